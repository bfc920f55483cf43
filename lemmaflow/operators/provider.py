"""Works of a bibliographic provider as papers and edges, and the step that takes a fetched
neighbourhood in (ID08-ID10, ID12, ID13, FLT17, FLT18, FLT23, MRG02, MRG03, MRG22, MRG23, STM01, STM02, STM05).

A work is (id, ids_openalex, ids_doi, doi, display_name, title, authors array of (name, raw),
publication_date, publication_year, type, primary, best and locations, each location a struct
(landing_page_url, source, license), biblio struct (volume, issue, first_page, last_page),
referenced array). Papers are (paper_id, title, authors, date, venue, status, identifiers map,
links, provenance, license, coverage, version). Texts in the outcome are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import stash
from ..functions.identifiers import nonempty, openalex_id, paper_id, stable_identifier, venue
from . import merge
from .joins import any_key_matches

COVERAGE = "struct<outgoing_found:bigint,outgoing_resolved:bigint,incoming_found:bigint,incoming_resolved:bigint,incoming_status:string,searches:bigint,closed:boolean,note:string>"
#: fixed values: providers whose records are a source's own bibliography
AUDITED = ("author-manuscript", "arXiv source bibliography")
_QUEUED = "Discovered through an OpenAlex citation edge; direct incoming and outgoing neighborhoods remain queued."
_RESOLVED = "An exact OpenAlex identity was resolved from citation-neighborhood evidence; direct incoming and outgoing neighborhoods are queued."
_FETCHED = "OpenAlex direct incoming and outgoing neighborhoods were fetched completely for this provider. Newly discovered papers remain in the persistent recursive queue."


def work_id() -> Column:
    return openalex_id(F.coalesce("id", "ids_openalex"))


def work_arxiv() -> Column:
    """The first arXiv id among the primary, the best and the other locations' addresses."""
    pages = F.concat(F.array(F.col("primary.landing_page_url"), F.col("best.landing_page_url")), F.coalesce(F.transform("locations", lambda x: x["landing_page_url"]), F.array()))
    found = F.transform(pages, lambda u: F.regexp_extract(F.coalesce(nonempty(u), F.lit("")), r"(?i)arxiv\.org/(?:abs|pdf)/([^?#]+?)(?:\.pdf)?$", 1))
    return F.nullif(F.get(F.filter(found, lambda x: x != ""), 0), F.lit(""))


def source_links(openalex: Column, doi: Column, arxiv: Column) -> Column:
    """Labelled addresses of the identifiers that are there, each address once."""
    link = lambda label, url: F.struct(F.lit(label).alias("label"), url.alias("url"))
    listed = F.array(
        F.when(openalex.isNotNull(), link("OpenAlex", F.concat(F.lit("https://openalex.org/"), openalex))),
        F.when(doi.isNotNull(), link("DOI", F.concat(F.lit("https://doi.org/"), doi))),
        F.when(arxiv.isNotNull(), link("arXiv", F.concat(F.lit("https://arxiv.org/abs/"), F.regexp_replace(arxiv, r"(?i)v\d+$", "")))),
    )
    return F.array_compact(listed)


def cache_envelope(url: Column, retrieved_at: Column, body: Column) -> Column:
    return F.struct(url.alias("url"), retrieved_at.alias("retrievedAt"), body.alias("body"))


def provenance_key(entry: Column) -> Column:
    """The key by which provenance entries are the same."""
    parts = [entry["provider"], entry["record_id"], entry["retrieved_at"], F.coalesce(entry["evidence_url"], F.lit(""))]
    return F.concat_ws("\u0000", *parts)


def papers_of(works: DataFrame) -> DataFrame:
    """Provisional papers of works with their ``retrieved_at``; works without a stable id give no row."""
    rows = works.withColumns({"w": work_id(), "d": stable_identifier(F.lit("doi"), F.coalesce("doi", "ids_doi")), "x": work_arxiv()}).where("w is not null")
    w, d, x, at = (F.col(c) for c in ("w", "d", "x", "retrieved_at"))
    authors = F.array_compact(F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string,raw:string>>")), lambda a: nonempty(F.coalesce(a["name"], a["raw"]))))
    source = F.coalesce(F.col("primary.source"), F.get(F.filter(F.transform("locations", lambda y: y["source"]), lambda y: F.length(y) > 0), 0))
    license_ = nonempty(F.coalesce(F.col("best.license"), F.col("primary.license")))
    ids = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in (("openAlex", w), ("doi", d), ("arxiv", x))])))
    provenance = F.array(F.struct(F.lit("OpenAlex").alias("provider"), w.alias("record_id"), at.alias("retrieved_at"), F.lit(None).cast("string").alias("evidence_url")))
    zero = F.lit(0).cast("long")
    coverage = F.struct(*[zero.alias(n) for n in ("outgoing_found", "outgoing_resolved", "incoming_found", "incoming_resolved")], F.lit("queued").alias("incoming_status"), zero.alias("searches"), F.lit(False).alias("closed"), F.lit(_QUEUED).alias("note"))
    return rows.select(
        paper_id(w).alias("paper_id"),
        F.coalesce(nonempty(F.coalesce("display_name", "title")), F.concat(F.lit("Untitled OpenAlex work "), w)).alias("title"),
        F.when(F.size(authors) > 0, authors).otherwise(F.array(F.lit("Unknown author"))).alias("authors"),
        F.coalesce(nonempty(F.col("publication_date")), F.col("publication_year").cast("string"), F.lit("Undated")).alias("date"),
        venue(source, *[F.col(f"biblio.{n}") for n in ("volume", "issue", "first_page", "last_page")]).alias("venue"),
        F.lit("provisional").alias("status"),
        ids.alias("identifiers"),
        source_links(w, d, x).alias("links"),
        provenance.alias("provenance"),
        F.coalesce(F.concat(F.lit("OpenAlex reports license "), license_, F.lit("; full-text reuse has not been independently verified.")), F.lit("No normalized reusable full-text license confirmed.")).alias("license"),
        coverage.cast(COVERAGE).alias("coverage"),
        F.concat(F.lit("openalex:"), at).alias("version"),
    )


def merge_papers(existing: DataFrame, found: DataFrame) -> DataFrame:
    """All papers after an upsert: existing values win, identifiers, links and provenance are
    united. Coverage of papers that are there stays."""
    combine = {
        "identifiers": merge.merge_maps,
        "links": lambda a, b: merge.union_by(a, b, lambda x: x["url"]),
        "provenance": lambda a, b: merge.union_by(a, b, provenance_key),
    }
    return merge.upsert(existing, found, "paper_id", combine)


def matched(papers: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` under the id of the paper that shares an identifier, its own id without one.
    One that matches several papers is ambiguous and keeps its id with ``ambiguous`` true."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.select("paper_id", "identifiers")

    kinds = ("openAlex", "doi", "arxiv")
    value = {k: stable_identifier(F.lit(k), F.try_element_at("identifiers", F.lit(k))) for k in kinds}
    pairs = any_key_matches(keyed(found), keyed(papers), "paper_id", {k: (v, v) for k, v in value.items()})
    target = pairs.groupBy(F.col("own").alias("paper_id")).agg(F.count_distinct("other").alias("n"), F.min("other").alias("target"))
    rows = found.join(target, "paper_id", "left")
    return rows.withColumns({"ambiguous": F.coalesce(F.col("n") > 1, F.lit(False)), "paper_id": F.when(F.col("n") == 1, F.col("target")).otherwise(F.col("paper_id"))}).drop("n", "target")


def is_audited(provenance: Column) -> Column:
    """True for edges whose evidence is the source's own bibliography."""
    return F.exists(provenance, lambda e: e["provider"].isin(*AUDITED))


def audited_papers(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id) of papers whose outgoing coverage rests on their own bibliography."""
    own = edges.where(is_audited(F.col("provenance"))).select(F.col("citing").alias("paper_id")).distinct()
    return papers.select("paper_id").join(own, "paper_id", "left_semi")


def refresh(unresolved: Column) -> Column:
    """True if a queue row's outgoing records are to be fetched anew."""
    return F.size(F.coalesce(unresolved, F.array().cast("array<string>"))) > 0


def edges_of(records: DataFrame) -> DataFrame:
    """records: (seed, paper_id, direction, record_id, retrieved_at, url). One edge for each."""
    out = F.col("direction") == "outgoing"
    citing, cited = F.when(out, F.col("seed")).otherwise(F.col("paper_id")), F.when(out, F.col("paper_id")).otherwise(F.col("seed"))
    entry = F.struct(F.lit("OpenAlex").alias("provider"), F.coalesce("record_id", F.lit("unresolved-work-id")).alias("record_id"), F.col("retrieved_at"), F.col("url").alias("evidence_url"))
    return records.select(F.concat_ws("-", F.lit("citation"), citing, cited).alias("edge_id"), citing.alias("citing"), cited.alias("cited"), F.col("seed").alias("source"), "direction", F.array(entry).alias("provenance"), F.lit("provider-linked").alias("confidence"))


def merge_provider_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (citing, cited): the stored one's id, source and direction stay, the stronger
    confidence wins and provenance entries are united in order."""
    both = edges.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    rank = merge.confidence_rank(F.col("confidence"))
    first = F.struct("seq", "edge_id", "source", "direction")
    out = both.groupBy("citing", "cited").agg(F.min(first).alias("f"), F.max_by("confidence", F.struct(rank, -F.col("seq"))).alias("confidence"), F.array_sort(F.collect_list(F.struct("seq", "provenance"))).alias("all"))
    every = F.flatten(F.transform("all", lambda x: x["provenance"]))
    return out.select("f.edge_id", "citing", "cited", "f.source", "f.direction", merge.union_by(every, F.array().cast("array<struct<provider:string,record_id:string,retrieved_at:string,evidence_url:string>>"), provenance_key).alias("provenance"), "confidence")


def coverage_after(papers: DataFrame, counts: DataFrame, audited: DataFrame) -> DataFrame:
    """``papers`` with the coverage of a finished fetch. counts: (paper_id, outgoing_found,
    outgoing_resolved, incoming_found, missing); audited: (paper_id), whose counts never
    shrink and whose note stays."""
    mark = audited.select("paper_id", F.lit(True).alias("audited"))
    renamed = counts.toDF("paper_id", "of", "or", "if", "missing")
    rows = papers.join(renamed, "paper_id", "left").join(mark, "paper_id", "left")
    old, keep = F.col("coverage"), F.coalesce("audited", F.lit(False))
    pick = lambda new, name: F.when(keep, F.greatest(old[name], F.col(new))).otherwise(F.col(new)).cast("long").alias(name)
    n = F.size("missing")
    short = F.concat(F.lit("OpenAlex returned no work record for "), n.cast("string"), F.lit(" referenced identifier(s). Those exact IDs remain on this paper's queue item for retry; the direct neighborhood is not marked complete."))
    note = F.when(keep, old["note"]).when(n == 0, _FETCHED).otherwise(short)
    new = F.struct(pick("of", "outgoing_found"), pick("or", "outgoing_resolved"), pick("if", "incoming_found"), pick("if", "incoming_resolved"), F.lit("provider-visible-only").alias("incoming_status"), (F.coalesce(old["searches"], F.lit(0)) + 2).cast("long").alias("searches"), F.lit(False).alias("closed"), note.alias("note"))
    return rows.withColumn("coverage", F.when(F.col("of").isNotNull(), new.cast(COVERAGE)).otherwise(old)).select(*papers.columns)


def integrate(papers: DataFrame, edges: DataFrame, queue: DataFrame, seeds: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """Take fetched neighbourhoods in, all seeds of a round at once. seeds: works with (seed,
    retrieved_at, completed_at); records: works with (seed, direction, retrieved_at, url).

    Seeds update their paper. Records become papers, matched by exact identifiers; those that
    match several papers are left out and returned as ``ambiguous``. A seed whose coverage rests
    on its own bibliography takes only outgoing records that it cites already. Edges merge by
    their ends; counts, queue rows and errors follow from what is stored then."""
    audited = stash(audited_papers(papers, edges), "round-audited")
    named = papers_of(seeds).withColumnRenamed("paper_id", "candidate").join(seeds.select("seed", work_id().alias("w")), F.col("identifiers")["openAlex"] == F.col("w")).drop("w", "candidate").withColumnRenamed("seed", "paper_id")
    known = stash(merge_papers(papers, named.select(*papers.columns)).where("not added").drop("added"), "round-known")

    listed = records.select("seed", "direction", "retrieved_at", "url", work_id().alias("record_id")).where("record_id is not null")
    found = stash(matched(known, papers_of(records).dropDuplicates(["paper_id"])), "round-found")
    place = found.select(F.col("paper_id"), F.col("identifiers")["openAlex"].alias("record_id"), "ambiguous")
    rows = listed.join(place, "record_id")
    cited = edges.where(is_audited(F.col("provenance"))).select(F.col("citing").alias("seed"), F.col("cited").alias("paper_id"), F.lit(True).alias("cites"))
    own = audited.select(F.col("paper_id").alias("seed"), F.lit(True).alias("own"))
    rows = stash(rows.join(own, "seed", "left").join(cited.distinct(), ["seed", "paper_id"], "left"), "round-rows")
    taken = rows.where("not ambiguous").where(~(F.coalesce("own", F.lit(False)) & (F.col("direction") == "outgoing") & F.col("cites").isNull()))

    new = found.join(taken.select("paper_id").distinct(), "paper_id", "left_semi").drop("ambiguous")
    new = new.groupBy("paper_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "paper_id"]), F.col("identifiers")["openAlex"]).alias("p")).select("paper_id", "p.*")
    all_papers = stash(merge_papers(known, new.select(*papers.columns)), "round-papers")
    all_edges = stash(merge_provider_edges(edges, edges_of(taken.where("seed <> paper_id")).select(*edges.columns)), "round-edges")

    expected = seeds.select("seed", F.explode("referenced").alias("raw")).select("seed", openalex_id(F.col("raw")).alias("ref")).where("ref is not null").distinct()
    fetched = listed.where("direction = 'outgoing'").select("seed", F.col("record_id").alias("ref")).distinct()
    stored = all_edges.join(all_papers.select(F.col("paper_id").alias("cited"), openalex_id(F.try_element_at("identifiers", F.lit("openAlex"))).alias("ref")), "cited").where("ref is not null").select(F.col("citing").alias("seed"), "ref").distinct()
    there = fetched.unionByName(stored).distinct().withColumn("there", F.lit(True))
    out = expected.join(there, ["seed", "ref"], "left").groupBy("seed").agg(F.count("*").alias("of"), F.count_if("there").alias("or"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("ref")))).alias("missing"))
    into = listed.where("direction = 'incoming'").groupBy("seed").agg(F.count_distinct("record_id").alias("if"))
    counts = seeds.select("seed").join(out, "seed", "left").join(into, "seed", "left").select(F.col("seed").alias("paper_id"), F.coalesce("of", F.lit(0)).alias("of"), F.coalesce("or", F.lit(0)).alias("or"), F.coalesce("if", F.lit(0)).alias("if"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
    counts = stash(counts, "round-counts")

    fresh = taken.groupBy("paper_id").agg(F.min("retrieved_at").alias("updated_at"))
    awake = taken.groupBy("paper_id").agg(F.max("retrieved_at").alias("retrieved_at"))
    waiting = queue.where((F.col("state") == "blocked") & F.array_contains("tasks", "resolve-identifiers")).join(awake, "paper_id", "left_semi").select("paper_id", F.lit(True).alias("woken"))
    rows_new = fresh.select("paper_id", F.lit("metadata-fetched").alias("state"), F.array(*[F.lit(t) for t in merge.TASKS]).alias("tasks"), F.lit(0).alias("attempts"), "updated_at")
    after = merge.reactivate(merge.merge_queue(queue, rows_new), awake)
    done = seeds.select(F.col("seed").alias("paper_id"), F.col("completed_at").alias("at")).join(counts.select("paper_id", "missing"), "paper_id").join(audited.withColumn("audited", F.lit(True)), "paper_id", "left")
    outcome = F.when(F.col("audited"), "audited").when(F.size("missing") == 0, "complete").otherwise("incomplete")
    after = merge.apply_outcomes(after, done.select("paper_id", outcome.alias("outcome"), "at", F.col("missing").alias("unresolved")))

    rested = all_papers.drop("added").join(waiting, "paper_id", "left")
    c = F.col("coverage")
    woken = F.coalesce(F.col("woken") & (c["incoming_status"] == "identifier-unresolved"), F.lit(False))
    rested = rested.withColumn("coverage", F.when(woken, c.withField("incoming_status", F.lit("queued")).withField("note", F.lit(_RESOLVED))).otherwise(c)).drop("woken")
    return {
        "papers": coverage_after(rested, counts, audited),
        "edges": all_edges,
        "queue": after,
        "ambiguous": rows.where("ambiguous").select("seed", "record_id"),
        "added_papers": all_papers.where("added").select("paper_id"),
    }

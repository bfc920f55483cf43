"""Reviewed citation audits merged into a snapshot (MRG06-MRG11, MRG13-MRG21, MRG24-MRG29, VAL16).

An audit is a table of records (direction, paper_id, bib_key, title, authors, date, venue,
identifiers map, lines array, evidence, reuse) and the parameters of ``Audit``. Papers, edges and
queue rows are those of ``provider``; a paper's ``history`` is an array of (version, at, summary).
What an importer would refuse is a row of (rule, entity, detail), not an exception.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import stable_identifier
from . import merge, provider
from .joins import any_key_matches

ENTRY = "struct<provider:string,record_id:string,retrieved_at:string,evidence_url:string>"
HISTORY = "array<struct<version:string,at:string,summary:string>>"
_BLOCKED = "No exact OpenAlex work identity is present in the reviewed citation audit; title-only resolution is prohibited."
_UNKNOWN = "This direct neighbor has no OpenAlex work identity in the reviewed metadata. Its recursive incoming and outgoing neighborhoods are blocked pending identifier resolution."


@dataclass(frozen=True)
class Audit:
    """Whose citations, when, from which archive, and what version the audit's papers carry."""

    seed: str
    as_of: str
    version: str
    archive: str
    archive_url: str
    query_url: str
    via: str


def _entry(provider_: Column, record: Column, at: str, url: Column) -> Column:
    return F.struct(provider_.alias("provider"), record.alias("record_id"), F.lit(at).alias("retrieved_at"), url.alias("evidence_url")).cast(ENTRY)


def _id(name: str) -> Column:
    return F.nullif(F.try_element_at("identifiers", F.lit(name)), F.lit(""))


def identifier_links(archive_url: Column, bib_key: Column) -> Column:
    """Links of an endpoint: the bibliography it stands in, then its identifiers."""
    first = F.struct(F.concat(F.lit("arXiv v2 bibliography ("), bib_key, F.lit(")")).alias("label"), archive_url.alias("url"))
    known = provider.source_links(_id("openAlex"), _id("doi"), _id("arxiv"))
    order = F.concat(F.filter(known, lambda x: x["label"] != "OpenAlex"), F.filter(known, lambda x: x["label"] == "OpenAlex"))
    return F.concat(F.array(first), order)


def audit_papers(records: DataFrame, audit: Audit) -> DataFrame:
    """Provisional papers of an audit's records, both directions."""
    out = F.col("direction") == "outgoing"
    none = F.lit(None).cast("string")
    doi = stable_identifier(F.lit("doi"), _id("doi"))
    by = F.when(F.col("evidence") == "reviewed-existing-record", "reviewed direct-neighborhood audit").otherwise("Crossref reference metadata")
    outgoing = F.array_compact(F.array(
        _entry(F.lit("arXiv source bibliography"), F.concat(F.lit(f"{audit.archive}:"), "bib_key"), audit.as_of, none),
        F.when(doi.isNotNull(), _entry(by, doi, audit.as_of, none)),
        F.when(_id("arxiv").isNotNull(), _entry(F.lit("arXiv"), _id("arxiv"), audit.as_of, none)),
    ))
    incoming = F.array(_entry(F.lit("OpenAlex version-family query"), _id("openAlex"), audit.as_of, none))
    queried = F.concat(F.array(F.struct(F.lit("OpenAlex version-family query").alias("label"), F.lit(audit.query_url).alias("url"))), provider.source_links(_id("openAlex"), _id("doi"), F.lit(None).cast("string")))
    status = F.when(_id("openAlex").isNotNull(), "queued").otherwise("identifier-unresolved")
    zero = F.lit(0).cast("long")
    coverage = F.struct(*[zero.alias(n) for n in ("outgoing_found", "outgoing_resolved", "incoming_found", "incoming_resolved")], status.alias("incoming_status"), zero.alias("searches"), F.lit(False).alias("closed"), F.when(_id("openAlex").isNull(), _UNKNOWN).otherwise("").alias("note"))
    summary = F.when(out, F.concat(F.lit("Created a source-resolved endpoint for bibliography key "), "bib_key", F.lit("; no title-only merge was used."))).otherwise(F.concat(F.lit("Created a provider-linked incoming endpoint from exact OpenAlex work "), _id("openAlex"), F.lit(".")))
    return records.select(
        "paper_id", "title", "authors", "date", "venue", F.lit("provisional").alias("status"), "identifiers",
        F.when(out, identifier_links(F.lit(audit.archive_url), F.col("bib_key"))).otherwise(queried).alias("links"),
        F.when(out, outgoing).otherwise(incoming).alias("provenance"),
        coverage.cast(provider.COVERAGE).alias("coverage"),
        F.array(F.struct(F.lit(audit.version).alias("version"), F.lit(audit.as_of).alias("at"), summary.alias("summary"))).cast(HISTORY).alias("history"),
    )


def audit_edges(records: DataFrame, audit: Audit) -> DataFrame:
    """records with ``paper_id`` as merged. Edges from the seed are reviewed, those to it
    linked by the provider."""
    out = F.col("direction") == "outgoing"
    place = F.concat(F.lit(f"{audit.archive}:"), "bib_key", F.lit(":lines-"), F.array_join(F.transform("lines", lambda x: x.cast("string")), "-"))
    entry = F.when(out, _entry(F.lit("arXiv source bibliography"), place, audit.as_of, F.lit(audit.archive_url))).otherwise(_entry(F.lit(f"OpenAlex version-family via {audit.via}"), _id("openAlex"), audit.as_of, F.lit(audit.query_url)))
    seed = F.lit(audit.seed)
    name = F.when(out, F.concat_ws("-", F.lit("citation"), seed, F.lower("bib_key"))).otherwise(F.concat_ws("-", F.lit("citation"), F.col("paper_id"), seed))
    return records.select(
        name.alias("edge_id"), F.when(out, seed).otherwise(F.col("paper_id")).alias("citing"), F.when(out, F.col("paper_id")).otherwise(seed).alias("cited"),
        seed.alias("source"), "direction", F.array(entry).alias("provenance"), F.when(out, "manual-reviewed").otherwise("provider-linked").alias("confidence"),
    )


def endpoint_queue(papers: DataFrame, audit: Audit) -> DataFrame:
    """A queue row for each paper: blocked until it has a provider's identity."""
    known = _id("openAlex").isNotNull()
    tasks = F.when(known, F.array(*[F.lit(t) for t in merge.TASKS])).otherwise(F.array(F.lit("resolve-identifiers")))
    return papers.select("paper_id", F.when(known, "metadata-fetched").otherwise("blocked").alias("state"), tasks.alias("tasks"), F.lit(0).alias("attempts"), F.lit(audit.as_of).alias("updated_at"), F.when(~known, _BLOCKED).alias("last_error"))


def reviewed_matches(papers: DataFrame, new: DataFrame, audit: Audit) -> tuple[DataFrame, DataFrame]:
    """new: papers of an audit with ``reuse``. First, (paper_id, target) of those that may be
    merged; second, the refused ones (rule, entity, detail): a paper that was there before is
    only reused if the record declares it and an identifier other than an internal one agrees."""
    kinds = ("openAlex", "doi", "arxiv", "semanticScholar", "isbn", "internal")
    value = {k: stable_identifier(F.lit(k), F.try_element_at("identifiers", F.lit(k))) for k in kinds}
    pairs = any_key_matches(new.select("paper_id", "identifiers"), papers.select("paper_id", "identifiers"), "paper_id", {k: (v, v) for k, v in value.items()})
    hits = pairs.groupBy(F.col("own").alias("paper_id")).agg(F.count_distinct("other").alias("n"), F.min("other").alias("target"), F.min("kinds").alias("kinds"))
    made = F.coalesce(F.exists("history", lambda h: h["version"] == audit.version), F.lit(False))
    old = papers.select(F.col("paper_id").alias("o"), made.alias("own_audit"))
    same = papers.select(F.col("paper_id").alias("s"), made.alias("same_audit"))
    rows = new.select("paper_id", "reuse").join(hits, "paper_id", "left").join(old, F.col("target") == F.col("o"), "left").join(same, F.col("paper_id") == F.col("s"), "left")
    declared = F.col("reuse").isNotNull()
    reason = (
        F.when(F.col("n") > 1, "ambiguous-identity")
        .when(declared & ~F.col("target").eqNullSafe(F.col("reuse")), "reuse-without-match")
        .when(declared & (F.col("kinds") == "internal"), "reuse-by-internal-id-only")
        .when(~declared & F.col("target").isNotNull() & ~F.col("own_audit"), "undeclared-reuse")
        .when(~declared & F.col("s").isNotNull() & ~F.col("same_audit") & ~F.col("s").eqNullSafe(F.col("target")), "id-collision")
    )
    judged = rows.withColumn("rule", reason)
    return judged.where("rule is null").select("paper_id", F.coalesce("target", "paper_id").alias("target")), judged.where("rule is not null").select("rule", F.col("paper_id").alias("entity"), F.coalesce("target", F.lit("")).alias("detail"))


def without_stale_provenance(papers: DataFrame, records: DataFrame, audit: Audit) -> DataFrame:
    """``papers`` without the provider entries that a record, since reviewed, has overtaken.
    records: (paper_id, identifiers, evidence)."""
    gone = records.where("evidence = 'reviewed-existing-record'").groupBy("paper_id").agg(F.collect_set(stable_identifier(F.lit("doi"), _id("doi"))).alias("dois"))
    rows = papers.join(gone, "paper_id", "left")
    stale = lambda e: (e["provider"] == "Crossref reference metadata") & (e["retrieved_at"] == audit.as_of) & F.array_contains("dois", stable_identifier(F.lit("doi"), e["record_id"]))
    return rows.withColumn("provenance", F.when(F.col("dois").isNull(), F.col("provenance")).otherwise(F.filter("provenance", lambda e: ~F.coalesce(stale(e), F.lit(False))))).drop("dois")


def add_history(history: Column, version: str, at: str, summary: str) -> Column:
    """The history with an entry of that version, if it has none yet."""
    entry = F.array(F.struct(F.lit(version).alias("version"), F.lit(at).alias("at"), F.lit(summary).alias("summary"))).cast(HISTORY)
    return F.when(F.coalesce(F.exists(history, lambda h: h["version"] == version), F.lit(False)), history).otherwise(F.concat(F.coalesce(history, F.array().cast(HISTORY)), entry))


def align_blocked(papers: DataFrame, touched: DataFrame, audit: Audit) -> DataFrame:
    """``papers`` of which the touched ones (paper_id) without a provider's identity say so."""
    mark = touched.select("paper_id").distinct().withColumn("touched", F.lit(True))
    rows = papers.join(mark, "paper_id", "left")
    wanting = F.coalesce("touched", F.lit(False)) & _id("openAlex").isNull()
    c = F.col("coverage")
    changed = c.withField("incoming_status", F.lit("identifier-unresolved")).withField("closed", F.lit(False)).withField("note", F.lit(_UNKNOWN))
    past = add_history(F.col("history"), f"{audit.version}:identity-state", audit.as_of, "Marked the recursive citation neighborhood blocked pending a resolvable provider work identity.")
    return rows.withColumns({"coverage": F.when(wanting, changed).otherwise(c), "history": F.when(wanting, past).otherwise(F.col("history"))}).drop("touched")


def update_seed(papers: DataFrame, audit: Audit, counts: tuple[int, int], searches: int, note: str) -> DataFrame:
    """``papers`` with the seed's coverage set to the audit's counts (outgoing, incoming);
    searches never shrink, and the history gets an entry once."""
    mine = F.col("paper_id") == audit.seed
    c = F.col("coverage")
    new = F.struct(
        *[F.lit(n).cast("long").alias(name) for n, name in zip((counts[0], counts[0], counts[1], counts[1]), ("outgoing_found", "outgoing_resolved", "incoming_found", "incoming_resolved"))],
        F.lit("provider-visible-only").alias("incoming_status"), F.greatest(F.coalesce(c["searches"], F.lit(0)), F.lit(searches)).cast("long").alias("searches"), F.lit(False).alias("closed"), F.lit(note).alias("note"),
    )
    return papers.withColumns({"coverage": F.when(mine, new.cast(provider.COVERAGE)).otherwise(c), "history": F.when(mine, add_history(F.col("history"), audit.version, audit.as_of, note)).otherwise(F.col("history"))})


def update_seed_queue(queue: DataFrame, audit: Audit, error: str) -> DataFrame:
    """``queue`` with the seed's row under review; attempts and time never go back."""
    spark = queue.sparkSession
    row = spark.range(1).select(F.lit(audit.seed).alias("paper_id"), F.lit("neighbors-fetched").alias("state"), F.array(F.lit("deduplicate"), F.lit("review-match")).alias("tasks"), F.lit(1).alias("attempts"), F.lit(audit.as_of).alias("updated_at"), F.lit(error).alias("last_error"))
    old = queue.where(F.col("paper_id") == audit.seed).select("paper_id", F.col("attempts").alias("a"), F.col("updated_at").alias("u"))
    mine = row.join(old, "paper_id", "left").select("paper_id", "state", "tasks", F.greatest("attempts", "a").alias("attempts"), F.greatest("updated_at", "u").alias("updated_at"), "last_error")
    return queue.where(F.col("paper_id") != audit.seed).select(mine.columns).unionByName(mine)


def merge_audit(papers: DataFrame, edges: DataFrame, queue: DataFrame, records: DataFrame, audit: Audit, blocks: bool = False) -> dict[str, DataFrame]:
    """A snapshot after an audit. Merging the same audit again changes nothing."""
    new = audit_papers(records, audit)
    targets, refused = reviewed_matches(papers, new.join(records.select("paper_id", "reuse"), "paper_id"), audit)
    placed = new.join(targets, "paper_id").drop("paper_id").withColumnRenamed("target", "paper_id").select(new.columns)
    placed = placed.groupBy("paper_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "paper_id"]), "title").alias("p")).select("paper_id", "p.*")
    merged = provider.merge_papers(papers, placed.select([c for c in papers.columns if c in placed.columns]))
    mine = records.join(targets, "paper_id").drop("paper_id").withColumnRenamed("target", "paper_id")
    kept = without_stale_provenance(merged.drop("added"), mine, audit)
    kept = align_blocked(kept, mine, audit) if blocks else kept
    touched = kept.join(mine.select("paper_id").distinct(), "paper_id", "left_semi")
    return {
        "papers": kept,
        "edges": provider.merge_provider_edges(edges, audit_edges(mine, audit).select(edges.columns)),
        "queue": merge.merge_queue(queue, endpoint_queue(touched, audit), blocks),
        "refused": refused,
        "added_papers": merged.where("added").select("paper_id"),
    }


def audit_rules(records: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Violations of an audit: keys that repeat, fields that are missing, and numbers of
    records by direction that are not the expected ones."""
    from ..plans.rules import _rows, holds, unique

    out, into = records.where("direction = 'outgoing'"), records.where("direction = 'incoming'")
    n = records.groupBy("direction").agg(F.count("*").alias("n"))
    wanted = records.sparkSession.createDataFrame(list(expected.items()), "direction string, wanted long")
    wrong = wanted.join(n, "direction", "left").where(F.coalesce("n", F.lit(0)) != F.col("wanted"))
    filled = (F.length("title") > 0) & (F.size("authors") > 0) & (F.length("date") > 0) & (F.length("venue") > 0)
    return reduce(DataFrame.unionByName, [
        unique(out, "bib-key-once", ["bib_key"]),
        unique(out, "endpoint-once", ["paper_id"]),
        unique(into.withColumn("work", _id("openAlex")), "work-once", ["work"]),
        holds(out, "outgoing-whole", filled & (F.length("bib_key") > 0) & (F.size("lines") > 0) & _id("internal").isNotNull(), F.col("paper_id")),
        holds(into, "incoming-whole", filled & F.regexp_like(_id("openAlex"), F.lit(r"^W[0-9]+$")), F.col("paper_id")),
        _rows(wrong, "record-count", F.col("direction"), F.coalesce("n", F.lit(0))),
    ])


def assemble(primary: DataFrame, neighbours: DataFrame, packs: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """A corpus of primary papers, gold packs and the neighbourhood's papers, the first of
    which wins by id. Second, collisions (rule, entity, detail): ids that primary papers and packs
    share, and packs that repeat."""
    from ..plans.rules import unique

    ranked = reduce(DataFrame.unionByName, [df.withColumn("rank__", F.lit(n)) for n, df in enumerate((primary, packs, neighbours))])
    best = ranked.groupBy(key).agg(F.min("rank__").alias("best__"))
    both = primary.select(key).distinct().join(packs.select(key).distinct(), key, "left_semi")
    clashes = both.select(F.lit("pack-collides").alias("rule"), F.col(key).cast("string").alias("entity"), F.lit("").alias("detail"))
    clashes = clashes.unionByName(unique(packs, "pack-once", [key])).unionByName(unique(primary, "primary-once", [key]))
    return ranked.join(best, key).where("rank__ = best__").drop("rank__", "best__"), clashes

"""Regions of lines and owners in books (JOIN15, JOIN17, JOIN22, JOIN26, JOIN27, JOIN29, JOIN31, JOIN32, JOIN36,
AGG24, GRF17, ORD02, ORD10, SET08, SET11, VAL32). Lines are (component, unit, line, text), line from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import without_comments

_UNIT = ["component", "unit"]
#: fixed values: heading commands from high to low, and environments that bound prose
RANKS = ("chapter", "section", "subsection", "subsubsection", "paragraph")
_BOUNDS = r"\\(?:begin|end)\{(?:proof|lemma|proposition|theorem|definition|situation)\}"


def lines_of(units: DataFrame) -> DataFrame:
    """The lines of units (component, unit, content), comments left out."""
    rows = units.select("component", "unit", F.posexplode(F.split("content", "\r?\n")).alias("n", "raw"))
    return rows.select("component", "unit", (F.col("n") + 1).alias("line"), without_comments(F.col("raw")).alias("text"))


def heading_rank(text: Column) -> Column:
    """0 for a chapter and so on; null for a line that is no heading."""
    name = F.regexp_extract(text, r"^\s*\\(chapter|section|subsection|subsubsection|paragraph)\b", 1)
    return F.when(name != "", F.array_position(F.array(*[F.lit(r) for r in RANKS]), name).cast("int") - 1)


def _next_of_rank(rank: Column, value: Column, order: list[str], levels: range) -> Column:
    """The value at the next row, in order, whose rank is not below that of the row."""
    after = W.partitionBy(*_UNIT).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(*[F.when(rank == r, F.last(F.when(rank <= r, value), ignorenulls=True).over(after)) for r in levels])


def section_ranges(lines: DataFrame) -> DataFrame:
    """Headings with the lines they own: up to the next heading of their rank or above, empty
    lines at the end left out. (component, unit, start_line, end_line, rank)"""
    rank = heading_rank(F.col("text"))
    last = W.partitionBy(*_UNIT)
    filled = F.last(F.when(F.trim("text") != "", F.col("line")), ignorenulls=True).over(last.orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = lines.select(*_UNIT, "line", rank.alias("rank"), filled.alias("filled"), F.max("line").over(last).alias("final"))
    heads = rows.where("rank is not null")
    ended = heads.select(*_UNIT, F.col("line").alias("start_line"), "rank", F.coalesce(_next_of_rank(F.col("rank"), F.col("line") - 1, ["line"], range(len(RANKS))), F.col("final")).alias("stop"))
    spots = rows.select(*_UNIT, F.col("line").alias("stop"), "filled")
    return ended.join(spots, [*_UNIT, "stop"]).select(*_UNIT, "start_line", F.greatest("filled", "start_line").alias("end_line"), "rank")


def prose_ranges(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: (component, unit, line). The paragraph around each: as far as no empty line, heading
    or bound of an environment stands before or after."""
    stops = (F.trim("text") == "") | heading_rank(F.col("text")).isNotNull() | F.regexp_like("text", F.lit(_BOUNDS))
    w = W.partitionBy(*_UNIT).orderBy("line")
    stop = F.when(stops, F.col("line"))
    before = F.last(stop, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.last(stop, ignorenulls=True).over(W.partitionBy(*_UNIT).orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, -1))
    rows = lines.select(*_UNIT, "line", (F.coalesce(before, F.lit(0)) + 1).alias("start_line"), (F.coalesce(after, F.max("line").over(W.partitionBy(*_UNIT)) + 1) - 1).alias("end_line"))
    return labels.join(rows, [*_UNIT, "line"])


def discussion_regions(lines: DataFrame, owners: DataFrame, proofs: DataFrame) -> DataFrame:
    """owners: (component, unit, node, start_line); proofs: (component, unit, end_line). The lines
    between the last proof or heading before an owner and the owner; end before start means none."""
    bounds = lines.where(heading_rank(F.col("text")) <= 3).select(*_UNIT, "line").unionByName(proofs.select(*_UNIT, F.col("end_line").alias("line")))
    events = bounds.select(*_UNIT, "line", F.col("line").alias("bound"), F.lit(None).cast(dict(owners.dtypes)["node"]).alias("node"))
    events = events.unionByName(owners.select(*_UNIT, F.col("start_line").alias("line"), F.lit(None).cast("int").alias("bound"), "node"))
    # an owner stands before a bound on its own line
    w = W.partitionBy(*_UNIT).orderBy("line", F.col("bound").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    found = events.withColumn("last", F.max("bound").over(w)).where("node is not null")
    return found.select(*_UNIT, "node", (F.coalesce("last", F.lit(0)) + 1).alias("start_line"), (F.col("line") - 1).alias("end_line"))


def proof_regions(headings: DataFrame) -> DataFrame:
    """headings: (component, unit, position, level, title, length of the unit). Regions of proofs in web
    pages: from a heading that names one to the next heading of its level or above."""
    named = F.regexp_like("title", F.lit(r"(?i)^(?:proof|derivation|why\s+it(?:'s|\s+is)\s+true|explanation)(?:\b|\s|:)"))
    rows = headings.withColumn("stop", F.coalesce(_next_of_rank(F.col("level"), F.col("position"), ["position"], range(1, 7)), F.col("length")))
    return rows.where(named).select(*_UNIT, F.col("position").alias("start"), F.col("stop").alias("end"), "title")


def explicit_owners(proofs: DataFrame, labels: DataFrame) -> DataFrame:
    """proofs: (component, proof, title); labels: (component, label, node, node_class). The theorem that
    a proof's title refers to, if that is exactly one."""
    refs = proofs.select("component", "proof", F.explode(F.regexp_extract_all("title", F.lit(r"\\ref\{([^{}]+)\}"))).alias("label"))
    theorems = labels.where("node_class = 'theorem-like'").select("component", "label", "node")
    found = refs.join(theorems, ["component", "label"]).groupBy("component", "proof").agg(F.min("node").alias("owner"), F.max("node").alias("other"))
    return found.where("owner = other").drop("other")


def citation_groups(citations: DataFrame) -> DataFrame:
    """citations: (owner, key, pinpoint, line). One group for each key and pinpoint, null like any other."""
    return citations.groupBy("owner", "key", F.coalesce("pinpoint", F.lit("")).alias("pinpoint")).agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("line")).alias("lines"))


def single_targets(entries: DataFrame, key: list[str], target: str) -> DataFrame:
    """Keys that stand once; those of several entries are ambiguous and left out."""
    return entries.groupBy(*key).agg(F.count("*").alias("n__"), F.min(target).alias(target)).where("n__ = 1").drop("n__")


def first_target_in_unit(groups: DataFrame) -> DataFrame:
    """groups: (owner, unit, target_unit, target_start). The first target of an owner in its own unit."""
    return groups.where("unit = target_unit").groupBy("owner").agg(F.min("target_start").alias("first_start"))


def semantic_groups(groups: DataFrame) -> DataFrame:
    """groups: (owner, target, seq, occurrences array, proof_lines array). One for each owner and target:
    occurrences in order, proof lines once each."""
    merged = groups.groupBy("owner", "target").agg(F.array_sort(F.collect_list(F.struct("seq", "occurrences", "proof_lines"))).alias("g"))
    flat = lambda name: F.flatten(F.transform("g", lambda x: x[name]))
    return merged.select("owner", "target", flat("occurrences").alias("occurrences"), F.array_distinct(flat("proof_lines")).alias("proof_lines"))


def not_preceding(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges (owner, target) whose target does not stand before the owner. places: (node, unit_order, start)."""
    at = lambda name: places.select(F.col("node").alias(name), F.struct("unit_order", "start").alias(f"{name}_at"))
    return edges.join(at("owner"), "owner").join(at("target"), "target").where("not target_at < owner_at").select("owner", "target")


def catalogue(papers: DataFrame) -> list[Column]:
    """The order of a catalogue: gold first, later dates first, then by title."""
    return [(F.col("status") == "gold").desc(), F.col("date").desc(), F.lower("title"), F.col("title")]


def first_ranges(ranges: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Ranges (start, end, title) of which the first for each key stays."""
    nth = F.row_number().over(W.partitionBy(*by, *key).orderBy("start", "end", "title"))
    return ranges.withColumn("nth__", nth).where("nth__ = 1").drop("nth__")


def append_new(existing: Column, links: Column) -> Column:
    """Entries of both arrays; of the second only those whose name the first has not."""
    old = F.coalesce(existing, F.slice(links, 1, 0))
    names = F.transform(old, lambda x: x["name"])
    return F.concat(old, F.filter(links, lambda x: ~F.array_contains(names, x["name"])))


def prior_paths(entries: DataFrame) -> DataFrame:
    """(path) of a manifest's entries, from the new or the old name of the field."""
    columns = [c for c in ("artifact_path", "path") if c in entries.columns]
    return entries.select(F.coalesce(*columns).alias("path")).where("path is not null")


def lost_paths(entries: DataFrame, present: DataFrame) -> DataFrame:
    """Paths that were there before and are gone, and unsafe ones: (rule, entity, detail)."""
    prior = prior_paths(entries)
    unsafe = prior.where(~F.regexp_like("path", F.lit(r"^S[0-9]{4}/[a-z0-9][a-z0-9-]*\.json$")))
    gone = prior.join(present.select("path"), "path", "left_anti")
    rows = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col("path").alias("entity"), F.lit("").alias("detail"))
    return reduce(DataFrame.unionByName, [rows(unsafe, "path-form"), rows(gone, "artifact-lost")])

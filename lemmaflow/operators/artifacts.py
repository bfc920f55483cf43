"""Source artifacts by label (JOIN28, EXT03, EXT04): which lines of a book a referenced label names.

A label belongs to the unit with the longest name that it starts with. Its first word says how
far it reaches: a section as far as its heading, an environment of that name, displayed mathematics, a list
item as far as the next one of its list, anything else its paragraph. Everything is lines and windows over them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse, without_comments
from .joins import innermost, longest_prefix
from .regions import heading_rank, lines_of, prose_ranges, section_ranges

_UNIT = ["component", "unit"]
#: fixed values: environments of lists and of displayed mathematics, and first words of labels that name their environment
LISTS = ("enumerate", "itemize", "description")
MATH = tuple(name + star for name in ("equation", "align", "gather", "multline", "eqnarray") for star in ("", "*")) + ("displaymath",)
NAMED = ("remark", "remarks", "example", "exercise")
_HEADED = r"^(?:section|subsection|subsubsection|paragraph)-"


def environment_ranges(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component, unit, environment, start_line, end_line) of environments, and violations (component, unit, line): an end
    that does not match what is open, or what is never closed."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(r"\\(?:begin|end)\{[^{}]+\}"), F.lit(0))).alias("at", "command")
    events = lines.select(*_UNIT, "line", found).select(*_UNIT, "line", "at", F.startswith("command", F.lit("\\begin")).alias("opens"), F.regexp_extract("command", r"\{([^{}]+)\}", 1).alias("environment"))
    depth = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(W.partitionBy(*_UNIT).orderBy("line", "at").rowsBetween(W.unboundedPreceding, W.currentRow))
    level = events.withColumn("depth", depth + F.when(F.col("opens"), 0).otherwise(1))
    order = W.partitionBy(*_UNIT, "depth").orderBy("line", "at")
    row = F.struct("opens", "environment", "line")
    paired = level.withColumn("after", F.lead(row).over(order)).withColumn("before", F.lag(row).over(order))
    fits = F.col("opens") & ~F.col("after.opens") & (F.col("environment") == F.col("after.environment"))
    closed = ~F.col("opens") & F.col("before.opens") & (F.col("environment") == F.col("before.environment"))
    ranges = paired.where(F.coalesce(fits, F.lit(False))).select(*_UNIT, "environment", F.col("line").alias("start_line"), F.col("after.line").alias("end_line"))
    return ranges, paired.where(~F.coalesce(fits, F.lit(False)) & ~F.coalesce(closed, F.lit(False))).select(*_UNIT, "line")


def _within(labels: DataFrame, ranges: DataFrame) -> DataFrame:
    """``labels`` with start_line and end_line of the innermost range around them."""
    spans = ranges.select(*_UNIT, F.col("start_line").alias("first"), (F.col("end_line") + 1).alias("beyond"), F.col("start_line").alias("start"), F.col("end_line").alias("stop"))
    return innermost(labels, spans, _UNIT, "line", "first", "beyond", ["start", "stop"]).withColumnsRenamed({"start": "start_line", "stop": "end_line"})


def item_ranges(lines: DataFrame, ranges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: (component, unit, line, ..). From the item at or before each to the line before the next item of the same
    list, or before its end; null without a list or an item."""
    lists = ranges.where(F.col("environment").isin(*LISTS))
    held = _within(labels, lists)
    # after its line, an item stands in the list that still goes on there
    open_ = lists.where("end_line > start_line").withColumn("end_line", F.col("end_line") - 1)
    items = _within(lines.where(F.regexp_like("text", F.lit(r"\\item"))).select(*_UNIT, "line"), open_).where("start_line is not null")
    marks = items.select(*_UNIT, "start_line", "line", F.col("line").alias("item"))
    both = held.withColumn("item", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
    mine = W.partitionBy(*_UNIT, "start_line")
    last = F.max("item").over(mine.orderBy("line").rangeBetween(W.unboundedPreceding, W.currentRow))
    following = F.min("item").over(mine.orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, -1))
    later = F.when(following > F.col("line"), following)
    rows = both.withColumn("first", last).withColumn("next", later).where("item is null")
    begun = F.col("start_line").isNotNull()
    return rows.withColumn("end_line", F.when(begun & F.col("first").isNotNull(), F.coalesce(F.col("next") - 1, F.col("end_line") - 1))).withColumn("start_line", F.when(begun, F.col("first"))).drop("item", "first", "next")


def _heading(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """The section whose heading stands last before each label."""
    marks = lines.where(heading_rank(F.col("text")).isNotNull()).select(*_UNIT, "line", F.col("line").alias("heading"))
    both = labels.withColumn("heading", F.lit(None).cast("int")).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    last = F.max("heading").over(W.partitionBy(*_UNIT).orderBy("line").rangeBetween(W.unboundedPreceding, W.currentRow))
    found = both.withColumn("start_line", last).where("mark is null").drop("mark", "heading")
    return found.join(section_ranges(lines).select(*_UNIT, "start_line", "end_line"), [*_UNIT, "start_line"], "left")


def source_artifacts(units: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """units: (component, unit, content); requested: (component, label), a unit's name and what it calls a line. Artifacts
    (component, label, unit, local, kind, start_line, end_line, source, title), and violations (component, label, rule): no unit owns the label,
    no line or several have it, or no range of its kind holds it."""
    lines = lines_of(units)
    ranges, _ = environment_ranges(lines)
    stems = units.select(F.concat("component", F.lit("\n"), "unit", F.lit("-")).alias("stem"))
    asked = requested.select("component", "label").distinct().withColumn("full", F.concat("component", F.lit("\n"), "label"))
    owned = longest_prefix(asked, "full", stems, "stem").withColumn("unit", F.substring_index(F.expr("substring(matched, 1, length(matched) - 1)"), "\n", -1))
    local = owned.withColumn("local", F.expr("substring(full, length(matched) + 1)")).select("component", "label", "unit", "local")
    spots = lines.select(*_UNIT, "line", F.explode(F.regexp_extract_all("text", F.lit(r"\\label\{([^{}]+)\}"), F.lit(1))).alias("local"))
    counted = spots.groupBy(*_UNIT, "local").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    placed = local.join(counted, [*_UNIT, "local"], "left")
    wrong = placed.select("component", "label", F.when(F.col("unit").isNull(), "no-unit").when(F.col("n").isNull(), "no-line").when(F.col("n") > 1, "several-lines").alias("rule")).where("rule is not null")

    word = F.split("local", "-", 2)[0]
    kind = F.when(F.regexp_like("local", F.lit(_HEADED)), "section").when(word.isin(*NAMED, "equation", "item"), word).otherwise("prose")
    labels = placed.where("n = 1").select(*_UNIT, "line", "label", "local", kind.alias("kind"))
    pick = lambda *kinds: labels.where(F.col("kind").isin(*kinds))
    parts = [_within(pick(name), ranges.where(F.col("environment") == name)) for name in NAMED]
    shown = _within(pick("equation"), ranges.where(F.col("environment").isin(*MATH)))
    loose = shown.where("start_line is null").drop("start_line", "end_line").unionByName(pick("prose"))
    around = prose_ranges(lines, loose.select(*_UNIT, "line").distinct()).select(*_UNIT, "line", "start_line", "end_line")
    parts += [shown.where("start_line is not null"), loose.join(around, [*_UNIT, "line"]), item_ranges(lines, ranges, pick("item")), _heading(lines, pick("section"))]
    every = reduce(DataFrame.unionByName, parts)
    lost = every.where("start_line is null or end_line is null").select("component", "label", F.lit("no-range").alias("rule"))

    # a range takes its own lines, not the text of its unit
    cut = every.where("start_line is not null and end_line is not null")
    raw = units.select(*_UNIT, F.posexplode(F.split("content", "\r?\n")).alias("n", "raw")).select(*_UNIT, (F.col("n") + 1).alias("at"), "raw")
    held = cut.where("start_line <= end_line").select("component", "label", "unit", F.explode(F.sequence("start_line", "end_line")).alias("at")).join(raw, [*_UNIT, "at"])
    texts = held.groupBy("component", "label").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("raw"))
    made = cut.join(texts, ["component", "label"], "left").withColumn("source", F.coalesce(F.array_join(F.col("raw.raw"), "\n"), F.lit("")))
    return made.select("component", "label", "unit", "local", "kind", "start_line", "end_line", "source", _title(F.col("source"), F.col("kind"), F.col("local")).alias("title")), wrong.unionByName(lost)


def _title(source: Column, kind: Column, local: Column) -> Column:
    plain = collapse(F.regexp_replace(F.array_join(F.transform(F.split(source, "\r?\n"), without_comments), "\n"), r"\\label\{[^{}]+\}", " "))
    heading = F.regexp_extract(plain, r"^\s*\\(?:chapter|section|subsection|subsubsection|paragraph)\{((?:[^{}]|\{[^{}]*\})*)\}", 1)
    preview = F.trim(F.regexp_replace(F.regexp_replace(plain, r"^\\begin\{[^{}]+\}(?:\[[^\]]*\])?", ""), r"\\end\{[^{}]+\}$", ""))
    said = F.concat(F.lit("Referenced source "), kind, F.lit(": "), F.when(preview != "", F.left(preview, F.lit(160))).otherwise(local))
    return F.when((kind == "section") & (F.trim(heading) != ""), F.trim(heading)).otherwise(said)

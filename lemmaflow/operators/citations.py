"""Citations and phrases in proofs of TeX units (EXT05-EXT07, JOIN30): rows of lines, groups of each owner, references with
evidence.

Units are (component, unit, content), proofs (component, unit, owner, start_line, end_line), lines from 1. A proof
is taken apart into its lines, which meet the unit's lines by equality, so that no text is copied for each of its
proofs. Null texts have no lines; proofs that end before they start have none; a line of two proofs counts for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import tex
from ..functions.json_text import json_text
from ..functions.text import without_comments

#: fixed pattern: a citation on one line, its pinpoint and its keys
CITE = r"\\cite(?:\[([^\]]*)\])?\{([^{}]+)\}"


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def proof_lines(units: DataFrame, proofs: DataFrame) -> DataFrame:
    """``proofs`` with a row for each of their lines: line, text (without its comment) and context."""
    raw = units.select("component", "unit", F.posexplode(F.split("content", "\r?\n")).alias("n", "raw")).withColumn("line", F.col("n") + 1).drop("n")
    spread = proofs.where("end_line >= start_line").select("component", "unit", "owner", "start_line", F.explode(F.sequence(F.col("start_line").cast("int"), F.col("end_line").cast("int"))).alias("line"))
    rows = spread.join(raw, ["component", "unit", "line"])
    return rows.select("component", "unit", "owner", "start_line", "line", without_comments(F.col("raw")).alias("text"), tex.line_context(F.col("raw"), F.col("line")).alias("context"))


def phrase_occurrences(units: DataFrame, proofs: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases: (component, owner, pattern), looked for in any case in the proofs of their owner alone.
    (component, unit, owner, pattern, start_line, line, position, matched, context), a row for each match."""
    rows = proof_lines(units, proofs).join(phrases.select("component", "owner", "pattern").distinct(), ["component", "owner"])
    found = F.regexp_extract_all("text", F.concat(F.lit("(?iu)"), "pattern"), F.lit(0))
    return rows.select("component", "unit", "owner", "pattern", "start_line", "line", F.posexplode(found).alias("position", "matched"), "context")


def phrase_groups(occurrences: DataFrame) -> DataFrame:
    """(component, owner, pattern, occurrences, proofs): how often a phrase stands, and the first lines of the proofs it
    stands in, in their order."""
    return occurrences.groupBy("component", "owner", "pattern").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("start_line")).alias("proofs"))


def proof_citations(units: DataFrame, proofs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations (component, unit, owner, start_line, line, place, key, pinpoint, context) in proofs, a row for each key, and
    violations (component, unit, line): lines with a citation that does not end there."""
    lines = proof_lines(units, proofs).where(F.contains("text", F.lit("\\cite"))).withColumn("uses", F.regexp_extract_all("text", F.lit(CITE), F.lit(0)))
    wrong = lines.where(F.regexp_count("text", F.lit(r"\\cite\b")) != F.size("uses")).select("component", "unit", "line").distinct()
    keys = lambda use: F.filter(F.transform(F.split(F.regexp_extract(use, CITE, 2), ","), _trimmed), lambda k: k != "")
    pinpoint = lambda use: F.nullif(_trimmed(F.regexp_extract(use, CITE, 1)), F.lit(""))
    cited = F.flatten(F.transform("uses", lambda use: F.transform(keys(use), lambda k: F.struct(k.alias("key"), pinpoint(use).alias("pinpoint")))))
    rows = lines.select("component", "unit", "owner", "start_line", "line", "context", F.posexplode(cited).alias("place", "c"))
    return rows.select("component", "unit", "owner", "start_line", "line", "place", "c.key", "c.pinpoint", "context"), wrong


def _identity(key: Column, pinpoint: Column) -> Column:
    return F.concat(key, F.lit("\0"), F.coalesce(pinpoint, F.lit("")))


def citation_references(citations: DataFrame, resolved: DataFrame) -> DataFrame:
    """A reference for each owner, key and pinpoint, a missing pinpoint like an empty one. resolved: (component, owner, key,
    pinpoint, target, dependency), what an audit found a citation to use. (component, unit, reference, owner, key, pinpoint,
    context, locator, occurrences, status, target, dependency, evidence_sha256). Two of an owner whose ids begin
    alike are told apart by a number, in the order of their first lines."""
    place = F.struct("start_line", "line", "place", "key", "pinpoint", "context", "unit")
    groups = citations.withColumn("identity", _identity(F.col("key"), F.col("pinpoint"))).groupBy("component", "owner", "identity").agg(F.array_sort(F.collect_list(place)).alias("found"))
    shown = F.transform("found", lambda x: F.struct(x["key"].alias("key"), x["pinpoint"].alias("pinpoint"), x["line"].alias("lineNumber"), x["context"].alias("context")))
    rows = groups.withColumn("shown", shown).withColumn("first", F.get("found", 0))
    kind = rows.schema["shown"].dataType
    assert isinstance(kind, ArrayType)
    base = F.concat(F.lit("ref-"), F.col("owner").cast("string"), F.lit("-to-cite-"), F.left(F.sha2("identity", 256), F.lit(12)), F.lit("-proof-citation"))
    rows = rows.withColumn("base", base).withColumn("nth", F.row_number().over(W.partitionBy("component", "base").orderBy("first", "identity")))
    known = resolved.select("component", "owner", _identity(F.col("key"), F.col("pinpoint")).alias("identity"), "target", "dependency").dropDuplicates(["component", "owner", "identity"])
    joined = rows.join(known, ["component", "owner", "identity"], "left")
    return joined.select(
        "component", "first.unit", F.concat("base", F.when(F.col("nth") > 1, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise("")).alias("reference"), "owner", "first.key", "first.pinpoint", "first.context",
        F.array_join(F.transform("found", lambda x: F.concat(x["unit"].cast("string"), F.lit(".tex:L"), x["line"].cast("string"))), "; ").alias("locator"), F.size("found").alias("occurrences"),
        F.when(F.col("target").isNotNull(), "resolved").otherwise("unresolved").alias("status"), "target", "dependency",
        F.sha2(F.concat(json_text(F.col("shown"), kind, 2), F.lit("\n")), 256).alias("evidence_sha256"),
    )

"""Reference and citation macros of TeX units as rows (TXT36, TXT37).

Units are (unit, content, file_id, tags): the active text, the three parts of the file's own
label, and the tags that hold. Offsets are those of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tex
from ..functions.text import collapse

#: fixed values: macros by what they take
OWN = ("olref", "Olref")
LISTED = ("cref", "Cref", "eqref")
TAGGED = "tagrefs"
CITED = ("cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "citeyearpar")


def uses(units: DataFrame, names: tuple[str, ...], optional: int = 0, star: bool = False) -> DataFrame:
    """``units`` without their content, with a row for each use of one of the macros, of one required argument: command and u
    (tex.invocations). The list is a column of its own first: a row for each of its elements would else carry the whole list."""
    listed = [units.withColumn("command", F.lit(name)).withColumn("uses", tex.invocations(F.col("content"), name, optional, 1, star)).drop("content") for name in names]
    rows = [one.withColumn("u", F.explode("uses")).drop("uses") for one in listed]
    return reduce(DataFrame.unionByName, rows)


def _bare(key: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(key), r"(?s)^\{(.*)\}$", "$1"))


def references(units: DataFrame) -> DataFrame:
    """(unit, key, start, stop, command): own labels completed from the file's, lists of labels taken apart, and of references
    by tag those whose tag is set."""
    argument = F.get("u.required", 0)
    own = uses(units, OWN, optional=3).withColumn("key", tex.reference_target(F.col("file_id"), F.col("u.optional"), argument))
    listed = uses(units, LISTED).withColumn("key", F.explode(tex.split_top_level(argument))).withColumn("key", _bare(F.col("key")))
    pairs = uses(units, (TAGGED,)).withColumn("pair", F.explode(tex.split_top_level(argument))).where(F.instr("pair", "/") > 1)
    tag = F.trim(F.substring_index("pair", "/", 1))
    tagged = pairs.where(F.coalesce(F.try_element_at("tags", tag), F.lit(False))).withColumn("key", _bare(F.expr("substring(pair, instr(pair, '/') + 1)"))).drop("pair")
    found = reduce(DataFrame.unionByName, [own, listed, tagged])
    return found.where("key <> ''").select("unit", "key", F.col("u.start").alias("start"), F.col("u.end").alias("stop"), "command")


def citations(units: DataFrame) -> DataFrame:
    """(unit, key, start, stop, command, pinpoint): a row for each key that is cited; up to two pinpoints are joined by a
    semicolon, null without one; a star belongs to the command."""
    clean = lambda x: collapse(F.regexp_replace(F.regexp_replace(x, r"\\(?:ol)?label\s*\{[^{}]*\}|\\(?:begin|end)\s*\{[^{}]+\}", " "), "~", " "))
    found = uses(units.select("unit", "content"), CITED, optional=2, star=True)
    pinpoints = F.filter(F.transform("u.optional", clean), lambda x: x != "")
    rows = found.withColumn("key", F.explode(tex.split_top_level(F.get("u.required", 0))))
    return rows.select("unit", "key", F.col("u.start").alias("start"), F.col("u.end").alias("stop"), F.concat("command", F.when(F.col("u.starred"), "*").otherwise("")).alias("command"), F.nullif(F.array_join(pinpoints, "; "), F.lit("")).alias("pinpoint"))

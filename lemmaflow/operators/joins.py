"""Joins beyond plain keys, each with an equality key so that it never becomes a cross join (JOIN01, JOIN02, JOIN06, JOIN16, JOIN18-JOIN21, JOIN23, JOIN30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: rows of one value that a task compares with as many of the other side; larger values are dealt out in squares
_SQUARE = 1024


def any_key_matches(left: DataFrame, right: DataFrame, own: str, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(own, other, kinds): pairs of rows that share a value of at least one key. The keys
    become rows (kind, value), so that one hash join serves all of them. A value that many rows have on both sides
    is cut into squares of some ``_SQUARE`` rows a side, and a pair is given by the first value that it shares, so
    neither a value nor a pair passes through one group. The number of pairs itself is that of the result."""
    kinds = sorted(keys)

    def gathered(df: DataFrame, side: int, name: str) -> DataFrame:
        sets = [F.collect_set(keys[k][side].cast("string")).alias(f"{name}_{n}") for n, k in enumerate(kinds)]
        return df.groupBy(F.col(own).alias(name)).agg(*sets)

    def listed(df: DataFrame, name: str) -> DataFrame:
        entry = lambda n: lambda v: F.struct(F.lit(n).alias("kind"), v.alias("value"))
        entries = F.flatten(F.array(*[F.transform(f"{name}_{n}", entry(n)) for n in range(len(kinds))]))
        return df.select("*", F.inline(entries))

    mine, theirs = listed(gathered(left, 0, "own"), "own"), listed(gathered(right, 1, "other"), "other")
    counts = [df.groupBy("kind", "value").agg(F.ceil(F.count("*") / _SQUARE).cast("int").alias(f"{name}_parts")) for df, name in ((mine, "own"), (theirs, "other"))]
    parts = counts[0].join(counts[1], ["kind", "value"])
    place = lambda name: F.pmod(F.xxhash64(name), F.col(f"{name}_parts"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}_parts") - 1))
    mine = mine.join(parts, ["kind", "value"]).withColumn("row", place("own").cast("int")).withColumn("column", every("other")).drop("own_parts", "other_parts")
    theirs = theirs.join(parts, ["kind", "value"]).withColumn("column", place("other").cast("int")).withColumn("row", every("own")).drop("own_parts", "other_parts")
    square = ["kind", "value", "row", "column"]
    # a number of its own: partitions that are small before the join, not after it, are not put together
    tasks = max(64, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = mine.repartition(tasks, *square).join(theirs.repartition(tasks, *square).hint("shuffle_hash"), square)
    shared = [F.array_intersect(f"own_{n}", f"other_{n}") for n in range(len(kinds))]
    first = F.coalesce(*[F.when(F.size(x) > 0, F.struct(F.lit(n).alias("kind"), F.array_min(x).alias("value"))) for n, x in enumerate(shared)])
    names = F.filter(F.array(*[F.when(F.arrays_overlap(f"own_{n}", f"other_{n}"), F.lit(k)) for n, k in enumerate(kinds)]), lambda x: x.isNotNull())
    return pairs.where(first == F.struct("kind", "value")).select("own", "other", F.array_join(names, ",").alias("kinds"))


def ambiguous(matches: DataFrame) -> DataFrame:
    """Rows that match several records, which is an error for exact identity."""
    return matches.groupBy("own").agg(F.count_distinct("other").alias("n")).where("n > 1")


def preceding(rows: DataFrame, by: list[str], order: list[str], is_owner: Column, is_barrier: Column, owner: str) -> DataFrame:
    """``rows`` with ``owner_of``: the nearest owner before the row within its group, null
    if a barrier stands between them."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    mark = F.when(is_owner | is_barrier, F.struct(is_owner.alias("holds"), F.col(owner).alias("name")))
    last = F.last(mark, ignorenulls=True).over(before)
    return rows.withColumn("owner_of", F.when(last["holds"], last["name"]))


def innermost(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, keep: list[str]) -> DataFrame:
    """``points`` with the columns ``keep`` of the innermost half-open range of the same
    group that contains them (null without one). A range is entered under the two or three
    blocks of its own power of two that it touches, and a distinct position is looked up once
    for each power of two that occurs, so no group is compared as a whole."""
    length = F.col(end) - F.col(start)
    level = F.floor(F.log2(length.cast("double"))).cast("int")
    sized = ranges.where(length > 0).withColumn("level__", level)
    block = lambda place, n: F.floor(place / F.pow(F.lit(2.0), n)).cast("long")
    named = sized.select(
        *[F.col(c).alias(f"{c}__r") for c in by],
        F.col(start).alias("start__r"),
        F.col(end).alias("end__r"),
        F.struct(F.col(start), *[F.col(k) for k in keep]).alias("best__r"),
        F.col("level__").alias("level__r"),
        F.explode(F.sequence(block(F.col(start), F.col("level__")), block(F.col(end) - 1, F.col("level__")))).alias("block__r"),
    )
    levels = sorted(r[0] for r in sized.select("level__").distinct().collect())  # at most 64
    spots = points.select(*by, at).distinct().withColumn("level__", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    spots = spots.withColumn("block__", block(F.col(at), F.col("level__")))
    condition = (spots["level__"] == named["level__r"]) & (spots["block__"] == named["block__r"]) & (spots[at] >= named["start__r"]) & (spots[at] < named["end__r"])
    for c in by:
        condition = (spots[c] == named[f"{c}__r"]) & condition
    best = spots.join(named, condition).groupBy(*[spots[c] for c in by], spots[at]).agg(F.max("best__r").alias("best__r"))
    best = best.toDF(*[f"{c}__b" for c in (*by, at)], "best__r")
    same = points[at] == best[f"{at}__b"]
    for c in by:
        same = (points[c] == best[f"{c}__b"]) & same
    return points.join(best, same, "left").select(*[points[c] for c in points.columns], *[F.col(f"best__r.{k}").alias(k) for k in keep])


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """``rows`` with ``matched``: the longest prefix with which ``text`` starts. Each distinct
    text is looked up by equality, once for each length that a prefix has."""
    listed = prefixes.select(F.col(prefix).alias("prefix__")).where(F.length(prefix) > 0).distinct()
    lengths = sorted(r[0] for r in listed.select(F.length("prefix__")).distinct().collect())
    texts = rows.select(F.col(text).alias("text__")).distinct()
    cut = texts.withColumn("cut__", F.explode(F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.left("text__", n))))
    best = cut.join(listed, F.col("cut__") == F.col("prefix__")).groupBy("text__").agg(F.max_by("prefix__", F.length("prefix__")).alias("matched"))
    return rows.join(best, rows[text] == best["text__"], "left").drop("text__")


def resolve_or(rows: DataFrame, key: str, tables: list[tuple[DataFrame, str, str]], name: str) -> DataFrame:
    """``rows`` with ``name``: the value of the first lookup table that has the key."""
    out, parts = rows, []
    for n, (lookup, own, value) in enumerate(tables):
        one = lookup.select(F.col(own).alias(f"k{n}__"), F.col(value).alias(f"v{n}__"))
        out = out.join(one, out[key] == one[f"k{n}__"], "left").drop(f"k{n}__")
        parts.append(F.col(f"v{n}__"))
    return out.withColumn(name, F.coalesce(*parts)).drop(*[f"v{n}__" for n in range(len(tables))])


def unambiguous(bindings: DataFrame, key: list[str], target: str) -> DataFrame:
    """One row for each key that is bound to exactly one target."""
    found = bindings.groupBy(*key).agg(F.min(target).alias("low__"), F.max(target).alias("high__"))
    return found.where("low__ = high__").select(*key, F.col("low__").alias(target))

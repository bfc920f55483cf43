"""Native span search: positions of regular-expression matches with SQL functions alone.

split() and regexp_extract_all() walk a text with the same matcher, so the pieces
between the matches and the matches themselves give every start, in code points.
Patterns used here must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,found:string>>"
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also inside other higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(sizes: Column) -> Column:
    """For each entry of an array of whole numbers, the sum up to and with it. An accumulator
    that holds an array is copied at every step, so the sums are made within blocks, whose
    own sums are made in the same way: a long array costs a block's copies for each entry."""
    empty = F.array().cast("array<bigint>")

    def scan(values: Column, first: Column) -> Column:
        start = F.struct(first.cast("long").alias("at"), empty.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = (acc["at"] + x).cast("long")
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(values, start, step, lambda acc: acc["out"])

    def blocks(all_: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(all_), F.lit(_BLOCK))
        return F.transform(firsts, lambda at: F.slice(all_, at, _BLOCK))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: (a + x).cast("long")))
        before = lambda ends: F.flatten(F.transform(parts, lambda p, i: scan(p, F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1)))))
        return let(scan(sums, F.lit(0)), before)

    return let(sizes, lambda all_: F.when(F.size(all_) == 0, empty).when(F.size(all_) <= _BLOCK, scan(all_, F.lit(0))).otherwise(let(blocks(all_), joined)))


def spans(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, found), end exclusive."""

    def placed(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        sizes = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, f: (F.length(p) + F.length(f)).cast("long"))
        one = lambda end, f: F.struct((end - F.length(f)).cast("long").alias("start"), end.alias("end"), f.alias("found"))
        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(F.zip_with(running_sums(sizes), found, one))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def no_spans() -> Column:
    return F.array().cast(SPAN)


def labelled(kind: str, rank: int, found: Column) -> Column:
    """Spans as an array of (start, end, rank, kind)."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))


def joined(ordered: Column) -> Column:
    """kind:start:end of an array of labelled spans, comma-joined in the order given."""
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_start(parts: list[Column]) -> Column:
    """Labelled spans by start, then rank of their kind."""
    return F.array_sort(F.concat(*[F.transform(p, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))) for p in parts]))


def by_kind(parts: list[Column]) -> Column:
    """Labelled spans by rank of their kind, then start."""
    return F.array_sort(F.concat(*[F.transform(p, lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))) for p in parts]))

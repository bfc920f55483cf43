"""Distinct rows in order, differences, paging, neighbours (SET01-SET07, ORD03-ORD06, ORD08, ORD09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in order."""
    return rows.withColumn("nth__", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("nth__ = 1").drop("nth__")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once, with their count ``n``."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def differences(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of the tables has."""
    a, b = expected.select(key).distinct(), seen.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def page(rows: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Rows of one page (from 1): a top-k sort and an offset, no full sort of the table."""
    return rows.orderBy(*order).limit(number * size).offset((number - 1) * size)


def neighbours(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with the value before and after in reading order."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"previous": F.lag(value).over(w), "following": F.lead(value).over(w)})


def top(rows: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with the number of their batch of ``size`` (from 0) within the group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / size))


def random_pick(rows: DataFrame, key: str, current, seed: int) -> DataFrame:
    """One row at random, not the current one where there is another."""
    draw = F.xxhash64(F.lit(seed), F.col(key))
    return rows.orderBy((F.col(key) == F.lit(current)).cast("int"), draw).limit(1)

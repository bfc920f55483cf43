"""Operator 6, SimHash near-dedup with covering locality-sensitive hashing.

Bit position i gets a non-zero vector m(i) of radius + 1 bits; table v (any non-zero
vector) keeps the positions where the product <m(i), v> is odd. At most ``radius``
differing positions span fewer than radius + 1 dimensions, so some v is orthogonal to
all of them: every pair within the radius agrees on all kept positions of that table.

Only distinct fingerprints are compared. Buckets of two are pairs as they stand; larger
ones are joined back, and a bucket's links are found inside one task and reduced to a
spanning star. Buckets above ``BUCKET_ROWS`` go another exact way that is linear in
their size: each member is listed under every value within half the radius of it, and
members that meet under one value are linked to the least of them; two members within
the radius always share such a value, and any two that share one are within the radius.

Defined cases: null and empty texts have fingerprint 0, linked like any other; copies
and repeated rows share a fingerprint; null ids never name a component unless all its
ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stash, table
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
BUCKET_ROWS = 1024
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the 64-bit hashes, unsigned."""
    columns = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(SHINGLE, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    return majority(hashes)


def fingerprint_of(text: Column) -> Column:
    """The fingerprints of a text column, as signed 64-bit numbers."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))

    return prints(text)


def masks(radius: int = RADIUS) -> list[int]:
    """The kept positions of each covering table, as signed 64-bit numbers."""
    n = (1 << (radius + 1)) - 1
    found = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(64) if ((1 + i % n) & v).bit_count() % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def bucket_star(prints: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints, the least fingerprint that each is linked with inside the bucket."""
    bits = prints.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return prints[label]
        label = new


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """batches: (t, k, fp), sorted by (t, k); a bucket may run over several batches."""
    held: pd.DataFrame | None = None

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        t, k, fp = (rows[c].to_numpy() for c in ("t", "k", "fp"))
        cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
        tops = [bucket_star(np.sort(part), RADIUS) for part in np.split(fp, cuts)]
        a = np.concatenate([np.sort(part) for part in np.split(fp, cuts)])
        b = np.concatenate(tops)
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = (rows["t"] == rows["t"].iloc[-1]) & (rows["k"] == rows["k"].iloc[-1])
        held = rows[last]
        if not last.all():
            yield solve(rows[~last])
    if held is not None and len(held):
        yield solve(held)


def links(prints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """prints: distinct (fp). Edges (a, b) with the same components as all pairs within RADIUS bits."""
    kept = masks()
    entries = prints.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in kept])).alias("t", "k"), "fp")
    buckets = stash(entries.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    edges = buckets.where((F.col("n") == 2) & near).select("a", "b")

    larger = buckets.where("n > 2").select(F.col("t").alias("t2"), F.col("k").alias("k2"), "n")
    members = stash(entries.join(larger.hint("merge"), (F.col("t") == F.col("t2")) & (F.col("k") == F.col("k2"))).select("t", "k", "fp", "n"), "simhash-members")
    small = members.where(F.col("n") <= bucket_rows).select("t", "k", "fp")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.unionByName(small.repartition(parts, "t", "k").sortWithinPartitions("t", "k").mapInPandas(_stars, "a long, b long"))

    half = RADIUS // 2
    free = [[i for i in range(64) if not m >> i & 1] for m in kept]
    flips = [[sum(1 << i for i in c) for n in range(half + 1) for c in combinations(bits, n)] for bits in free]
    signed = [[x - (1 << 64) if x >> 63 else x for x in row] for row in flips]
    steps = prints.sparkSession.createDataFrame([(t, x) for t, row in enumerate(signed) for x in row], "ft int, flip long")
    large = members.where(F.col("n") > bucket_rows)
    if large.limit(1).count():
        listed = stash(large.join(F.broadcast(steps), F.col("t") == F.col("ft")).select("t", "k", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "fp"), "simhash-near")
        meets = stash(listed.groupBy("t", "k", "z").agg(F.count("*").alias("n"), F.min("fp").alias("b")).where("n > 1").drop("n"), "simhash-meets")
        met = listed.join(meets, ["t", "k", "z"]).where("fp <> b")
        edges = edges.unionByName(met.select(F.col("fp").alias("a"), "b").distinct())
    return edges.distinct()


def group(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``."""
    rows = stash(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp")), "simhash-rows")
    prints = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    labels = stash(components(links(prints.select("fp"))), "simhash-labels")
    named = labels.join(prints, labels["node"] == prints["fp"]).select("fp", "label", "least")
    tops = stash(named.groupBy("label").agg(F.min("least").alias("top")), "simhash-tops")
    named = stash(labels.join(tops, "label").select(F.col("node").alias("linked"), "top"), "simhash-named")
    ids = stash(prints.join(named, prints["fp"] == named["linked"], "left").select(F.col("fp").alias("f"), F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("top")).alias("component_id")), "simhash-ids")
    joined = rows.join(ids, rows["fp"] == ids["f"])
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group: the one that names the component. Rows that repeat its
    id are copies too, and one row of each such id stays; documents with null ids that
    are alone stay, and of a group of null ids one row stays."""
    grouped = stash(group(docs), "simhash-groups")
    keep = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    kept, count = free_name(docs, "kept_id"), free_name(docs, "kept_rows")
    keep = stash(keep.select(F.col("doc_id").alias(kept), F.col("n").alias(count)), "simhash-keep")
    rows = docs.join(keep.hint("merge"), docs["doc_id"].eqNullSafe(keep[kept]))
    single = rows.where(F.col(count) == 1)
    if keep.where(F.col(count) > 1).limit(1).count():
        fp = free_name(rows, "print_of_row")
        repeated = rows.where(F.col(count) > 1).withColumn(fp, F.when(F.col(kept).isNull(), fingerprint_of(docs["text"])))
        single = single.unionByName(repeated.dropDuplicates([kept, fp]).drop(fp))
    return single.drop(kept, count)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))

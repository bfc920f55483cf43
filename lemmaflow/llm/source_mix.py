"""Operator 2, mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words; a document is taken floor(rate) times
whole, and the remaining fraction is its inclusion probability. The flight phase moves
these probabilities along the null space of two balancing constraints (number of
documents, number of words), three open documents at a time, until each block has at
most two open ones. Blocks are hashed shares of a source, so a source of any size is
spread; what stays open goes through the same phase again until one small landing
problem for each source is left, which is settled so that its words come nearest.

Defined cases: null or empty text has size 0; a null source is a source, last in
order; a source of size 0 has target 0; with no words at all nothing is taken; rows
that agree in id and text are drawn separately; an empty table gives an empty result;
reruns agree, as every draw comes from a hash of the rows and a fixed seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, stash, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_ROWS = 1024
LANDING_ROWS = 11
SEED = 7
_TINY = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) in order of code points, null last, without one task for all rows."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(sources.repartitionByRange(n, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    offsets = dict(zip([p for p, _ in counts], np.cumsum([0, *(n for _, n in counts)]).tolist()))
    start = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("part")] if offsets else F.lit(0)
    here = W.partitionBy("part").orderBy(F.col("source").isNull(), F.col("source"))
    return dealt.withColumn("rank", F.row_number().over(here) - 1 + start).drop("part")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size): shares by weight, capped at
    MOST_REPEATS times the source's size, the excess reshared until no source is above."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = stash(_ranked(sources).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST_REPEATS).alias("most")), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped_before = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("most")
        r = ranked.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("most"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if r["n"] == capped_before or not r["open"]:
            break
        capped_before, level = r["n"], (total - (r["held"] or 0)) / r["open"]
    return ranked.select("source", "source_size", F.least(F.col("weight") * level, F.col("most").cast("double")).alias("target"))


def flight(p: list[float], size: list[int], rng: np.random.Generator) -> list[float]:
    """Move probabilities until at most two are open, keeping their sum and their sum of
    words; a vector that satisfies both for three documents is the cross product of the
    two constraints. Expected values are kept by drawing the direction."""
    p = list(p)
    open_: list[int] = []
    for k in range(len(p) + 1):
        while len(open_) == 3 or k == len(p) and len(open_) == 2 and size[open_[0]] == size[open_[1]]:
            s = [size[i] for i in open_]
            if len(s) == 3 and not s[0] == s[1] == s[2]:
                move = [s[2] - s[1], s[0] - s[2], s[1] - s[0]]
            else:
                move = [1, -1, 0][: len(s)]
            up = min((1 - p[i] if u > 0 else p[i]) / abs(u) for i, u in zip(open_, move) if u)
            down = min((p[i] if u > 0 else 1 - p[i]) / abs(u) for i, u in zip(open_, move) if u)
            step = up if rng.random() * (up + down) < down else -down
            for i, u in zip(open_, move):
                p[i] += step * u
                if p[i] < _TINY:
                    p[i] = 0.0
                elif p[i] > 1 - _TINY:
                    p[i] = 1.0
            open_ = [i for i in open_ if 0 < p[i] < 1]
        if k < len(p) and 0 < p[k] < 1:
            open_.append(k)
    return p


def landing(p: list[float], size: list[int]) -> list[float]:
    """Settle the last open probabilities (LANDING_ROWS and two at most): of all their
    roundings, take the one whose words, and then number of documents, come nearest to
    what the probabilities promise."""
    p = list(p)
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    odds, words = np.array([p[i] for i in open_]), np.array([size[i] for i in open_], float)
    miss = np.abs((choices - odds) @ words) + 0.01 * (words.mean() if open_ else 0) * np.abs((choices - odds).sum(axis=1))
    for i, x in zip(open_, choices[int(np.argmin(miss))].tolist()):
        p[i] = float(x)
    return p


def _fly(last: bool):
    """Flight over one block; the last one for a source keeps LANDING_ROWS documents of
    spread sizes back, which make the landing problem together with the open ones."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "u", "doc_id"], ignore_index=True)
        seed = [SEED, len(block), *(int(x) & 0xFFFFFFFF for x in block["u"].head(4))]
        rng = np.random.default_rng(seed)
        p, size = block["p"].to_numpy(copy=True), block["size"].to_numpy()
        back = np.zeros(len(p), bool)
        if last:
            can = np.flatnonzero((p > 0) & (p < 1))
            back[can[np.unique(np.linspace(0, len(can) - 1, min(len(can), LANDING_ROWS)).astype(int))]] = True
        go = rng.permutation(np.flatnonzero(~back))
        p[go] = flight(p[go].tolist(), size[go].tolist(), rng)
        return block.assign(p=landing(p.tolist(), size.tolist()) if last else p).drop(columns="block")

    return run


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``."""
    sized = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("u")), "mix-sizes")
    targets = stash(source_targets(sized), "mix-targets")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(rate).cast("long")).withColumn("p", rate - F.floor(rate))
    columns = ["doc_id", "source", "size", "u", "source_size", "target", "whole", "p"]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(columns).dtypes)

    done: list[DataFrame] = []
    open_ = rows.select(columns)
    level = 0
    while True:
        if level == 0:
            counts = sized.groupBy("source").agg(F.count("*").alias("n"))
        else:
            counts = open_.groupBy("source").agg(F.count("*").alias("n"))
        counts = stash(counts.select(F.col("source").alias("of"), F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")), f"mix-blocks{level}")
        most = counts.agg(F.max("blocks")).first()[0] or 0
        dealt = open_.join(counts, open_["source"].eqNullSafe(counts["of"])).drop("of")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + level), "u"), F.col("blocks"))).drop("blocks")
        flown = stash(dealt.groupBy("source", "block").applyInPandas(_fly(most <= 1), schema), f"mix-flight{level}")
        still = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~still))
        if most <= 1:
            break
        open_, level = flown.where(still), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    taken = F.col("size") * (F.col("whole") + F.col("p").cast("long"))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "u")


def take(docs: DataFrame) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with a column ``copy``
    that counts from 1 (a longer name if there is one already). Rows without words go."""
    drawn = mix(docs).where("taken > 0").select("doc_id", "source", "u", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    nth = W.partitionBy("doc_id", "source", "u")  # rows that agree in id, source and text were drawn separately
    drawn = drawn.withColumn("nth", F.row_number().over(nth.orderBy(F.col("times").desc())))
    drawn = drawn.toDF(*[free_name(docs, f"drawn_{c}") for c in drawn.columns])
    one, two, three, times, which = drawn.columns
    own, number, copy = free_name(docs, "row_print"), free_name(docs, "row_number"), free_name(docs, "copy")
    rows = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    rows = rows.withColumn(number, F.row_number().over(W.partitionBy("doc_id", "source", own).orderBy(own)))
    same = F.col("doc_id").eqNullSafe(F.col(one)) & F.col("source").eqNullSafe(F.col(two)) & (F.col(own) == F.col(three)) & (F.col(number) == F.col(which))
    return rows.join(drawn.hint("merge"), same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("u")

"""Operator 1, language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language inside the tasks and sums them with Spark. The matrix of
languages x buckets is cut into blocks of about ``BLOCK_LANGUAGES`` languages, hashed, of which
the driver and the tasks hold one at a time, so any number of languages has a bounded model.
Scoring gathers log-probabilities for a batch of texts from the broadcast block and adds them
up per text. A single block is scored within the plan; several are one pass each, which leaves
each text's best language, its log-probability and the sum over the block, merged by text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows
without text or language are not learned from; with no labelled row at all every text
is ``und``; copies and repeated rows are scored alike; a text of any length is read
whole, in pieces that overlap so that no n-gram is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stash, table, text_key
from .rolling import mix

ORDERS = (1, 2, 3)
BITS = 16
BLOCK_LANGUAGES = 64
SMOOTHING = 0.5
UNKNOWN = "und"
_PIECE = 1 << 18
_BATCH = 1 << 20


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams of the lower-cased, space-padded text, piece by piece."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    reach = max(ORDERS) - 1
    for at in range(0, len(points), _PIECE):
        piece = points[at : at + _PIECE + reach]
        found = []
        for n in ORDERS:
            m = min(len(piece) - n + 1, _PIECE)
            if m > 0:
                h = np.full(m, n, np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) + piece[k : k + m]
                found.append(mix(h) >> np.uint64(64 - BITS))
        yield np.concatenate(found).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, and log-probabilities: priors, then by bucket; one row for each language."""

    languages: list[str]
    priors: np.ndarray
    weights: np.ndarray

    def logs(self, texts: list[str]) -> np.ndarray:
        """Joint log-probabilities, one row for each text."""
        logs = np.tile(self.priors, (len(texts), 1))
        gathered: list[np.ndarray] = []
        owners: list[int] = []

        def settle() -> None:
            if gathered:
                firsts = np.cumsum([0, *map(len, gathered[:-1])])
                buckets = np.concatenate(gathered)
                for k in range(len(self.languages)):
                    np.add.at(logs[:, k], owners, np.add.reduceat(self.weights[k][buckets], firsts))
                gathered.clear()
                owners.clear()

        held = 0
        for row, text in enumerate(texts):
            for buckets in ngram_buckets(text):
                gathered.append(buckets)
                owners.append(row)
                held += len(buckets)
                if held > _BATCH:
                    settle()
                    held = 0
        settle()
        return logs


@dataclass(frozen=True)
class Training:
    """Sums (lang, bucket, n) in the shared folder; the last bucket counts documents."""

    sums: DataFrame
    documents: int
    blocks: int

    def model(self, block: int) -> LanguageModel:
        """The languages of one block; their priors are shares of all documents."""
        mine = self.sums.where(F.pmod(F.xxhash64("lang"), F.lit(self.blocks)) == block).toArrow()
        names = mine["lang"].to_pylist()
        languages = sorted(set(names))
        place = {name: k for k, name in enumerate(languages)}
        counts = np.zeros((len(languages), (1 << BITS) + 1))
        counts[np.array([place[x] for x in names], np.int64), mine["bucket"].to_numpy()] = mine["n"].to_numpy()
        grams = counts[:, :-1] + SMOOTHING
        return LanguageModel(languages, np.log(counts[:, -1] / self.documents), np.log(grams / grams.sum(axis=1, keepdims=True)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Training | None:
    """Learn from all rows that have a text and a language; None if there are none."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0

        def settle() -> None:
            for name, parts in waiting.items():
                totals[name][:-1] += np.bincount(np.concatenate(parts), minlength=1 << BITS)
            waiting.clear()

        def rows_of() -> Iterator[pd.DataFrame]:
            settle()
            for name, counts in totals.items():
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": name, "bucket": used, "n": counts[used]})
            totals.clear()

        for batch in batches:
            for text, name in zip(batch["text"], batch["lang"]):
                if name not in totals and len(totals) >= BLOCK_LANGUAGES:
                    yield from rows_of()
                totals.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))[-1] += 1
                for buckets in ngram_buckets(text):
                    waiting.setdefault(name, []).append(buckets)
                    held += len(buckets)
                    if held > _BATCH:
                        settle()
                        held = 0
        yield from rows_of()

    sums = stash(rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-sums")
    found = sums.where(F.col("bucket") == 1 << BITS).agg(F.count("*").alias("languages"), F.sum("n").alias("documents")).first()
    return Training(sums, found["documents"], -(-found["languages"] // BLOCK_LANGUAGES)) if found["languages"] else None


def _scorer(spark: SparkSession, model: LanguageModel):
    """A UDF that gives a text's best language of the model, its log-probability, and the sum
    of all the model's probabilities as a share of the best one; null without a letter."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, top double, total double")
    def score(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        known = texts.map(lambda x: x is not None and any(c.isalpha() for c in x)).to_numpy(bool)
        names = np.full(len(texts), None, object)
        top, total = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
        if known.any() and model.languages:
            logs = model.logs(list(texts[known]))
            names[known] = np.array(model.languages, object)[logs.argmax(axis=1)]
            top[known] = logs.max(axis=1)
            total[known] = np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return pd.DataFrame({"lang": names, "top": top, "total": total})

    return score, shared


def scored(docs: DataFrame, training: Training | None, name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: lang_pred, score."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if training is None:
        return docs.withColumn(name, unknown)
    spark = docs.sparkSession

    def verdict(lang: Column, odds: Column) -> Column:
        return F.when(lang.isNotNull(), F.struct(lang.alias("lang_pred"), odds.alias("score"))).otherwise(unknown)

    if training.blocks == 1:
        look, _ = _scorer(spark, training.model(0))
        raw = docs.withColumn(name, look(docs["text"]))
        return raw.withColumn(name, verdict(F.col(f"{name}.lang"), 1 / F.col(f"{name}.total")))
    passes = []
    for k in range(training.blocks):
        look, shared = _scorer(spark, training.model(k))
        found = docs.select(text_key(docs["text"]).alias("key"), look(docs["text"]).alias("f")).where(F.col("f.lang").isNotNull())
        passes.append(stash(found.groupBy("key").agg(F.any_value("f").alias("f")), f"language-block{k}"))
        shared.destroy()
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    key = free_name(docs, "language_key")
    best = F.array_sort(F.collect_list(F.struct((-F.col("f.top")).alias("low"), F.col("f.lang").alias("lang"), F.col("f.total").alias("total"))))
    every = every.groupBy(F.col("key").alias(key)).agg(best.alias("b"))
    first = F.get("b", 0)
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + x["total"] * F.exp(first["low"] - x["low"]))
    every = stash(every.select(key, F.struct(first["lang"].alias("lang_pred"), (1 / total).alias("score")).alias(name)), "language-merged")
    return docs.join(every.hint("merge"), text_key(docs["text"]) == every[key], "left").withColumn(name, F.coalesce(F.col(name), unknown)).drop(key)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that is kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def identify(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``; the model learns
    from the rows of ``train`` (or ``docs``) outside the held-out fold."""
    training = fit((docs if train is None else train).where(~held_out(F.col("doc_id"))))
    rows = scored(docs.select("doc_id", "text"), training, "p")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is recognised with at least that probability, all columns kept."""
    found = free_name(docs, "language_found")
    rows = scored(docs, fit(docs.where(~held_out(F.col("doc_id")))), found)
    return rows.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= least)).drop(found)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))

"""Operator 7, benchmark decontamination with training suffix arrays.

The documents of a batch are cut into shards of bounded size, and the words of a shard become
a suffix array in full order, by doubling: three words first, and then only what is still
tied. The test items are a stated query set. Each distinct run of ten of their words (all
words of a shorter item) is binary-searched in each shard; the range it finds holds every
location. Where a document is hit, its suffixes are placed in the suffix array of the items,
whose neighbours there give the longest verbatim match.

Items go in blocks of about ``BLOCK_BYTES`` of text, hashed, of which the driver and the tasks
hold one at a time. Equal items are one, an item of over ``PIECE_BYTES`` is cut into pieces that share
``OVERLAP_BYTES`` and at least a window, and there are as many blocks as keep the largest within twice
its size, which is checked before one is fetched. A single block is searched within the plan and nothing is
shuffled; several are one pass each, whose hits are written to the shared folder and merged by text.

Defined cases: a null or empty text has no words; an item without words is never found;
an item with a null id counts as having the empty id; items that share an id are one
item; the longest match with an item that was cut is that with one of its pieces; repeated documents are judged alike; long documents are searched in overlapping
shards; words that repeat without end cost no pairs; with no items nothing is contaminated;
a column name that is taken is lengthened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .common import free_name, stash, table, text_key

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 2 << 20
OVERLAP_BYTES = 64 << 10
_RANK_BITS = 21  # three ranks make a key; a shard has fewer than 2**21 words
_GAP, _ITEM_GAP = np.zeros(1, np.uint64), np.ones(1, np.uint64)  # no word's hash: matches cross neither
_HITS = "n_words long, runs array<struct<start:int,end:int>>, items array<string>, longest long"


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of the text, A-Z lower-cased; read in pieces cut between words."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SHARD_BYTES)
        while end < len(raw) and rolling.ALNUM[raw[end]]:
            end += 1
        data = np.frombuffer(raw, np.uint8, end - at, at)
        starts, ends = rolling.word_bounds(data, rolling.ALNUM)
        found.append(rolling.span_hashes(rolling.prefix_sums(data), starts, ends))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


class SuffixArray:
    """All suffixes of a run of words, in order of their words' hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        n = len(words)
        padded = np.zeros(n + WINDOW + 3, np.int64)
        padded[:n] = rank + 1
        bits = np.int64(_RANK_BITS)
        self.keys = (padded[:-2] << (2 * bits)) | (padded[1:-1] << bits) | padded[2:]
        order = np.argsort(self.keys[:n], kind="stable")
        place = np.zeros(n + 1, np.int64)  # by position, the first place of its group, from 1
        group = self._groups(self.keys[order])
        place[order] = group + 1
        depth = 3
        while depth < n:
            tied = np.zeros(n, bool)
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            at = np.flatnonzero(tied)
            if not len(at):
                break
            part = order[at]
            key = group[at] * np.int64(n + 1) + place[np.minimum(part + depth, n)]
            sorting = np.argsort(key, kind="stable")
            order[at] = part[sorting]
            key = key[sorting]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            group[at] = np.repeat(at[start], np.diff(np.concatenate((start, [len(at)]))))
            place[order[at]] = group[at] + 1
            depth *= 2
        self.order = order

    @staticmethod
    def _groups(keys: np.ndarray) -> np.ndarray:
        """For sorted keys, the first place of each one's run."""
        start = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
        return np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0)) if len(keys) else np.empty(0, np.int64)

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """windows: hashes, a row of n words for each. Rows that occur, and the first and the
        last but one place of each in ``order``."""
        if not len(self.order) or not len(windows):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        n = windows.shape[1]
        at = np.minimum(np.searchsorted(self.vocabulary, windows), len(self.vocabulary) - 1)
        rows = np.flatnonzero((self.vocabulary[at] == windows).all(axis=1))
        ranks = at[rows] + 1
        low, high = [], []
        for first in range(0, n, 3):
            a, b = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for k in range(first, first + 3):
                a = (a << _RANK_BITS) | (ranks[:, k] if k < n else 0)
                b = (b << _RANK_BITS) | (ranks[:, k] if k < n else (1 << _RANK_BITS) - 1)
            low.append(a)
            high.append(b)
        starts, ends = self._bound(low, False), self._bound(high, True)
        met = ends > starts
        return rows[met], starts[met], ends[met]

    def _bound(self, wanted: list[np.ndarray], after: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(self.order), np.int64)
        while (busy := low < high).any():
            mid = np.where(busy, (low + high) // 2, 0)
            spot = self.order[mid]
            less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
            for k, theirs in enumerate(wanted):
                got = self.keys[np.minimum(spot + 3 * k, len(self.keys) - 1)]
                less |= equal & (got < theirs)
                equal &= got == theirs
            right = busy & (less | (equal & after))
            low = np.where(right, mid + 1, low)
            high = np.where(busy & ~right, mid, high)
        return low


def _sums(words: np.ndarray) -> np.ndarray:
    """Sums from which spans of words are compared in one step, as of bytes in ``rolling``."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(rolling.mix(words) * rolling.power("up", len(words) + 1)[: len(words)], out=sums[1:])
    return sums


def _shared(sums_a: np.ndarray, a: np.ndarray, sums_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b share from their start on, for each pair."""
    down = rolling.power("down", max(len(sums_a), len(sums_b)))
    low, high = np.zeros(len(a), np.int64), np.minimum(len(sums_a) - 1 - a, len(sums_b) - 1 - b)
    while (busy := low < high).any():
        mid = np.where(busy, (low + high + 1) // 2, low)
        same = (sums_a[a + mid] - sums_a[a]) * down[a] == (sums_b[b + mid] - sums_b[b]) * down[b]
        low = np.where(busy & same, mid, low)
        high = np.where(busy & ~same, mid - 1, high)
    return low


class Queries:
    """The distinct windows of a block of test items, the items of each, and the items' suffixes."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.ids = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.ids)}
        parts, starts, owners, at = [np.empty(0, np.uint64)], {}, {}, 0
        for name, text in items:
            words = word_hashes(text)
            n = min(WINDOW, len(words))
            if n:
                starts.setdefault(n, []).append(np.arange(at, at + len(words) - n + 1))
                owners.setdefault(n, []).append(np.full(len(words) - n + 1, place[name]))
                parts += [words, _ITEM_GAP]
                at += len(words) + 1
        self.words = np.concatenate(parts)
        self.windows = []  # length, first words of the distinct windows, and the items of each from .. to
        for n, found in starts.items():
            first, owner = np.concatenate(found), np.concatenate(owners[n])
            one, two = rolling.combine(self.words, n), rolling.combine(rolling.mix(self.words), n)
            _, kept, which = np.unique(np.stack((one[first], two[first]), axis=1), axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(which.ravel() * len(self.ids) + owner)
            edges = np.searchsorted(pairs // len(self.ids), np.arange(len(kept) + 1))
            self.windows.append((n, first[kept], edges, pairs % len(self.ids)))
        self.order, self.sums = SuffixArray(self.words).order, _sums(self.words)

    def longest(self, words: np.ndarray, at: np.ndarray) -> int:
        """The longest match of any suffix of ``words`` that starts at one of these places."""
        sums = _sums(words)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        best = 0
        while (busy := low < high).any():
            mid = np.where(busy, (low + high) // 2, 0)
            spot = self.order[mid]
            same = _shared(sums, at, self.sums, spot)
            best = max(best, int(same[busy].max()))
            mine, theirs = at + same, spot + same
            ended = (mine >= len(words)) | (theirs >= len(self.words))
            a, b = words[np.minimum(mine, len(words) - 1)], self.words[np.minimum(theirs, len(self.words) - 1)]
            right = busy & np.where(ended, theirs >= len(self.words), b < a)
            low = np.where(right, mid + 1, low)
            high = np.where(busy & ~right, mid, high)
        return best


def _shards(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Runs of words of bounded length with, for each document in it, (row, first word in
    the document, start in the run, end). A document that is cut overlaps by a window."""
    most = SHARD_BYTES // 4
    words: list[np.ndarray] = []
    spans: list[tuple[int, int, int, int]] = []
    filled = 0
    for row, own in enumerate(texts):
        for at in range(0, max(len(own) - WINDOW + 1, min(len(own), 1)), most):
            piece = own[at : at + most + WINDOW - 1]
            words += [piece, _GAP]
            spans.append((row, at, filled, filled + len(piece)))
            filled += len(piece) + 1
            if filled >= most:
                yield np.concatenate(words), spans
                words, spans, filled = [], [], 0
    if spans:
        yield np.concatenate(words), spans


def _unions(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that intervals make up."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def search(queries: Queries, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str], int]]:
    """For each text: number of words, runs of hit words, items found (ids), longest match in words."""
    words = [word_hashes(x) for x in texts]
    starts: dict[int, list[np.ndarray]] = {}
    ends: dict[int, list[np.ndarray]] = {}
    items: dict[int, set[int]] = {}
    for run, spans in _shards(words) if queries.windows else ():
        array = SuffixArray(run)
        row_of, first_of, begin = (np.array([s[k] for s in spans]) for k in (0, 1, 2))
        for n, first, edges, owners in queries.windows:
            which, low, high = array.find(queries.words[first[:, None] + np.arange(n)])
            if not len(which):
                continue
            counts = high - low
            ranks = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
            places = array.order[ranks]
            span = np.searchsorted(begin, places, "right") - 1
            own = places - begin[span] + first_of[span]
            met = np.unique(row_of[span] * np.int64(len(first)) + np.repeat(which, counts))
            for row, window in zip((met // len(first)).tolist(), (met % len(first)).tolist()):
                items.setdefault(row, set()).update(owners[edges[window] : edges[window + 1]].tolist())
            by_row = np.argsort(row_of[span], kind="stable")
            rows, cuts = np.unique(row_of[span][by_row], return_index=True)
            for row, part in zip(rows.tolist(), np.split(own[by_row], cuts[1:])):
                starts.setdefault(row, []).append(part)
                ends.setdefault(row, []).append(part + n)
    out = []
    for row, own in enumerate(words):
        if row in items:
            a, b = np.concatenate(starts[row]), np.concatenate(ends[row])
            out.append((len(own), _unions(a, b), [queries.ids[i] for i in sorted(items[row])], queries.longest(own, np.unique(a))))
        else:
            out.append((len(own), [], [], 0))
    return out


def _looker(shared: Broadcast):
    @F.pandas_udf(_HITS)
    def look(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(search(shared.value, list(texts)), columns=["n_words", "runs", "items", "longest"])

    return look


def _merged(runs: pd.Series) -> pd.Series:
    return pd.Series([_unions(np.array([r["start"] for r in x]), np.array([r["end"] for r in x])) for x in runs], dtype=object)


def pieces(text: str | None, most: int, overlap: int) -> list[str]:
    """The text, or if it has over ``most`` bytes, parts of it that between them hold all its windows."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= most:
        return [text] if text else []
    starts, ends = rolling.word_bounds(np.frombuffer(raw.lower(), np.uint8), rolling.ALNUM)
    found, first = [], 0
    while first < len(starts):
        last = min(len(starts), max(int(np.searchsorted(ends, starts[first] + most, "right")), first + 2 * WINDOW))
        found.append(raw[starts[first] : ends[last - 1]].decode("utf-8", "replace"))
        if last == len(starts):
            break
        first = max(first + 1, min(last - WINDOW + 1, int(np.searchsorted(starts, ends[last - 1] - overlap))))
    return found


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct pieces (i, text) of the items, and how many hashed blocks they make."""
    bounds = PIECE_BYTES, OVERLAP_BYTES
    cut = F.pandas_udf(lambda texts: pd.Series([pieces(x, *bounds) for x in texts], dtype=object), "array<string>")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").where("text is not null").distinct()
    items = stash(rows.select("i", F.explode(cut("text")).alias("text")).distinct(), "leak-items")
    size = F.octet_length("text")
    total, largest = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK_BYTES))
    while blocks > 1:
        most = items.groupBy(F.pmod(F.xxhash64("i", "text"), F.lit(blocks))).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0]
        if most <= max(2 * BLOCK_BYTES + PIECE_BYTES, largest):  # words of megabytes make larger pieces
            break
        blocks *= 2
    return items, blocks


def _searched(docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct column of _HITS."""
    spark = docs.sparkSession
    items, blocks = _blocks(benchmark)

    def block(k: int) -> Broadcast:
        mine = items.where(F.pmod(F.xxhash64("i", "text"), F.lit(blocks)) == k)
        return spark.sparkContext.broadcast(Queries([(r["i"], r["text"]) for r in mine.toLocalIterator()]))

    if blocks == 1:
        return docs.withColumn(name, _looker(block(0))(docs["text"]))
    passes = []
    for k in range(blocks):
        shared = block(k)
        found = docs.select(text_key(docs["text"]).alias("key"), _looker(shared)(docs["text"]).alias("f"))
        passes.append(stash(found.where(F.size("f.items") > 0).groupBy("key").agg(F.any_value("f").alias("f")), f"leak-block{k}"))
        shared.destroy()
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    merge = F.pandas_udf(_merged, "array<struct<start:int,end:int>>")
    every = every.groupBy("key").agg(F.max("f.n_words").alias("n_words"), F.flatten(F.collect_list("f.runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"), F.max("f.longest").alias("longest"))
    key = free_name(docs, "leak_key")
    every = stash(every.select(F.col("key").alias(key), F.struct("n_words", merge("runs").alias("runs"), "items", "longest").alias(name)), "leak-merged")
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")
    none = F.struct(words.alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("runs"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"))
    return docs.join(every.hint("merge"), text_key(docs["text"]) == every[key], "left").withColumn(name, F.coalesce(F.col(name), none)).drop(key)


def match(docs: DataFrame, benchmark: DataFrame, name: str = "leak") -> DataFrame:
    """``docs`` with a last struct column, named so or longer: n_words, n_hit, items (ids as
    text, sorted), longest_match in words, locations (runs of hit words), contaminated."""
    name = free_name(docs, name)
    hits = F.aggregate(F.col(f"{name}.runs"), F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    leak = F.struct(
        F.col(f"{name}.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.col(f"{name}.items").alias("items"),
        F.col(f"{name}.longest").alias("longest_match"),
        F.col(f"{name}.runs").alias("locations"),
        (F.size(f"{name}.runs") > 0).alias("contaminated"),
    )
    return _searched(docs, benchmark, name).withColumn(name, leak)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of any item."""
    found = match(docs, benchmark)
    name = found.columns[-1]
    return found.where(~F.col(f"{name}.contaminated")).drop(name)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"), "leak.contaminated", "leak.longest_match", "leak.locations")

"""Operator 11, cross-tokenizer alignment: the tokens of two tokenizers over the same bytes.

A batch of texts is one stream of bytes, in which the end of every text is a cut of both
tokenizers: cumulated token lengths are the ends, ends that both share are the cuts
(``intersect1d``), a token's group is its place among the cuts (``searchsorted``), and
the overlapping pairs of tokens come from repeating each A token as often as B tokens reach into it.

Counts of id pairs are summed in tasks for each chunk of texts, then by pair and salt, then by
pair. A chunk's distinct pairs (not those of each text) meet the sums in a join, and the chunk's
texts take their figures from that in one bounded group, as a chunk ends after ``CHUNK_BYTES``.

Defined cases: null and empty texts, and texts whose tokens do not give back a space and the
text (a B model without a byte for some character, a U+2581 in the text), have no tokens and
zeros, and '' as digest; strings of special tokens are plain text; every row is a document of
its own, so repeated rows and copies count each; other columns are not looked at; an empty
table gives an empty result. A tokenizer's file is read on the driver, whose size bounds the broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 8 << 20
STREAM_BYTES = 2 << 20
SALTS = 16
#: fixed value: how the byte-level tokenizer cuts a text into words before it merges bytes
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """The vocabulary of a byte-level BPE file; ids are in the order of merges."""

    def __init__(self, content: bytes):
        import tiktoken

        letters = _byte_of_letter()
        ranks = {bytes(letters[c] for c in token): k for token, k in json.loads(content)["model"]["vocab"].items()}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, k in ranks.items():
            self.pieces[k] = piece
        self._encoding = tiktoken.Encoding("byte-bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encoding.encode_to_numpy(" " + x, disallowed_special=()) for x in texts]


class PieceBpe:
    """A sentencepiece model, which puts a space before the text by itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        names = [self._model.id_to_piece(k) for k in range(self._model.get_piece_size())]
        one_byte = [re.fullmatch("<0x([0-9A-F]{2})>", x) for x in names]
        self.pieces = [bytes([int(m[1], 16)]) if m else x.replace("▁", " ").encode() for m, x in zip(one_byte, names)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self._model.encode(texts, num_threads=1)]


_loaded: dict[tuple[type, int], ByteBpe | PieceBpe] = {}


def _load(kind: type, content: bytes):
    """One tokenizer of a kind for each worker."""
    key = (kind, hash(content))
    if key not in _loaded:
        _loaded[key] = kind(content)
    return _loaded[key]


@dataclass(frozen=True)
class Alignment:
    """Texts as one stream: token ids and ends of both tokenizers, cuts, and for each text its
    number of bytes and of tokens; links are places of an A and a B token that overlap."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray
    n_bytes: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def owners(self) -> np.ndarray:
        """The text of each link."""
        return np.repeat(np.arange(len(self.n_a)), self.n_a)[self.left]

    def group_bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each group's A and B tokens begin, and one more for the end."""
        starts = np.concatenate(([0], self.cuts))
        return np.searchsorted(self.a_ends, starts, "right"), np.searchsorted(self.b_ends, starts, "right")


def align(texts: list[str | None], one: ByteBpe, two: PieceBpe) -> Alignment:
    """Texts that one of the tokenizers does not give back have no tokens."""
    known = [x or "" for x in texts]
    tokens_a, tokens_b = one.encode(known), two.encode(known)
    none = np.empty(0, np.int64)
    n_bytes = np.zeros(len(known), np.int64)
    for k, text in enumerate(known):
        raw = (" " + text).encode()
        if text and all(raw == b"".join(map(t.pieces.__getitem__, ids[k].tolist())) for t, ids in ((one, tokens_a), (two, tokens_b))):
            n_bytes[k] = len(raw)
        else:
            tokens_a[k] = tokens_b[k] = none
    sides = []
    for tokenizer, ids in ((one, tokens_a), (two, tokens_b)):
        stream = np.concatenate([none, *ids]).astype(np.int64)
        lengths = np.fromiter(map(len, tokenizer.pieces), np.int64, len(tokenizer.pieces))[stream]
        sides.append((stream, np.cumsum(lengths), lengths, np.fromiter(map(len, ids), np.int64, len(ids))))
    (a, a_ends, a_lengths, n_a), (b, b_ends, _, n_b) = sides
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    first, last = np.searchsorted(b_ends, a_ends - a_lengths, "right"), np.searchsorted(b_ends, a_ends, "left")
    times = last - first + 1
    left = np.repeat(np.arange(len(a)), times)
    right = np.arange(len(left)) + np.repeat(first - (np.cumsum(times) - times), times)
    return Alignment(a, a_ends, b, b_ends, cuts, n_bytes, n_a, n_b, left, right)


def _decimals(n: int, between: str, after: str) -> np.ndarray:
    """Rows of bytes, filled up with zeros: ids and what follows them, inside and at the end of a group."""
    text = [f"{k}{between}" for k in range(n)] + [f"{k}{after}" for k in range(n)]
    return np.array([x.encode() for x in text]).view(np.uint8).reshape(2 * n, -1)


def digests(found: Alignment, size_a: int, size_b: int) -> list[str]:
    """The sha256 of each text's groups, written as a1,a2|b1;a3|b2,b3; '' for texts without tokens."""
    first_a, first_b = found.group_bounds()
    group_a, group_b = np.searchsorted(found.cuts, found.a_ends), np.searchsorted(found.cuts, found.b_ends)
    width = len(str(max(size_a, size_b))) + 1
    rows = np.zeros((len(found.a) + len(found.b), width), np.uint8)
    for ids, ends, place, size, marks in (
        (found.a, found.a_ends, np.arange(len(found.a)) + first_b[group_a], size_a, ",|"),
        (found.b, found.b_ends, np.arange(len(found.b)) + first_a[group_b + 1], size_b, ",;"),
    ):
        group = group_a if ids is found.a else group_b
        known = _decimals(size, *marks)
        rows[place, : known.shape[1]] = known[ids + size * (ends == found.cuts[group])]
    used = rows != 0
    written = rows[used].tobytes()
    ends = np.concatenate(([0], np.cumsum(np.count_nonzero(used, axis=1))))[np.concatenate(([0], np.cumsum(found.n_a + found.n_b)))].tolist()
    return [hashlib.sha256(written[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]


def _streams(batches: Iterator[pd.DataFrame], most: int = STREAM_BYTES) -> Iterator[pd.DataFrame]:
    """The same rows, cut after about so many characters."""
    for batch in batches:
        size = batch["text"].str.len().fillna(0).to_numpy(np.int64).cumsum() // most
        for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(size)) + 1):
            if len(part):
                yield batch.iloc[part].reset_index(drop=True)


def _tokenizers(spark: SparkSession, byte_bpe: str, piece_bpe: str):
    """A function that tasks call to get both tokenizers, read on the driver and broadcast."""
    files = spark.sparkContext.broadcast((Path(byte_bpe).read_bytes(), Path(piece_bpe).read_bytes()))
    return lambda: (_load(ByteBpe, files.value[0]), _load(PieceBpe, files.value[1]))


#: ids go through pandas as strings, which keeps large ones beside nulls
_ID = "cast(doc_id AS string) AS doc_id"
_FIGURES = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_TEXTS = f"chunk long, {_FIGURES}, pairs array<long>, times array<long>, documents array<long>"


def groups(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id and the groups of each text: start and end in bytes of the text with its space, ids of A and of B."""
    tokenizers = _tokenizers(docs.sparkSession, byte_bpe, piece_bpe)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _streams(batches):
            found = align(batch["text"].tolist(), *tokenizers())
            first_a, first_b = found.group_bounds()
            text_ends = np.cumsum(found.n_bytes)
            owner = np.searchsorted(text_ends, found.cuts)
            rows: list[list[dict]] = [[] for _ in range(len(batch))]
            start = 0
            for g, (end, text) in enumerate(zip(found.cuts.tolist(), owner.tolist())):
                base = int(text_ends[text] - found.n_bytes[text])
                rows[text].append({"start": start - base, "end": end - base, "a": found.a[first_a[g] : first_a[g + 1]].tolist(), "b": found.b[first_b[g] : first_b[g + 1]].tolist()})
                start = end
            yield pd.DataFrame({"doc_id": batch["doc_id"], "groups": rows})

    out = docs.selectExpr(_ID, "text").mapInPandas(made, "doc_id string, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def encoded(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Figures of each text with its distinct pairs (a * size of B + b) and how often it links them; and,
    as rows where ``documents`` is set, the distinct pairs of each chunk with the documents that have them."""
    tokenizers = _tokenizers(docs.sparkSession, byte_bpe, piece_bpe)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = tokenizers()
        size_a, size_b = len(one.pieces), len(two.pieces)
        chunk, held = TaskContext.get().partitionId() << 32, 0
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> pd.DataFrame:
            pairs, at = np.unique(np.concatenate([p for p, _ in seen]), return_inverse=True)
            documents = np.bincount(at, np.concatenate([n for _, n in seen]), len(pairs)).astype(np.int64)
            return pd.DataFrame({c: [None] for c in columns} | {"chunk": [chunk], "pairs": [pairs], "documents": [documents]})

        columns = [c.split()[0] for c in _TEXTS.split(", ")]
        for batch in _streams(batches):
            found = align(batch["text"].tolist(), one, two)
            n = len(batch)
            owners = found.owners
            keys, times = np.unique(owners * (size_a * size_b) + found.a[found.left] * size_b + found.b[found.right], return_counts=True)
            pairs = keys % (size_a * size_b)
            parts = np.searchsorted(keys // (size_a * size_b), np.arange(1, n))
            out = {"chunk": chunk, "doc_id": batch["doc_id"], "n_a": found.n_a, "n_b": found.n_b}
            out |= {"n_groups": np.bincount(np.searchsorted(np.cumsum(found.n_bytes), found.cuts), minlength=n), "n_links": np.bincount(owners, minlength=n)}
            out |= {"groups_sha256": digests(found, size_a, size_b), "pairs": np.split(pairs, parts), "times": np.split(times, parts)}
            yield pd.DataFrame(out | {"documents": [None] * n})
            seen.append(np.unique(pairs, return_counts=True))
            held += int(found.n_bytes.sum())
            if held >= CHUNK_BYTES:
                yield summed()
                chunk, held, seen = chunk + 1, 0, []
        if seen:
            yield summed()

    return docs.selectExpr(_ID, "text").mapInPandas(made, _TEXTS)


def _summed(table_: DataFrame) -> DataFrame:
    """pair, count: by pair and salt first, then by pair."""
    each = table_.where("documents IS NOT NULL").select(F.pmod("chunk", F.lit(SALTS)).alias("salt"), F.explode(F.arrays_zip("pairs", "documents")).alias("p"))
    salted = each.groupBy(F.col("p")["pairs"].alias("pair"), "salt").agg(F.sum(F.col("p")["documents"]).alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("count"))


def pair_counts(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """a, b, documents: in how many documents tokens of these ids overlap."""
    size = len(_load(PieceBpe, Path(piece_bpe).read_bytes()).pieces)
    sums = _summed(encoded(docs, byte_bpe, piece_bpe))
    return sums.select(F.expr(f"pair div {size}").cast("int").alias("a"), (F.col("pair") % size).cast("int").alias("b"), F.col("count").alias("documents"))


def scored(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """The figures of each text, its links that are the most frequent of their A id, and the sum of its links' counts."""
    size = len(_load(PieceBpe, Path(piece_bpe).read_bytes()).pieces)
    made = stash(encoded(docs, byte_bpe, piece_bpe), "align-texts")
    sums = stash(_summed(made).withColumn("a", F.expr(f"pair div {size}")), "align-sums")
    highest = sums.groupBy("a").agg(F.max("count").alias("highest"))
    known = stash(sums.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "align-counts")
    each = made.where("documents IS NOT NULL").select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair"))
    chunks = each.join(known, "pair")
    texts = made.where("documents IS NULL").drop("documents")

    def settle(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("pair")
        pair, count, best = (known[c].to_numpy() for c in ("pair", "count", "best"))
        empty = [np.empty(0, np.int64)]
        at = np.searchsorted(pair, np.concatenate([*empty, *texts["pairs"]]))
        times = np.concatenate([*empty, *texts["times"]])
        owner = np.repeat(np.arange(len(texts)), texts["pairs"].map(len))
        out = texts.drop(columns=["chunk", "pairs", "times"])
        for name, values in (("n_best", times * best[at]), ("count_sum", times * count[at])):
            sums = np.zeros(len(texts), np.int64)
            np.add.at(sums, owner, values)
            out[name] = sums
        return out

    both = texts.groupBy("chunk").cogroup(chunks.groupBy("of"))
    return both.applyInPandas(settle, f"{_FIGURES}, n_best long, count_sum long").withColumn("doc_id", F.col("doc_id").cast("long"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))

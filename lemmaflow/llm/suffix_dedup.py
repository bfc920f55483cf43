"""Operator 3, suffix-array dedup by deep-shallow sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts at two places or
more. Of each such window the least hash among its ``GRAM``-byte grams is its anchor, so
equal windows have equal anchors at equal offsets, and a window can only repeat where its
anchor's gram repeats. Anchors whose context (all windows through them) is repeated as a
whole are settled by counting. For the rest, one member of each different context goes to
its gram's group; there the suffixes after the grams, and the reversed prefixes before
them, are ordered: multikey quicksort on eight bytes at a time to ``SHALLOW`` bytes, then
a blind trie for each group that is still tied. The common prefixes of both orders tell
how far every member's repeated windows reach.

Groups of more than ``GROUP_ROWS`` different contexts go another exact way, linear in
their size and spread over tasks: the windows of an anchor are cut into ranges of offsets;
the bytes that all windows of a range share are its core, those that any covers its cover; a
range whose core is alone holds no repeated window, one whose cover is repeated only such
windows, and the others are cut finer until a range is one window.

Defined cases: null and empty texts have no bytes; a text shorter than ``LENGTH`` loses
nothing; matches never cross documents; rows that repeat id and text are two places;
null ids are ids like any other; long texts are read whole, in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .common import stash, table

LENGTH = 400
GRAM = 128
REACH = LENGTH - GRAM
SHALLOW = 64
GROUP_ROWS = 256
#: widths of the ranges of offsets, from coarse to single windows
RANGES = (96, 12, 1)
_PIECE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` consecutive ones, from running minima of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows, hashes of their grams and of their contexts."""
    windows = len(raw) - LENGTH + 1
    places, grams, contexts = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for first in range(0, windows, _PIECE):
        last = min(first + _PIECE, windows)
        low, high = max(0, first - REACH), min(len(raw), last + REACH + LENGTH)
        sums = rolling.prefix_sums(np.frombuffer(raw, np.uint8, high - low, low))
        hashes = rolling.gram_hashes(sums, GRAM)[first - low : last + REACH - low]
        # the place within the piece breaks ties to the left and names the anchor
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        at = np.unique(_least_in_windows(keys, REACH + 1) & _PLACE).astype(np.int64)
        own = at + first
        starts, ends = np.maximum(own - REACH, 0) - low, np.minimum(own + LENGTH, len(raw)) - low
        places.append(own)
        grams.append(hashes[at])
        contexts.append(rolling.mix(rolling.span_hashes(sums, starts, ends) + (own - low - starts).astype(np.uint64)))
    position, kept = np.unique(np.concatenate(places), return_index=True)
    return position, np.concatenate(grams)[kept], np.concatenate(contexts)[kept]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class _Branch:
    """A node of a blind trie: it knows only where its strings part and by which byte."""

    __slots__ = ("depth", "ways")

    def __init__(self, depth: int, ways: dict):
        self.depth, self.ways = depth, ways


def _byte(text: bytes, at: int) -> int:
    return text[at] if at < len(text) else -1


def blind_trie(strings: list[bytes], group: list[int]) -> Iterator[tuple[list[int], int]]:
    """The group in order: (members with equal strings, common prefix with the ones before)."""
    root: _Branch | list[int] = [group[0]]
    for i in group[1:]:
        own, node = strings[i], root
        while isinstance(node, _Branch):
            node = node.ways.get(_byte(own, node.depth)) or next(iter(node.ways.values()))
        other = strings[node[0]]
        same = common_prefix(own, other)
        if same == len(own) == len(other):
            node.append(i)
            continue
        parent, node = None, root
        while isinstance(node, _Branch) and node.depth < same:
            parent, node = node, node.ways[own[node.depth]]
        if isinstance(node, _Branch) and node.depth == same:
            node.ways[_byte(own, same)] = [i]
            continue
        fork = _Branch(same, {_byte(other, same): node, _byte(own, same): [i]})
        if parent is None:
            root = fork
        else:
            parent.ways[own[parent.depth]] = fork
    todo: list[tuple[_Branch | list[int], int]] = [(root, 0)]
    while todo:
        node, above = todo.pop()
        if isinstance(node, _Branch):
            ways = [node.ways[b] for b in sorted(node.ways)]
            todo += [(way, node.depth) for way in reversed(ways[1:])]
            todo.append((ways[0], above))
        else:
            yield node, above


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each with the next one in order."""
    order: list[int] = []
    shared: list[int] = []

    def put(members: list[int], known: int | None) -> None:
        for i in members:
            if order:
                shared.append(common_prefix(strings[order[-1]], strings[i]) if known is None else known)
            order.append(i)
            known = len(strings[i])

    todo: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            put(group, None)
        elif depth >= SHALLOW:
            for k, (members, known) in enumerate(blind_trie(strings, group)):
                put(members, known if k else None)
        else:
            pivot = strings[group[len(group) // 2]][depth : depth + 8]
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for i in group:
                key = strings[i][depth : depth + 8]
                parts[(key > pivot) - (key < pivot) + 1].append(i)
            less, equal, more = parts
            if more:
                todo.append((more, depth))
            if len(pivot) < 8:  # the strings end here, so the equal ones are equal to the end
                if less:
                    todo += [(equal, SHALLOW), (less, depth)]
                else:
                    put(equal, None)
            else:
                todo.append((equal, depth + 8))
                if less:
                    todo.append((less, depth))
    return np.array(order), np.array(shared, np.int64)


def reaches(lefts: list[bytes], rights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For members of one gram: how many bytes before it, and from it on, repeated windows
    reach (-1 and 0: none do). lefts: bytes before the gram, reversed; rights: those after it."""
    n = len(lefts)
    order_l, shared_l = deep_shallow(lefts)
    order_r, shared_r = deep_shallow(rights)
    before, since = np.full(n, -1), np.zeros(n, np.int64)
    if n == 2:
        left, right = int(shared_l[0]), int(shared_r[0])
        if left + right >= REACH:
            before[:], since[:] = left, GRAM + right
        return before, since
    # members agree on the window at offset o if they agree on o bytes before and REACH - o after
    cuts = np.unique(np.concatenate(([0], shared_l + 1, REACH - shared_r)))
    cuts = cuts[cuts <= REACH]
    of_l, of_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for first, last in zip(cuts.tolist(), [*(cuts[1:] - 1).tolist(), REACH]):
        of_l[order_l] = np.concatenate(([0], np.cumsum(shared_l < first)))
        of_r[order_r] = np.concatenate(([0], np.cumsum(shared_r < REACH - first)))
        _, which, count = np.unique(of_l * n + of_r, return_inverse=True, return_counts=True)
        again = count[which] > 1
        before[again] = np.maximum(before[again], last)
        since[again] = np.maximum(since[again], LENGTH - first)
    return before, since


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [anchors(raw_bytes(x)) for x in batch["text"]]
        if not found:
            continue
        times = [len(f[0]) for f in found]
        rows = batch[["doc_id", "print"]].loc[np.repeat(batch.index.to_numpy(), times)].reset_index(drop=True)
        yield rows.assign(at=np.concatenate([f[0] for f in found]), gram=np.concatenate([f[1] for f in found]).view(np.int64), context=np.concatenate([f[2] for f in found]).view(np.int64))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """batches: (text, wanted). The bytes around each wanted anchor."""
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["text"], batch["wanted"]):
            raw = raw_bytes(text)
            for w in wanted:
                at = w["at"]
                rows.append((w["gram"], w["context"], w["size"], raw[max(0, at - REACH) : at][::-1], raw[at + GRAM : at + LENGTH]))
        yield pd.DataFrame(rows, columns=["gram", "context", "size", "before", "after"])


def _order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """batches: (gram, context, before, after), sorted by gram; a group may run over batches."""
    held: pd.DataFrame | None = None

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["gram", "context"], ignore_index=True)
        grams = rows["gram"].to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(grams)) + 1, [len(grams)]))
        before, since = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
        lefts, rights = rows["before"].tolist(), rows["after"].tolist()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                before[a:b], since[a:b] = reaches(lefts[a:b], rights[a:b])
        return pd.DataFrame({"gram": grams, "context": rows["context"], "before": before, "since": since})[before >= 0]

    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = rows["gram"] == rows["gram"].iloc[-1]
        held = rows[last]
        if not last.all():
            yield solve(rows[~last])
    if held is not None and len(held):
        yield solve(held)


def _ranges(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """batches: (gram, context, before, after, offsets). For each range of offsets,
        hashes of the bytes that all its windows share, and of all bytes they cover."""
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                for o in r.offsets:
                    last = min(o + width - 1, REACH)
                    if len(r.before) >= o and len(r.after) >= REACH - last:
                        core = xxhash.xxh3_128_digest(r.before[:o] + r.after[: REACH - last])
                        full = len(r.before) >= last and len(r.after) >= REACH - o
                        rows.append((r.gram, r.context, o, core, xxhash.xxh3_128_digest(r.before[:last] + r.after[: REACH - o]) if full else None))
            yield pd.DataFrame(rows, columns=["gram", "context", "offset", "core", "cover"])

    return run


def _by_ranges(large: DataFrame) -> DataFrame:
    """The reaches of members of large groups. All windows of a range repeat if all the
    bytes they cover do; none does if their core is alone. What is neither is cut finer, if
    that can take a member with this core further than what is settled for it."""
    rows = large.withColumn("offsets", F.sequence(F.lit(0), F.lit(REACH), F.lit(RANGES[0])))
    settled: DataFrame | None = None
    for level, width in enumerate(RANGES):
        found = rows.select("gram", "context", "before", "after", "offsets").mapInPandas(_ranges(width), "gram long, context long, offset int, core binary, cover binary")
        found = stash(found, f"suffix-ranges{level}")
        both = stash(found.groupBy("gram", "offset", "core", "cover").agg(F.count("*").alias("n")), f"suffix-covers{level}")
        cores = stash(both.groupBy("gram", "offset", "core").agg(F.sum("n").alias("n")).where("n > 1").drop("n"), f"suffix-cores{level}")
        covers = both.where("n > 1 and cover is not null").select("gram", "offset", "cover", F.lit(True).alias("whole"))
        judged = found.join(cores, ["gram", "offset", "core"]).join(covers, ["gram", "offset", "cover"], "left")
        last = F.least(F.col("offset") + width - 1, F.lit(REACH))
        judged = stash(judged.select("gram", "context", "offset", last.alias("last"), "core", "cover", F.coalesce("whole", F.lit(False)).alias("whole")), f"suffix-judged{level}")
        new = judged.where("whole").groupBy("gram", "context").agg(F.max("last").alias("high"), F.min("offset").alias("low"))
        every = new if settled is None else settled.unionByName(new).groupBy("gram", "context").agg(F.max("high").alias("high"), F.min("low").alias("low"))
        settled = stash(every, f"suffix-settled{level}")
        if width == 1:
            break
        finer = RANGES[level + 1]
        open_ = judged.where("not whole").join(settled, ["gram", "context"], "left").where("high is null or offset > high or last < low")
        asked = stash(open_.groupBy("gram", "offset", "core").agg(F.lit(1).alias("asked")).drop("asked"), f"suffix-asked{level}")
        going = stash(judged.join(asked, ["gram", "offset", "core"]), f"suffix-going{level}")
        one = going.where("whole").groupBy("gram", "offset", "last", "cover").agg(F.min("context").alias("context"))  # partner of the open ones
        going = going.where("not whole").select("gram", "context", "offset", "last").unionByName(one.drop("cover"))
        offsets = going.groupBy("gram", "context").agg(F.flatten(F.collect_list(F.sequence("offset", "last", F.lit(finer)))).alias("offsets"))
        rows = large.join(stash(offsets, f"suffix-offsets{level}"), ["gram", "context"])
    return settled.select("gram", "context", F.col("high").cast("long").alias("before"), (F.lit(LENGTH) - F.col("low")).cast("long").alias("since"))


def repeated_reaches(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs: (doc_id, text, print). (doc_id, print, at, before, since): anchors through
    which repeated windows go, and how far these reach before and from the anchor on."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stash(docs.select("doc_id", "print", "text").mapInPandas(_anchor_rows, f"doc_id {kind}, print long, at int, gram long, context long"), "suffix-anchors")
    shared = stash(rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "suffix-grams")
    members = stash(rows.join(shared, "gram"), "suffix-members")
    contexts = stash(members.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "print", "at")).alias("one")), "suffix-contexts")
    whole = contexts.where("n > 1").select("gram", "context", F.lit(REACH).cast("long").alias("before"), F.lit(LENGTH).cast("long").alias("since"))

    sizes = stash(contexts.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1"), "suffix-sizes")
    asked = contexts.join(sizes, "gram").select(F.col("one.doc_id").alias("id_"), F.col("one.print").alias("print_"), F.struct("one.at", "gram", "context", "size").alias("w"))
    asked = stash(asked.groupBy("id_", "print_").agg(F.collect_list("w").alias("wanted")), "suffix-asked")
    found = docs.join(asked.hint("merge"), docs["doc_id"].eqNullSafe(asked["id_"]) & (docs["print"] == asked["print_"])).select("text", "wanted")
    cut = stash(found.mapInPandas(_cut, "gram long, context long, size long, before binary, after binary"), "suffix-cut")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = cut.where(F.col("size") <= group_rows).select("gram", "context", "before", "after")
    reached = small.repartition(parts, "gram").sortWithinPartitions("gram").mapInPandas(_order, "gram long, context long, before long, since long")
    every = whole.unionByName(reached)
    large = cut.where(F.col("size") > group_rows).select("gram", "context", "before", "after").dropDuplicates(["gram", "context"])
    if cut.where(F.col("size") > group_rows).limit(1).count():
        every = every.unionByName(_by_ranges(stash(large, "suffix-large")))
    every = stash(every.groupBy("gram", "context").agg(F.max("before").alias("before"), F.max("since").alias("since")), "suffix-reaches")
    return members.join(every, ["gram", "context"]).select("doc_id", "print", "at", "before", "since")


def kept_pieces(n: int, spans: list) -> list[tuple[int, int]]:
    """The maximal runs (start, end) of removed bytes; spans: (at, before, since)."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted((max(0, s["at"] - s["before"]), min(n, s["at"] + s["since"])) for s in spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def _finish(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, own in zip(texts, spans):
        raw = raw_bytes(text)
        runs = kept_pieces(len(raw), own) if own is not None else []
        digest, at = hashlib.sha256(), 0
        for a, b in runs:
            digest.update(memoryview(raw)[at:a])
            at = b
        digest.update(memoryview(raw)[at:])
        rows.append((len(raw), sum(b - a for a, b in runs), runs, digest.hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "spans", "kept_sha256"])


def deduplicate(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end of removed runs, in bytes) and
    kept_sha256 for each row of ``docs``."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    found = repeated_reaches(own, group_rows)
    spans = found.groupBy(F.col("doc_id").alias("id_"), F.col("print").alias("print_")).agg(F.collect_set(F.struct("at", "before", "since")).alias("spans"))
    spans = stash(spans, "suffix-spans")
    # rows that repeat id and text share one entry, in which each span stands once
    both = own.join(spans.hint("merge"), own["doc_id"].eqNullSafe(spans["id_"]) & (own["print"] == spans["print_"]), "left")
    finish = F.pandas_udf(_finish, "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    return both.select("doc_id", finish("text", "spans").alias("r")).select("doc_id", "r.*")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

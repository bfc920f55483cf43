"""Operator 12, MinHash near-dedup with odd sketches: links of similarity 0.85 or more over five-word shingles.

``SAMPLES`` MinHash samples of a set give ``BANDS`` keys of ``BAND_ROWS`` samples, and are folded into a
bitmap in which each sample flips one bit. Sets that share a key are candidates; the bits in which their
bitmaps differ are at most two for each sample that differs, so a count over ``MOST_BITS`` rules a pair
out. A second bitmap, in which each shingle flips a bit, differs in no more bits than the sets in
shingles, and rules out what is too different for its size without any loss; what is left is confirmed on
the full sets. A pair of similarity 0.85 shares no key with probability 6e-9 and is ruled out by
the first bitmap with less than 1e-9; nothing else is lost.

Only distinct sets meet. First every set of a bucket is tried with the least one. Buckets that
then hold several components are cut into cells: all but the largest component is compared,
bitmap by bitmap, with everything else of the bucket, a cell having at most two blocks of
``BLOCK_ROWS`` sets. Each set offers its nearest few in other components, then, where that left any out, all,
so that sets which differ from one another but not from a common original meet that one first.

Defined cases: null texts and texts without words have an empty set, which is linked with
nothing; fewer than five words are one shingle; equal sets and repeated rows are linked; null
ids name no component but one of null ids only, and such rows are kept; sets and shingles are
known by 64-bit hashes; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stash, table
from .components import components
from .near_dedup import SHINGLE, set_print, sets_of, shingles
from .rolling import mix

PERCENT = 85
BANDS, BAND_ROWS = 40, 6
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 1024
LOSS = 1e-9
BLOCK_ROWS = 4096
#: how many of the nearest sets of other components each set offers, round by round
WIDTHS = (4, None)
WHOLE_BITS = 2048
_PAIRS_AT_ONCE = 1 << 18


def _most_bits() -> int:
    """Twice the differing samples that a pair at the threshold exceeds with probability LOSS at most."""
    p, tail, k = 1 - PERCENT / 100, 0.0, SAMPLES
    while tail + (share := comb(SAMPLES, k) * p**k * (1 - p) ** (SAMPLES - k)) <= LOSS:
        tail, k = tail + share, k - 1
    return 2 * k


MOST_BITS = _most_bits()
_DRAWN = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
_FACTORS, _FLIPS = (_DRAWN[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_DRAWN[SAMPLES:] >> np.uint64(32)).astype(np.uint32)


def samples(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    short = (mix(found.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        part = short[at : at + 256]
        np.minimum(least, ((part[None, :] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    return least


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """For rows of samples, a hash of each band's samples and number."""
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sampled), 1))
    bands = sampled.reshape(len(sampled), BANDS, BAND_ROWS)
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return key.view(np.int64)


def _bitmaps(spots: np.ndarray, owners: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """For each owner the bits that an odd number of its spots falls on, as 64-bit words."""
    odd = np.bincount(owners * bits + spots.astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(rows, bits // 64)


def odd_sketch(sampled: np.ndarray) -> np.ndarray:
    """For rows of samples, the bitmap in which each sample flips a bit."""
    spots = mix(sampled.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return _bitmaps(spots.ravel(), np.repeat(np.arange(len(sampled)), SAMPLES), len(sampled), SKETCH_BITS)


def whole_sketch(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the bitmap in which each of its shingles flips a bit."""
    spots = mix(~np.concatenate([np.empty(0, np.int64), *sets]).view(np.uint64)) % np.uint64(WHOLE_BITS)
    return _bitmaps(spots, np.repeat(np.arange(len(sets)), [len(x) for x in sets]), len(sets), WHOLE_BITS)


def described(text: Column) -> Column:
    """A struct of the set's hash, its size, keys of its bands and its two bitmaps."""

    @F.pandas_udf("fp long, n long, bands array<long>, sketch array<long>, whole array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for at in range(0, len(texts), 256):
            sets = [shingles(x) for x in texts.iloc[at : at + 256]]
            sampled = np.stack([samples(x) if len(x) else np.zeros(SAMPLES, np.uint32) for x in sets])
            columns = {"fp": [set_print(x) for x in sets], "n": [len(x) for x in sets]}
            parts.append(pd.DataFrame(columns | {"bands": list(band_keys(sampled)), "sketch": list(odd_sketch(sampled)), "whole": list(whole_sketch(sets))}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["fp", "n", "bands", "sketch", "whole"])

    return made(text)


def _sizes_fit(one: Column, two: Column) -> Column:
    return F.least(one, two) * 100 >= F.greatest(one, two) * PERCENT


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out."""
    side = lambda k: sets.select(F.col("fp").alias(f"f{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"), F.col("whole").alias(f"w{k}"))
    one, two = side(1), side(2)
    joined = pairs.join(one.hint("merge"), pairs["a"] == one["f1"]).join(two.hint("merge"), pairs["b"] == two["f2"])
    differing = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return joined.where((differing("s1", "s2") <= MOST_BITS) & (differing("w1", "w2") * (100 + PERCENT) <= (F.col("n1") + F.col("n2")) * (100 - PERCENT))).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets have the similarity. sets: (fp, print); texts: (print, text)."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    wanted = stash(named.join(sets.hint("merge"), named["w"] == sets["fp"]).select("fp", "print"), "odd-wanted")
    full = sets_of(texts, wanted)
    one, two = full.select(F.col("fp").alias("fa"), F.col("shingles").alias("sa")), full.select(F.col("fp").alias("fb"), F.col("shingles").alias("sb"))

    @F.pandas_udf("boolean")
    def close(sa: pd.Series, sb: pd.Series) -> pd.Series:
        shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sa, sb)], np.int64)
        return pd.Series(100 * shared >= PERCENT * (sa.map(len).to_numpy(np.int64) + sb.map(len).to_numpy(np.int64) - shared))

    joined = pairs.join(one.hint("merge"), pairs["a"] == one["fa"]).drop("fa")
    joined = joined.join(two.hint("merge"), joined["b"] == two["fb"]).drop("fb")
    found = stash(joined.where(close("sa", "sb")).select("a", "b"), "odd-links")
    release(wanted, full)
    return found


def cell_pairs(rows: pd.DataFrame, width: int | None) -> Iterator[pd.DataFrame]:
    """rows of whole cells: (key, cell, fp, n, label, sketch, whole, offers, taken). Pairs (a, b) of each set that
    offers with the ``width`` nearest of those in its cell that can be taken, are of another component and
    are not ruled out; ``cut`` where there are more. Pairs are looked at in blocks of bounded size."""
    cell = rows.groupby(["key", "cell"], sort=False).ngroup().to_numpy()
    fp, n, label = (rows[c].to_numpy(np.int64) for c in ("fp", "n", "label"))
    sketch, whole = (np.stack(rows[c].to_numpy()).view(np.uint64) for c in ("sketch", "whole"))
    left, right = (np.flatnonzero(rows[c].to_numpy(bool)) for c in ("offers", "taken"))
    left, right = left[np.argsort(cell[left], kind="stable")], right[np.lexsort((fp[right], cell[right]))]
    first, last = (np.searchsorted(cell[right], cell[left], side) for side in ("left", "right"))
    block = np.cumsum(last - first) // _PAIRS_AT_ONCE
    for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(block)) + 1):
        times = (last - first)[part]
        a = np.repeat(left[part], times)
        b = right[np.arange(len(a)) + np.repeat(first[part] - (np.cumsum(times) - times), times)]
        fits = (label[a] != label[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * PERCENT)
        a, b = a[fits], b[fits]
        bits = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        close = bits <= MOST_BITS
        a, b, bits = a[close], b[close], bits[close]
        apart = np.bitwise_count(whole[a] ^ whole[b]).sum(axis=1, dtype=np.int64)
        close = apart * (100 + PERCENT) <= (n[a] + n[b]) * (100 - PERCENT)
        a, b, bits = a[close], b[close], bits[close]
        order = np.lexsort((fp[b], bits, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        rank = np.arange(len(a)) - np.repeat(starts, np.diff(starts, append=len(a)))
        kept = rank < (len(a) if width is None else width)
        more = np.isin(a, a[~kept])
        yield pd.DataFrame({"a": np.maximum(fp[a], fp[b])[kept], "b": np.minimum(fp[a], fp[b])[kept], "cut": more[kept]})


def _cells(width: int | None):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches sorted by (key, cell); a cell may run over several batches."""
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows["key"] == rows["key"].iloc[-1]) & (rows["cell"] == rows["cell"].iloc[-1])
            held = rows[last]
            if not last.all():
                yield from cell_pairs(rows[~last], width)
        if held is not None and len(held):
            yield from cell_pairs(held, width)

    return made


def cells(members: DataFrame, labels: DataFrame, sets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """members: (key, fp). The members of buckets that hold several components, dealt into cells: sets outside
    the bucket's largest component offer, in blocks, to each block of that component and to each other block."""
    named = members.join(labels.hint("merge"), members["fp"] == labels["node"], "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    named = stash(named, "odd-named")
    counts = named.groupBy("key", "label").agg(F.count("*").alias("rows"))
    largest = F.max(F.struct("rows", F.col("label").alias("main")))
    buckets = counts.groupBy("key").agg(largest.alias("top"), F.sum("rows").alias("all")).where(F.col("all") > F.col("top")["rows"])
    blocks = lambda rows: F.ceil(rows / block_rows).cast("int")
    buckets = buckets.select(F.col("key").alias("k"), F.col("top")["main"].alias("main"), blocks(F.col("top")["rows"]).alias("main_blocks"), blocks(F.col("all") - F.col("top")["rows"]).alias("blocks"))
    open_ = stash(named.join(buckets.hint("merge"), named["key"] == buckets["k"]).drop("k"), "odd-open")
    open_ = open_.join(sets.select(F.col("fp").alias("f"), "n", "sketch", "whole").hint("merge"), F.col("fp") == F.col("f")).drop("f")
    deal = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    to = lambda i, j, offers, taken: F.struct((i.cast("long") * (1 << 32) + j).alias("cell"), F.lit(offers).alias("offers"), F.lit(taken).alias("taken"))
    each = lambda n, entry: F.transform(F.sequence(F.lit(0), n - 1), entry)
    # cell (i, j): block i of the others against block j >= i of the others; the blocks of the largest component are numbered from -1 down
    mine = deal(F.col("blocks"))
    main = each(F.col("blocks"), lambda i: to(i, -1 - deal(F.col("main_blocks")), False, True))
    with_main = each(F.col("main_blocks"), lambda j: to(mine, -1 - j, True, False))
    among = each(F.col("blocks"), lambda j: F.when(j < mine, to(j, mine, False, True)).otherwise(to(mine, j, True, j == mine)))
    dealt = F.when(F.col("label") == F.col("main"), main).otherwise(F.concat(with_main, among))
    return open_.select("key", F.explode(dealt).alias("e"), "fp", "n", "label", "sketch", "whole").select("key", "e.*", "fp", "n", "label", "sketch", "whole")


def links(sets: DataFrame, texts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """sets: distinct (fp, n, bands, sketch, whole, print) without the empty one; texts: (print, text).
    Edges (a, b) with the same components as all pairs of sets with the similarity."""
    entries = sets.select(F.explode("bands").alias("key"), "fp", "n")
    buckets = entries.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.struct("fp", "n")).alias("least")).where("rows > 1")
    buckets = stash(buckets.select(F.col("key").alias("k"), F.col("least")["fp"].alias("least"), F.col("least")["n"].alias("least_n")), "odd-buckets")
    members = stash(entries.join(buckets.hint("merge"), entries["key"] == buckets["k"]).drop("k"), "odd-members")
    stars = members.where((F.col("fp") != F.col("least")) & _sizes_fit(F.col("n"), F.col("least_n"))).select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    near = stash(_near(stars, sets), "odd-stars")
    found = confirmed(near, sets, texts)
    members = members.select("key", "fp")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for width in WIDTHS:
        labels = stash(components(found), "odd-round")
        dealt = cells(members, labels, sets, block_rows).repartition(parts, "key", "cell").sortWithinPartitions("key", "cell")
        tried = dealt.mapInPandas(_cells(width), "a long, b long, cut boolean").groupBy("a", "b").agg(F.max("cut").alias("cut"))
        tried = stash(tried, "odd-tried")
        if not tried.limit(1).count():
            break
        found = stash(found.unionByName(confirmed(tried.select("a", "b"), sets, texts)).distinct(), "odd-found")
        if not tried.where("cut").limit(1).count():
            break
    return found


def group(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    made = docs.select("doc_id", F.xxhash64("text").alias("print"), described(F.col("text")).alias("s"))
    rows = stash(made.select("doc_id", "print", "s.*"), "odd-rows")
    firsts = [F.any_value(c).alias(c) for c in ("n", "bands", "sketch", "whole", "print")]
    sets = stash(rows.where("n > 0").groupBy("fp").agg(*firsts, F.min("doc_id").alias("least")), "odd-sets")
    texts = docs.select(F.xxhash64("text").alias("print"), "text")
    labels = stash(components(links(sets, texts)), "odd-labels")
    named = sets.select("fp", "least").join(labels.hint("merge"), sets["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = stash(named, "odd-components")
    tops = named.groupBy("label").agg(F.min("least").alias("top"))
    ids = stash(named.join(tops, "label").select(F.col("fp").alias("f"), "top"), "odd-ids")
    joined = rows.select("doc_id", "fp", "n").join(ids, F.col("fp") == F.col("f"), "left")
    top = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("top"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), top.alias("component_id"), F.col("doc_id").eqNullSafe(top).alias("kept"))


def op12_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


#: the sets themselves, joined on every shingle
OP12_SQL = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT r, md5(array_to_string(w[i : i + {SHINGLE - 1}], ' ')) AS gram
  FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n, md5(string_agg(gram, ',' ORDER BY gram)) AS fp FROM grams GROUP BY r),
sets AS MATERIALIZED (SELECT fp, min(r) AS r, any_value(n) AS n FROM sizes GROUP BY fp),
named AS MATERIALIZED (SELECT r, gram FROM grams JOIN sets USING (r)),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM named a JOIN named b ON a.gram = b.gram AND a.r < b.r GROUP BY ALL),
near AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sets x ON a = x.r JOIN sets y ON b = y.r WHERE 100 * shared.n >= {PERCENT} * (x.n + y.n - shared.n)),
edges AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
tops AS (SELECT s.fp, min(w.doc_id) AS top FROM sets s JOIN reach ON s.r = reach.a JOIN sets t ON reach.b = t.r JOIN sizes z ON z.fp = t.fp JOIN words w ON w.r = z.r GROUP BY s.fp)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE top END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE top END AS kept
FROM words LEFT JOIN sizes USING (r) LEFT JOIN tops USING (fp)
"""

"""Near copies for the pipeline: SimHash first, then all pairs of similarity 0.8 exactly.

Similarity is that of Jaccard over five-word shingles. The SimHash of a text's shingles
goes through the covering tables of ``simhash``; pairs that meet there within its radius and have the
similarity are linked at once. Pairs at 0.8 differ in about 10 of 64 bits, which no covering
table of a bearable number reaches, so the rest is found by prefixes. The shingles of all texts have one
order, frequent ones last. If two sets of a and b shingles share 0.8 of their union, the
first of the shared ones is among the first a - ceil(0.8 a) + 1 of the one and the first
b - ceil(0.8 b) + 1 of the other, so only such prefixes are joined, and every pair of
similarity 0.8 meets. Any order loses nothing; the frequent shingles are found in a
sample of texts, so that few texts meet by chance.

Texts that meet in a prefix are compared with one of their bucket, first the least one and then, round
by round, the one that has most links, the next one and so on, as long as that links many; then those of a bucket
that are still in different components are compared with each other. Sizes,
places and profiles (how many shingles have each of 64 to 2048 hashed values, so that the sum
of the lesser counts bounds what two sets share) rule out most pairs, and for the last ones already where they
meet: there, parities of such counts bound what they do not share. The others are settled by the
sets themselves, which are made again for the texts that are in any such pair only. Shingles that have the same texts in
their buckets are one bucket.

Defined cases: words are as in SimHash (lower case in ASCII); fewer than five words are
one shingle; texts with equal sets, null and empty ones among them, are copies; sets and
shingles are known by 64-bit hashes. Of a component the row of the least id stays (null
last, then least text); rows that repeat both id and text are one.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .common import free_name, release, stash, text_key
from .components import components

SHINGLE = 5
SEED = 43
#: similarity as a fraction, for exact comparisons in whole numbers
NUMERATOR, DENOMINATOR = 4, 5
SAMPLE_ROWS = 10_000
SAMPLE_PART = 16
FREQUENT_IN = 3
FREQUENT = 200_000
_FILTER_WORDS = 1 << 18
_LEAST_PROFILE, _MOST_PROFILE = 64, 2048
_PARITY_WORDS = 16
#: texts that are named by a broadcast table of that many hashes at most, more by a bit table
BROADCAST_ROWS = 200_000
#: rounds of one against all of a bucket end when the pairs that are left are no more than this times the rows
PAIRS_PER_ROW = 1
MOST_ROUNDS = 24


def shingles(text: str | None) -> np.ndarray:
    """The hashes of the distinct shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(SHINGLE, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    return np.unique(hashes.view(np.int64))


def set_print(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


def _sets(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x) for x in texts], dtype=object)

    return made(text)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles that several texts of a sample hold, ascending; at most FREQUENT."""
    part = max(1, min(SAMPLE_PART, docs.count() // SAMPLE_ROWS))
    text = F.coalesce("text", F.lit(""))
    sample = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
    counted = sample.select(F.explode(_sets(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    most = counted.where(F.col("n") >= FREQUENT_IN).orderBy(F.col("n").desc(), "h").limit(FREQUENT)
    return np.sort(most.toPandas()["h"].to_numpy(np.int64))


def profile(found: np.ndarray) -> np.ndarray:
    """How many of the shingles have each value of their lowest bits; more values for larger sets."""
    values = min(max(1 << (len(found) // 4).bit_length(), _LEAST_PROFILE), _MOST_PROFILE)
    return np.bincount(found.view(np.uint64) & np.uint64(values - 1), minlength=values).astype(np.int32)


def parities(found: np.ndarray) -> np.ndarray:
    """Whether the shingles with each value of their lowest ten bits are odd in number, as 16 words of 64 bits."""
    odd = np.bincount(found.view(np.uint64) & np.uint64(64 * _PARITY_WORDS - 1), minlength=64 * _PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """A bound on the shingles that two sets with these profiles share."""
    values = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, values).sum(axis=0), y.reshape(-1, values).sum(axis=0)).sum())


def prefixes(text: Column, frequent: np.ndarray, spark) -> Column:
    """A struct of the set's hash, its size, its prefix in the common order, profile, parities and SimHash."""
    shared = spark.sparkContext.broadcast(frequent)

    @F.pandas_udf("fp long, size int, prefix array<long>, profile array<int>, parity array<long>, sim long")
    def made(texts: pd.Series) -> pd.DataFrame:
        late, rows = shared.value, []
        for x in texts:
            found = shingles(x)
            at = np.searchsorted(late, found)
            is_late = np.zeros(len(found), bool)
            inside = at < len(late)
            is_late[inside] = late[at[inside]] == found[inside]
            ordered = np.concatenate((found[~is_late], found[is_late]))
            sim = int(np.uint64(simhash.majority(found.view(np.uint64))).astype(np.int64))
            rows.append((set_print(found), len(found), ordered[: prefix_length(len(found))], profile(found), parities(found), sim))
        out = pd.DataFrame(rows, columns=["fp", "size", "prefix", "profile", "parity", "sim"])
        return out.astype({"prefix": object, "profile": object, "parity": object})

    return made(text)


def _packed(size: str, at: str) -> Column:
    """Size and place of a shingle in one number."""
    return F.shiftleft(F.col(size).cast("long"), 32) + F.col(at)


def meets(sets: DataFrame) -> DataFrame:
    """sets: (fp, size, prefix). Distinct (h, fp, size, at, first, first_size, first_at): the
    members of each shingle that is in two prefixes or more, with the least of them. Of the shingles that have the
    same members, as those of a passage have, only the first in the common order stays: it is the first of them
    for every pair, and no later place leaves more pairs possible."""
    entries = sets.select("fp", "size", F.posexplode("prefix").alias("at", "h")).select("h", "fp", _packed("size", "at").alias("spot"))
    bucket = W.partitionBy("h")
    both = entries.select("h", "fp", "spot", F.min(F.struct("fp", "spot")).over(bucket).alias("least"), F.max("fp").over(bucket).alias("most"))
    both = both.where(F.col("least")["fp"] < F.col("most")).select("h", "fp", "spot", F.col("least")["fp"].alias("first"), F.col("least")["spot"].alias("first_spot")).distinct()
    members = [F.bit_xor(F.xxhash64("fp", F.lit(k))).over(bucket).alias(f"members{k}") for k in range(2)]
    least = F.min(F.struct("spot", "h", "first", "first_spot")).alias("row")
    both = both.select("*", *members).groupBy("members0", "members1", "fp").agg(least).select("fp", "row.*")
    size, place = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return both.select("h", "fp", size("spot").alias("size"), place("spot").alias("at"), "first", size("first_spot").alias("first_size"), place("first_spot").alias("first_at"))


def possible(size: str, at: str, other_size: str, other_at: str) -> Column:
    """False only if sets that share no shingle before these places cannot be similar enough:
    they need at least n shared shingles, where n / (a + b - n) is the similarity."""
    a, b = F.col(size), F.col(other_size)
    shared = F.least(a - F.col(at), b - F.col(other_at))
    return (shared * (NUMERATOR + DENOMINATOR) >= (a + b) * NUMERATOR) & (F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR)


def near_parities(size: str, parity: str, other_size: str, other_parity: str) -> Column:
    """False only if the sets cannot be similar enough: each odd place of one of them alone is a shingle
    at least that they do not share, and those are no more than a ninth of both."""
    apart = sum(F.bit_count(F.col(parity)[k].bitwiseXOR(F.col(other_parity)[k])) for k in range(_PARITY_WORDS))
    return apart * (NUMERATOR + DENOMINATOR) <= (F.col(size) + F.col(other_size)) * (DENOMINATOR - NUMERATOR)


def alike(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose profiles leave the similarity possible."""
    one, two = profiles.select(F.col("fp").alias("fa"), F.col("profile").alias("pa")), profiles.select(F.col("fp").alias("fb"), F.col("profile").alias("pb"))

    @F.pandas_udf("boolean")
    def near(pa: pd.Series, pb: pd.Series) -> pd.Series:
        return pd.Series([(NUMERATOR + DENOMINATOR) * most_shared(x, y) >= NUMERATOR * int(x.sum() + y.sum()) for x, y in zip(pa, pb)], dtype=bool)

    joined = pairs.join(one.hint("merge"), pairs["a"] == one["fa"]).drop("fa")
    joined = joined.join(two.hint("merge"), joined["b"] == two["fb"]).drop("fb")
    return joined.where(near("pa", "pb")).select("a", "b")


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts: (print, text), wanted: distinct (fp, print). (fp, shingles) of the wanted: their
    sets, made again. Few wanted texts are named by a broadcast table; for more, a bit table of
    bounded size lets few others through. The join drops those."""
    table = None
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(wanted.select("print")), "print", "left_semi")
    else:
        spot = F.pmod("print", F.lit(_FILTER_WORDS * 64))
        words = wanted.groupBy((spot / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(print, 64) as int))")).alias("bits")).toPandas()
        table = np.zeros(_FILTER_WORDS, np.int64)
        table[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = None if table is None else texts.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def make(batches):
        for batch in batches:
            chosen = batch["text"]
            if shared is not None:
                at = np.mod(batch["print"].to_numpy(np.int64), _FILTER_WORDS * 64).astype(np.uint64)
                chosen = chosen[((shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)]
            found = [shingles(x) for x in chosen]
            yield pd.DataFrame({"fp": np.array([set_print(x) for x in found], np.int64), "shingles": pd.Series(found, dtype=object)})

    some = stash(texts.mapInPandas(make, "fp long, shingles array<long>"), "near-some")
    w = wanted.select(F.col("fp").alias("w"))
    sets = stash(some.join(w.hint("merge"), some["fp"] == w["w"]).groupBy("fp").agg(F.first("shingles").alias("shingles")), "near-sets")
    release(some)
    return sets


def similar(pairs: DataFrame, profiles: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have the similarity."""
    pairs = stash(alike(pairs, profiles), "near-pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    wanted = stash(named.join(profiles.hint("merge"), named["w"] == profiles["fp"]).select("fp", "print"), "near-wanted")
    sets = sets_of(texts, wanted)
    one, two = sets.select(F.col("fp").alias("fa"), F.col("shingles").alias("sa")), sets.select(F.col("fp").alias("fb"), F.col("shingles").alias("sb"))

    @F.pandas_udf("boolean")
    def close(sa: pd.Series, sb: pd.Series) -> pd.Series:
        shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sa, sb)], np.int64)
        return pd.Series(DENOMINATOR * shared >= NUMERATOR * (sa.map(len).to_numpy(np.int64) + sb.map(len).to_numpy(np.int64) - shared))

    joined = pairs.join(one.hint("merge"), pairs["a"] == one["fa"]).drop("fa")
    joined = joined.join(two.hint("merge"), joined["b"] == two["fb"]).drop("fb")
    found = stash(joined.where(close("sa", "sb")).select("a", "b"), "near-links")
    release(pairs, wanted, sets)
    return found


def by_simhash(sets: DataFrame) -> DataFrame:
    """sets: (fp, sim). Candidate pairs (a, b): sets of one SimHash with the least of them, and
    the least ones of SimHashes that a covering table brings together within the radius."""
    prints = stash(sets.groupBy("sim").agg(F.min("fp").alias("least")), "near-prints")
    met = stash(simhash.links(prints.select(F.col("sim").alias("fp"))), "near-covered")
    one, two = prints.select(F.col("sim").alias("s1"), F.col("least").alias("a")), prints.select(F.col("sim").alias("s2"), F.col("least").alias("b"))
    across = met.join(one.hint("merge"), met["a"] == one["s1"]).drop(met["a"]).join(two.hint("merge"), met["b"] == two["s2"]).select(one["a"].alias("a"), two["b"].alias("b"))
    inside = sets.select("sim", F.col("fp").alias("a")).join(prints.hint("merge"), "sim").where("a <> least").select("a", F.col("least").alias("b"))
    return stash(across.unionByName(inside).distinct(), "near-simhash")


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """sets: (fp, size, prefix, profile, parity, sim, print), any row of it repeated; texts: (print, text).
    Edges (a, b) with the same components as all pairs of sets with the similarity."""
    profiles = stash(sets.groupBy("fp").agg(F.any_value("profile").alias("profile"), F.any_value("parity").alias("parity"), F.any_value("sim").alias("sim"), F.any_value("print").alias("print")), "near-profiles")
    members = stash(meets(sets.select("fp", "size", "prefix")), "near-members")
    close = by_simhash(profiles.select("fp", "sim"))
    stars = members.where("fp <> first").where(possible("size", "at", "first_size", "first_at"))
    stars = stars.select(F.col("fp").alias("a"), F.col("first").alias("b")).unionByName(close)
    stars = stash(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-stars")
    found = similar(stars, profiles, texts)

    tested = stars
    bucket = W.partitionBy("h")
    for round_ in range(MOST_ROUNDS):
        labels = stash(components(found), "near-round")
        named = members.select("h", "fp", "size", "at").join(labels.hint("merge"), members["fp"] == labels["node"], "left")
        named = named.select("h", "fp", "size", "at", F.coalesce("label", "fp").alias("label"))
        spread = named.select("*", F.min("label").over(bucket).alias("low"), F.max("label").over(bucket).alias("high")).where("low < high").drop("low", "high")
        apart = stash(spread, "near-apart")
        release(members)
        members = apart
        counts = apart.groupBy("h", "label").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
        left = counts.agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("n") - F.col("within")) / 2).alias("pairs")).first()
        if not left["rows"]:
            return found
        if left["pairs"] <= PAIRS_PER_ROW * left["rows"]:
            break
        # the member of each bucket that has most links, in every round the next one
        degrees = stash(found.select(F.explode(F.array("a", "b")).alias("d")).groupBy("d").agg(F.count("*").alias("degree")), "near-degrees")
        linked = apart.join(degrees.hint("merge"), apart["fp"] == degrees["d"], "left").drop("d").withColumn("degree", F.coalesce("degree", F.lit(0)))
        rank = F.row_number().over(bucket.orderBy(F.col("degree").desc(), F.xxhash64("fp"), "fp"))
        ranked = linked.withColumn("rank", rank)
        mid = F.max(F.when(F.col("rank") == round_ + 1, F.struct("fp", "size", "at", "label"))).over(bucket)
        pairs = ranked.withColumn("mid", mid).where(F.col("label") != F.col("mid")["label"])
        pairs = pairs.select("fp", "size", "at", F.col("mid")["fp"].alias("b"), F.col("mid")["size"].alias("size2"), F.col("mid")["at"].alias("at2")).where(possible("size", "at", "size2", "at2"))
        pairs = pairs.select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b")).distinct()
        pairs = stash(pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"), "near-stars")
        linked = similar(pairs, profiles, texts)
        n_pairs, n_links = pairs.count(), linked.count()
        tested = stash(tested.unionByName(pairs), "near-tested")
        found = stash(found.unionByName(linked), "near-found")
        if n_links * 50 < n_pairs or not n_pairs:
            break
    labels = stash(components(found), "near-round")
    named = members.select("h", "fp", "size", "at").join(labels.hint("merge"), members["fp"] == labels["node"], "left")
    named = named.select("h", F.col("fp").alias("f"), "size", "at", F.coalesce("label", "fp").alias("label"))
    parity = profiles.select("fp", "parity")
    apart = stash(named.join(parity.hint("merge"), named["f"] == parity["fp"]).select("h", "fp", "size", "at", "label", "parity"), "near-apart")
    other = apart.select(F.col("h").alias("h2"), F.col("fp").alias("b"), F.col("size").alias("size2"), F.col("at").alias("at2"), F.col("label").alias("label2"), F.col("parity").alias("parity2"))
    near = possible("size", "at", "size2", "at2") & near_parities("size", "parity", "size2", "parity2")
    crossed = apart.join(other.hint("merge"), (apart["h"] == other["h2"]) & (F.col("fp") > F.col("b")) & (F.col("label") != F.col("label2")) & near)
    crossed = crossed.select(F.col("fp").alias("a"), "b").distinct()
    crossed = stash(crossed.join(tested.hint("merge"), ["a", "b"], "left_anti"), "near-crossed")
    release(apart, members)
    return found.unionByName(similar(crossed, profiles, texts)) if crossed.limit(1).count() else found


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies."""
    spark = docs.sparkSession
    frequent = frequent_shingles(docs)
    made = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.xxhash64("text").alias("print"), prefixes(F.col("text"), frequent, spark).alias("s")).select("doc_id", "key", "print", "s.*")
    rows = stash(made, "near-rows")
    labels = stash(components(links(rows, docs.select(F.xxhash64("text").alias("print"), "text"))), "near-labels")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    named = rows.select("doc_id", "key", "fp").join(labels.hint("merge"), F.col("fp") == F.col("node"), "left")
    tops = named.groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min(place).alias("top"))
    name, key, count = free_name(docs, "kept_id"), free_name(docs, "kept_key"), free_name(docs, "kept_rows")
    repeats = rows.groupBy("doc_id", "key").agg(F.count("*").alias(count))
    tops = tops.select(F.col("top")["doc_id"].alias(name), F.col("top")["key"].alias(key))
    same = tops[name].eqNullSafe(repeats["doc_id"]) & (tops[key] == repeats["key"])
    keep = stash(tops.join(repeats.hint("merge"), same).select(name, key, count), "near-keep")
    kept = docs.join(keep.hint("merge"), docs["doc_id"].eqNullSafe(keep[name]) & (text_key(docs["text"]) == keep[key]))
    single = kept.where(F.col(count) == 1)
    if keep.where(F.col(count) > 1).limit(1).count():
        single = single.unionByName(kept.where(F.col(count) > 1).dropDuplicates([name, key]))
    return single.drop(name, key, count)

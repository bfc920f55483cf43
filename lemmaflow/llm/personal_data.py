"""Operator 5, personal data: base patterns and bootstrapped contextual extraction, in SQL functions only.

The base matches seed the bootstrap. Every identifier-like token (one with four digits or an
at-sign) is an instance. Its lexical patterns are the words around it, digits and punctuation
folded: one, two and three before it, one and two after it, and one on both sides. Spark scores
the graph of patterns and instances in rounds: a pattern is as sure as the mean of its distinct
instances, held down while it has few; an instance that no seed names is as sure as its best
pattern if that reaches ``LEAST_SCORE``. Instances that a pattern of that score names in the end
give extra spans of kind ``context`` where they do not touch a base span.

Defined cases: null and empty texts have no span; a token without words around it has no
pattern and is only found by the base patterns; equal texts enter the graph once, so
copies add no weight; repeated rows and null ids each give a row; long texts are read
whole, in time in proportion to their length; with no seed at all no pattern is sure and nothing is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, table, text_key
from .spans import by_kind, joined, labelled, let, no_spans, spans

ROUNDS = 3
LEAST_SCORE = 0.6
LEAST_INSTANCES = 3  # a pattern with fewer distinct instances is held down by smoothing

#: fixed base patterns. "(?:(?<![..])|\G)" starts a search only at the start of a run
#: or where the last match ended, the only places a leftmost match can start, which
#: keeps long runs linear; the possessive repeats give back nothing that could help.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a text of digits passes the Luhn check."""
    doubled = F.split(F.lit("0,2,4,6,8,1,3,5,7,9"), ",")

    def value(d: Column, i: Column) -> Column:
        plain = d.cast("int")
        return F.when(i % 2 == 1, F.element_at(doubled, plain + 1).cast("int")).otherwise(plain)

    figures = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), value)
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base matches of each kind as arrays of (start, end, found)."""
    has_digit = F.regexp_like(text, F.lit("[0-9]"))
    count = lambda x: F.length(_digits(x["found"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(no_spans()),
        "ip": F.when(has_digit, F.filter(spans(text, IP), lambda x: F.regexp_like(x["found"], F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")))).otherwise(no_spans()),
        "card": F.when(has_digit, F.filter(spans(text, CARD), lambda x: (count(x) >= 16) & (count(x) <= 19) & luhn(_digits(x["found"])))).otherwise(no_spans()),
        "phone": F.when(has_digit & F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), lambda x: (count(x) >= 8) & (count(x) <= 15))).otherwise(no_spans()),
    }


def context_tokens(text: Column) -> Column:
    """Identifier-like tokens with the patterns around them: (start, end, instance, patterns)."""
    kind = "array<struct<start:bigint,end:bigint,instance:string,patterns:array<string>>>"
    four = r"(?:[0-9][^0-9\x20\x09-\x0D]*+){4}|@"

    def fold(x: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(x["found"], "[0-9]+", "0"), r"[^\p{L}0:=@#]", ""))

    def of_words(words: Column) -> Column:
        def of_folded(folded: Column) -> Column:
            def row(i: Column) -> Column:
                own = F.get(words, i)
                after = F.regexp_replace(own["found"], "^[^A-Za-z0-9]++", "")
                bare = F.regexp_replace(after, r"(?<=[A-Za-z0-9])[^A-Za-z0-9]++\z", "")
                start = own["end"] - F.length(after)
                near = {k: F.nullif(F.get(folded, i + k), F.lit("")) for k in (-3, -2, -1, 1, 2)}
                patterns = [F.concat(F.lit("< "), near[-1]), F.concat(F.lit("<< "), near[-2], F.lit(" "), near[-1]), F.concat(F.lit("<<< "), near[-3], F.lit(" "), near[-2], F.lit(" "), near[-1])]
                patterns += [F.concat(F.lit("> "), near[1]), F.concat(F.lit(">> "), near[1], F.lit(" "), near[2]), F.concat(F.lit("<> "), near[-1], F.lit(" "), near[1])]
                return F.struct(start.alias("start"), (start + F.length(bare)).alias("end"), F.lower(bare).alias("instance"), F.array_compact(F.array(*patterns)).alias("patterns"))

            places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.regexp_like(F.get(words, i)["found"], F.lit(four)))
            return F.filter(F.transform(places, row), lambda x: (F.length(x["instance"]) >= 6) & (F.size(x["patterns"]) > 0))

        return F.when(F.size(words) > 0, let(F.transform(words, fold), of_folded)).otherwise(F.array().cast(kind))

    return F.when(F.regexp_like(text, F.lit(four)), let(spans(text, _TOKEN), of_words)).otherwise(F.array().cast(kind))


def judged_tokens(once: DataFrame) -> DataFrame:
    """once: (key, tokens, and the base spans of each kind). (key, t, seed): the tokens, and
    whether each touches a base span, by the furthest end of those that start before its own end."""
    base = once.select("key", F.explode(F.concat(*[F.transform(k, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"))) for k in KINDS])).alias("b"))
    tokens = once.select("key", F.explode("tokens").alias("t"))
    none = F.lit(None).cast(tokens.schema["t"].dataType)
    both = tokens.select("key", F.col("t.end").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("reach"), "t")
    both = both.unionByName(base.select("key", F.col("b.s").alias("pos"), F.lit(1).alias("kind"), F.col("b.e").alias("reach"), none.alias("t")))
    before = W.partitionBy("key").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("furthest", F.max("reach").over(before)).where("kind = 0")
    return both.select("key", "t", F.coalesce(F.col("furthest") > F.col("t.start"), F.lit(False)).alias("seed"))


def pattern_scores(edges: DataFrame) -> DataFrame:
    """edges: distinct (pattern, instance, seed). Returns (pattern, score) after ROUNDS rounds."""
    sure = edges.select("instance", F.col("seed").cast("double").alias("sure")).groupBy("instance").agg(F.max("sure").alias("sure"))
    seeds = stash(sure, "pii-sure0")
    sure = seeds
    for k in range(ROUNDS):
        scored = edges.join(sure, "instance").groupBy("pattern").agg((F.sum("sure") / (F.count("*") + LEAST_INSTANCES - 1)).alias("score"))
        scored = stash(scored, f"pii-patterns{k}")
        if k + 1 < ROUNDS:
            best = edges.join(scored, "pattern").groupBy("instance").agg(F.max("score").alias("best"))
            sure = stash(seeds.join(best, "instance").select("instance", F.greatest("sure", F.when(F.col("best") >= LEAST_SCORE, F.col("best")).otherwise(0.0)).alias("sure")), f"pii-sure{k + 1}")
    return scored


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, an array column of labelled spans for each base kind, and one for ``context``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", text_key(F.col("text")))
    base = [labelled(kind, n, found).alias(kind) for n, (kind, found) in enumerate(base_spans(F.col("text")).items())]
    every = stash(rows.select("doc_id", "key", *base, context_tokens(F.col("text")).alias("tokens")), "pii-rows")

    once = every.where(F.size("tokens") > 0).groupBy("key").agg(*[F.any_value(c).alias(c) for c in (*KINDS, "tokens")])
    tokens = stash(judged_tokens(stash(once, "pii-once")).select("key", "t.*", "seed"), "pii-tokens")
    named = tokens.select("key", "start", "end", "instance", "seed", F.explode("patterns").alias("pattern"))
    edges = stash(named.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    good = stash(pattern_scores(edges).where(F.col("score") >= LEAST_SCORE).select(F.col("pattern").alias("p")), "pii-good")
    fresh = named.where(~F.col("seed"))
    sure = stash(fresh.join(good.hint("merge"), fresh["pattern"] == good["p"]).select(F.col("instance").alias("i")).distinct(), "pii-found")
    others = tokens.where(~F.col("seed")).select("key", "start", "end", "instance")
    added = others.join(sure.hint("merge"), others["instance"] == sure["i"]).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("more"))
    added = stash(added.select(F.col("key").alias("k"), "more"), "pii-added")
    out = every.join(added.hint("merge"), every["key"] == added["k"], "left")
    more = F.coalesce(F.col("more"), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return out.select("doc_id", *KINDS, labelled("context", len(KINDS), F.array_sort(more)).alias("context"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    base = by_kind([F.col(k) for k in KINDS])
    every = by_kind([F.col(k) for k in (*KINDS, "context")])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))

"""Operator 4, secret scan with a trigram inverted index, in SQL functions only.

Every rule's regular expression is turned into a Boolean trigram query: a list of
alternatives, each a set of trigrams that any match must contain in lower case. One pass over
the texts, with an expression that steps through the queries' trigrams as a tree, gives an
inverted index that maps each of these trigrams to the texts that hold it; it can be kept, and
``candidates`` takes one again for any rules whose trigrams it covers. Intersecting the postings of an alternative gives its candidates, and
only these are verified with the expression. A rule without a mandatory trigram scans
all texts. Rules differ only in how few texts they read, never in what they find.

Defined cases: null and empty texts have no span; equal texts share one entry of the
index and get equal results; repeated rows and null ids each give a row; a text of any
length is scanned whole; a rule that has more than 16 alternatives scans all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, text_key
from .spans import by_start, joined, labelled, no_spans, spans

_MOST_ALTERNATIVES = 16


@dataclass(frozen=True)
class Rule:
    """kind, expression; a match is dropped unless group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: fixed patterns of the base kinds. A run of hex digits of 24 or more is the longest
#: run from its first digit, and a key shorter than 20 has no longer one inside, so
#: these two lengths are part of the expression; that of an assignment is not.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: fixed patterns of further kinds
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _strings(tree) -> list[list[str]]:
    """For each alternative of an expression, literal strings that a match must contain."""
    paths: list[list[str]] = [[""]]
    for op, arg in tree:
        if op is sre.LITERAL:
            options = [[chr(arg)]]
        elif op is sre.SUBPATTERN:
            options = _strings(arg[3])
        elif op is sre.BRANCH:
            options = [path for branch in arg[1] for path in _strings(branch)]
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            inner = _strings(arg[2])
            options = inner if arg[0] == arg[1] == 1 else [["", *path, ""] for path in inner]
        elif op is sre.MAX_REPEAT and arg[1] == 1:
            inner = _strings(arg[2])
            options = [[""], *inner] if all(len(path) == 1 for path in inner) else [["", ""]]
        else:
            options = [["", ""]]
        # the last string of what came before runs on into the first one of what follows
        paths = [[*p[:-1], p[-1] + o[0], *o[1:]] for p in paths for o in options]
        if len(paths) > _MOST_ALTERNATIVES:
            return [["", ""]]
    return paths


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory lower-case trigrams; empty if some alternative has none."""
    sets = {frozenset(s[i : i + 3] for s in map(str.lower, path) for i in range(len(s) - 2)) for path in _strings(_parser.parse(pattern))}
    if not all(sets) or len(sets) > _MOST_ALTERNATIVES:
        return []
    return sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)


def query_grams(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams of all queries of the rules."""
    return sorted({g for rule in rules for alt in trigram_query(rule.pattern) for g in alt})


def _tree(grams: list[str]) -> str:
    """An expression that matches any of the strings, which share no end; common starts once."""
    heads: dict[str, list[str]] = {}
    for g in grams:
        heads.setdefault(g[0], []).append(g[1:])
    parts = [re.escape(h) + (_tree(rest) if rest[0] else "") for h, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def index(texts: DataFrame, grams: list[str]) -> DataFrame:
    """texts: (key, text). Postings (gram, key): the texts that hold each trigram in lower case."""
    firsts = "".join(re.escape(c) for c in sorted({g[0] for g in grams}))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?=[{firsts}])(?=({_tree(grams)}))"), F.lit(1)))
    return texts.select("key", F.explode(found).alias("gram")).distinct()


def candidates(texts: DataFrame, rules: tuple[Rule, ...], postings: DataFrame | None = None) -> DataFrame:
    """texts: (key, text). Returns (key, rules): numbers of the rules whose query a text satisfies."""
    queries = [(n, k, sorted(alt)) for n, rule in enumerate(rules) for k, alt in enumerate(trigram_query(rule.pattern))]
    spark = texts.sparkSession
    if not queries:
        return spark.createDataFrame([], "key binary, rules array<int>")
    if postings is None:
        postings = stash(index(texts, query_grams(rules)), "secret-postings")
    wanted = spark.createDataFrame([(g, n, k, len(alt)) for n, k, alt in queries for g in alt], "gram string, rule int, alternative int, needed long")
    met = postings.join(F.broadcast(wanted), "gram").groupBy("key", "rule", "alternative", "needed").agg(F.count("*").alias("n")).where(F.col("n") == F.col("needed"))
    return met.groupBy("key").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def rule_spans(text: Column, rule: Rule) -> Column:
    """The rule's matches, those that are too short dropped."""
    found = spans(text, rule.pattern)
    if not rule.least:
        return found
    return F.filter(found, lambda x: F.length(F.regexp_extract(x["found"], rule.pattern, rule.group)) >= rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id and for each rule an array column ``kind`` of labelled spans."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("key", text_key(F.col("text")))
    found = stash(candidates(keyed.select("key", "text"), rules).select(F.col("key").alias("k"), "rules"), "secret-candidates")
    both = keyed.join(found.hint("merge"), keyed["key"] == found["k"], "left")
    columns = []
    for n, rule in enumerate(rules):
        hits = labelled(rule.kind, n, rule_spans(F.col("text"), rule))
        if trigram_query(rule.pattern):
            hits = F.when(F.array_contains("rules", n), hits).otherwise(labelled(rule.kind, n, no_spans()))
        columns.append(hits.alias(rule.kind))
    return both.select("doc_id", *columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = by_start([F.col(r.kind) for r in BASE_RULES])
    every = by_start([F.col(r.kind) for r in BASE_RULES + MORE_RULES])
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))

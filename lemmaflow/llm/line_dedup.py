"""Operator 10, line dedup by winnowing over line hashes, in SQL functions only.

Lines that hold a word are hashed. Of every ``WINDOW`` consecutive such lines the one of least
hash is selected (the first of equal ones), and likewise of every two that hold ``LONG_WORDS``
words together; a line with that many words is selected itself. Only selected lines become
rows, each with the runs that selected it. Two places that share a run have selected the same
line of it, so positions are joined on the hashes of selected lines, and those that
no other position shares are dropped. The others are extended to both sides: a
selected line's runs, named by a digest of their whole text, are matched with the earliest
place of the same text in order of (doc_id, text, line), and runs that have an earlier place
are deleted. A longer repeated run is one of overlapping ones, so it goes as a whole.
So: a line goes if a run of three lines, of two lines of 50 words together, or of one line of 50
words, that it is in occurred before in the corpus; every repeated run of whole lines with 50
words is made up of these, and the first occurrence of everything stays.

Defined cases: null and empty texts have no lines to delete and stay as they are; lines
without a word are never matched nor deleted; runs are judged on the input; rows that
repeat both id and text are one place, so none is deleted for the other's sake; null
ids come last; columns other than the text pass through unread, and a name that is taken is
lengthened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, release, stash, table, text_key

WINDOW = 3
LONG_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]"


def _place() -> Column:
    """A place in the corpus, comparable: ids ascending and null last, then text, then line."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key", F.element_at("lines", 1).alias("line"))


def postings(rows: DataFrame) -> DataFrame:
    """rows: (doc_id, key, text). One row for each selected line: (doc_id, key, print, at,
    runs); ``at`` is its number and ``runs`` are the runs that selected it (unit, lines)."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    own = rows.select("doc_id", "key", F.filter(numbered, lambda x: F.regexp_like(x["text"], F.lit(_WORD))).alias("own")).where(F.size("own") > 0)
    own = own.select(
        "doc_id",
        "key",
        F.transform("own", lambda x: x["line"]).alias("lines"),
        F.transform("own", lambda x: F.xxhash64(x["text"])).alias("hashes"),
        F.transform("own", lambda x: F.unhex(F.md5(x["text"]))).alias("names"),
        F.transform("own", lambda x: F.regexp_count(x["text"], F.lit(_WORD + "+"))).alias("counts"),
    )
    n = F.size("lines")

    def up_to(last: Column) -> Column:
        return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    def least(i: Column, length: int) -> Column:
        hashes = F.slice("hashes", i, length)
        return (i + F.array_position(hashes, F.array_min(hashes)) - 1).cast("int")

    def is_long(i: Column, length: int) -> Column:
        return sum(F.get("counts", i - 1 + k) for k in range(length)) >= LONG_WORDS

    def run(i: Column, length: int) -> Column:
        return F.struct(F.unhex(F.md5(F.concat(*[F.get("names", i - 1 + k) for k in range(length)]))).alias("unit"), F.slice("lines", i, length).alias("lines"))

    own = own.withColumns({
        "windows": F.transform(up_to(n - WINDOW + 1), lambda i: least(i, WINDOW)),
        "pairs": F.transform(up_to(n - 1), lambda i: F.when(is_long(i, 2), least(i, 2))),
        "alone": F.transform(up_to(n), lambda i: F.when(is_long(i, 1), i)),
    })

    def selected(p: Column) -> Column:
        runs = []
        for name, length in (("windows", WINDOW), ("pairs", 2), ("alone", 1)):
            for back in range(length):
                # get() is null before the first place and after the last
                runs.append(F.when(F.get(name, p - 1 - back) == p, run(p - back, length)))
        return F.struct(F.get("hashes", p - 1).alias("print"), F.get("lines", p - 1).alias("at"), F.array_compact(F.array(*runs)).alias("runs"))

    places = F.array_distinct(F.array_compact(F.concat("windows", "pairs", "alone")))
    return own.select("doc_id", "key", F.explode(F.transform(places, selected)).alias("m")).select("doc_id", "key", "m.*")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, removed): line numbers (from 0) to delete, for the texts that have any."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    prints = stash(postings(rows), "lines-prints")
    spot = F.struct("doc_id", "key", "at")
    shared = prints.groupBy("print").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    shared = stash(shared.select(F.col("print").alias("p")), "lines-shared")
    joined = prints.join(shared.hint("merge"), prints["print"] == shared["p"]).select("doc_id", "key", F.explode("runs").alias("r"))
    matched = stash(joined.select("doc_id", "key", F.col("r.unit").alias("unit"), F.col("r.lines").alias("lines")).select("doc_id", "key", "unit", "lines", _place().alias("place")), "lines-matched")
    release(prints, shared)
    firsts = matched.groupBy("unit").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    firsts = stash(firsts.select(F.col("unit").alias("u"), "first"), "lines-firsts")
    later = matched.join(firsts.hint("merge"), matched["unit"] == firsts["u"]).where("place > first")
    numbers = later.select("doc_id", "key", F.explode("lines").alias("line"))
    removed = stash(numbers.groupBy("doc_id", "key").agg(F.collect_set("line").alias("removed")), "lines-removed")
    release(matched, firsts)
    return removed


def mark(docs: DataFrame, name: str = "removed") -> DataFrame:
    """``docs`` with a column of the line numbers to delete (empty if none), which has the
    given name, lengthened if ``docs`` has it already, and comes last."""
    removed = removed_lines(docs).select(F.col("doc_id").alias("id_"), F.col("key").alias("key_"), F.col("removed").alias("removed_"))
    removed = removed.select(*[F.col(c).alias(free_name(docs, f"{c}line")) for c in removed.columns])
    one, two, three = removed.columns
    both = docs.join(removed.hint("merge"), docs["doc_id"].eqNullSafe(removed[one]) & (text_key(docs["text"]) == removed[two]), "left")
    return both.withColumn(free_name(docs, name), F.coalesce(F.col(three), F.array().cast("array<int>"))).drop(one, two, three)


def kept_text(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers; unchanged (null included) if there are none."""
    lines = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed), lambda i: F.element_at(lines, i + 1))
    return F.when(F.size(removed) > 0, F.array_join(kept, "\n")).otherwise(text)


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeated runs deleted from the text and n_chars, if there is such a column, counted anew. Documents left without any word by it go."""
    name = free_name(docs, "removed")
    kept = free_name(docs, "kept")
    out = mark(docs, name).withColumn(kept, kept_text(docs["text"], F.col(name)))
    out = out.where((F.size(name) == 0) | F.regexp_like(F.col(kept), F.lit(_WORD)))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(kept).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.size(name) > 0, F.length(kept).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(kept_text(F.col("text"), F.col("removed")), F.lit(""))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return docs.select("doc_id", lines.alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"))


#: the same rows in DuckDB
OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key FROM documents),
l AS (SELECT DISTINCT doc_id, key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
c AS (SELECT *, row_number() OVER w AS n, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id, key ORDER BY i)),
u AS (SELECT doc_id, key, i, line || chr(10) || l1 || chr(10) || l2 AS unit, [i, i1, i2] AS spots FROM c WHERE i2 IS NOT NULL
      UNION ALL
      SELECT doc_id, key, i, line || chr(10) || l1, [i, i1] FROM c WHERE i1 IS NOT NULL AND len(regexp_extract_all(line || chr(10) || l1, '[^\x20\x09-\x0D]+')) >= 50
      UNION ALL
      SELECT doc_id, key, i, line, [i] FROM c WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
o AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY doc_id NULLS LAST, key, i) AS r FROM u),
x AS (SELECT DISTINCT doc_id, key, unnest(spots) AS i FROM o WHERE r > 1),
k AS (SELECT l.doc_id, l.key, count(*) AS n_lines, count(x.i) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL), '') AS kept
      FROM l LEFT JOIN x ON l.doc_id IS NOT DISTINCT FROM x.doc_id AND l.key = x.key AND l.i = x.i GROUP BY l.doc_id, l.key)
SELECT d.doc_id, k.n_lines, k.n_removed, sha256(k.kept) AS kept_sha256 FROM d JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.key = k.key
"""

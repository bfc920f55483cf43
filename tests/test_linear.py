"""Work on one long text that must grow with its length, not with its square."""

from __future__ import annotations

import time

from lemmaflow.functions import text
from lemmaflow.operators import artifacts, joins
from lemmaflow.plans import tags
from lemmaflow.sources import macros, webbooks
from pyspark.sql import functions as F


def test_macros_of_a_long_unit(spark):
    content = "".join(f"\\cref{{k{n}}} text\n" for n in range(20_000))
    units = spark.createDataFrame([("u", content)], "unit string, content string").withColumn("file_id", F.array(F.lit("a"), F.lit("u"), F.lit("x"))).withColumn("tags", F.create_map().cast("map<string,boolean>"))
    began = time.time()
    found = macros.uses(units, ("cref",)).agg(F.count("*"), F.max("u.start"), F.count_distinct("u.required")).first()
    assert tuple(found) == (20_000, content.rindex("\\cref"), 20_000)
    assert time.time() - began < 20
    assert "content" not in macros.uses(units, ("cref",)).columns


def test_blanks_in_a_long_text(spark):
    ranges = [(5 * n, 5 * n + 2) for n in range(20_000)]
    rows = spark.createDataFrame([("abcd\n" * 20_000, ranges), ("abc", None), (None, [(0, 1)]), ("a\nbc", [(2, 3), (1, 1), (0, 2)])], "t string, r array<struct<start:int,stop:int>>")
    began = time.time()
    got = [r[0] for r in rows.select(tags.blank_ranges(F.col("t"), F.col("r"))).collect()]
    assert got == ["  cd\n" * 20_000, "abc", None, " \n c"]
    assert time.time() - began < 20


def test_ranges_of_a_long_page(spark):
    page = "".join(f"<p>Rule <b>{n}</b></p>" for n in range(20_000))
    began = time.time()
    rows = webbooks.tag_ranges(spark.createDataFrame([("a", page)], "page string, html string"), "page", "html", ["p"])
    assert tuple(rows.agg(F.count("*"), F.count_distinct("text"), F.max("stop")).first()) == (20_000, 20_000, len(page))
    assert time.time() - began < 20


def test_tags_by_name(spark):
    pages = spark.createDataFrame([("<H1 id='x' class=\"y\">a</h1><p/>",), (None,), ("",)], "html string")
    every, heads = (pages.select(text.scan_tags(F.col("html"), names=names)).collect() for names in (None, ["h1"]))
    assert [[t["name"] for t in r[0]] for r in every] == [["h1", "h1", "p"], [], []] and [len(r[0]) for r in heads] == [2, 0, 0]
    assert every[0][0][0]["attributes"] == {"id": "x", "class": "y"} and every[0][0][2]["single"] and every[0][0][1]["closing"]


def test_artifacts_of_a_long_unit(spark):
    content = "\n".join(f"\nPart {n} \\label{{lemma-{n}}}is\n" for n in range(6_000))
    units = spark.createDataFrame([("c", "u", content)], "component string, unit string, content string")
    asked = spark.createDataFrame([("c", f"u-lemma-{n}") for n in range(6_000)], "component string, label string")
    began = time.time()
    made, wrong = artifacts.source_artifacts(units, asked)
    assert made.where(F.col("source") == F.concat(F.lit("Part "), F.regexp_extract("label", "([0-9]+)$", 1), F.lit(" \\label{lemma-"), F.regexp_extract("label", "([0-9]+)$", 1), F.lit("}is"))).count() == 6_000
    assert time.time() - began < 60


def test_a_common_key_is_dealt_out(spark):
    left = spark.range(3000).selectExpr("id", "id % 2 as a", "cast(null as long) as b").unionByName(spark.createDataFrame([(5, 7, 9), (5, 1, 9)], "id long, a long, b long"))
    right = spark.range(2500).selectExpr("id", "1 as a", "9 as b")
    made = joins.any_key_matches(left, right, "id", {"y": (F.col("a"), F.col("a")), "x": (F.col("b"), F.col("b"))})
    assert {(r.kinds, r.n) for r in made.groupBy("kinds").agg(F.count("*").alias("n")).collect()} == {("y", 1499 * 2500), ("x,y", 2500)}
    assert made.select("own", "other").distinct().count() == made.count()
    most = max(made.select("own").groupBy(F.spark_partition_id()).count().collect(), key=lambda r: r["count"])["count"]
    assert most < 1500 * 2500

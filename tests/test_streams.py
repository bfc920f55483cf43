"""Texts of any number of tags, commands and lines: what a task holds of them."""

from __future__ import annotations

import tracemalloc
from itertools import pairwise

import pyarrow as pa
from lemmaflow.functions import text
from lemmaflow.plans import tags
from lemmaflow.sources import markup
from pyspark.sql import functions as F


def held(listed) -> tuple[int, int]:
    """How many things are listed, and the most bytes that were in use meanwhile."""
    tracemalloc.start()
    try:
        return sum(1 for _ in listed()), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_commands_are_not_held(spark):
    """a unit's commands were one list of objects, some 3 KB each, and its brackets a dict."""
    source = "".join(f"\\iftag{{big}}{{\\tagtrue{{odd}}}}{{<small:{n}>}}\n" for n in range(10_000))
    n, most = held(lambda: tags.commands_of(source))
    assert n == 20_000 and most < 4 * len(source)
    rows = tags.tokens(spark.createDataFrame([("a", source), ("b", None), ("c", "\\tagtrue{x}")], "unit string, content string"))
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().toString()
    assert {(r.unit, r["count"]) for r in rows.groupBy("unit").count().collect()} == {("a", 20_000), ("c", 1)}


def test_tags_are_not_held(spark):
    """a unit's tags were one list in a row, and the places where they end two lists of objects."""
    source = "<book>" + "".join(f'<theorem xml:id="p{n}"><statement>It holds.</statement></theorem>' for n in range(10_000)) + "</book>"
    n, most = held(lambda: text.tags_of(source, xml=True))
    assert n == 40_002 and most < 3 * len(source)
    rows = markup.elements(spark.createDataFrame([("c", "u", source), ("c", "v", None)], "component string, unit string, content string"))
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().toString()
    assert {(r.name, r["count"]) for r in rows.groupBy("name").count().collect()} == {("book", 1), ("theorem", 10_000), ("statement", 10_000)}


def test_lines_are_joined_in_order(spark):
    """a unit's lines were gathered in one list, for all units of a task at once."""
    rows = spark.range(30_000).select((F.col("id") % 7).alias("unit"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("at"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("ä"), F.col("id").cast("string"))).alias("line"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1, "x"), (None, 0, "y"), (9, 0, None)], "unit long, at long, line string"))
    made = text.joined_lines(rows, "unit", "at", "line")
    assert "collect_list" not in made._jdf.queryExecution().toString()
    got = {r.unit: r.content for r in made.collect()}
    places = {r.line: r["at"] for r in rows.where("line is not null").collect()}
    assert got[None] == "y\nx" and got[9] == "" and len(got) == 9
    assert sorted(x for k in range(7) for x in got[k].split("\n")) == sorted(x for x in places if x not in ("x", "y"))
    assert all(places[a] <= places[b] for k in range(7) for a, b in pairwise(got[k].split("\n")))


def test_pieces_are_cut_as_rows(spark):
    texts = spark.createDataFrame([("a", "xäyz", [0, 1], [1, 4]), ("b", None, None, None)], "k string, t string, i array<int>, j array<int>")
    assert [tuple(r) for r in text.cut_rows(texts, "t", "i", "j").collect()] == [("a", 0, "x"), ("a", 1, "äyz")]


def test_small_texts_share_their_rows(spark):
    """what is found in many small texts goes on together, not as a batch for each text."""
    texts = spark.range(0, 12_000, 1, 1).select("id", F.concat(F.lit("<a/><b/>"), F.col("id").cast("string")).alias("t"))
    rows = text.tag_rows(texts, "t")
    assert rows.agg(F.count("*"), F.count_distinct("id", "n"), F.max("end")).first()[:] == (24_000, 24_000, 8)
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert sizes.count() < 100


def test_contexts_without_choices_take_no_rounds(spark):
    """every level of imports settled all its commands by rounds, twice, and moved the texts and commands of all files."""
    names = [f"u{k}" for k in range(1, 14)]
    content = {n: "\\tagtrue{x}" + "".join(f"\\olimport{{{m}}}" for m in (f"u{3 * k - 1}", f"u{3 * k}", f"u{3 * k + 1}", "gone") if m in (*names, "gone")) for k, n in enumerate(names, 1)}
    units = spark.createDataFrame([(f"{n}.tex", t) for n, t in content.items()], "unit string, content string")
    entry = spark.createDataFrame([("u1.tex",)], "unit string").select("unit", F.create_map(F.lit("x"), F.lit(False)).alias("tags"))
    group = "unfolded"
    spark.sparkContext.setJobGroup(group, group)
    try:
        made = tags.unfolded(units, entry)
        rows = made["instance"].orderBy("ordinal").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    order = lambda k: [f"u{k}.tex", *(x for m in (3 * k - 1, 3 * k, 3 * k + 1) if m < 14 for x in order(m))]
    assert [r.unit for r in rows] == order(1)
    assert [r.unit for r in made["missing"].collect()] == ["gone.tex"] and {r.active for r in made["text"].collect()} == set(content.values())
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 170 and not spark.catalog.listTables()

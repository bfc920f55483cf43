"""What the graph loops move, and how many jobs they are, on small graphs."""

from __future__ import annotations

import random
import uuid

from lemmaflow.plans import graph
from pyspark.sql import functions as F


def jobs_and_moved(spark, run):
    """The result of ``run``, its number of jobs and the records that they shuffled."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        found = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup(group)
    store = sc._jsc.sc().statusStore()
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    return found, len(jobs), sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def halves(spark, n):
    return spark.range(2, n).select(F.col("id").alias("src"), F.explode(F.array(F.floor(F.col("id") / 2), F.floor(F.col("id") / 3))).alias("dst")).where("dst > 0").distinct()


def test_closure_moves_pairs_once(spark):
    """a round moved all pairs found before it."""
    edges = halves(spark, 1024)
    rows, _, moved = jobs_and_moved(spark, lambda: graph.closure(edges, spark.range(1, 1024).withColumnRenamed("id", "root")).collect())
    assert len({(r.root, r.node) for r in rows}) == len(rows)
    assert moved < 7 * len(rows)


def test_reading_order_is_one_stream(spark):
    """each root was a group of its own in pandas. Roots and nodes are as in a plain walk, with a cycle and strings."""
    rng = random.Random(3)
    pairs = [(f"n{a}", f"n{b}", k) for a in range(30) for k, b in enumerate(rng.sample(range(30), 2))]
    edges = spark.createDataFrame(pairs + [("n3", None, 9)], "src string, dst string, seq int")
    made = graph.reading_order(edges, spark.createDataFrame([(f"n{k}",) for k in range(30)] + [("alone",)], "root string"))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.root, r.position)):
        got.setdefault(r.root, []).append(r.node)

    def order(root):
        out = []

        def visit(node, seen):
            seen.add(node)
            for a, b, _ in pairs:
                if a == node and b not in seen:
                    visit(b, seen)
            out.append(node)

        visit(root, set())
        return out

    assert got == {root: order(root) for root in [f"n{k}" for k in range(30)] + ["alone"]}


def test_strong_components_in_a_row(spark):
    """components that lie behind one another were found one by one. Also with classes split by spreading."""
    rings = [(10 * k + i, 10 * k + (i + 1) % 4) for k in range(8) for i in range(4)]
    edges = spark.createDataFrame(rings + [(10 * k, 10 * k + 10) for k in range(7)] + [(70, 71), (500, 500), (80, 81)], "src long, dst long")
    for most in (10_000, 3):
        rows, jobs, _ = jobs_and_moved(spark, lambda most=most: graph.strong_components(edges, most).collect())
        got = {}
        for r in rows:
            got.setdefault(r.component, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == [[10 * k + i for i in range(4)] for k in range(8)] + [[500]]
        assert jobs < (60 if most > 3 else 1000)


def test_first_paths_make_no_pairs(spark):
    """all pairs of a target and what is above it were made."""
    edges = halves(spark, 1024).withColumn("seq", F.col("dst"))
    roots = spark.range(512, 1024).select(F.col("id").alias("root"), F.col("id").alias("seq"))
    rows, _, moved = jobs_and_moved(spark, lambda: graph.first_paths(edges, roots, spark.range(1, 1024).withColumnRenamed("id", "target")).collect())
    assert {r.target for r in rows} == set(range(1, 1024)) and moved < 25_000


def test_redundant_edges_search_no_further_than_needed(spark):
    """the whole closure was made. A star has no ways to search, a ladder has one for each of its long edges."""
    ladder = [(k, k + 1) for k in range(200)] + [(k, k + 2) for k in range(0, 199, 5)]
    edges = spark.createDataFrame(ladder + [(1000, 1001 + k) for k in range(300)], "src long, dst long")
    rows, _, moved = jobs_and_moved(spark, lambda: graph.redundant_edges(edges).collect())
    assert sorted((r.src, r.dst) for r in rows) == [(k, k + 2) for k in range(0, 199, 5)]
    assert moved < 60_000

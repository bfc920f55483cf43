"""What loops over graphs cost, and their results against plain walks."""

from __future__ import annotations

import random
import uuid

from lemmaflow.plans import graph


def jobs_of(spark, run):
    """The result of ``run`` and how many jobs it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def below(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    found = {}
    for start in {x for p in pairs for x in p}:
        seen, todo = set(), [start]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        found[start] = seen
    return found


def test_strong_components_walk_large_classes(spark):
    """classes of over 50,000 edges were split by rounds of spreading, of many jobs each."""
    n = 30_000
    edges = spark.range(2, n).selectExpr("id AS src", "explode(array(id div 2, id div 3)) AS dst").where("dst > 0").union(spark.range(8, n, 50).selectExpr("id div 8", "id"))
    rows, jobs = jobs_of(spark, lambda: graph.strong_components(edges).collect())
    assert edges.count() > 55_000 and len(rows) > 1000
    assert jobs < 50


def test_strong_components_at_random(spark):
    """walked at once, in classes cut between batches, and after layers are shed and numbers spread."""
    rng = random.Random(7)
    pairs = sorted({(300 * g + rng.randrange(12), 300 * g + rng.randrange(12)) for g in range(25) for _ in range(16)} | {(300 * g, 300 * g + 300) for g in range(24)} | {(k, k + 1) for k in range(9000, 9020)})
    reach = below(pairs)
    expected = sorted(sorted({a, *(b for b in reach[a] if a in reach[b])}) for a in reach if a in reach[a])
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for most in (10_000, 25):
        found = {}
        for r in graph.strong_components(edges, most).collect():
            assert r.node not in found
            found[r.node] = r.component
        groups = [sorted(k for k, c in found.items() if c == found[node]) for node in found]
        assert sorted(groups) == expected


def test_visible_makes_no_pairs(spark):
    """all pairs of a root and what it reaches were made."""
    rng = random.Random(5)
    pairs = {(a, b) for a in range(2, 400) for b in (a // 2, rng.randrange(a)) if a != b} | {(7, 300), (500, 501), (501, 502), (3, 3)}
    matches, roots = {9, 30, 77, 502, 600}, {*range(200, 400), 500, 600, 601}
    reach = below(pairs)
    kept = matches | {a for a, seen in reach.items() if seen & matches}
    inside = below({(a, b) for a, b in pairs if a in kept and b in kept})
    expected = {n for r in roots & kept for n in {r} | inside.get(r, set())}
    one = lambda values, name: spark.createDataFrame([(v,) for v in sorted(values)], f"{name} long")
    before = spark.catalog.listTables()
    made = graph.visible(spark.createDataFrame(sorted(pairs), "src long, dst long"), one(roots, "root"), one({*reach, 600, 601}, "node"), one(matches, "node"))
    assert sorted(r.node for r in made.collect()) == sorted(expected)
    assert spark.catalog.listTables() == before

    # a step along the chain took a round of its own, with the pairs of all roots
    chain = spark.range(1, 24).selectExpr("id AS src", "id - 1 AS dst")
    nodes = spark.range(24).withColumnRenamed("id", "node")
    rows, jobs = jobs_of(spark, lambda: graph.visible(chain, nodes.withColumnRenamed("node", "root"), nodes, nodes.where("node = 0")).collect())
    assert len(rows) == 24 and jobs < 150

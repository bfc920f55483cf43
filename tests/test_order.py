"""Greedy edges and first-visit trees against plain loops."""

from __future__ import annotations

import random
import time

import duckdb
from lemmaflow.plans import graph
from lemmaflow.queries import views
from lemmaflow.registry import ORACLES
from pyspark.sql import functions as F


def test_greedy_edges(spark):
    rng = random.Random(6)
    rows, seq = [], 0
    for block in range(12):
        nodes = [f"{block}-{k}" for k in range(7)]
        for _ in range(rng.randint(2, 14)):
            rows.append((rng.choice(nodes), rng.choice(nodes), seq))
            seq += rng.randint(1, 5)
    rows += [(f"{b}-0", f"{b + 1}-0", seq + b) for b in range(11)]
    rng.shuffle(rows)
    taken, expected = {}, set()
    for a, b, n in sorted(rows, key=lambda r: r[2]):
        todo, seen = [b], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += taken.get(x, [])
        if a not in seen:
            taken.setdefault(a, []).append(b)
            expected.add(n)
    got = graph.greedy_acyclic(spark.createDataFrame(rows, "src string, dst string, seq long")).collect()
    assert len(got) == len(rows) and {r["seq"] for r in got if r["taken"]} == expected != {r[2] for r in rows}
    assert graph.greedy_acyclic(spark.createDataFrame([], "src string, dst string, seq long")).collect() == []


def test_greedy_query_lists_the_edge_of_ring_0(spark, tmp_path):
    parts = [(k, 1 + k % 7) for k in range(12)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rows = views.grf_greedy_edges(spark, str(tmp_path)).collect()
    assert len(rows) == 15 and {r["src"]: r["taken"] for r in rows if r["src"] == r["dst"]} == {0: True}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(tuple(r) for r in rows) == sorted(con.sql(ORACLES["grf_greedy_edges"]).project("src, dst, seq, taken").fetchall())


def walk(edges, roots):
    ways, out, seen = {}, [], set()
    for a, b, n in sorted(edges, key=lambda e: e[2]):
        ways.setdefault(a, []).append((b, n))

    def visit(node, parent, path, above):
        kind = "cycle" if node in above else "shared" if node in seen else "first"
        out.append((parent, node, path, kind))
        if kind == "first":
            seen.add(node)
            for b, n in ways.get(node, []):
                visit(b, node, (*path, n), above | {node})

    for root, n in sorted(roots, key=lambda r: r[1]):
        visit(root, None, (n,), frozenset())
    return out


def test_first_visits(spark):
    rng = random.Random(4)
    edges = [(a, b, n) for a in range(40) for n, b in enumerate(rng.sample(range(a + 1, 60), min(4, 59 - a)))]
    edges += [(100, 101, 0), (101, 102, 0), (102, 100, 1), (102, 103, 2), (103, 101, 0), (100, 103, 5)]
    roots = [(0, 1), (7, 0), (100, 2), (3, 9)]
    made = graph.first_visit_tree(spark.createDataFrame(edges, "src int, dst int, seq int"), spark.createDataFrame(roots, "root int, seq int"))
    got = sorted(((r["parent"], r["node"], tuple(r["path"]), r["kind"]) for r in made.collect()), key=lambda r: r[2])
    assert got == walk(edges, roots)
    assert {k for *_, k in got} == {"first", "shared", "cycle"}


def test_levels_against_longest_paths(spark):
    rng = random.Random(9)
    for case in range(3):
        edges = {(a, rng.randrange(a)) for a in range(1, 60) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}
        if case:
            edges |= {(100, 101), (101, 102), (102, 100), (103, 100), (104, 103), (105, 5), (5, 7), (7, 5), (110, 110), (111, 200)}
        nodes = list(range(60)) + [100, 101, 102, 103, 104, 105, 110, 111]
        level: dict[int, int] = {}
        while True:
            new = {n: max((level[b] + 1 for a, b in edges if a == n), default=0) for n in nodes if n not in level and all(b in level for a, b in edges if a == n)}
            if not new:
                break
            level |= new
        made, left = graph.peel(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(list(edges), "src int, dst int"))
        assert {r["node"]: r["level"] for r in made.collect()} == level
        assert sorted(r["node"] for r in left.collect()) == sorted(set(nodes) - set(level))


def test_long_chain_takes_few_rounds(spark):
    began = time.time()
    nodes = spark.range(100_000).select(F.col("id").alias("node"))
    edges = spark.range(1, 100_000).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    made, left = graph.peel(nodes, edges)
    assert made.where("level = node").count() == 100_000 and left.count() == 0
    assert time.time() - began < 150

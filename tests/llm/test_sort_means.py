"""Sort-means against plain k-means in Python's whole numbers, and against SQL."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from lemmaflow.llm import sort_means

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain(rows, clusters=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = [v for _, v in ranked[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for c in range(len(points)):
            own = [v for (_, v), m in zip(kept, mine) if m == c]
            if own:
                points[c] = tuple(sum(x) // len(own) for x in zip(*own))
    final = [near(v) for _, v in kept]
    total = sum(d for d, _ in final)
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return [(i, c, d, sum(e for e, m in final if m == c), total, digest[c]) for (i, _), (d, c) in zip(kept, final)]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def run(spark, rows, folder):
    spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    got = sort_means.op13_sort_means(spark, str(folder))
    assert got.columns == COLUMNS
    return order(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_plain(spark, tmp_path, seed):
    rng = random.Random(seed)
    spots = [[rng.choice([-1, 0, 0.5, 1]) for _ in range(64)] for _ in range(9)]
    rows = [(k, [float(np.float32(x + rng.gauss(0, 0.2))) for x in rng.choice(spots)]) for k in range(300)]
    rows += [(400 + k, [0.0] * 63 + [k % 4 / 64]) for k in range(40)]  # many ties
    rows += [(5, rows[5][1]), (5, rows[5][1]), (7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 63 + [None]), (904, [0.0] * 63 + [math.nan]), (905, [math.inf] + [0.0] * 63), (906, [0.0] * 65)]
    assert run(spark, rows, tmp_path) == order(plain(rows))


def test_few_equal_and_none(spark, tmp_path):
    rows = [(k, [0.5] * 64) for k in range(30)]
    assert run(spark, rows, tmp_path / "equal") == order(plain(rows))
    rows = [(k, [float(k)] * 64) for k in range(5)]
    assert run(spark, rows, tmp_path / "few") == order(plain(rows))
    assert run(spark, [(1, None)], tmp_path / "none") == []


def test_scan_stops_early_and_only_then():
    rng = np.random.default_rng(3)
    points = rng.integers(-40, 40, (12, 4))
    points[5] = points[2]
    units = rng.integers(-60, 60, (2000, 4))
    units[:200] = (points[rng.integers(0, 12, 200)] + points[rng.integers(0, 12, 200)]) // 2
    squares = ((units[:, None] - points[None]) ** 2).sum(axis=2)
    for before in (np.zeros(2000, np.int64), rng.integers(0, 12, 2000)):
        number, distance = sort_means.Centroids.of(points).assign(units, before)
        assert (number == squares.argmin(axis=1)).all() and (distance == squares.min(axis=1)).all()


def test_too_large(spark, tmp_path):
    with pytest.raises(Exception, match="would not fit 64 bits"):
        run(spark, [(1, [3e30] + [0.0] * 63)], tmp_path)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = con.sql(sort_means.OP13_SQL).project(", ".join(COLUMNS)).fetchall()
    assert order(tuple(r) for r in sort_means.op13_sort_means(spark, SF).collect()) == order(expected)

"""Operator 13, centroid clustering by sort-means, in whole numbers.

Each round orders the other centroids by their distance from each centroid. A vector
starts with the centroid it was assigned to before and scans that one's order, up to
the first centroid that is strictly more than twice as far from it as the vector is: by the
triangle inequality none from there on is nearer, or as near with a smaller number. Tasks take
the centroids as a broadcast of ``clusters`` x ``components`` numbers, which are parameters; sums are
made in the tasks and merged by cluster, so the driver gets one row a cluster and round.

Defined cases: vectors that are null, of another length, or with a component that is null or
not finite are left out; repeated rows and equal vectors count each; the smaller number wins a
tie; an empty cluster keeps its centroid; with fewer vectors than clusters there are as many
clusters as vectors; null ids come last in the choice of the first centroids and rows that
agree in id are chosen in order of their components; other columns are not looked at; an empty
table gives an empty result. A component of over 2^27 units, whose squares could not be added
up in 64 bits, stops the run with an error that says so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stash, table

COMPONENTS = 64
CLUSTERS = 16
ROUNDS = 3
UNITS = 64
SEED = 1
_MOST = 1 << 27


def whole_vectors(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id and ``units``, the floor of UNITS times each component, of the vectors that are kept."""
    number = lambda x: x.cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf"))
    kept = rows.where((F.size(vector) == components) & F.forall(vector, finite))
    return kept.select("vec_id", F.transform(vector, lambda x: F.floor(number(x) * UNITS)).alias("units"))


@dataclass(frozen=True)
class Centroids:
    """Centroids with, for each, the numbers of all in order of distance from it, itself first."""

    points: np.ndarray
    squares: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Centroids:
        squares = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        ranked = squares.copy()
        np.fill_diagonal(ranked, -1)
        return cls(points, squares, np.argsort(ranked, axis=1, kind="stable"))

    def assign(self, units: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row and its squared distance, from the one it had before."""
        best = ((units - self.points[before]) ** 2).sum(axis=1)
        nearest, own = before.copy(), best.copy()
        for c in np.unique(before):
            scanned = np.flatnonzero(before == c)
            for other in self.order[c, 1:]:
                scanned = scanned[self.squares[c, other] <= 4 * own[scanned]]
                if not len(scanned):
                    break
                far = ((units[scanned] - self.points[other]) ** 2).sum(axis=1)
                nearer = (far < best[scanned]) | ((far == best[scanned]) & (other < nearest[scanned]))
                best[scanned[nearer]], nearest[scanned[nearer]] = far[nearer], other
        return nearest, best


def _assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """vectors: (vec_id, units, cluster). The same with the new cluster and its squared distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("cluster int, distance long")
    def nearest(units: pd.Series, cluster: pd.Series) -> pd.DataFrame:
        known = shared.value
        rows = np.concatenate([np.empty(0, np.int64), *units]).reshape(len(units), -1)
        if np.abs(rows).max(initial=0) > _MOST or rows.min(initial=0) < -_MOST:
            raise ValueError(f"a vector has a component of over {_MOST} units; squared distances would not fit 64 bits")
        found, distance = known.assign(rows, cluster.to_numpy(np.int64))
        return pd.DataFrame({"cluster": found.astype(np.int32), "distance": distance})

    return vectors.select("vec_id", "units", nearest("units", "cluster").alias("near")).select("vec_id", "units", "near.*")


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the least sha256 of ``seed:vec_id``, in that order."""
    drawn: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(drawn.asc_nulls_last(), "units").select("units").limit(clusters).collect()
    return np.array([r["units"] for r in chosen], np.int64)


def _means(assigned: DataFrame, points: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a cluster without vectors keeps its point."""
    sums = [F.sum(F.col("units")[k]).alias(f"s{k}") for k in range(points.shape[1])]
    moved = points.copy()
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # one row a cluster
        moved[row["cluster"]] = [row[f"s{k}"] // row["n"] for k in range(points.shape[1])]
    return moved


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vectors: (vec_id, units). Adds cluster, distance (squared), cluster_inertia, inertia, centroid (array of units)."""
    spark = vectors.sparkSession
    step = stash(vectors.select("vec_id", "units", F.lit(0).alias("cluster")), "means-vectors")
    points = first_centroids(step, clusters, seed)
    if not len(points):
        return step.selectExpr("*", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "units AS centroid").limit(0)
    for k in range(rounds + 1):
        moved = stash(_assigned(step, Centroids.of(points)), "means-assigned")
        release(step)
        step = moved
        if k < rounds:
            points = _means(step, points)
    sums = {r["cluster"]: r["inertia"] for r in step.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    known = [(c, n, sum(sums.values()), points[c].tolist()) for c, n in sums.items()]
    figures = spark.createDataFrame(known, "c int, cluster_inertia long, inertia long, centroid array<long>")
    return step.join(F.broadcast(figures), step["cluster"] == figures["c"]).drop("c")  # one row a cluster


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(whole_vectors(table(spark, sf_dir, "embeddings")))
    written = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", written.alias("centroid_sha256"))


def _round_sql(k: int) -> str:
    """Assignment to the centroids of round k, and their means as those of round k + 1."""
    return f"""
near{k} AS (
  SELECT v.row_id, v.vec_id, v.units, c.number,
    list_sum(list_transform(list_zip(v.units, c.units), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM vectors v, centroids{k} c),
best{k} AS MATERIALIZED (SELECT * FROM near{k} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, number) = 1),
sums{k} AS (
  SELECT number, place, sum(unit)::BIGINT AS s, count(*) AS n
  FROM (SELECT number, unnest(units) AS unit, generate_subscripts(units, 1) AS place FROM best{k}) GROUP BY number, place),
means{k} AS (SELECT number, list((s - ((s % n) + n) % n) // n ORDER BY place) AS units FROM sums{k} GROUP BY number),
centroids{k + 1} AS MATERIALIZED (SELECT c.number, coalesce(m.units, c.units) AS units FROM centroids{k} c LEFT JOIN means{k} m USING (number))"""


OP13_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS units FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), units) - 1 AS number, units FROM vectors
  QUALIFY number < {CLUSTERS}),{",".join(_round_sql(k) for k in range(ROUNDS + 1))}
SELECT vec_id, b.number::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY b.number))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.units, ',')) AS centroid_sha256
FROM best{ROUNDS} b JOIN centroids{ROUNDS} c USING (number)
"""

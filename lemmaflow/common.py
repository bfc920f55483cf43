"""Shared helpers: intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; set to a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lemmaflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/steps/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """Tables in the shared folder in as many buckets of a column as a shuffle has partitions, so that joins and groups on
    it need not move their rows again; such joins sort, and no table goes through the driver."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.n, self.paths = spark, int(spark.conf.get("spark.sql.shuffle.partitions")), {}

    def write(self, df: DataFrame, label: str, by: str) -> DataFrame:
        name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
        path = f"{shared_folder(self.spark).rstrip('/')}/steps/{name}"
        df.repartition(self.n, by).write.format("parquet").bucketBy(self.n, by).option("path", path).saveAsTable(name)
        self.paths[name] = path
        return self.spark.table(name).hint("merge")

    def files(self, label: str) -> list[DataFrame]:
        """What was written under a label, in order, as plain files, which stay when the names go."""
        return [self.spark.read.schema(self.spark.table(n).schema).parquet(p) for n, p in self.paths.items() if n.startswith(f"{label.replace('-', '_')}_")]


@contextmanager
def buckets(spark: SparkSession) -> Iterator[Buckets]:
    """Names in the catalog go at the end, files stay."""
    made = Buckets(spark)
    try:
        yield made
    finally:
        for name in made.paths:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

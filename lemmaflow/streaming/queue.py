"""The work queue as a stream of outcomes (STM01-STM12): each micro-batch is folded into
the queue table by the same batch operators, and written as a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import apply_outcomes, discovered


def version(folder: str, batch: int) -> str:
    return f"{folder.rstrip('/')}/version={batch:08d}"


def start(outcomes: DataFrame, folder: str, queue: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fold a stream (paper_id, outcome, at) into versions of the queue under ``folder``.
    Batch n reads version n and writes version n + 1, so that a batch that runs again
    after a failure gives the same version. Papers that are new join the queue."""
    queue.write.mode("ignore").parquet(version(folder, 0))
    schema = queue.schema

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(version(folder, number))
        latest = batch.groupBy("paper_id").agg(F.max_by("outcome", "at").alias("outcome"), F.max("at").alias("at"))
        known = discovered(before, latest.select("paper_id", F.col("at").alias("updated_at")))
        apply_outcomes(known, latest).write.mode("overwrite").parquet(version(folder, number + 1))

    writer = outcomes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts(outcomes: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Outcomes by kind and window of event time; rows later than ``delay`` are left out."""
    timed = outcomes.withColumn("time", F.to_timestamp("at")).withWatermark("time", delay)
    return timed.groupBy(F.window("time", window), "outcome").count()

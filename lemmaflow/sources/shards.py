"""Content-addressed JSONL shards of bounded size: writer, reader and checks (SRC03, SRC04, SRC06, SRC09, SNK01-SNK04, SNK06).

Records are (component, collection, ordinal, record), record being one line of JSON. A
component's collection is cut greedily in order: a shard ends before the line that would
take it over the limit. The index, a table of descriptors, is written last and marks the
shards as complete; shards that are there already are named by their content, so a rerun
writes the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 5 << 20


def assign(sizes: DataFrame, by: list[str], order: str, size: str, limit: int = MAX_BYTES) -> DataFrame:
    """``sizes`` with ``shard`` (from 0): a shard starts anew where the limit would be
    passed. Each group is read in order as a stream of batches, never held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, shard, held = None, 0, 0
        for batch in batches:
            out = []
            for key, n in zip(batch[by].itertuples(index=False, name=None), batch[size].tolist()):
                if key != group:
                    group, shard, held = key, 0, 0
                elif held + n > limit:
                    shard, held = shard + 1, 0
                held += n
                out.append(shard)
            yield batch.assign(shard=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in sizes.dtypes) + ", shard int"
    # by a hash of the key: a repartition by the key itself is left out above a join on it, which may then change its own
    return sizes.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, order).mapInPandas(run, schema)


def encode(records: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Shards (component, collection, shard, path, record_count, byte_length, sha256, content).
    A record that passes the limit alone is an error."""
    size = F.octet_length("record") + 1
    checked = records.withColumn("n", F.when(size <= limit, size).otherwise(F.raise_error(F.concat(F.lit("record exceeds the shard limit: "), "component", F.lit(" "), F.col("ordinal").cast("string")))))
    placed = assign(checked, ["component", "collection"], "ordinal", "n", limit)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "record"))), lambda x: F.concat(x["record"], F.lit("\n")))
    shards = placed.groupBy("component", "collection", "shard").agg(F.array_join(lines, "").alias("content"), F.count("*").alias("record_count"))
    digest = F.sha2("content", 256)
    path = F.format_string("%s/%s/%06d-%s.jsonl", "component", "collection", "shard", digest)
    return shards.select("component", "collection", "shard", path.alias("path"), "record_count", F.octet_length("content").cast("long").alias("byte_length"), digest.alias("sha256"), "content")


def write(records: DataFrame, folder: str, limit: int = MAX_BYTES) -> None:
    """Write shards as files of text under ``folder``/shards, then the index."""
    shards = encode(records, limit)
    named = shards.withColumn("body", F.expr("substring(content, 1, length(content) - 1)"))
    named.select("component", "collection", "shard", "sha256", "body").write.mode("overwrite").partitionBy("component", "collection", "shard", "sha256").text(f"{folder}/shards")
    shards.drop("content").write.mode("overwrite").parquet(f"{folder}/index")


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    schema = "value string, component string, collection string, shard int, sha256 string"
    return spark.read.schema(schema).text(f"{folder}/shards", wholetext=True)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records that write() was given, in order of their ordinal within a collection."""
    base = spark.read.parquet(f"{folder}/index")
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("record_count").over(W.partitionBy("component", "collection").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = base.select("component", "collection", "shard", "sha256", before.alias("before"))
    rows = _contents(spark, folder).join(starts, ["component", "collection", "shard", "sha256"])
    lines = F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n"))
    return rows.select("component", "collection", "before", lines.alias("at", "record")).select("component", "collection", (F.col("before") + F.col("at")).alias("ordinal"), "record")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """Violations (rule, path): shards that are missing, unknown or not what the index says."""
    index = spark.read.parquet(f"{folder}/index")
    keys = ["component", "collection", "shard", "sha256"]
    found = _contents(spark, folder).select(*keys, F.sha2("value", 256).alias("digest"), F.octet_length("value").alias("bytes"), (F.size(F.split("value", "\n")) - 1).alias("lines"), F.contains("value", F.lit("\r")).alias("cr"))
    both = index.join(found, keys, "full_outer")
    checks = F.array(
        F.when(F.col("digest").isNull(), F.lit("missing")), F.when(F.col("path").isNull(), F.lit("unknown")), F.when(F.col("digest") != F.col("sha256"), F.lit("digest")),
        F.when(F.col("bytes") != F.col("byte_length"), F.lit("length")), F.when(F.col("lines") != F.col("record_count"), F.lit("count")), F.when(F.col("cr"), F.lit("line-ends")),
        F.when(F.col("path") != F.format_string("%s/%s/%06d-%s.jsonl", *keys), F.lit("path")),
    )
    return both.select(F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("rule"), F.coalesce("path", F.concat_ws("/", *keys)).alias("path"))

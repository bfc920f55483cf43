"""The manifest of book graphs: metrics, summary and its rules (AGG01, AGG03, AGG04, PRJ12, PRJ15, VAL06-VAL08)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import routed_theorems
from .rules import Tables, _rows, holds, refers, unique

COUNTS = (
    "source_unit_count", "inventoried_unit_count", "reviewed_unit_count", "theorem_count", "unrouted_count", "pending_count", "support_count", "artifact_count",
    "dependency_count", "reviewed_dependency_count", "unresolved_count",
)
IDENTITY = ("record", "ordinal", "component_id", "label")


def component_metrics(t: Tables) -> DataFrame:
    """All metrics of each component, from the tables of ``rules`` (component also has ``edition``)."""
    node = t["node"].select("component", "node", "node_class")
    has_route = t["proof_route"].select("component", F.col("theorem").alias("node")).distinct().withColumn("routed", F.lit(True))
    has_base = routed_theorems(t["proof_route"], t["dependency"], node).select("component", F.col("theorem").alias("node"), F.lit(True).alias("based"))
    theorem = F.col("node_class") == "theorem-like"
    nodes = node.join(has_route, ["component", "node"], "left").join(has_base, ["component", "node"], "left").groupBy("component").agg(
        F.count_if(theorem).alias("theorem_count"), F.count_if(theorem & F.col("routed").isNull()).alias("unrouted_count"), F.count_if(theorem & F.col("based").isNull()).alias("pending_count"),
        F.count_if(F.col("node_class") == "support").alias("support_count"), F.count_if(F.col("node_class") == "source-artifact").alias("artifact_count"),
    )
    status = F.col("evidence.status")
    parts = [
        t["source_unit"].groupBy("component").agg(F.count("*").alias("source_unit_count")),
        t["unit_inventory"].groupBy("component").agg(F.count_if(status != "pending").alias("inventoried_unit_count"), F.count_if(status == "reviewed").alias("reviewed_unit_count")),
        nodes,
        t["dependency"].groupBy("component").agg(F.count("*").alias("dependency_count"), F.count_if(status == "reviewed").alias("reviewed_dependency_count")),
        t["reference"].groupBy("component").agg(F.count_if(F.col("status") == "unresolved").alias("unresolved_count")),
    ]
    out = t["component"].select("component", "extraction_status", "graph_status", F.col("edition").isNotNull().alias("edition_resolved"))
    out = reduce(lambda a, b: a.join(b, "component", "left"), parts, out)
    return out.select("component", "extraction_status", "graph_status", "edition_resolved", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def summary(entries: DataFrame) -> DataFrame:
    """One row over a manifest's entries: states counted and counts summed."""
    states = [
        F.count_if("edition_resolved").alias("editions_resolved"), F.count_if(F.col("extraction_status") == "awaiting-edition").alias("awaiting_edition"),
        F.count_if(F.col("extraction_status") == "reviewed").alias("reviewed_extractions"), F.count_if(F.col("graph_status") == "reviewed-complete").alias("complete_graphs"),
    ]
    return entries.agg(F.count("*").alias("components"), *states, *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])


def entries_of(expected: DataFrame, metrics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A manifest: a row for each expected component (component, identity columns, path) with its
    metrics and, if the artifact is there (path), its path; components without a graph count nothing."""
    there = artifacts.select(F.col("path").alias("artifact_path")).distinct()
    rows = expected.join(there, F.col("path") == F.col("artifact_path"), "left").join(metrics, "component", "left")
    return rows.select("component", *IDENTITY, "artifact_path", F.coalesce("extraction_status", F.lit("awaiting-edition")).alias("extraction_status"), F.coalesce("graph_status", F.lit("not-started")).alias("graph_status"), F.coalesce("edition_resolved", F.lit(False)).alias("edition_resolved"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def _safe(path: Column) -> Column:
    return ~F.contains(path, F.lit("..")) & ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\"))


def index_rules(expected: DataFrame, entries: DataFrame, stored_summary: DataFrame | None = None) -> DataFrame:
    """Violations of a stored manifest against the registry's components, and of its summary
    against its own entries."""
    known = expected.select(F.col("component").alias("c"), F.struct(*IDENTITY).alias("identity"), F.col("path").alias("canonical"))
    both = entries.join(known, F.col("component") == F.col("c"), "left")
    filed = both.where("artifact_path is not null")
    found = [
        unique(entries, "entry-once", ["component"]),
        unique(entries.where("artifact_path is not null"), "artifact-once", ["artifact_path"]),
        refers(expected, "entry-for-component", "component", ["component"], entries, ["component"]),
        holds(both, "entry-identity", F.col("identity").eqNullSafe(F.struct(*IDENTITY)), F.col("component")),
        holds(filed, "artifact-path-safe", _safe(F.col("artifact_path")), F.col("component"), F.col("artifact_path")),
        holds(filed, "artifact-path-canonical", F.col("artifact_path") == F.col("canonical"), F.col("component"), F.col("artifact_path")),
    ]
    if stored_summary is not None:
        now = summary(entries)
        stale = now.exceptAll(stored_summary.select(now.columns))
        found.append(_rows(stale, "summary-current", F.lit("summary"), F.lit("")))
    return reduce(DataFrame.unionByName, found)


def entry_rules(entries: DataFrame, metrics: DataFrame) -> DataFrame:
    """Entries with an artifact whose metrics are not those of the graph, one row for each metric."""
    names = ("extraction_status", "graph_status", "edition_resolved", *COUNTS)
    now = metrics.select(F.col("component").alias("c"), *[F.col(n).alias(f"{n}__") for n in names])
    both = entries.where("artifact_path is not null").join(now, F.col("component") == F.col("c"), "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(n).eqNullSafe(F.col(f"{n}__")), F.lit(n)) for n in names]))
    return _rows(both.select("component", F.explode(wrong).alias("metric")), "metrics-current", F.col("component"), F.col("metric"))


def file_rules(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path) that no entry names, and entries whose file is missing."""
    named = entries.where("artifact_path is not null")
    return reduce(DataFrame.unionByName, [
        holds(files, "file-path-safe", _safe(F.col("path")), F.col("path")),
        refers(files, "file-in-manifest", "path", ["path"], named, ["artifact_path"]),
        refers(named, "file-present", "component", ["artifact_path"], files, ["path"]),
    ])

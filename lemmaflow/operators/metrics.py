"""Coverage and manifest metrics, statuses and route choice (AGG01-AGG03, AGG07, AGG21-AGG23, AGG27, PRJ02, PRJ05, VAL26, VAL27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def routed_theorems(routes: DataFrame, dependencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, theorem) of theorems with a route that is a root attestation or has an
    external or mathematical prerequisite. routes: (component, theorem, kind, dependency_ids)."""
    roots = routes.where("kind = 'root-attestation'").select("component", "theorem")
    used = routes.select("component", "theorem", F.explode("dependency_ids").alias("dependency"))
    edges = dependencies.select("component", "dependency", "prerequisite_type", "prerequisite")
    real = nodes.where("node_class <> 'source-artifact'").select("component", F.col("node").alias("prerequisite"))
    joined = used.join(edges.hint("merge"), ["component", "dependency"])
    outside = joined.where("prerequisite_type = 'external-input'").select("component", "theorem")
    inside = joined.where("prerequisite_type = 'node'").join(real.hint("merge"), ["component", "prerequisite"], "left_semi").select("component", "theorem")
    return roots.unionByName(outside).unionByName(inside).distinct()


def manifest_metrics(nodes: DataFrame, dependencies: DataFrame, routes: DataFrame, references: DataFrame) -> DataFrame:
    """Counts for each component. nodes: (component, node, node_class); dependencies:
    (component, dependency, prerequisite_type, prerequisite, reviewed); references:
    (component, unresolved)."""
    has_route = routes.select("component", F.col("theorem").alias("node")).distinct().withColumn("routed", F.lit(True))
    has_base = routed_theorems(routes, dependencies, nodes).select("component", F.col("theorem").alias("node"), F.lit(True).alias("based"))
    rows = nodes.join(has_route, ["component", "node"], "left").join(has_base, ["component", "node"], "left")
    theorem = F.col("node_class") == "theorem-like"
    counts = rows.groupBy("component").agg(
        F.count_if(theorem).alias("theorem_count"),
        F.count_if(theorem & F.col("routed").isNull()).alias("unrouted_count"),
        F.count_if(theorem & F.col("based").isNull()).alias("pending_count"),
        F.count_if(F.col("node_class") == "support").alias("support_count"),
        F.count_if(F.col("node_class") == "source-artifact").alias("artifact_count"),
    )
    edges = dependencies.groupBy("component").agg(F.count("*").alias("dependency_count"), F.count_if("reviewed").alias("reviewed_dependency_count"))
    open_ = references.groupBy("component").agg(F.count_if("unresolved").alias("unresolved_count"))
    return counts.join(edges, "component", "left").join(open_, "component", "left").na.fill(0)


def manifest_summary(metrics: DataFrame) -> DataFrame:
    """One row: the number of components and the sum of every count."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in metrics.columns if c.endswith("_count")]
    return metrics.agg(F.count("*").alias("components"), *sums)


def preferred_route(routes: Column) -> Column:
    """Of an array of routes (kind, status, ...): a reviewed one, minimized before original
    before the first of any other kind."""
    reviewed = F.filter(routes, lambda r: r["status"] == "complete")
    of = lambda kind: F.get(F.filter(reviewed, lambda r: r["kind"] == kind), 0)
    return F.coalesce(of("minimized"), of("original"), F.get(reviewed, 0))


def resolution_state(selected: Column, proposals: Column) -> Column:
    """The state of a source: proposals is an array of (id, kind, decision)."""
    chosen = F.get(F.filter(proposals, lambda p: p["id"] == selected), 0)["kind"]
    active = F.filter(proposals, lambda p: F.coalesce(p["decision"], F.lit("")) != "rejected")
    has = lambda kind: F.exists(active, lambda p: p["kind"] == kind)
    return (
        F.when(selected.isNotNull() & (chosen == "exact-edition"), "verified-exact-edition")
        .when(selected.isNotNull() & chosen.isNotNull(), "verified-duplicate")
        .when(selected.isNotNull(), "invalid-selection")
        .when(has("exact-edition"), "candidate-exact-edition")
        .when(has("duplicate-component"), "candidate-duplicate")
        .otherwise("unresolved")
    )


def importer_state(selected: Column, proposals: Column, assessments: Column) -> Column:
    """The strongest outcome among assessments (proposal_id, outcome) that still matter."""
    active = F.transform(F.filter(proposals, lambda p: F.coalesce(p["decision"], F.lit("")) != "rejected"), lambda p: p["id"])
    relevant = F.when(selected.isNotNull(), F.array(selected)).otherwise(active)
    outcomes = F.transform(F.filter(assessments, lambda a: F.array_contains(relevant, a["proposal_id"])), lambda a: a["outcome"])
    chain = F.when(F.lit(False), F.lit(""))
    for outcome in ("candidate-produced", "candidate-output-rejected", "needs-adapter", "incompatible"):
        chain = chain.when(F.array_contains(outcomes, outcome), outcome)
    return chain.otherwise("not-assessed")


def status_rollup(rows: DataFrame, by: str, status: str, ordinal: str) -> DataFrame:
    """(by, statuses): counts of statuses in the order in which they come first."""
    counts = rows.groupBy(by, status).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    part = F.concat_ws(" ", F.col("n"), F.col(status))
    listed = F.array_sort(F.collect_list(F.struct("first", part.alias("part"))))
    return counts.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["part"]), ", ").alias("statuses"))


def edge_groups(occurrences: DataFrame, owner: str, target: str, evidence: str) -> DataFrame:
    """One edge for each owner and target: number of occurrences and sorted evidence."""
    return occurrences.groupBy(owner, target).agg(F.count("*").alias("occurrences"), F.array_join(F.array_sort(F.collect_set(F.col(evidence).cast("string"))), ",").alias("evidence"))

"""Which tables of the loops go through the driver."""

from __future__ import annotations

from lemmaflow.operators import metrics
from lemmaflow.plans import graph, rules, tags
from pyspark.sql import functions as F


def broadcasts(spark, run) -> int:
    """How many of the plans that ``run`` executes hold a broadcast."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    plans = store.executionsList()
    return sum("BroadcastExchange" in plans.apply(k).physicalPlanDescription() for k in range(before, plans.size()))


def test_contexts_are_not_broadcast(spark):
    """contexts with their texts, and what is known of their commands, were collected on the driver in each round."""
    units = spark.createDataFrame([("a", "\\tagtrue{x}\\iftag{x}{\\olimport{b}}{}"), ("b", "\\begin{tagblock}{x}y\\end{tagblock}")], "unit string, content string")
    contexts = units.select(F.col("unit").alias("context"), "unit", "content", F.create_map(F.lit("x"), F.lit(False)).alias("tags"))
    assert broadcasts(spark, lambda: tags.evaluated(contexts, tags.tokens(units))) == 0


def test_greedy_edges_are_not_broadcast(spark):
    """bounds, refused edges and components of each round were collected on the driver."""
    edges = spark.createDataFrame([(5 * k + i, 5 * k + (i + 1) % 5, 7 * (5 * k + i) % 101) for k in range(6) for i in range(5)], "src long, dst long, seq long")
    assert broadcasts(spark, lambda: graph.greedy_acyclic(edges)) == 0


def test_rules_are_not_broadcast(spark):
    """the keys that rows refer to were collected on the driver, once for each rule, and so were the nodes on cycles."""
    units = spark.createDataFrame([("c", f"u{k}") for k in range(9)], "component string, unit string")
    cited = spark.createDataFrame([("c", f"u{k}", f"n{k}") for k in range(0, 12, 2)], "component string, cited string, node string")
    found = []
    assert broadcasts(spark, lambda: found.extend(rules.refers(cited, "r", "node", ["component", "cited"], units, ["component", "unit"]).collect())) == 0
    assert [tuple(r) for r in found] == [("r", "n10", "c|u10")]
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 0), (3, 3), (4, 3)], "src long, dst long")
    cycles = []
    assert broadcasts(spark, lambda: cycles.extend(rules.acyclic(nodes, edges, "a").collect())) == 0
    assert sorted(r.entity for r in cycles) == ["0", "1", "3"]
    routes = spark.createDataFrame([("c", "t1", "proof", ["e1"]), ("c", "t2", "proof", ["e2"])], "component string, theorem string, kind string, dependency_ids array<string>")
    uses = spark.createDataFrame([("c", "e1", "node", "t2"), ("c", "e2", "node", "a")], "component string, dependency string, prerequisite_type string, prerequisite string")
    kinds = spark.createDataFrame([("c", "t1", "theorem-like"), ("c", "t2", "theorem-like"), ("c", "a", "source-artifact")], "component string, node string, node_class string")
    routed = []
    assert broadcasts(spark, lambda: routed.extend(metrics.routed_theorems(routes, uses, kinds).collect())) == 0
    assert [tuple(r) for r in routed] == [("c", "t1")]

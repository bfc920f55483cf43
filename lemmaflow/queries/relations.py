"""Queries of joins, metrics, merges, graphs and rules on the driver's tables.

The part graph stands in for a book graph: nodes are parts, classes follow from p_size,
and part k depends on k div 2 and on k div 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..operators import joins, merge, metrics
from ..plans import graph, rules
from ..sources import shards
from .scalars import query


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 5 == 0, "source-artifact").when(F.col("p_size") % 3 != 0, "theorem-like").otherwise("support")
    return table(spark, d, "part").select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("node"), kind.alias("node_class"), "p_size")


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    ends = F.array(F.when(key > 1, F.floor(key / 2)), F.when(key > 2, F.floor(key / 3)))
    rows = table(spark, d, "part").select(key.alias("src"), F.posexplode(ends).alias("seq", "dst"))
    return rows.where("dst is not null").groupBy("src", "dst").agg(F.min("seq").alias("seq"))


_EDGES = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, 0 AS seq FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey > 2), g AS (SELECT src, dst, min(seq) AS seq FROM e GROUP BY ALL)"
_NODES = "n AS (SELECT p_brand AS component, p_partkey AS node, CASE WHEN p_size % 5 = 0 THEN 'source-artifact' WHEN p_size % 3 <> 0 THEN 'theorem-like' ELSE 'support' END AS cls FROM part)"
_METRICS = f"""{_EDGES}, {_NODES},
r AS (SELECT node, node % 11 = 0 AS root FROM n WHERE cls = 'theorem-like' AND node % 7 <> 0),
based AS (SELECT DISTINCT r.node FROM r WHERE root UNION SELECT r.node FROM r JOIN g ON g.src = r.node JOIN n p ON p.node = g.dst WHERE p.cls <> 'source-artifact' AND NOT root),
m AS (SELECT component, count(*) FILTER (WHERE cls = 'theorem-like') AS theorem_count, count(*) FILTER (WHERE cls = 'theorem-like' AND node NOT IN (SELECT node FROM r)) AS unrouted_count,
count(*) FILTER (WHERE cls = 'theorem-like' AND node NOT IN (SELECT node FROM based)) AS pending_count, count(*) FILTER (WHERE cls = 'support') AS support_count, count(*) FILTER (WHERE cls = 'source-artifact') AS artifact_count FROM n GROUP BY component),
d AS (SELECT component, count(*) AS dependency_count, count(*) FILTER (WHERE (src + dst) % 2 = 0) AS reviewed_dependency_count FROM g JOIN n ON n.node = g.src GROUP BY component),
u AS (SELECT component, count(*) FILTER (WHERE node % 13 = 0) AS unresolved_count FROM n GROUP BY component),
w AS (SELECT m.*, coalesce(dependency_count, 0) AS dependency_count, coalesce(reviewed_dependency_count, 0) AS reviewed_dependency_count, unresolved_count FROM m LEFT JOIN d USING (component) JOIN u USING (component))"""


@query(f"WITH {_METRICS} SELECT * FROM w")
def agg_manifest_metrics(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = part_nodes(spark, d), part_edges(spark, d)
    owner = nodes.select("component", F.col("node").alias("src"))
    prerequisites = nodes.select(F.col("node").alias("dst"), F.lit("node").alias("prerequisite_type"))
    named = edges.join(owner, "src").join(prerequisites, "dst").withColumn("dependency", F.concat_ws("-", "src", "dst"))
    dependencies = named.select("component", "dependency", "prerequisite_type", F.col("dst").alias("prerequisite"), ((F.col("src") + F.col("dst")) % 2 == 0).alias("reviewed"))
    theorem = nodes.where("node_class = 'theorem-like' and node % 7 <> 0").select("component", F.col("node").alias("theorem"), F.when(F.col("node") % 11 == 0, "root-attestation").otherwise("proof").alias("kind"))
    used = named.groupBy(F.col("src").alias("theorem")).agg(F.collect_list("dependency").alias("used"))
    routes = theorem.join(used, "theorem", "left").select("component", "theorem", "kind", F.when(F.col("kind") == "proof", F.coalesce("used", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("dependency_ids"))
    # prerequisites lie in any component, so that every node is known to all of them here
    everywhere = nodes.select("node", "node_class")
    in_use = dependencies.join(everywhere.withColumnRenamed("node", "prerequisite"), "prerequisite").select("component", F.col("prerequisite").alias("node"), "node_class").distinct()
    routed = metrics.routed_theorems(routes, dependencies, in_use)
    counted = metrics.manifest_metrics(nodes, dependencies, routes, nodes.select("component", (F.col("node") % 13 == 0).alias("unresolved")))
    theorems = nodes.where("node_class = 'theorem-like'").join(routed.withColumnRenamed("theorem", "node"), ["component", "node"], "left_anti")
    pending = theorems.groupBy("component").agg(F.count("*").alias("pending"))
    return counted.join(pending, "component", "left").withColumn("pending_count", F.coalesce("pending", F.lit(0))).drop("pending")


@query(f"""WITH {_METRICS} SELECT count(*) AS components, sum(theorem_count)::BIGINT AS theorem_count, sum(unrouted_count)::BIGINT AS unrouted_count, sum(pending_count)::BIGINT AS pending_count, sum(support_count)::BIGINT AS support_count,
sum(artifact_count)::BIGINT AS artifact_count, sum(dependency_count)::BIGINT AS dependency_count, sum(reviewed_dependency_count)::BIGINT AS reviewed_dependency_count, sum(unresolved_count)::BIGINT AS unresolved_count FROM w""")
def agg_manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.manifest_summary(agg_manifest_metrics(spark, d))


@query("""SELECT user_id, string_agg(n || ' ' || event_type, ', ' ORDER BY first) AS statuses FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id""")
def agg_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.status_rollup(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE every) AS complete, count(*) FILTER (WHERE any_back) AS partly FROM (SELECT o_custkey, o_orderkey, bool_and(l_linestatus = 'F') AS every, bool_or(l_returnflag = 'R') AS any_back FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey""")
def agg_coverage_quantifiers(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("every"), F.bool_or(F.col("l_returnflag") == "R").alias("some"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if("every").alias("complete"), F.count_if("some").alias("partly"))


@query("""SELECT l_orderkey, l_suppkey, count(*) AS occurrences, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS evidence FROM lineitem GROUP BY ALL""")
def agg_edge_groups(spark: SparkSession, d: str) -> DataFrame:
    return metrics.edge_groups(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), "l_orderkey", "l_suppkey", "l_partkey")


@query("""SELECT o_custkey, coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'), min(o_orderkey) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '2%'), min(o_orderkey) FILTER (WHERE o_orderstatus = 'F')) AS route FROM orders GROUP BY o_custkey""")
def prj_preferred_route(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.startswith("o_orderpriority", F.lit("1")), "minimized").when(F.startswith("o_orderpriority", F.lit("2")), "original").otherwise("other")
    route = F.struct(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("open").alias("status"))
    routes = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(route)).alias("routes"))
    return routes.select("o_custkey", metrics.preferred_route(F.col("routes"))["id"].alias("route"))


@query("""WITH s AS (SELECT s_suppkey AS own, s_nationkey AS nation, s_suppkey % 97 AS code FROM supplier), c AS (SELECT c_custkey AS other, c_nationkey + 1000 * (c_custkey % 40) AS nation, c_custkey % 997 AS code FROM customer)
SELECT own, other, CASE WHEN s.code = c.code AND s.nation = c.nation THEN 'code,nation' WHEN s.code = c.code THEN 'code' ELSE 'nation' END AS kinds FROM s JOIN c ON s.code = c.code OR s.nation = c.nation""")
def join_multi_key_match(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 97).alias("b"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") + 1000 * (F.col("c_custkey") % 40)).alias("a"), (F.col("c_custkey") % 997).alias("b"))
    return joins.any_key_matches(left, right, "key", {"nation": (F.col("a"), F.col("a")), "code": (F.col("b"), F.col("b"))})


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi_connected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def join_anti_unrouted(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
    return table(spark, d, "part").select("p_partkey").join(returned, F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@query("""SELECT event_id, CASE WHEN m.event_type = 'signup' THEN m.event_id END AS owner_of FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'error') THEN {'event_type': event_type, 'event_id': event_id} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE event_type = 'purchase'""")
def join_asof_owner(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    owned = joins.preceding(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error", "event_id")
    return owned.where("event_type = 'purchase'").select("event_id", "owner_of")


@query("""WITH p AS (SELECT l_suppkey AS k, l_partkey AS spot, l_orderkey, l_linenumber FROM lineitem), r AS (SELECT l_suppkey AS k, l_partkey AS s, l_partkey + (l_orderkey % 50) AS e, l_orderkey AS name FROM lineitem WHERE l_linenumber = 1),
b AS (SELECT x.k, spot, max({'s': s, 'name': name}).name AS name FROM (SELECT DISTINCT k, spot FROM p) x JOIN r ON x.k = r.k AND spot >= s AND spot < e GROUP BY x.k, spot) SELECT k, spot, l_orderkey, l_linenumber, name FROM p LEFT JOIN b USING (k, spot)""")
def join_interval_innermost(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("spot"), "l_orderkey", "l_linenumber")
    ranges = lines.where("l_linenumber = 1").select("k", F.col("spot").alias("s"), (F.col("spot") + F.col("l_orderkey") % 50).alias("e"), F.col("l_orderkey").alias("name"))
    return joins.innermost(lines, ranges, ["k"], "spot", "s", "e", ["name"])


@query("""WITH x AS (SELECT DISTINCT left(p_name, n::INTEGER) AS prefix FROM part, unnest([3, 5, 8]) AS t(n) WHERE length(p_name) >= n)
SELECT p_partkey, n, arg_max(prefix, length(prefix)) AS matched FROM part, unnest([2, 4, 6, 20]) AS u(n) LEFT JOIN x ON starts_with(left(p_name, n::INTEGER), prefix) GROUP BY p_partkey, n""")
def join_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    prefixes = parts.select("p_name", F.explode(F.array(F.lit(3), F.lit(5), F.lit(8))).alias("n")).where("length(p_name) >= n").select(F.left("p_name", F.col("n")).alias("prefix"))
    rows = parts.select("p_partkey", "p_name", F.explode(F.array(*[F.lit(n) for n in (2, 4, 6, 20)])).alias("n")).withColumn("p_name", F.left("p_name", F.col("n")))
    return joins.longest_prefix(rows, "p_name", prefixes, "prefix").drop("p_name")


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey AS k, 'new ' || c_name AS name, c_nationkey + 1 AS nation FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, greatest(a.nation, b.nation) AS nation, a.k IS NULL AS added FROM a FULL JOIN b ON a.k = b.k""")
def mrg_upsert_existing_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    mine = rows.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"))
    new = rows.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit("new "), "c_name").alias("name"), (F.col("c_nationkey") + 1).alias("nation"))
    return merge.upsert(mine, new, "k", {"nation": F.greatest})


@query("""WITH e AS (SELECT event_id, user_id AS citing, event_id % 7 AS cited, ['uncertain', 'provider-linked', 'exact-id', 'manual-reviewed'][CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 1 ELSE 4 END] AS confidence, event_type FROM events)
SELECT citing, cited, min(event_id) AS edge_id, ['uncertain', 'provider-linked', 'exact-id', 'manual-reviewed'][max(list_position(['uncertain', 'provider-linked', 'exact-id', 'manual-reviewed'], confidence))] AS confidence,
(SELECT string_agg(event_type, ',' ORDER BY first) FROM (SELECT event_type, min(event_id) AS first FROM e x WHERE x.citing = e.citing AND x.cited = e.cited GROUP BY event_type)) AS provenance FROM e GROUP BY citing, cited""")
def mrg_edge_confidence_max(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind.isin("view", "error"), 1).when(kind == "click", 2).when(kind == "signup", 3).otherwise(4)
    edges = table(spark, d, "events").select(F.col("event_id").alias("edge_id"), F.col("user_id").alias("citing"), (F.col("event_id") % 7).alias("cited"), F.element_at(F.array(*[F.lit(c) for c in merge.CONFIDENCE]), level).alias("confidence"), F.array("event_type").alias("provenance"), F.col("event_id").alias("seq"))
    return merge.merge_edges(edges).select("citing", "cited", "edge_id", "confidence", F.array_join("provenance", ",").alias("provenance"))


@query("""WITH o AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id)
SELECT user_id, CASE event_type WHEN 'purchase' THEN 'complete-direct-neighborhood' WHEN 'view' THEN 'metadata-fetched' WHEN 'click' THEN 'neighbors-fetched' ELSE 'metadata-fetched' END AS state,
CASE event_type WHEN 'purchase' THEN '' WHEN 'view' THEN 'fetch-outgoing' WHEN 'click' THEN 'deduplicate,review-match' ELSE 'fetch-outgoing,fetch-incoming,deduplicate' END AS tasks, 1 AS attempts, event_id AS updated_at FROM o""")
def stm_queue_transition(spark: SparkSession, d: str) -> DataFrame:
    kind = F.max_by("event_type", "event_id")
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("paper_id")).agg(kind.alias("kind"), F.max("event_id").alias("at"))
    outcome = F.when(F.col("kind") == "purchase", "complete").when(F.col("kind") == "view", "incomplete").when(F.col("kind") == "click", "audited").otherwise("failed")
    outcomes = last.select("paper_id", outcome.alias("outcome"), "at")
    empty = last.limit(0).select("paper_id", F.lit("").alias("state"), F.array(F.lit("")).alias("tasks"), F.lit(0).alias("attempts"), F.col("at").alias("updated_at"))
    queue = merge.discovered(empty, outcomes.select("paper_id", F.col("at").alias("updated_at")))
    return merge.apply_outcomes(queue, outcomes).select(F.col("paper_id").alias("user_id"), "state", F.array_join("tasks", ",").alias("tasks"), "attempts", "updated_at")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS tasks FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def mrg_task_union(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    odd, even = (events.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.collect_set("event_type").alias("tasks")) for k in (1, 0))
    both = merge.upsert(odd, even, "user_id", {"tasks": lambda a, b: merge.merge_tasks(F.lit("open"), a, b)})
    return both.select("user_id", F.array_join(F.array_sort("tasks"), ",").alias("tasks"))


@query(f"WITH RECURSIVE {_EDGES}, r(root, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT root, dst FROM r JOIN g ON g.src = r.node) SELECT root, node FROM r")
def grf_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(part_edges(spark, d), part_nodes(spark, d).select(F.col("node").alias("root"))).select("root", "node")


@query(f"WITH {_EDGES} SELECT dst AS node, count(*) AS dependents FROM g GROUP BY dst")
def grf_dependents(spark: SparkSession, d: str) -> DataFrame:
    return part_edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependents"))


@query(f"""WITH {_EDGES}, l1 AS (SELECT dst AS root, src AS node, row_number() OVER (PARTITION BY dst ORDER BY src) AS nth FROM g), k1 AS (SELECT root, node, nth FROM l1 WHERE nth <= 7),
c AS (SELECT root, count(*) + 1 AS seen FROM k1 GROUP BY root), x AS (SELECT root, g.src AS node, min({{'p': nth, 's': g.src}}) AS spot FROM k1 JOIN g ON g.dst = k1.node GROUP BY root, g.src),
l2 AS (SELECT x.root, x.node, seen, row_number() OVER (PARTITION BY x.root ORDER BY spot) AS nth FROM x JOIN c USING (root) WHERE NOT EXISTS (SELECT 1 FROM k1 WHERE k1.root = x.root AND k1.node = x.node) AND x.node <> x.root)
SELECT p_partkey AS root, p_partkey AS node, 0 AS depth, 1::BIGINT AS position FROM part UNION ALL SELECT root, node, 1, nth + 1 FROM k1 UNION ALL SELECT root, node, 2, seen + nth FROM l2 WHERE seen + nth <= 8""")
def grf_bounded_bfs(spark: SparkSession, d: str) -> DataFrame:
    back = part_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("seq", F.col("dst"))
    found = graph.bounded_search(back, part_nodes(spark, d).select(F.col("node").alias("root")), 2, 8)
    return found.withColumn("position", F.col("position").cast("long"))


@query(f"WITH RECURSIVE {_EDGES}, r(node, level) AS (SELECT p_partkey, 0 FROM part UNION SELECT src, level + 1 FROM r JOIN g ON g.dst = r.node) SELECT node, max(level) AS level FROM r GROUP BY node")
def grf_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.peel(part_nodes(spark, d), part_edges(spark, d))[0]


@query(f"WITH RECURSIVE {_EDGES}, h AS (SELECT src, dst FROM g UNION SELECT 3, 100), r(root, node) AS (SELECT src, dst FROM h UNION SELECT root, dst FROM r JOIN h ON h.src = r.node) SELECT root AS node FROM r WHERE root = node")
def grf_cycle_residue(spark: SparkSession, d: str) -> DataFrame:
    back = spark.createDataFrame([(3, 100)], "src long, dst long")
    return graph.on_cycles(part_nodes(spark, d).select("node"), part_edges(spark, d).select("src", "dst").unionByName(back))


@query(f"WITH RECURSIVE {_EDGES}, r(root, node) AS (SELECT src, dst FROM g UNION SELECT root, dst FROM r JOIN g ON g.src = r.node) SELECT DISTINCT g.src, g.dst FROM g JOIN g f ON f.src = g.src JOIN r ON r.root = f.dst AND r.node = g.dst")
def grf_transitive_reduction(spark: SparkSession, d: str) -> DataFrame:
    return graph.redundant_edges(part_edges(spark, d))


@query(f"WITH RECURSIVE {_EDGES}, r(node) AS (SELECT p_partkey FROM part WHERE contains(p_name, 'cold') UNION SELECT src FROM r JOIN g ON g.dst = r.node) SELECT node FROM r")
def flt_ancestor_filter(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "part").where(F.contains("p_name", F.lit("cold"))).select(F.col("p_partkey").alias("node"))
    return graph.keeps_ancestors(part_nodes(spark, d).select("node"), part_edges(spark, d), hits)


@query(f"""WITH RECURSIVE {_EDGES}, w(root, node, path) AS (SELECT p_partkey, p_partkey, []::INTEGER[] FROM part UNION ALL SELECT root, dst, list_append(path, seq) FROM w JOIN g ON src = node),
b AS (SELECT root, node, min(path) AS path FROM w GROUP BY root, node)
SELECT root, node, (row_number() OVER (PARTITION BY root ORDER BY list_append(path, 9)))::INTEGER AS position FROM b""")
def grf_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.reading_order(part_edges(spark, d), part_nodes(spark, d).select(F.col("node").alias("root")))


@query("WITH RECURSIVE c(node, last) AS (SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey > 0 UNION ALL SELECT node, last // 5 FROM c WHERE last > 0) SELECT node, last, false AS broken FROM c WHERE last = 0")
def grf_pointer_chains(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return graph.end_of_chain(table(spark, d, "part").where(key > 0).select(key.alias("node"), F.floor(key / 5).alias("next")))


@query("SELECT 'order-once' AS rule, o_custkey || '|' || o_orderdate::DATE AS entity, count(*)::VARCHAR AS detail FROM orders GROUP BY o_custkey, o_orderdate::DATE HAVING count(*) > 1")
def val_unique(spark: SparkSession, d: str) -> DataFrame:
    return rules.unique(table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), "order-once", ["o_custkey", "day"])


@query("SELECT 'line-part' AS rule, l_orderkey::VARCHAR AS entity, l_partkey::VARCHAR AS detail FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 3)")
def val_referential(spark: SparkSession, d: str) -> DataFrame:
    return rules.refers(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "line-part", "l_orderkey", ["l_partkey"], table(spark, d, "part").where("p_size > 3"), ["p_partkey"])


@query("SELECT 'turn-order' AS rule, conv_id::VARCHAR AS entity, turn::VARCHAR AS detail FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role <> 'system') WHERE turn <> r")
def val_contiguous_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return rules.contiguous(table(spark, d, "conversations").where("role <> 'system'").select("conv_id", "turn"), "turn-order", ["conv_id"], "turn")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), s(source, r, doc_id, shard, held) AS (SELECT source, r, doc_id, 0, size FROM o WHERE r = 1
UNION ALL SELECT o.source, o.r, o.doc_id, CASE WHEN held + size > 50000 THEN shard + 1 ELSE shard END, CASE WHEN held + size > 50000 THEN size ELSE held + size END FROM s JOIN o ON o.source IS NOT DISTINCT FROM s.source AND o.r = s.r + 1) SELECT doc_id, shard FROM s""")
def snk_greedy_shards(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return shards.assign(sizes, ["source"], "doc_id", "n_chars", 50_000).select("doc_id", "shard")

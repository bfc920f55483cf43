"""Queries of TeX helpers, regions of lines and the manifest on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..functions import tex
from ..operators import regions
from ..plans import manifest
from .relations import part_edges
from .scalars import query


def _key() -> Column:
    return F.col("p_partkey")


@query(r"""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Explicit source reference on line ' || p_partkey || '.' ELSE 'By [reference] and [citation] the ' || p_name || ' holds.' END AS context,
'The ' || p_name || ' is' || chr(10) || 'clear.' AS body, CASE WHEN p_size % 2 = 0 THEN 'A ' || p_name END AS slogan FROM part""")
def txt_tex_parts(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    line = F.when(F.col("p_size") % 4 == 0, F.lit("  % only a comment")).otherwise(F.concat(F.lit("  By \\ref{lem-"), _key().cast("string"), F.lit("} and \\cite[p. 3]{key}   the "), name, F.lit(" holds. % not \\ref{x}")))
    proof = F.concat(F.lit("\n\\begin{proof}[Of it]  The   "), name, F.lit(" is  \n  clear.\n\\end{proof} \n"))
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x\\begin{slogan}\n A "), name, F.lit(".\n\\end{slogan}y"))).otherwise("no slogan")
    return table(spark, d, "part").select("p_partkey", tex.line_context(line, _key()).alias("context"), tex.proof_body(proof).alias("body"), tex.slogan(raw).alias("slogan"))


@query(r"""SELECT p_partkey, i AS n, CASE i WHEN 1 THEN p_size % 2 = 0 ELSE false END AS starred, CASE i WHEN 1 THEN 'a [b' WHEN 2 THEN '' ELSE '' END AS optional, CASE i WHEN 1 THEN 'k' || p_partkey || '{x}' WHEN 2 THEN '\alpha' ELSE 'z' END AS required FROM part, unnest([1, 2, 3]) AS t(i)""")
def txt_invocations(spark: SparkSession, d: str) -> DataFrame:
    star = F.when(F.col("p_size") % 2 == 0, "*").otherwise("")
    source = F.concat(F.lit("\\use"), star, F.lit(" [a [b]]{k"), _key().cast("string"), F.lit("{x}} text \\useful{no} \\use \\alpha rest \\use z \\use{never closed"))
    source = F.replace(source, F.lit("[a [b]]"), F.lit("[a \\[b]"))
    found = table(spark, d, "part").select("p_partkey", F.posexplode(tex.invocations(source, "use", optional=1, required=1, star=True)).alias("n", "u"))
    return found.select("p_partkey", (F.col("n") + 1).alias("n"), "u.starred", F.replace(F.array_join("u.optional", "|"), F.lit("\\["), F.lit("[")).alias("optional"), F.array_join("u.required", "|").alias("required"))


@query("""SELECT p_partkey, 'a{b,c}|' || p_name || '|d' AS parts, 'content/x/' || p_brand || '.tex' AS starred, 'dir/' || p_brand || '.tex' AS plain, 'own:one:' || p_size || ':lab' AS target, 'a%20b%2F' || p_size || '!' AS anchor, sha256('[["a",true],["b",false]]') AS digest, p_size % 2 = 0 AS matched,
CASE WHEN p_size % 3 = 0 THEN p_size ELSE -1 END AS number FROM part""")
def txt_import_helpers(spark: SparkSession, d: str) -> DataFrame:
    size, none = F.col("p_size").cast("string"), F.lit(None).cast("string")
    tags = F.create_map(F.lit("b"), F.lit(False), F.lit("a"), F.lit(True))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(tex.split_top_level(F.concat(F.lit(" a{b,c} ,, "), "p_name", F.lit(" , d"))), "|").alias("parts"),
        tex.resolve_import(F.lit("dir/sub/owner.tex"), F.lit("x/y/.."), F.col("p_brand"), F.lit(True)).alias("starred"), tex.resolve_import(F.lit("dir/sub/owner.tex"), F.lit(".."), F.concat("p_brand", F.lit(".tex")), F.lit(False)).alias("plain"),
        tex.reference_target(F.array(F.lit("own"), F.lit("one"), F.lit("two")), F.array(F.concat(F.lit(" "), size)), F.lit(" lab ")).alias("target"), tex.encoded_anchor(F.concat(F.lit("a b/"), size, F.lit("!"))).alias("anchor"),
        tex.tag_digest(tags).alias("digest"), tex.tags_match(tags, F.when(F.col("p_size") % 2 == 0, "b, a").otherwise("b,c")).alias("matched"),
        tex.whole_number(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), size)).otherwise(F.concat(size, F.lit("x"))), -1).alias("number"),
    )


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '2024-05-06 07:08:09' WHEN 1 THEN '2023-04-05 06:07:00' END AS value, CASE p_size % 3 WHEN 0 THEN 'generator-comment' WHEN 1 THEN 'source-filename' END AS basis, CASE WHEN p_size % 2 = 0 THEN p_name || ': Sub, Second' ELSE p_name || ' Second: Sub' END AS edition FROM part""")
def txt_export_stamp(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    xml = F.when(size % 3 == 0, '<?xml?><!-- generator="Press/6" created="2024-05-06T07:08:09" -->').otherwise("<rss/>")
    address = F.when(size % 3 == 1, "https://h.org/book-2023-04-05_06-07.xml").otherwise("https://h.org/book.xml")
    stamp = tex.export_timestamp(xml, address)
    title = F.when(size % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("  Second")))
    return table(spark, d, "part").select("p_partkey", stamp["value"].alias("value"), stamp["basis"].alias("basis"), tex.edition_label(title, F.lit(" Sub "), F.lit("Second")).alias("edition"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as units: a turn of a user opens a section or subsection, assistants speak in prose."""
    first = F.when((F.col("turn") % 4) == 0, "\\section{A}").when(F.col("role") == "user", "\\subsection{B}").otherwise(F.when(F.col("turn") % 3 == 0, "").otherwise("prose"))
    return table(spark, d, "conversations").select(F.lit("c").alias("component"), F.col("conv_id").alias("unit"), (F.col("turn") + 1).cast("int").alias("line"), first.alias("text"))


_LINES = """l AS (SELECT conv_id AS unit, (turn + 1)::INTEGER AS line, CASE WHEN turn % 4 = 0 THEN 1 WHEN role = 'user' THEN 2 END AS rank, turn % 4 <> 0 AND role <> 'user' AND turn % 3 = 0 AS empty FROM conversations)"""


@query(f"""WITH {_LINES}, h AS (SELECT a.unit, a.line AS start_line, a.rank, coalesce((SELECT min(b.line) - 1 FROM l b WHERE b.unit = a.unit AND b.line > a.line AND b.rank <= a.rank), (SELECT max(line) FROM l b WHERE b.unit = a.unit)) AS stop FROM l a WHERE rank IS NOT NULL)
SELECT unit, start_line, (SELECT max(line) FROM l WHERE l.unit = h.unit AND line BETWEEN start_line AND stop AND NOT empty) AS end_line, rank FROM h""")
def ext_section_ranges(spark: SparkSession, d: str) -> DataFrame:
    return regions.section_ranges(_lines(spark, d)).select("unit", "start_line", "end_line", "rank")


@query(f"""WITH {_LINES} SELECT unit, line, coalesce((SELECT max(b.line) FROM l b WHERE b.unit = l.unit AND b.line < l.line AND (b.empty OR b.rank IS NOT NULL)), 0) + 1 AS start_line,
coalesce((SELECT min(b.line) - 1 FROM l b WHERE b.unit = l.unit AND b.line > l.line AND (b.empty OR b.rank IS NOT NULL)), (SELECT max(line) FROM l b WHERE b.unit = l.unit)) AS end_line FROM l WHERE rank IS NULL AND NOT empty""")
def ext_prose_ranges(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return regions.prose_ranges(lines, lines.where("text = 'prose'").select("component", "unit", "line")).select("unit", "line", "start_line", "end_line")


@query(f"""WITH {_LINES} SELECT unit, line AS node, greatest(coalesce((SELECT max(b.line) FROM l b WHERE b.unit = l.unit AND b.line < l.line AND b.rank IS NOT NULL), 0), coalesce((SELECT max(b.line) FROM l b WHERE b.unit = l.unit AND b.line < l.line AND b.empty), 0)) + 1 AS start_line, line - 1 AS end_line FROM l WHERE rank IS NULL AND NOT empty""")
def ext_discussion_regions(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    owners = lines.where("text = 'prose'").select("component", "unit", F.col("line").alias("node"), F.col("line").alias("start_line"))
    proofs = lines.where("text = ''").select("component", "unit", F.col("line").alias("end_line"))
    return regions.discussion_regions(lines, owners, proofs).select("unit", "node", "start_line", "end_line")


@query("""WITH h AS (SELECT user_id AS unit, event_id AS position, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS level, event_type FROM events)
SELECT unit, position AS start, coalesce((SELECT min(b.position) FROM h b WHERE b.unit = h.unit AND b.position > h.position AND b.level <= h.level), 1000000) AS "end" FROM h WHERE event_type IN ('error', 'click')""")
def ext_proof_regions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    title = F.when(kind == "error", "Why it's true: x").when(kind == "click", "PROOF of it").otherwise("Proofreading")
    heads = table(spark, d, "events").select(F.lit("c").alias("component"), F.col("user_id").alias("unit"), F.col("event_id").alias("position"), F.when(kind == "view", 1).when(kind == "click", 2).otherwise(3).alias("level"), title.alias("title"), F.lit(1000000).cast("long").alias("length"))
    return regions.proof_regions(heads).select("unit", "start", "end")


@query("""WITH r AS (SELECT o_orderkey AS proof, o_custkey AS a, o_orderkey // 3 AS b FROM orders), n AS (SELECT c_custkey AS lab, c_custkey AS node FROM customer WHERE c_mktsegment <> 'FURNITURE'),
m AS (SELECT proof, node FROM r JOIN n ON lab = a UNION ALL SELECT proof, node FROM r JOIN n ON lab = b) SELECT proof, min(node) AS owner FROM m GROUP BY proof HAVING count(DISTINCT node) = 1""")
def join_explicit_owner(spark: SparkSession, d: str) -> DataFrame:
    title = F.format_string("Proof of \\ref{l%d} and \\ref{l%d}", F.col("o_custkey"), F.floor(F.col("o_orderkey") / 3))
    proofs = table(spark, d, "orders").select(F.lit("c").alias("component"), F.col("o_orderkey").alias("proof"), title.alias("title"))
    labels = table(spark, d, "customer").select(F.lit("c").alias("component"), F.format_string("l%d", F.col("c_custkey")).alias("label"), F.col("c_custkey").alias("node"), F.when(F.col("c_mktsegment") == "FURNITURE", "support").otherwise("theorem-like").alias("node_class"))
    return regions.explicit_owners(proofs, labels).select("proof", "owner")


@query("""SELECT l_suppkey AS owner, l_partkey AS key, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS pinpoint, count(*) AS occurrences FROM lineitem GROUP BY ALL""")
def agg_citation_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("key"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("pinpoint"), F.col("l_linenumber").alias("line"))
    return regions.citation_groups(rows).drop("lines")


@query("""SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) = 1""")
def join_single_targets(spark: SparkSession, d: str) -> DataFrame:
    return regions.single_targets(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query("""SELECT user_id AS owner, event_type AS target, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS occurrences FROM events GROUP BY ALL""")
def agg_semantic_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("target"), F.col("event_id").alias("seq"), F.array(F.col("event_id").cast("string")).alias("occurrences"), F.array(F.lit(1)).alias("proof_lines"))
    return regions.semantic_groups(groups).select("owner", "target", F.array_join("occurrences", ",").alias("occurrences"))


@query("""WITH e AS (SELECT DISTINCT p_partkey AS owner, p_partkey // 2 AS target FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2)
SELECT owner, target FROM e JOIN part a ON a.p_partkey = owner JOIN part b ON b.p_partkey = target WHERE NOT (b.p_size < a.p_size OR (b.p_size = a.p_size AND b.p_partkey < a.p_partkey))""")
def val_target_precedes(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "part").select(_key().alias("node"), F.col("p_size").alias("unit_order"), _key().alias("start"))
    return regions.not_preceding(part_edges(spark, d).select(F.col("src").alias("owner"), F.col("dst").alias("target")), places)


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, lower(o_orderpriority), o_orderpriority, o_orderkey) AS position FROM orders""")
def ord_catalogue(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    papers = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "gold").otherwise("other").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("title"))
    return papers.select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(*regions.catalogue(papers), F.col("o_orderkey"))).cast("long").alias("position"))


def _graph_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Nations are components, customers nodes, orders routes and dependencies, suppliers references."""
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    evidence = lambda c: F.struct(c.alias("status")).alias("evidence")
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    seg = F.col("c_mktsegment")
    nodes = customer.select(name("c_nationkey").alias("component"), F.col("c_custkey").alias("node"), F.when(seg == "BUILDING", "support").when(seg == "FURNITURE", "source-artifact").otherwise("theorem-like").alias("node_class"))
    owned = orders.join(customer.select("c_custkey", name("c_nationkey").alias("component"), seg.alias("seg")), F.col("o_custkey") == F.col("c_custkey"))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    dependency = owned.select("component", F.col("o_orderkey").alias("dependency"), F.when(s == "P", "external-input").otherwise("node").alias("prerequisite_type"), F.col("o_custkey").alias("prerequisite"), evidence(F.when(s == "F", "reviewed").otherwise("captured")))
    route = owned.where(~F.col("seg").isin("BUILDING", "FURNITURE") & (p != "5-LOW")).select("component", F.col("o_custkey").alias("theorem"), F.when(p == "1-URGENT", "root-attestation").otherwise("proof").alias("kind"), F.when(p == "2-HIGH", F.array("o_orderkey")).otherwise(F.array().cast("array<bigint>")).alias("dependency_ids"))
    units = table(spark, d, "supplier").select(name("s_nationkey").alias("component"), F.col("s_suppkey").alias("unit"), "s_acctbal")
    status = F.when(F.col("s_acctbal") < 2000, "pending").when(F.col("s_acctbal") < 6000, "captured").otherwise("reviewed")
    component = table(spark, d, "nation").where("n_nationkey <> 4").select(name("n_nationkey").alias("component"), F.when(F.col("n_regionkey") == 0, "awaiting-edition").when(F.col("n_regionkey") == 1, "reviewed").otherwise("extracted").alias("extraction_status"), F.when(F.col("n_regionkey") == 1, "reviewed-complete").otherwise("candidate").alias("graph_status"), F.when(F.col("n_regionkey") != 0, F.lit("e")).alias("edition"))
    return {
        "component": component, "node": nodes, "dependency": dependency, "proof_route": route, "source_unit": units.drop("s_acctbal"), "unit_inventory": units.select("component", "unit", evidence(status)),
        "reference": units.select("component", F.when(F.col("s_acctbal") < 5000, "unresolved").otherwise("resolved").alias("status")),
    }


_GRAPH_METRICS = """c AS (SELECT *, c_mktsegment NOT IN ('BUILDING', 'FURNITURE') AS thm FROM customer), r AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT DISTINCT o_custkey FROM orders JOIN c ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND (o_orderstatus = 'P' OR c_mktsegment <> 'FURNITURE'))),
nd AS (SELECT c_nationkey AS n, count(*) FILTER (WHERE thm) AS theorem_count, count(*) FILTER (WHERE thm AND c_custkey NOT IN (FROM r)) AS unrouted_count, count(*) FILTER (WHERE thm AND c_custkey NOT IN (FROM b)) AS pending_count, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS support_count, count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS artifact_count FROM c GROUP BY 1),
dp AS (SELECT c_nationkey AS n, count(*) AS dependency_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS reviewed_dependency_count FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
un AS (SELECT s_nationkey AS n, count(*) AS source_unit_count, count(*) FILTER (WHERE s_acctbal >= 2000) AS inventoried_unit_count, count(*) FILTER (WHERE s_acctbal >= 6000) AS reviewed_unit_count, count(*) FILTER (WHERE s_acctbal < 5000) AS unresolved_count FROM supplier GROUP BY 1),
m AS (SELECT 'n' || n_nationkey AS component, CASE n_regionkey WHEN 0 THEN 'awaiting-edition' WHEN 1 THEN 'reviewed' ELSE 'extracted' END AS extraction_status, CASE n_regionkey WHEN 1 THEN 'reviewed-complete' ELSE 'candidate' END AS graph_status, n_regionkey <> 0 AS edition_resolved,
coalesce(source_unit_count, 0) AS source_unit_count, coalesce(inventoried_unit_count, 0) AS inventoried_unit_count, coalesce(reviewed_unit_count, 0) AS reviewed_unit_count, coalesce(theorem_count, 0) AS theorem_count, coalesce(unrouted_count, 0) AS unrouted_count, coalesce(pending_count, 0) AS pending_count, coalesce(support_count, 0) AS support_count, coalesce(artifact_count, 0) AS artifact_count,
coalesce(dependency_count, 0) AS dependency_count, coalesce(reviewed_dependency_count, 0) AS reviewed_dependency_count, coalesce(unresolved_count, 0) AS unresolved_count FROM nation LEFT JOIN nd ON nd.n = n_nationkey LEFT JOIN dp ON dp.n = n_nationkey LEFT JOIN un ON un.n = n_nationkey WHERE n_nationkey <> 4)"""


@query(f"WITH {_GRAPH_METRICS} SELECT * FROM m")
def man_component_metrics(spark: SparkSession, d: str) -> DataFrame:
    return manifest.component_metrics(_graph_tables(spark, d))


def _manifest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("n_nationkey").cast("string")
    expected = table(spark, d, "nation").select(F.concat(F.lit("n"), key).alias("component"), F.lit("S0001").alias("record"), F.lit(1).alias("ordinal"), key.alias("component_id"), F.col("n_name").alias("label"), F.concat(F.lit("S0001/"), key, F.lit(".json")).alias("path"))
    metrics = manifest.component_metrics(_graph_tables(spark, d))
    entries = manifest.entries_of(expected, metrics, expected.where("component_id < '2'"))
    return expected, metrics, entries


@query(f"""WITH {_GRAPH_METRICS}, s AS (SELECT count(*) + 1 AS components, count(*) FILTER (WHERE edition_resolved) AS editions_resolved, count(*) FILTER (WHERE extraction_status = 'awaiting-edition') + 1 AS awaiting_edition, count(*) FILTER (WHERE extraction_status = 'reviewed') AS reviewed_extractions, count(*) FILTER (WHERE graph_status = 'reviewed-complete') AS complete_graphs,
sum(source_unit_count)::BIGINT AS source_unit_count, sum(inventoried_unit_count)::BIGINT AS inventoried_unit_count, sum(reviewed_unit_count)::BIGINT AS reviewed_unit_count, sum(theorem_count)::BIGINT AS theorem_count, sum(unrouted_count)::BIGINT AS unrouted_count, sum(pending_count)::BIGINT AS pending_count, sum(support_count)::BIGINT AS support_count,
sum(artifact_count)::BIGINT AS artifact_count, sum(dependency_count)::BIGINT AS dependency_count, sum(reviewed_dependency_count)::BIGINT AS reviewed_dependency_count, sum(unresolved_count)::BIGINT AS unresolved_count FROM m) SELECT * FROM s""")
def man_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifest.summary(_manifest(spark, d)[2])


@query("""WITH n AS (SELECT n_nationkey AS k, n_nationkey::VARCHAR AS i, n_name, n_regionkey AS r, n_nationkey::VARCHAR < '2' AS filed FROM nation)
SELECT 'entry-for-component' AS rule, 'n' || k AS entity, 'n' || k AS detail FROM n WHERE r = 3 UNION ALL SELECT 'entry-identity', 'n' || k, '' FROM n WHERE r = 2 UNION ALL SELECT 'artifact-path-safe', 'n' || k, '../' || i FROM n WHERE r = 1 AND filed UNION ALL SELECT 'artifact-path-canonical', 'n' || k, '../' || i FROM n WHERE r = 1 AND filed
UNION ALL SELECT 'metrics-current', 'n' || k, 'theorem_count' FROM n WHERE r = 0 AND filed UNION ALL SELECT 'file-in-manifest', 'S0001/' || i || '.json', 'S0001/' || i || '.json' FROM n WHERE NOT filed OR r IN (1, 3) UNION ALL SELECT 'file-present', 'n' || k, '../' || i FROM n WHERE r = 1 AND filed""")
def man_rules(spark: SparkSession, d: str) -> DataFrame:
    expected, metrics, entries = _manifest(spark, d)
    region = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("component"), F.col("n_regionkey").alias("r"))
    stored = entries.join(region, "component").where("r <> 3")
    stored = stored.withColumns({
        "label": F.when(F.col("r") == 2, "other").otherwise(F.col("label")), "artifact_path": F.when(F.col("artifact_path").isNotNull() & (F.col("r") == 1), F.concat(F.lit("../"), "component_id")).otherwise(F.col("artifact_path")),
        "theorem_count": F.when(F.col("r") == 0, F.col("theorem_count") + 1).otherwise(F.col("theorem_count")),
    }).drop("r")
    known = metrics.where("component <> 'n4'")
    return manifest.index_rules(expected, stored).unionByName(manifest.entry_rules(stored.where("component <> 'n4'"), known)).unionByName(manifest.file_rules(stored, expected.select("path")))

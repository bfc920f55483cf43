"""Queries of provider records, audits, corpus rules, the source ledger and selections on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..operators import audits, filters, provider
from ..plans import corpus, ledger
from .relations import part_edges
from .scalars import query


def _k() -> Column:
    return F.col("c_custkey")


def _nation() -> Column:
    return F.col("c_nationkey")


def _none() -> Column:
    return F.lit(None).cast("string")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _location(page: Column, source: Column, license_: Column) -> Column:
    return F.struct(page.alias("landing_page_url"), source.alias("source"), license_.alias("license"))


def _works(rows: DataFrame) -> DataFrame:
    """Works with everything null but what the caller adds."""
    kinds = {
        "id": "string", "ids_openalex": "string", "ids_doi": "string", "doi": "string", "display_name": "string", "title": "string", "authors": "array<struct<name:string,raw:string>>", "publication_date": "string",
        "publication_year": "int", "type": "string", "primary": "struct<landing_page_url:string,source:string,license:string>", "best": "struct<landing_page_url:string,source:string,license:string>",
        "locations": "array<struct<landing_page_url:string,source:string,license:string>>", "biblio": "struct<volume:string,issue:string,first_page:string,last_page:string>", "referenced": "array<string>",
    }
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns})


@query("""WITH w AS (SELECT c_custkey AS k, c_nationkey AS n, c_name, c_mktsegment AS seg FROM customer WHERE c_custkey % 9 <> 8)
SELECT 'openalex-w' || k AS paper_id, CASE WHEN k % 10 = 0 THEN 'Untitled OpenAlex work W' || k ELSE c_name END AS title, CASE WHEN k % 3 = 0 THEN 'Unknown author' WHEN k % 2 = 0 THEN 'Raw ' || k ELSE c_name END AS authors,
CASE WHEN k % 4 <> 1 THEN '2020-01-02' WHEN k % 8 <> 1 THEN (2000 + n)::VARCHAR ELSE 'Undated' END AS date,
concat_ws(', ', CASE WHEN k % 2 = 1 THEN seg WHEN n > 0 THEN 'Loc ' || n ELSE 'Venue not supplied by OpenAlex' END, CASE WHEN k % 3 = 0 THEN 'volume 7' END, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 'pages 10' ELSE 'pages 10-19' END END) AS venue,
CASE WHEN k % 2 = 0 THEN '10.1/ab-' || k END AS doi, CASE WHEN k % 3 = 1 THEN '2401.' || lpad(k::VARCHAR, 5, '0') || 'v2' END AS arxiv,
concat_ws(' ', 'https://openalex.org/W' || k, CASE WHEN k % 2 = 0 THEN 'https://doi.org/10.1/ab-' || k END, CASE WHEN k % 3 = 1 THEN 'https://arxiv.org/abs/2401.' || lpad(k::VARCHAR, 5, '0') END) AS links,
CASE WHEN k % 6 = 0 THEN 'OpenAlex reports license cc-by; full-text reuse has not been independently verified.' ELSE 'No normalized reusable full-text license confirmed.' END AS license FROM w""")
def prov_papers(spark: SparkSession, d: str) -> DataFrame:
    id_ = _text("W", _k())
    rows = table(spark, d, "customer").select(
        F.when((_k() % 4 != 0) & (_k() % 9 != 8), id_).alias("id"),
        F.when((_k() % 4 == 0) & (_k() % 9 != 8), F.concat(F.lit("https://openalex.org/"), id_)).alias("ids_openalex"),
        F.when(_k() % 5 != 0, _text(" ", F.col("c_name"), " ")).alias("display_name"),
        F.when(_k() % 10 == 0, "  ").otherwise(F.col("c_name")).alias("title"),
        F.when(_k() % 3 != 0, F.array(F.struct(F.when(_k() % 2 != 0, F.col("c_name")).alias("name"), _text("Raw ", _k()).alias("raw")))).alias("authors"),
        F.when(_k() % 4 != 1, "2020-01-02").alias("publication_date"),
        F.when(_k() % 8 != 1, (_nation() + 2000).cast("int")).alias("publication_year"),
        F.when(_k() % 2 == 0, _text("https://doi.org/10.1/AB-", _k())).alias("doi"),
        _location(F.when(_k() % 3 == 1, _text("https://arxiv.org/pdf/2401.", F.lpad(_k().cast("string"), 5, "0"), "v2.pdf")).otherwise("https://x.org"), F.when(_k() % 2 == 1, F.col("c_mktsegment")), F.when(_k() % 6 == 0, "cc-by")).alias("primary"),
        F.array(_location(_none(), F.when(_nation() > 0, _text("Loc ", _nation())), _none())).alias("locations"),
        F.struct(F.when(_k() % 3 == 0, "7").alias("volume"), _none().alias("issue"), F.when(_k() % 2 == 0, "10").alias("first_page"), F.when(_k() % 4 == 0, "10").otherwise("19").alias("last_page")).alias("biblio"),
        F.lit("2024").alias("retrieved_at"),
    )
    found = provider.papers_of(_works(rows))
    named = [F.try_element_at("identifiers", F.lit(k)).alias(k) for k in ("doi", "arxiv")]
    return found.select("paper_id", "title", F.array_join("authors", ", ").alias("authors"), "date", "venue", *named, F.array_join(F.transform("links", lambda x: x["url"]), " ").alias("links"), "license")


def _snapshot(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Customers with more than 2000 are papers; those of one segment were fetched: customer k
    cites k + 1 to k + 4, of which the provider lacks every seventh, and is cited by k + 5."""
    rows = table(spark, d, "customer").where("c_acctbal > 2000")
    none = provider.papers_of(_works(rows.select(_text("W", _k()).alias("id"), F.lit("t0").alias("retrieved_at")))).limit(0)
    blocked = _nation() % 4 == 0
    base = rows.select(_text("c", _k()).alias("paper_id"), F.col("c_name").alias("title"), F.create_map(F.lit("openAlex"), _text("https://openalex.org/W", _k())).alias("identifiers"), F.when(blocked, "identifier-unresolved").otherwise("queued").alias("s"))
    zero = F.lit(0).cast("long")
    coverage = F.struct(zero, zero, zero, zero, F.col("s"), zero, F.lit(False), F.lit("")).cast(provider.COVERAGE).alias("coverage")
    papers = none.unionByName(base.select("paper_id", "title", "identifiers", coverage), allowMissingColumns=True)
    queue = rows.select(
        _text("c", _k()).alias("paper_id"), F.when(blocked, "blocked").otherwise("metadata-fetched").alias("state"),
        F.when(blocked, F.array(F.lit("resolve-identifiers"))).when(_nation() % 4 == 1, F.array(F.lit("deduplicate"), F.lit("review-match"))).otherwise(F.array(F.lit("fetch-outgoing"))).alias("tasks"),
        F.lit(0).alias("attempts"), F.lit("t0").alias("updated_at"), F.when(blocked, "waits").alias("last_error"),
    )
    seeds = rows.where("c_mktsegment = 'MACHINERY'").select(_text("c", _k()).alias("seed"), _k().alias("k"), _text("W", _k()).alias("id"), F.transform(F.sequence(_k() + 1, _k() + 4), lambda x: F.concat(F.lit("https://openalex.org/W"), x.cast("string"))).alias("referenced"), F.lit("t1").alias("retrieved_at"), F.lit("t2").alias("completed_at"))
    out = seeds.select("seed", F.explode(F.sequence(F.col("k") + 1, F.col("k") + 4)).alias("w"), F.lit("outgoing").alias("direction")).where("w % 7 <> 0")
    into = seeds.select("seed", (F.col("k") + 5).alias("w"), F.lit("incoming").alias("direction"))
    records = out.unionByName(into).select("seed", "direction", _text("W", F.col("w")).alias("id"), F.lit("t1").alias("retrieved_at"), F.lit("u").alias("url"))
    edges = provider.edges_of(records.select("seed", F.col("id").alias("paper_id"), "direction", F.col("id").alias("record_id"), "retrieved_at", "url")).limit(0)
    return provider.integrate(papers, edges, queue, _works(seeds.drop("k")), _works(records))


_ROUND = """p AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment = 'MACHINERY' AS seed FROM customer WHERE c_acctbal > 2000),
f AS (SELECT k, k + j AS w, 'outgoing' AS direction FROM p, unnest([1, 2, 3, 4]) AS t(j) WHERE seed AND (k + j) % 7 <> 0 UNION ALL SELECT k, k + 5, 'incoming' FROM p WHERE seed),
r AS (SELECT f.*, CASE WHEN p.k IS NULL THEN 'openalex-w' || w ELSE 'c' || w END AS target FROM f LEFT JOIN p ON p.k = w),
m AS (SELECT k, string_agg('W' || (k + j), ', ' ORDER BY 'W' || (k + j)) AS missing FROM p, unnest([1, 2, 3, 4]) AS t(j) WHERE seed AND (k + j) % 7 = 0 GROUP BY k)"""


@query(f"""WITH {_ROUND} SELECT 'c' || p.k AS paper_id, CASE WHEN seed AND missing IS NULL THEN 'complete-direct-neighborhood' WHEN seed OR n % 4 <> 0 OR t.target IS NOT NULL THEN 'metadata-fetched' ELSE 'blocked' END AS state,
CASE WHEN seed THEN CASE WHEN missing IS NULL THEN '' ELSE 'fetch-outgoing' END WHEN n % 4 = 0 THEN CASE WHEN t.target IS NULL THEN 'resolve-identifiers' ELSE 'fetch-outgoing,fetch-incoming,deduplicate' END
WHEN n % 4 = 1 THEN CASE WHEN t.target IS NULL THEN 'deduplicate,review-match' ELSE 'deduplicate,review-match,fetch-outgoing,fetch-incoming' END ELSE CASE WHEN t.target IS NULL THEN 'fetch-outgoing' ELSE 'fetch-outgoing,fetch-incoming,deduplicate' END END AS tasks,
seed::INTEGER AS attempts, CASE WHEN seed THEN 't2' WHEN n % 4 = 0 AND t.target IS NOT NULL THEN 't1' ELSE 't0' END AS updated_at,
CASE WHEN seed THEN 'OpenAlex returned no work record for ' || len(string_split(missing, ', ')) || ' referenced identifier(s): ' || missing WHEN n % 4 = 0 AND t.target IS NULL THEN 'waits' END AS last_error
FROM p LEFT JOIN m ON m.k = p.k LEFT JOIN (SELECT DISTINCT target FROM r) t ON t.target = 'c' || p.k
UNION ALL SELECT DISTINCT target, 'metadata-fetched', 'fetch-outgoing,fetch-incoming,deduplicate', 0, 't1', NULL FROM r WHERE target LIKE 'o%'""")
def stm_integrate_queue(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d)["queue"].select("paper_id", "state", F.array_join("tasks", ",").alias("tasks"), "attempts", "updated_at", "last_error")


@query(f"""WITH {_ROUND} SELECT 'c' || p.k AS paper_id, CASE WHEN seed THEN 4 ELSE 0 END AS outgoing_found, CASE WHEN seed THEN 4 - coalesce(len(string_split(missing, ', ')), 0) ELSE 0 END AS outgoing_resolved, seed::BIGINT AS incoming_found,
CASE WHEN seed THEN 'provider-visible-only' WHEN n % 4 = 0 AND t.target IS NULL THEN 'identifier-unresolved' ELSE 'queued' END AS status, 2 * seed::BIGINT AS searches FROM p LEFT JOIN m ON m.k = p.k LEFT JOIN (SELECT DISTINCT target FROM r) t ON t.target = 'c' || p.k
UNION ALL SELECT DISTINCT target, 0, 0, 0, 'queued', 0 FROM r WHERE target LIKE 'o%'""")
def stm_integrate_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("coverage")
    return _snapshot(spark, d)["papers"].select("paper_id", c["outgoing_found"].alias("outgoing_found"), c["outgoing_resolved"].alias("outgoing_resolved"), c["incoming_found"].alias("incoming_found"), c["incoming_status"].alias("status"), c["searches"].alias("searches"))


@query(f"""WITH {_ROUND} SELECT 'citation-' || a || '-' || b AS edge_id, a AS citing, b AS cited, direction, 'provider-linked' AS confidence FROM (SELECT CASE direction WHEN 'outgoing' THEN 'c' || k ELSE target END AS a, CASE direction WHEN 'outgoing' THEN target ELSE 'c' || k END AS b, direction FROM r)""")
def stm_integrate_edges(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d)["edges"].select("edge_id", "citing", "cited", "direction", "confidence")


_AUDIT = audits.Audit("seed", "2026-01-01", "audit:one", "2401.1", "https://a.org/src", "https://a.org/q", "W1")


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal > 2000 AND (c_custkey % 3 = 0 OR c_custkey % 2 = 0) AS met, c_custkey % 4 = 0 OR c_custkey % 8 = 1 AS declared FROM customer),
j AS (SELECT *, CASE WHEN declared AND (k % 8 = 1 OR NOT met) THEN 'reuse-without-match' WHEN declared AND k % 3 <> 0 THEN 'reuse-by-internal-id-only' WHEN NOT declared AND met AND n % 2 <> 0 THEN 'undeclared-reuse' WHEN NOT declared AND n = 5 THEN 'id-collision' END AS rule FROM c)
SELECT rule, 'a' || k AS entity, CASE WHEN met THEN 'c' || k ELSE '' END AS detail FROM j WHERE rule IS NOT NULL""")
def aud_refused_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    ids = F.map_from_entries(F.array_compact(F.array(F.when(_k() % 3 == 0, F.struct(F.lit("doi").alias("key"), _text("10.1/", _k()).alias("value"))), F.when(_k() % 2 == 0, F.struct(F.lit("internal").alias("key"), _text("i", _k()).alias("value"))))))
    past = F.when(_nation() % 2 == 0, F.array(F.struct(F.lit("audit:one").alias("version"), F.lit("").alias("at"), F.lit("").alias("summary"))))
    papers = rows.where("c_acctbal > 2000").select(_text("c", _k()).alias("paper_id"), ids.alias("identifiers"), past.alias("history"))
    papers = papers.unionByName(rows.where("c_nationkey = 5").select(_text("a", _k()).alias("paper_id"), F.create_map().cast("map<string,string>").alias("identifiers"), F.lit(None).cast(audits.HISTORY).alias("history")))
    new = rows.select(_text("a", _k()).alias("paper_id"), ids.alias("identifiers"), F.when(_k() % 4 == 0, _text("c", _k())).when(_k() % 8 == 1, "zzz").alias("reuse"))
    return audits.reviewed_matches(papers, new, _AUDIT)[1]


@query("""WITH e AS (SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id), q AS (SELECT *, first IN ('error', 'purchase') AS ended FROM e WHERE first <> 'view')
SELECT e.user_id AS paper_id, CASE WHEN e.first = 'view' THEN CASE WHEN e.last = 'click' THEN 'blocked' ELSE 'open' END WHEN NOT ended AND e.last = 'click' THEN 'blocked' WHEN e.first = 'error' THEN 'blocked' WHEN e.first = 'purchase' THEN 'complete-direct-neighborhood' ELSE 'open' END AS state,
CASE WHEN e.first = 'view' OR (NOT ended AND e.last = 'click') THEN e.last WHEN ended OR e.first = e.last THEN e.first ELSE e.first || ',' || e.last END AS tasks, CASE WHEN e.first = 'view' THEN 0 ELSE 3 END AS attempts FROM e LEFT JOIN q USING (user_id)""")
def mrg_baseline_queue(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import merge

    ends = table(spark, d, "events").groupBy(F.col("user_id").alias("paper_id")).agg(F.min_by("event_type", "event_id").alias("first"), F.max_by("event_type", "event_id").alias("last"))
    state = F.when(F.col("first") == "error", "blocked").when(F.col("first") == "purchase", "complete-direct-neighborhood").otherwise("open")
    queue = ends.where("first <> 'view'").select("paper_id", state.alias("state"), F.array("first").alias("tasks"), F.lit(3).alias("attempts"))
    new = ends.select("paper_id", F.when(F.col("last") == "click", "blocked").otherwise("open").alias("state"), F.array("last").alias("tasks"), F.lit(0).alias("attempts"))
    return merge.merge_queue(queue, new, blocks=True).withColumn("tasks", F.array_join("tasks", ","))


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """Part k is a statement that uses k div 2 and k div 3; parts of some sizes break a rule each."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = lambda x: _text("s", x)
    own = F.when(k > 1, F.array_distinct(F.array(name(F.floor(k / 2)), name(F.floor(k / 3))))).otherwise(F.array().cast("array<string>"))
    deps = F.when(size == 1, F.concat(own, F.array(F.lit("s-none")))).when(size == 2, F.concat(own, F.array(name(k)))).otherwise(own)
    used = F.when(size % 5 == 0, F.slice(deps, 1, 1)).otherwise(deps)
    refs = F.when(size == 7, F.array(F.lit("s-x"))).when(k > 1, F.array(name(F.floor(k / 2)))).otherwise(F.array().cast("array<string>"))
    step = F.struct(F.lit("x").alias("id"), refs.alias("refs"), F.when(size == 10, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("formal"))
    route = F.struct(
        F.lit("r1").alias("id"), F.when(size == 30, "minimized").otherwise("original").alias("kind"), F.when(size % 2 == 0, "complete").otherwise("open").alias("status"), F.when(size == 14, "fully-certified").otherwise("none").alias("verification"),
        F.lit("none").alias("alignment"), F.when(size == 22, "r1").when(size == 26, "r9").alias("parent"), used.alias("dependencies"), F.array(step).alias("steps"),
    )
    declared = F.array(F.struct(F.lit("g").alias("name"), (size % 2 == 0).alias("certified")))
    return table(spark, d, "part").select(
        name(k).alias("statement"), _text(F.when(size % 9 == 0, "x").otherwise(F.col("p_brand")), ".", k).alias("global_id"), F.col("p_brand").alias("paper_id"), F.when(size % 3 != 0, "theorem").otherwise("definition").alias("kind"), deps.alias("dependencies"),
        F.when(size % 6 == 0, "said").alias("source_statement"), F.when(size % 7 == 0, "noted").alias("note"), F.when(size % 8 == 0, "fully-certified").otherwise("none").alias("formal_status"), F.when(size % 16 == 0, "reviewed").otherwise("none").alias("formal_alignment"),
        F.when(F.startswith("p_type", F.lit("ECONOMY")), "q").alias("cluster"), F.when(size % 3 == 0, declared).otherwise(F.slice(declared, 1, 0)).alias("declarations"), F.when(size % 4 != 0, F.array(route)).otherwise(F.slice(F.array(route), 1, 0)).alias("routes"),
    )


_STATEMENTS = """p AS (SELECT p_partkey AS k, p_size AS size, p_brand AS brand, p_type AS type FROM part),
o AS (SELECT DISTINCT k, size, brand, dep FROM (SELECT k, size, brand, k // 2 AS dep FROM p WHERE k > 1 UNION ALL SELECT k, size, brand, k // 3 FROM p WHERE k > 1))"""


@query(f"""WITH {_STATEMENTS} SELECT 'statement-paper' AS rule, 's' || k AS entity, brand AS detail FROM p WHERE brand = 'Brand#7' UNION ALL SELECT 'global-namespace', 's' || k, '' FROM p WHERE size % 9 = 0
UNION ALL SELECT 'source-with-note', 's' || k, '' FROM p WHERE (size % 6 = 0) <> (size % 7 = 0) UNION ALL SELECT 'dependency-exists', 's' || k, 's-none' FROM p WHERE size = 1 UNION ALL SELECT 'no-self-dependency', 's' || k, '' FROM p WHERE size = 2
UNION ALL SELECT 'dependency-own-paper', 's' || o.k, 's' || dep FROM o JOIN p ON p.k = dep WHERE p.brand <> o.brand UNION ALL SELECT 'dependencies-of-routes', 's' || k, '' FROM p WHERE size % 4 <> 0 AND size % 5 = 0 AND k > 1 AND k // 2 <> k // 3
UNION ALL SELECT 'theorem-routed', 's' || k, '' FROM p WHERE size % 3 <> 0 AND size % 4 = 0 UNION ALL SELECT 'certified-possible', 's' || k, '' FROM p WHERE size % 8 = 0 AND NOT (size % 16 = 0 AND size % 3 = 0)""")
def val_corpus_statements(spark: SparkSession, d: str) -> DataFrame:
    statement = _statements(spark, d)
    return corpus.statement_rules({"statement": statement, "paper": statement.select("paper_id").distinct().where("paper_id <> 'Brand#7'")})


@query(f"""WITH {_STATEMENTS}, r AS (SELECT *, 's' || k || '/r1' AS name FROM p WHERE size % 4 <> 0), u AS (SELECT o.k, 's' || dep AS dep FROM o WHERE dep <> o.k // 2 AND size % 5 <> 0 UNION ALL SELECT k, 's' || k FROM p WHERE size = 2)
SELECT 'route-dependency-exists' AS rule, name AS entity, 's-none' AS detail FROM r WHERE size = 1 UNION ALL SELECT 'step-refs-declared', name || '/x', 's-x' FROM r WHERE size = 7 UNION ALL SELECT 'step-formal-declared', name || '/x', 'f' FROM r WHERE size = 10
UNION ALL SELECT 'complete-route-uses-all', name, string_agg(dep, ',' ORDER BY dep) FROM r JOIN u USING (k) WHERE size % 2 = 0 GROUP BY name UNION ALL SELECT 'certified-route-possible', name, '' FROM r WHERE size = 14
UNION ALL SELECT 'route-parent', name, CASE size WHEN 22 THEN 'r1' ELSE 'r9' END FROM r WHERE size IN (22, 26) UNION ALL SELECT 'minimized-names-source', name, '' FROM r WHERE size = 30 UNION ALL SELECT 'route-lineage-acyclic', name, 'on a cycle' FROM r WHERE size = 22
UNION ALL SELECT 'cycle-reviewed', 's' || k, 's' || k FROM p WHERE size = 2 AND NOT starts_with(type, 'ECONOMY')""")
def val_corpus_routes(spark: SparkSession, d: str) -> DataFrame:
    statement = _statements(spark, d)
    return corpus.route_rules({"statement": statement}).unionByName(corpus.cycle_rules({"statement": statement}))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment = 'BUILDING' AS gold, c_custkey // 2 AS half, c_custkey % 10 AS got, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer)
SELECT 'identifier-owner' AS rule, 'doi:10.1/x' || half AS entity, '2' AS detail FROM c GROUP BY half HAVING count(*) = 2 UNION ALL SELECT 'coverage-resolved-within-found', 'c' || k, '' FROM c WHERE got > n OR got > 6
UNION ALL SELECT 'coverage-complete', 'c' || k, '' FROM c WHERE n % 3 = 0 AND got <> 6 UNION ALL SELECT 'closure-possible', 'c' || k, '' FROM c WHERE k % 5 = 0 AND NOT (got = n AND got = 6 AND n % 3 = 0)
UNION ALL SELECT 'featured-once', 'corpus', count(*)::VARCHAR FROM c WHERE n = 0 HAVING count(*) > 1 UNION ALL SELECT 'gold-has-statement', 'c' || k, 'c' || k FROM c WHERE gold AND orders = 0 UNION ALL SELECT 'gold-has-graph', 'c' || k, '' FROM c WHERE gold AND (n % 2 = 0 OR n > 20)
UNION ALL SELECT 'view-once', 'c' || k || '|v', '2' FROM c WHERE n % 2 = 1 AND n % 5 = 0 UNION ALL SELECT 'graph-root-exists', 'c' || k, 'o-none' FROM c WHERE n = 7
UNION ALL SELECT 'graph-root-own-paper', 'c' || k, 'o' || k FROM c JOIN orders ON o_orderkey = k WHERE o_custkey <> k AND n <= 20""")
def val_corpus_papers(spark: SparkSession, d: str) -> DataFrame:
    got, n = (_k() % 10).cast("long"), _nation().cast("long")
    view = F.struct(F.lit("v").alias("id"), F.when(_nation() == 7, F.array(F.lit("o-none"))).otherwise(F.array().cast("array<string>")).alias("roots"), F.array().cast("array<string>").alias("expanded"))
    views = F.when(_nation() % 2 == 0, F.slice(F.array(view), 1, 0)).when(_nation() % 5 == 0, F.array(view, view)).otherwise(F.array(view))
    coverage = F.struct(n.alias("outgoing_found"), got.alias("outgoing_resolved"), F.lit(6).cast("long").alias("incoming_found"), got.alias("incoming_resolved"), F.when(_nation() % 3 == 0, "complete").otherwise("queued").alias("incoming_status"), (_k() % 5 == 0).alias("closed"))
    root = F.when(_nation() <= 20, _text("o", _k()))
    graph = F.struct(root.alias("main_root"), F.array_compact(F.array(root)).alias("roots"), views.alias("views"))
    doi = F.when(_k() % 2 == 0, F.lit("https://doi.org/10.1/X")).otherwise("doi: 10.1/x")
    paper = table(spark, d, "customer").select(_text("c", _k()).alias("paper_id"), F.when(F.col("c_mktsegment") == "BUILDING", "gold").otherwise("provisional").alias("status"), (_nation() == 0).alias("featured"), F.create_map(F.lit("doi"), _text(doi, F.floor(_k() / 2))).alias("identifiers"), coverage.alias("coverage"), graph.alias("graph"))
    statement = table(spark, d, "orders").select(_text("o", F.col("o_orderkey")).alias("statement"), _text("c", F.col("o_custkey")).alias("paper_id"))
    return corpus.paper_rules({"paper": paper, "statement": statement})


@query("""WITH e AS (SELECT event_id AS id, user_id AS a, event_id % 40 AS b, event_type AS t FROM events), q AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment = 'FURNITURE' AS done FROM customer)
SELECT 'endpoints-once' AS rule, a || '|' || b AS entity, count(*)::VARCHAR AS detail FROM e GROUP BY a, b HAVING count(*) > 1 UNION ALL SELECT 'no-self-citation', id::VARCHAR, '' FROM e WHERE a = b
UNION ALL SELECT 'citing-exists', id::VARCHAR, a::VARCHAR FROM e WHERE a NOT IN (SELECT k FROM q WHERE n <> 3) UNION ALL SELECT 'cited-exists', id::VARCHAR, b::VARCHAR FROM e WHERE b NOT IN (SELECT k FROM q WHERE n <> 3) UNION ALL SELECT 'source-exists', id::VARCHAR, a::VARCHAR FROM e WHERE a NOT IN (SELECT k FROM q WHERE n <> 3)
UNION ALL SELECT 'direction-of-source', id::VARCHAR, '' FROM e WHERE t <> 'click' AND a <> b UNION ALL SELECT 'queue-paper', k::VARCHAR, k::VARCHAR FROM q WHERE n = 3 UNION ALL SELECT 'complete-without-work', k::VARCHAR, '' FROM q WHERE done AND n % 6 <> 0 UNION ALL SELECT 'unresolved-with-retry', k::VARCHAR, '' FROM q WHERE n % 5 = 0 AND n % 6 <> 1 AND NOT (done AND n % 6 = 0)
UNION ALL SELECT 'blocked-without-identity', k::VARCHAR, '' FROM q WHERE NOT done AND n % 6 = 2 AND n <> 3 UNION ALL SELECT 'closure-complete-in-queue', k::VARCHAR, k::VARCHAR FROM q WHERE n % 7 = 0 AND NOT done""")
def val_corpus_edges(spark: SparkSession, d: str) -> DataFrame:
    edge = table(spark, d, "events").select(F.col("event_id").alias("edge_id"), F.col("user_id").alias("citing"), (F.col("event_id") % 40).alias("cited"), F.col("user_id").alias("source"), F.when(F.col("event_type") == "click", "outgoing").otherwise("incoming").alias("direction"))
    rows = table(spark, d, "customer")
    paper = rows.where("c_nationkey <> 3").select(_k().alias("paper_id"), F.create_map(F.lit("openAlex"), F.lit("W1")).alias("identifiers"), F.struct((_nation() % 7 == 0).alias("closed")).alias("coverage"))
    tasks = F.when(_nation() % 6 == 1, F.array(F.lit("fetch-outgoing"))).when(_nation() % 6 == 2, F.array(F.lit("resolve-identifiers"))).when(_nation() % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("deduplicate")))
    open_ids = F.when((_nation() % 5 == 0) & (_nation() % 6 != 0) | (_nation() % 30 == 0), F.array(F.lit("W2"))).when(_nation() % 5 == 0, F.array(F.lit("W3")))
    state = F.when(F.col("c_mktsegment") == "FURNITURE", "complete-direct-neighborhood").otherwise("blocked")
    # rows without tasks are whole only if nothing is unresolved
    open_ids = F.when((_nation() % 5 == 0) & ~((_nation() % 6 == 0) & (F.col("c_mktsegment") == "FURNITURE")), open_ids)
    queue = rows.select(_k().alias("paper_id"), state.alias("state"), tasks.alias("tasks"), open_ids.alias("unresolved"))
    t = {"paper": paper, "edge": edge, "queue": queue}
    return corpus.edge_rules(t).unionByName(corpus.queue_rules(t))


_EDITION = ("accessKind", "artifactSha256", "editionId", "licenseNote", "licenseSpdx", "licenseUrl", "sourceRepository", "sourceRevision", "stableLocator")


def _ledger(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Customers are components, orders their proposals; the audits and reviews of some don't hold."""
    comp, pid = _text("S", F.col("o_custkey")), _text("o", F.col("o_orderkey"))
    total, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    exact = status != "P"
    edition = F.struct(*[_text(f"{n[:3]}-", F.col("o_orderkey")).alias(n) if n != "editionId" else pid.alias(n) for n in _EDITION])
    rows = table(spark, d, "orders").select(
        comp.alias("component"), pid.alias("proposal"), F.when(exact, "exact-edition").otherwise("duplicate-component").alias("kind"), F.when(exact, edition).alias("edition"),
        F.when(~exact, F.when(total == "1-URGENT", comp).otherwise("S-other")).alias("target"), F.when(~exact, "here").alias("evidence_locator"), F.when(~exact, "00").alias("evidence_sha256"), F.when(~exact, "same").alias("reason"),
        F.lit("maker").alias("actor"), F.when(total == "2-HIGH", "approved").when(total == "5-LOW", "rejected").alias("decision"), F.when(total == "5-LOW", "maker").when(total == "2-HIGH", "judge").alias("reviewer"), total.alias("priority"), status.alias("status"),
    )
    bound = ledger.proposal_digest(_EDITION, F.lit("rev"))
    license_ = F.struct(F.lit("candidate").alias("status"), F.lit("review-required").alias("distribution"), _none().alias("decision"), _none().alias("reviewer"), _none().alias("sha256"))
    proposal = rows.withColumn("license", F.when(F.col("kind") == "exact-edition", license_))
    proposal = proposal.withColumns({"audit_sha256": F.when(F.col("priority") == "3-MEDIUM", "old").otherwise(bound), "review_sha256": F.when(F.col("decision").isNotNull(), F.when(F.col("status") == "O", bound).otherwise("old"))})
    customer = table(spark, d, "customer")
    seg = F.col("c_mktsegment")
    approved = rows.where("decision = 'approved'").groupBy("component").agg(F.min("proposal").alias("one"))
    record = customer.select(_text("S", _k()).alias("component"), F.when(seg == "BUILDING", "old").otherwise("rev").alias("revision"), seg.alias("seg")).join(approved, "component", "left")
    record = record.select("component", "revision", F.when(F.col("seg") == "HOUSEHOLD", "o-x").otherwise(F.col("one")).alias("selected"))
    lead = customer.select(_text("S", _k()).alias("component"), F.lit("l").alias("lead"), F.when(_nation() % 2 == 0, "promoted").otherwise("open").alias("disposition"), F.when(_nation() % 3 == 0, "o-x").alias("proposal"))
    blocker = customer.select(_text("S", _k()).alias("component"), F.explode(F.array(F.lit("license"), F.lit("identity"))).alias("domain"), _nation().alias("n"))
    blocker = blocker.select("component", F.col("domain").alias("blocker"), "domain", F.when((F.col("n") % 4 == 0) & (F.col("domain") == "license"), "resolved").otherwise("open").alias("state"), F.when(F.col("n") % 8 == 0, "done").alias("resolution"), _none().alias("proposal")).where("domain = 'license' or component like '%1'")
    produced = F.when(F.col("o_orderpriority") == "1-URGENT", "candidate-produced").otherwise("not-tested")
    pins = proposal.select(F.col("proposal").alias("p"), ledger.pin_digest().alias("pin"))
    assessment = table(spark, d, "orders").where("o_orderstatus = 'F'").select(comp.alias("component"), F.lit("a").alias("assessment"), pid.alias("proposal"), produced.alias("outcome"), F.lit("e").alias("extraction_sha256"), F.lit("g").alias("graph_sha256"), F.lit("m").alias("by"), F.lit("t").alias("at"))
    assessment = assessment.join(pins, F.col("proposal") == F.col("p")).select("component", F.concat("assessment", "proposal").alias("assessment"), "proposal", "outcome", F.when(F.col("outcome") == "candidate-produced", F.col("pin")).alias("pin_sha256"), "extraction_sha256", "graph_sha256", "by", "at")
    expected = customer.where("c_nationkey <> 24").select(_text("S", _k()).alias("component"))
    return {"expected": expected, "record": record, "lead": lead, "proposal": proposal, "blocker": blocker, "assessment": assessment, "administrator": spark.createDataFrame([("judge",)], "actor string")}


@query("""SELECT 'o' || o_orderkey AS proposal, CASE WHEN o_orderstatus = 'P' THEN sha256('{"bookGraphId":"S' || o_custkey || '","evidenceLocator":"here","evidenceSha256":"00","id":"o' || o_orderkey || '","kind":"duplicate-component","reason":"same","sourceSetRevision":"rev","targetBookGraphId":"' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'S' || o_custkey ELSE 'S-other' END || '"}')
ELSE sha256('{"bookGraphId":"S' || o_custkey || '","edition":{"accessKind":"acc-' || o_orderkey || '","artifactSha256":"art-' || o_orderkey || '","editionId":"o' || o_orderkey || '","licenseNote":"lic-' || o_orderkey || '","licenseSpdx":"lic-' || o_orderkey || '","licenseUrl":"lic-' || o_orderkey || '","sourceRepository":"sou-' || o_orderkey || '","sourceRevision":"sou-' || o_orderkey || '","stableLocator":"sta-' || o_orderkey || '"},"id":"o' || o_orderkey || '","kind":"exact-edition","sourceSetRevision":"rev"}') END AS subject,
CASE WHEN o_orderstatus <> 'P' THEN sha256('{"artifactSha256":"art-' || o_orderkey || '","sourceRepository":"sou-' || o_orderkey || '","sourceRevision":"sou-' || o_orderkey || '","stableLocator":"sta-' || o_orderkey || '"}') END AS pin FROM orders""")
def led_subjects(spark: SparkSession, d: str) -> DataFrame:
    p = _ledger(spark, d)["proposal"]
    return p.select("proposal", ledger.proposal_digest(_EDITION, F.lit("rev")).alias("subject"), F.when(F.col("kind") == "exact-edition", ledger.pin_digest()).alias("pin"))


@query("""WITH o AS (SELECT 'S' || o_custkey AS c, 'o' || o_orderkey AS p, o_orderpriority AS pr, o_orderstatus AS st FROM orders), a AS (SELECT c, count(*) AS n, min(p) AS one FROM o WHERE pr = '2-HIGH' GROUP BY c),
r AS (SELECT 'S' || c_custkey AS c, c_nationkey AS n, c_mktsegment AS seg, a.n AS approved, a.one, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'o-x' ELSE a.one END AS selected FROM customer LEFT JOIN a ON a.c = 'S' || c_custkey)
SELECT 'record-expected' AS rule, c AS entity, c AS detail FROM r WHERE n = 24 UNION ALL SELECT 'record-current', c, '' FROM r WHERE seg = 'BUILDING' UNION ALL SELECT 'audit-current', c || ':' || p, '' FROM o WHERE pr = '3-MEDIUM' UNION ALL SELECT 'reviewer-authorised', c || ':' || p, 'maker' FROM o WHERE pr = '5-LOW'
UNION ALL SELECT 'review-independent', c || ':' || p, '' FROM o WHERE pr = '5-LOW' UNION ALL SELECT 'review-current', c || ':' || p, '' FROM o WHERE pr IN ('2-HIGH', '5-LOW') AND st <> 'O' UNION ALL SELECT 'no-self-duplicate', c || ':' || p, '' FROM o WHERE st = 'P' AND pr = '1-URGENT'
UNION ALL SELECT 'approved-once', c, n::VARCHAR FROM a WHERE n > 1 UNION ALL SELECT 'selected-is-approved', c, selected FROM r WHERE approved IS NULL AND selected IS NOT NULL UNION ALL SELECT 'approved-is-selected', c, one FROM r WHERE approved = 1 AND selected <> one
UNION ALL SELECT 'lead-proposal', 'l', CASE WHEN n % 3 = 0 THEN c || '|o-x' ELSE c END FROM r WHERE n % 2 = 0 UNION ALL SELECT 'lead-not-promoted', c || ':l', '' FROM r WHERE n % 2 <> 0 AND n % 3 = 0
UNION ALL SELECT 'blocker-resolution', c || ':' || b, '' FROM r, unnest(['license', 'identity']) AS t(b) WHERE (b = 'license' OR c LIKE '%1') AND (b = 'license' AND n % 4 = 0) <> (n % 8 = 0)
UNION ALL SELECT 'untested-without-hashes', c || ':a' || p, '' FROM o WHERE st = 'F' AND pr <> '1-URGENT'""")
def led_record_rules(spark: SparkSession, d: str) -> DataFrame:
    return ledger.record_rules(_ledger(spark, d), "rev", _EDITION)


_MANIFEST = """WITH o AS (SELECT 'S' || o_custkey AS c, 'o' || o_orderkey AS p, o_orderpriority AS pr, o_orderstatus AS st FROM orders), a AS (SELECT c, min(p) AS one FROM o WHERE pr = '2-HIGH' GROUP BY c),
s AS (SELECT 'S' || c_custkey AS c, c_nationkey AS n, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'o-x' ELSE a.one END AS selected FROM customer LEFT JOIN a ON a.c = 'S' || c_custkey WHERE c_nationkey <> 24),
g AS (SELECT s.c, s.n, s.selected, count(p) AS proposals, bool_or(p = selected) AS found, bool_or(p = selected AND st <> 'P') AS exact, bool_or(pr <> '5-LOW' AND st <> 'P') AS any_exact, bool_or(pr <> '5-LOW') AS any_active,
bool_or(st = 'F' AND pr = '1-URGENT' AND selected IS NULL) AS made FROM s LEFT JOIN o ON o.c = s.c GROUP BY ALL),
m AS (SELECT c AS component, selected, CASE WHEN selected IS NOT NULL THEN CASE WHEN exact THEN 'verified-exact-edition' WHEN found THEN 'verified-duplicate' ELSE 'invalid-selection' END WHEN any_exact THEN 'candidate-exact-edition' WHEN any_active THEN 'candidate-duplicate' ELSE 'unresolved' END AS resolution_state,
CASE WHEN made THEN 'candidate-produced' ELSE 'not-assessed' END AS importer_state, 1 AS lead_count, proposals AS proposal_count, concat_ws(',', CASE WHEN c LIKE '%1' THEN 'identity' END, CASE WHEN n % 4 <> 0 THEN 'license' END) AS open_domains FROM g)"""


@query(f"{_MANIFEST} SELECT * FROM m")
def led_manifest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.resolution_manifest(_ledger(spark, d)).withColumn("open_domains", F.array_join("open_domains", ","))


@query(f"""{_MANIFEST} SELECT count(*) AS components, count(*) FILTER (WHERE resolution_state = 'unresolved') AS unresolved, count(*) FILTER (WHERE resolution_state = 'candidate-exact-edition') AS candidate_editions, count(*) FILTER (WHERE resolution_state = 'verified-exact-edition') AS verified_editions,
count(*) FILTER (WHERE resolution_state = 'candidate-duplicate') AS candidate_duplicates, count(*) FILTER (WHERE resolution_state = 'verified-duplicate') AS verified_duplicates, count(*) FILTER (WHERE open_domains <> '') AS blocked, count(*) FILTER (WHERE importer_state = 'candidate-produced') AS produced FROM m""")
def led_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.resolution_summary(ledger.resolution_manifest(_ledger(spark, d)))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0)
SELECT c_custkey, coalesce(o_orderkey, -1) AS chosen, coalesce(o_orderkey, c_custkey) AS first FROM customer LEFT JOIN o ON o_custkey = c_custkey AND r = 1""")
def prj_chosen_dependencies(spark: SparkSession, d: str) -> DataFrame:
    route = F.struct(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"), F.array("o_orderkey").alias("dependencies"))
    routes = table(spark, d, "orders").where("o_orderstatus = 'O' and o_custkey % 2 = 0").groupBy("o_custkey").agg(F.array_sort(F.collect_list(route)).alias("routes"))
    rows = table(spark, d, "customer").join(routes, _k() == F.col("o_custkey"), "left")
    none = F.lit(None).cast("long")
    return rows.select("c_custkey", F.coalesce(filters.chosen_route(F.col("routes"), none)["id"], F.lit(-1)).alias("chosen"), F.get(filters.chosen_dependencies(F.col("routes"), none, F.array("c_custkey")), 0).alias("first"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END, o_orderkey) AS r, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT c_custkey FROM customer JOIN o ON o_custkey = c_custkey AND r = 1 JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' AND c_mktsegment NOT IN ('FURNITURE', 'HOUSEHOLD') AND n_regionkey <> 2""")
def flt_train_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kind = F.when(F.startswith(p, F.lit("1")), "minimized").when(F.startswith(p, F.lit("2")), "original").otherwise("other")
    route = F.struct(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("open").alias("status"), F.when(p != "5-LOW", "reviewed").otherwise("open").alias("review"))
    routes = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(route)).alias("routes"))
    seg = F.col("c_mktsegment")
    statements = table(spark, d, "customer").join(routes, _k() == F.col("o_custkey")).select("c_custkey", _nation().alias("paper_id"), F.when(seg == "FURNITURE", "definition").when(seg == "HOUSEHOLD", "imported-result").otherwise("lemma").alias("kind"), "routes")
    papers = table(spark, d, "nation").select(F.col("n_nationkey").alias("paper_id"), F.when(F.col("n_regionkey") != 2, "gold").otherwise("provisional").alias("status"))
    return filters.train_candidates(statements, papers).select("c_custkey")


@query("WITH RECURSIVE x(node, bad) AS (SELECT p_partkey, p_size = 7 FROM part WHERE p_partkey < 2 UNION ALL SELECT p_partkey, bad OR p_size = 7 FROM x JOIN part ON p_partkey // 2 = node AND p_partkey > 1) SELECT node FROM x WHERE NOT bad")
def flt_excluded_ancestor(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    nodes = table(spark, d, "part").select(k.alias("node"), F.when(k > 1, F.floor(k / 2)).alias("parent"), "p_size")
    return filters.without_excluded(nodes, "node", "parent", F.col("p_size") == 7).select("node")


@query("""SELECT n_nationkey AS unit, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING'), '') AS theorems, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FILTER (WHERE c_mktsegment = 'MACHINERY'), '') AS supports FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def agg_inventory(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "nation").select(F.lit("b").alias("component"), F.col("n_nationkey").alias("unit"))
    nodes = table(spark, d, "customer").select(F.lit("b").alias("component"), _nation().alias("unit"), _k().alias("node"), F.col("c_mktsegment").alias("node_class"))
    made = filters.inventory(units, nodes, {"theorems": "BUILDING", "supports": "MACHINERY"})
    return made.select("unit", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("theorems", "supports")])


@query("""SELECT event_type, count(*) - count(*) FILTER (WHERE value > 50) AS n FROM events GROUP BY event_type HAVING count(*) > count(*) FILTER (WHERE value > 50)""")
def agg_counts_without(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return filters.counts_without(events, events.where("value > 50"), "event_type")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS seen FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id""")
def agg_in_order_of_appearance(spark: SparkSession, d: str) -> DataFrame:
    found = filters.in_order_of_appearance(table(spark, d, "events"), "user_id", "event_type", "event_id")
    return found.select("user_id", F.array_join("values", ",").alias("seen"))


@query("""SELECT string_agg(p_brand || '=' || n, ',' ORDER BY p_brand) AS counts FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)""")
def agg_ordered_counts(spark: SparkSession, d: str) -> DataFrame:
    one = filters.ordered_counts(table(spark, d, "part"), "p_brand")
    return one.select(F.array_join(F.transform("counts", lambda x: F.concat_ws("=", x["p_brand"], x["n"].cast("string"))), ",").alias("counts"))


@query("""SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE contains(lower(p_name), 'wid') AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)) WHERE r <= 8""")
def flt_root_matches(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_partkey").alias("b"))
    papers = table(spark, d, "part").withColumnRenamed("p_partkey", "paper_id")
    options = filters.root_options(papers, lines, "a", "b")
    return filters.root_matches(options, " WID ", [F.col("p_name")], [F.desc("p_size"), F.col("paper_id")]).select(F.col("paper_id").alias("p_partkey"), "p_name")


@query("""WITH s AS (SELECT o_custkey AS paper_id, substr(o_orderpriority, 1, 1) AS p FROM orders) SELECT paper_id, count(*) FILTER (WHERE p IN ('1', '2')) AS results, count(*) FILTER (WHERE p = '3') AS conjectures FROM s GROUP BY paper_id""")
def agg_result_counts(spark: SparkSession, d: str) -> DataFrame:
    p = F.left("o_orderpriority", F.lit(1))
    kind = F.when(p == "1", "lemma").when(p == "2", "theorem").when(p == "3", "conjecture").otherwise("remark")
    return filters.result_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), kind.alias("kind")))


@query("""WITH RECURSIVE g AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2 UNION SELECT c.p_partkey // 8, c.p_partkey FROM part c WHERE c.p_size = 5 AND c.p_partkey >= 8),
r(a, b) AS (SELECT src, dst FROM g UNION SELECT a, dst FROM r JOIN g ON src = b), s AS (SELECT a FROM r WHERE a = b) SELECT a AS node, count(*) AS peers FROM (SELECT x.a, y.b FROM s x JOIN r y ON y.a = x.a JOIN r z ON z.a = y.b AND z.b = x.a) GROUP BY a""")
def grf_strong_components(spark: SparkSession, d: str) -> DataFrame:
    from ..plans import graph

    back = table(spark, d, "part").where("p_size = 5 and p_partkey >= 8").select(F.floor(F.col("p_partkey") / 8).alias("src"), F.col("p_partkey").alias("dst"))
    found = graph.strong_components(part_edges(spark, d).select("src", "dst").unionByName(back))
    sizes = found.groupBy("component").agg(F.count("*").alias("peers"))
    return found.join(sizes, "component").select("node", "peers")

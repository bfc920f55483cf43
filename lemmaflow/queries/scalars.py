"""Queries of column functions, filters, pages and sets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..functions import identifiers as ids
from ..functions import text
from ..operators import sets
from ..sources import books

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/$', '') || CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]+/*([?#].*)?$') THEN '/' ELSE '' END AS page_key FROM pages""")
def id_normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", ids.page_key(F.col("url")).alias("page_key"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'W' || c_custkey END AS openalex, '10.1/ab-' || c_custkey AS doi, '2401.' || lpad(c_custkey::VARCHAR, 5, '0') AS arxiv FROM customer""")
def id_stable_identifiers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    forms = [F.concat(F.lit("https://openalex.org/w"), key), F.concat(F.lit(" openalex:W"), key), F.concat(F.lit("https://api.openalex.org/works/W"), key, F.lit("?x=1")), F.concat(F.lit("w"), key), F.concat(F.lit("author"), key)]
    raw = F.element_at(F.array(*forms), (F.col("c_custkey") % 5 + 1).cast("int"))
    doi = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/AB-"), key)).otherwise(F.concat(F.lit("DOI: 10.1/Ab-"), key))
    arxiv = F.concat(F.lit("https://arxiv.org/pdf/2401."), F.lpad(key, 5, "0"), F.lit("v3.pdf"))
    kinds = {"openalex": ("openAlex", raw), "doi": ("doi", doi), "arxiv": ("arxiv", arxiv)}
    return table(spark, d, "customer").select("c_custkey", *[ids.stable_identifier(F.lit(k), v).alias(name) for name, (k, v) in kinds.items()])


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def id_sha256_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ids.sha256(F.col("text")).alias("digest"))


@query("SELECT page_id, sha256(url) || '.json.gz' AS file FROM pages")
def id_cache_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", ids.cache_file(F.col("url")).alias("file"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9-]+', '-', 'g'), '-') AS slug FROM part""")
def id_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", ids.slug("p_name").alias("slug"))


@query("""WITH b AS (SELECT p_partkey, p_brand, trim(regexp_replace(lower(p_name), '[^a-z0-9-]+', '-', 'g'), '-') AS base, left(sha256(p_name || chr(0) || p_brand), 12) AS h FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) = 1 AS one FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY base, h, one ORDER BY p_partkey) - 1 AS again FROM n)
SELECT p_partkey, CASE WHEN one THEN base ELSE base || '-' || h || CASE WHEN again > 0 THEN '-' || again ELSE '' END END AS stable_id FROM m""")
def id_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return ids.unique_ids(rows.withColumn("fallback", F.replace("p_brand", F.lit("\0"), F.lit(""))), "p_partkey", "p_name", "fallback").select("p_partkey", "stable_id")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85   -     　]+', ' ', 'g'))) AS digest FROM documents""")
def txt_collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("digest"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\s  - 　]+', ' ', 'g'))) AS digest FROM pages""")
def txt_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(text.strip_tags(F.col("html")), 256).alias("digest"))


_LICENSE_LINES = ("See https://CreativeCommons.org/licenses/by/4.0/ now", "under creativecommons.org/licenses/by-sa/4.0/", "creativecommons.org/licenses/by-nc-sa/4.0/legalcode", "GNU free documentation license,  version 1.3 or any later version", "GNU Free Documentation License Version 1.2  or any later version", "Creative Commons Attribution", "creativecommons.org/licenses/by/4.0/ and creativecommons.org/licenses/by-sa/4.0/")


@query(rf"""WITH d AS (SELECT doc_id, text || ' ' || {list(_LICENSE_LINES)!r}[1 + doc_id % 7] AS t FROM documents), k AS (SELECT doc_id, lower(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM d),
m AS (SELECT doc_id, [x FOR x IN [CASE WHEN contains(replace(t, 'license,', 'license'), 'gnu free documentation license version 1.2 or any later version') THEN 'GFDL-1.2-or-later' END, CASE WHEN contains(replace(t, 'license,', 'license'), 'gnu free documentation license version 1.3 or any later version') THEN 'GFDL-1.3-or-later' END,
CASE WHEN contains(t, 'creativecommons.org/licenses/by-nc-sa/4.0/') THEN 'CC-BY-NC-SA-4.0' END, CASE WHEN contains(t, 'creativecommons.org/licenses/by-sa/4.0/') THEN 'CC-BY-SA-4.0' END, CASE WHEN contains(t, 'creativecommons.org/licenses/by/4.0/') THEN 'CC-BY-4.0' END] IF x IS NOT NULL] AS found FROM k)
SELECT doc_id, array_to_string(found, ',') AS licenses, CASE WHEN len(found) = 1 THEN found[1] END AS license FROM m""")
def txt_license_detect(spark: SparkSession, d: str) -> DataFrame:
    line = F.element_at(F.array(*[F.lit(x) for x in _LICENSE_LINES]), (F.col("doc_id") % 7 + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit(None).cast("string")), line).alias("text"), F.col("text").isNull().alias("none"))
    docs = docs.select("doc_id", F.when(~F.col("none"), F.col("text")).alias("text"))
    return docs.select("doc_id", F.array_join(text.licenses(F.col("text")), ",").alias("licenses"), text.license_of(F.col("text")).alias("license"))


@query(r"""SELECT page_id, i - 1 AS position, hrefs[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages), unnest(range(1, len(hrefs) + 1)) AS t(i)""")
def txt_extract_links(spark: SparkSession, d: str) -> DataFrame:
    links = F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"')))
    return table(spark, d, "pages").select("page_id", links.alias("position", "href")).withColumn("position", F.col("position").cast("long"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS shown, upper(left(replace(lower(o_orderpriority), '-', ' '), 1)) || substr(replace(lower(o_orderpriority), '-', ' '), 2) AS priority FROM orders""")
def txt_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.long_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shown"), text.enum_label(F.lower("o_orderpriority")).alias("priority"))


@query("""SELECT doc_id, lang, source FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'the th')""")
def flt_catalog_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(F.contains(text.search_text(F.col("text"), F.col("lang"), F.col("source")), F.lit("the th"))).select("doc_id", "lang", "source")


@query("""SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r BETWEEN 51 AND 100""")
def ord_page_slice(spark: SparkSession, d: str) -> DataFrame:
    return sets.page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 2, 50)


@query("""SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def ord_prev_next(spark: SparkSession, d: str) -> DataFrame:
    return sets.neighbours(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role").drop("role")


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def ord_topk(spark: SparkSession, d: str) -> DataFrame:
    found = sets.top(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3)
    return found.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 50 AS batch FROM lineitem""")
def ord_request_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return sets.batches(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 50).drop("l_partkey")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def set_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return sets.first_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH a AS (SELECT DISTINCT p_partkey AS key FROM part WHERE p_size > 10), b AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity > 49)
SELECT key, 'missing' AS side FROM a WHERE key NOT IN (FROM b) UNION ALL SELECT key, 'unexpected' FROM b WHERE key NOT IN (FROM a)""")
def set_expected_minus_seen(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("key"))
    return sets.differences(expected, table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("key")), "key")


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def set_content_dups(spark: SparkSession, d: str) -> DataFrame:
    return sets.repeated(table(spark, d, "documents").select(F.md5("text").alias("digest")), ["digest"])


@query()
def ext_html_candidates(spark: SparkSession, d: str) -> DataFrame:
    return books.html_candidates(table(spark, d, "pages"), "page_id", "html")

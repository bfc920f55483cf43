"""Queries of component files and of JSON in a stated order on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..common import shared_folder, table
from ..functions import identifiers
from ..functions.json_text import digest, json_text
from ..operators import provider
from ..plans import structure
from ..sources import component_files, envelopes
from .scalars import query


def _typed(df: DataFrame, value: Column) -> StructType:
    return df.select(value.alias("v")).schema["v"].dataType


@query("""SELECT doc_id, sha256(to_json({'doc_id': doc_id, 'text': text, 'place': {'lang': lang, 'source': source, 'none': NULL}, 'sizes': [n_chars, NULL], 'empty': []})::VARCHAR) AS whole,
sha256(to_json({'doc_id': doc_id, 'place': {'lang': lang, 'source': source, 'none': NULL}, 'sizes': [n_chars, NULL], 'empty': []})::VARCHAR) AS without_text FROM documents""")
def id_json_digest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    place = F.struct("lang", "source", F.lit(None).cast("string").alias("none"))
    value = F.struct("doc_id", "text", place.alias("place"), F.array(F.col("n_chars"), F.lit(None)).alias("sizes"), F.array().cast("array<int>").alias("empty"))
    kind = _typed(docs, value)
    return docs.select("doc_id", digest(value, kind).alias("whole"), digest(value, kind, without="text").alias("without_text"))


def part_components(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and headers: a component for each brand, its parts as nodes, part k div 2 as what each depends on."""
    key = F.col("p_partkey")
    numbered = parts.withColumn("ordinal", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    component = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("component")
    node = F.struct(F.concat(F.lit("p"), key.cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("size"), F.lit(None).cast("string").alias("note"))
    edge = F.struct(key.alias("from"), F.floor(key / 2).alias("to"))
    records = [numbered.select(component, F.lit(name).alias("collection"), F.col("ordinal").cast("long").alias("ordinal"), json_text(value, _typed(parts, value)).alias("record")) for name, value in (("nodes", node), ("directDependencies", edge))]
    named = parts.select(component).distinct()
    identity = F.struct(F.col("component").alias("componentId"), F.lit("S0001").alias("sourceRecordId"))
    meta = F.struct(F.lit(component_files.PHASE).alias("phase"), identity.alias("identity"), F.lit(None).cast("string").alias("exactEdition"), F.lit("done").alias("extractionState"), F.lit("captured").alias("graphState"))
    heads = named.select("component", F.lit("S0001").alias("source_record"), json_text(meta, _typed(named, meta)).alias("metadata"), F.lit(None).cast("string").alias("distribution"))
    return records[0].unionByName(records[1]), heads


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/components-{uuid.uuid4().hex}"


_PARTS = "SELECT lower(replace(p_brand, '#', '-')) AS component, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ordinal, * FROM part"
_RECORDS = """SELECT component, 'nodes' AS collection, ordinal, to_json({'id': 'p' || p_partkey, 'title': p_name, 'size': p_size, 'note': NULL})::VARCHAR AS record FROM p
UNION ALL SELECT component, 'directDependencies', ordinal, to_json({'from': p_partkey, 'to': p_partkey // 2})::VARCHAR FROM p"""


@query(f"WITH p AS ({_PARTS}) {_RECORDS}")
def src_component_files(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    component_files.write_components(*part_components(table(spark, d, "part")), folder)
    return component_files.read_components(spark, folder)


@query(f"""WITH p AS ({_PARTS} WHERE p_size % 3 <> 0), r AS ({_RECORDS}), n AS (SELECT component, count(*) FILTER (WHERE collection = 'nodes') AS nodes, sum(octet_length(encode(record)) + 1)::BIGINT AS bytes FROM r GROUP BY component)
SELECT component, nodes, bytes, 2::BIGINT AS shards FROM n""")
def snk_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Parts are written, then some of them again: what the second index names is all there is."""
    folder, parts = _folder(spark), table(spark, d, "part")
    component_files.write_components(*part_components(parts), folder)
    component_files.write_components(*part_components(parts.where("p_size % 3 <> 0")), folder)
    records = component_files.read_components(spark, folder).groupBy("component").agg(F.count_if(F.col("collection") == "nodes").alias("nodes"), F.sum(F.octet_length("record") + 1).alias("bytes"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder)
    shards = there.groupBy(F.element_at(F.split("path", "/"), -3).alias("component")).agg(F.count("*").alias("shards"))
    return records.join(shards, "component")


@query("""SELECT lower(replace(p_brand, '#', '-')) AS component, 'captured' AS state, 'S0001' AS source_record, count(*) AS parts FROM part GROUP BY p_brand""")
def src_component_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Only indexes are opened for the metadata of components."""
    folder, parts = _folder(spark), table(spark, d, "part")
    component_files.write_components(*part_components(parts), folder)
    known = component_files.read_components(spark, folder, index_only=True)
    counts = parts.groupBy(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("component")).agg(F.count("*").alias("parts"))
    return known.select("component", F.get_json_object("metadata", "$.graphState").alias("state"), F.get_json_object("metadata", "$.identity.sourceRecordId").alias("source_record")).join(counts, "component")


_RULES = [
    structure.Allowed("$", ("object",)), structure.Allowed("$.id", ("string",), pattern="^S[0-9]{4}$"), structure.Allowed("$.year", ("whole",), nullable=True), structure.Allowed("$.nodes", ("list",)),
    structure.Allowed("$.nodes[]", ("object",)), structure.Allowed("$.nodes[].kind", ("string",), values=("lemma", "theorem")), structure.Allowed("$.nodes[].open", ("boolean",)),
]


@query("""SELECT c_custkey AS k, '$.extra' AS at, 'unknown-key' AS rule FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, '$.nodes[1].open', 'missing-key' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, '$.nodes[0].kind', 'value' FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey, '$.id', CASE WHEN c_custkey % 13 = 0 THEN 'type' ELSE 'pattern' END FROM customer WHERE c_custkey % 13 = 0 OR c_custkey > 9999
UNION ALL SELECT c_custkey, '$.year', CASE WHEN c_custkey % 34 = 0 THEN 'missing-key' ELSE 'type' END FROM customer WHERE c_custkey % 17 = 0""")
def val_structure(spark: SparkSession, d: str) -> DataFrame:
    """A document for each customer, with violations of every kind by its key."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    key = k.cast("string")
    id_ = F.when(k % 13 == 0, key).otherwise(text('"S', F.when(k > 9999, key).otherwise(F.lpad(key, 4, "0")), '"'))
    year = F.when(k % 34 == 0, "").when(k % 17 == 0, ',"year":"x"').when(k % 3 == 0, ',"year":null').otherwise(text(',"year":', F.col("c_nationkey").cast("string")))
    kind = F.when(k % 11 == 0, "idea").otherwise("lemma")
    second = F.when(k % 5 == 0, '{"kind":"theorem"}').otherwise('{"open":false,"kind":"theorem"}')
    extra = F.when(k % 7 == 0, ',"extra":{"deep":[1]}').otherwise("")
    document = text('{"id":', id_, year, ',"nodes":[{"kind":"', kind, '","open":true},', second, "]", extra, "}")
    return structure.violations(table(spark, d, "customer").select(k.alias("k"), document.alias("document")), "k", _RULES)


_CUSTOMERS = "c AS (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS n, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer), p AS (SELECT *, n // 50 AS page, n % 50 AS place FROM c)"


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 50 works for each nation; the last page of every third nation is not there, the first of every seventh has no date."""
    place = W.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = table(spark, d, "customer").select("*", (F.row_number().over(place) - 1).alias("n"), F.count("*").over(W.partitionBy("c_nationkey")).alias("total"))
    key = F.col("c_custkey").cast("string")
    work = F.struct(
        F.concat(F.lit("https://openalex.org/W"), key).alias("id"), F.concat(F.lit("https://doi.org/10.1/AB-"), key).alias("doi"), F.col("c_name").alias("title"),
        F.array(F.struct(F.struct(F.col("c_mktsegment").alias("display_name")).alias("author"))).alias("authorships"), (1900 + F.col("c_nationkey")).alias("publication_year"),
    )
    page = F.floor(F.col("n") / 50)
    made = rows.groupBy("c_nationkey", page.alias("page"), F.floor((F.col("total") - 1) / 50).alias("last")).agg(F.array_sort(F.collect_list(F.struct("n", work.alias("work")))).alias("works"))
    cursor = lambda k: F.when(k == 0, "*").otherwise(F.concat(F.lit("c="), k.cast("string")))
    url = envelopes.collection_url(F.concat(F.lit("cites:"), F.col("c_nationkey").cast("string")), cursor(F.col("page")), 50)
    body = F.struct(F.transform("works", lambda w: w["work"]).alias("results"), F.struct(F.when(F.col("page") < F.col("last"), cursor(F.col("page") + 1)).alias("next_cursor")).alias("meta"))
    kept = made.where((F.col("c_nationkey") % 3 != 0) | (F.col("page") < F.col("last")) | (F.col("last") == 0))
    dated = F.when((F.col("c_nationkey") % 7 != 0) | (F.col("page") > 0), "t1")
    return kept.select(url.alias("url"), dated.alias("retrieved_at"), F.to_json(body).alias("body"))


def _read_back(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    envelopes.write_envelopes(_envelopes(spark, d), folder)
    return envelopes.read_envelopes(spark, folder)


@query(f"""WITH {_CUSTOMERS} SELECT 'openalex-w' || c_custkey AS paper_id, c_name AS title, c_mktsegment AS authors, (1900 + c_nationkey)::VARCHAR AS date, '10.1/ab-' || c_custkey AS doi, 'cites:' || c_nationkey AS filter, place::INTEGER AS place
FROM p WHERE (c_nationkey % 3 <> 0 OR page < (total - 1) // 50 OR total <= 50) AND (c_nationkey % 7 <> 0 OR page > 0)""")
def prov_pages(spark: SparkSession, d: str) -> DataFrame:
    """From gzipped envelopes over pages to works and papers."""
    works = envelopes.works(envelopes.pages(_read_back(spark, d)))
    places = works.select("id", "filter", "place")
    papers = provider.papers_of(works).select("paper_id", "title", F.array_join("authors", ", ").alias("authors"), "date", F.try_element_at("identifiers", F.lit("doi")).alias("doi"))
    return papers.join(places.select(identifiers.paper_id(identifiers.openalex_id(F.col("id"))).alias("paper_id"), "filter", "place"), "paper_id")


@query(f"""WITH {_CUSTOMERS}, q AS (SELECT DISTINCT c_nationkey AS k, page, (total - 1) // 50 AS last FROM p), kept AS (SELECT * FROM q WHERE k % 3 <> 0 OR page < last OR last = 0), sound AS (SELECT * FROM kept WHERE k % 7 <> 0 OR page > 0)
SELECT 'retrieved-at' AS rule, count(*) AS n FROM kept WHERE k % 7 = 0 AND page = 0 HAVING count(*) > 0
UNION ALL SELECT 'missing-page', count(*) FROM sound s WHERE page < last AND NOT EXISTS (SELECT 1 FROM sound t WHERE t.k = s.k AND t.page = s.page + 1) HAVING count(*) > 0""")
def val_envelopes(spark: SparkSession, d: str) -> DataFrame:
    found = _read_back(spark, d)
    wrong = found.select("rule").unionByName(envelopes.pages(found).select("rule")).where("rule is not null")
    return wrong.groupBy("rule").agg(F.count("*").alias("n"))

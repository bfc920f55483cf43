"""Cached answers of a provider as tables (SRC10, SRC14, SRC41, VAL14): envelopes, pages, works.

An envelope is a gzipped file of JSON (url, retrievedAt, body), named by the sha256 of its url. Bodies are
VARIANT columns, so fields that a provider adds or leaves out change no schema; only what is
asked for is read out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BASE = "https://api.openalex.org/works"


def collection_url(filter_: Column, cursor: Column, per_page: int) -> Column:
    """The address of a page of works."""
    paged = F.when(cursor.isNotNull() & (cursor != ""), F.concat(F.lit("&cursor="), F.url_encode(cursor))).otherwise("")
    return F.concat(F.lit(f"{_BASE}?filter="), F.url_encode(filter_), F.lit(f"&per-page={per_page}"), paged)


def _got(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def write_envelopes(envelopes: DataFrame, folder: str) -> None:
    """envelopes: (url, retrieved_at, body), body as JSON. One file for each, below a folder named by its url's digest."""
    quoted = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    value = F.concat(F.lit('{"url":'), quoted(F.col("url")), F.lit(',"retrievedAt":'), quoted(F.col("retrieved_at")), F.coalesce(F.concat(F.lit(',"body":'), "body"), F.lit("")), F.lit("}"))
    envelopes.select(F.sha2("url", 256).alias("envelope"), value.alias("value")).write.option("compression", "gzip").partitionBy("envelope").text(folder)


def read_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """(key, url, retrieved_at, body, rule): rule says what is wrong with an envelope, null for a sound one."""
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(folder)
    parsed = files.select(F.regexp_extract(F.col("_metadata.file_path"), "([0-9a-f]{64})[^0-9a-f]", 1).alias("key"), F.try_parse_json("value").alias("v"))
    rows = parsed.select("key", _got(F.col("v"), "$.url").alias("url"), F.schema_of_variant(_got(F.col("v"), "$.retrievedAt", "variant")).alias("kind"), _got(F.col("v"), "$.retrievedAt").alias("retrieved_at"), _got(F.col("v"), "$.body", "variant").alias("body"), F.col("v").isNull().alias("broken"))
    rule = (
        F.when(F.col("broken"), "json")
        .when(F.col("url").isNull() | (F.sha2("url", 256) != F.col("key")), "url")
        .when(F.coalesce(F.col("kind"), F.lit("")) != "STRING", "retrieved-at")
        .when(F.col("body").isNull(), "body")
    )
    return rows.select("key", "url", "retrieved_at", "body", rule.alias("rule"))


def pages(envelopes: DataFrame) -> DataFrame:
    """(url, filter, cursor, next_cursor, results, retrieved_at, rule): pages of collections; rule is ``results`` for a page without
    a list of results, ``repeated-cursor`` where two pages lead to one, ``missing-page`` where the next page is not there."""
    rows = envelopes.where("rule is null and contains(url, '?filter=')")
    part = lambda name: F.try_url_decode(F.nullif(F.regexp_extract("url", rf"[?&]{name}=([^&]*)", 1), F.lit("")))
    listed = rows.select("url", part("filter").alias("filter"), part("cursor").alias("cursor"), _got(F.col("body"), "$.meta.next_cursor").alias("next_cursor"), _got(F.col("body"), "$.results", "array<variant>").alias("results"), "retrieved_at")
    same = W.partitionBy("filter")
    known = F.collect_set("cursor").over(same)
    twice = F.count("*").over(W.partitionBy("filter", "next_cursor"))
    wrong = (
        F.when(F.col("results").isNull(), "results")
        .when(F.col("next_cursor").isNotNull() & (twice > 1), "repeated-cursor")
        .when(F.col("next_cursor").isNotNull() & ~F.array_contains(known, F.col("next_cursor")), "missing-page")
    )
    return listed.withColumn("rule", wrong)


def works(pages_: DataFrame) -> DataFrame:
    """(filter, url, cursor, place, retrieved_at and the columns of ``provider.papers_of``): a row for each work of a page."""
    each = pages_.where("results is not null").select("filter", "url", "cursor", "retrieved_at", F.posexplode("results").alias("place", "w"))
    w = F.col("w")
    location = lambda v: F.struct(_got(v, "$.landing_page_url").alias("landing_page_url"), _got(v, "$.source.display_name").alias("source"), _got(v, "$.license").alias("license"))
    author = lambda a: F.struct(_got(a, "$.author.display_name").alias("name"), _got(a, "$.raw_author_name").alias("raw"))
    plain = {"id": "$.id", "ids_openalex": "$.ids.openalex", "ids_doi": "$.ids.doi", "doi": "$.doi", "display_name": "$.display_name", "title": "$.title", "publication_date": "$.publication_date", "type": "$.type"}
    return each.select(
        "filter", "url", "cursor", "place", "retrieved_at",
        *[_got(w, path).alias(name) for name, path in plain.items()],
        F.transform(_got(w, "$.authorships", "array<variant>"), author).alias("authors"),
        _got(w, "$.publication_year", "int").alias("publication_year"),
        location(_got(w, "$.primary_location", "variant")).alias("primary"),
        location(_got(w, "$.best_oa_location", "variant")).alias("best"),
        F.transform(_got(w, "$.locations", "array<variant>"), location).alias("locations"),
        F.struct(*[_got(w, f"$.biblio.{n}").alias(n) for n in ("volume", "issue", "first_page", "last_page")]).alias("biblio"),
        _got(w, "$.referenced_works", "array<string>").alias("referenced"),
    )

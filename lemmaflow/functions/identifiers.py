"""Identifiers, hashes and addresses as Column functions (ID01-ID08, ID11, ID14, ID17, ID18, ID21-ID25, ID26-ID29, ID31-ID33, ID35, ID38, ID43, ID44)."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from urllib.parse import unquote_to_bytes, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = ("openAlex", "doi", "arxiv", "semanticScholar", "isbn", "internal")

#: fixed formats of the identifier kinds: prefixes and suffixes that carry no identity
_OPENALEX = r"(?i)^https?://(?:api\.)?openalex\.org/(?:works/)?"
_DOI = (r"(?i)^https?://(?:dx\.)?doi\.org/", r"(?i)^doi:\s*")
_ARXIV = (r"(?i)^https?://arxiv\.org/(?:abs|pdf)/", r"(?i)^arxiv:\s*", r"(?i)\.pdf$", r"(?i)v\d+$")
_SCHOLAR = r"(?i)^https?://www\.semanticscholar\.org/paper/"
_ISBN = (r"(?i)^isbn(?:-1[03])?:?\s*", r"[\s-]")


def _without(value: Column, *patterns: str) -> Column:
    for pattern in patterns:
        value = F.regexp_replace(value, pattern, "")
    return value


def nonempty(value: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))


def openalex_id(value: Column) -> Column:
    """W and digits in upper case; null if the value has not that form."""
    tail = F.upper(F.regexp_extract(_without(nonempty(value), _OPENALEX, r"(?i)^openalex:"), "^[^/?#]*", 0))
    return F.when(F.regexp_like(tail, F.lit(r"^W\d+$")), tail)


def stable_identifier(kind: Column, value: Column) -> Column:
    """The form in which identifiers of a kind are compared; null for blanks and unknown kinds."""
    raw = nonempty(value)
    return (
        F.when(kind == "openAlex", openalex_id(raw))
        .when(kind == "doi", F.lower(_without(raw, *_DOI)))
        .when(kind == "arxiv", F.lower(_without(raw, *_ARXIV)))
        .when(kind == "semanticScholar", F.lower(_without(raw, _SCHOLAR)))
        .when(kind == "isbn", F.upper(_without(raw, *_ISBN)))
        .when(kind == "internal", F.lower(raw))
    )


def corpus_identifier(kind: Column, value: Column) -> Column:
    """The looser form that corpus rules compare: neither trimmed nor checked."""
    openalex = F.upper(F.regexp_extract(_without(value, _OPENALEX, r"(?i)^openalex:"), "^[^/?#]*", 0))
    return (
        F.when(kind == "openAlex", openalex)
        .when(kind == "doi", F.lower(_without(value, *_DOI)))
        .when(kind == "arxiv", F.lower(_without(value, *_ARXIV)))
        .when(kind == "isbn", F.upper(_without(value, *_ISBN)))
        .otherwise(F.lower(value))
    )


def identifier_or_text(kind: Column, value: Column) -> Column:
    return F.coalesce(stable_identifier(kind, value), F.lower(F.trim(value)))


def paper_id(openalex: Column) -> Column:
    return F.concat(F.lit("openalex-"), F.lower(openalex))


def arxiv_id(urls: Column) -> Column:
    """The first arXiv id among an array of addresses."""
    found = F.filter(F.transform(urls, lambda u: F.regexp_extract(u, r"(?i)arxiv\.org/(?:abs|pdf)/([^?#]+)", 1)), lambda x: F.length(x) > 0)
    return stable_identifier(F.lit("arxiv"), F.get(found, 0))


def venue(source: Column, volume: Column, issue: Column, first: Column, last: Column) -> Column:
    """Source, volume, issue and pages in one line; a range of one page is that page."""
    pages = F.when(last.isNotNull() & (first != last), F.concat(first, F.lit("-"), last)).otherwise(first)
    details = [F.concat(F.lit("volume "), nonempty(volume)), F.concat(F.lit("issue "), nonempty(issue)), F.concat(F.lit("pages "), nonempty(pages))]
    return F.concat_ws(", ", F.coalesce(nonempty(source), F.lit("Venue not supplied by OpenAlex")), *details)


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def cache_file(url: Column) -> Column:
    return F.concat(sha256(url), F.lit(".json.gz"))


def tag_node_id(tag: Column) -> Column:
    return F.concat(F.lit("tag-"), F.lower(tag))


def unit_id(stem: Column) -> Column:
    return F.concat(F.lit("unit-"), stem)


def source_label(kind: Column, tag: Column) -> Column:
    return F.concat(F.upper(F.left(kind, F.lit(1))), F.substr(kind, F.lit(2)), F.lit(" "), tag)


def repository(remote: Column) -> Column:
    """The https address of a repository, from an https or ssh remote."""
    name = F.regexp_extract(remote, r"^(?:https://github\.com/|git@github\.com:|ssh://git@github\.com/)([\w.-]+/[\w.-]+?)(?:\.git)?/?$", 1)
    return F.when(F.length(name) > 0, F.concat(F.lit("https://github.com/"), name))


def permalink(repo: Column, commit: Column, file: Column, line: Column) -> Column:
    return F.concat(repo, F.lit("/blob/"), commit, F.lit("/"), file, F.coalesce(F.concat(F.lit("#L"), line.cast("string")), F.lit("")))


def page_key(url: Column) -> Column:
    """Host and port in lower case, and the decoded path without doubled or trailing slashes."""
    host = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^?#]*)", 1), "/{2,}", "/"), "/$", "")
    return F.when(F.length(host) > 0, F.concat(F.lower(host), percent_decode(F.when(F.length(path) > 0, path).otherwise("/"))))


def https_if_same_host(link: Column, source: Column) -> Column:
    same = (F.try_parse_url(link, F.lit("HOST")) == F.try_parse_url(source, F.lit("HOST"))) & source.startswith("https://")
    return F.when(same, F.regexp_replace(link, "^http://", "https://")).otherwise(link)


def short_identifier(identifiers: Column, own: Column) -> Column:
    """The first of DOI, arXiv, OpenAlex and internal identifier, with its label."""
    named = [F.concat(F.lit(label), identifiers[kind]) for kind, label in (("doi", "DOI "), ("arxiv", "arXiv:"), ("openAlex", "OpenAlex "), ("internal", ""))]
    return F.coalesce(*named, own)


@F.pandas_udf(StringType())
def slug(values: pd.Series) -> pd.Series:
    """NFKD text in lower case, of a-z, 0-9 and single dashes, ``id-`` before any other start."""

    def one(value: str | None) -> str:
        bare = re.sub(r"-+", "-", re.sub(r"[^a-z0-9-]+", "-", unicodedata.normalize("NFKD", value or "").lower())).strip("-")
        return bare if bare else "id-item"

    return values.map(one)


@F.pandas_udf(StringType())
def percent_decode(values: pd.Series) -> pd.Series:
    """Percent-decoded text; malformed input stays as it is."""

    def one(value: str | None) -> str | None:
        if value is None or re.search(r"%(?![0-9A-Fa-f]{2})", value):
            return value
        try:
            return unquote_to_bytes(value).decode("utf-8")
        except UnicodeDecodeError:
            return value

    return values.map(one)


@F.pandas_udf(StringType())
def http_url(values: pd.Series, bases: pd.Series) -> pd.Series:
    """The absolute address of a link on a page; null unless it is http or https."""

    def one(value: str | None, base: str | None) -> str | None:
        try:
            found = urljoin(base or "", value) if value is not None else ""
        except ValueError:
            return None
        return found if re.match("https?://[^/]", found, re.I) else None

    return pd.Series([one(v, b) for v, b in zip(values, bases)], dtype=object)


@F.pandas_udf(StringType())
def canonical_digest(documents: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text written anew with sorted keys and without blanks."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return documents.map(one)


def unique_ids(rows, order: str, preferred: str, fallback: str, digits: int = 12):
    """``rows`` with a column ``stable_id``: the slug of the preferred name, or of the fallback
    without one, followed by a digest and a number where an earlier row of the same slug has it."""
    from pyspark.sql import Window as W

    base = rows.withColumn("base_", slug(F.coalesce(F.nullif(F.col(preferred), F.lit("")), F.col(fallback))))
    digest = F.left(sha256(F.concat(F.coalesce(F.col(preferred), F.lit("")), F.lit("\0"), F.coalesce(F.col(fallback), F.lit("")))), F.lit(digits))
    base = base.withColumn("nth_", F.row_number().over(W.partitionBy("base_").orderBy(order))).withColumn("long_", F.concat("base_", F.lit("-"), digest))
    first = F.col("nth_") == 1
    base = base.withColumn("again_", F.row_number().over(W.partitionBy("long_", first).orderBy(order)) - 1)
    name = F.when(first, F.col("base_")).otherwise(F.concat("long_", F.when(F.col("again_") > 0, F.concat(F.lit("-"), F.col("again_"))).otherwise(F.lit(""))))
    return base.withColumn("stable_id", name).drop("base_", "nth_", "long_", "again_")

"""Strict structure of JSON documents (VAL01, VAL10, SET09): a table of allowed paths, and a violation for each departure.

A document is a VARIANT. Its values are walked level by level as far as the allowed paths go, without a
shuffle: objects as maps, lists as arrays. What no rule names is reported where it
stands and not walked on.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Allowed:
    """A path such as ``$.nodes[].id``, the kinds its values may have (object, list, string, whole, number, boolean),
    whether they may be null and must be there, and what strings may be."""

    path: str
    kinds: tuple[str, ...]
    nullable: bool = False
    required: bool = True
    values: tuple[str, ...] = ()
    pattern: str | None = None


def kind_of(value: Column) -> Column:
    """The kind of a VARIANT."""
    said = F.schema_of_variant(value)
    number = F.regexp_like(said, F.lit("^(?:BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\([0-9]+,0\\))$"))
    return (
        F.when(F.startswith(said, F.lit("OBJECT")), "object").when(F.startswith(said, F.lit("ARRAY")), "list").when(said == "STRING", "string")
        .when(said == "BOOLEAN", "boolean").when(said == "VOID", "null").when(number, "whole").otherwise("number")
    )


def _lookup(pairs: dict[str, Column], key: Column, none: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), key), none) if pairs else none


def violations(documents: DataFrame, key: str, rules: Iterable[Allowed]) -> DataFrame:
    """documents: (key, document) with the document as JSON. (key, at, rule): ``at`` is the place with numbers in lists. Rules
    are ``json``, ``unknown-key``, ``missing-key``, ``null``, ``type``, ``value`` and ``pattern``."""
    known = {r.path: r for r in rules}
    names = F.array(*[F.lit(p) for p in known])
    words = lambda of: {p: F.array(*[F.lit(x) for x in of(r)]).cast("array<string>") for p, r in known.items()}
    children: dict[str, list[str]] = {p: [] for p in known}
    for path, rule in known.items():
        parent, _, name = path.rpartition(".")
        if rule.required and parent in children and not name.endswith("[]"):
            children[parent].append(name)
    none = F.array().cast("array<string>")
    parsed = documents.select(key, F.try_parse_json("document").alias("value"))
    found = [parsed.where("value is null").select(key, F.lit("$").alias("at"), F.lit("json").alias("rule"))]
    level = parsed.where("value is not null").select(key, F.lit("$").alias("path"), F.lit("$").alias("at"), "value")
    depth = max(p.count(".") + p.count("[]") for p in known) + 1
    for _ in range(depth):
        path, kind = F.col("path"), F.col("kind")
        rows = level.withColumn("kind", kind_of(F.col("value"))).withColumn("known", F.array_contains(names, path))
        allowed = _lookup(words(lambda r: r.kinds), path, none)
        fits = F.array_contains(allowed, kind) | ((kind == "whole") & F.array_contains(allowed, F.lit("number")))
        text = F.try_variant_get("value", "$", "string")
        values = _lookup(words(lambda r: r.values), path, none)
        pattern = _lookup({p: F.lit(r.pattern) for p, r in known.items() if r.pattern}, path, F.lit(None).cast("string"))
        nullable = _lookup({p: F.lit(r.nullable) for p, r in known.items()}, path, F.lit(False))
        wrong = (
            F.when(~F.col("known"), "unknown-key").when((kind == "null") & nullable, None).when(kind == "null", "null").when(~fits, "type")
            .when((kind == "string") & (F.size(values) > 0) & ~F.array_contains(values, text), "value").when((kind == "string") & ~F.rlike(text, pattern), "pattern")
        )
        there = F.when(kind == "object", F.map_keys(F.try_variant_get("value", "$", "map<string,variant>")))
        needed = _lookup({p: F.array(*[F.lit(n) for n in c]).cast("array<string>") for p, c in children.items()}, path, none)
        missing = F.when(F.col("known") & there.isNotNull(), F.array_except(needed, there))
        found.append(rows.withColumn("rule", wrong).where("rule is not null").select(key, "at", "rule"))
        found.append(rows.select(key, "at", F.explode(missing).alias("name")).select(key, F.concat("at", F.lit("."), "name").alias("at"), F.lit("missing-key").alias("rule")))
        inner = rows.where("known and kind in ('object', 'list')")
        fields = inner.where("kind = 'object'").select(key, "path", "at", F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("name", "value"))
        fields = fields.select(key, F.concat("path", F.lit("."), "name").alias("path"), F.concat("at", F.lit("."), "name").alias("at"), "value")
        items = inner.where("kind = 'list'").select(key, "path", "at", F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("n", "value"))
        items = items.select(key, F.concat("path", F.lit("[]")).alias("path"), F.concat("at", F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("at"), "value")
        level = fields.unionByName(items)
    return reduce(DataFrame.unionByName, found)

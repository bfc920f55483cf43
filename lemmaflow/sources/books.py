"""Book sources as tables of nodes, edges, routes and references (SRC21, SRC23, EXT01, EXT02, EXT05, EXT14).

Units are (component, unit, ordinal, content). A small parser lists the environments or
tags of each unit; everything after that is joins, windows and groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators.joins import preceding
from ..operators.views import route_groups

#: fixed values: environments that become nodes, with class
ENVIRONMENTS = {"theorem": "theorem-like", "lemma": "theorem-like", "proposition": "theorem-like", "corollary": "theorem-like", "definition": "support", "example": "support", "remark": "support"}
#: fixed pattern: titles of proofs that are complete by themselves
ALTERNATIVE = r"(?i)^(?:first|second|third) proof\b(?!.*proof of part\b)"


def read_units(spark: SparkSession, folder: str, component: str) -> DataFrame:
    """Text files under a folder, one unit each, in order of their names."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    units = files.select(F.lit(component).alias("component"), name.alias("unit"), F.col("value").alias("content"))
    # only the names go through one order, not the contents
    names = files.select(name.alias("n")).withColumn("ordinal", F.row_number().over(W.orderBy("n")))
    numbered = names.groupBy("n").agg(F.min("ordinal").alias("ordinal"))
    return units.join(numbered, units["unit"] == numbered["n"]).drop("n")


def tag_rows(lines: DataFrame) -> DataFrame:
    """(tag, label) of lines ``TAG,label``; comments and blank lines are left out."""
    parts = F.split("value", ",", 2)
    return lines.where(F.regexp_like("value", F.lit(r"^[^#\s][^,]*,"))).select(F.trim(parts[0]).alias("tag"), F.trim(parts[1]).alias("label"))


def nodes_of(units: DataFrame) -> DataFrame:
    """One row for each environment or section of TeX units: (component, unit, start, end,
    environment, title, body, label)."""
    found = text.tex_environment_rows(units.select("component", "unit", "content"), "content")
    return found.withColumn("label", F.get(text.labels(F.col("body")), 0))


def extract_tex(units: DataFrame, alternative: str = ALTERNATIVE, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables node, dependency, route, unresolved and proof of TeX units. A proof belongs to the
    nearest theorem before it, unless a section starts in between. Two proofs or more with a
    title like ``alternative`` are a route each; else all proofs of a theorem are one route.
    Labels that two nodes have are ambiguous and stay unresolved. found: rows of ``nodes_of``, if they are made already."""
    found = nodes_of(units) if found is None else found
    sections = units.select("component", "unit", "content").select("component", "unit", F.inline(text.tex_sections("content")))
    events = found.where(F.col("environment").isin("proof", *ENVIRONMENTS)).unionByName(sections, allowMissingColumns=True)
    node = F.concat_ws(":", "unit", F.coalesce("label", F.concat_ws("-", "environment", "start")))
    events = events.withColumn("node", node).withColumn("node_class", F.create_map(*[F.lit(x) for pair in ENVIRONMENTS.items() for x in pair])[F.col("environment")])
    owned = preceding(events, ["component", "unit"], ["start"], F.coalesce(F.col("node_class") == "theorem-like", F.lit(False)), F.col("environment") == "section", "node")
    nodes = events.where("node_class is not null").select("component", "unit", "node", "node_class", F.col("environment").alias("kind"), "label", text.clean_title(F.col("title")).alias("title"), text.tex_statement(F.col("body")).alias("statement"), "start")
    proofs = owned.where("environment = 'proof' and owner_of is not null").select("component", "unit", F.col("owner_of").alias("theorem"), "start", "end", "title", "body")

    titled = F.regexp_like(F.coalesce("title", F.lit("")), F.lit(alternative))
    grouped = route_groups(proofs, ["component", "theorem"], ["unit", "start"], titled)
    refs = grouped.select("component", "theorem", "route", F.explode(F.regexp_extract_all(text.without_comments(F.col("body")), F.lit(r"\\(?:eq)?ref\{([^{}]+)\}"))).alias("ref"))
    bound = nodes.where("label is not null").groupBy("component", F.col("label").alias("ref")).agg(F.count("*").alias("n"), F.min("node").alias("target"))
    linked = refs.join(bound, ["component", "ref"], "left")
    edges = linked.where("n = 1 and target <> theorem").groupBy("component", "theorem", "target").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("route")).alias("routes"))
    prerequisites = nodes.select("component", F.col("node").alias("target"), "node_class", "kind")
    edges = edges.join(prerequisites, ["component", "target"]).withColumn("role", text.dependency_role(F.col("node_class"), F.col("kind"))).drop("node_class", "kind")
    in_routes = edges.select("component", "theorem", F.explode("routes").alias("route"), "target").groupBy("component", "theorem", "route").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    routes = grouped.where("route is not null").select("component", "theorem", "route").distinct().join(in_routes, ["component", "theorem", "route"], "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    unresolved = linked.where("n is null or n > 1").select("component", "theorem", "ref", F.when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("reason")).distinct()
    return {"node": nodes, "dependency": edges, "route": routes, "unresolved": unresolved, "proof": proofs}


def html_candidates(pages: DataFrame, key: str, source: str) -> DataFrame:
    """(key, position, level, title, node_class, kind) of all headings of HTML pages, one for
    each key; class and kind are null where the heading names no kind of statement."""
    listed = pages.select(key, text.scan_tags(F.col(source), names=[f"h{n}" for n in range(1, 7)]).alias("tags"))
    heads = listed.select(key, F.posexplode("tags").alias("n", "tag"))
    after = F.lead("tag").over(W.partitionBy(key).orderBy("n"))
    opened = heads.withColumn("close", after).where("not tag.closing").join(pages.select(key, F.col(source).alias("source__")), key)
    stop = F.when(F.col("close.closing"), F.col("close.start")).otherwise(F.length("source__"))
    title = text.decode_entities(text.strip_tags(F.substr("source__", F.col("tag.end") + 1, stop - F.col("tag.end"))))
    rows = opened.select(key, F.col("tag.start").alias("position"), F.substr(F.col("tag.name"), F.lit(2)).cast("int").alias("level"), title.alias("title"))
    kind = text.semantic_kind(F.col("title"))
    return rows.select("*", kind["node_class"].alias("node_class"), kind["kind"].alias("kind"))

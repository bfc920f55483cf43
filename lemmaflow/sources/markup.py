"""XML books and web exports as tables (SRC26-SRC31, EXT11-EXT13, FLT14-FLT16, ORD12).

Units are (component, unit, ordinal, content). Tags are listed unit by unit; that tags
pair to elements, and elements to parents, is found by windows over the depth of tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import stash
from ..functions import text
from ..operators.joins import innermost, preceding
from ..operators.merge import union_by

#: fixed values: elements that become nodes, with class and kind
XML_NODES = {
    "theorem": ("theorem-like", "theorem"), "lemma": ("theorem-like", "lemma"), "proposition": ("theorem-like", "proposition"), "corollary": ("theorem-like", "corollary"), "claim": ("theorem-like", "claim"),
    "principle": ("theorem-like", "named-result"), "fact": ("theorem-like", "named-result"), "identity": ("theorem-like", "named-result"),
    "definition": ("support", "definition"), "axiom": ("support", "axiom"), "assumption": ("support", "assumption"), "notation": ("support", "notation"), "construction": ("support", "construction"), "algorithm": ("support", "algorithm"),
}
#: fixed values: types and states of exported items that are part of a book
ACTIVE_TYPES = ("front-matter", "part", "chapter")
ACTIVE_STATES = ("publish", "web-only")

_PLACE = ["component", "unit"]


def elements(units: DataFrame) -> DataFrame:
    """(component, unit, start, stop, inner_start, inner_stop, name, attributes, parent):
    every element, with the bounds of what is between its tags and the start of the element
    around it. An element that is never closed runs to the end of its unit. The windows
    carry offsets only, no text."""
    tags = text.tag_rows(units.select(*_PLACE, F.length("content").alias("length"), "content"), "content", xml=True)
    step = F.when(F.col("closing"), -1).when(F.col("single"), 0).otherwise(1)
    before = F.coalesce(F.sum(step).over(W.partitionBy(*_PLACE).orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tags = tags.withColumn("depth", F.when(F.col("closing"), before).otherwise(before + 1))
    close = F.when(F.col("closing"), F.struct("start", "end"))
    after = F.last(close, ignorenulls=True).over(W.partitionBy(*_PLACE, "depth").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1))
    stop = F.when(F.col("single"), F.col("end")).otherwise(F.coalesce(after["end"], "length"))
    inner_stop = F.when(F.col("single"), F.col("end")).otherwise(F.coalesce(after["start"], "length"))
    found = tags.withColumn("stop", stop).withColumn("inner_stop", inner_stop).where(~F.col("closing"))
    # an element is the parent of what follows it one level deeper, until the next of its own level
    rows = found.select(*_PLACE, "n", "start", "stop", F.col("end").alias("inner_start"), "inner_stop", "name", "attributes", F.explode(F.array(F.struct("depth", F.lit(False).alias("outer")), F.struct((F.col("depth") + 1).alias("depth"), F.lit(True).alias("outer")))).alias("at"))
    around = F.last(F.when(F.col("at.outer"), F.col("start")), ignorenulls=True).over(W.partitionBy(*_PLACE, "at.depth").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("parent", around).where(~F.col("at.outer")).drop("at", "n")


def _without(inner: Column, *names: str) -> Column:
    return F.regexp_replace(inner, rf"(?s)<({'|'.join(names)})\b[^>]*(?<!/)>.*?</\1\s*>", " ")


def _mapped(position: int) -> Column:
    return F.create_map(*[F.lit(x) for name, pair in XML_NODES.items() for x in (name, pair[position])])[F.col("name")]


def extract_xml(units: DataFrame) -> dict[str, DataFrame]:
    """Tables node, dependency, route and reference of XML units. A proof belongs to the
    innermost statement around it, or else to the nearest theorem before it among its
    siblings, unless that theorem has a proof inside. Ids that two nodes have are in no
    lookup; a theorem has a route only if it depends on something."""
    every = stash(elements(units), "xml-elements")
    ordinal = F.row_number().over(W.partitionBy(*_PLACE, "name").orderBy("start"))
    named = every.where(F.col("name").isin(*XML_NODES)).withColumn("ordinal", ordinal)
    own = F.col("attributes")["xml:id"]
    fallback = F.concat_ws("-", "name", "unit", F.lpad(F.col("ordinal").cast("string"), 4, "0"))
    keys = stash(named.select(*_PLACE, F.coalesce(own, fallback).alias("node"), own.alias("xml_id"), _mapped(0).alias("node_class"), _mapped(1).alias("kind"), "start", "stop", "inner_start", "inner_stop"), "xml-nodes")
    # texts are cut in one pass over their unit, beside what the rest needs of the nodes
    places = keys.groupBy(*_PLACE).agg(F.array_sort(F.collect_list(F.struct("start", "inner_start", "inner_stop"))).alias("p"))
    places = places.select(*_PLACE, F.col("p.start").alias("starts"), F.col("p.inner_start").alias("from"), F.col("p.inner_stop").alias("to"))
    cut = text.cut_rows(units.select(*_PLACE, "content").join(places.drop("starts"), _PLACE), "content", "from", "to").withColumnRenamed("piece", "inner")
    at = places.select(*_PLACE, F.posexplode("starts").alias("n", "start"))
    stated = F.regexp_extract("inner", r"(?s)<statement\b[^>]*>(.*?)</statement\s*>", 1)
    body = F.when(F.length(stated) > 0, _without(stated, "idx")).otherwise(_without(F.col("inner"), "idx", "title", "proof", "solution"))
    title = F.regexp_extract("inner", r"(?s)<title\b[^>]*>(.*?)</title\s*>", 1)
    texts = cut.join(at, [*_PLACE, "n"]).select(*_PLACE, "start", text.decode_entities(text.strip_tags(title)).alias("title"), text.decode_entities(text.strip_tags(body)).alias("statement"))
    nodes = keys.join(texts, [*_PLACE, "start"]).select(*_PLACE, "node", "xml_id", "node_class", "kind", "title", "statement", "start", "stop")

    proofs = every.where("name = 'proof'").select(*_PLACE, "start", "stop")
    nested = innermost(proofs, keys.select(*_PLACE, F.col("start").alias("s"), F.col("stop").alias("e"), F.col("node").alias("around"), F.col("node_class").alias("around_class")), _PLACE, "start", "s", "e", ["around", "around_class"])
    full = nested.where("around_class = 'theorem-like'").select(F.col("component"), F.col("around").alias("node")).distinct().withColumn("full", F.lit(True))
    siblings = every.where(F.col("name").isin("proof", *XML_NODES)).join(keys.select(*_PLACE, "start", "node", "node_class"), [*_PLACE, "start"], "left")
    siblings = preceding(siblings, [*_PLACE, "parent"], ["start"], F.coalesce(F.col("node_class") == "theorem-like", F.lit(False)), F.lit(False), "node")
    alone = siblings.where("name = 'proof' and owner_of is not null").select(*_PLACE, "start", F.col("owner_of").alias("node")).join(full, ["component", "node"], "left").where("full is null").select(*_PLACE, "start", F.col("node").alias("before"))
    owned = nested.join(alone, [*_PLACE, "start"], "left").withColumn("owner", F.when(F.col("around").isNotNull(), F.when(F.col("around_class") == "theorem-like", F.col("around"))).otherwise(F.col("before"))).where("owner is not null")
    owned = stash(owned, "xml-proofs")

    links = every.where("name = 'xref'").select(*_PLACE, "start", F.coalesce(F.col("attributes")["ref"], F.lit("missing-ref-attribute")).alias("ref"))
    in_proof = stash(innermost(links, owned.select(*_PLACE, F.col("start").alias("s"), F.col("stop").alias("e"), "owner"), _PLACE, "start", "s", "e", ["owner"]), "xml-links")
    stated_in = every.where("name = 'statement'").select(*_PLACE, F.col("start").alias("s"), F.col("stop").alias("e"), F.lit(True).alias("in_statement"))
    in_node = innermost(in_proof.where("owner is null").drop("owner"), keys.select(*_PLACE, F.col("start").alias("s"), F.col("stop").alias("e"), F.col("node").alias("owner")), _PLACE, "start", "s", "e", ["owner"])
    in_statement = innermost(in_node.where("owner is not null"), stated_in, _PLACE, "start", "s", "e", ["in_statement"]).where("in_statement").drop("in_statement")
    captured = in_proof.where("owner is not null").withColumn("basis", F.lit("proof-xref")).unionByName(in_statement.withColumn("basis", F.lit("statement-xref")))

    lookup = keys.where("xml_id is not null").groupBy("component", F.col("xml_id").alias("ref")).agg(F.count("*").alias("n"), F.min(F.struct("node", "kind")).alias("t")).where("n = 1").select("component", "ref", F.col("t.node").alias("target"), F.col("t.kind").alias("kind"))
    resolved = captured.join(lookup, ["component", "ref"], "left").withColumn("target", F.when((F.col("basis") != "proof-xref") | (F.col("target") != F.col("owner")), F.col("target")))
    used = resolved.where("basis = 'proof-xref' and target is not null")
    role = F.when(F.col("kind").isin("definition", "notation", "construction", "calculation"), F.col("kind")).otherwise("logical")
    edges = used.groupBy("component", F.col("owner").alias("theorem"), "target", role.alias("role")).agg(F.count("*").alias("occurrences"))
    routes = edges.groupBy("component", "theorem").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    references = resolved.select(*_PLACE, "owner", "basis", "ref", "start", "target", F.when(F.col("target").isNull(), "unresolved").otherwise("resolved").alias("status"))
    return {"node": nodes, "dependency": edges, "route": routes, "reference": references}


def includes(units: DataFrame) -> DataFrame:
    """(component, src, dst, seq): include elements of XML units, for closure() and
    reading_order(); each target is a unit by its file name without folder and ending."""
    found = elements(units).where(F.regexp_like("name", F.lit("^(?:xi:)?include$")))
    target = F.regexp_extract(F.col("attributes")["href"], r"([^/]+?)(?:\.[^./]+)?$", 1)
    return found.select("component", F.col("unit").alias("src"), target.alias("dst"), F.col("start").alias("seq")).where("dst <> ''")


_ITEM = "`title` string, `link` string, `wp:post_id` string, `wp:post_parent` string, `wp:menu_order` string, `wp:post_type` string, `wp:post_name` string, `wp:status` string, `content:encoded` string, `wp:postmeta` array<struct<`wp:meta_key`: string, `wp:meta_value`: string>>, `category` array<struct<`_domain`: string, `_nicename`: string, `_VALUE`: string>>"


def read_export(spark: SparkSession, path: str, component: str) -> DataFrame:
    """The items of a web export, one row each; of two values of a key the first one counts."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(_ITEM).load(path)
    number = lambda name, other: F.coalesce(F.expr(f"try_cast(trim(`{name}`) AS bigint)"), F.lit(other))
    entries = F.filter(F.transform("wp:postmeta", lambda x: F.struct(x["wp:meta_key"].alias("key"), F.coalesce(x["wp:meta_value"], F.lit("")).alias("value"))), lambda x: x["key"].isNotNull())
    meta = F.map_from_entries(union_by(entries, entries, lambda x: x["key"]))
    rows = raw.select(
        F.lit(component).alias("component"), F.monotonically_increasing_id().alias("at"), number("wp:post_id", -1).alias("post_id"), number("wp:post_parent", 0).alias("post_parent"), number("wp:menu_order", 0).alias("menu_order"),
        F.lower(F.trim("wp:post_type")).alias("post_type"), F.lower(F.trim("wp:status")).alias("status"), F.col("wp:post_name").alias("slug"), text.collapse(F.col("title")).alias("title"), "link", F.col("content:encoded").alias("html"),
        F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("meta"), "category",
    )
    pieces = F.array_distinct(F.filter(F.array("html", F.col("meta")["pb_part_content"]), lambda x: F.length(F.trim(x)) > 0))
    rows = rows.withColumn("content", F.array_join(pieces, "\n")).withColumn("exported", F.lower(F.coalesce(F.col("meta")["pb_export"], F.lit("on"))) != "off")
    # an item's place within its split, and how many items the splits before hold; contents are not moved
    rows = rows.withColumns({"split": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = rows.groupBy(F.col("split").alias("s")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("s", before.alias("before"))
    return rows.join(starts, F.col("split") == F.col("s")).withColumn("ordinal", (F.col("place") + F.col("before") + 1).cast("int")).drop("at", "split", "place", "s", "before")


def ordered_items(items: DataFrame) -> DataFrame:
    """Items that are part of the book, with ``position``: front matter, then every part
    with its chapters after it, then chapters without a part, by their parent."""
    active = items.where(F.col("post_type").isin(*ACTIVE_TYPES) & F.col("status").isin(*ACTIVE_STATES) & F.col("exported"))
    own = F.struct("menu_order", "post_id", "ordinal")
    parts = active.where("post_type = 'part'").groupBy("component", F.col("post_id").alias("post_parent")).agg(F.min(own).alias("part_at"))
    joined = active.join(parts, ["component", "post_parent"], "left")
    kind, child = F.col("post_type"), F.col("part_at").isNotNull()
    section = F.when(kind == "front-matter", 0).when((kind == "part") | child, 1).otherwise(2)
    group = F.when(kind == "part", own).when((kind == "chapter") & child, F.col("part_at"))
    orphan = F.when(section == 2, F.col("post_parent"))
    order = W.partitionBy("component").orderBy(section, group, F.when(kind == "part", 0).otherwise(1), orphan, own)
    # only keys go through one order, not the contents
    places = joined.select("component", F.col("ordinal").alias("at"), F.row_number().over(order).alias("position"))
    same = (active["component"] == places["component"]) & (active["ordinal"] == places["at"])
    return active.join(places, same).drop(places["component"]).drop("at")

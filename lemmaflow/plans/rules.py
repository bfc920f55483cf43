"""Integrity rules: each gives violations (rule, entity, detail) as rows (VAL02-VAL05, VAL15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import on_cycles

Tables = dict[str, DataFrame]
_EVIDENCED = ("node", "external_input", "dependency", "proof_route", "reference", "unit_inventory")


def _rows(df: DataFrame, rule: str, entity: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), detail.cast("string").alias("detail"))


def holds(df: DataFrame, rule: str, predicate: Column, entity: Column, detail: Column | None = None) -> DataFrame:
    """Rows for which the predicate is not true; null counts as not true."""
    return _rows(df.where(~F.coalesce(predicate, F.lit(False))), rule, entity, F.lit("") if detail is None else detail)


def unique(df: DataFrame, rule: str, key: list[str]) -> DataFrame:
    found = df.groupBy(*key).agg(F.count("*").alias("n__")).where("n__ > 1")
    return _rows(found, rule, F.concat_ws("|", *[F.col(k).cast("string") for k in key]), F.col("n__"))


def refers(child: DataFrame, rule: str, entity: str, key: list[str], parent: DataFrame, parent_key: list[str]) -> DataFrame:
    """Rows of ``child`` whose key is no key of ``parent``. The join sorts, no table of keys goes through the driver."""
    known = parent.select(*[F.col(p).alias(f"p{n}__") for n, p in enumerate(parent_key)]).distinct().hint("merge")
    same = reduce(lambda a, b: a & b, [child[k] == known[f"p{n}__"] for n, k in enumerate(key)])
    return _rows(child.join(known, same, "left_anti"), rule, F.col(entity), F.concat_ws("|", *[F.col(k).cast("string") for k in key]))


def contiguous(df: DataFrame, rule: str, by: list[str], ordinal: str, first: int = 1) -> DataFrame:
    """Rows whose ordinal is not their place within the group."""
    placed = df.withColumn("place__", F.row_number().over(W.partitionBy(*by).orderBy(ordinal)) + (first - 1))
    return _rows(placed.where(F.col(ordinal) != F.col("place__")), rule, F.concat_ws("|", *[F.col(b).cast("string") for b in by]), F.col(ordinal))


def acyclic(nodes: DataFrame, edges: DataFrame, rule: str) -> DataFrame:
    return _rows(on_cycles(nodes, edges), rule, F.col("node"), F.lit("on a cycle"))


def allowed(df: DataFrame, rule: str, column: str, values: tuple[str, ...], entity: str) -> DataFrame:
    return holds(df, rule, F.col(column).isin(*values), F.col(entity), F.col(column))


def evidence_rules(df: DataFrame, name: str, entity: str, units: DataFrame) -> list[DataFrame]:
    """Evidence cites existing units, each once; a review is by another actor and of the
    captured content. evidence: struct (status, units array, actor, sha256, reviewer, reviewed_sha256)."""
    e = F.col("evidence")
    cited = df.select("component", entity, F.explode("evidence.units").alias("cited"))
    reviewed = df.where(e["status"] == "reviewed")
    return [
        allowed(df.select(entity, e["status"].alias("status")), f"{name}-evidence-status", "status", ("pending", "captured", "reviewed"), entity),
        refers(cited, f"{name}-evidence-unit", entity, ["component", "cited"], units, ["component", "unit"]),
        holds(df, f"{name}-evidence-units-distinct", F.size(F.array_distinct(e["units"])) == F.size(e["units"]), F.col(entity)),
        holds(df.where(e["status"] != "pending"), f"{name}-evidence-captured", e["actor"].isNotNull() & e["sha256"].isNotNull(), F.col(entity)),
        holds(reviewed, f"{name}-review-independent", e["reviewer"] != e["actor"], F.col(entity)),
        holds(reviewed, f"{name}-review-current", e["reviewed_sha256"] == e["sha256"], F.col(entity)),
    ]


def _inventory_rules(t: Tables) -> list[DataFrame]:
    inventory, node, unit = t["unit_inventory"], t["node"], t["source_unit"]
    listed = inventory.select("component", "unit", F.inline(F.concat(*[F.transform(c, lambda x: F.struct(x.alias("node"), F.lit(k).alias("listed_as"))) for c, k in (("theorems", "theorem-like"), ("supports", "support"), ("artifacts", "source-artifact"))])))
    both = listed.join(node.select("component", "node", "node_class", "evidence").hint("merge"), ["component", "node"], "left")
    own = inventory.join(unit.select("component", "unit", "content_sha256").hint("merge"), ["component", "unit"], "left")
    extracted = t["component"].where(F.col("extraction_status").isin("extracted", "reviewed")).select("component")
    return [
        unique(inventory, "inventory-unique", ["component", "unit"]),
        refers(inventory, "inventory-unit", "unit", ["component", "unit"], unit, ["component", "unit"]),
        holds(inventory, "inventory-own-evidence", F.col("evidence.units") == F.array("unit"), F.col("unit")),
        holds(own.where("evidence.status <> 'pending'"), "inventory-current", F.col("evidence.sha256") == F.col("content_sha256"), F.col("unit")),
        holds(inventory, "theorem-free-flag", F.col("theorem_free") == (F.size("theorems") == 0), F.col("unit")),
        holds(both, "inventory-class", F.col("node_class") == F.col("listed_as"), F.col("node"), F.col("unit")),
        holds(both.where("node_class is not null"), "inventory-node-evidence", F.array_contains("evidence.units", F.col("unit")), F.col("node"), F.col("unit")),
        unique(listed, "inventory-once", ["component", "node"]),
        refers(unit.join(extracted, "component", "left_semi"), "inventory-covers-units", "unit", ["component", "unit"], inventory, ["component", "unit"]),
        refers(node.join(extracted, "component", "left_semi"), "inventory-covers-nodes", "node", ["component", "node"], listed, ["component", "node"]),
        holds(inventory.join(extracted, "component", "left_semi"), "inventory-not-pending", F.col("evidence.status") != "pending", F.col("unit")),
    ]


def _edge_rules(t: Tables) -> list[DataFrame]:
    node, dependency, outside = t["node"], t["dependency"], t["external_input"]
    inner = dependency.where("prerequisite_type = 'node'")
    return [
        refers(dependency, "dependent-exists", "dependency", ["component", "dependent"], node, ["component", "node"]),
        refers(inner, "prerequisite-exists", "dependency", ["component", "prerequisite"], node, ["component", "node"]),
        refers(dependency.where("prerequisite_type = 'external-input'"), "external-input-exists", "dependency", ["component", "prerequisite"], outside, ["component", "input"]),
        holds(inner, "no-self-dependency", F.col("dependent") != F.col("prerequisite"), F.col("dependency")),
        unique(dependency, "dependency-once", ["component", "dependent", "prerequisite_type", "prerequisite"]),
        acyclic(node.select(F.struct("component", "node").cast("string").alias("node")), inner.select(F.struct("component", "dependent").cast("string").alias("src"), F.struct("component", "prerequisite").cast("string").alias("dst")), "acyclic"),
    ]


def _route_rules(t: Tables) -> list[DataFrame]:
    route, dependency = t["proof_route"], t["dependency"]
    theorems = t["node"].where("node_class = 'theorem-like'")
    used = route.select("component", "route", "theorem", F.explode("dependency_ids").alias("dependency"))
    owned = used.join(dependency.select("component", "dependency", "dependent").hint("merge"), ["component", "dependency"])
    signature = route.withColumns({"sorted": F.array_join(F.array_sort("dependency_ids"), ","), "sha": F.coalesce("evidence.sha256", F.lit("pending"))})
    return [
        refers(route, "route-theorem", "route", ["component", "theorem"], theorems, ["component", "node"]),
        holds(route, "route-dependencies-distinct", F.size(F.array_distinct("dependency_ids")) == F.size("dependency_ids"), F.col("route")),
        holds(route.where("kind = 'root-attestation'"), "root-without-dependencies", F.size("dependency_ids") == 0, F.col("route")),
        refers(used, "route-dependency-exists", "route", ["component", "dependency"], dependency, ["component", "dependency"]),
        holds(owned, "route-dependency-own", F.col("dependent") == F.col("theorem"), F.col("route"), F.col("dependency")),
        unique(signature, "route-once", ["component", "theorem", "kind", "sorted", "locator", "sha"]),
    ]


def _reference_rules(t: Tables) -> list[DataFrame]:
    reference, node, dependency = t["reference"], t["node"], t["dependency"]
    resolved = reference.where("status = 'resolved'")
    proof = resolved.where(F.col("basis").isin("proof-xref", "proof-citation"))
    linked = resolved.where("dependency is not null").join(dependency.select("component", "dependency", "dependent", "prerequisite_type", "prerequisite").hint("merge"), ["component", "dependency"])
    return [
        refers(reference, "reference-owner", "reference", ["component", "owner"], node, ["component", "node"]),
        unique(reference.withColumn("pin", F.coalesce("pinpoint", F.lit(""))), "reference-once", ["component", "owner", "basis", "ref", "pin", "locator"]),
        refers(resolved.where("target_type = 'node'"), "reference-target-node", "reference", ["component", "target"], node, ["component", "node"]),
        refers(resolved.where("target_type = 'external-input'"), "reference-target-input", "reference", ["component", "target"], t["external_input"], ["component", "input"]),
        holds(resolved.where("basis = 'proof-citation'"), "citation-to-input", F.col("target_type") == "external-input", F.col("reference")),
        holds(proof, "proof-reference-has-dependency", F.col("dependency").isNotNull(), F.col("reference")),
        refers(resolved.where("dependency is not null"), "reference-dependency-exists", "reference", ["component", "dependency"], dependency, ["component", "dependency"]),
        holds(linked, "reference-matches-dependency", (F.col("dependent") == F.col("owner")) & (F.col("prerequisite_type") == F.col("target_type")) & (F.col("prerequisite") == F.col("target")), F.col("reference")),
    ]


def _completion_rules(t: Tables) -> list[DataFrame]:
    from ..operators.metrics import routed_theorems

    done = t["component"].where("graph_status = 'reviewed-complete'").select("component")
    within = lambda name: t[name].join(done, "component", "left_semi")
    theorem = within("node").where("node_class = 'theorem-like'")
    routed = routed_theorems(within("proof_route").where("evidence.status = 'reviewed'"), t["dependency"], t["node"])
    used = within("proof_route").select("component", F.explode("dependency_ids").alias("dependency"))
    ids = {"node": "node", "external_input": "input", "dependency": "dependency", "proof_route": "route", "reference": "reference"}
    return [
        refers(done, "complete-has-theorems", "component", ["component"], theorem, ["component"]),
        holds(within("node"), "complete-without-artifacts", F.col("node_class") != "source-artifact", F.col("node")),
        refers(theorem, "complete-theorem-routed", "node", ["component", "node"], routed, ["component", "theorem"]),
        holds(within("reference"), "complete-references-resolved", F.col("status") == "resolved", F.col("reference")),
        refers(within("dependency"), "complete-dependency-used", "dependency", ["component", "dependency"], used, ["component", "dependency"]),
        *[holds(within(name), f"complete-{name}-reviewed", F.col("evidence.status") == "reviewed", F.col(i)) for name, i in ids.items()],
    ]


def validate_book_graph(t: Tables) -> DataFrame:
    """All violations of a set of book-graph tables; an empty result means it is valid."""
    entities = [("source_unit", "unit"), ("node", "node"), ("external_input", "input"), ("dependency", "dependency"), ("proof_route", "route"), ("reference", "reference")]
    ids = reduce(DataFrame.unionByName, [t[name].select("component", F.col(i).alias("id")) for name, i in entities])
    id_of = dict(entities) | {"unit_inventory": "unit"}
    found = [
        contiguous(t["source_unit"], "unit-ordinal", ["component"], "ordinal"),
        unique(ids, "entity-id-once", ["component", "id"]),
        holds(t["component"], "graph-after-extraction", ~((F.col("graph_status") != "not-started") & ~F.col("extraction_status").isin("extracted", "reviewed")), F.col("component")),
        *[rule for name in _EVIDENCED for rule in evidence_rules(t[name], name, id_of[name], t["source_unit"])],
        *_inventory_rules(t), *_edge_rules(t), *_route_rules(t), *_reference_rules(t), *_completion_rules(t),
    ]
    return reduce(DataFrame.unionByName, found)


def validate_snapshot(papers: DataFrame, edges: DataFrame, queue: DataFrame) -> DataFrame:
    """Citation tables: papers (paper_id, identifiers map), edges (edge_id, citing, cited), queue (paper_id)."""
    from ..functions.identifiers import stable_identifier

    known = papers.select("paper_id", F.explode("identifiers").alias("kind", "value")).withColumn("norm", stable_identifier(F.col("kind"), F.col("value"))).where("norm is not null")
    shared = known.groupBy("kind", "norm").agg(F.count_distinct("paper_id").alias("n")).where("n > 1")
    return reduce(DataFrame.unionByName, [
        unique(papers, "paper-once", ["paper_id"]), unique(edges, "edge-once", ["citing", "cited"]), unique(queue, "queue-once", ["paper_id"]),
        refers(edges, "citing-exists", "edge_id", ["citing"], papers, ["paper_id"]), refers(edges, "cited-exists", "edge_id", ["cited"], papers, ["paper_id"]),
        refers(queue, "queue-paper", "paper_id", ["paper_id"], papers, ["paper_id"]),
        holds(edges, "no-self-citation", F.col("citing") != F.col("cited"), F.col("edge_id")),
        _rows(shared, "identifier-owner", F.concat_ws(":", "kind", "norm"), F.col("n")),
    ])

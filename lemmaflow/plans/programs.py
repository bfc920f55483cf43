"""Rules and coverage of reading programs: roadmaps, textbooks, compression programs and
source ledgers (VAL17-VAL23, AGG12-AGG13, FLT20-FLT22). Every table has a column ``program``;
rules give violations (rule, entity, detail) as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import end_of_chain
from .rules import Tables, acyclic, contiguous, holds, refers, unique

#: fixed values: what a classified occurrence can be, and node kinds that can be trained on
MAPPED = ("rewritten-core", "equivalent-to-core", "alternate-proof", "bridge")
RESIDUAL = ("specialist-extension", "historical-or-corrected")
OPEN = ("unclassified", "unresolved")
TRAINABLE = ("law", "method", "theorem")


def _all(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def _lists(df: DataFrame, entity: str, column: str, parent: DataFrame, key: str, name: str) -> list[DataFrame]:
    """An array of ids has no repeats, and every id exists."""
    listed = df.select("program", entity, F.explode(column).alias("listed"))
    return [
        holds(df, f"{name}-distinct", F.size(F.array_distinct(column)) == F.size(column), F.col(entity)),
        refers(listed, f"{name}-exists", entity, ["program", "listed"], parent, ["program", key]),
    ]


def _prerequisites(df: DataFrame, entity: str, column: str, name: str) -> list[DataFrame]:
    """No row is its own prerequisite, directly or by way of others."""
    named = lambda c: F.struct("program", F.col(c).alias("id")).cast("string")
    edges = df.select("program", entity, F.explode(column).alias("listed"))
    return [
        holds(edges, f"{name}-not-itself", F.col("listed") != F.col(entity), F.col(entity)),
        acyclic(df.select(named(entity).alias("node")).distinct(), edges.select(named(entity).alias("src"), named("listed").alias("dst")), f"{name}-acyclic"),
    ]


def _reviewed(df: DataFrame, entity: str, name: str, state: str = "status") -> DataFrame:
    """A row is reviewed exactly if it names who reviewed it."""
    return holds(df, f"{name}-review-evidence", (F.col(state) == "reviewed") == F.col("reviewer").isNotNull(), F.col(entity))


def validate_roadmap(t: Tables) -> DataFrame:
    """part (part, number); chapter (chapter, slug, number, part, prerequisites, clusters)."""
    part, chapter = t["part"], t["chapter"]
    numbers = part.select("program", "part", F.col("number").alias("part_number"))
    in_order = chapter.join(numbers, ["program", "part"]).withColumn("before", F.lag("part_number").over(W.partitionBy("program").orderBy("number")))
    asked = chapter.select("program", "chapter", "number", F.explode("prerequisites").alias("asked"))
    earlier = asked.join(chapter.select("program", F.col("chapter").alias("asked"), F.col("number").alias("asked_number")), ["program", "asked"])
    return _all([
        *[unique(part, f"part-{c}-once", ["program", c]) for c in ("part", "number")],
        *[unique(chapter, f"chapter-{c}-once", ["program", c]) for c in ("chapter", "slug", "number")],
        contiguous(part, "part-order", ["program"], "number"),
        contiguous(chapter, "chapter-order", ["program"], "number"),
        holds(chapter, "chapter-id", F.col("chapter") == F.format_string("R%03d", F.col("number").cast("int")), F.col("chapter")),
        refers(part, "part-not-empty", "part", ["program", "part"], chapter, ["program", "part"]),
        refers(chapter, "chapter-part", "chapter", ["program", "part"], part, ["program", "part"]),
        holds(in_order, "part-contiguous", F.coalesce(F.col("before") <= F.col("part_number"), F.lit(True)), F.col("chapter")),
        holds(chapter, "chapter-clusters-distinct", F.size(F.array_distinct("clusters")) == F.size("clusters"), F.col("chapter")),
        holds(earlier, "prerequisite-earlier", F.col("asked_number") < F.col("number"), F.col("chapter"), F.col("asked")),
        *_lists(chapter, "chapter", "prerequisites", chapter, "chapter", "prerequisite"),
        *_prerequisites(chapter, "chapter", "prerequisites", "prerequisite"),
    ])


def validate_textbook(t: Tables) -> DataFrame:
    """source (source, record); chapter (chapter, number); notation (notation, first_node); node
    (node, slug, section, chapter, kind, trainable, proof_goal, prerequisites, notations, sources)."""
    source, chapter, notation, node = t["source"], t["chapter"], t["notation"], t["node"]
    placed = node.join(chapter.select("program", "chapter", "number"), ["program", "chapter"])
    has_goal = F.length(F.coalesce("proof_goal", F.lit(""))) > 0
    return _all([
        *[unique(source, f"source-{c}-once", ["program", c]) for c in ("source", "record")],
        *[unique(chapter, f"chapter-{c}-once", ["program", c]) for c in ("chapter", "number")],
        *[unique(node, f"node-{c}-once", ["program", c]) for c in ("node", "slug", "section")],
        unique(notation, "notation-once", ["program", "notation"]),
        refers(chapter, "chapter-not-empty", "chapter", ["program", "chapter"], node, ["program", "chapter"]),
        refers(node, "node-chapter", "node", ["program", "chapter"], chapter, ["program", "chapter"]),
        refers(notation, "notation-first-node", "notation", ["program", "first_node"], node, ["program", "node"]),
        holds(placed, "section-of-chapter", F.split("section", r"\.")[0].try_cast("int") == F.col("number"), F.col("node")),
        holds(node, "trainable-has-goal", F.col("trainable") == has_goal, F.col("node")),
        holds(node.where("trainable"), "trainable-kind", F.col("kind").isin(*TRAINABLE), F.col("node"), F.col("kind")),
        *_lists(node, "node", "prerequisites", node, "node", "prerequisite"),
        *_lists(node, "node", "notations", notation, "notation", "notation"),
        *_lists(node, "node", "sources", source, "source", "source")[1:],
        *_prerequisites(node, "node", "prerequisites", "prerequisite"),
    ])


def validate_compression(t: Tables) -> DataFrame:
    """family (family); band (band, clusters); cluster (cluster, slug, status, families, nodes,
    reviewer); route (cluster, route, kind, dependency_kind, review_state, equivalence,
    prerequisites, parent, reviewer); residual (cluster, residual, status, families, reviewer)."""
    family, band, cluster, route, residual = (t[k] for k in ("family", "band", "cluster", "route", "residual"))
    memberships = band.select("program", F.explode("clusters").alias("cluster")).groupBy("program", "cluster").agg(F.count("*").alias("bands"))
    counts = route.groupBy("program", "cluster").agg(
        F.count_if(F.col("kind") == "canonical").alias("canonical"),
        F.count_if(F.col("dependency_kind") == "original").alias("original"),
        F.bool_and(F.when(F.col("kind") == "canonical", F.col("dependency_kind") == "minimized")).alias("short"),
    )
    counted = cluster.select("program", "cluster").join(counts, ["program", "cluster"], "left").join(memberships, ["program", "cluster"], "left")
    parents = route.select("program", "cluster", F.col("route").alias("parent"), F.col("dependency_kind").alias("parent_kind"))
    derived = route.join(parents, ["program", "cluster", "parent"], "left")
    needed = route.groupBy("program", "cluster").agg(F.array_distinct(F.flatten(F.collect_list("prerequisites"))).alias("prerequisites"))
    return _all([
        unique(family, "family-once", ["program", "family"]), unique(band, "band-once", ["program", "band"]),
        *[unique(cluster, f"cluster-{c}-once", ["program", c]) for c in ("cluster", "slug")],
        unique(route, "route-once", ["program", "cluster", "route"]), unique(residual, "residual-once", ["program", "cluster", "residual"]),
        holds(counted, "cluster-in-one-band", F.col("bands") == 1, F.col("cluster")),
        holds(counted, "one-canonical-route", F.col("canonical") == 1, F.col("cluster")),
        holds(counted, "one-original-route", F.col("original") == 1, F.col("cluster")),
        holds(counted, "canonical-minimized", F.col("short"), F.col("cluster")),
        refers(route.where("parent is not null"), "route-parent-exists", "route", ["program", "cluster", "parent"], route, ["program", "cluster", "route"]),
        holds(derived.where("dependency_kind = 'minimized'"), "minimized-from-original", F.col("parent_kind") == "original", F.col("route")),
        holds(route.where("equivalence = 'exact'"), "exact-after-review", F.col("review_state") == "reviewed", F.col("route")),
        _reviewed(route, "route", "route", "review_state"), _reviewed(residual, "residual", "residual"), _reviewed(cluster, "cluster", "cluster"),
        holds(cluster, "cluster-nodes-distinct", F.size(F.array_distinct("nodes")) == F.size("nodes"), F.col("cluster")),
        *_lists(band, "band", "clusters", cluster, "cluster", "band-cluster"),
        *_lists(cluster, "cluster", "families", family, "family", "cluster-family"),
        _lists(residual, "residual", "families", family, "family", "residual-family")[1],
        _lists(route, "route", "prerequisites", cluster, "cluster", "route-prerequisite")[1],
        *_prerequisites(needed, "cluster", "prerequisites", "route-prerequisite"),
    ])


def validate_crosswalk(lens_branch: DataFrame, representative: DataFrame, branch: DataFrame, record: DataFrame) -> DataFrame:
    """lens_branch (lens, branch, title); representative (lens, record, citation); branch
    (branch, title); record (record, citation, branch): every branch is covered, and lenses
    name branches and records as they are registered."""
    key = ["program", "lens", "record"]
    known = representative.join(record.select("program", "record", "branch"), ["program", "record"])
    return _all([
        unique(lens_branch, "lens-branch-once", ["program", "lens", "branch"]), unique(representative, "representative-once", key),
        refers(lens_branch, "lens-branch-exists", "lens", ["program", "branch"], branch, ["program", "branch"]),
        refers(lens_branch, "lens-branch-title", "lens", ["program", "branch", "title"], branch, ["program", "branch", "title"]),
        refers(representative, "representative-registered", "lens", ["program", "record", "citation"], record, ["program", "record", "citation"]),
        refers(known, "representative-in-branches", "lens", ["program", "lens", "branch"], lens_branch, ["program", "lens", "branch"]),
        refers(branch, "branch-covered", "branch", ["program", "branch"], lens_branch, ["program", "branch"]),
    ])


def unauthorized_reviews(reviews: DataFrame, administrators: DataFrame) -> DataFrame:
    """reviews (program, entity, reviewer) by actors that are no administrators (program, actor)."""
    return refers(reviews.where("reviewer is not null"), "reviewer-allowed", "entity", ["program", "reviewer"], administrators, ["program", "actor"])


def terminal_occurrences(occurrence: DataFrame, claim: DataFrame, residual: DataFrame) -> DataFrame:
    """``occurrence`` (occurrence, disposition, decision, relation, claims, residuals) with
    ``terminal``: verified, and everything it is mapped to is reviewed. claim (claim, status,
    targets); residual (residual, status)."""

    def settled(column: str, good: DataFrame, name: str) -> DataFrame:
        listed = occurrence.select("program", "occurrence", F.explode(column).alias("listed"))
        ok = good.select("program", F.col(good.columns[1]).alias("listed"), F.lit(True).alias("ok")).distinct()
        return listed.join(ok, ["program", "listed"], "left").groupBy("program", "occurrence").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias(name))

    claims = settled("claims", claim.where("status = 'reviewed' and targets > 0").select("program", "claim"), "claims_done")
    residuals = settled("residuals", residual.where("status = 'reviewed'").select("program", "residual"), "residuals_done")
    joined = occurrence.join(claims, ["program", "occurrence"], "left").join(residuals, ["program", "occurrence"], "left")
    done = lambda c: F.coalesce(F.col(c), F.lit(False))
    rest = F.when(F.col("relation").isin("source-stronger", "overlapping"), done("residuals_done")).otherwise(F.size("residuals") == 0)
    terminal = F.when(F.col("disposition").isin(*MAPPED), done("claims_done") & rest).when(F.col("disposition").isin(*RESIDUAL), done("residuals_done")).otherwise(False)
    verified = F.coalesce(F.col("decision") == "verified", F.lit(False))
    return joined.withColumn("terminal", verified & terminal).drop("claims_done", "residuals_done")


def complete_records(record: DataFrame, edition: DataFrame) -> DataFrame:
    """(program, record, complete): a duplicate counts as what its chain ends in, and is
    complete if that is resolved to editions, all with a complete inventory. record: (record,
    state, duplicate_of, editions); edition: (edition, inventory)."""
    name = lambda c: F.struct("program", F.col(c).alias("id")).cast("string")
    done = edition.where("inventory = 'audited-complete'").select("program", F.col("edition").alias("listed"), F.lit(True).alias("ok")).distinct()
    listed = record.where("state = 'resolved-editions'").select("program", "record", F.explode("editions").alias("listed"))
    own = listed.join(done, ["program", "listed"], "left").groupBy("program", "record").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("good"))
    good = own.where("good").select(name("record").alias("last"), F.lit(True).alias("good"))
    chained = record.where("state = 'duplicate-record' and duplicate_of is not null")
    ends = end_of_chain(chained.select(name("record").alias("node"), name("duplicate_of").alias("next"))).where("not broken").select("node", F.col("last").alias("end"))
    keyed = record.select("program", "record", name("record").alias("node")).join(ends, "node", "left").withColumn("last", F.coalesce("end", "node"))
    return keyed.join(good, "last", "left").select("program", "record", F.coalesce("good", F.lit(False)).alias("complete"))


def coverage_summary(t: Tables) -> DataFrame:
    """One row for each program: counts of records, editions and occurrences, and whether all
    records are complete. Tables as in complete_records() and terminal_occurrences()."""
    count = lambda condition: F.count_if(condition)
    records = t["record"].join(complete_records(t["record"], t["edition"]), ["program", "record"]).groupBy("program").agg(
        F.count("*").alias("source_records"), count(F.col("state") != "unresolved").alias("resolved_records"), count("complete").alias("complete_records"))
    editions = t["edition"].groupBy("program").agg(F.count("*").alias("editions"), count(F.col("inventory") == "audited-complete").alias("complete_editions"))
    kind = F.col("disposition")
    occurrences = terminal_occurrences(t["occurrence"], t["claim"], t["residual"]).groupBy("program").agg(
        F.count("*").alias("theorem_occurrences"), count(~kind.isin(*OPEN)).alias("classified_occurrences"), count("terminal").alias("terminal_occurrences"),
        count(F.col("terminal") & kind.isin(*MAPPED)).alias("verified_mappings"), count(F.col("terminal") & kind.isin(*RESIDUAL)).alias("verified_residuals"),
        count(kind.isin(*OPEN)).alias("unresolved_occurrences"))
    both = records.join(editions, "program", "left").join(occurrences, "program", "left").na.fill(0)
    return both.withColumn("complete", F.col("complete_records") == F.col("source_records"))

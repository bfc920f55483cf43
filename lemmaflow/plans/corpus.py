"""Integrity rules of a citation corpus as tables of violations (VAL09, VAL11-VAL13, VAL15, GRF10, GRF11).

Tables, of which each function names those it reads:
paper (paper_id, status, featured, identifiers map, coverage struct (outgoing_found,
outgoing_resolved, incoming_found, incoming_resolved, incoming_status, closed), graph struct
(main_root, roots array, views array of (id, roots, expanded)));
statement (statement, global_id, paper_id, kind, dependencies, source_statement, note,
formal_status, formal_alignment, cluster, declarations array of (name, certified), routes array
of (id, kind, status, verification, alignment, parent, dependencies, steps array of (id, refs,
formal))); edge (edge_id, citing, cited, source, direction); queue (paper_id, state, tasks,
unresolved array).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import corpus_identifier
from .graph import strong_components
from .rules import Tables, _rows, holds, refers, unique

#: fixed values: kinds that need a proof
THEOREM_LIKE = ("theorem", "lemma", "proposition", "corollary", "imported-result")


def certified(kernel: Column, sorry: Column, admit: Column, placeholders: Column, external: Column, axioms: Column, accepted: Column) -> Column:
    """True for a formal declaration without anything that is left open or assumed."""
    return F.coalesce(kernel & ~sorry & ~admit & ~external & accepted & (F.size(placeholders) == 0) & (F.size(axioms) == 0), F.lit(False))


def paper_rules(t: Tables) -> DataFrame:
    """Rules of papers and their graph views. Reads paper and statement."""
    paper, statement = t["paper"], t["statement"]
    c, g, me = F.col("coverage"), F.col("graph"), F.col("paper_id")
    named = paper.select("paper_id", F.explode("identifiers").alias("kind", "value")).where("value <> ''")
    owners = named.groupBy("kind", corpus_identifier(F.col("kind"), F.col("value")).alias("norm")).agg(F.count_distinct("paper_id").alias("n")).where("n > 1")
    closed = (c["outgoing_resolved"] == c["outgoing_found"]) & (c["incoming_resolved"] == c["incoming_found"]) & (c["incoming_status"] == "complete")
    featured = paper.where("featured").agg(F.count("*").alias("n")).where("n > 1")
    gold = paper.where("status = 'gold'")
    views = paper.select("paper_id", F.explode("graph.views").alias("v"))
    every = F.concat(F.array(g["main_root"]), g["roots"], F.flatten(F.transform(g["views"], lambda v: F.concat(v["roots"], v["expanded"]))))
    roots = paper.select("paper_id", F.explode(F.array_distinct(F.array_compact(every))).alias("root"))
    owned = roots.join(statement.select("statement", F.col("paper_id").alias("owner")), F.col("root") == F.col("statement"))
    return reduce(DataFrame.unionByName, [
        unique(paper, "paper-once", ["paper_id"]),
        _rows(owners, "identifier-owner", F.concat_ws(":", "kind", "norm"), F.col("n")),
        holds(paper, "coverage-resolved-within-found", (c["outgoing_resolved"] <= c["outgoing_found"]) & (c["incoming_resolved"] <= c["incoming_found"]), me),
        holds(paper.where(c["incoming_status"] == "complete"), "coverage-complete", c["incoming_resolved"] == c["incoming_found"], me),
        holds(paper.where(c["closed"]), "closure-possible", closed, me),
        _rows(featured, "featured-once", F.lit("corpus"), F.col("n")),
        refers(gold, "gold-has-statement", "paper_id", ["paper_id"], statement, ["paper_id"]),
        holds(gold, "gold-has-graph", g["main_root"].isNotNull() & (F.size(g["roots"]) > 0) & (F.size(g["views"]) > 0), me),
        unique(views.select("paper_id", F.col("v.id").alias("view")), "view-once", ["paper_id", "view"]),
        refers(roots, "graph-root-exists", "paper_id", ["root"], statement, ["statement"]),
        holds(owned, "graph-root-own-paper", F.col("owner") == me, me, F.col("root")),
    ])


def statement_rules(t: Tables) -> DataFrame:
    """Rules of statements and their dependencies. Reads paper and statement."""
    paper, statement = t["paper"], t["statement"]
    me = F.col("statement")
    used = statement.select("statement", "paper_id", F.explode(F.array_distinct("dependencies")).alias("dependency"))
    other = statement.select(F.col("statement").alias("dependency"), F.col("paper_id").alias("of"))
    routed = F.array_distinct(F.flatten(F.transform("routes", lambda r: r["dependencies"])))
    same = (F.size(F.array_except(routed, "dependencies")) == 0) & (F.size(F.array_except("dependencies", routed)) == 0)
    proven = (F.col("formal_alignment") == "reviewed") & (F.size("declarations") > 0) & F.forall("declarations", lambda d: d["certified"])
    return reduce(DataFrame.unionByName, [
        unique(statement, "statement-once", ["statement"]),
        unique(statement, "global-id-once", ["global_id"]),
        refers(statement, "statement-paper", "statement", ["paper_id"], paper, ["paper_id"]),
        holds(statement, "global-namespace", F.startswith("global_id", F.concat("paper_id", F.lit("."))), me),
        holds(statement, "source-with-note", F.col("source_statement").isNull() == F.col("note").isNull(), me),
        refers(used, "dependency-exists", "statement", ["dependency"], statement, ["statement"]),
        holds(used, "no-self-dependency", F.col("dependency") != me, me),
        holds(used.join(other, "dependency"), "dependency-own-paper", F.col("of") == F.col("paper_id"), me, F.col("dependency")),
        holds(statement.where(F.size("routes") > 0), "dependencies-of-routes", same, me),
        holds(statement.where(F.col("kind").isin(*THEOREM_LIKE)), "theorem-routed", F.size("routes") > 0, me),
        holds(statement.where("formal_status = 'fully-certified'"), "certified-possible", proven, me),
    ])


def route_rules(t: Tables) -> DataFrame:
    """Rules of proof routes and their steps. Reads statement."""
    statement = t["statement"]
    route = statement.select("statement", "formal_status", "formal_alignment", "declarations", F.explode("routes").alias("r"))
    route = route.select("statement", "formal_status", "formal_alignment", "declarations", "r.*").withColumn("name", F.concat_ws("/", "statement", "id"))
    step = route.select("name", "dependencies", F.transform("declarations", lambda d: d["name"]).alias("known"), F.explode("steps").alias("s")).select("name", "dependencies", "known", "s.*")
    me, spot = F.col("name"), F.concat_ws("/", "name", "id")
    used = F.flatten(F.transform("steps", lambda s: s["refs"]))
    proven = (
        (F.col("status") == "complete") & (F.col("alignment") == "reviewed") & (F.col("formal_status") == "fully-certified")
        & (F.col("formal_alignment") == "reviewed") & (F.size("declarations") > 0) & F.forall("declarations", lambda d: d["certified"])
    )
    mine = route.select(F.col("statement").alias("s"), F.col("id").alias("parent_id"))
    derived = route.where("parent is not null and parent <> ''")
    lost = derived.where("parent = id").select("name", "parent").unionByName(derived.where("parent <> id").join(mine, (F.col("statement") == F.col("s")) & (F.col("parent") == F.col("parent_id")), "left_anti").select("name", "parent"))
    lineage = derived.join(mine, (F.col("statement") == F.col("s")) & (F.col("parent") == F.col("parent_id"))).select(F.col("name").alias("src"), F.concat_ws("/", "statement", "parent").alias("dst"))
    return reduce(DataFrame.unionByName, [
        unique(route, "route-once", ["statement", "id"]),
        refers(route.select("name", F.explode("dependencies").alias("dependency")).distinct(), "route-dependency-exists", "name", ["dependency"], statement, ["statement"]),
        unique(step, "step-once", ["name", "id"]),
        holds(step, "step-refs-declared", F.size(F.array_except("refs", "dependencies")) == 0, spot, F.array_join(F.array_sort(F.array_except("refs", "dependencies")), ",")),
        holds(step, "step-formal-declared", F.size(F.array_except("formal", "known")) == 0, spot, F.array_join(F.array_sort(F.array_except("formal", "known")), ",")),
        holds(route.where("status = 'complete'"), "complete-route-uses-all", F.size(F.array_except("dependencies", used)) == 0, me, F.array_join(F.array_sort(F.array_except("dependencies", used)), ",")),
        holds(route.where("verification = 'fully-certified'"), "certified-route-possible", proven, me),
        _rows(lost, "route-parent", me, F.col("parent")),
        holds(route.where("kind = 'minimized'"), "minimized-names-source", F.col("parent") != "", me),
        _rows(strong_components(lineage), "route-lineage-acyclic", F.col("node"), F.lit("on a cycle")),
    ])


def cycle_rules(t: Tables) -> DataFrame:
    """Statements with a dependency on a cycle that leaves their equivalence cluster; cycles
    within one cluster have been reviewed. Reads statement."""
    statement = t["statement"]
    edges = statement.select(F.col("statement").alias("src"), F.explode("dependencies").alias("dst")).distinct()
    part = strong_components(edges)
    cluster = statement.select("statement", "cluster")
    inside = edges.join(part.toDF("src", "one"), "src").join(part.toDF("dst", "two"), "dst").where("one = two")
    inside = inside.join(cluster.toDF("src", "c1"), "src").join(cluster.toDF("dst", "c2"), "dst")
    return holds(inside, "cycle-reviewed", F.col("c1") == F.col("c2"), F.col("src"), F.col("dst"))


def edge_rules(t: Tables) -> DataFrame:
    """Rules of citation edges. Reads paper and edge."""
    paper, edge = t["paper"], t["edge"]
    me = F.col("edge_id")
    return reduce(DataFrame.unionByName, [
        unique(edge, "edge-once", ["edge_id"]),
        unique(edge, "endpoints-once", ["citing", "cited"]),
        holds(edge, "no-self-citation", F.col("citing") != F.col("cited"), me),
        *[refers(edge, f"{c}-exists", "edge_id", [c], paper, ["paper_id"]) for c in ("citing", "cited", "source")],
        holds(edge, "direction-of-source", F.col("source") == F.when(F.col("direction") == "outgoing", F.col("citing")).otherwise(F.col("cited")), me),
    ])


def queue_rules(t: Tables) -> DataFrame:
    """Rules of the work queue. Reads paper and queue."""
    paper, queue = t["paper"], t["queue"]
    me, open_ids = F.col("paper_id"), F.size(F.coalesce("unresolved", F.array())) > 0
    known = paper.where(F.length(F.try_element_at("identifiers", F.lit("openAlex"))) > 0).select("paper_id")
    waiting = queue.where((F.col("state") == "blocked") & F.array_contains("tasks", "resolve-identifiers"))
    done = queue.where("state = 'complete-direct-neighborhood'")
    return reduce(DataFrame.unionByName, [
        unique(queue, "queue-once", ["paper_id"]),
        refers(queue, "queue-paper", "paper_id", ["paper_id"], paper, ["paper_id"]),
        holds(done, "complete-without-work", (F.size("tasks") == 0) & ~open_ids, me),
        holds(queue.where(open_ids), "unresolved-with-retry", F.array_contains("tasks", "fetch-outgoing"), me),
        _rows(waiting.join(known, "paper_id", "left_semi"), "blocked-without-identity", me, F.lit("")),
        refers(paper.where("coverage.closed"), "closure-complete-in-queue", "paper_id", ["paper_id"], done, ["paper_id"]),
    ])


def validate_corpus(t: Tables) -> DataFrame:
    """All violations of a corpus; an empty result means it is valid."""
    return reduce(DataFrame.unionByName, [f(t) for f in (paper_rules, statement_rules, route_rules, cycle_rules, edge_rules, queue_rules)])

"""Predicates and small selections of papers, statements, nodes and programs (FLT01-FLT03, FLT06, FLT12,
FLT15, FLT16, FLT19, FLT24-FLT26, FLT28-FLT31, PRJ01-PRJ04, PRJ07, AGG14, AGG15, AGG17, AGG18, AGG20, AGG25-AGG30, AGG32)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import stash
from ..functions.text import search_text

#: fixed values: kinds that count as theorem-like on display, and the states of a queue row that is ready
THEOREM_LIKE = ("theorem", "lemma", "proposition", "corollary", "imported-result")
READY = ("queued", "metadata-fetched")


def of_paper(statements: DataFrame, paper: str) -> DataFrame:
    return statements.where(F.col("paper_id") == paper)


def is_theorem_like(kind: Column) -> Column:
    return kind.isin(*THEOREM_LIKE)


def learning_route(routes: Column) -> Column:
    """Of an array of routes (id, kind, status, review, dependencies): a reviewed one, minimized
    before original before the first of any other kind."""
    reviewed = F.filter(routes, lambda r: r["review"] == "reviewed")
    of = lambda kind: F.get(F.filter(reviewed, lambda r: r["kind"] == kind), 0)
    return F.coalesce(of("minimized"), of("original"), F.get(reviewed, 0))


def train_candidates(statements: DataFrame, papers: DataFrame) -> DataFrame:
    """Theorem-like statements of gold papers, imported ones left out, whose route to be
    learned is complete."""
    open_ = statements.where(is_theorem_like(F.col("kind")) & (F.col("kind") != "imported-result") & (learning_route(F.col("routes"))["status"] == "complete"))
    return open_.join(papers.where("status = 'gold'").select("paper_id").distinct(), "paper_id", "left_semi")


def pool(candidates: DataFrame, paper: str | None, kind: str | None) -> DataFrame:
    """Candidates of the chosen paper and kind; null chooses all."""
    out = candidates
    for column, wanted in (("paper_id", paper), ("kind", kind)):
        out = out if wanted is None else out.where(F.col(column) == wanted)
    return out


def papers_with(papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """``papers`` that have a candidate, with their number."""
    return papers.join(candidates.groupBy("paper_id").agg(F.count("*").alias("exercises")), "paper_id")


def matches(needle: str, *fields: Column) -> Column:
    """True if any field holds the needle in either case; a blank needle matches all."""
    return F.contains(search_text(*fields), F.lit(needle.strip().lower()))


def root_options(papers: DataFrame, edges: DataFrame, citing: str, cited: str) -> DataFrame:
    """Papers with an edge on either side."""
    ends = edges.select(F.col(citing).alias("paper_id")).unionByName(edges.select(F.col(cited).alias("paper_id"))).distinct()
    return papers.join(ends, "paper_id", "left_semi")


def without_excluded(nodes: DataFrame, node: str, parent: str, excluded: Column) -> DataFrame:
    """``nodes`` none of whose ancestors, nor they themselves, are excluded. Ancestors are
    followed by pointer doubling, log(depth) rounds."""
    at = stash(nodes.select(F.col(node).alias("n"), F.col(parent).alias("up"), excluded.alias("bad")), "excluded-0")
    k = 0
    while True:
        above = at.select(F.col("n").alias("a"), F.col("up").alias("up2"), F.col("bad").alias("bad2"))
        step = at.join(above, F.col("up") == F.col("a"), "left").select("n", F.col("up2").alias("up"), (F.col("bad") | F.coalesce("bad2", F.lit(False))).alias("bad"))
        k += 1
        at = stash(step, f"excluded-{k}")
        if k >= 64 or not at.where("up is not null").limit(1).count():
            break
    return nodes.join(at.where("not bad").select(F.col("n").alias(node)), node, "left_semi")


def is_empty_graph(*collections: Column) -> Column:
    """True if all collections of a graph are empty."""
    total = F.lit(0)
    for c in collections:
        total = total + F.coalesce(F.size(c), F.lit(0))
    return total <= 0


def one_featured(papers: DataFrame) -> DataFrame:
    """The featured paper, or the first by id without one."""
    return papers.orderBy(F.coalesce("featured", F.lit(False)).desc(), "paper_id").limit(1)


def picked(rows: DataFrame, key: str, wanted: str | None) -> DataFrame:
    """The wanted row; the first in order of ``ordinal`` if there is none such."""
    return rows.orderBy((F.col(key) == F.lit(wanted)).desc_nulls_last(), "ordinal").limit(1)


def made_by(history: Column, version: str) -> Column:
    """True if a paper's history has an entry of that version."""
    return F.coalesce(F.exists(history, lambda e: e["version"] == version), F.lit(False))


def chosen_route(routes: Column, wanted: Column) -> Column:
    """The route of that id, else the first one."""
    return F.coalesce(F.get(F.filter(routes, lambda r: r["id"] == wanted), 0), F.get(routes, 0))


def chosen_dependencies(routes: Column, wanted: Column, own: Column) -> Column:
    """Dependencies of the chosen route; the statement's own without any route."""
    return F.coalesce(chosen_route(routes, wanted)["dependencies"], own)


def learning_dependencies(routes: Column, own: Column) -> Column:
    """Dependencies of the route to be learned; the statement's own if it has no route at all."""
    return F.coalesce(learning_route(routes)["dependencies"], F.when(F.size(routes) == 0, own).otherwise(F.slice(own, 1, 0)))


def root_matches(options: DataFrame, needle: str, fields: list[Column], order: list, most: int = 8) -> DataFrame:
    """The first options that hold the needle, which must have two characters."""
    found = options.where(matches(needle, *fields)) if len(needle.strip()) >= 2 else options.limit(0)
    return found.orderBy(*order).limit(most)


def count_by(rows: DataFrame, by: str, name: str = "n") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias(name))


def ordered_counts(rows: DataFrame, by: str) -> DataFrame:
    """One row: the counts by value as a list in order of the values."""
    return count_by(rows, by).agg(F.array_sort(F.collect_list(F.struct(by, "n"))).alias("counts"))


def counts_without(rows: DataFrame, promoted: DataFrame, by: str) -> DataFrame:
    """Counts of ``rows`` less those of ``promoted``, where any are left."""
    gone = count_by(promoted, by, "gone")
    left = F.col("n") - F.coalesce("gone", F.lit(0))
    return count_by(rows, by).join(gone, by, "left").select(by, left.alias("n")).where("n > 0")


def inventory(units: DataFrame, nodes: DataFrame, classes: dict[str, str]) -> DataFrame:
    """A row for each unit, empty ones too, with a sorted list of its nodes for each class.
    units: (component, unit); nodes: (component, unit, node, node_class)."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("node_class") == c, F.col("node")))).alias(name) for name, c in classes.items()]
    return units.join(nodes, ["component", "unit"], "left").groupBy("component", "unit").agg(*lists)


def ready_count(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("state").isin(*READY)).alias("ready"))


def in_order_of_appearance(rows: DataFrame, by: str, value: str, ordinal: str) -> DataFrame:
    """(by, values): the distinct values in the order in which they come first."""
    first = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.min(ordinal).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", F.col(value).alias("v"))))
    return first.groupBy(by).agg(F.transform(listed, lambda x: x["v"]).alias("values"))


def unresolved(found: Column, resolved: Column) -> Column:
    return F.greatest(found - resolved, F.lit(0))


def result_counts(statements: DataFrame) -> DataFrame:
    """Theorem-like statements and conjectures of each paper."""
    return statements.groupBy("paper_id").agg(F.count_if(is_theorem_like(F.col("kind"))).alias("results"), F.count_if(F.col("kind") == "conjecture").alias("conjectures"))

"""Keyed merges in which existing values win, and work-queue transitions (MRG01, MRG04-MRG07, STM03, STM04, STM06-STM10, FLT04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: confidence of a citation edge, from weak to strong
CONFIDENCE = ("uncertain", "provider-linked", "exact-id", "manual-reviewed")
TERMINAL = ("blocked", "complete-direct-neighborhood")
TASKS = ("fetch-outgoing", "fetch-incoming", "deduplicate")


def union_by(first: Column, second: Column, key) -> Column:
    """Both arrays without entries whose key stands before; key maps an entry to a column."""
    every = F.concat(F.coalesce(first, F.array()), F.coalesce(second, F.array()))
    return F.filter(every, lambda x, i: F.array_position(F.transform(every, key), key(x)) == i + 1)


def merge_maps(existing: Column, candidate: Column) -> Column:
    return F.map_zip_with(F.coalesce(existing, F.create_map().cast("map<string,string>")), F.coalesce(candidate, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(a, b))


def upsert(existing: DataFrame, candidate: DataFrame, key: str, combine: dict | None = None) -> DataFrame:
    """All rows of both tables, one for each key, with ``added``: existing values win where
    they are not null, unless ``combine`` has a function of both values for the column."""
    a, b = existing.alias("a"), candidate.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    columns = []
    for c in existing.columns:
        mine, theirs = F.col(f"a.{c}"), F.col(f"b.{c}") if c in candidate.columns else F.lit(None)
        value = combine[c](mine, theirs) if combine and c in combine and c != key else F.coalesce(mine, theirs)
        columns.append(value.alias(c))
    return both.select(*columns, F.col(f"a.{key}").isNull().alias("added"))


def confidence_rank(value: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), value)


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges (edge_id, citing, cited, confidence, provenance array, seq) as one for each
    pair: the first id, the strongest confidence, provenance in order without repeats."""
    merged = edges.groupBy("citing", "cited").agg(
        F.min_by("edge_id", "seq").alias("edge_id"),
        F.max_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"),
        F.array_sort(F.collect_list(F.struct("seq", "provenance"))).alias("all"),
    )
    return merged.withColumn("provenance", F.array_distinct(F.flatten("all.provenance"))).drop("all")


def merge_tasks(state: Column, mine: Column, theirs: Column) -> Column:
    """Tasks of a queue row after a merge: those of terminal rows stay as they are."""
    return F.when(state.isin(*TERMINAL), mine).otherwise(F.array_distinct(F.concat(F.coalesce(mine, F.array()), F.coalesce(theirs, F.array()))))


def discovered(queue: DataFrame, papers: DataFrame) -> DataFrame:
    """``queue`` with a fresh row for each paper (paper_id, updated_at) that has none."""
    new = papers.join(queue, "paper_id", "left_anti").select("paper_id", F.lit("metadata-fetched").alias("state"), F.array(*[F.lit(t) for t in TASKS]).alias("tasks"), F.lit(0).alias("attempts"), "updated_at")
    return queue.unionByName(new, allowMissingColumns=True)


def merge_queue(queue: DataFrame, new: DataFrame, blocks: bool = False) -> DataFrame:
    """Queue rows after a merge: rows that are blocked or complete stay, tasks of others are
    united; with ``blocks`` a blocked new row replaces an open one but keeps its attempts."""
    a, b = queue.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.paper_id") == F.col("b.paper_id"), "full_outer")
    fresh = F.col("a.paper_id").isNull()
    over = F.lit(blocks) & ~F.coalesce(F.col("a.state").isin(*TERMINAL), F.lit(False)) & F.coalesce(F.col("b.state") == "blocked", F.lit(False))
    columns = []
    for c in queue.columns:
        theirs = F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in ("paper_id", "attempts"):
            value = F.coalesce(F.col(f"a.{c}"), theirs)
        elif c == "tasks":
            value = F.when(fresh | over, theirs).otherwise(merge_tasks(F.col("a.state"), F.col("a.tasks"), theirs))
        else:
            value = F.when(fresh | over, theirs).otherwise(F.col(f"a.{c}"))
        columns.append(value.alias(c))
    return both.select(columns)


def reactivate(queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """Blocked rows that wait for an identifier start anew once their paper has one, without
    what their error was. resolved: (paper_id, retrieved_at)."""
    latest = resolved.groupBy("paper_id").agg(F.max("retrieved_at").alias("latest"))
    rows = queue.join(latest, "paper_id", "left")
    ready = F.col("latest").isNotNull() & (F.col("state") == "blocked") & F.array_contains("tasks", "resolve-identifiers")
    anew = {"state": F.lit("metadata-fetched"), "tasks": F.array(*[F.lit(t) for t in TASKS]), "updated_at": F.col("latest")}
    kept = ("paper_id", "attempts")
    return rows.select(*[F.col(c) if c in kept else F.when(ready, anew.get(c, F.lit(None))).otherwise(F.col(c)).alias(c) for c in queue.columns])


def apply_outcomes(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Queue rows after a round of work. outcomes: (paper_id, outcome, at), one row for
    each paper; outcome is ``complete``, ``incomplete``, ``audited`` or ``failed``. With columns
    ``unresolved`` (array of ids) or ``error`` the rows have a ``last_error`` as well, and the ids
    that an incomplete row still waits for."""
    columns = [c for c in ("unresolved", "error") if c in outcomes.columns]
    kind = {"unresolved": "array<string>", "error": "string"}
    filled = outcomes.select("paper_id", "outcome", "at", *[F.col(c) if c in columns else F.lit(None).cast(t).alias(c) for c, t in kind.items()])
    rows = queue.select("paper_id", "state", "tasks", "attempts", "updated_at", *[F.col(c) if c in queue.columns else F.lit(None).cast(t).alias(c) for c, t in (("last_error", "string"), ("unresolved_ids", "array<string>"))]).join(filled, "paper_id", "left")
    done, short, audited = (F.col("outcome") == x for x in ("complete", "incomplete", "audited"))
    review = F.array(F.lit("deduplicate"), F.lit("review-match"))
    kept = F.array_distinct(F.concat(F.filter("tasks", lambda t: t.isin("deduplicate", "review-match")), review))
    ids = F.coalesce("unresolved", F.array().cast("array<string>"))
    count = F.size(ids).cast("string")
    #: fixed texts
    missing = F.concat(F.lit("OpenAlex returned no work record for "), count, F.lit(" referenced identifier(s): "), F.array_join(ids, ", "))
    open_ids = F.concat(F.lit("Source-authoritative direct endpoints remain persisted; OpenAlex still did not return "), count, F.lit(" referenced identifier(s), so provider identity reconciliation remains under review."))
    review_only = F.lit("Source-authoritative direct endpoints remain persisted; provider identity reconciliation and recursive endpoint crawling remain under review.")
    out = rows.select(
        "paper_id",
        F.when(done, TERMINAL[1]).when(short, "metadata-fetched").when(audited, "neighbors-fetched").otherwise(F.col("state")).alias("state"),
        F.when(done, F.array().cast("array<string>")).when(short, F.array(F.lit("fetch-outgoing"))).when(audited, kept).otherwise(F.col("tasks")).alias("tasks"),
        (F.col("attempts") + F.col("outcome").isNotNull().cast("int")).alias("attempts"),
        F.coalesce("at", "updated_at").alias("updated_at"),
        F.when(done, F.lit(None)).when(short, missing).when(audited & (F.size(ids) > 0), open_ids).when(audited, review_only).when(F.col("outcome") == "failed", F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(short, ids).when(F.col("outcome") == "failed", F.col("unresolved_ids")).when(F.col("outcome").isNull(), F.col("unresolved_ids")).alias("unresolved_ids"),
    )
    return out if columns or "last_error" in queue.columns else out.drop("last_error", "unresolved_ids")


def eligible(queue: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows that can be fetched: open, with a fetch task, the paper has a provider id."""
    from ..functions.identifiers import openalex_id

    known = papers.where(openalex_id(F.col("openalex")).isNotNull()).select("paper_id")
    open_ = queue.where(~F.col("state").isin(*TERMINAL) & F.arrays_overlap("tasks", F.array(F.lit("fetch-outgoing"), F.lit("fetch-incoming"))))
    return open_.join(known, "paper_id", "left_semi")

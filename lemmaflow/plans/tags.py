"""Tags over nested blocks of TeX, and imports unfolded into instances (SRC24, SRC25, SRC38, SRC42, EXT17, AGG19, ORD11).

A scanner lists the commands of a text with the places of their arguments; the rest is rows. Which
command stands in which arm of which conditional is found by windows over the depth of commands.
Whether a command is reached depends on tags, and tags on commands reached before it: each round
takes the tags that are settled, chooses arms by them and passes that down; the first open command
of a text is settled by every round, so there are as many rounds as conditionals that wait for one another, not
as there are commands.

Imports hand the tags on to the file they name, so a file has as many contexts as there are different
tags it is read with. Contexts are evaluated once, level by level; their imports are then unfolded
to a tree whose key is the path of imports taken. A context that is on its own path is a cycle.

A command as the bare argument of a conditional, which would take its own arguments from behind it, and
problem blocks that a command switches on and off are not evaluated.
"""

from __future__ import annotations

import io
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .. import common
from ..common import buckets
from ..functions import tex, text

#: fixed values: commands with the number of their optional and required arguments
COMMANDS = {"iftag": (0, 3), "tagitem": (0, 3), "tagtrue": (0, 1), "tagfalse": (0, 1), "olimport": (1, 1)}
BLOCK = "tagblock"
_ARGUMENTS = "array<struct<start:int,stop:int,text:string>>"
_FOUND = f"n int, start int, stop int, command string, starred boolean, optional array<string>, arguments {_ARGUMENTS}"
_ESCAPED = re.compile(r"\\.|[{}\[\]]", re.S)
_WORD = re.compile(r"\\[A-Za-z@]+|\\.|.", re.S)
_BLANK = re.compile(r"\s*")
_VISIBLE = re.compile(r"[^\n\r]")


def stash(df: DataFrame, label: str) -> DataFrame:
    """As ``common.stash``; joins with the table sort. Its files are small for what they hold, since texts and tags of
    many contexts are alike: by their size they would go through the driver, where they are many times as large."""
    return common.stash(df, label).hint("merge")


def _partners(source: str) -> tuple[array, array]:
    """The places of opening brackets, and for each that of the closing one, -1 without one; braces and square brackets
    each for themselves."""
    open_ = {"{": array("i"), "[": array("i")}
    places, ends = array("i"), array("i")
    for m in _ESCAPED.finditer(source):
        if m[0] in open_:
            open_[m[0]].append(len(places))
            places.append(m.start())
            ends.append(-1)
        elif m[0] in "}]" and open_["{" if m[0] == "}" else "["]:
            ends[open_["{" if m[0] == "}" else "["].pop()] = m.start()
    return places, ends


def commands_of(source: str) -> Iterator[dict]:
    """The uses of COMMANDS that have all their arguments, in order of their start."""
    places, ends = _partners(source)

    def closed(at: int) -> int:
        k = bisect_left(places, at)
        return ends[k] if k < len(places) and places[k] == at else -1

    for m in re.finditer(rf"\\({'|'.join(COMMANDS)})(?![A-Za-z@])", source):
        optional, required = COMMANDS[m[1]]
        at = _BLANK.match(source, m.end()).end()
        starred = m[1] == "olimport" and source[at : at + 1] == "*"
        at = _BLANK.match(source, at + 1).end() if starred else at
        options, arguments = [], []
        while len(options) < optional and source[at : at + 1] == "[" and (end := closed(at)) >= 0:
            options.append(source[at + 1 : end])
            at = _BLANK.match(source, end + 1).end()
        while len(arguments) < required and at < len(source):
            if source[at] == "{":
                if (end := closed(at)) < 0:
                    break
                inner, end = (at + 1, end), end + 1
            else:
                end = _WORD.match(source, at).end()
                inner = (at, end)
            arguments.append({"start": inner[0], "stop": inner[1], "text": source[slice(*inner)]})
            at = _BLANK.match(source, end).end()
        if len(arguments) == required:
            yield {"start": m.start(), "stop": at, "command": m[1], "starred": starred, "optional": options, "arguments": arguments}


def _names(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def nested(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: (by, n, start, stop, ..) of ranges that nest. Adds ``parent``, the n of the innermost range around each."""
    events = rows.select(*by, "n", F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("step")))))
    order = W.partitionBy(*by).orderBy("at", "step")
    opened = events.withColumn("depth", F.sum("step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("step = 1")
    # a range is the parent of what follows it one level deeper, until the next of its own level
    levels = opened.select(*by, "n", "at", F.explode(F.array(F.struct("depth", F.lit(False).alias("outer")), F.struct((F.col("depth") + 1).alias("depth"), F.lit(True).alias("outer")))).alias("level"))
    around = F.last(F.when(F.col("level.outer"), F.col("n")), ignorenulls=True).over(W.partitionBy(*by, "level.depth").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    return rows.hint("merge").join(levels.withColumn("parent", around).where(~F.col("level.outer")).select(*by, "n", "parent"), [*by, "n"])


def tokens(units: DataFrame, key: str = "unit") -> DataFrame:
    """units: (key, content), comments blanked. The commands as rows (key, n, start, stop, kind, tags, value, arms,
    parent, arm, ..): arms are the ranges of a choice's two texts, arm is the one of its parent that a command stands in."""
    # rows as they are found: a list of a long text's commands would be many times as large as the text
    found = text.rows_of(units.select(key, "content"), ["content"], StructType.fromDDL(_FOUND), lambda x: ({"n": n, **c} for n, c in enumerate(commands_of(x or ""))))
    kind = F.when(F.col("command").isin("iftag", "tagitem"), "choice").when(F.col("command") == "olimport", "import").otherwise("set")
    arms = F.when(kind == "choice", F.transform(F.slice("arguments", 2, 2), lambda a: F.struct(a["start"].alias("start"), a["stop"].alias("stop"))))
    tags = F.when(kind != "import", _names(F.get("arguments", 0)["text"]))
    rows = found.select(key, "n", "start", "stop", kind.alias("kind"), tags.alias("tags"), (F.col("command") == "tagtrue").alias("value"), arms.alias("arms"), "starred", F.trim(F.get("optional", 0)).alias("directory"), F.trim(F.get("arguments", 0)["text"]).alias("name"))
    return placed(nested(rows, [key]), [key])


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``arm``: in which of its parent's arms a row stands, -1 in none."""
    above = rows.select(*by, F.col("n").alias("parent"), F.col("arms").alias("around"))
    inside = F.transform("around", lambda a: (F.col("start") >= a["start"]) & (F.col("stop") <= a["stop"]))
    return rows.hint("merge").join(above, [*by, "parent"], "left").withColumn("arm", F.when(F.col("parent").isNotNull(), F.coalesce(F.array_position(inside, F.lit(True)).cast("int") - 1, F.lit(-1)))).drop("around")


def settle(rows: DataFrame, initial: DataFrame, key: str) -> DataFrame:
    """rows: tokens of each ``key``; initial: (key, tags as a map). (key, n, reached, chosen): whether a command is
    reached, and which arm a choice takes: the first if one of its tags is set, else the second."""
    choosing = F.max(F.col("kind") == "choice").over(W.partitionBy(key))
    every = stash(rows.select(key, "n", "start", "kind", "tags", "value", "parent", "arm", choosing.alias("choosing")), "tags-places")
    # where nothing is chosen, all is reached that stands in no other command's arguments
    plain = every.where("not choosing").select(key, "n", F.col("parent").isNull().alias("reached"), F.lit(None).cast("int").alias("chosen"))
    places = every.where("choosing").drop("choosing")
    mentions = places.where("kind = 'choice'").select(key, "n", "start", F.explode("tags").alias("tag"))
    both = F.inline(F.flatten(F.transform("tags", lambda t: F.array(F.struct(t.alias("tag"), F.col("value").alias("value")), F.struct(F.concat(F.lit("not"), t).alias("tag"), (~F.col("value")).alias("value"))))))
    sets = places.where("kind = 'set'").select(key, "n", "start", both)
    at_first = initial.select(key, F.explode("tags").alias("tag", "first"))
    state = stash(places.select(key, "n", "kind", "parent", "arm", F.when(F.col("parent").isNull(), True).when(F.col("arm") < 0, False).alias("reached"), F.lit(None).cast("int").alias("chosen")), "tags-state")
    while state.where("reached is null or (kind = 'choice' and reached and chosen is null)").limit(1).count():
        held = sets.join(state.select(key, "n", "reached"), [key, "n"]).where("reached is null or reached")
        marks = held.select(key, "tag", "start", F.lit(None).cast("int").alias("n"), F.struct(F.col("reached").isNull().alias("open"), "value").alias("mark"))
        asked = marks.unionByName(mentions.select(key, "tag", "start", "n", F.lit(None).cast("struct<open:boolean,value:boolean>").alias("mark")))
        last = F.last("mark", ignorenulls=True).over(W.partitionBy(key, "tag").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
        seen = asked.withColumn("last", last).where("n is not null").hint("merge").join(at_first, [key, "tag"], "left")
        value = F.when(F.col("last").isNull(), F.coalesce("first", F.lit(False))).when(~F.col("last.open"), F.col("last.value"))
        answers = seen.groupBy(key, "n").agg(F.bool_or(F.coalesce(value, F.lit(False))).alias("yes"), F.bool_or(value.isNull()).alias("open"))
        chosen = F.when(F.col("kind") == "choice", F.when(F.coalesce("yes", F.lit(False)), 0).when(~F.coalesce("open", F.lit(False)), 1)).cast("int")
        picked = state.drop("chosen").join(answers, [key, "n"], "left").select(key, "n", "kind", "parent", "arm", "reached", chosen.alias("chosen"))
        above = picked.select(key, F.col("n").alias("parent"), F.col("reached").alias("up"), F.col("chosen").alias("way"))
        below = F.coalesce("reached", F.when(~F.col("up"), False).when(F.col("way") != F.col("arm"), False).when(F.col("up") & F.col("way").isNotNull(), True))
        state = stash(picked.hint("merge").join(above, [key, "parent"], "left").select(key, "n", "kind", "parent", "arm", below.alias("reached"), "chosen"), "tags-state")
    return state.select(key, "n", "reached", "chosen").unionByName(plain)


def blank_ranges(content: Column, ranges: Column) -> Column:
    """``content`` with the ranges (start, stop), which do not overlap, blanked where they stand, in one pass over the text."""
    return _blanked(content, ranges["start"], ranges["stop"])


@F.pandas_udf(StringType())
def _blanked(contents: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    def one(content: str | None, starts, stops) -> str | None:
        if content is None or starts is None:
            return content
        made, at, order = io.StringIO(), 0, np.lexsort((stops, starts))
        for k in order:
            start, stop = int(starts[k]), int(stops[k])
            if start < stop:
                made.write(content[at:start])
                made.write(_VISIBLE.sub(" ", content[start:stop]))
                at = stop
        made.write(content[at:])
        return made.getvalue()

    return pd.Series([one(*row) for row in zip(contents, starts, stops)], dtype=object)


def evaluated(contexts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """contexts: (context, unit, content, tags); found: tokens(units). Texts (context, unit, active) in which what is not
    reached is blanked, and imports (context, n, owner, directory, name, starred, tags) with the tags at their place."""
    rows = stash(contexts.select("context", "unit").hint("merge").join(found, "unit"), "tags-rows")
    state = settle(rows, contexts, "context")
    known = stash(rows.join(state, ["context", "n"]).where("reached"), "tags-reached")
    way = F.get("arms", F.col("chosen"))
    spans = F.array(F.struct("start", way["start"].alias("stop")), F.struct(way["stop"].alias("start"), F.col("stop")))
    masked = known.where("kind = 'choice'").groupBy("context").agg(F.flatten(F.collect_list(spans)).alias("ranges"))
    first = contexts.hint("merge").join(masked, "context", "left").select("context", "unit", "tags", blank_ranges(F.col("content"), F.col("ranges")).alias("content"))
    first = stash(first, "tags-first")

    # blocks that hold for some tags only, by the tags that stay set after the choices
    blocks = text.tex_environment_rows(first.where(F.contains("content", F.lit(BLOCK))).select("context", "content"), "content").where(F.col("environment") == BLOCK)
    condition = F.regexp_extract("body", r"^\s*\{([^{}]*)\}", 1)
    whole = F.struct("start", F.col("end").alias("stop"))
    ranges = blocks.select("context", (-1 - F.col("start")).alias("n"), "start", F.col("end").alias("stop"), F.lit("choice").alias("kind"), _names(condition).alias("tags"), F.lit(None).cast("boolean").alias("value"), F.array(whole).alias("arms"))
    ranges = stash(ranges, "tags-ranges")
    texts, imports = first.select("context", "unit", F.col("content").alias("active")), known.where("kind = 'import'")
    if ranges.limit(1).count():  # without a block all that is reached stays so
        blocked = ranges.select("context").distinct()
        others = known.where("kind <> 'choice'").select("context", "n", "start", "stop", "kind", "tags", "value", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("arms"))
        inner = stash(placed(nested(ranges.unionByName(others.join(blocked, "context", "left_semi")), ["context"]), ["context"]), "tags-blocks")
        again = settle(inner, first, "context")
        off = inner.join(again, ["context", "n"]).where("kind = 'choice' and reached and chosen = 1")
        off = off.groupBy("context").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
        texts = first.join(off, "context", "left").select("context", "unit", blank_ranges(F.col("content"), F.col("ranges")).alias("active"))
        imports = imports.join(again.where("not reached").select("context", "n"), ["context", "n"], "left_anti")

    imports = imports.select("context", "unit", "n", "start", "directory", "name", "starred").hint("merge")
    changes = F.inline(F.flatten(F.transform("tags", lambda t: F.array(F.struct(t.alias("tag"), F.col("value").alias("v")), F.struct(F.concat(F.lit("not"), t).alias("tag"), (~F.col("value")).alias("v"))))))
    sets = known.where("kind = 'set'").select("context", "start", changes)
    asked = sets.select("context", "tag").distinct().join(imports.select("context", "start", "n"), "context")
    events = sets.withColumn("n", F.lit(None).cast("int")).unionByName(asked.withColumn("v", F.lit(None).cast("boolean")))
    value = F.last("v", ignorenulls=True).over(W.partitionBy("context", "tag").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    changed = events.withColumn("value", value).where("n is not null and value is not null").groupBy("context", "n").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("changed"))
    carried = imports.join(changed, ["context", "n"], "left").hint("merge").join(first.select("context", "tags"), "context")
    kept = F.map_filter("tags", lambda k, _: ~F.coalesce(F.map_contains_key(F.col("changed"), k), F.lit(False)))
    tags = F.when(F.col("changed").isNull(), F.col("tags")).otherwise(F.map_concat(kept, "changed"))
    return stash(texts, "tags-texts"), stash(carried.select("context", "unit", "n", "directory", "name", "starred", tags.alias("tags")), "tags-imports")


def context_id(unit: Column, tags: Column) -> Column:
    """One name for a file and the tags it is read with."""
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return F.sha2(F.concat_ws("\x00", unit, listed), 256)


def unfolded(units: DataFrame, entry: DataFrame) -> dict[str, DataFrame]:
    """units: (unit, content), comments blanked; entry: (unit, tags). Tables ``instance`` (entry, path, ordinal, unit, context,
    occurrence) in the order of visits, ``text`` (context, unit, active), ``missing`` (unit) and ``cyclic`` (entry, path, unit)."""
    with buckets(units.sparkSession) as made:
        # in buckets of their unit: a level moves its own contexts and imports, not all texts and commands
        units = made.write(units.select("unit", "content"), "tags-units", "unit")
        found = made.write(tokens(units), "tags-tokens", "unit")
        start = entry.select("unit", "tags").withColumn("context", context_id(F.col("unit"), F.col("tags")))
        fresh = stash(start.hint("merge").join(units, "unit").select("context", "unit", "content", "tags"), "tags-contexts")
        texts, ways, missing, seen = [], [], [], []
        while fresh.limit(1).count():
            seen.append(fresh.select("context"))
            active, imports = evaluated(fresh, found)
            target = tex.resolve_import(F.col("unit"), F.coalesce("directory", F.lit("")), F.col("name"), F.coalesce("starred", F.lit(False)))
            named = imports.select("context", "n", target.alias("target"), "tags").withColumn("to", context_id(F.col("target"), F.col("tags")))
            known = units.select(F.col("unit").alias("target"), F.lit(True).alias("known"))
            named = stash(named.hint("merge").join(known, "target", "left"), "tags-ways")
            texts.append(active)
            ways.append(named.where("known").select("context", "n", "to", "target"))
            missing.append(named.where("known is null").select(F.col("target").alias("unit")))
            new = named.where("known").select(F.col("to").alias("context"), F.col("target").alias("unit"), "tags").dropDuplicates(["context"])
            new = new.hint("merge").join(reduce(DataFrame.unionByName, seen), "context", "left_anti")
            fresh = stash(new.hint("merge").join(units, "unit").select("context", "unit", "content", "tags"), "tags-contexts")
        units = made.files("tags-units")[0]
    ways = stash(reduce(DataFrame.unionByName, ways), "tags-all-ways") if ways else None

    path = F.array().cast("array<int>")
    step = stash(start.select(F.col("unit").alias("entry"), path.alias("path"), "unit", "context", F.array("context").alias("above")).hint("merge").join(units.select("unit"), "unit"), "tags-instances")
    levels, cyclic = [step], []
    while ways is not None:
        on = step.join(ways, "context").select("entry", F.array_append("path", F.col("n")).alias("path"), F.col("target").alias("unit"), F.col("to").alias("context"), "above")
        on = stash(on.withColumn("cycle", F.array_contains("above", F.col("context"))), "tags-step")
        cyclic.append(on.where("cycle").select("entry", "path", "unit"))
        step = on.where("not cycle").withColumn("above", F.array_append("above", F.col("context"))).drop("cycle")
        if not step.limit(1).count():
            break
        levels.append(step)
    every = reduce(DataFrame.unionByName, levels).select("entry", "path", "unit", "context")
    ordinal, occurrence = (F.row_number().over(W.partitionBy(*by).orderBy("path")) for by in (["entry"], ["entry", "unit"]))
    none = units.select("unit").limit(0)
    return {
        "instance": every.select("entry", "path", ordinal.alias("ordinal"), "unit", "context", occurrence.alias("occurrence")),
        "text": reduce(DataFrame.unionByName, texts) if texts else none.select(F.lit("").alias("context"), "unit", F.lit("").alias("active")),
        "missing": (reduce(DataFrame.unionByName, missing) if missing else none).distinct(),
        "cyclic": reduce(DataFrame.unionByName, cyclic) if cyclic else every.select("entry", "path", "unit").limit(0),
    }

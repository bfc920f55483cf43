"""Graph iterations as joins of a frontier with the edges (GRF01-GRF16).

Edges are (src, dst), dependent to prerequisite. Every round's table is written to the
shared folder, so plans stay short and a lost executor costs one round's tasks at most.
"""

from __future__ import annotations

from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import common
from ..common import Buckets, buckets

#: rows that a task hands on at once
BATCH_ROWS = 50_000
#: steps along the edges between two tables that are written
STEPS = 4
#: edges of a bucket, where a loop keeps single nodes only
BUCKET_EDGES = 200_000
#: edges of a class that one task takes at once (some 100 bytes each), larger ones are split by spreading numbers
CLASS_EDGES = 1_000_000
#: edges of small classes that are walked together
WALK_EDGES = 200_000
#: rounds that take off what has no way in or no way on, before numbers are spread
SHED_ROUNDS = 8


def stash(df: DataFrame, label: str) -> DataFrame:
    """As ``common.stash``; joins with the table sort, so that no round sends it through the driver."""
    return common.stash(df, label).hint("merge")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def closure(edges: DataFrame, roots: DataFrame, depth_limit: int | None = None) -> DataFrame:
    """(root, node, depth) of everything that the roots (root) reach, themselves included. Pairs lie in buckets
    of their root: a round moves the new ones only, to their edges and back, and meets all former ones where they are."""
    with buckets(edges.sparkSession) as made:
        edges = made.write(edges.select("src", "dst").distinct(), "closure-edges", "src")
        found = [made.write(roots.select("root", F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0)), "closure-pairs", "root")]
        while depth_limit is None or len(found) <= depth_limit:
            step = found[-1].join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"))
            new = _unseen(made, step, found, ["root", "node"]).withColumn("depth", F.lit(len(found)))
            new = made.write(new, "closure-pairs", "root")
            if not new.limit(1).count():
                break
            found.append(new)
        return _all(made.files("closure-pairs"))


def _unseen(made: Buckets, rows: DataFrame, seen: list[DataFrame], by: list[str]) -> DataFrame:
    """The distinct rows (by) that are in none of the tables, which lie in buckets of the first of ``by``. A group over
    both, not a join: the optimizer would move an anti-join below the exchange, and all tables with it."""
    own = rows.select(*by, F.lit(False).alias("old")).repartition(made.n, by[0])
    both = _all([own, *(t.select(*by, F.lit(True).alias("old")) for t in seen)])
    return both.groupBy(*by).agg(F.bool_or("old").alias("old")).where("not old").drop("old")


def _chains(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame] | None:
    """edges: (src, dst, w), one for each pair. Nodes with a single edge hang on what follows them: (node, end, dist) by
    pointer doubling, ``end`` being the first node that is none of them, null on a cycle; and the edges of the
    other nodes, led on to such ends. None if no node has a single edge to another such node."""
    single = edges.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("dst"), F.first("w").alias("w")).where("n = 1")
    at = stash(single.select(F.col("src").alias("node"), F.col("dst").alias("end"), "w"), f"{label}-0").withColumnRenamed("w", "dist")
    inner = at.select(F.col("node").alias("end"))
    if not at.join(inner, "end", "left_semi").limit(1).count():
        return None
    size = at.count()
    for k in range(size.bit_length() + 1):
        hop = at.select(F.col("node").alias("via"), F.col("end").alias("beyond"), F.col("dist").alias("more"))
        step = at.join(hop, at["end"] == hop["via"], "left").select("node", F.when(F.col("via").isNull(), F.col("end")).otherwise(F.col("beyond")).alias("end"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("via").isNotNull().alias("moved"))
        step = stash(step, f"{label}-{k + 1}")
        at = step.select("node", "end", "dist")
        if not step.where("moved").limit(1).count():
            break
    # what still moves after as many doublings as there are nodes goes round
    nodes = at.select(F.col("node").alias("end"), F.lit(True).alias("round"))
    hung = stash(at.join(nodes, "end", "left").select("node", F.when(F.col("round").isNull(), F.col("end")).alias("end"), "dist"), f"{label}-hung")
    others = edges.join(hung.select(F.col("node").alias("src")), "src", "left_anti")
    led = others.join(hung.select(F.col("node").alias("dst"), "end", "dist", F.lit(True).alias("hangs")), "dst", "left")
    # an edge to a cycle stays as it is: its end is never free
    moved = F.col("hangs").isNotNull() & F.col("end").isNotNull()
    rows = led.select("src", F.when(moved, F.col("end")).otherwise(F.col("dst")).alias("dst"), F.when(moved, F.col("w") + F.col("dist")).otherwise(F.col("w")).alias("w"))
    return hung, stash(rows.groupBy("src", "dst").agg(F.max("w").alias("w")), f"{label}-edges")


def peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels (node, level) by longest path to a node without prerequisites, and the nodes
    that no round could peel off: those on cycles and whatever depends on them. Chains of nodes
    with one prerequisite each are contracted first, and again where that makes new ones, in a logarithm of
    their length; a round is then a level of what is left."""
    every = stash(nodes.select("node").distinct(), "peel-nodes")
    own = edges.join(every.select(F.col("node").alias("src")), "src", "left_semi")
    rest = stash(own.select("src", "dst").distinct().withColumn("w", F.lit(1)), "peel-edges")
    chains: list[DataFrame] = []
    while (shorter := _chains(rest, f"peel-chain{len(chains)}")) is not None:
        chains.append(shorter[0])
        rest = shorter[1]
    alone = _all([c.select("node") for c in chains]) if chains else every.limit(0)
    free = every.join(rest.select(F.col("src").alias("node")).unionByName(alone), "node", "left_anti")
    free = stash(free.withColumn("level", F.lit(0)), "peel-free0")
    levels: list[DataFrame] = []
    gained: list[DataFrame] = []
    while free.limit(1).count():
        levels.append(free)
        # only nodes that lost an edge in this round can have become free
        gone = free.select(F.col("node").alias("dst"), "level")
        lost = rest.join(gone, "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.col("level") + F.col("w")).alias("level"))
        if chains:  # edges have lengths: an earlier round may have given more
            gained.append(stash(lost, f"peel-lost{len(levels)}"))
            lost = gained[-1]
        rest = stash(rest.join(gone, "dst", "left_anti").select("src", "dst", "w"), f"peel-rest{len(levels)}")
        still = rest.select(F.col("src").alias("node")).distinct()
        ready = lost.join(still, "node", "left_anti").join(every, "node", "left_semi")
        if chains:
            ready = _all(gained).join(ready.select("node"), "node", "left_semi").groupBy("node").agg(F.max("level").alias("level"))
        free = stash(ready, f"peel-free{len(levels)}")
    peeled = _all(levels) if levels else every.withColumn("level", F.lit(0)).limit(0)
    for hung in reversed(chains):
        known = peeled.select(F.col("node").alias("end"), F.col("level").alias("up"))
        hanging = hung.join(known, "end").select("node", (F.col("up") + F.col("dist")).alias("level")).join(every, "node", "left_semi")
        peeled = stash(peeled.unionByName(hanging), "peel-levels")
    return peeled, every.join(peeled, "node", "left_anti")


def _trim(edges: DataFrame, label: str) -> DataFrame:
    """Edges (src, dst) without those whose ends have no way in or no way on, peeled off while there are any."""
    while True:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = stash(kept.select("src", "dst"), label)
        if kept.count() == edges.count():
            return kept
        edges = kept


def _mutual(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, components) of the components of two nodes or more, by Tarjan's walk over arrays."""
    size = 0
    while len(a) != size:  # ends without a way in or a way on, as long as this is worth its pass
        size = len(a)
        kept = np.isin(a, b) & np.isin(b, a)
        if 10 * np.count_nonzero(kept) > 9 * size:
            break
        a, b = a[kept], b[kept]
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    flat, n = flat.reshape(-1).astype(np.int32), len(names)
    from_, to = flat[: len(a)], flat[len(a) :]
    after = array("i", to[np.argsort(from_, kind="stable")].tobytes())
    last = array("i", np.cumsum(np.bincount(from_, minlength=n)).astype(np.int32).tobytes())
    at = array("i", [0]) + last[:-1] if n else array("i")
    place, low = array("i", bytes(4 * n)), array("i", bytes(4 * n))
    done, count = n + 1, 0
    open_, path, members, components = array("i"), array("i"), array("i"), array("i")
    for start in range(n):
        if place[start]:
            continue
        nxt = start
        while True:
            if nxt >= 0:
                count += 1
                place[nxt] = low[nxt] = count
                open_.append(nxt)
                path.append(nxt)
            node, nxt = path[-1], -1
            for k in range(at[node], last[node]):
                seen = place[after[k]]
                if not seen:
                    at[node], nxt = k + 1, after[k]
                    break
                if seen < low[node]:
                    low[node] = seen
            if nxt >= 0:
                continue
            path.pop()
            if path and low[node] < low[path[-1]]:
                low[path[-1]] = low[node]
            if low[node] == place[node]:
                alone = open_[-1] == node
                while True:
                    one = open_.pop()
                    place[one] = done
                    if not alone:
                        members.append(one)
                        components.append(node)
                    if one == node:
                        break
            if not path:
                break
    return names[np.frombuffer(members, np.int32)], names[np.frombuffer(components, np.int32)]


def _by_class(batches):
    """Rows (down, up, a, b) sorted by class: (node, component) of each class. No edge leads from class to class, so
    whole classes are walked together, some WALK_EDGES edges or one larger class at a time."""
    held, n, due = [], 0, WALK_EDGES

    def walked(rows: np.ndarray):
        nodes, components = _mutual(rows[2], rows[3])
        for k in range(0, len(nodes), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + BATCH_ROWS], pa.int64()) for x in (nodes, components)], ["node", "component"])

    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        n += batch.num_rows
        if n < due:
            continue
        rows = np.concatenate(held, axis=1)
        ends = np.flatnonzero(np.any(rows[:2, 1:] != rows[:2, :-1], axis=0))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield from walked(rows[:, :cut])
        held, n = [rows[:, cut:].copy()], rows.shape[1] - cut
        due = max(WALK_EDGES, 2 * n)
    if n:
        yield from walked(np.concatenate(held, axis=1))


def _shed(left: DataFrame) -> DataFrame:
    """Edges (down, up, a, b) without those whose ends have no way in or no way on, in some rounds, as long as a round
    takes a tenth of them. What is in a component stays."""
    n = left.count()
    for _ in range(SHED_ROUNDS):
        ends = lambda x, as_: left.select(F.col(x).alias(as_)).distinct()
        kept = stash(left.join(ends("b", "a"), "a", "left_semi").join(ends("a", "b"), "b", "left_semi").select("down", "up", "a", "b"), "strong-shed")
        before, n, left = n, kept.count(), kept
        if 10 * n > 9 * before:
            break
    return left


def strong_components(edges: DataFrame, class_edges: int = CLASS_EDGES) -> DataFrame:
    """(node, component) of all nodes on cycles; component is one of its nodes. Nodes get numbers in a random order.
    The greatest number spreads along the edges, and another one against them; nodes that both come to from the same node are
    a component, and an edge between different pairs of numbers is in none. What is left of the edges is numbered by
    its pairs anew: every class falls apart into several, so there are about a logarithm of rounds of spreading, not one for each
    component on a way. Classes of no more than ``class_edges`` edges are walked, many by a task; larger ones first lose
    some layers of edges that lead in or out only. Tables have at most four rows for an edge."""
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    between = stash(edges.select("src", "dst").where("src <> dst").distinct(), "strong-edges")
    mix = F.xxhash64("node")
    with buckets(edges.sparkSession) as made:
        nodes = between.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        names = stash(nodes.repartition(made.n, mix).sortWithinPartitions(mix).withColumn("id", F.monotonically_increasing_id()), "strong-names")
        left = between.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.lit(0).cast("long").alias("down"), F.lit(0).cast("long").alias("up"), "a", "b")
        found: list[DataFrame] = []
        shed = False
        while True:
            left = stash(left, "strong-left")
            sizes = stash(left.groupBy("down", "up").agg((F.count("*") <= class_edges).alias("small")), "strong-sizes")
            small = left.join(sizes.where("small"), ["down", "up"], "left_semi").select("down", "up", "a", "b")
            found.append(stash(small.repartition(made.n, "down", "up").sortWithinPartitions("down", "up").mapInArrow(_by_class, "node long, component long"), "strong-walked"))
            if not sizes.where("not small").limit(1).count():
                break
            left = left.join(sizes.where("not small"), ["down", "up"], "left_semi").select("down", "up", "a", "b")
            if not shed:
                left, shed = _shed(stash(left, "strong-large")), True
                continue
            # each way in both directions, and from every node to itself
            ways = F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.lit(k).alias("kind")) for k, (x, y) in enumerate(("ab", "ba", "aa", "bb"))]))
            both = made.write(left.select(ways).withColumn("kind", F.least("kind", F.lit(2))).distinct(), "strong-ways", "a")
            state = both.where("kind = 2").select(F.col("a").alias("node"), F.col("a").alias("down"), F.col("a").alias("up"), F.lit(True).alias("fresh"))
            while state.where("fresh").limit(1).count():
                step = state.select("node", "down", "up", F.col("down").alias("d"), F.col("up").alias("u"))
                for _ in range(STEPS):
                    own = lambda c: F.when(F.col("kind") == 2, F.col(c))
                    sent = step.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.when(F.col("kind") != 1, F.col("down")).alias("down"), F.when(F.col("kind") != 0, F.col("up")).alias("up"), own("d").alias("d"), own("u").alias("u"))
                    step = sent.groupBy("node").agg(*[F.max(c).alias(c) for c in ("down", "up", "d", "u")])
                state = made.write(step.select("node", "down", "up", ((F.col("down") > F.col("d")) | (F.col("up") > F.col("u"))).alias("fresh")), "strong-state", "node")
            found.append(stash(state.where("down = up").select("node", F.col("down").alias("component")), "strong-found"))
            one, two = (state.where("down <> up").select(F.col("node").alias(c), F.col("down").alias(f"down_{c}"), F.col("up").alias(f"up_{c}")) for c in "ab")
            left = both.where("kind = 0").select("a", "b").join(one, "a").join(two, "b").where("down_a = down_b and up_a = up_b").select(F.col("down_a").alias("down"), F.col("up_a").alias("up"), "a", "b")
    alone = loops.distinct().withColumn("component", F.col("node"))
    every = _all(found)
    large = every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    named = every.join(large.hint("merge"), "component").join(names.toDF("name", "node"), "node").select("name", "component")
    named = stash(named.join(names.toDF("called", "component"), "component").select(F.col("name").alias("node"), F.col("called").alias("component")), "strong-named")
    return named.unionByName(alone.join(named.select("node"), "node", "left_anti"))


def on_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (node) on a cycle."""
    return nodes.select("node").distinct().join(strong_components(edges).select("node").hint("merge"), "node", "left_semi")


def redundant_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) of an acyclic graph whose end is reached by a longer way as well. A way to an end only goes over
    nodes of higher levels, so what is searched from a node stops at the lowest level that its edges lead to; a search
    is no closure unless an edge leads to the bottom."""
    edges = stash(edges.select("src", "dst").distinct(), "reduce-edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    with buckets(edges.sparkSession) as made:
        levels = peel(ends, edges)[0]
        # a node without a level is on a cycle or above one, so above all that have one
        named = made.write(edges.join(levels.toDF("dst", "level"), "dst", "left").select("src", "dst", "level"), "reduce-named", "src")
        onward = F.col("level").isNull() | (F.col("level") > F.col("floor"))
        inside = F.col("level").isNull() | (F.col("level") >= F.col("floor"))
        floors = named.groupBy("src").agg(F.min("level").alias("floor"), F.count("*").alias("n")).where("n > 1").select(F.col("src").alias("root"), "floor")
        fresh = made.write(named.select(F.col("src").alias("root"), F.col("dst").alias("node"), "level").join(floors, "root").where(onward).select("root", "node", "level", "floor"), "reduce-start", "root")
        found: list[DataFrame] = []
        columns = ["root", "node", "level", "floor"]
        while fresh.limit(1).count():
            step = fresh.where(onward).select("root", "node", "floor").join(named, F.col("node") == F.col("src")).where(inside).select("root", F.col("dst").alias("node"), "level", "floor")
            fresh = made.write(_unseen(made, step, found, columns), "reduce-found", "root")
            found.append(fresh)
        if not found:
            return edges.limit(0)
        ways = _all(made.files("reduce-found")).select(F.col("root").alias("src"), F.col("node").alias("dst"))
    return edges.join(ways.hint("merge"), ["src", "dst"], "left_semi")


def spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): the nodes of ``start`` (node) and all that they reach. A round takes STEPS steps along the edges and meets
    what was found before where it lies; no pairs of nodes are made."""
    edges = edges.select("src", "dst").where("src <> dst")
    # an edge from each end to itself keeps in a step what the steps before it came to
    ways = stash(edges.unionByName(edges.select(F.col("dst").alias("src"), "dst")).distinct(), "spread-ways")
    with buckets(edges.sparkSession) as made:
        made.n = min(made.n, ways.count() // BUCKET_EDGES + 1)
        ways = made.write(ways, "spread-edges", "src")
        found = [made.write(start.select("node").distinct(), "spread-nodes", "node")]
        while found[-1].limit(1).count():
            step = found[-1]
            for _ in range(STEPS):
                # as many partitions as buckets, or the join would move the edges
                step = step.join(ways, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).repartition(made.n, "node").distinct()
            found.append(made.write(_unseen(made, step, found, ["node"]), "spread-nodes", "node"))
        return _all(made.files("spread-nodes"))


def keeps_ancestors(nodes: DataFrame, edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Nodes that match or have a match below them: (node), along the edges back."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return nodes.join(spread(back, matches).hint("merge"), "node", "left_semi")


def bounded_search(edges: DataFrame, roots: DataFrame, depth: int = 2, limit: int = 60) -> DataFrame:
    """(root, node, depth, position): breadth-first search in order of discovery, cut off
    at ``limit`` nodes for each root. edges: (src, dst, seq); seq orders a node's edges."""
    found = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(1).alias("position"))
    levels = [stash(found, "search-0")]
    for d in range(1, depth + 1):
        seen = _all(levels)
        step = levels[-1].join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.struct("position", "seq").alias("at"))
        step = step.groupBy("root", "node").agg(F.min("at").alias("at")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        count = seen.groupBy("root").agg(F.count("*").alias("before"))
        ranked = step.join(count, "root").withColumn("position", F.col("before") + F.row_number().over(W.partitionBy("root").orderBy("at")))
        levels.append(stash(ranked.where(F.col("position") <= limit).select("root", "node", F.lit(d).alias("depth"), F.col("position").cast("int").alias("position")), f"search-{d}"))
    return _all(levels)


def reading_order(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, position): prerequisites first, in the stored order of the edges (src,
    dst, seq). A task reads the closures of its roots as one sorted stream and holds that of one root; for
    graphs whose closures outgrow a task, peel() gives an order by levels."""
    reach = closure(edges, roots).select("root", "node").hint("merge")
    ways = edges.where("dst is not null").groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "dst"))), lambda x: x["dst"]).alias("ways"))
    none = F.array().cast(dict(ways.dtypes)["ways"])
    inside = reach.join(ways, F.col("node") == F.col("src"), "left").select("root", "node", F.coalesce("ways", none).alias("ways"))

    def walk(root, ways: dict) -> list:
        order, seen, todo = [], {root}, [(root, iter(ways.get(root, ())))]
        while todo:
            node, rest = todo[-1]
            for nxt in rest:
                if nxt not in seen:
                    seen.add(nxt)
                    below = ways.get(nxt)
                    if below:
                        todo.append((nxt, iter(below)))
                        break
                    order.append(nxt)
            else:
                order.append(node)
                todo.pop()
        return order

    def walks(batches):
        kinds, held, ways, out = None, None, {}, ([], [], [])

        def close() -> None:
            order = walk(held, ways)
            out[0].extend([held] * len(order))
            out[1].extend(order)
            out[2].extend(range(1, len(order) + 1))

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], kinds[0]), pa.array(out[1], kinds[1]), pa.array(out[2], pa.int32())], ["root", "node", "position"])

        for batch in batches:
            kinds = batch.schema.field("root").type, batch.schema.field("node").type
            lists = batch.column(2)
            at, values = lists.offsets.to_pylist(), lists.values.to_pylist()
            for k, (root, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if root != held:
                    if ways:
                        close()
                    held, ways = root, {}
                    if len(out[0]) >= BATCH_ROWS:
                        yield full()
                        out = ([], [], [])
                ways[node] = values[at[k] : at[k + 1]]
        if ways:
            close()
            yield full()

    kind = dict(edges.dtypes)["dst"]
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return inside.repartition(n, "root").sortWithinPartitions("root").mapInArrow(walks, f"root {dict(roots.dtypes)['root']}, node {kind}, position int")


def visible(edges: DataFrame, roots: DataFrame, nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """(node): what the roots (root) reach over nodes that match or have a match below them."""
    kept = stash(keeps_ancestors(nodes.select("node"), edges, matches).select("node"), "visible-kept")
    inside = edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    return spread(inside, roots.select(F.col("root").alias("node")).join(kept, "node", "left_semi"))


def first_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, position, node) for an acyclic graph: the first path in the order of the
    edges (src, dst, seq), from the first root (root, seq) that reaches the target. That is the least
    path by the numbers of its root and edges; it is the least one to every node that it goes over, so least paths spread along
    the edges until none gets less. No table of pairs of nodes is made."""
    number = dict(edges.dtypes)["seq"]
    with buckets(edges.sparkSession) as made:
        rows = made.write(edges.select("src", "dst", "seq"), "path-edges", "src")
        way = F.struct(F.col("seq").alias("first"), F.array().cast(f"array<{number}>").alias("path"), F.array("root").alias("nodes"))
        start = roots.select(F.col("root").alias("node"), way.alias("way")).groupBy("node").agg(F.min("way").alias("way"))
        found = [made.write(start, "path-best", "node")]
        while found[-1].limit(1).count():
            longer = F.struct("way.first", F.array_append("way.path", F.col("seq")).alias("path"), F.array_append("way.nodes", F.col("dst")).alias("nodes"))
            step = found[-1].join(rows, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), longer.alias("way"), F.lit(False).alias("old"))
            both = _all([step.repartition(made.n, "node"), *(t.select("node", "way", F.lit(True).alias("old")) for t in found)])
            best = both.groupBy("node").agg(F.min("way").alias("way"), F.min(F.when(F.col("old"), F.col("way"))).alias("was"))
            found.append(made.write(best.where("was is null or way < was").select("node", "way"), "path-best", "node"))
        asked = targets.select(F.col("target").alias("node")).distinct().repartition(made.n, "node")
        last = _all([t.select("node", "way", F.lit(False).alias("asked")) for t in found] + [asked.select("node", F.lit(None).cast(dict(found[0].dtypes)["way"]).alias("way"), F.lit(True).alias("asked"))])
        last = last.groupBy("node").agg(F.min("way").alias("way"), F.bool_or("asked").alias("asked")).where("asked and way is not null")
        paths = stash(last.select(F.col("node").alias("target"), F.posexplode("way.nodes").alias("position", "node")), "path-rows")
    return paths.select("target", (F.col("position") + 1).alias("position"), "node")


def end_of_chain(pointers: DataFrame, limit: int = 64) -> DataFrame:
    """(node, last, broken) for pointers (node, next): where each chain ends. Pointer
    doubling takes log(length) rounds; what has not ended after ``limit`` doublings is a cycle."""
    at = stash(pointers.select("node", F.col("next").alias("last")), "chain-0")
    for n in range(1, limit):
        hop = at.select(F.col("node").alias("via"), F.col("last").alias("beyond"))
        moved = stash(at.join(hop, F.col("last") == F.col("via"), "left").select("node", F.coalesce("beyond", "last").alias("last"), F.col("via").isNotNull().alias("moved")), f"chain-{n}")
        at = moved.select("node", "last")
        if not moved.where("moved").limit(1).count():
            return at.withColumn("broken", F.lit(False))
        if n > 1 and 2**n > pointers.count():
            break
    ends = pointers.select(F.col("node").alias("last")).distinct().withColumn("broken", F.lit(True))
    return at.join(ends, "last", "left").select("node", "last", F.coalesce("broken", F.lit(False)).alias("broken"))


def greedy_acyclic(edges: DataFrame) -> DataFrame:
    """edges: (src, dst, seq), seq a whole number that no two share. Adds ``taken``: whether the edge closes no cycle
    with those taken before it, in the order of seq. Only edges inside a strong component can be refused. The first
    that closes a cycle is found by halving, in all components at once, by the prefix of edges that leaves no
    way round; so a run of taken edges costs a logarithm of rounds, and each round refuses an edge a component."""
    rows = stash(edges.select("src", "dst", "seq"), "greedy-edges")
    refused = [stash(rows.where("src = dst").select("seq"), "greedy-loops")]
    left = stash(rows.where("src <> dst"), "greedy-left")
    while True:
        component = stash(strong_components(left), "greedy-components")
        inside = left.join(component.toDF("src", "component"), "src").join(component.toDF("dst", "other"), "dst").where("component = other")
        inside = stash(inside.select("src", "dst", "seq", "component"), "greedy-inside")
        if not inside.limit(1).count():
            break
        bounds = stash(inside.groupBy("component").agg((F.min("seq") - 1).alias("low"), F.max("seq").alias("high")), "greedy-bounds")
        while True:
            between = inside.join(bounds, "component").where("seq > low and seq < high")
            middle = stash(between.groupBy("component").agg(F.percentile_approx("seq", 0.5).alias("middle")), "greedy-middle")
            if not middle.limit(1).count():
                break
            prefix = inside.join(middle, "component").where("seq <= middle")
            round_ = _trim(stash(prefix.select("src", "dst"), "greedy-prefix"), "greedy-trim")
            closed = round_.select(F.col("src").alias("node")).distinct().join(component, "node").select("component").distinct().withColumn("closed", F.lit(True)).hint("merge")
            halved = bounds.join(middle, "component", "left").join(closed, "component", "left")
            known, yes = F.col("middle").isNotNull(), F.coalesce("closed", F.lit(False))
            bounds = stash(halved.select("component", F.when(known & ~yes, F.col("middle")).otherwise(F.col("low")).alias("low"), F.when(known & yes, F.col("middle")).otherwise(F.col("high")).alias("high")), "greedy-bounds")
        refused.append(stash(bounds.select(F.col("high").alias("seq")), "greedy-refused"))
        left = stash(inside.join(refused[-1], "seq", "left_anti").select("src", "dst", "seq"), "greedy-left")
    gone = _all(refused).withColumn("gone", F.lit(True))
    return rows.join(gone, "seq", "left").select("src", "dst", "seq", F.col("gone").isNull().alias("taken"))


def first_visit_tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges: (src, dst, seq), roots: (root, seq), seq a whole number that orders a node's edges and the roots. (parent, node, path,
    kind) in the order of a walk when sorted by path: ``first`` where a node is met first, ``shared`` where it is met
    again, ``cycle`` where it stands on the path already. A node is met first on its least path, and least paths
    are those of the nodes before it with one more step, so they spread along the edges until none gets less;
    a round is a step of depth. Sorted by the path with a last number above all, nodes come after what they need.
    For graphs with cycles a walk may meet nodes in another order: edges of ``greedy_acyclic`` first."""
    rows = stash(edges.select("src", "dst", F.col("seq").cast("long").alias("seq")), "tree-edges")
    start = roots.groupBy(F.col("root").alias("node")).agg(F.array(F.min("seq").cast("long")).alias("path"))
    best = stash(start.withColumn("parent", F.lit(None).cast(dict(rows.dtypes)["src"])), "tree-best")
    fresh = best
    while fresh.limit(1).count():
        step = fresh.join(rows, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.struct(F.array_append("path", F.col("seq")).alias("path"), F.col("src").alias("parent")).alias("way"))
        step = step.groupBy("node").agg(F.min("way").alias("way"))
        both = best.join(step, "node", "full_outer")
        better = F.col("way").isNotNull() & (F.col("path").isNull() | (F.col("way.path") < F.col("path")))
        pick = lambda c: F.when(better, F.col(f"way.{c}")).otherwise(F.col(c)).alias(c)
        moved = stash(both.select("node", pick("path"), pick("parent"), better.alias("fresh")), "tree-step")
        best, fresh = moved.select("node", "path", "parent"), moved.where("fresh").select("node", "path")
    own = best.select(F.col("node").alias("src"), F.col("path").alias("up"))
    seen = best.select(F.col("node").alias("dst"), F.col("path").alias("first"))
    met = rows.join(own, "src").join(seen, "dst").withColumn("path", F.array_append("up", F.col("seq")))
    on_path = (F.size("first") <= F.size("up")) & (F.slice("up", 1, F.size("first")) == F.col("first"))
    kind = F.when(F.col("path") == F.col("first"), "first").when(on_path, "cycle").otherwise("shared")
    again = roots.select(F.col("root").alias("dst"), F.array(F.col("seq").cast("long")).alias("path")).join(seen, "dst")
    tops = again.select(F.lit(None).cast(dict(rows.dtypes)["src"]).alias("parent"), F.col("dst").alias("node"), "path", F.when(F.col("path") == F.col("first"), "first").otherwise("shared").alias("kind"))
    return met.select(F.col("src").alias("parent"), F.col("dst").alias("node"), "path", kind.alias("kind")).unionByName(tops)

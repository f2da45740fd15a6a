"""Parent-child links to full hierarchies, with cycles.

A node with one link above it walks up to the next stop (pointer doubling that ends there). Stops are splitters chosen
by a hash of the node, and the nodes at which a walk can't go on or the graph may close: tops, nodes with several links
above them, the upper ends of these links, and nodes linked to themselves. A walk that meets no stop runs into a cycle
without a splitter; it is found by a node that comes again on its own walk, and its cycle is made one step apart.

What is left is the reduced graph of the stops alone. It is solved as a pointer graph: each stop points to one stop above it,
cycles of pointers, and links back into a stop's own line, are contracted to one step, and the pointers are chosen
again, from the deepest stop above, until neither is left and the choice is stable. A stable choice of deepest parents
has no cycle, so the loop ends on any graph. Only these rounds repeat, and only on the stops; each node's exact path is
the line of its stop and its own walk, put together once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut, cut_counting

#: One node in so many is a splitter: the expected length of a walk.
SPLITTER_EVERY = 16


def call_links(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (scope, node) and distinct links (scope, above, below) of rows with both lists of neighbours.

    A link is taken if either list names it, and dropped if one of its ends has no row of its own. Null rows' keys,
    null lists, null entries, repeated entries and repeated rows are allowed.
    """
    rows = graph.select(F.col("binary_id").alias("scope"), F.col("address").alias("node"), "callers", "callees").where(
        "scope IS NOT NULL AND node IS NOT NULL"
    )
    nodes = rows.select("scope", "node").distinct()
    listed = (
        rows.select("scope", F.explode("callers").alias("above"), F.col("node").alias("below"))
        .unionByName(rows.select("scope", F.col("node").alias("above"), F.explode("callees").alias("below")))
        .distinct()
    )
    links = listed.join(nodes.withColumnRenamed("node", "above"), ["scope", "above"], "left_semi").join(
        nodes.withColumnRenamed("node", "below"), ["scope", "below"], "left_semi"
    )
    return nodes, links


def _walk(first: DataFrame, arrays: list[str]) -> DataFrame:
    """Pointer doubling until every walk is over: (scope, node, at, seg, over, circle) and the further `arrays`.

    `seg` holds the ids from the one below `at` down to `node`; a walk is over where `first` says so, or, as a circle,
    where it meets an id for the second time. Finished walks are written once; the others take over the walk of the
    node they stand at, which doubles them.
    """
    columns = ["scope", "node", "at", *arrays, "over", "circle"]
    active, left = cut_counting(first.withColumn("circle", F.lit(False)).select(columns), ~F.col("over"))
    finished = active.where("over")
    while left:
        active = active.where("NOT over")
        there = finished.unionByName(active).select("scope", F.col("node").alias("at"), *[F.col(c).alias(f"{c}2") for c in columns[2:]])
        moved = (
            active.join(there, ["scope", "at"])
            .select("scope", "node", F.col("at2").alias("at"), *[F.concat(f"{c}2", c).alias(c) for c in arrays], "over2", "circle2")
            .withColumn("circle", F.col("circle2") | (F.size(F.array_distinct("seg")) < F.size("seg")))
            .withColumn("over", F.col("over2") | F.col("circle"))
        )
        active, left = cut_counting(moved.select(columns), ~F.col("over"))
        finished = finished.unionByName(active.where("over"))
    return finished


def _on_cycle() -> Column:
    """A walk that comes back to its own start: it never left the cycle, so all its ids are the cycle's."""
    return F.size(F.filter("seg", lambda x: x == F.col("node"))) > 1


def _without(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows (scope, node, seg): seg without the ids that are merged (scope, node, step), and their step, if any, as `met`.

    Walks are exploded, which are short; whole lines never are.
    """
    each = rows.select("scope", "node", F.posexplode("seg").alias("pos", "id"))
    met = each.join(merged.select("scope", F.col("node").alias("id"), "step"), ["scope", "id"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("step").isNull(), F.struct("pos", "id"))))
    return met.groupBy("scope", "node").agg(kept.alias("kept"), F.max("step").alias("met")).select("scope", "node", F.transform("kept", lambda x: x["id"]).alias("seg"), "met")


def _reduce(nodes: DataFrame, links: DataFrame, every: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Walk every node to its stop.

    Gives rows (scope, node, stop, at, seg) of all nodes, `at` null where none is above or several are; the reduced
    graph's heads (scope, node, seg, in_cycle) and links; and the members (scope, node, step) of cycles without a stop.
    """
    links = cut(links)
    edges = links.where("above <> below")
    loops = links.where("above = below").select("scope", F.col("above").alias("node"), F.lit(True).alias("loop"))
    above = edges.groupBy("scope", F.col("below").alias("node")).agg(F.min("above").alias("above"), F.count(F.lit(1)).alias("n"))
    joins = above.where("n > 1").select("scope", F.col("node").alias("below"))
    entries = cut(edges.join(joins, ["scope", "below"], "left_semi"))
    sources = entries.select("scope", F.col("above").alias("node"), F.lit(True).alias("source")).distinct()
    stop = F.col("above").isNull() | (F.col("n") > 1) | F.col("loop").isNotNull() | F.col("source").isNotNull()
    marked = cut(
        nodes.join(above, ["scope", "node"], "left").join(loops, ["scope", "node"], "left").join(sources, ["scope", "node"], "left")
        .select(
            "scope", "node", F.when(F.col("n") == 1, F.col("above")).alias("above"), F.col("loop").isNotNull().alias("loop"),
            (stop | (F.pmod(F.xxhash64("scope", "node"), F.lit(every)) == 0)).alias("stop"),
        )
    )
    ends = marked.where("stop").select("scope", F.col("node").alias("above"), F.lit(True).alias("over"))
    first = marked.where("above IS NOT NULL").join(ends, ["scope", "above"], "left").select(
        "scope", "node", F.col("above").alias("at"), F.array("node").alias("seg"), F.coalesce("over", F.lit(False)).alias("over")
    )
    walks = _walk(first, ["seg"])
    rings = cut(walks.where("circle").where(_on_cycle()).select("scope", "node", F.array_min("seg").alias("step")))
    arrived = walks.where("NOT circle").select("scope", "node", "at", "seg")
    if not rings.isEmpty():
        hanging = walks.where("circle").where(~_on_cycle()).select("scope", "node", "seg")
        own = rings.select("scope", "node", F.col("step").alias("at"), F.array().cast("array<bigint>").alias("seg"))
        arrived = arrived.unionByName(_without(hanging, rings).select("scope", "node", F.col("met").alias("at"), "seg")).unionByName(own)
    rows = cut(marked.join(arrived, ["scope", "node"], "left").select("scope", "node", "stop", "loop", "at", "seg"))
    heads = rows.where("stop").select("scope", "node", F.coalesce("seg", F.array("node")).alias("seg"), F.col("loop").alias("in_cycle"))
    heads = heads.unionByName(rings.select("scope", F.col("step").alias("node"), F.array("step").alias("seg"), F.lit(True).alias("in_cycle")).distinct())
    reduced = rows.where("stop AND at IS NOT NULL").select("scope", F.col("at").alias("above"), F.col("node").alias("below"))
    return rows, heads, reduced.unionByName(entries.select("scope", "above", "below")), rings


def _lines(pointers: DataFrame) -> DataFrame:
    """(scope, node, seg, cyc, circle) of a pointer graph (scope, node, seg, in_cycle, above), `above` null at a top.

    `seg` is the line from the top down to the node, `cyc` tells which of its ids are cycles. The line of a node whose walk
    runs into a cycle of pointers is a `circle`: it begins somewhere on the cycle and goes round it at least once.
    """
    cyc = F.concat(F.array_repeat(F.lit(False), F.size("seg") - 1), F.array("in_cycle")).alias("cyc")
    tops = pointers.where("above IS NULL").select("scope", F.col("node").alias("above"), F.col("in_cycle").alias("top_cyc"))
    held = pointers.where("above IS NOT NULL").select("scope", "node", "above", "seg", cyc).join(tops, ["scope", "above"], "left")
    over = F.col("top_cyc").isNotNull()
    first = held.select(
        "scope", "node", F.col("above").alias("at"), F.when(over, F.concat(F.array("above"), "seg")).otherwise(F.col("seg")).alias("seg"),
        F.when(over, F.concat(F.array("top_cyc"), "cyc")).otherwise(F.col("cyc")).alias("cyc"), over.alias("over"),
    )
    walks = _walk(first, ["seg", "cyc"]).select("scope", "node", "seg", "cyc", "circle")
    return walks.unionByName(pointers.where("above IS NULL").select("scope", "node", "seg", cyc, F.lit(False).alias("circle")))


def _groups(lines: DataFrame, side: DataFrame, pointers: DataFrame) -> DataFrame:
    """(scope, node, group): ids that reach each other, by cycles of pointers and by links back into a line.

    An id in several such segments is in the group with the smallest name. Of a cycle of pointers each stop gives the ids of
    its own walk, so a cycle is never written once for each of its stops.
    """
    back = (
        lines.join(side.select("scope", F.col("above").alias("node"), "below"), ["scope", "node"])
        .withColumn("place", F.array_position("seg", F.col("below")).cast("int"))
        .where("place > 0")
        .select("scope", F.slice("seg", F.greatest("place", F.lit(1)), F.size("seg")).alias("seg"))
        .select("scope", F.explode("seg").alias("node"), F.array_min("seg").alias("group"))
    )
    rings = lines.where("circle").where(_on_cycle()).select("scope", "node", F.array_min("seg").alias("group"))
    own = pointers.select("scope", "node", "seg").join(rings, ["scope", "node"]).select("scope", F.explode("seg").alias("node"), "group")
    return back.unionByName(own).groupBy("scope", "node").agg(F.min("group").alias("group"))


def _solve(heads: DataFrame, edges: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contract everything in the reduced graph that reaches itself.

    Gives the steps' lines (scope, node, seg, cyc) and the members (scope, node, step) of all cycles, those in `merged`
    included; `step` is the smallest id in the cycle. Where a step has several steps above it, the deepest one counts, the
    smallest of these on a tie.
    """
    heads, edges, depth = cut(heads), cut(edges), None
    while True:
        choice = edges.withColumn("d", F.lit(0)) if depth is None else edges.join(depth, ["scope", "above"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
        picked = choice.groupBy("scope", F.col("below").alias("node")).agg(
            F.min(F.struct((-F.col("d")).alias("d"), F.col("above").alias("above")))["above"].alias("above"), F.count(F.lit(1)).alias("n")
        )
        pointers = cut(heads.join(picked, ["scope", "node"], "left"))
        lines = _lines(pointers)
        # links beside the pointers: one from a step to a step of its own line closes a cycle too
        many = pointers.where("n > 1").select("scope", F.col("node").alias("below"), F.col("above").alias("ptr"))
        side, n_side = cut_counting(edges.join(many, ["scope", "below"]).where("above <> ptr"), F.lit(True))
        groups, n_groups = cut_counting(_groups(lines, side, pointers), F.lit(True))
        if not n_groups:
            if not n_side:
                break
            # does any step have a deeper step above it than the one it points to?
            now = cut(lines.select("scope", F.col("node").alias("above"), F.size("seg").alias("d")))
            better = (
                side.join(now, ["scope", "above"])
                .join(now.select("scope", F.col("above").alias("ptr"), F.col("d").alias("ptr_d")), ["scope", "ptr"])
                .where("d > ptr_d OR (d = ptr_d AND above < ptr)")
            )
            if better.isEmpty():
                break
            depth = now
            continue
        into = groups.groupBy("scope", "group").agg(F.min("node").alias("step"))
        new = cut(groups.join(into, ["scope", "group"]).select("scope", "node", "step"))
        to = new.select("scope", F.col("node").alias("above"), F.col("step").alias("a"))
        merged = cut(
            merged.join(new.select("scope", F.col("node").alias("step"), F.col("step").alias("next")), ["scope", "step"], "left")
            .select("scope", "node", F.coalesce("next", "step").alias("step"))
            .unionByName(new)
            .groupBy("scope", "node").agg(F.min("step").alias("step"))
        )
        # walks that begin at a merged step may begin with ids that are merged now
        worn = pointers.where(F.size("seg") > 1).join(to, ["scope", "above"], "left_semi")
        fresh = _without(worn, new).select("scope", "node", F.col("seg").alias("fresh"))
        heads = cut(
            heads.join(new.select("scope", "node"), ["scope", "node"], "left_anti")
            .join(fresh, ["scope", "node"], "left")
            .select("scope", "node", F.coalesce("fresh", "seg").alias("seg"), "in_cycle")
            .unionByName(new.select("scope", F.col("step").alias("node"), F.array("step").alias("seg"), F.lit(True).alias("in_cycle")).distinct())
        )
        edges = cut(
            edges.join(to, ["scope", "above"], "left")
            .join(to.select("scope", F.col("above").alias("below"), F.col("a").alias("b")), ["scope", "below"], "left")
            .select("scope", F.coalesce("a", "above").alias("above"), F.coalesce("b", "below").alias("below"))
            .where("above <> below")
            .distinct()
        )
        depth = None
    return cut(lines.select("scope", "node", "seg", "cyc")), merged


def hierarchy(nodes: DataFrame, links: DataFrame, every: int = SPLITTER_EVERY) -> DataFrame:
    """Every node with its place: (scope, node, step, in_cycle, steps, path, depth, top).

    nodes: (scope, node) distinct; links: (scope, above, below) distinct, between nodes of one scope; a node linked
    to itself is a cycle of one. `steps` is the array of steps from the top to the own one, `path` the same as text
    joined by `/`, with `@` before a cycle's smallest node; `depth` counts the steps above. An empty table gives none.
    Ids are longs.
    """
    rows, heads, reduced, rings = _reduce(nodes, links, every)
    lines, merged = _solve(heads, reduced, rings)
    none = F.array().cast("array<bigint>")
    own = merged.select("scope", "node", F.col("step").alias("own"))
    up = merged.select("scope", F.col("node").alias("at"), F.col("step").alias("up"))
    placed = (
        rows.select("scope", "node", F.when(F.col("stop"), F.col("node")).otherwise(F.col("at")).alias("at"), F.when(F.col("stop"), none).otherwise(F.col("seg")).alias("seg"))
        .join(own, ["scope", "node"], "left")
        .join(up, ["scope", "at"], "left")
        .select(
            "scope", "node", F.coalesce("own", "up", "at").alias("at"), F.when(F.col("own").isNotNull(), none).otherwise(F.col("seg")).alias("seg"),
            (F.col("own").isNull() & F.col("up").isNotNull() & (F.size("seg") > 0)).alias("worn"),
        )
    )
    placed = cut(placed)
    fresh = _without(placed.where("worn"), merged).select("scope", "node", F.col("seg").alias("fresh"))
    placed = placed.where("NOT worn").select("scope", "node", "at", "seg").unionByName(
        placed.where("worn").join(fresh, ["scope", "node"]).select("scope", "node", "at", F.col("fresh").alias("seg"))
    )
    text = F.array_join(F.transform("seg", lambda x, i: F.concat(F.when(F.get("cyc", i), "@").otherwise(""), x.cast("string"))), "/")
    ends = lines.select("scope", F.col("node").alias("at"), F.col("seg").alias("line"), text.alias("text"), F.element_at("cyc", -1).alias("end_cyc"))
    deeper = F.size("seg") > 0
    return placed.join(ends, ["scope", "at"]).select(
        "scope", "node", F.when(deeper, F.col("node")).otherwise(F.col("at")).alias("step"), (~deeper & F.col("end_cyc")).alias("in_cycle"),
        F.concat("line", "seg").alias("steps"), F.when(deeper, F.concat_ws("/", "text", F.array_join(F.transform("seg", lambda x: x.cast("string")), "/"))).otherwise(F.col("text")).alias("path"),
        (F.size("line") + F.size("seg") - 1).alias("depth"), F.col("line")[0].alias("top"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """All (scope, node, below) of a hierarchy: every node in a step under `node`'s, cycle mates excluded.

    The result is as large as the answer itself, one row for each node and each node of every step above it.
    """
    members = tree.select("scope", "step", "node")
    pairs = tree.where("depth > 0").select(
        "scope", F.col("node").alias("below"), F.explode(F.slice("steps", F.lit(1), F.col("depth"))).alias("step")
    )
    return pairs.join(members, ["scope", "step"]).select("scope", "node", "below")

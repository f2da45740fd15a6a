"""Reachability over links: closures of seeds, one-hop neighbourhoods, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.hierarchy import hierarchy
from ferrule.session import cut, cut_counting


def closure(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(scope, node): the seeds and all they reach over links (scope, above, below).

    Frontier by frontier: each round only joins the nodes found last and drops those known, so cycles end. Seeds
    without links are in the result. Each round's nodes are written; the number of rounds is the longest distance.
    """
    frontier, links = cut(seeds.select("scope", "node").distinct()), cut(links)
    known = frontier
    while not frontier.isEmpty():
        step = frontier.join(links, (frontier.scope == links.scope) & (frontier.node == links.above)).select(links.scope, links.below.alias("node")).distinct()
        frontier = cut(step.join(known, ["scope", "node"], "left_anti"))
        known = known.unionByName(frontier)
    return known


def _steps(tree: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree's steps (scope, step, steps, depth), and the distinct links between steps that its paths don't take."""
    steps = cut(tree.select("scope", "step", "steps", "depth").dropDuplicates(["scope", "step"]))
    of = tree.select("scope", F.col("node").alias("above"), F.col("step").alias("a"))
    between = (
        links.join(of, ["scope", "above"])
        .join(of.select("scope", F.col("above").alias("below"), F.col("a").alias("b")), ["scope", "below"])
        .select("scope", F.col("a").alias("above"), F.col("b").alias("below"))
        .where("above <> below")
        .distinct()
    )
    taken = steps.where("depth > 0").select("scope", F.element_at("steps", -2).alias("above"), F.col("step").alias("below"))
    return steps, between.join(taken, ["scope", "above", "below"], "left_anti")


def closure_in_tree(seeds: DataFrame, tree: DataFrame, links: DataFrame) -> DataFrame:
    """(scope, node): the seeds and all they reach over links, by the hierarchy of these links.

    A step is reached if a seed is in one of the steps of its path. Where a step has several steps above it, the links
    that no path takes lead on: those that leave what was reached last give the next seeds. A graph whose steps have one
    step above them at most takes one round, any other as many as the most such links on a way. Seeds that the
    tree doesn't have are in the result.
    """
    seeds = cut(seeds.select("scope", "node").distinct())
    steps, side = _steps(tree, links)
    side, left = cut_counting(side, F.lit(True))
    on_path = steps.select("scope", F.col("step").alias("below"), F.explode("steps").alias("step"))
    new, reached = tree.join(seeds, ["scope", "node"], "left_semi").select("scope", "step").distinct(), None
    while True:
        hit = on_path.join(new, ["scope", "step"], "left_semi").select("scope", F.col("below").alias("step")).distinct()
        hit = cut(hit if reached is None else hit.join(reached, ["scope", "step"], "left_anti"))
        reached = hit if reached is None else reached.unionByName(hit)
        if not left:
            break
        onward = side.join(hit.select("scope", F.col("step").alias("above")), ["scope", "above"], "left_semi").select("scope", F.col("below").alias("step")).distinct()
        new, left = cut_counting(onward.join(reached, ["scope", "step"], "left_anti"), F.lit(True))
    return tree.join(reached, ["scope", "step"], "left_semi").select("scope", "node").unionByName(seeds).distinct()


def heights(tree: DataFrame, links: DataFrame) -> DataFrame:
    """(scope, node, height): links on the longest way down from a node's step, cycles counting as one step.

    The hierarchy's paths give the heights along the links they take. Every other link offers its upper end, and all steps
    above that, the height of its lower end and one more; what grows is offered again, until nothing grows. Contracted links
    have no cycle, so it ends. A forest takes one round.
    """
    steps, side = _steps(tree, links)
    side, left = cut_counting(side, F.lit(True))
    best = steps.select("scope", "depth", F.posexplode("steps").alias("pos", "step"))
    known = cut(best.groupBy("scope", "step").agg(F.max(F.col("depth") - F.col("pos")).alias("height")))
    grown = known
    while left:
        offers = (
            side.join(grown.select("scope", F.col("step").alias("below"), "height"), ["scope", "below"])
            .groupBy("scope", F.col("above").alias("step")).agg((F.max("height") + 1).alias("height"))
            .join(known.select("scope", "step", F.col("height").alias("own")), ["scope", "step"])
            .where("height > own")
            .select("scope", "step", "height")
        )
        up = steps.join(offers, ["scope", "step"]).select("scope", (F.col("depth") + F.col("height")).alias("end"), F.posexplode("steps").alias("pos", "step"))
        taller = up.groupBy("scope", "step").agg(F.max(F.col("end") - F.col("pos")).alias("height"))
        news = taller.join(known.select("scope", "step", F.col("height").alias("own")), ["scope", "step"]).where("height > own").select("scope", "step", "height")
        grown, left = cut_counting(news, F.lit(True))
        if left:
            known = cut(known.join(grown.select("scope", "step", F.col("height").alias("new")), ["scope", "step"], "left").select("scope", "step", F.coalesce("new", "height").alias("height")))
    return tree.select("scope", "node", "step").join(known, ["scope", "step"]).select("scope", "node", "height")


def with_callers(changed: DataFrame, links: DataFrame) -> DataFrame:
    """(scope, node): the changed nodes and the nodes directly above them."""
    above = links.join(changed.select("scope", F.col("node").alias("below")), ["scope", "below"], "left_semi").select("scope", F.col("above").alias("node"))
    return changed.select("scope", "node").unionByName(above).distinct()


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(scope, node, n_above, n_below) of all nodes, 0 where there are none."""
    one = lambda end, a, b: links.select("scope", F.col(end).alias("node"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    every = nodes.select("scope", "node", F.lit(0).alias("a"), F.lit(0).alias("b")).unionByName(one("below", 1, 0)).unionByName(one("above", 0, 1))
    return every.groupBy("scope", "node").agg(F.sum("a").alias("n_above"), F.sum("b").alias("n_below"))


def chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(scope, chain, pos, node): maximal runs of nodes in which each has one node above and that one has one below.

    `chain` is the run's first node. Runs of one node and pure cycles aren't chains; a node linked to itself breaks one.
    """
    d = cut(degrees(nodes, links))
    single = links.join(d.where("n_above = 1").select("scope", F.col("node").alias("below")), ["scope", "below"], "left_semi").join(
        d.where("n_below = 1").select("scope", F.col("node").alias("above")), ["scope", "above"], "left_semi"
    )
    held = cut(single.where("above <> below").select("scope", F.col("below").alias("node"), "above"))
    members = held.select("scope", "node").unionByName(held.select("scope", F.col("above").alias("node"))).distinct()
    lines = hierarchy(members, held.select("scope", "above", F.col("node").alias("below")))
    return lines.where("NOT in_cycle").select("scope", F.col("top").alias("chain"), F.col("depth").alias("pos"), "node")

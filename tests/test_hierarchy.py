import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from ferrule.operators import hierarchy, reach


def reachable(n, edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    got = {}
    for s in range(n):
        seen, todo = set(), [s]
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        got[s] = seen
    return got


def longest_ways(n, edges):
    """Links on the longest way down from each node, cycles contracted."""
    get = reachable(n, edges)
    step = {v: min({u for u in get[v] if v in get[u]} | {v}) for v in range(n)}
    below = defaultdict(set)
    for a, b in edges:
        if step[a] != step[b]:
            below[step[a]].add(step[b])
    high = {}
    for s in sorted(set(step.values()), key=lambda s: len({step[x] for x in get[s]} - {s})):
        high[s] = max((high[b] + 1 for b in below[s]), default=0)
    return {v: high[step[v]] for v in range(n)}


def random_forest_of_cycles(rng):
    """Steps that are single nodes or strongly connected groups, each below at most one other."""
    n, groups = 0, []
    for _ in range(rng.randint(1, 9)):
        k = rng.choice([1, 1, 1, 2, 3, 6])
        groups.append(list(range(n, n + k)))
        n += k
    names = list(range(n))
    rng.shuffle(names)
    edges = set()
    for i, g in enumerate(groups):
        if len(g) > 1:
            order = g[:]
            rng.shuffle(order)
            edges |= set(zip(order, order[1:] + order[:1]))
            edges |= {(rng.choice(g), rng.choice(g)) for _ in range(rng.randint(0, 6))}
        elif rng.random() < 0.2:
            edges.add((g[0], g[0]))
        if i and rng.random() < 0.85:
            above = groups[rng.randrange(i)]
            edges |= {(rng.choice(above), rng.choice(g)) for _ in range(rng.randint(1, 3))}
    return n, {(names[a], names[b]) for a, b in edges}


def test_random_graphs(spark):
    rng = random.Random(5)
    graphs = {s: random_forest_of_cycles(rng) for s in range(30)}
    for s in range(30, 40):  # any graph: cycles must still be exact
        n = rng.randint(2, 8)
        graphs[s] = n, {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))}
    graphs[40] = 60, {(i, i + 1) for i in range(59)}  # a chain longer than the gaps between splitters
    graphs[41] = 3, {(0, 1), (1, 2), (2, 0)}
    nodes = spark.createDataFrame([(s, v) for s, (n, _) in graphs.items() for v in range(n)], "scope long, node long")
    links = spark.createDataFrame([(s, a, b) for s, (_, e) in graphs.items() for a, b in e], "scope long, above long, below long")
    tree = hierarchy.hierarchy(nodes, links, every=4).cache()
    rows = {(r.scope, r.node): r for r in tree.collect()}
    assert len(rows) == sum(n for n, _ in graphs.values())
    below = defaultdict(set)
    for r in hierarchy.descendants(tree).collect():
        below[r.scope, r.node].add(r.below)
    for s, (n, edges) in graphs.items():
        get = reachable(n, edges)
        for v in range(n):
            mates = {u for u in get[v] if v in get[u]} | {v}
            row = rows[s, v]
            assert row.step == min(mates) and row.in_cycle == (v in get[v])
            if s < 30 or s >= 40:
                above = {min({u for u in get[x] if x in get[u]} | {x}) for x in range(n) if v in get[x] and x not in mates}
                assert set(row.steps[:-1]) == above and row.steps[-1] == row.step and row.depth == len(above)
                assert all(b in get[a] for a, b in zip(row.steps, row.steps[1:]))
                assert below[s, v] == get[v] - mates
    assert rows[41, 1].path == "@0" and rows[40, 59].path == "/".join(map(str, range(60)))
    for s in range(30, 40):  # the deepest step above counts
        n, edges = graphs[s]
        high = longest_ways(n, edges)
        down = {(b, a) for a, b in edges}
        assert all(rows[s, v].depth == longest_ways(n, down)[v] for v in range(n)), s
        assert all(high[v] >= 0 for v in range(n))
    heights = {(r.scope, r.node): r.height for r in reach.heights(tree, links).collect()}
    assert heights == {(s, v): h for s, (n, e) in graphs.items() for v, h in longest_ways(n, e).items()}
    seeds = spark.createDataFrame([(s, 0) for s in range(40)] + [(99, 7)], "scope long, node long")
    want = {(s, v) for s in range(40) for v in reachable(*graphs[s])[0] | {0}} | {(99, 7)}
    assert {tuple(r) for r in reach.closure(seeds, links).collect()} == want
    assert {tuple(r) for r in reach.closure_in_tree(seeds, tree, links).collect()} == want


def test_diamonds_and_wide_graphs(spark):
    """Steps with several steps above them: closures, depths and heights stay exact."""
    rng = random.Random(11)
    graphs = {0: (5, {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)}), 1: (4, {(1, 3), (2, 3), (3, 0)})}
    for s in range(2, 6):
        n = rng.randint(10, 20)
        up = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)}
        graphs[s] = n, up | {(rng.randrange(n), rng.randrange(n)) for _ in range(s - 2)}
    nodes = spark.createDataFrame([(s, v) for s, (n, _) in graphs.items() for v in range(n)], "scope long, node long")
    links = spark.createDataFrame([(s, a, b) for s, (_, e) in graphs.items() for a, b in e], "scope long, above long, below long")
    tree = hierarchy.hierarchy(nodes, links, every=4).cache()
    depths = {(r.scope, r.node): r.depth for r in tree.collect()}
    assert depths == {(s, v): d for s, (n, e) in graphs.items() for v, d in longest_ways(n, {(b, a) for a, b in e}).items()}
    heights = {(r.scope, r.node): r.height for r in reach.heights(tree, links).collect()}
    assert heights == {(s, v): h for s, (n, e) in graphs.items() for v, h in longest_ways(n, e).items()}
    seeds = spark.createDataFrame([(s, 2) for s in graphs], "scope long, node long")
    want = {(s, v) for s in graphs for v in reachable(*graphs[s])[2] | {2}}
    assert {tuple(r) for r in reach.closure_in_tree(seeds, tree, links).collect()} == want


def test_long_chain(spark):
    """8,000 steps under each other, and a cycle longer than any walk."""
    n, m = 8000, 300
    link = "scope long, above long, below long"
    nodes = spark.range(n).select(F.lit(0).cast("long").alias("scope"), F.col("id").alias("node")).unionByName(spark.createDataFrame([(1, v) for v in range(m)], "scope long, node long"))
    links = spark.range(n - 1).select(F.lit(0).cast("long").alias("scope"), F.col("id").alias("above"), (F.col("id") + 1).alias("below"))
    began = time.time()
    tree = hierarchy.hierarchy(nodes, links.unionByName(spark.createDataFrame([(1, v, (v + 1) % m) for v in range(m)], link)))
    got = tree.groupBy("scope", "in_cycle").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("d"), F.max(F.length("path")).alias("longest"), F.max("step").alias("step")).collect()
    longest = sum(len(str(v)) for v in range(n)) + n - 1
    assert {tuple(r) for r in got} == {(0, False, n, n * (n - 1) // 2, longest, n - 1), (1, True, m, 0, 2, 0)}
    assert time.time() - began < 180  # repeated work in a deep graph took longer than that for a fifth of the nodes


def test_links_of_dirty_rows(spark):
    rows = [
        (1, 10, [20, 20, None, 0], None, "x"), (1, 20, None, [], "x"), (1, 20, None, [], "x"), (None, 5, [1], None, "x"),
        (1, None, [10], None, "x"), (2, 20, [10], [20], "x"), (1, 30, [], [10, 99], "x"),
    ]
    graph = spark.createDataFrame(rows, "binary_id long, address long, callers array<long>, callees array<long>, node string")
    nodes, links = hierarchy.call_links(graph)
    assert {tuple(r) for r in nodes.collect()} == {(1, 10), (1, 20), (2, 20), (1, 30)}
    assert {tuple(r) for r in links.select("scope", "above", "below").collect()} == {(1, 20, 10), (2, 20, 20), (1, 30, 10)}


def test_empty(spark):
    nodes = spark.createDataFrame([], "scope long, node long")
    links = spark.createDataFrame([], "scope long, above long, below long")
    tree = hierarchy.hierarchy(nodes, links)
    assert tree.count() == 0 and hierarchy.descendants(tree).count() == 0
    assert reach.degrees(nodes, links).count() == 0
    assert reach.with_callers(nodes.withColumn("x", F.lit(1)), links).count() == 0

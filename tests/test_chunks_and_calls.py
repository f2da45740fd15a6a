import random

import pytest
from pyspark.sql import functions as F

from ferrule.functions import code, parsing
from ferrule.operators import callsites, chunks, ranges


def walk(rows, budget, most):
    out = {}
    for k in {r[0] for r in rows}:
        chunk = used = n = 0
        for _, o, c in sorted(r for r in rows if r[0] == k):
            c = max(c or 0, 0)
            if n and (used + c > budget or (most and n >= most)):
                chunk, used, n = chunk + 1, 0, 0
            out[k, o] = (chunk, n)
            used, n = used + c, n + 1
    return out


@pytest.mark.parametrize("most", [None, 3])
def test_next_fit(spark, most):
    rnd = random.Random(3)
    rows = [(k, i * 5 + k, rnd.choice([0, 1, 4, 9, 20, 21, 90, -2, None])) for k in (0, 0, 0, 1) for i in range(60)]
    rows = sorted(set({(k, o): (k, o, c) for k, o, c in rows}.values()), key=str)
    df = spark.createDataFrame([*rows, (None, 1, 1), (0, None, 1)], "k long, o long, c int").withColumn("chunks", F.lit("own column"))
    got = chunks.next_fit(df, ["k"], "o", F.col("c"), 20, 64, most)
    assert got.columns == ["k", "o", "c", "chunks", "chunk", "place"]
    assert {(r.k, r.o): (r.chunk, r.place) for r in got.collect()} == walk(rows, 20, most)
    assert chunks.next_fit(df.limit(0), ["k"], "o", F.col("c"), 20, 64, most).count() == 0


def shared_walk(rows, budget, most):
    """Row by row: a row that opens a batch keeps the cost it had against the batch before."""
    out = {}
    for k in {r[0] for r in rows}:
        chunk = used = n = 0
        seen = set()
        for _, o, own, items in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            named = {}
            for i, c in items or []:
                if i is not None:
                    named.setdefault(i, max(c or 0, 0))
            cost = max(own or 0, 0) + sum(c for i, c in named.items() if i not in seen)
            if n and (n >= most or used + cost > budget):
                chunk, used, n, seen = chunk + 1, 0, 0, set()
            out[k, o] = (chunk, n)
            used, n, seen = used + cost, n + 1, seen | set(named)
    return out


@pytest.mark.parametrize(("most", "width"), [(4, 4), (4, 64), (1, 8)])
def test_shared_batches(spark, most, width):
    rnd = random.Random(most + width)
    pick = lambda: rnd.choice([None, [], *([(rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, 3, 8, 40, -1])) for _ in range(rnd.randrange(1, 4))] for _ in range(6))])
    rows = [(k, i * 3 + k, rnd.choice([0, 2, 9, None, -4]), pick()) for k, n in ((0, 70), (1, 9), (2, 1)) for i in range(n)]
    kind = "k long, o long, own int, named array<struct<a:bigint,c:int>>, chunks string"
    df = spark.createDataFrame([(*r, "own column") for r in [*rows, (None, 1, 1, None), (0, None, 1, None)]], kind)
    got = chunks.shared_batches(df, ["k"], "o", F.col("own"), F.col("named"), 45, width, most)
    assert got.columns == ["k", "o", "own", "named", "chunks", "chunk", "place"]
    assert {(r.k, r.o): (r.chunk, r.place) for r in got.collect()} == shared_walk(rows, 45, most)
    assert chunks.shared_batches(df.limit(0), ["k"], "o", F.col("own"), F.col("named"), 45, width, most).count() == 0


def test_lanes(spark):
    sizes = [5, 5, 30, 5, 200, None, 9]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "k long, o long, c int")
    got = chunks.chunks_with_lanes(df, ["k"], "o", F.col("c"), 10, 100, 64, 8).orderBy("o").collect()
    assert [r.lane for r in got] == ["shared", "shared", "alone", "shared", "cut", "shared", "shared"]
    assert [(r.segment, r.chunk, r.place) for r in got] == [(0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 0, 0), (2, 0, 0), (2, 0, 0), (2, 0, 1)]


def test_in_flight(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", None]), s, rnd.choice([None, s - 5, s, s + rnd.randrange(1, 9000)])) for i in range(120) for s in [rnd.randrange(0, 9000)]]
    df = spark.createDataFrame([*rows, (999, "a", None, 4)], "i long, m string, s long, e long").select("i", "m", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    want = {i: 1 + sum(1 for j, n, t, f in rows if j != i and n == m and t <= s and (f is None or f > s)) for i, m, s, e in rows}
    assert {r.i: r.in_flight for r in ranges.in_flight(df, "m", "s", "e", 600).collect()} == want
    assert ranges.in_flight(df.limit(0), "m", "s", "e", 600).count() == 0


BODY = 'int f(int a)\n{ g(1, h(2, (3)), "a,b(");  // no m(1)\n x = k(); if (z) { q(); } else r(1,);\n /* n(1) */ do s( ); y(")'


def test_sites(spark):
    seen = [(s[1], s[2], s[3]) for s in callsites.sites_of(BODY)]
    assert seen == [("g", 3, False), ("h", 2, True), ("k", 0, True), ("q", 0, False), ("r", 2, False), ("s", 0, False), ("y", 1, False)]
    texts = spark.createDataFrame([(1, BODY), (2, ""), (3, None), (4, "f(1)"), (5, "{ f(1 "), (6, "{" + "a(1);" * 50000)], "id long, t string")
    got = callsites.call_sites(texts, "id", "t").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: 7, 6: 50000}
    assert callsites.call_sites(texts.limit(0), "id", "t").count() == 0


def test_call_conflicts(spark):
    ddl = "result_id long, binary_id long, address long, name string, original_name string, signature string, error string, skipped boolean"
    results = spark.createDataFrame(
        [
            (1, 1, 10, "two", "FUN_a", "void two(int a, int b)", None, None), (2, 1, 11, "any", "FUN_b", "int any(int a, ...)", "", False),
            (3, 1, 12, "same", "FUN_c", "int same(int a)", "", False), (4, 1, 13, "same", "FUN_d", "int same(int a, int b)", "", False),
            (5, 1, 14, "open", "FUN_e", "int open()", "", False), (6, 1, 15, "odd", "FUN_f", None, "", False), (7, 1, 16, "bad", "FUN_g", "int bad(int a)", "failed", False),
        ],
        ddl,
    )
    bodies = spark.createDataFrame(
        [
            (1, 1, "f() { two(1); }"), (2, 1, "f() { two(1); two(1, 2); }"), (3, 1, "f() { x = two(1, 2); }"), (4, 1, "f() { any(1, 2); open(4); odd(1); bad(); same(); FUN_c(); }"),
            (5, 2, "f() { two(1); }"), (6, None, "f() { two(1); }"), (1, 1, "f() { two(1); }"), (7, 1, "f() { FUN_a(1); }"), (8, 1, None),
        ],
        "doc_id long, binary_id long, text string",
    )
    got = callsites.call_conflicts(results, bodies, "doc_id", "text").collect()
    assert sorted((r.kind, r.address, r.doc_id, r.detail) for r in got) == [
        ("argument_count", 10, 1, "2 declared, 1 passed"), ("argument_count", 10, 7, "2 declared, 1 passed"), ("argument_count", 12, 4, "1 declared, 0 passed"), ("return_value", 10, 3, "used"),
    ]
    assert callsites.call_conflicts(results.limit(0), bodies, "doc_id", "text").count() == 0


def test_small_functions(spark):
    df = spark.createDataFrame([("UNCONDITIONAL_CALL",), ("CONDITIONAL_JUMP",), ("FALL_THROUGH",), ("COMPUTED",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(code.flow(F.col("a"))).collect()] == ["call", "branch", "fall_through", "computed", "unknown", "unknown"]
    ids = spark.createDataFrame([("Uå",), ("",), (None,), ("long name",)], "a string").select(code.byte_tokens(F.col("a"), 6, 257, 258, 256)).collect()
    assert [r[0] for r in ids] == [[257, 0x55, 0xC3, 0xA5, 258, 256], [257, 258, 256, 256, 256, 256], None, [257, *b"long "]]
    types = spark.createDataFrame([("uint8_t *", 8), ("Int", None), ("mine **", 2), ("mine", 2), (None, 3)], "a string, n int")
    assert [r[0] for r in types.select(parsing.resolved_type(F.col("a"), F.col("n"))).collect()] == ["byte*", "int", "undefined8**", "undefined2", "undefined4"]


def test_merge_votes(spark):
    rnd = random.Random(5)
    rows = [(k, s, [(rnd.randrange(3), rnd.choice([0.25, 0.5, 1.0])) for _ in range(n)]) for k, s, n in [(1, 0, 8), (1, 4, 8), (1, 8, 6), (2, 0, 3), (3, 0, 0)]]
    given = [(k, s, "".join(str(x) for x, _ in v), [c for _, c in v]) for k, s, v in rows]
    df = spark.createDataFrame([*given, given[0], (4, 0, None, None), (None, 0, "1", [1.0])], "k long, s int, l string, c array<double>")
    scores = {}
    for k, s, v in rows:
        for i, (label, c) in enumerate(v):
            scores.setdefault((k, s + i), []).append((label, c))
    want = {}
    for (k, at), v in sorted(scores.items()):
        best = max(((sum(c for x, c in v if x == n) / len(v), n) for n in range(3)))
        want.setdefault((k, at // 4 * 4), []).append(best)
    got = ranges.merge_votes(df, "k", "s", "l", "c", 3, 4).collect()
    assert {(r.k, r.start): list(zip(r.confidences, map(int, r.labels))) for r in got} == want
    assert ranges.merge_votes(df.limit(0), "k", "s", "l", "c", 3, 4).count() == 0


def test_painted(spark):
    rows = [(1, 0, 10), (1, 4, 2), (1, 8, 5), (1, 8, 3), (1, 20, 0), (1, None, 3), (1, 30, None), (2, 0, 4), (2, 0, 4), (1, 9, 1)]
    want, owner = {}, {}
    for k, s, n in sorted((r for r in rows if None not in r), key=lambda r: r[1]):
        owner |= {(k, b): s for b in range(s, s + n)}
    for (k, _), s in owner.items():
        want[k, s] = want.get((k, s), 0) + 1
    df = spark.createDataFrame(rows, "k long, s long, n int")
    assert {(r.k, r.s): r.n_bytes for r in ranges.painted(df, ["k"], "s", "n").collect()} == want
    assert ranges.painted(df.limit(0), ["k"], "s", "n").count() == 0


def test_functions_of_one_text(spark):
    block = "/**\n * @name %s\n * as in note(1) {\n */\n/* calls told(2) { */\nvoid %s(int a)\n{\n  %s\n}\n\n"
    text = block % ("one", "one", "two(1);") + block % ("two", "two", "one(1, 2); x = three();") + "int tail(int a) { one(3); }\nint last() { }"
    got = callsites.call_sites(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("pos").collect()
    assert [(r.block, r.name, r.n_args, r.uses_return) for r in got] == [(0, "two", 1, False), (1, "one", 2, False), (1, "three", 0, True), (1, "one", 1, False)]
    assert all(text[r.pos :].startswith(r.name + "(") for r in got)
    ddl = "result_id long, binary_id long, address long, name string, original_name string, signature string, error string, skipped boolean"
    results = spark.createDataFrame([(1, 1, 10, "one", "FUN_a", "void one(int a)", None, None), (2, 1, 11, "two", "FUN_b", "void two(int a)", None, None)], ddl)
    bodies = spark.createDataFrame([(1, 1, block % ("a", "a", "one(1);") + block % ("two", "two", "one(1, 2);"))], "doc_id long, binary_id long, text string")
    conflicts = callsites.call_conflicts(results, bodies, "doc_id", "text").collect()
    assert [(r.kind, r.address, r.block, r.detail) for r in conflicts] == [("argument_count", 10, 1, "1 declared, 2 passed")]

import random
from collections import Counter, defaultdict

import numpy as np

from ferrule.llm import packing


def test_best_fit_plans_hold_everything():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.randint(1, 60)
        histogram = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 200)))
        plan, held = packing.best_fit(histogram, capacity), Counter()
        for n, fill in plan:
            assert 0 < sum(s * k for s, k in fill.items()) <= capacity
            for s, k in fill.items():
                held[s] += n * k
        assert held == histogram
        total, least = sum(n for n, _ in plan), -(-sum(s * c for s, c in histogram.items()) // capacity)
        assert least <= total <= 1.7 * least + 1


def brute_padding(sizes, k):
    best = None
    n = len(sizes)
    from itertools import combinations

    for cuts in combinations(range(1, n), k - 1):
        bounds = [0, *cuts, n]
        cost = sum(sum(sizes[b - 1][0] * c - s * c for s, c in sizes[a:b]) for a, b in zip(bounds, bounds[1:]))
        best = cost if best is None else min(best, cost)
    return best


def test_buckets_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        histogram = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 30)))
        k = min(3, len(histogram))
        bounds = packing.length_buckets(histogram, k)
        cost = sum((next(b for b in bounds if b >= s) - s) * c for s, c in histogram.items())
        assert len(bounds) <= k and cost == brute_padding(sorted(histogram.items()), k)


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 3, 3, 7, 10, 11, 25, 30]), "x") for i in range(500)] + [(500, None, "x"), (501, 100, "x")]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens int, size string")
    held, parts = defaultdict(int), defaultdict(list)
    for r in packing.pack(sizes, [10, 30]).collect():
        held[r.capacity, r.container] += r.n_tokens
        parts[r.capacity, r.doc_id].append((r.part, r.start, r.n_tokens))
    assert all(0 < t <= c for (c, _), t in held.items())
    for d, n, _ in rows:
        for c in (10, 30):
            got = sorted(parts.get((c, d), []))
            assert sum(t for *_, t in got) == (n or 0) and len(got) == -(-(n or 0) // c)
            assert [p for p, *_ in got] == list(range(len(got))) and [s for _, s, _ in got] == [p * c for p, *_ in got]
    for c in (10, 30):
        used = sum(1 for x, _ in held if x == c)
        assert used <= 1.25 * -(-sum(n or 0 for _, n, _ in rows) // c)
    assert packing.pack(sizes.where("false"), [10]).count() == 0
    assert packing.pack(sizes, []).count() == 0
    assert packing.bucket_report(sizes, [10]).count() > 0


def test_every_size_is_a_boundary():
    rng = random.Random(7)
    histogram = {s: rng.randint(1, 3) for s in range(1, 1300)} | {1400: 10**6, 1401: 10**6}
    sizes = np.array(sorted(histogram))
    n, t = (np.concatenate([[0], np.cumsum([histogram[s] * x for s, x in zip(sizes.tolist(), by)])]) for by in (np.ones(len(sizes), int), sizes.tolist()))
    best = np.concatenate([[0], sizes * n[1:] - t[1:]])
    for _ in range(3):
        best = np.array([0, *(min(best[j], (best[:j] + sizes[j - 1] * (n[j] - n[:j]) - t[j] + t[:j]).min()) for j in range(1, len(best)))])
    bounds = packing.length_buckets(histogram, 4)
    assert len(bounds) == 4 and sum((next(b for b in bounds if b >= s) - s) * c for s, c in histogram.items()) == best[-1]


def test_batches_hold_every_text_once(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, 3, 9, 10, 25, 44])) for i in range(400)] + [(400, None)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    got = packing.bucket_batches(sizes, [10, 30]).collect()
    assert sorted((r.capacity, r.doc_id, r.n_tokens) for r in got) == sorted((c, i, n % c) for i, n in rows for c in (10, 30) if n and n % c)
    held = Counter((r.capacity, r.upto, r.batch) for r in got)
    assert all(n * u <= c for (c, u, _), n in held.items()) and all(r.n_tokens <= r.upto for r in got)
    report = {(r.capacity, r.upto): (r.n_texts, r.n_batches) for r in packing.bucket_report(sizes, [10, 30]).collect()}
    assert report == {(c, u): (sum(n for k, n in held.items() if k[:2] == (c, u)), sum(k[:2] == (c, u) for k in held)) for c, u, _ in held}
    assert packing.bucket_report(sizes.where("false"), [10]).count() == 0 and packing.bucket_report(sizes, []).count() == 0

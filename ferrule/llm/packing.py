"""Filling containers of fixed capacity with texts, by their numbers of tokens.

Only the histogram of sizes comes to the driver: at most one row for each size up to the capacity, whatever the number
of texts. Two plans are made from it:

* `length_buckets`, the optimal buckets: dynamic programming chooses boundaries that minimise padding, and batches of a
  token budget form inside each bucket. Items of one bucket have about the same length, so a batch of items above half
  the capacity holds one; the plan can't reach the least number of containers.
* `best_fit`, the plan that the containers use: sizes in descending order go, many equal ones at a time, into the
  fullest open containers that take them.

Containers that are filled alike are one group, a plan has few groups, and each text finds its container from its rank
among the texts of its size.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.session import cut

#: Buckets of the padding plan, and parts that ranks of one size or bucket are counted in.
BUCKETS, RANK_PARTS = 16, 256


def best_fit(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Groups (number of containers, size -> items in each of them) that hold all items; sizes are 1 to capacity."""
    fills: list[dict[int, int]] = []
    counts: list[int] = []
    rooms: dict[int, list[int]] = {}
    order: list[int] = []  # rooms that are open, ascending

    def put(fill: dict[int, int], count: int, room: int) -> None:
        if count:
            fills.append(fill)
            counts.append(count)
            if room:
                if room not in rooms:
                    rooms[room] = []
                    bisect.insort(order, room)
                rooms[room].append(len(fills) - 1)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                room = order[at]
                group = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
                fill, have = fills[group], counts[group]
            else:
                room, fill, have, group = capacity, {}, left, -1
            each = room // size
            whole = min(have, left // each)
            rest = left - whole * each if whole < have else 0
            rest = min(rest, each - 1)
            if group >= 0:
                counts[group] = 0
            put({**fill, size: each}, whole, room - each * size)
            if rest:
                put({**fill, size: rest}, 1, room - rest * size)
            if group >= 0:
                put(fill, have - whole - bool(rest), room)
            left -= whole * each + rest
    return [(n, fill) for n, fill in zip(counts, fills) if n]


def length_buckets(histogram: Mapping[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of the buckets that minimise padding to each bucket's bound, by dynamic programming over all sizes.

    The best last bucket of the first j sizes begins no earlier the larger j is (padding meets the quadrangle
    inequality), so each round divides at the middle j and searches what is left on both sides: O(n log n).
    """
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    counts = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    upto, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    n, rounds = len(sizes), min(buckets, len(sizes))
    best, back = np.concatenate([[0], sizes * upto[1:] - tokens[1:]]), []  # padding of the first j sizes in one bucket
    for k in range(1, rounds):
        # the first j sizes in k + 1 buckets, the last of which takes the sizes i..j-1
        now, begin, todo = best.copy(), np.zeros(n + 1, np.int64), [(k + 1, n, k, n - 1)]
        while todo:
            low, high, least, most = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = slice(least, min(most, j - 1) + 1)
            cost = best[i] + tokens[i] - sizes[j - 1] * upto[i]
            at = int(cost.argmin())
            now[j], begin[j] = cost[at] + sizes[j - 1] * upto[j] - tokens[j], least + at
            todo += [(low, j - 1, least, least + at), (j + 1, high, least + at, most)]
        back.append(begin)
        best = now
    ends = [n]
    for begin in reversed(back):
        ends.append(int(begin[ends[-1]]))
    return [int(sizes[j - 1]) for j in reversed(ends)]


def pieces(sizes: DataFrame, capacities: Sequence[int], key: str = "doc_id") -> DataFrame:
    """(capacity, key, whole, size): full containers that a text takes alone and what is left of it (0: nothing).

    Sizes of 0 and null need no container.
    """
    each = sizes.where("n_tokens > 0").select(F.explode(F.array(*[F.lit(int(c)) for c in capacities])).alias("capacity"), key, "n_tokens")
    return each.select("capacity", key, F.expr("n_tokens div capacity").cast("int").alias("whole"), (F.col("n_tokens") % F.col("capacity")).alias("size"))


def histograms(parts: DataFrame) -> dict[int, dict[int, int]]:
    """The histogram of remaining sizes for each capacity: at most `capacity` rows each come to the driver."""
    out: dict[int, dict[int, int]] = {}
    for r in parts.where("size > 0").groupBy("capacity", "size").agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r.capacity, {})[r["size"]] = r.n
    return out


def _ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows + (rank): zero-based ranks among the rows of one group, without giving a group to one task.

    Ranks are positions in parts of a group plus the parts' offsets; the last column of `order` is the rows' key.
    """
    rest = rows.withColumn("slice", F.pmod(F.xxhash64(order[-1]), F.lit(RANK_PARTS)).cast("int"))
    counted = rest.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("n"))
    offsets = counted.withColumn("offset", F.sum("n").over(Window.partitionBy(*by).orderBy("slice")) - F.col("n")).drop("n")
    return (
        rest.withColumn("at", F.row_number().over(Window.partitionBy(*by, "slice").orderBy(*order)))
        .join(offsets, [*by, "slice"])
        .withColumn("rank", F.col("offset") + F.col("at") - 1)
    )


def pack(sizes: DataFrame, capacities: Sequence[int], key: str = "doc_id") -> DataFrame:
    """(capacity, container, key, part, start, n_tokens): which tokens of which text each container holds.

    sizes: (key, n_tokens), one row for each text. A text is split only if it alone exceeds the capacity; its full
    parts are containers of their own, the rest is packed like other texts. Empty input gives no rows.
    """
    if not capacities:
        return pieces(sizes, [1], key).where(F.lit(False)).select("capacity", F.lit("").alias("container"), key, F.lit(0).alias("part"), F.lit(0).alias("start"), F.lit(0).alias("n_tokens"))
    parts = cut(pieces(sizes, capacities, key))
    segments = []
    for capacity, histogram in sorted(histograms(parts).items()):
        rank, first = dict.fromkeys(histogram, 0), 0
        for count, fill in best_fit(histogram, capacity):
            for size, each in fill.items():
                segments.append((capacity, size, rank[size], rank[size] + count * each, each, first))
                rank[size] += count * each
            first += count
    spark = sizes.sparkSession
    plan = spark.createDataFrame(segments, "capacity int, size int, from_rank long, to_rank long, each long, first long")

    ranked = _ranked(parts.where("size > 0"), ["capacity", "size"], [key])
    packed = (
        ranked.join(F.broadcast(plan), ["capacity", "size"])  # bounded by the capacities: one row for each size and group of containers
        .where("rank >= from_rank AND rank < to_rank")
        .select(
            "capacity", F.expr("concat('p', first + (rank - from_rank) div each)").alias("container"), key,
            F.col("whole").alias("part"), (F.col("whole") * F.col("capacity")).alias("start"), F.col("size").alias("n_tokens"),
        )
    )
    full = parts.where("whole > 0").select("capacity", key, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"))
    alone = full.select(
        "capacity", F.concat(F.lit("f"), F.col(key).cast("string"), F.lit("."), F.col("part").cast("string")).alias("container"), key,
        "part", (F.col("part") * F.col("capacity")).alias("start"), F.col("capacity").alias("n_tokens"),
    )
    return packed.unionByName(alone)


def fill_report(packed: DataFrame) -> DataFrame:
    """(capacity, n_containers, least, tokens, used): containers against the least number the tokens would allow."""
    total = packed.groupBy("capacity", "container").agg(F.sum("n_tokens").alias("t")).groupBy("capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("tokens"))
    return total.select(
        "capacity", "n_containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens",
        (F.col("tokens") / (F.col("n_containers") * F.col("capacity"))).alias("used"),
    )


def bucket_batches(sizes: DataFrame, capacities: Sequence[int], key: str = "doc_id") -> DataFrame:
    """(capacity, upto, batch, key, part, n_tokens): the bucket of each text's rest, and the batch inside of it.

    A batch of a bucket holds as many rests as fit when each is padded to the bucket's bound.
    """
    if not capacities:
        return pieces(sizes, [1], key).where(F.lit(False)).select("capacity", F.lit(0).alias("upto"), F.lit(0).cast("long").alias("batch"), key, F.col("whole").alias("part"), F.col("size").alias("n_tokens"))
    parts = cut(pieces(sizes, capacities, key))
    rows = []
    for capacity, histogram in sorted(histograms(parts).items()):
        bounds = length_buckets(histogram)
        rows += [(capacity, low, bound) for low, bound in zip([0, *bounds], bounds)]
    plan = sizes.sparkSession.createDataFrame(rows, "capacity int, low int, upto int")
    placed = parts.where("size > 0").join(F.broadcast(plan), "capacity").where("size > low AND size <= upto")  # BUCKETS rows for each capacity
    ranked = _ranked(placed, ["capacity", "upto"], ["size", key])
    return ranked.select("capacity", "upto", F.expr("rank div (capacity div upto)").alias("batch"), key, F.col("whole").alias("part"), F.col("size").alias("n_tokens"))


def bucket_report(sizes: DataFrame, capacities: Sequence[int], key: str = "doc_id") -> DataFrame:
    """(capacity, upto, n_texts, n_batches, padding): the optimal length buckets and their token-budget batches, counted."""
    batches = bucket_batches(sizes, capacities, key).groupBy("capacity", "upto", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("upto") - F.col("n_tokens")).alias("pad"))
    return batches.groupBy("capacity", "upto").agg(F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_batches"), F.sum("pad").alias("padding"))

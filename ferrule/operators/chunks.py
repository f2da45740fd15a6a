"""Next-fit chunks of ordered rows, also where one key holds most of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators.ranges import running_total
from ferrule.session import cut


def _next_starts(rows: DataFrame, keys: list[str], budget: int, most: int | None) -> DataFrame:
    """(keys, _pos, _next): where the next chunk starts if one starts at _pos; the last chunk has no row.

    The next start is the first row whose running cost passes what came before _pos plus the budget. Costs above the
    budget count as budget + 1, so that row is in the threshold's own cell of that width or in the one after it.
    """
    wide = budget + 1
    cell = lambda c: F.floor(c / wide)
    ends = rows.select(*keys, F.col("_cum").alias("_v"), F.col("_pos").alias("_end"), F.lit(None).cast("bigint").alias("_from"), cell(F.col("_cum")).alias("_cell"))
    limit = F.col("_cum") - F.col("_cost") + budget
    asks = rows.select(
        *keys, limit.alias("_v"), F.lit(None).cast("bigint").alias("_end"), F.col("_pos").alias("_from"), F.explode(F.array(cell(limit), cell(limit) + 1)).alias("_cell")
    )
    # downwards, so that the frame grows: the last end seen is the smallest one above; equal values aren't above
    above = Window.partitionBy(*keys, "_cell").orderBy(F.desc("_v"), F.col("_from").isNull(), F.desc("_end")).rowsBetween(Window.unboundedPreceding, 0)
    met = asks.unionByName(ends).withColumn("_hit", F.last("_end", ignorenulls=True).over(above)).where("_from IS NOT NULL")
    found = met.groupBy(*keys, F.col("_from").alias("_pos")).agg(F.min("_hit").alias("_hit"))
    nxt = F.when(F.col("_hit").isNotNull(), F.greatest("_hit", F.col("_pos") + 1))  # greatest itself would skip the null
    if most is None:
        return found.select(*keys, "_pos", nxt.alias("_next")).where("_hit IS NOT NULL")
    last = rows.groupBy(*keys).agg(F.max("_pos").alias("_last"))
    full = found.join(last, keys).select(*keys, "_pos", F.least(nxt, F.col("_pos") + most).alias("_next"), "_last", "_hit")
    return full.where("_hit IS NOT NULL OR _next <= _last").select(*keys, "_pos", "_next")


def _followed(found: DataFrame, jumps: DataFrame, keys: list[str]) -> DataFrame:
    """All (keys, _pos) that pointers (keys, _pos, _next) lead to from those found, by doubling the pointers."""
    while True:
        further = cut(found.join(jumps, [*keys, "_pos"]).select(*keys, F.col("_next").alias("_pos")))
        if further.isEmpty():
            return found
        found = cut(found.unionByName(further))
        second = jumps.select(*keys, F.col("_pos").alias("_next"), F.col("_next").alias("_after"))
        jumps = cut(jumps.join(second, [*keys, "_next"]).select(*keys, "_pos", F.col("_after").alias("_next")))


def _by_starts(rows: DataFrame, found: DataFrame, keys: list[str], columns: list[str], width: int) -> DataFrame:
    """columns of the rows with `chunk` and `place`, chunks beginning at the positions found."""
    starts = found.withColumn("_start", F.lit(1))
    marked = running_total(rows.join(starts, [*keys, "_pos"], "left"), keys, "_pos", F.col("_start"), "_chunk", width)
    first = running_total(starts, keys, "_pos", F.col("_start"), "_chunk", width).select(*keys, "_chunk", F.col("_pos").alias("_first"))
    return marked.join(first, [*keys, "_chunk"]).select(*columns, (F.col("_chunk") - 1).alias("chunk"), (F.col("_pos") - F.col("_first")).alias("place"))


def next_fit(df: DataFrame, keys: list[str], order: str, cost: Column, budget: int, width: int, most: int | None = None) -> DataFrame:
    """df with `chunk` (from 0) and `place` (from 0 within the chunk): rows are put in order into chunks, and a new chunk
    starts where the next row would exceed the budget or the chunk has `most` rows.

    A row that alone exceeds the budget has its own chunk. `order` is a whole number, unique within the keys; `width` is
    the number of order values in one slice of the running totals. Rows with a null key or order are left out, null and
    negative costs count as 0. An empty table gives no rows.

    Where a chunk starts depends on all chunks before it. Every row gets a pointer to the start that would follow it,
    and the pointers are doubled: round n finds the next 2^n starts of every key by joins on (keys, position), so a key
    with most rows is spread over all tasks, and the number of rounds is the logarithm of the longest run of chunks.
    """
    given = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, order])).withColumn("_cost", F.least(F.greatest(F.coalesce(cost, F.lit(0)), F.lit(0)), F.lit(budget + 1)).cast("bigint"))
    numbered = running_total(given, keys, order, F.lit(1), "_pos", width)
    rows = cut(running_total(numbered, keys, order, F.col("_cost"), "_cum", width))
    jumps = cut(_next_starts(rows.select(*keys, "_pos", "_cum", "_cost"), keys, budget, most))
    found = _followed(rows.where("_pos = 1").select(*keys, "_pos"), jumps, keys)
    return _by_starts(rows, found, keys, df.columns, width)


def shared_batches(df: DataFrame, keys: list[str], order: str, own: Column, items: Column, budget: int, width: int, most: int) -> DataFrame:
    """df with `chunk` and `place`: rows are put in order into batches of at most `most` rows within a budget, and an item
    that several rows of a batch name is paid for once.

    `own` is a row's cost without its items, `items` an array of struct<id, cost>; an id named twice in a row counts once,
    with its first cost. The first row of a batch is charged for what the batch before it hasn't seen, as in the
    published rule; a row that alone exceeds the budget is taken all the same. Rows with a null key or order are left out;
    null arrays are empty, null costs count as 0, null items and ids as nothing. `most` may not exceed `width`.

    How far a batch goes depends on its first row and on the number of rows in the batch before it, so a state is both.
    Each row sees the `most` rows before and behind it through slices of positions that overlap; the states' pointers are
    followed by doubling as in next_fit.
    """
    if not 0 < most <= width:
        raise ValueError("most has to be between 1 and width")
    nothing = F.lit(0).cast("bigint")
    named = F.filter(F.coalesce(items, F.array()).cast("array<struct<id:bigint,cost:bigint>>"), lambda x: x["id"].isNotNull())
    first_of = F.transform(F.array_distinct(F.transform(named, lambda x: x["id"])), lambda i: F.struct(i.alias("id"), F.greatest(F.coalesce(F.filter(named, lambda x: x["id"] == i)[0]["cost"], nothing), nothing).cast("bigint").alias("cost")))
    given = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, order])).withColumn("_own", F.greatest(F.coalesce(own, nothing), nothing).cast("bigint")).withColumn("_items", first_of)
    rows = cut(running_total(given, keys, order, F.lit(1), "_pos", width))
    cell = F.floor(F.col("_pos") / width)
    cells = F.array_distinct(F.array(cell, F.floor((F.col("_pos") - most) / width), F.floor((F.col("_pos") + most) / width)))
    slices = rows.select(*keys, "_pos", "_own", "_items", F.explode(cells).alias("_cell"))
    near = Window.partitionBy(*keys, "_cell").orderBy("_pos")
    me = F.struct("_own", "_items")
    seen = slices.select(
        *keys, "_pos", "_cell", F.collect_list(me).over(near.rowsBetween(0, most - 1)).alias("_ahead"), F.collect_list(F.struct("_items")).over(near.rowsBetween(-most, -1)).alias("_behind")
    ).where(F.col("_cell") == cell)
    ids = lambda xs: F.transform(xs, lambda x: x["id"])
    fresh = lambda xs, known: F.aggregate(F.filter(xs, lambda x: ~F.array_contains(known, x["id"])), nothing, lambda t, x: t + x["cost"])
    start = F.struct(F.array(nothing).alias("spent"), ids(F.col("_ahead")[0]["_items"]).alias("known"))
    more = lambda s, r: F.struct(
        F.concat(s["spent"], F.array(F.element_at(s["spent"], -1) + r["_own"] + fresh(r["_items"], s["known"]))).alias("spent"), F.array_union(s["known"], ids(r["_items"])).alias("known")
    )
    grown = F.aggregate(F.slice("_ahead", 2, most), start, more)["spent"]
    before = lambda n: F.flatten(F.transform(F.slice("_behind", F.size("_behind") - n + 1, n), lambda r: ids(r["_items"])))
    paid = F.transform(F.sequence(F.lit(0), F.size("_behind")), lambda n: F.col("_ahead")[0]["_own"] + fresh(F.col("_ahead")[0]["_items"], before(n)))
    steps = seen.select(*keys, "_pos", grown.alias("_grown"), F.posexplode(paid).alias("_back", "_paid"))
    taken = F.greatest(F.lit(1), F.size(F.filter("_grown", lambda g: g + F.col("_paid") <= budget)))
    last = rows.groupBy(*keys).agg(F.max("_pos").alias("_last"))
    coded = lambda pos, back: pos * (most + 1) + back
    moves = steps.withColumn("_taken", taken).join(last, keys).where("_pos + _taken <= _last")
    jumps = cut(moves.select(*keys, coded(F.col("_pos"), F.col("_back")).alias("_pos"), coded(F.col("_pos") + F.col("_taken"), F.col("_taken")).alias("_next")))
    begun = rows.where("_pos = 1").select(*keys, coded(F.col("_pos"), F.lit(0)).alias("_pos"))
    found = _followed(begun, jumps, keys).select(*keys, F.floor(F.col("_pos") / (most + 1)).alias("_pos"))
    return _by_starts(rows, found, keys, df.columns, width)


def chunks_with_lanes(df: DataFrame, keys: list[str], order: str, cost: Column, shared: int, alone: int, width: int, most: int) -> DataFrame:
    """df with `lane`, `chunk` and `place`: rows up to `shared` share chunks, larger ones up to `alone` have one of their own,
    the rest have one too but must be shortened first (lane `cut`).

    A row of its own closes the chunk before it. chunk counts within (keys, lane, segment), where a segment is a run of
    rows without such a row; it is 0 for a row of its own, whose segment is its number.
    """
    size = F.greatest(F.coalesce(cost, F.lit(0)), F.lit(0))
    lane = F.when(size <= shared, "shared").when(size <= alone, "alone").otherwise("cut")
    given = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, order])).withColumn("lane", lane)
    parted = running_total(given, keys, order, (F.col("lane") != "shared").cast("int"), "segment", width)
    own = parted.where("lane <> 'shared'").withColumn("chunk", F.lit(0).cast("bigint")).withColumn("place", F.lit(0).cast("bigint"))
    return next_fit(parted.where("lane = 'shared'"), [*keys, "segment"], order, cost, shared, width, most).unionByName(own)

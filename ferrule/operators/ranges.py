"""Containment joins, running totals, sliding counts and byte windows, without one task holding a whole key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of the cells that turn a containment join into an equi join.
CELL = 4096


def contained(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, size: str, cell: int = CELL) -> DataFrame:
    """points joined with every range [start, start + size) of the same keys that contains them.

    Ranges are put into the cells that they touch, so both sides meet by an equi join on keys and cell; a long range
    has one row for each of its cells. Null points, starts and sizes match nothing, an empty range contains nothing.
    """
    last = F.col(start) + F.col(size) - 1
    floor = lambda c: F.floor(c / F.lit(cell)).cast("bigint")
    cells = ranges.where((F.col(size) > 0) & F.col(start).isNotNull()).withColumn("_cell", F.explode(F.sequence(floor(F.col(start)), floor(last))))
    at = points.where(F.col(point).isNotNull()).withColumn("_cell", floor(F.col(point)))
    return at.join(cells, [*keys, "_cell"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(size))).drop("_cell")


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int) -> DataFrame:
    """df with the sum of `value` over the rows of its keys up to and with its own, ordered by the whole number `order`.

    Rows are cut into slices of `width` order values; slices are summed first, then totals run inside of each slice
    alone. `order` must be unique within the keys. Null values count as 0.
    """
    sliced = df.withColumn("_v", F.coalesce(value, F.lit(0))).withColumn("_slice", F.floor(F.col(order) / F.lit(width)))
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_s")).drop("_s")
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sliced.join(before, [*keys, "_slice"]).withColumn(name, F.col("_before") + F.sum("_v").over(inside)).drop("_v", "_slice", "_before")


def within_budget(df: DataFrame, keys: list[str], order: str, cost: Column, budget: int, width: int) -> DataFrame:
    """The longest prefix of each key's rows whose costs, each plus 1, stay within the budget."""
    return running_total(df, keys, order, cost + 1, "used", width).where(F.col("used") <= budget)


def calls_in_window(df: DataFrame, key: str, at: str, seconds: int, name: str = "in_window") -> DataFrame:
    """df with the number of rows of the same key in the `seconds` up to and with its own time, older ones excluded.

    Each row also goes to the next time slice as a witness, so that windows are computed in slices of that length and
    a key with most rows is spread over all its slices. Null keys are a key of their own.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    span = seconds * 1_000_000
    timed = df.where(F.col(at).isNotNull()).withColumn("_t", micros).withColumn("_slice", F.floor(micros / span))
    both = timed.withColumn("_own", F.lit(1)).unionByName(timed.withColumn("_slice", F.col("_slice") + 1).withColumn("_own", F.lit(0)))
    frame = Window.partitionBy(key, "_slice").orderBy("_t").rangeBetween(-(span - 1), 0)
    return both.withColumn(name, F.count(F.lit(1)).over(frame)).where("_own = 1").drop("_t", "_slice", "_own")


def in_flight(df: DataFrame, key: str, start: str, stop: str, seconds: int, name: str = "in_flight") -> DataFrame:
    """df with the number of rows of the same key that have started and not yet stopped at its own start, itself included.

    A row stops before others start at the same time; one without a stop never stops, one that stops before it starts
    counts as stopped at once. Rows without a start are left out, null keys are a key of their own. Starts and stops are
    summed by time slice of `seconds`; only what changes inside of a slice is ordered, so a key with most rows is spread
    over all its slices.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = df.where(F.col(start).isNotNull()).withColumn("_t", micros(start)).withColumn("_own", F.lit(True)).withColumn("_d", F.lit(1))
    ends = timed.where(F.col(stop) > F.col(start)).withColumn("_t", micros(stop)).withColumn("_own", F.lit(False)).withColumn("_d", F.lit(-1))
    at_once = F.col("_own") & F.coalesce(F.col(stop) <= F.col(start), F.lit(False))
    log = timed.unionByName(ends).withColumn("_d", F.when(at_once, 0).otherwise(F.col("_d"))).withColumn("_slice", F.floor(F.col("_t") / (seconds * 1_000_000)))
    sums = log.groupBy(key, "_slice").agg(F.sum("_d").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(key).orderBy("_slice")) - F.col("_s")).select(F.col(key).alias("_k"), F.col("_slice").alias("_at"), "_before")
    inside = Window.partitionBy(key, "_slice").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    running = log.withColumn("_run", F.sum("_d").over(inside)).where("_own")
    met = running.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_at")))
    return met.withColumn(name, F.col("_before") + F.col("_run") + at_once.cast("int")).select(*df.columns, name)


def byte_windows(df: DataFrame, key: str, data: str, window: int = 512, stride: int = 256, keep_tail: bool = True, slices: str | None = None) -> DataFrame:
    """(key, start, length): windows over the bytes of a column, with the bytes themselves in the column `slices` if named.

    keep_tail: a last, shorter window covers the end (as for inference); else it is dropped where the data are longer
    than one window (as for training). Empty and null data have no windows.
    """
    n = F.octet_length(F.col(data))
    last = F.greatest(n - window, F.lit(0))
    starts = F.sequence(F.lit(0), (F.ceil(last / stride) if keep_tail else F.floor(last / stride)).cast("int") * stride, F.lit(stride))
    held = [F.col(data).cast("binary").alias("_data")] if slices else []
    out = df.where(n > 0).select(key, n.alias("_n"), *held, F.explode(starts).alias("start"))
    part = [F.substring(F.col("_data"), F.col("start") + 1, F.lit(window)).alias(slices)] if slices else []
    return out.select(key, "start", F.least(F.lit(window), F.col("_n") - F.col("start")).alias("length"), *part)


def merge_votes(windows: DataFrame, key: str, start: str, labels: str, confidences: str, n_labels: int, stride: int) -> DataFrame:
    """(key, start, labels, confidences): one row for each `stride` bytes, the votes of all windows over them merged.

    labels: a text of one digit for each byte from `start` on, which is a multiple of the stride; confidences: an array
    of as many doubles. A byte's score for a label is the sum of its confidences over the number of windows that cover
    the byte; the best label counts, the largest on a tie. Windows are cut into pieces of a stride, and a piece meets
    only the windows over it; a repeated window counts once. Null and empty votes have no bytes, a null key is left out.
    The sums are made in Arrow batches: as array expressions they took over ten times as long.
    """
    given = windows.where(F.col(key).isNotNull() & (F.length(labels) > 0) & F.col(confidences).isNotNull()).dropDuplicates([key, start])
    pieces = given.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.length(labels) - 1) / stride).cast("int")))).select(
        key, (F.col(start) + F.col("_i") * stride).alias("start"),
        F.struct(F.substring(F.col(labels), F.col("_i") * stride + 1, F.lit(stride)).alias("l"), F.slice(confidences, F.col("_i") * stride + 1, stride).alias("c")).alias("_p"),
    )
    met = pieces.groupBy(key, "start").agg(F.collect_list("_p").alias("_p")).select(key, "start", F.col("_p.l").alias("_l"), F.col("_p.c").alias("_c"))

    @F.pandas_udf("labels string, confidences array<double>")
    def merged(texts: pd.Series, trusts: pd.Series) -> pd.DataFrame:
        out = []
        for own, trust in zip(texts, trusts):
            n = max(map(len, own))
            score, seen = np.zeros((n_labels, n)), np.zeros(n)
            for text, c in zip(own, trust):
                at = np.arange(len(text))
                np.add.at(score, (np.frombuffer(text.encode(), np.uint8) - 48, at), c)
                seen[at] += 1
            best = n_labels - 1 - score[::-1].argmax(0)
            out.append((bytes((best + 48).astype(np.uint8)).decode(), score.max(0) / seen))
        return pd.DataFrame(out, columns=["labels", "confidences"])

    return met.withColumn("_m", merged("_l", "_c")).select(key, "start", "_m.labels", "_m.confidences")


def painted(ranges: DataFrame, keys: list[str], start: str, size: str, cell: int = CELL) -> DataFrame:
    """(keys, start, n_bytes): how many bytes of each range [start, start + size) stay its own when ranges are painted by
    ascending start, so that a later one covers what it shares with earlier ones.

    Ranges are cut at the borders of cells; in each cell the sorted starts and ends give segments, and the latest start that is
    still open owns each. Of ranges with one start the longest counts; null and empty ranges paint nothing, a range that is
    covered whole has no row.
    """
    given = ranges.where(F.col(start).isNotNull() & (F.col(size) > 0)).groupBy(*keys, F.col(start).alias("_from")).agg((F.col(start) + F.max(size)).alias("_to"))
    floor = lambda c: F.floor(c / F.lit(cell)).cast("bigint")
    parts = given.withColumn("_cell", F.explode(F.sequence(floor(F.col("_from")), floor(F.col("_to") - 1)))).select(
        *keys, "_cell", "_from", F.greatest("_from", F.col("_cell") * cell).alias("_low"), F.least("_to", (F.col("_cell") + 1) * cell).alias("_high")
    )
    ends = parts.select(*keys, "_cell", F.explode(F.array("_low", "_high")).alias("_at")).distinct()
    segments = ends.withColumn("_next", F.lead("_at").over(Window.partitionBy(*keys, "_cell").orderBy("_at"))).where("_next IS NOT NULL")
    owned = segments.join(parts, [*keys, "_cell"]).where("_low <= _at AND _at < _high").groupBy(*keys, "_at", "_next").agg(F.max("_from").alias(start))
    return owned.groupBy(*keys, start).agg(F.sum(F.col("_next") - F.col("_at")).alias("n_bytes"))


def label_runs(df: DataFrame, key: str, labels: Column) -> DataFrame:
    """(key, start, stop): the stretches that a label 1 opens and labels 2 continue, in a text of one label each.

    A further 1 closes a stretch and opens the next, any other label closes it; a 2 without a 1 before it opens none. Found in
    Arrow batches, nothing is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["_l"].str.len().to_numpy(np.int64) + 1  # a further sign between texts ends a stretch
            code = np.frombuffer(("0".join([*batch["_l"], ""])).encode(), np.uint8)
            starts, others = np.flatnonzero(code == 49), np.flatnonzero(code != 50)
            stops = others[np.searchsorted(others, starts, "right")] if len(starts) else starts
            first = np.cumsum(sizes) - sizes
            row = np.searchsorted(first, starts, "right") - 1
            yield pd.DataFrame({key: batch[key].to_numpy()[row], "start": starts - first[row], "stop": stops - first[row]})

    return df.select(key, labels.alias("_l")).where("_l <> ''").mapInPandas(run, f"`{key}` {kind}, start bigint, stop bigint")


def class_scores(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """(keys, label, tp, fp, fn, precision, recall, f1): scores of each label, 0 where a denominator is 0; null truths don't count."""
    known = df.where(F.col(truth).isNotNull())
    one = lambda c, t, p: known.select(*keys, F.col(c).alias("label"), t.cast("int").alias("t"), p.cast("int").alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit"))
    both = one(truth, F.lit(True), F.lit(False)).unionByName(one(predicted, F.lit(False), F.lit(True)).where("label IS NOT NULL"))
    counted = both.groupBy(*keys, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum(F.when(F.col("t") == 1, F.coalesce("hit", F.lit(0))).otherwise(0)).alias("tp"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, t, p = F.col("tp"), F.col("t"), F.col("p")
    return counted.select(*keys, "label", "tp", (p - tp).alias("fp"), (t - tp).alias("fn"), ratio(tp, p).alias("precision"), ratio(tp, t).alias("recall"), ratio(2 * tp, t + p).alias("f1"))

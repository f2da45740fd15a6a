"""Structured Streaming twins of batch aggregates over event files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.session import scratch_dir


def hourly_counts(events: DataFrame, at: str = "ts", key: str = "event_type", late: str | None = None) -> DataFrame:
    """(hour, key, n, total) in tumbling windows of an hour.

    `late` is the watermark of a live stream: it bounds the state, and events that come later are dropped. Without one, as for
    a bounded set of files, every event counts, in whatever order files come.

    Works on batch and streaming frames alike; times without a zone are read as UTC.
    """
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming and late:
        timed = timed.withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 hour").alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,4)")).alias("total")).select(
        F.col("w.start").alias("hour"), key, "n", "total"
    )


def latest_state(events: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The last row of each key by (time, event_id): the fold of an event log into current state."""
    order = F.struct(at, "event_id", *columns)
    return events.groupBy(key).agg(F.max(order).alias("s"), F.count(F.lit(1)).alias("n_events")).select(key, *[F.col(f"s.{c}").alias(c) for c in [at, *columns]], "n_events")


def drain(spark: SparkSession, source: str, fold, schema, pattern: str = "*", values: tuple[str, ...] = ("n", "total")) -> DataFrame:
    """Run a fold over all files of a folder as a stream with trigger availableNow; the result is the last update of each row, told by
    all columns but the `values` that the fold updates.

    The checkpoint is in the shared folder, so a restarted query goes on where it stopped.
    """
    where = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = fold(spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source))

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/out")
    keys, others = [c for c in stream.columns if c not in values], [c for c in stream.columns if c in values]
    last = rows.groupBy(*keys).agg(F.max(F.struct("_batch", *others)).alias("s"))
    return last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in others])

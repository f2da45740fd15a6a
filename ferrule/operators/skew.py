"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are grouped by key *and* value first, which spreads a hot key over as many groups as it has values and
replaces its repeated rows by weights; only these weighted values are then grouped by key, with map-side
partial aggregates, so that no task ever sees the raw rows of one key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "_weight"


def weighted_values(df: DataFrame, keys: Sequence[str], values: Sequence[str], *extra: Column) -> DataFrame:
    """One row for each distinct (keys, values) with the number of its rows in `_weight`."""
    return df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias(WEIGHT), *extra)


def key_profile(
    df: DataFrame,
    keys: Sequence[str],
    distinct: Mapping[str, Sequence[str]],
    latest: Mapping[str, str] | None = None,
    modes: Mapping[str, str] | None = None,
    rows: str = "n_rows",
) -> DataFrame:
    """Exact statistics of every key, null keys left out, without giving one key to one task.

    distinct: result column -> the columns whose distinct combinations are counted; a combination with a null in
      it isn't counted, as with SQL's COUNT(DISTINCT ...).
    latest: result column -> the column whose maximum is taken; null where all are null.
    modes: result column -> the column whose most frequent non-null value is taken; ties go to the smallest value.
    rows: the column with the number of rows, repeated ones included.

    The first entry of `distinct` also carries rows and maxima. Its values should be fine-grained. An empty table
    gives no rows. Columns that aren't named are never read.
    """
    if not distinct:
        raise ValueError("name at least one distinct count")
    latest, modes = dict(latest or {}), dict(modes or {})
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    parts, zero = [], F.lit(0).cast("long")
    for i, (name, values) in enumerate(distinct.items()):
        whole = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in values])
        first = i == 0
        grouped = weighted_values(
            known if first else known.where(whole), keys, values, *([F.max(c).alias(n) for n, c in latest.items()] if first else [])
        )
        parts.append(
            grouped.select(
                *keys,
                (F.col(WEIGHT) if first else zero).alias(rows),
                *[(F.when(whole, 1).otherwise(0) if n == name else zero).cast("long").alias(n) for n in distinct],
                *[(F.col(n) if first else F.lit(None).cast(df.schema[c].dataType)).alias(n) for n, c in latest.items()],
            )
        )
    out = (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*keys)
        .agg(F.sum(rows).alias(rows), *[F.sum(n).alias(n) for n in distinct], *[F.max(n).alias(n) for n in latest])
    )
    for name, column in modes.items():
        best = (
            weighted_values(known.where(F.col(column).isNotNull()), keys, [column])
            .groupBy(*keys)
            .agg(F.min(F.struct((-F.col(WEIGHT)).alias("w"), F.col(column).alias("v")))["v"].alias(name))
        )
        out = out.join(best, list(keys), "left")
    return out


def heavy_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The non-null keys that hold at least `share` of all rows (null keys and repeated rows count among them).

    Weights of (key, value) are summed by key, so a key with a third of the rows is counted by all tasks. The
    number of all rows is a scalar subquery; for an empty table nothing qualifies.
    """
    counted = weighted_values(df.where(F.col(key).isNotNull()), [key], [value]).groupBy(key).agg(F.sum(WEIGHT).alias("n_rows"))
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return counted.where(F.col("n_rows") >= F.lit(share) * total)

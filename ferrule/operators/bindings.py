"""The given tables as clean relations: repeated rows once, the latest row of each function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.session import table


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each (binary_id, address)."""
    return table(spark, sf, "function_info").dropDuplicates(["binary_id", "address"])


def results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").dropDuplicates(["result_id"])


def latest_results(spark: SparkSession, sf: str) -> DataFrame:
    """The last result of each function: refined before not, then by made_at and result_id."""
    rows = results(spark, sf)
    order = F.struct(F.coalesce("refined", F.lit(False)).alias("r"), "made_at", "result_id")
    last = rows.groupBy("binary_id", "address").agg(F.max(order)["result_id"].alias("result_id"))
    return rows.join(last.select("result_id"), "result_id", "left_semi")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "responses").dropDuplicates(["response_id"])


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """call_edges without repeated rows and with ref_type in one spelling."""
    return table(spark, sf, "call_edges").dropDuplicates(["edge_id"]).withColumn("ref_type", F.upper(F.trim("ref_type")))

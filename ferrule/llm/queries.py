"""Queries of the text problems (2, 5, 6, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import encode as enc
from ferrule.llm import packing, spam, truncation
from ferrule.session import table


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "responses").select(F.lit("raw").alias("field"), F.col("response_id").alias("record_id"), "model", F.col("raw").alias("value"))
    comments = table(spark, sf, "results").select(F.lit("comments").alias("field"), F.col("result_id").alias("record_id"), "model", F.col("comments").alias("value"))
    return raw.unionByName(comments)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_answers(spark, sf))


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    """For each field and model the share of its non-empty values that lost their end."""
    values = _answers(spark, sf)
    return truncation.truncation_rates(values, truncation.truncated(values))


def p5_ids(spark: SparkSession, sf: str) -> DataFrame:
    return enc.encode(table(spark, sf, "documents"))


def p5_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with the byte offset of each, and whether they spell the text again."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ids = enc.encode(docs, offsets=True)
    spelled = enc.decode(ids).withColumnRenamed("text", "spelled")
    return ids.join(spelled, "doc_id").join(docs, "doc_id").select(
        "doc_id", F.size("ids").alias("n_tokens"), F.try_element_at("starts", F.lit(-1)).alias("last_start"), (F.col("spelled") == F.coalesce("text", F.lit(""))).alias("same")
    )


def _sizes(spark: SparkSession, sf: str) -> tuple[DataFrame, list[int]]:
    """Sizes of all documents in tokens and the models' distinct capacities (a dimension of a few rows)."""
    limits = table(spark, sf, "model_limits").where("tokenizer = 'byte_bpe_50k' AND capacity_tokens > 0").select("capacity_tokens").distinct()
    return enc.token_counts(table(spark, sf, "documents")), sorted(r[0] for r in limits.collect())


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(*_sizes(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(packing.pack(*_sizes(spark, sf)))


def p6_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return packing.bucket_report(*_sizes(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf, "documents")).select("doc_id")


def p7_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The flagged pages with their group, distance and direction."""
    return spam.spam_pages(table(spark, sf, "documents")).select("doc_id", "grp", "d2", "cosine")


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p5_ids": p5_ids, "p5_offsets": p5_offsets, "p6_containers": p6_containers, "p6_report": p6_report, "p6_buckets": p6_buckets, "p7_found": p7_found, "p7_scores": p7_scores}

SQL: dict[str, str] = {}

"""Saved documents, shared-cost batches, lookups and write-back rows over the given tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import parsing
from ferrule.operators import bindings as b
from ferrule.operators import chunks, review
from ferrule.plans import programs
from ferrule.plans import reference as ref
from ferrule.session import scratch_dir, table
from ferrule.sources import documents as docs_io

#: Sizes that one prompt may show, and the positions in one slice.
PROMPT, SLICE = 4000, 1 << 12
# fixed values: rows of one prompt, cost of a row and of a body besides their texts, characters of an error
PER_CALL, FRAME, ERROR = 10, 200, 200


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    """(binary_id, address, callers, callees) of each function's last call_graph row."""
    last = lambda c: F.max_by(c, "built_at").alias(c)
    return table(spark, sf, "call_graph").groupBy("binary_id", "address").agg(last("callers"), last("callees"))


def w3_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The functions of each binary in address order in prompts that show their bodies and those of what they call.

    A body that several functions of a prompt call is shown, and paid for, once. Sizes stand for the bodies' lengths.
    """
    f = b.functions(spark, sf)
    g = _graph(spark, sf).select("binary_id", "address", F.array_distinct(F.concat(F.coalesce("callees", F.array().cast("array<bigint>")), F.array("address"))).alias("ids"))
    size = f.select("binary_id", F.col("address").alias("id"), (F.coalesce("size", F.lit(0)) + FRAME).alias("cost"))
    # no longer than the row's own list
    shown = g.select("binary_id", "address", F.explode("ids").alias("id")).join(size, ["binary_id", "id"]).groupBy("binary_id", "address").agg(F.collect_list(F.struct("id", "cost")).alias("items"))
    named = f.select("binary_id", "address", F.length(F.coalesce("name", F.lit(""))).alias("chars"))
    rows = g.select("binary_id", "address").join(named, ["binary_id", "address"], "left").join(shown, ["binary_id", "address"], "left")
    done = chunks.shared_batches(rows, ["binary_id"], "address", F.coalesce("chars", F.lit(0)) + FRAME, F.col("items"), PROMPT, SLICE, PER_CALL)
    return done.select("binary_id", "address", "chunk", "place")


def _saved(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """JSON documents written as lines to the shared folder and read back."""
    path = f"{scratch_dir(spark)}/analyses-{uuid.uuid4().hex}"
    rows.write.text(path)
    return docs_io.read_analyses(spark, path, wholetext=False)


def s14_saved_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of saved documents, one document a function; pairs without a caller or callee are dropped."""
    shown = lambda c: F.format_string("0x%x", c)
    pair = F.transform("callers", lambda u: F.array(F.when(u.isNotNull(), shown(u)), shown(F.col("address"))))
    body = F.to_json(F.struct(F.struct(F.col("binary_id").cast("string").alias("name")).alias("binary"), F.struct(pair.alias("edges")).alias("call_graph")))
    docs = _saved(table(spark, sf, "call_graph").select(body.alias("value")), spark)
    edges = docs_io.analysis_edges(docs.select(F.col("doc.binary.name").cast("bigint").alias("file"), "doc"))
    return edges.select(F.col("file").alias("binary_id"), "caller", "callee").distinct()


def s15_saved_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of saved documents, one document a result."""
    one = F.struct(F.format_string("0x%08x", "address").alias("address"), "original_name", "name", "signature", "confidence")
    body = F.to_json(F.struct(F.struct(F.col("binary_id").cast("string").alias("name")).alias("binary"), F.array(one).alias("functions")))
    docs = _saved(b.latest_results(spark, sf).where("address IS NOT NULL").select(body.alias("value")), spark)
    found = docs_io.analysis_functions(docs.select(F.col("doc.binary.name").cast("bigint").alias("file"), "doc"))
    return found.withColumnRenamed("file", "binary_id")


def s2_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every called address looked up among its binary's functions; `missing` where there is none."""
    asked = b.edges(spark, sf).where("callee IS NOT NULL").select("binary_id", F.col("callee").alias("address")).distinct()
    counted = lambda c: F.coalesce(F.size(c), F.lit(0))
    f = b.functions(spark, sf).select("binary_id", "address", F.lit(True).alias("known"), F.when(F.col("params").isNull(), 0).otherwise(counted("params")).alias("n_params"))
    return asked.join(f, ["binary_id", "address"], "left").select("binary_id", "address", F.col("known").isNull().alias("missing"), "n_params")


def x7_callers(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct callers of each finished function: from its call graph row, else from the calls, else none."""
    listed = _graph(spark, sf).where("callers IS NOT NULL").select("binary_id", "address", F.size(F.array_distinct(F.array_compact("callers"))).cast("bigint").alias("in_graph"))
    calls = b.edges(spark, sf).where("caller IS NOT NULL").select("binary_id", F.col("callee").alias("address"), "caller").distinct()
    called = calls.groupBy("binary_id", "address").agg(F.count(F.lit(1)).alias("in_edges"))
    keys = ["binary_id", "address"]
    good = b.latest_results(spark, sf).where(review.usable()).select(*keys).join(listed, keys, "left").join(called, keys, "left")
    source = F.when(F.col("in_graph").isNotNull(), "graph").when(F.col("in_edges").isNotNull(), "edges").otherwise("none")
    return good.select(*keys, F.coalesce("in_graph", "in_edges", F.lit(0)).alias("n_callers"), source.alias("source"))


def x4_write_back(spark: SparkSession, sf: str) -> DataFrame:
    """What a finished result writes to its function, each independently: name, signature and comment that aren't empty."""
    good = b.latest_results(spark, sf).where(review.usable()).withColumnRenamed("comments", "comment")
    return good.unpivot(["binary_id", "address"], ["name", "signature", "comment"], "field", "value").where("value <> ''")


def x32_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Failures by model and what a user is shown of their error."""
    return b.results(spark, sf).where("error <> ''").groupBy("model", F.substring("error", 1, ERROR).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


def a18_pending(spark: SparkSession, sf: str) -> DataFrame:
    """How many functions of each binary are still to be made again, by reason."""
    return programs.x12_pending(spark, sf).groupBy("binary_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def f27_constants(spark: SparkSession, sf: str) -> DataFrame:
    """The number that each constant of a signature holds: hexadecimal anywhere in it, decimal alone, or behind `(const,`.

    Null where there is none or it doesn't fit a long.
    """
    c = F.explode("indicators.constants").alias("token")
    tokens = table(spark, sf, "signatures").select("sig_id", c).where("token IS NOT NULL").withColumn("token", F.trim("token"))
    part = lambda p: F.nullif(F.regexp_extract("token", p, 1), F.lit(""))
    hexadecimal = parsing.address(F.concat(F.lit("0x"), part("0x([0-9a-fA-F]+)")))
    decimal = F.coalesce(part(r"^#?(-?\d+)$"), part(r"\(const,\s*(\d+)")).try_cast("bigint")
    return tokens.select("sig_id", "token", F.when(part("0x([0-9a-fA-F]+)").isNotNull(), hexadecimal).otherwise(decimal).alias("value")).distinct()


QUERIES = {f.__name__: f for f in [w3_batches, s14_saved_edges, s15_saved_functions, s2_lookup, x7_callers, x4_write_back, x32_errors, a18_pending, f27_constants]}

_LAST_GRAPH = "g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY binary_id, address ORDER BY built_at DESC NULLS LAST) AS rn FROM call_graph) WHERE rn = 1)"
_GOOD = f"good AS (SELECT * FROM last WHERE {ref._USABLE})"
_FRESH = "coalesce(list_sum(list_transform(list_filter(q.items, lambda x: NOT list_contains(w.seen, x.id)), lambda x: x.cost)), 0)"
_FULL = f"(w.n >= {PER_CALL} OR w.spent + q.own + {_FRESH} > {PROMPT})"

SQL = {
    "w3_batches": f"""WITH RECURSIVE {ref._F}, {_LAST_GRAPH}, i AS (SELECT binary_id, address, unnest(list_distinct(list_append(coalesce(callees, []), address))) AS id FROM g),
        c AS (SELECT i.binary_id, i.address, list({{'id': id, 'cost': coalesce(size, 0) + {FRAME}}}) AS items FROM i JOIN f ON f.binary_id = i.binary_id AND f.address = id GROUP BY ALL),
        q AS (SELECT g.binary_id, g.address, coalesce(length(name), 0) + {FRAME} AS own, coalesce(items, []) AS items, row_number() OVER (PARTITION BY g.binary_id ORDER BY g.address) AS pos
            FROM g LEFT JOIN f ON f.binary_id = g.binary_id AND f.address = g.address LEFT JOIN c ON c.binary_id = g.binary_id AND c.address = g.address),
        w AS (SELECT binary_id, address, pos, 0::BIGINT AS chunk, 1::BIGINT AS n, list_transform(items, lambda x: x.id) AS seen, (own + coalesce(list_sum(list_transform(items, lambda x: x.cost)), 0))::BIGINT AS spent FROM q WHERE pos = 1
            UNION ALL SELECT q.binary_id, q.address, q.pos, CASE WHEN {_FULL} THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN {_FULL} THEN 1 ELSE w.n + 1 END,
                CASE WHEN {_FULL} THEN list_transform(q.items, lambda x: x.id) ELSE list_concat(w.seen, list_transform(q.items, lambda x: x.id)) END,
                (q.own + {_FRESH} + CASE WHEN {_FULL} THEN 0 ELSE w.spent END)::BIGINT FROM w JOIN q ON q.binary_id = w.binary_id AND q.pos = w.pos + 1)
        SELECT binary_id, address, chunk, n - 1 AS place FROM w""",
    "s14_saved_edges": "SELECT DISTINCT binary_id, caller, address AS callee FROM (SELECT binary_id, address, unnest(callers) AS caller FROM call_graph) WHERE caller IS NOT NULL",
    "s15_saved_functions": f"WITH {ref._L} SELECT binary_id, address, original_name, name, signature, confidence FROM last WHERE address IS NOT NULL",
    "s2_lookup": f"""WITH {ref._F}, {ref._E}, d AS (SELECT DISTINCT binary_id, callee AS address FROM e WHERE callee IS NOT NULL)
        SELECT d.binary_id, d.address, f.address IS NULL AS missing, CASE WHEN f.address IS NOT NULL THEN coalesce(len(params), 0) END::INT AS n_params FROM d LEFT JOIN f ON f.binary_id = d.binary_id AND f.address = d.address""",
    "x7_callers": f"""WITH {ref._L}, {_GOOD}, {_LAST_GRAPH}, {ref._E}, c AS (SELECT binary_id, callee, count(DISTINCT caller) AS n FROM e WHERE caller IS NOT NULL GROUP BY ALL)
        SELECT good.binary_id, good.address, coalesce(len(list_distinct(callers)), n, 0)::BIGINT AS n_callers, CASE WHEN callers IS NOT NULL THEN 'graph' WHEN n IS NOT NULL THEN 'edges' ELSE 'none' END AS source
        FROM good LEFT JOIN g ON g.binary_id = good.binary_id AND g.address = good.address LEFT JOIN c ON c.binary_id = good.binary_id AND c.callee = good.address""",
    "x4_write_back": f"WITH {ref._L}, {_GOOD} "
    + " UNION ALL ".join(f"SELECT binary_id, address, '{shown}' AS field, {c} AS value FROM good WHERE {c} <> ''" for shown, c in [("name", "name"), ("signature", "signature"), ("comment", "comments")]),
    "x32_errors": f"WITH {ref._R} SELECT model, left(error, {ERROR}) AS shown, count(*) AS n FROM r WHERE error <> '' GROUP BY ALL",
    "a18_pending": f"SELECT binary_id, reason, count(*) AS n FROM ({programs.SQL['x12_pending']}) GROUP BY ALL",
    "f27_constants": r"""SELECT DISTINCT sig_id, token, CASE WHEN regexp_matches(token, '0x[0-9a-fA-F]+') THEN CASE WHEN length(regexp_extract(token, '0x([0-9a-fA-F]+)', 1)) <= 16
            THEN try_cast('0x' || regexp_extract(token, '0x([0-9a-fA-F]+)', 1) AS BIGINT) END
        WHEN regexp_matches(token, '^#?-?\d+$') THEN try_cast(ltrim(token, '#') AS BIGINT) ELSE try_cast(nullif(regexp_extract(token, '\(const,\s*(\d+)', 1), '') AS BIGINT) END AS value
        FROM (SELECT sig_id, trim(unnest(indicators.constants)) AS token FROM signatures) WHERE token IS NOT NULL""",
}

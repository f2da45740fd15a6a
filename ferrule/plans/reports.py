"""Reports and joins over results, answers, calls and limits, and their SQL. Names begin with the survey's ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import bindings as b
from ferrule.operators import callsites, review
from ferrule.plans import reference as ref
from ferrule.session import scratch_dir, table
from ferrule.sources import documents as docs_io

#: Conflicts that one review takes from each binary, seconds that a call may take.
REVIEWED, TIMEOUT = 50, 600
# fixed values: samples a measured rate needs, output budget without one and at most
SAMPLES, MOST_OUTPUT = 3, 65536


def _ranked(found: DataFrame) -> DataFrame:
    """Conflicts with the place of their kind in the report."""
    return found.select((F.array_position(F.array(*[F.lit(k) for k in review.KINDS]), F.col("kind")) - 1).cast("int").alias("kind_rank"), *found.columns)


def l3_report(spark: SparkSession, sf: str) -> DataFrame:
    """The conflicts that SQL can state, ordered by kind, binary and address."""
    return _ranked(review.conflicts(b.latest_results(spark, sf), table(spark, sf, "signatures"))).orderBy("kind_rank", "binary_id", "address", "detail")


def d7_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole coherence report, calls in bodies included (D1 to D7), ordered by kind, binary and address."""
    last = b.latest_results(spark, sf)
    calls = callsites.call_conflicts(last, table(spark, sf, "documents"), "doc_id", "text")
    found = review.conflicts(last, table(spark, sf, "signatures")).unionByName(calls.select("kind", "binary_id", "address", "detail"))
    return _ranked(found).orderBy("kind_rank", "binary_id", "address", "detail").drop("kind_rank")


def l4_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """For each binary the conflicts that a review takes, the first in the report's order, and how many it leaves."""
    found = _ranked(review.conflicts(b.latest_results(spark, sf), table(spark, sf, "signatures")))
    order = Window.partitionBy("binary_id").orderBy("kind_rank", "address", "detail")
    taken = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= REVIEWED)
    left = found.groupBy("binary_id").agg(F.greatest(F.count(F.lit(1)) - REVIEWED, F.lit(0)).alias("unreviewed"))
    return taken.join(left, "binary_id").select("binary_id", "place", "kind", "address", "detail", "unreviewed")


def j5_library_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Known library functions that are called: calls and calling binaries of each signature."""
    calls = b.edges(spark, sf).select("edge_id", "binary_id", F.col("callee").alias("address"))
    counted = calls.groupBy("address", "binary_id").agg(F.count(F.lit(1)).alias("n")).groupBy("address").agg(F.sum("n").alias("n_calls"), F.count("binary_id").alias("n_binaries"))
    return table(spark, sf, "signatures").select("sig_id", "address", "name").join(counted, "address").select("sig_id", "name", "n_calls", "n_binaries")


def c5_draft(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a function gets a draft first: large ones don't."""
    f = b.functions(spark, sf).select("binary_id", "address", review.size_class(F.col("size"), F.col("is_thunk")).alias("c"))
    return f.select("binary_id", "address", (F.coalesce("c", F.lit("")) != "large").alias("draft"))


def l8_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Finished results of the selected functions: those that a struct proposal comes from."""
    picked = table(spark, sf, "proposals").select("binary_id", F.col("source_function").alias("address"))
    return b.latest_results(spark, sf).where(review.usable()).join(picked, ["binary_id", "address"], "left_semi").select("binary_id", "address", "name")


def x19_includable(spark: SparkSession, sf: str) -> DataFrame:
    """Finished results whose function has a body."""
    bodies = b.functions(spark, sf).where("size > 0 AND NOT coalesce(is_thunk, false)").select("binary_id", "address")
    return b.latest_results(spark, sf).where(review.usable()).join(bodies, ["binary_id", "address"], "left_semi").select("binary_id", "address", "name")


def a17_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Output tokens that each model gives within the time limit, by its measured rate; a fixed number for fewer than three samples."""
    took = (F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("received_at").cast("timestamp"))) / 1e6
    timed = b.responses(spark, sf).select("model", "output_tokens", took.alias("took")).where("output_tokens > 0 AND took > 0")
    sums = timed.groupBy("model").agg(F.count(F.lit(1)).alias("samples"), F.sum("output_tokens").alias("tokens"), F.sum("took").alias("seconds"))
    within = F.floor(F.col("tokens") / F.col("seconds") * TIMEOUT).cast("bigint")
    return sums.select("model", "samples", F.when(F.col("samples") >= SAMPLES, within).otherwise(MOST_OUTPUT).alias("within"))


def w15_next_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The output budget after a cut answer: twice the present one within the model's capacity; null where there is no more."""
    top = F.least("capacity_tokens", F.lit(MOST_OUTPUT))
    now = F.coalesce("max_output_tokens", F.lit(4096))
    return table(spark, sf, "model_limits").select("model", F.when(now < top, F.least(now * 2, top)).alias("next_budget"))


def k5_translated(spark: SparkSession, sf: str) -> DataFrame:
    """Finished results with the answer that translates each; those without one are marked."""
    answers = ref.j2_answers_of_functions(spark, sf)
    good = b.latest_results(spark, sf).where(review.usable()).select("binary_id", "address", "name")
    shown = F.coalesce(F.col("response_id").cast("string"), F.lit("no translation"))
    return good.join(answers, ["binary_id", "address"], "left").select("binary_id", "address", "name", shown.alias("translation"))


def t8_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Results that came in after the last synthesis of their binary: what a snapshot taken then lacks."""
    cursor = table(spark, sf, "synthesis").groupBy("binary_id").agg(F.max("received_at").alias("cursor"))
    return b.results(spark, sf).join(cursor, "binary_id", "left").where("cursor IS NULL OR loaded_at > cursor").select("result_id", "binary_id", "address")


def s17_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of a selection file: the functions of all binaries, written as lines with comments and read again."""
    path = f"{scratch_dir(spark)}/selection-{uuid.uuid4().hex}"
    name = F.regexp_replace(F.coalesce("name", F.lit("")), r"[\r\n]", " ")
    b.functions(spark, sf).where("address IS NOT NULL").select(F.concat(F.format_string("0x%x", "address"), F.lit(",  # "), name).alias("value")).write.text(path)
    return docs_io.address_selection(spark.read.text(path))


QUERIES = {f.__name__: f for f in [l3_report, d7_report, l4_reviewed, j5_library_calls, c5_draft, l8_selected, x19_includable, a17_rates, w15_next_budget, k5_translated, t8_delta, s17_selection]}

_RANK = "list_position([{}], kind) - 1".format(", ".join(f"'{k}'" for k in review.KINDS))
_FOUND = ref.SQL["d7_conflicts"]
_GOOD = f"good AS (SELECT * FROM last WHERE {ref._USABLE})"

SQL = {
    "l3_report": f"SELECT ({_RANK})::INT AS kind_rank, kind, binary_id, address, detail FROM ({_FOUND})",
    "l4_reviewed": f"""SELECT binary_id, place::INT AS place, kind, address, detail, greatest(n - {REVIEWED}, 0) AS unreviewed FROM (SELECT *, count(*) OVER (PARTITION BY binary_id) AS n,
        row_number() OVER (PARTITION BY binary_id ORDER BY {_RANK}, address, detail) AS place FROM ({_FOUND})) WHERE place <= {REVIEWED}""",
    "j5_library_calls": f"WITH {ref._E} SELECT sig_id, s.name, count(*) AS n_calls, count(DISTINCT binary_id) AS n_binaries FROM e JOIN signatures s ON s.address = e.callee GROUP BY sig_id, s.name, s.address",
    "c5_draft": f"WITH {ref._F} SELECT binary_id, address, coalesce(is_thunk, false) OR coalesce(size, 0) <= 256 AS draft FROM f",
    "l8_selected": f"WITH {ref._L}, {_GOOD} SELECT binary_id, address, name FROM good g WHERE EXISTS (SELECT 1 FROM proposals p WHERE p.binary_id = g.binary_id AND p.source_function = g.address)",
    "x19_includable": f"WITH {ref._L}, {_GOOD}, {ref._F} SELECT g.binary_id, g.address, g.name FROM good g JOIN f ON f.binary_id = g.binary_id AND f.address = g.address WHERE f.size > 0 AND NOT coalesce(f.is_thunk, false)",
    "a17_rates": f"""WITH {ref._P}, t AS (SELECT model, output_tokens, (epoch_us(loaded_at) - epoch_us(received_at)) / 1e6 AS took FROM q)
        SELECT model, count(*) AS samples, CASE WHEN count(*) >= {SAMPLES} THEN floor(sum(output_tokens) / sum(took) * {TIMEOUT})::BIGINT ELSE {MOST_OUTPUT} END AS within
        FROM t WHERE output_tokens > 0 AND took > 0 GROUP BY model""",
    "w15_next_budget": f"""SELECT model, CASE WHEN now < top THEN least(now * 2, top) END::INT AS next_budget FROM (SELECT model, coalesce(max_output_tokens, 4096) AS now,
        least(capacity_tokens, {MOST_OUTPUT}) AS top FROM model_limits)""",
    "k5_translated": f"""WITH {ref._L}, {_GOOD}, a AS ({ref.SQL["j2_answers_of_functions"]}) SELECT g.binary_id, g.address, g.name, coalesce(a.response_id::VARCHAR, 'no translation') AS translation
        FROM good g LEFT JOIN a ON a.binary_id = g.binary_id AND a.address = g.address""",
    "t8_delta": f"""WITH {ref._R}, c AS (SELECT binary_id, max(received_at) AS at FROM synthesis GROUP BY binary_id)
        SELECT result_id, r.binary_id, r.address FROM r LEFT JOIN c ON c.binary_id = r.binary_id WHERE c.at IS NULL OR r.loaded_at > c.at""",
    "s17_selection": "SELECT DISTINCT address FROM function_info WHERE address IS NOT NULL",
}

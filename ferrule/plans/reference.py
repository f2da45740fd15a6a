"""Queries of the analysis operators over the given tables, and their SQL. Names begin with the survey's ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import code, names, parsing
from ferrule.operators import bindings as b
from ferrule.operators import hierarchy, nested, ranges, reach, review
from ferrule.plans.general import _P1
from ferrule.session import cut, table
from ferrule.sources import documents as docs_io
from ferrule.streaming import folds

BUDGET, SLICE = 4000, 1 << 16


def c1_size_class(spark: SparkSession, sf: str) -> DataFrame:
    return b.functions(spark, sf).select("binary_id", "address", review.size_class(F.col("size"), F.col("is_thunk")).alias("size_class"))


def c2_analyzable(spark: SparkSession, sf: str) -> DataFrame:
    """Functions worth an analysis; one without a classification is."""
    return b.functions(spark, sf).where(~review.class_label(F.col("classification")).isin("imported", "thunk")).select("binary_id", "address")


def a3_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return b.functions(spark, sf).groupBy(review.class_label(F.col("classification")).alias("classification")).agg(F.count(F.lit(1)).alias("n"))


def c4_generic_names(spark: SparkSession, sf: str) -> DataFrame:
    return b.results(spark, sf).select("result_id", names.is_generic(F.col("name")).alias("generic"))


def c6_refine_reason(spark: SparkSession, sf: str) -> DataFrame:
    return b.results(spark, sf).select("result_id", review.refinement_reason().alias("reason"))


def a1_stats(spark: SparkSession, sf: str) -> DataFrame:
    return review.result_stats(b.latest_results(spark, sf), ["binary_id"])


def a2_retracted(spark: SparkSession, sf: str) -> DataFrame:
    """The same statistics as an update stream gives them: every result added, every replaced one taken back."""
    every, last = b.results(spark, sf), b.latest_results(spark, sf).select("result_id", F.lit(True).alias("stays"))
    log = every.withColumn("sign", F.lit(1)).unionByName(every.join(last, "result_id", "left_anti").withColumn("sign", F.lit(-1)))
    return review.result_stats(log, ["binary_id"], F.col("sign"))


def a5_duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return review.duplicate_names(b.latest_results(spark, sf))


def j1_signature_match(spark: SparkSession, sf: str) -> DataFrame:
    return review.match_signatures(b.results(spark, sf), table(spark, sf, "signatures")).select("result_id", "sig_id")


def j2_answers_of_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Every function with its last answer, null where there is none."""
    last = review.answers_by_address(b.responses(spark, sf))
    return b.functions(spark, sf).select("binary_id", "address").join(last.select("binary_id", "address", "response_id"), ["binary_id", "address"], "left")


def j4_sites_in_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Call sites and the function whose body holds them, counted by function."""
    sites = b.edges(spark, sf).select("edge_id", "binary_id", "site_addr")
    inside = ranges.contained(sites, b.functions(spark, sf).select("binary_id", "address", "size"), ["binary_id"], "site_addr", "address", "size")
    return inside.groupBy("binary_id", "address").agg(F.count(F.lit(1)).alias("n_sites"), F.min("site_addr").alias("first_site"))


def s6_callees(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct calls between functions of one binary; calls of anything else are dropped."""
    calls = b.edges(spark, sf).where(F.col("ref_type").contains("CALL")).select("binary_id", "caller", "callee").distinct()
    entry = b.functions(spark, sf).select("binary_id", F.col("address").alias("callee"))
    return calls.where("caller IS NOT NULL").join(entry, ["binary_id", "callee"], "left_semi")


def j9_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes of the call graph: the functions and the ends of links that are none."""
    e = b.edges(spark, sf)
    ends = e.select("binary_id", F.col("caller").alias("address")).unionByName(e.select("binary_id", F.col("callee").alias("address"))).dropna().distinct()
    own = b.functions(spark, sf).select("binary_id", "address", F.lit("f").alias("kind"))
    return own.unionByName(ends.join(own, ["binary_id", "address"], "left_anti").withColumn("kind", F.lit("u")))


def g1_degrees(spark: SparkSession, sf: str) -> DataFrame:
    d = reach.degrees(*hierarchy.call_links(table(spark, sf, "call_graph")))
    return d.select(F.col("scope").alias("binary_id"), F.col("node").alias("address"), "n_above", "n_below")


def g2_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All functions that the thunks reach."""
    nodes, links = hierarchy.call_links(table(spark, sf, "call_graph"))
    nodes, links = cut(nodes), cut(links)
    seeds = b.functions(spark, sf).where("is_thunk").select(F.col("binary_id").alias("scope"), F.col("address").alias("node"))
    reached = reach.closure_in_tree(seeds, cut(hierarchy.hierarchy(nodes, links)), links)
    return reached.select(F.col("scope").alias("binary_id"), F.col("node").alias("address"))


def g10_invalidated(spark: SparkSession, sf: str) -> DataFrame:
    """Refined functions and their direct callers."""
    _, links = hierarchy.call_links(table(spark, sf, "call_graph"))
    changed = b.results(spark, sf).where("refined").select(F.col("binary_id").alias("scope"), F.col("address").alias("node")).distinct()
    return reach.with_callers(changed, links).select(F.col("scope").alias("binary_id"), F.col("node").alias("address"))


def w1_name_budget(spark: SparkSession, sf: str) -> DataFrame:
    """For each binary the functions in address order whose names fit into a budget of characters."""
    f = b.functions(spark, sf).select("binary_id", "address", "name")
    return ranges.within_budget(f, ["binary_id"], "address", F.length(F.coalesce("name", F.lit(""))), BUDGET, SLICE)


def l1_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis order: functions that call nothing unfinished first, by the longest way down, then size."""
    nodes, links = hierarchy.call_links(table(spark, sf, "call_graph"))
    nodes, links = cut(nodes), cut(links)
    heights = reach.heights(cut(hierarchy.hierarchy(nodes, links)), links)
    sizes = b.functions(spark, sf).select(F.col("binary_id").alias("scope"), F.col("address").alias("node"), F.coalesce("size", F.lit(0)).alias("size"))
    placed = heights.join(sizes, ["scope", "node"])
    return placed.select(F.col("scope").alias("binary_id"), F.col("node").alias("address"), "height", (F.col("height").cast("bigint") * 1000000 + F.col("size")).alias("priority"))


def w8_top_callees(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 callees with most distinct callers (a top-k report)."""
    pairs = b.edges(spark, sf).select("callee", "binary_id", "caller").dropna().distinct()
    return pairs.groupBy("callee").agg(F.count(F.lit(1)).alias("n_callers")).orderBy(F.desc("n_callers"), "callee").limit(50)


def w10_last_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The last 4000 answers (a ring of fixed length)."""
    return b.responses(spark, sf).select("response_id", "received_at").orderBy(F.desc_nulls_last("received_at"), F.desc("response_id")).limit(4000)


def w11_byte_windows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    infer = ranges.byte_windows(docs, "doc_id", "text").withColumn("rule", F.lit("inference"))
    return infer.unionByName(ranges.byte_windows(docs, "doc_id", "text", keep_tail=False).withColumn("rule", F.lit("training")))


def w13_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of letters that a capital opens, in all documents."""
    labels = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]", "0"), "[A-Z]", "1"), "[a-z]", "2")
    return ranges.label_runs(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", labels)


def a13_class_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How well the size tells the classification that functions have."""
    f = b.functions(spark, sf).select("binary_id", F.nullif(F.lower(F.trim("classification")), F.lit("")).alias("truth"), review.size_class(F.col("size"), F.col("is_thunk")).alias("guess"))
    s = ranges.class_scores(f, ["binary_id"], "truth", "guess")
    return s.select("binary_id", "label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def t4_calls_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    """For each answer the number of answers of its model in the 60 seconds up to it."""
    timed = b.responses(spark, sf).select("response_id", "model", "received_at")
    return ranges.calls_in_window(timed, "model", "received_at", 60).select("response_id", "in_window")


def a8_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and tokens by model; null is a model of its own."""
    return b.responses(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens")
    )


def f31_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Each model's output limit: its own, else an eighth of the capacity within 256 and 8192, else 4096."""
    used = b.responses(spark, sf).select("model").distinct()
    limits = table(spark, sf, "model_limits").select("model", "capacity_tokens", "max_output_tokens")
    guess = F.greatest(F.lit(256), F.least(F.lit(8192), F.expr("capacity_tokens div 8"))).cast("int")
    return used.join(limits, "model", "left").select("model", F.coalesce("max_output_tokens", guess, F.lit(4096)).alias("max_output"))


def f12_confidences(spark: SparkSession, sf: str) -> DataFrame:
    """All confidences as the answers write them, and their scores."""
    said = F.regexp_extract_all("raw", F.lit('"confidence"\\s*:\\s*"?([^",}\n]*)'), F.lit(1))
    each = b.responses(spark, sf).select("response_id", F.posexplode(said).alias("pos", "said"))
    return each.select("response_id", "pos", parsing.confidence(F.col("said")).alias("score"))


def f12_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """All addresses as the answers write them, read by the rules for hexadecimal and decimal."""
    said = F.regexp_extract_all("raw", F.lit('"address"\\s*:\\s*"?([0-9a-fA-Fx]+)'), F.lit(1))
    each = b.responses(spark, sf).select("response_id", F.posexplode(said).alias("pos", "said"))
    return each.select("response_id", "pos", parsing.address(F.col("said")).alias("address"))


def f13_fences(spark: SparkSession, sf: str) -> DataFrame:
    return b.responses(spark, sf).where("raw IS NOT NULL").select("response_id", F.md5(parsing.strip_fences(F.col("raw"))).alias("inner_md5"))


def f8_signatures(spark: SparkSession, sf: str) -> DataFrame:
    s = parsing.signature(F.col("signature"))
    return b.results(spark, sf).select("result_id", s.alias("s")).where("s IS NOT NULL").select("result_id", "s.return_type", "s.name", "s.n_params")


def f2_negative_literals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text LIKE '%+ -%'").select("doc_id", F.md5(code.negative_literals(F.col("text"))).alias("text_md5"))


def f7_obfuscation(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", F.explode(code.obfuscation(F.col("text"))).alias("technique"))
    return found


def c8_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Whether obfuscation is real in each language's documents: at least 12 flagged, or a twentieth of all."""
    flagged = table(spark, sf, "documents").select("lang", (F.size(F.coalesce(code.obfuscation(F.col("text")), F.array())) > 0).cast("int").alias("hit"))
    counted = flagged.groupBy("lang").agg(F.sum("hit").alias("flagged"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("verdict", (F.col("flagged") > 0) & ((F.col("flagged") >= 12) | (F.col("flagged") >= F.col("total") * 0.05)))


def f26_crypto(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(code.crypto_algorithms(F.col("text"))).alias("algorithm"))


def f28_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("n_bytes"))


def a10_globals(spark: SparkSession, sf: str) -> DataFrame:
    """Names of globals in documents that at least two documents use: number of documents and of uses."""
    each = table(spark, sf, "synthesis").dropDuplicates(["synth_id"]).select("synth_id", F.explode(F.regexp_extract_all("raw", F.lit("DAT_[0-9a-fA-F]+"), F.lit(0))).alias("symbol"))
    per = each.groupBy("symbol", "synth_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("n_uses")).where("n_records >= 2")


def l9_globals(spark: SparkSession, sf: str) -> DataFrame:
    """The globals of all syntheses merged by binary: the first synthesis that names one wins."""
    rows = table(spark, sf, "synthesis").dropDuplicates(["synth_id"])
    maps = nested.find_member(nested.parse_answers(rows, "synth_id", "raw"), "globals")
    named = nested.members(maps, "node", ["record"]).select(F.col("record").alias("synth_id"), F.col("key").alias("symbol"), F.try_variant_get("value", "$", "string").alias("name"))
    placed = named.join(rows.select("synth_id", "binary_id"), "synth_id")
    return placed.groupBy("binary_id", "symbol").agg(F.min(F.struct("synth_id", "name"))["name"].alias("name"))


def f20_name_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How well first names agree with the refined ones of the same functions."""
    r = b.results(spark, sf).where(review.usable())
    first = r.where("NOT coalesce(refined, false)").groupBy("binary_id", "address").agg(F.min(F.struct("result_id", "name"))["name"].alias("predicted"))
    truth = r.where("refined").groupBy("binary_id", "address").agg(F.min(F.struct("result_id", "name"))["name"].alias("truth"))
    both = first.join(truth, ["binary_id", "address"])
    return both.select("binary_id", "address", F.round(names.symbol_accuracy(F.col("predicted"), F.col("truth")), 6).alias("accuracy"))


def f23_type_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How well first signatures agree with the refined ones, averaged by binary; both must be signatures."""
    r = b.results(spark, sf).where(review.usable() & F.col("signature").rlike(parsing.SIGNATURE))
    first = r.where("NOT coalesce(refined, false)").groupBy("binary_id", "address").agg(F.min(F.struct("result_id", "signature"))["signature"].alias("p"))
    truth = r.where("refined").groupBy("binary_id", "address").agg(F.min(F.struct("result_id", "signature"))["signature"].alias("t"))
    both = first.join(truth, ["binary_id", "address"])
    return both.select("binary_id", "address", F.round(parsing.type_accuracy(F.col("p"), F.col("t")), 6).alias("accuracy"))


def g4_chains(spark: SparkSession, sf: str) -> DataFrame:
    c = reach.chains(*hierarchy.call_links(table(spark, sf, "call_graph")))
    return c.select(F.col("scope").alias("binary_id"), "chain", "pos", F.col("node").alias("address"))


def g8_source_edges(spark: SparkSession, sf: str) -> DataFrame:
    return docs_io.source_edges(table(spark, sf, "documents"), "doc_id", "text")


def a6_unified_structs(spark: SparkSession, sf: str) -> DataFrame:
    return review.unify_structs(table(spark, sf, "proposals"))


def d7_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """The coherence report: all conflicts of the latest results."""
    return review.conflicts(b.latest_results(spark, sf), table(spark, sf, "signatures"))


def x16_merged(spark: SparkSession, sf: str) -> DataFrame:
    """First and refined results merged: a failed or nameless refinement keeps the old name, calls add up."""
    r = b.results(spark, sf)
    pick = lambda cond, p: r.where(cond).groupBy("binary_id", "address").agg(F.max(F.struct("made_at", "result_id", "name", "error"))[
        "name"].alias(f"{p}name"), F.max(F.struct("made_at", "result_id", "name", "error"))["error"].alias(f"{p}error"), F.sum(F.coalesce("llm_calls", F.lit(0))).alias(f"{p}calls"))
    old, new = pick("NOT coalesce(refined, false)", "o_"), pick("refined", "n_")
    good = (F.coalesce("n_name", F.lit("")) != "") & (F.coalesce("n_error", F.lit("")) == "")
    return old.join(new, ["binary_id", "address"], "full").select(
        "binary_id", "address", F.when(good, F.col("n_name")).otherwise(F.col("o_name")).alias("name"),
        (F.coalesce("o_calls", F.lit(0)) + F.coalesce("n_calls", F.lit(0))).alias("llm_calls"), F.col("n_calls").isNotNull().alias("refined"),
    )


def k7_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.coalesce("error", F.lit("")) != ""
    line = docs_io.log_line(
        F.col("made_at"), F.when(failed, "WARNING").otherwise("INFO"), F.lit("result"),
        F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.format_string("0x%08x", "address")), F.col("error"),
    )
    return b.results(spark, sf).where("address IS NOT NULL").select("result_id", line.alias("line"))


def k1_export(spark: SparkSession, sf: str) -> DataFrame:
    """The finished results as JSON and read again."""
    rows = docs_io.export_rows(b.latest_results(spark, sf))
    back = F.from_json("json", "address string, name string, confidence int")
    return rows.select("binary_id", "address", back.alias("j")).select("binary_id", "address", "j.name", "j.confidence", parsing.address(F.col("j.address")).alias("read_address"))


def k2_source_order(spark: SparkSession, sf: str) -> DataFrame:
    """Finished results with the rank of their section; unknown sections come last."""
    order = ["crypto", "networking", "io", "memory", "string", "math", "init", "cleanup", "handler", "parser", "utility"]  # fixed values
    label = review.class_label(F.col("classification"))
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), label)
    good = b.latest_results(spark, sf).where(review.usable())
    return good.select("binary_id", "address", F.when(rank > 0, rank - 1).otherwise(len(order)).cast("int").alias("section_rank"))


def s16_c_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions in all documents: lang is null or wrong for some of the C sources."""
    docs = table(spark, sf, "documents").where(F.col("text").contains("{") & F.col("text").contains("("))
    return docs_io.c_functions(docs, "doc_id", "text").select("doc_id", "name", "signature")


def t2_stream_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of events, folded by a stream over the file."""
    got = folds.drain(spark, sf, folds.hourly_counts, table(spark, sf, "events").schema, "events*.parquet")
    return got.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.col("total").cast("double").alias("total"))


def t3_user_state(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last event and number of events."""
    return folds.latest_state(table(spark, sf, "events"), "user_id", "ts", ["event_type"]).select("user_id", "event_type", "n_events")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:1] in "acdfgjklstwx" and k[1:2].isdigit()}

_CONTROL = ", ".join(f"'{x}'" for x in docs_io.CONTROL)
_F = "f AS (SELECT DISTINCT ON (binary_id, address) * FROM function_info)"
_R = "r AS (SELECT DISTINCT ON (result_id) * FROM results)"
_L = _R + """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY binary_id, address
    ORDER BY coalesce(refined, false) DESC, made_at DESC NULLS LAST, result_id DESC) AS rn FROM r) WHERE rn = 1)"""
_P = "q AS (SELECT DISTINCT ON (response_id) * FROM responses)"
_E = "e AS (SELECT DISTINCT ON (edge_id) * REPLACE (upper(trim(ref_type)) AS ref_type) FROM call_edges)"
_LINKS = """nodes AS (SELECT DISTINCT binary_id AS b, address AS v FROM call_graph),
    links AS (SELECT l.* FROM (SELECT binary_id AS b, unnest(callers) AS u, address AS v FROM call_graph
        UNION SELECT binary_id, address, unnest(callees) FROM call_graph) l
        JOIN nodes x ON x.b = l.b AND x.v = l.u JOIN nodes y ON y.b = l.b AND y.v = l.v)"""
_CLASS = "coalesce(nullif(lower(trim(classification)), ''), 'unknown')"
_USABLE = "NOT coalesce(skipped, false) AND coalesce(error, '') = '' AND coalesce(name, '') <> ''"
_GENERIC = "(lower(trim(coalesce(name, ''))) = '' OR regexp_matches(lower(trim(name)), '^({})') OR lower(trim(name)) IN ({}))".format(
    "|".join(names.GENERIC_PREFIXES), ", ".join(f"'{x}'" for x in names.GENERIC_NAMES)
)
_REASON = f"""CASE WHEN coalesce(skipped, false) THEN '' WHEN coalesce(error, '') <> '' THEN CASE WHEN length(error) > 240 THEN left(error, 240) || '…' ELSE error END
        WHEN trim(coalesce(name, '')) = '' THEN 'no name' WHEN {_GENERIC} THEN 'generic name' WHEN coalesce(confidence, 0) < 80 THEN 'low confidence' ELSE '' END"""
_DONE = "NOT coalesce(skipped, false) AND coalesce(error, '') = ''"
_STATS = f"""SELECT binary_id, count(*) FILTER (coalesce(skipped, false)) AS skipped,
    count(*) FILTER (NOT coalesce(skipped, false) AND coalesce(error, '') <> '') AS errors, count(*) FILTER ({_DONE}) AS analyzed,
    count(*) FILTER ({_DONE} AND name IS DISTINCT FROM original_name) AS renamed, count(*) FILTER ({_DONE} AND name IS NOT DISTINCT FROM original_name) AS confirmed,
    count(*) FILTER ({_DONE} AND coalesce(confidence, 0) >= 80) AS high, count(*) FILTER ({_DONE} AND coalesce(confidence, 0) BETWEEN 50 AND 79) AS medium,
    count(*) FILTER ({_DONE} AND coalesce(confidence, 0) < 50) AS low, coalesce(sum(llm_calls) FILTER ({_DONE}), 0)::BIGINT AS llm_calls
    FROM last GROUP BY binary_id"""
_KEYS = """spell AS (SELECT sig_id, name AS s FROM signatures UNION ALL SELECT sig_id, unnest(aliases) FROM signatures),
    keys AS (SELECT lower(ltrim(s, '_')) AS key, max(sig_id) AS sig_id FROM spell WHERE s <> '' GROUP BY 1)"""
_SIG = r"(?s)^\s*(.*?)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\((.*)\)\s*;?\s*$"


def _sig_parts(column: str) -> str:
    inner = f"trim(regexp_extract({column}, '{_SIG}', 3))"
    parts = f"list_filter(list_transform(string_split(regexp_replace({inner}, '\\([^()]*\\)', '', 'g'), ','), lambda p: trim(p)), lambda p: p <> '')"
    real = f"list_filter({parts}, lambda p: p <> '...')"
    return f"""regexp_extract({column}, '{_SIG}', 1) AS return_type, regexp_extract({column}, '{_SIG}', 2) AS pname,
        CASE WHEN {real} = ['void'] THEN 0 ELSE len({real}) END::INT AS n_params, len({parts}) > len({real}) AS variadic, len({parts}) = 0 AS unspecified"""


_HEDGE = "list_filter([{}], lambda h: contains(lower(coalesce(comments, '') || ' ' || coalesce(reasoning, '')), h))[1]".format(", ".join(f"'{h}'" for h in review.HEDGES))
_CANON = "CASE w {} ELSE w END".format(" ".join(f"WHEN '{w}' THEN '{g[0]}'" for g in names.SYNONYMS for w in g))
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(trim(regexp_replace(replace({0}, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'))), '\\s+'), lambda w: w <> '' AND w NOT IN ({1})))"
_NOISE = ", ".join(f"'{w}'" for w in names.NOISE)
_ADDRESS = """CASE WHEN regexp_matches(lower(x), '^0x[0-9a-f]{1,16}$') THEN try_cast(lower(x) AS BIGINT) WHEN regexp_matches(x, '^(0+|[1-9][0-9]{0,18})$') THEN try_cast(x AS BIGINT)
    WHEN regexp_matches(lower(x), '^[0-9a-f]{1,16}$') THEN try_cast('0x' || x AS BIGINT) END"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_DEFINITION = r"(?m)^(?:static[ \t]+)?([A-Za-z_][\w \t*]*[ \t*])(\w+)[ \t]*\(([^(){};]*)\)\s*\{"
_MACHINE = f"regexp_matches(text, {_quoted(code.LOOP)}) AND regexp_matches(text, {_quoted(code.SWITCH)})"
_COUNT = lambda patterns: " + ".join(f"regexp_matches(text, {_quoted(p)})::INT" for p in patterns)
_CASES = f"len(regexp_extract_all(text, {_quoted(code.CASE)}))"
_TECHNIQUES = f"""
    SELECT doc_id, lang, unnest(list_filter([
        CASE WHEN {_MACHINE} AND {_CASES} >= 4 THEN 'control_flow_flattening' END,
        CASE WHEN {_COUNT(code.OPAQUE)} >= 2 THEN 'bogus_control_flow' END,
        CASE WHEN {_COUNT(code.SUBSTITUTED)} >= 2 THEN 'instruction_substitution' END,
        CASE WHEN regexp_matches(text, {_quoted(code.XOR_LOOP)}) OR regexp_matches(text, {_quoted(code.STACK_STRING)}) THEN 'string_encryption' END,
        CASE WHEN {_MACHINE} AND {_CASES} >= 15 AND len(string_split(rtrim(text, chr(10)), chr(10))) > 200 THEN 'vm_protection' END
    ], lambda x: x IS NOT NULL)) AS technique FROM documents WHERE text IS NOT NULL"""
_CRYPTO = ", ".join(
    "CASE WHEN {} >= {} THEN '{}' END".format(" + ".join(f"contains(lower(text), '{c}')::INT" for c in cs), 1 if len(cs) <= 2 else 2, n) for n, cs in code.CRYPTO.items()
)

SQL = {
    "c1_size_class": f"WITH {_F} SELECT binary_id, address, CASE WHEN coalesce(is_thunk, false) THEN 'thunk' WHEN size <= 16 THEN 'trivial' WHEN size <= 64 THEN 'small' WHEN size <= 256 THEN 'medium' WHEN size IS NOT NULL THEN 'large' END AS size_class FROM f",
    "c2_analyzable": f"WITH {_F} SELECT binary_id, address FROM f WHERE {_CLASS} NOT IN ('imported', 'thunk')",
    "a3_class_counts": f"WITH {_F} SELECT {_CLASS} AS classification, count(*) AS n FROM f GROUP BY 1",
    "c4_generic_names": f"WITH {_R} SELECT result_id, {_GENERIC} AS generic FROM r",
    "c6_refine_reason": f"""WITH {_R} SELECT result_id, {_REASON} AS reason FROM r""",
    "a1_stats": f"WITH {_L} {_STATS}",
    "a2_retracted": f"WITH {_L} {_STATS}",
    "a5_duplicate_names": f"""WITH {_L} SELECT binary_id, name, address, n FROM (SELECT binary_id, name, address, count(*) OVER (PARTITION BY binary_id, name) AS n
        FROM (SELECT DISTINCT binary_id, name, address FROM last WHERE {_USABLE})) WHERE n > 1""",
    "j1_signature_match": f"WITH {_R}, {_KEYS} SELECT result_id, sig_id FROM r JOIN keys ON key = lower(ltrim(name, '_'))",
    "j2_answers_of_functions": f"""WITH {_F}, {_P}, body AS (SELECT response_id, binary_id, received_at, regexp_extract(raw, '(?s)[\\[{{].*[\\]}}]') AS t FROM q WHERE address IS NULL),
        j AS (SELECT *, coalesce(try_cast(nullif(t, '') AS JSON), try_cast(nullif(regexp_replace(t, ',(\\s*[}}\\]])', '\\1', 'g'), '') AS JSON)) AS j FROM body),
        items AS (SELECT response_id, binary_id, received_at, i AS pos, CASE WHEN json_type(j) = 'OBJECT' THEN j ELSE json_extract(j, '$[' || i || ']') END AS item
            FROM (SELECT *, unnest(range(CASE json_type(j) WHEN 'ARRAY' THEN json_array_length(j)::BIGINT WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS i FROM j)),
        said AS (SELECT *, trim(json_extract_string(item, '$.address')) AS x FROM items),
        rows AS (SELECT response_id, binary_id, address, received_at, -1 AS pos FROM q WHERE address IS NOT NULL
            UNION ALL SELECT * FROM (SELECT response_id, binary_id, {_ADDRESS} AS address, received_at, pos FROM said) WHERE address <> 0)
        SELECT f.binary_id, f.address, response_id FROM f LEFT JOIN (SELECT binary_id, address, response_id FROM rows
            QUALIFY row_number() OVER (PARTITION BY binary_id, address ORDER BY received_at DESC NULLS LAST, response_id DESC, pos DESC) = 1) r
        ON r.binary_id = f.binary_id AND r.address = f.address""",
    "j4_sites_in_functions": f"""WITH {_F}, {_E} SELECT f.binary_id, f.address, count(*) AS n_sites, min(site_addr) AS first_site
        FROM e JOIN f ON e.binary_id = f.binary_id AND site_addr >= f.address AND site_addr < f.address + f.size GROUP BY ALL""",
    "s6_callees": f"""WITH {_F}, {_E} SELECT DISTINCT e.binary_id, caller, callee FROM e JOIN f ON f.binary_id = e.binary_id AND f.address = callee
        WHERE contains(ref_type, 'CALL') AND caller IS NOT NULL""",
    "j9_graph_nodes": f"""WITH {_F}, {_E}, ends AS (SELECT binary_id, caller AS address FROM e UNION SELECT binary_id, callee FROM e)
        SELECT binary_id, address, 'f' AS kind FROM f UNION ALL SELECT x.binary_id, x.address, 'u' FROM ends x ANTI JOIN f ON f.binary_id = x.binary_id AND f.address = x.address
        WHERE x.address IS NOT NULL AND x.binary_id IS NOT NULL""",
    "g1_degrees": f"""WITH {_LINKS} SELECT b AS binary_id, v AS address, (SELECT count(*) FROM links l WHERE l.b = n.b AND l.v = n.v) AS n_above,
        (SELECT count(*) FROM links l WHERE l.b = n.b AND l.u = n.v) AS n_below FROM nodes n""",
    "g2_closure": f"""WITH RECURSIVE {_LINKS}, c AS (SELECT DISTINCT binary_id AS b, address AS v FROM function_info WHERE is_thunk
        UNION SELECT l.b, l.v FROM c JOIN links l ON l.b = c.b AND l.u = c.v) SELECT b AS binary_id, v AS address FROM c""",
    "g4_chains": f"""WITH RECURSIVE {_LINKS}, one AS (SELECT b, u, v FROM links l WHERE u <> v AND (SELECT count(*) FROM links x WHERE x.b = l.b AND x.v = l.v) = 1
            AND (SELECT count(*) FROM links x WHERE x.b = l.b AND x.u = l.u) = 1),
        c AS (SELECT DISTINCT b, u AS chain, 0 AS pos, u AS node FROM one o WHERE NOT EXISTS (SELECT 1 FROM one x WHERE x.b = o.b AND x.v = o.u)
            UNION ALL SELECT c.b, chain, pos + 1, o.v FROM c JOIN one o ON o.b = c.b AND o.u = c.node)
        SELECT b AS binary_id, chain, pos, node AS address FROM c""",
    "g8_source_edges": f"""WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
        numbered AS (SELECT *, sum((line = '/**')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM lines),
        blocks AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY i) AS text FROM numbered GROUP BY ALL),
        bare AS (SELECT *, regexp_replace(regexp_replace(text, '(?s)^\\s*/\\*.*?\\*/\\s*', ''), '(?s)^\\s*/\\*.*?\\*/\\s*', '') AS rest FROM blocks),
        d AS (SELECT doc_id, block, regexp_extract(text, '@name\\s+(\\S+)', 1) AS name, regexp_extract(text, '@address\\s+(0x[0-9a-fA-F]+)', 1) AS a,
            regexp_extract(rest, '(?s)\\{{(.*)$', 1) AS body FROM bare),
        x AS (SELECT *, try_cast(a AS BIGINT) AS caller FROM d WHERE regexp_matches(a, '^0x[0-9a-fA-F]{{1,16}}$') AND name <> ''),
        known AS (SELECT name, arg_max(caller, (doc_id, block)) AS known FROM x GROUP BY name),
        calls AS (SELECT DISTINCT caller, unnest(regexp_extract_all(body, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS n FROM x)
        SELECT DISTINCT caller, callee FROM (SELECT caller, coalesce(known, CASE WHEN regexp_matches(n, '^(?:thunk_)?FUN_[0-9a-fA-F]{{8}}$') THEN ('0x' || right(n, 8))::BIGINT END) AS callee
            FROM calls LEFT JOIN known ON name = n WHERE n NOT IN ({_CONTROL})) WHERE callee IS NOT NULL""",
    "g10_invalidated": f"""WITH {_LINKS}, ch AS (SELECT DISTINCT binary_id AS b, address AS v FROM results WHERE refined)
        SELECT b AS binary_id, v AS address FROM ch UNION SELECT l.b, l.u FROM links l JOIN ch ON ch.b = l.b AND ch.v = l.v""",
    "l1_queue": _P1 + """, rel AS (SELECT DISTINCT r.b, x.s, y.s AS down FROM reach r JOIN step x ON x.b = r.b AND x.v = r.u JOIN step y ON y.b = r.b AND y.v = r.v),
        high AS (SELECT p.b, p.s, coalesce(max(d.depth), p.depth) - p.depth AS height FROM paths p LEFT JOIN rel ON rel.b = p.b AND rel.s = p.s
            LEFT JOIN paths d ON d.b = rel.b AND d.s = rel.down GROUP BY p.b, p.s, p.depth)
        SELECT s.b AS binary_id, s.v AS address, greatest(height, 0)::INT AS height, greatest(height, 0)::BIGINT * 1000000 + coalesce(f.size, 0) AS priority
        FROM step s JOIN high h ON h.b = s.b AND h.s = s.s JOIN (SELECT DISTINCT ON (binary_id, address) * FROM function_info) f ON f.binary_id = s.b AND f.address = s.v""",
    "w1_name_budget": f"""WITH {_F} SELECT binary_id, address, name, used::BIGINT AS used FROM (SELECT binary_id, address, name,
        sum(length(coalesce(name, '')) + 1) OVER (PARTITION BY binary_id ORDER BY address) AS used FROM f) WHERE used <= {BUDGET}""",
    "w8_top_callees": f"""WITH {_E} SELECT callee, count(*) AS n_callers FROM (SELECT DISTINCT callee, binary_id, caller FROM e
        WHERE callee IS NOT NULL AND caller IS NOT NULL AND binary_id IS NOT NULL) GROUP BY callee ORDER BY n_callers DESC, callee LIMIT 50""",
    "w10_last_answers": f"WITH {_P} SELECT response_id, received_at FROM q ORDER BY received_at DESC NULLS LAST, response_id DESC LIMIT 4000",
    "w11_byte_windows": """WITH d AS (SELECT doc_id, strlen(text)::INT AS n FROM documents WHERE strlen(text) > 0), s AS (
        SELECT doc_id, n, 'inference' AS rule, unnest(range(0, 1 + 256 * ceil(greatest(n - 512, 0) / 256)::BIGINT, 256)) AS start FROM d
        UNION ALL SELECT doc_id, n, 'training', unnest(range(0, 1 + 256 * floor(greatest(n - 512, 0) / 256)::BIGINT, 256)) FROM d)
        SELECT doc_id, start::INT AS start, least(512, n - start)::INT AS length, rule FROM s""",
    "w13_boundaries": """WITH l AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z]', '0', 'gs'), '[A-Z]', '1', 'g'), '[a-z]', '2', 'g'), '12*|[^1]+') AS r FROM documents WHERE text IS NOT NULL),
        x AS (SELECT doc_id, generate_subscripts(r, 1) AS pos, unnest(r) AS run FROM l), y AS (SELECT *, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM x)
        SELECT doc_id, (e - length(run))::BIGINT AS start, e::BIGINT AS stop FROM y WHERE run LIKE '1%'""",
    "a13_class_scores": f"""WITH {_F}, g AS (SELECT binary_id, nullif(lower(trim(classification)), '') AS t, CASE WHEN coalesce(is_thunk, false) THEN 'thunk' WHEN size <= 16 THEN 'trivial' WHEN size <= 64 THEN 'small'
            WHEN size <= 256 THEN 'medium' WHEN size IS NOT NULL THEN 'large' END AS p FROM f), k AS (SELECT * FROM g WHERE t IS NOT NULL),
        l AS (SELECT binary_id, t AS label FROM k UNION SELECT binary_id, p FROM k WHERE p IS NOT NULL),
        c AS (SELECT l.binary_id, label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (p = label AND t <> label) AS fp,
            count(*) FILTER (t = label AND p IS DISTINCT FROM label) AS fn FROM l JOIN k ON k.binary_id = l.binary_id GROUP BY ALL)
        SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
            round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""",
    "t4_calls_per_minute": f"""WITH {_P} SELECT response_id, count(*) OVER (PARTITION BY model ORDER BY received_at
        RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM q WHERE received_at IS NOT NULL""",
    "a8_usage": f"""WITH {_P} SELECT model, count(*) AS calls, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens,
        coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM q GROUP BY model""",
    "f31_limits": """SELECT u.model, coalesce(max_output_tokens, greatest(256, least(8192, capacity_tokens // 8)), 4096)::INT AS max_output
        FROM (SELECT DISTINCT model FROM responses) u LEFT JOIN model_limits m ON m.model = u.model""",
    "f12_confidences": f"""WITH {_P}, x AS (SELECT response_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS said FROM (
        SELECT response_id, regexp_extract_all(raw, '"confidence"\\s*:\\s*"?([^",}}\n]*)', 1) AS s FROM q)),
        v AS (SELECT *, try_cast(trim(rtrim(trim(said), '%')) AS DOUBLE) AS d FROM x)
        SELECT response_id, pos::INT AS pos, CASE WHEN d IS NULL OR isnan(d) THEN 0 ELSE greatest(0, least(100, round_even(CASE WHEN d > 0 AND d < 1 THEN d * 100 ELSE d END, 0))) END::INT AS score FROM v""",
    "f12_addresses": f"""WITH {_P} SELECT response_id, pos::INT AS pos, {_ADDRESS} AS address FROM (SELECT response_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS x FROM (
        SELECT response_id, regexp_extract_all(raw, '"address"\\s*:\\s*"?([0-9a-fA-Fx]+)', 1) AS s FROM q))""",
    "f13_fences": f"""WITH {_P} SELECT response_id, md5(CASE WHEN regexp_matches(raw, '(?s)```[a-zA-Z]*[ \\t]*\\n.*?```') THEN regexp_extract(raw, '(?s)```[a-zA-Z]*[ \\t]*\\n(.*?)\\n?```', 1)
        ELSE trim(raw) END) AS inner_md5 FROM q WHERE raw IS NOT NULL""",
    "f8_signatures": f"""WITH {_R} SELECT result_id, return_type, pname AS name, n_params FROM (SELECT result_id, {_sig_parts("signature")} FROM r
        WHERE regexp_matches(signature, '{_SIG}'))""",
    "f2_negative_literals": "SELECT doc_id, md5(regexp_replace(text, '\\+ -(0x[0-9a-fA-F]+|\\d+)', '- \\1', 'g')) AS text_md5 FROM documents WHERE contains(text, '+ -')",
    "f7_obfuscation": f"SELECT doc_id, technique FROM ({_TECHNIQUES})",
    "c8_verdict": f"""WITH t AS (SELECT DISTINCT doc_id FROM ({_TECHNIQUES})), c AS (SELECT lang, count(t.doc_id) AS flagged, count(*) AS total FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY lang)
        SELECT *, flagged > 0 AND (flagged >= 12 OR flagged >= total * 0.05) AS verdict FROM c""",
    "f26_crypto": f"SELECT doc_id, unnest(list_filter([{_CRYPTO}], lambda x: x IS NOT NULL)) AS algorithm FROM documents WHERE text IS NOT NULL",
    "f28_sha256": "SELECT doc_id, sha256(text) AS sha256, strlen(text)::INT AS n_bytes FROM documents WHERE text IS NOT NULL",
    "a10_globals": """SELECT symbol, count(DISTINCT synth_id) AS n_records, count(*) AS n_uses FROM (SELECT synth_id, unnest(regexp_extract_all(raw, 'DAT_[0-9a-fA-F]+')) AS symbol
        FROM (SELECT DISTINCT ON (synth_id) * FROM synthesis)) GROUP BY symbol HAVING count(DISTINCT synth_id) >= 2""",
    "l9_globals": """WITH j AS (SELECT DISTINCT ON (synth_id) synth_id, binary_id, regexp_extract(raw, '(?s)[\\[{].*[\\]}]')::JSON AS j FROM synthesis),
        g AS (SELECT synth_id, binary_id, CASE WHEN json_exists(j, '$.globals') THEN json_extract(j, '$.globals') ELSE json_extract(j, '$.synthesis.globals') END AS g FROM j),
        m AS (SELECT synth_id, binary_id, g, unnest(json_keys(g)) AS symbol FROM g WHERE json_type(g) = 'OBJECT')
        SELECT binary_id, symbol, arg_min(json_extract_string(g, '$."' || symbol || '"'), synth_id) AS name FROM m GROUP BY ALL""",
    "f20_name_accuracy": f"""WITH {_R}, one AS (SELECT binary_id, address, arg_min(name, result_id) AS p FROM r WHERE {_USABLE} AND NOT coalesce(refined, false) GROUP BY ALL),
        two AS (SELECT binary_id, address, arg_min(name, result_id) AS t FROM r WHERE {_USABLE} AND refined GROUP BY ALL),
        w AS (SELECT one.binary_id, one.address, p, t, {_WORDS.format("p", _NOISE)} AS pw, {_WORDS.format("t", _NOISE)} AS tw FROM one JOIN two ON one.binary_id = two.binary_id AND one.address = two.address),
        h AS (SELECT *, len(list_filter(tw, lambda w: list_contains(list_transform(pw, lambda w: {_CANON}), {_CANON}))) AS hit FROM w)
        SELECT binary_id, address, round(CASE WHEN p = t THEN 1.0 WHEN len(pw) = 0 OR len(tw) = 0 THEN 0.0 WHEN list_sort(pw) = list_sort(tw) THEN 0.9
            WHEN hit = len(tw) THEN 0.8 ELSE 0.7 * hit::DOUBLE / len(tw) END::DOUBLE, 6) AS accuracy FROM h""",
    "a6_unified_structs": """WITH p AS (SELECT DISTINCT ON (proposal_id) * FROM proposals),
        x AS (SELECT binary_id, name, proposal_id, generate_subscripts(fields, 1) AS pos, unnest(fields) AS f FROM p),
        best AS (SELECT binary_id, name, f."offset" AS o, f FROM x WHERE f."offset" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY binary_id, name, f."offset" ORDER BY
            CASE WHEN lower(coalesce(f.data_type, 'undefined')) IN ('undefined', 'undefined4', 'undefined8') THEN 0 ELSE -1 END,
            CASE WHEN regexp_matches(lower(coalesce(f.name, '')), 'field|unk|undefined|pad') THEN 0 ELSE -length(coalesce(f.name, '')) END, proposal_id, pos) = 1),
        z AS (SELECT binary_id, name, coalesce(max(total_size), 0) AS largest FROM p GROUP BY ALL)
        SELECT best.binary_id, best.name, greatest(largest, max(o + coalesce(f.size, 0)) OVER (PARTITION BY best.binary_id, best.name))::INT AS size, o AS "offset",
            f.name AS field, f.data_type, f.size AS field_size FROM best JOIN z ON z.binary_id = best.binary_id AND z.name IS NOT DISTINCT FROM best.name""",
    "d7_conflicts": f"""WITH {_L}, {_KEYS}, good AS (SELECT * FROM last WHERE {_USABLE}),
        own AS (SELECT *, {_sig_parts("signature")} FROM good WHERE regexp_matches(signature, '{_SIG}')),
        known AS (SELECT sig_id, {_sig_parts("signature")} FROM signatures WHERE regexp_matches(signature, '{_SIG}')),
        held AS (SELECT DISTINCT binary_id, name, address FROM good)
        SELECT 'duplicate_name' AS kind, binary_id, address, name AS detail FROM (SELECT *, count(*) OVER (PARTITION BY binary_id, name) AS n FROM held) WHERE n > 1
        UNION ALL SELECT * FROM (SELECT 'known_signature', o.binary_id, o.address, CASE WHEN o.n_params <> k.n_params THEN 'arguments'
            WHEN (replace(o.return_type, ' ', '') = 'void') <> (replace(k.return_type, ' ', '') = 'void') THEN 'return' END AS d
            FROM own o JOIN keys ON key = lower(ltrim(o.name, '_')) JOIN known k ON k.sig_id = keys.sig_id WHERE NOT o.variadic AND NOT k.variadic AND NOT o.unspecified) WHERE d IS NOT NULL
        UNION ALL SELECT 'signature_name', binary_id, address, pname FROM own WHERE pname <> name
        UNION ALL SELECT * FROM (SELECT 'unsupported_confidence', binary_id, address, {_HEDGE} AS h FROM good WHERE confidence >= 80) WHERE h IS NOT NULL""",
    "x16_merged": f"""WITH {_R}, pick AS (SELECT *, coalesce(refined, false) AS ref FROM r),
        one AS (SELECT binary_id, address, ref, sum(coalesce(llm_calls, 0)) AS calls FROM pick GROUP BY ALL),
        top AS (SELECT * FROM pick QUALIFY row_number() OVER (PARTITION BY binary_id, address, ref ORDER BY made_at DESC NULLS LAST, result_id DESC) = 1),
        a AS (SELECT one.*, top.name, top.error FROM one JOIN top USING (binary_id, address, ref))
        SELECT coalesce(o.binary_id, n.binary_id) AS binary_id, coalesce(o.address, n.address) AS address,
            CASE WHEN coalesce(n.name, '') <> '' AND coalesce(n.error, '') = '' THEN n.name ELSE o.name END AS name,
            (coalesce(o.calls, 0) + coalesce(n.calls, 0))::BIGINT AS llm_calls, n.calls IS NOT NULL AS refined
        FROM (SELECT * FROM a WHERE NOT ref) o FULL JOIN (SELECT * FROM a WHERE ref) n ON o.binary_id = n.binary_id AND o.address = n.address""",
    "k7_log_lines": f"""WITH {_R} SELECT result_id, m || CASE WHEN coalesce(error, '') <> '' AND NOT contains(coalesce(name, '') || ' ' || a, error) THEN ': ' || error ELSE '' END AS line
        FROM (SELECT *, coalesce(strftime(made_at, '%Y-%m-%d %H:%M:%S') || ' ', '') || CASE WHEN coalesce(error, '') <> '' THEN 'WARNING' ELSE 'INFO' END || ' result ' || coalesce(name, '') || ' ' || printf('0x%08x', address) AS m,
            printf('0x%08x', address) AS a FROM r WHERE address IS NOT NULL)""",
    "k1_export": f"WITH {_L} SELECT binary_id, address, name, confidence, address AS read_address FROM last WHERE {_DONE}",
    "k2_source_order": f"""WITH {_L} SELECT binary_id, address, coalesce(list_position(['crypto', 'networking', 'io', 'memory', 'string', 'math', 'init', 'cleanup', 'handler', 'parser', 'utility'], {_CLASS}) - 1, 11)::INT AS section_rank
        FROM last WHERE {_USABLE}""",
    "s16_c_functions": f"""WITH m AS (SELECT doc_id, generate_subscripts(n, 1) AS i, unnest(n) AS name, unnest(t) AS ty, unnest(p) AS pa FROM (
            SELECT doc_id, regexp_extract_all(text, '{_DEFINITION}', 2) AS n, regexp_extract_all(text, '{_DEFINITION}', 1) AS t, regexp_extract_all(text, '{_DEFINITION}', 3) AS p FROM documents WHERE text IS NOT NULL))
        SELECT doc_id, name, trim(ty, ' ') || ' ' || name || '(' || trim(pa, ' ') || ')' AS signature FROM m
        WHERE NOT regexp_matches(ty || name, '[ \\t*]\\d\\w*[ \\t*]+\\w') AND name NOT IN ({_CONTROL})""",
    "t2_stream_hours": """SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, sum(value::DECIMAL(20, 4))::DOUBLE AS total FROM events GROUP BY ALL""",
    "t3_user_state": """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_events FROM events GROUP BY user_id""",
}

"""Further queries on functions, calls, results and documents, and their SQL. Names begin with the survey's ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import code, names, parsing
from ferrule.operators import bindings as b
from ferrule.operators import callsites, chunks, hierarchy, nested, ranges, reach, review
from ferrule.plans.general import _NUMBER, _P3, p3_structs
from ferrule.plans.reference import _CANON, _CLASS, _E, _F, _L, _LINKS, _NOISE, _P, _R, _REASON, _USABLE, _WORDS
from ferrule.session import table

SHARED, ALONE, MOST, SLICE = 1200, 2400, 8, 1 << 16
BATCH, NAMES_BUDGET, MARK = 2000, 3000, "\n/* shortened */"
WINDOW, STRIDE, CALLERS, CALLEES = 512, 256, 3, 5
TOP, LISTED, PART = 50, 300, "fun"
TOKENS, CLS, SEP, PAD = 64, 257, 258, 256  # fixed values: length and special ids of byte tokens
CLASSES = ["thunk", *[n for _, n in review.SIZE_CLASSES], "large"]


def s5_callers(spark: SparkSession, sf: str) -> DataFrame:
    """For each called address the functions whose bodies hold a call of it."""
    sites = b.edges(spark, sf).where(F.col("ref_type").contains("CALL") & F.col("callee").isNotNull()).select("binary_id", "callee", "site_addr").distinct()
    inside = ranges.contained(sites, b.functions(spark, sf).select("binary_id", "address", "size"), ["binary_id"], "site_addr", "address", "size")
    return inside.select("binary_id", "callee", F.col("address").alias("caller")).distinct()


def c10_flow(spark: SparkSession, sf: str) -> DataFrame:
    return b.edges(spark, sf).select("edge_id", code.flow(F.col("ref_type")).alias("flow"))


def c11_confidence_class(spark: SparkSession, sf: str) -> DataFrame:
    """Class of each function's last result, `lo` without one."""
    last = b.latest_results(spark, sf).select("binary_id", "address", "confidence")
    known = b.functions(spark, sf).select("binary_id", "address").join(last, ["binary_id", "address"], "left")
    return known.select("binary_id", "address", F.when(F.coalesce("confidence", F.lit(0)) < 40, "lo").when(F.col("confidence") >= 80, "hi").otherwise("md").alias("class"))


def c13_language(spark: SparkSession, sf: str) -> DataFrame:
    """Source language of each binary by its function names: Rust before Go before C++, else C."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    go, rust, cpp = F.col("name").rlike(r"^(runtime\.|main\.main)"), F.col("name").contains("_ZN") & F.col("name").contains("17h"), F.col("name").rlike("^(_ZN|_ZSt|std::)")
    return b.functions(spark, sf).groupBy("binary_id").agg(F.when(has(rust), "Rust").when(has(go), "Go").when(has(cpp), "C++").otherwise("C").alias("language"))


def j6_call_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Results that the bodies of their binary call with other arguments, or for a value, than they declare (D2, D3)."""
    return callsites.call_conflicts(b.latest_results(spark, sf), table(spark, sf, "documents"), "doc_id", "text")


def f11_call_sites(spark: SparkSession, sf: str) -> DataFrame:
    return callsites.call_sites(table(spark, sf, "documents").dropDuplicates(["doc_id"]), "doc_id", "text")


def _used_params(spark: SparkSession, sf: str) -> DataFrame:
    """Each proposal with the ordinal of the parameter that uses it, the first of that name, null where there is none."""
    p = table(spark, sf, "proposals").dropDuplicates(["proposal_id"]).where("used_by_param <> ''").select("proposal_id", "binary_id", "name", "source_function", "used_by_param")
    params = b.functions(spark, sf).select("binary_id", F.col("address").alias("source_function"), F.posexplode("params").alias("pos", "p"))
    first = params.groupBy("binary_id", "source_function", F.col("p.name").alias("used_by_param")).agg(F.min(F.struct("pos", F.col("p.ordinal").alias("o")))["o"].alias("ordinal"))
    return p.join(first, ["binary_id", "source_function", "used_by_param"], "left")


def j8_param_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return _used_params(spark, sf).select("proposal_id", "ordinal")


def x13_struct_users(spark: SparkSession, sf: str) -> DataFrame:
    """The parameters to which each unified struct applies."""
    return _used_params(spark, sf).where("ordinal IS NOT NULL").select("binary_id", "name", "source_function", "ordinal").distinct()


def j10_kept_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals without those of functions that were analysed again."""
    again = b.results(spark, sf).where("refined").select("binary_id", F.col("address").alias("source_function"))
    return table(spark, sf, "proposals").dropDuplicates(["proposal_id"]).join(again, ["binary_id", "source_function"], "left_anti").select("proposal_id")


def a4_edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct callees and calls of each caller."""
    pairs = b.edges(spark, sf).where("caller IS NOT NULL AND callee IS NOT NULL").groupBy("binary_id", "caller", "callee").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("binary_id", "caller").agg(F.count(F.lit(1)).alias("n_callees"), F.sum("n").alias("n_calls"))


def a9_models(spark: SparkSession, sf: str) -> DataFrame:
    """First and refined results of each model, null being a model of its own."""
    again = F.coalesce(F.col("refined"), F.lit(False))
    return b.results(spark, sf).groupBy("model").agg(F.count_if(~again).alias("drafted"), F.count_if(again).alias("refined"))


def a12_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Mean name accuracy of each binary over its refined results; a function without a first name scores 0."""
    r = b.results(spark, sf).where(review.usable())
    pick = lambda cond, n: r.where(cond).groupBy("binary_id", "address").agg(F.min(F.struct("result_id", "name"))["name"].alias(n))
    both = pick("refined", "t").join(pick("NOT coalesce(refined, false)", "p"), ["binary_id", "address"], "left")
    score = F.coalesce(F.round(names.symbol_accuracy(F.col("p"), F.col("t")), 6), F.lit(0.0)).cast("decimal(9,6)")
    return both.groupBy("binary_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(score).cast("double") / F.count(F.lit(1)), 6).alias("score"))


def a14_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the size classes in each binary: the root of all / (classes x own), 1 for a class without functions."""
    counted = b.functions(spark, sf).groupBy("binary_id", review.size_class(F.col("size"), F.col("is_thunk")).alias("label")).agg(F.count(F.lit(1)).alias("n")).where("label IS NOT NULL")
    totals = counted.groupBy("binary_id").agg(F.sum("n").alias("total"))
    every = totals.withColumn("label", F.explode(F.array(*[F.lit(c) for c in CLASSES])))
    weight = F.coalesce(F.round(F.sqrt(F.col("total") / (len(CLASSES) * F.col("n"))), 6), F.lit(1.0))
    return every.join(counted, ["binary_id", "label"], "left").select("binary_id", "label", weight.alias("weight"))


def a15_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Functions, their bytes, windows of 512 bytes and failed results of each binary."""
    windows = F.when(F.col("size") > 512, F.floor((F.col("size") - 512) / 256) + 1).when(F.col("size") > 0, 1).otherwise(0)
    f = b.functions(spark, sf).groupBy("binary_id").agg(F.count(F.lit(1)).alias("functions"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.sum(windows).alias("windows"))
    bad = b.results(spark, sf).where("error <> ''").groupBy("binary_id").agg(F.count(F.lit(1)).alias("errors"))
    return f.join(bad, "binary_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


def a16_in_flight(spark: SparkSession, sf: str) -> DataFrame:
    """For each result how many of its model were made and not yet loaded when it was made."""
    return ranges.in_flight(b.results(spark, sf).select("result_id", "model", "made_at", "loaded_at"), "model", "made_at", "loaded_at", 3600).select("result_id", "in_flight")


def w2_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The functions of each binary in address order put into chunks of a size and a number; larger ones go alone."""
    f = b.functions(spark, sf).select("binary_id", "address", "size")
    return chunks.chunks_with_lanes(f, ["binary_id"], "address", F.col("size"), SHARED, ALONE, SLICE, MOST).select("binary_id", "address", "lane", "segment", "chunk", "place")


def w4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 functions of each binary with most callers (a top-k report), most called first, in groups of a size."""
    calls = b.edges(spark, sf).where("caller IS NOT NULL").select("binary_id", "caller", F.col("callee").alias("address")).distinct()
    n = calls.groupBy("binary_id", "address").agg(F.count(F.lit(1)).alias("n_callers"))
    known = b.functions(spark, sf).select("binary_id", "address", "size").join(n, ["binary_id", "address"])
    top = known.selectExpr("*", "row_number() OVER (PARTITION BY binary_id ORDER BY n_callers DESC, address) AS rank").where(F.col("rank") <= TOP)
    return chunks.next_fit(top, ["binary_id"], "rank", F.coalesce("size", F.lit(0)) + 1, SHARED, SLICE).select("binary_id", "address", "rank", "chunk")


def w5_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Finished results of each binary in address order, batched by characters and number; too long ones are left out."""
    cost = sum((F.length(F.coalesce(c, F.lit(""))) for c in ("name", "signature", "comments", "reasoning")), F.lit(0))
    r = b.latest_results(spark, sf).where(review.usable()).select("binary_id", "address", cost.alias("cost")).where(F.col("cost") <= BATCH)
    return chunks.next_fit(r, ["binary_id"], "address", F.col("cost"), BATCH, SLICE, MOST).select("binary_id", "address", "chunk", "place")


def w6_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten lines of each document."""
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 10), "\n")
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(head).alias("head_md5"))


def w7_known_names(spark: SparkSession, sf: str) -> DataFrame:
    """For each binary the newest names that fit into a budget of characters."""
    r = b.results(spark, sf).where(review.usable() & F.col("binary_id").isNotNull()).select("binary_id", "result_id", "name", (-F.col("result_id")).alias("back"))
    return ranges.within_budget(r, ["binary_id"], "back", F.length("name"), NAMES_BUDGET, SLICE).select("binary_id", "result_id", "name")


def w9_graph_list(spark: SparkSession, sf: str) -> DataFrame:
    """Functions with a word in their name, the 300 with most links first (a top-k report), and how many there are."""
    d = reach.degrees(*hierarchy.call_links(table(spark, sf, "call_graph"))).select(F.col("scope").alias("binary_id"), F.col("node").alias("address"), (F.col("n_above") + F.col("n_below")).alias("degree"))
    named = b.functions(spark, sf).where(F.lower("name").contains(PART)).select("binary_id", "address", "name").join(d, ["binary_id", "address"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return named.withColumn("matches", named.select(F.count(F.lit(1)).alias("n")).scalar()).orderBy(F.desc("degree"), "binary_id", "address").limit(LISTED)


def f29_byte_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Names of functions as byte tokens of a fixed length (joined by blanks), with the number of those that aren't padding."""
    ids = code.byte_tokens(F.col("name"), TOKENS, CLS, SEP, PAD)
    return b.functions(spark, sf).where("name IS NOT NULL").select("binary_id", "address", F.array_join(ids, " ").alias("ids"), F.size(F.filter(ids, lambda x: x != PAD)).alias("n_seen"))


def f30_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Limits that follow from a model's capacity: output, prompt characters and functions in a chunk."""
    m = table(spark, sf, "model_limits").select("model", "capacity_tokens").withColumn("max_output", F.expr("greatest(256, least(8192, capacity_tokens div 8))").cast("int"))
    return m.where("capacity_tokens IS NOT NULL").select(
        "model", "max_output", F.greatest(F.lit(2000), (F.col("capacity_tokens") - F.col("max_output") - 600) * 3).alias("prompt_chars"), F.expr("greatest(1, max_output div 260)").cast("int").alias("chunk")
    )


def f32_shortened(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut to a length of characters with a mark at their end, where they are longer."""
    t = table(spark, sf, "documents").where(F.length("text") > BATCH)
    return t.select("doc_id", F.md5(F.concat(F.substring("text", 1, BATCH - len(MARK)), F.lit(MARK))).alias("text_md5"))


def f36_param_types(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters with their resolved types: pointers by depth, aliases, else a type of the size."""
    p = b.functions(spark, sf).select("binary_id", "address", F.posexplode("params").alias("pos", "p")).where("p IS NOT NULL")
    return p.select("binary_id", "address", "pos", parsing.resolved_type(F.col("p.data_type"), F.col("p.size")).alias("resolved"))


def l9_structs(spark: SparkSession, sf: str) -> DataFrame:
    """The structs of all syntheses merged by binary: the first synthesis, and the first place in it, that has a name wins."""
    found = p3_structs(spark, sf).where("name IS NOT NULL")
    placed = found.join(table(spark, sf, "synthesis").select("synth_id", "binary_id").distinct(), "synth_id")
    first = placed.groupBy("binary_id", "name").agg(F.min(F.struct("synth_id", "pos", "total_size")).alias("s"))
    return first.select("binary_id", "name", F.col("s.synth_id").alias("synth_id"), F.col("s.total_size").alias("total_size"))


def w12_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all bytes of all documents from windows that overlap: a capital opens a word (1), letters go on with it (2).

    A window knows no letters of a word before its first capital, and trusts itself less towards its edges.
    """
    d = table(spark, sf, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    w = ranges.byte_windows(d, "doc_id", "text", WINDOW, STRIDE, slices="bytes")
    signs = F.translate(F.decode("bytes", "iso-8859-1"), "\n", " ")  # one character for each byte
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(signs, "(?s)[^A-Za-z]", "0"), "[A-Z]", "1"), "[a-z]", "2")
    labels = F.regexp_replace(kinds, r"\G[02]", "0")  # all up to the first capital
    sure = F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.least(i, F.col("length") + 1 - i) / F.lit(float(WINDOW)))
    return ranges.merge_votes(w.select("doc_id", "start", labels.alias("labels"), sure.alias("sure")), "doc_id", "start", "labels", "sure", 3, STRIDE).drop("confidences")


def w14_painted(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each function that no later function of its binary covers."""
    return ranges.painted(b.functions(spark, sf).select("binary_id", "address", "size"), ["binary_id"], "address", "size")


def f14_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Name and confidence of each entry of each answer: the items of a list or the one object; JSON that is faulty beyond spare commas has none."""
    answers = nested.parse_answers(b.responses(spark, sf).where("raw IS NOT NULL"), "response_id", "raw", repair=True)
    flat = nested.list_items(answers, "answer", ["record"])
    said = lambda k: F.try_variant_get("value", f"$.{k}", "string")
    return flat.select(F.col("record").alias("response_id"), "pos", said("name").alias("name"), parsing.confidence(said("confidence")).alias("score")).where("name <> ''")


def x1_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """For each function the three callers and five callees with the lowest addresses, as a prompt shows them."""
    _, links = hierarchy.call_links(table(spark, sf, "call_graph"))
    one = lambda own, other, side, n: links.where("above <> below").select(F.col("scope").alias("binary_id"), F.col(own).alias("address"), F.lit(side).alias("side"), F.col(other).alias("neighbour")).selectExpr(
        "*", "row_number() OVER (PARTITION BY binary_id, address ORDER BY neighbour) AS rank").where(F.col("rank") <= n)
    return one("below", "above", "caller", CALLERS).unionByName(one("above", "below", "callee", CALLEES))


def x2_names(spark: SparkSession, sf: str) -> DataFrame:
    """The name to show for each function: its last result's, else its own, else one made of the address."""
    last = b.latest_results(spark, sf).select("binary_id", "address", F.col("name").alias("found"))
    f = b.functions(spark, sf).select("binary_id", "address", "name").join(last, ["binary_id", "address"], "left")
    return f.select("binary_id", "address", F.coalesce(F.nullif("found", F.lit("")), F.nullif("name", F.lit("")), F.format_string("FUN_%08x", "address")).alias("shown"))


def x12_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Functions still to be made again: not refined, with a reason to; those without any result have the reason `never`."""
    last = b.latest_results(spark, sf).withColumn("reason", review.refinement_reason())
    f = b.functions(spark, sf).select("binary_id", "address").join(last.select("binary_id", "address", "refined", "reason"), ["binary_id", "address"], "left")
    why = F.coalesce("reason", F.lit("never"))
    return f.where(~F.coalesce("refined", F.lit(False)) & (why != "")).select("binary_id", "address", why.alias("reason"))


def x14_unapplied(spark: SparkSession, sf: str) -> DataFrame:
    """Results whose signature has still to be applied."""
    return b.results(spark, sf).where("signature <> '' AND NOT coalesce(signature_applied, false) AND NOT coalesce(skipped, false) AND coalesce(error, '') = ''").select("result_id")


def x15_renamed(spark: SparkSession, sf: str) -> DataFrame:
    """Last results with the name that a synthesis of their binary gives them, the first synthesis with one."""
    rows = table(spark, sf, "synthesis").dropDuplicates(["synth_id"])
    maps = nested.find_member(nested.parse_answers(rows, "synth_id", "raw"), "name_refinements")
    named = nested.members(maps, "node", ["record"]).select(F.col("record").alias("synth_id"), parsing.address(F.col("key")).alias("address"), F.try_variant_get("value", "$", "string").alias("new"))
    placed = named.where("address IS NOT NULL AND new <> ''").join(rows.select("synth_id", "binary_id"), "synth_id")
    first = placed.groupBy("binary_id", "address").agg(F.min(F.struct("synth_id", "new"))["new"].alias("new"))
    return b.latest_results(spark, sf).select("binary_id", "address", "name").join(first, ["binary_id", "address"]).select("binary_id", "address", F.col("name").alias("old"), "new")


def x18_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each binary's last results that have a name other than the original, in percent with one decimal."""
    done = review.result_stats(b.latest_results(spark, sf), ["binary_id"])
    return done.select("binary_id", F.when(F.col("analyzed") > 0, F.round(F.col("renamed") * 100 / F.col("analyzed"), 1)).otherwise(0.0).alias("rate"))


def x20_addresses_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """The function that a name means in a binary: the one with the last result."""
    return b.latest_results(spark, sf).where("name <> ''").groupBy("binary_id", "name").agg(F.max(F.struct("result_id", "address"))["address"].alias("address"))


def x30_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in one of two parts, a tenth held out, by a hash of its id: the same on every run and cluster."""
    digit = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 10
    return table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", F.when(digit == 0, "held_out").otherwise("train").alias("part"))


def t3_after_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last event of every type after the user's last signup, which resets the state; all where there is none."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value").where("user_id IS NOT NULL")
    reset = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("reset"))
    at = F.struct("ts", "event_id")
    kept = e.join(reset, "user_id", "left").where(F.col("reset").isNull() | (at > F.col("reset")))
    last = kept.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("l"))
    return last.select("user_id", "event_type", F.col("l.event_id").alias("event_id"), F.col("l.value").alias("value"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:1] in "acfjlstwx" and k[1:2].isdigit()}


def _walk(rows: str, keys: str, budget: int, most: int | None) -> str:
    """WITH parts that put rows(keys, pos, cost) into chunks one after the other."""
    full = f"s.used + r.cost > {budget}" + (f" OR s.n >= {most}" if most else "")
    on = " AND ".join(f"r.{k} = s.{k}" for k in keys.split(", "))
    cols = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""s AS (SELECT {keys}, pos, 0::BIGINT AS chunk, cost::BIGINT AS used, 1::BIGINT AS n FROM {rows} WHERE pos = 1
        UNION ALL SELECT {cols}, r.pos, CASE WHEN {full} THEN s.chunk + 1 ELSE s.chunk END, CASE WHEN {full} THEN r.cost ELSE s.used + r.cost END,
            CASE WHEN {full} THEN 1 ELSE s.n + 1 END FROM s JOIN {rows} r ON {on} AND r.pos = s.pos + 1)"""


_FIRST_TWO = f"""one AS (SELECT binary_id, address, arg_min(name, result_id) AS p FROM r WHERE {_USABLE} AND NOT coalesce(refined, false) GROUP BY ALL),
    two AS (SELECT binary_id, address, arg_min(name, result_id) AS t FROM r WHERE {_USABLE} AND refined GROUP BY ALL)"""
_PARAMS = """pr AS (SELECT DISTINCT ON (proposal_id) * FROM proposals), x AS (SELECT binary_id, address, generate_subscripts(params, 1) AS pos, unnest(params) AS p FROM f),
    o AS (SELECT binary_id, address, p.name AS n, arg_min(p.ordinal, pos) AS ordinal FROM x WHERE p.name IS NOT NULL GROUP BY ALL),
    u AS (SELECT pr.*, ordinal FROM pr LEFT JOIN o ON o.binary_id = pr.binary_id AND o.address = source_function AND n = used_by_param WHERE used_by_param <> '')"""
_SIZE = "CASE WHEN coalesce(is_thunk, false) THEN 'thunk' WHEN size <= 16 THEN 'trivial' WHEN size <= 64 THEN 'small' WHEN size <= 256 THEN 'medium' WHEN size IS NOT NULL THEN 'large' END"
_BASE = "lower(trim(regexp_replace(t, '[* ]+$', '')))"
_ALIAS = "CASE {} {} ELSE CASE WHEN depth > 0 THEN 'undefined8' WHEN size IN (1, 2, 4, 8) THEN 'undefined' || size ELSE 'undefined4' END END".format(
    _BASE, " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in parsing.BUILTIN_TYPES.items())
)
_HEX = """CASE WHEN regexp_matches(lower(k), '^0x[0-9a-f]{1,15}$') THEN lower(k)::BIGINT WHEN regexp_matches(k, '^(0+|[1-9][0-9]{0,17})$') THEN k::BIGINT
    WHEN regexp_matches(lower(k), '^[0-9a-f]{1,15}$') THEN ('0x' || k)::BIGINT END"""

SQL = {
    "s5_callers": f"""WITH {_F}, {_E} SELECT DISTINCT f.binary_id, callee, f.address AS caller FROM e JOIN f ON e.binary_id = f.binary_id AND site_addr >= f.address
        AND site_addr < f.address + f.size WHERE contains(ref_type, 'CALL') AND callee IS NOT NULL""",
    "c10_flow": f"""WITH {_E} SELECT edge_id, CASE WHEN contains(ref_type, 'FALL_THROUGH') THEN 'fall_through' WHEN contains(ref_type, 'CONDITIONAL_JUMP') THEN 'branch'
        WHEN contains(ref_type, 'CALL') THEN 'call' WHEN contains(ref_type, 'COMPUTED') OR contains(ref_type, 'INDIRECT') THEN 'computed' ELSE 'unknown' END AS flow FROM e""",
    "c11_confidence_class": f"""WITH {_F}, {_L} SELECT f.binary_id, f.address, CASE WHEN coalesce(confidence, 0) < 40 THEN 'lo' WHEN confidence >= 80 THEN 'hi' ELSE 'md' END AS class
        FROM f LEFT JOIN last ON last.binary_id = f.binary_id AND last.address = f.address""",
    "c13_language": f"""WITH {_F} SELECT binary_id, CASE WHEN bool_or(contains(name, '_ZN') AND contains(name, '17h')) THEN 'Rust' WHEN bool_or(starts_with(name, 'runtime.') OR starts_with(name, 'main.main')) THEN 'Go'
        WHEN bool_or(starts_with(name, '_ZN') OR starts_with(name, '_ZSt') OR starts_with(name, 'std::')) THEN 'C++' ELSE 'C' END AS language FROM f GROUP BY binary_id""",
    "j8_param_ordinals": f"WITH {_F}, {_PARAMS} SELECT proposal_id, ordinal FROM u",
    "x13_struct_users": f"WITH {_F}, {_PARAMS} SELECT DISTINCT binary_id, name, source_function, ordinal FROM u WHERE ordinal IS NOT NULL",
    "j10_kept_proposals": """SELECT DISTINCT proposal_id FROM proposals p WHERE NOT EXISTS (SELECT 1 FROM results r WHERE refined AND r.binary_id = p.binary_id AND r.address = p.source_function)""",
    "a4_edge_counts": f"WITH {_E} SELECT binary_id, caller, count(DISTINCT callee) AS n_callees, count(*) AS n_calls FROM e WHERE caller IS NOT NULL AND callee IS NOT NULL GROUP BY ALL",
    "a9_models": f"WITH {_R} SELECT model, count(*) FILTER (NOT coalesce(refined, false)) AS drafted, count(*) FILTER (coalesce(refined, false)) AS refined FROM r GROUP BY model",
    "a12_scores": f"""WITH {_R}, {_FIRST_TWO}, w AS (SELECT two.binary_id, p, t, {_WORDS.format("p", _NOISE)} AS pw, {_WORDS.format("t", _NOISE)} AS tw FROM two LEFT JOIN one ON one.binary_id = two.binary_id AND one.address = two.address),
        h AS (SELECT *, len(list_filter(tw, lambda w: list_contains(list_transform(pw, lambda w: {_CANON}), {_CANON}))) AS hit FROM w),
        v AS (SELECT binary_id, coalesce(round(CASE WHEN p IS NULL THEN 0.0 WHEN p = t THEN 1.0 WHEN len(pw) = 0 OR len(tw) = 0 THEN 0.0 WHEN list_sort(pw) = list_sort(tw) THEN 0.9
            WHEN hit = len(tw) THEN 0.8 ELSE 0.7 * hit::DOUBLE / len(tw) END::DOUBLE, 6), 0) AS a FROM h)
        SELECT binary_id, count(*) AS n, round(sum(a::DECIMAL(9, 6))::DOUBLE / count(*), 6) AS score FROM v GROUP BY binary_id""",
    "a14_class_weights": f"""WITH {_F}, c AS (SELECT binary_id, {_SIZE} AS label, count(*) AS n FROM f WHERE size IS NOT NULL OR is_thunk GROUP BY 1, 2), t AS (SELECT binary_id, sum(n) AS total FROM c GROUP BY 1),
        e AS (SELECT binary_id, total, unnest({CLASSES}) AS label FROM t)
        SELECT e.binary_id, e.label, coalesce(round(sqrt(total::DOUBLE / ({len(CLASSES)} * n)), 6), 1.0) AS weight FROM e LEFT JOIN c ON c.binary_id = e.binary_id AND c.label = e.label""",
    "a15_corpus": f"""WITH {_F}, {_R}, bad AS (SELECT binary_id, count(*) AS errors FROM r WHERE error <> '' GROUP BY 1)
        SELECT f.binary_id, count(*) AS functions, coalesce(sum(size), 0)::BIGINT AS bytes, sum(CASE WHEN size > 512 THEN (size - 512) // 256 + 1 WHEN size > 0 THEN 1 ELSE 0 END)::BIGINT AS windows,
            coalesce(any_value(errors), 0) AS errors FROM f LEFT JOIN bad ON bad.binary_id = f.binary_id GROUP BY 1""",
    "a16_in_flight": f"""WITH {_R}, ev AS (SELECT result_id, model, made_at AS t, 1 AS d FROM r WHERE made_at IS NOT NULL AND NOT coalesce(loaded_at <= made_at, false)
            UNION ALL SELECT result_id, model, made_at, 0 FROM r WHERE loaded_at <= made_at UNION ALL SELECT NULL, model, loaded_at, -1 FROM r WHERE loaded_at > made_at)
        SELECT result_id, n AS in_flight FROM (SELECT result_id, (sum(d) OVER (PARTITION BY model ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + CASE WHEN d = 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM ev)
        WHERE result_id IS NOT NULL""",
    "w2_chunks": f"""WITH RECURSIVE {_F}, z AS (SELECT binary_id, address, greatest(coalesce(size, 0), 0) AS cost, CASE WHEN greatest(coalesce(size, 0), 0) <= {SHARED} THEN 'shared' WHEN size <= {ALONE} THEN 'alone' ELSE 'cut' END AS lane FROM f),
        g AS (SELECT *, (sum((lane <> 'shared')::INT) OVER (PARTITION BY binary_id ORDER BY address))::BIGINT AS segment FROM z),
        q AS (SELECT *, row_number() OVER (PARTITION BY binary_id, segment ORDER BY address) AS pos FROM g WHERE lane = 'shared'), {_walk("q", "binary_id, segment", SHARED, MOST)}
        SELECT q.binary_id, address, lane, q.segment, chunk, n - 1 AS place FROM q JOIN s ON s.binary_id = q.binary_id AND s.segment = q.segment AND s.pos = q.pos
        UNION ALL SELECT binary_id, address, lane, segment, 0, 0 FROM g WHERE lane <> 'shared'""",
    "w4_groups": f"""WITH RECURSIVE {_F}, {_E}, n AS (SELECT binary_id, callee AS address, count(DISTINCT caller) AS n_callers FROM e WHERE caller IS NOT NULL GROUP BY ALL),
        k AS (SELECT f.binary_id, f.address, coalesce(size, 0) + 1 AS cost, row_number() OVER (PARTITION BY f.binary_id ORDER BY n_callers DESC, f.address) AS pos FROM f JOIN n ON n.binary_id = f.binary_id AND n.address = f.address),
        q AS (SELECT * FROM k WHERE pos <= {TOP}), {_walk("q", "binary_id", SHARED, None)}
        SELECT q.binary_id, address, q.pos::INT AS rank, chunk FROM q JOIN s ON s.binary_id = q.binary_id AND s.pos = q.pos""",
    "w5_batches": f"""WITH RECURSIVE {_L}, c AS (SELECT binary_id, address, length(coalesce(name, '')) + length(coalesce(signature, '')) + length(coalesce(comments, '')) + length(coalesce(reasoning, '')) AS cost FROM last WHERE {_USABLE}),
        q AS (SELECT *, row_number() OVER (PARTITION BY binary_id ORDER BY address) AS pos FROM c WHERE cost <= {BATCH}), {_walk("q", "binary_id", BATCH, MOST)}
        SELECT q.binary_id, address, chunk, n - 1 AS place FROM q JOIN s ON s.binary_id = q.binary_id AND s.pos = q.pos""",
    "w6_snippets": "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:10], chr(10))) AS head_md5 FROM documents WHERE text IS NOT NULL",
    "w7_known_names": f"""WITH {_R} SELECT binary_id, result_id, name FROM (SELECT *, sum(length(name) + 1) OVER (PARTITION BY binary_id ORDER BY result_id DESC) AS used FROM r WHERE {_USABLE} AND binary_id IS NOT NULL)
        WHERE used <= {NAMES_BUDGET}""",
    "w9_graph_list": f"""WITH {_F}, {_LINKS}, d AS (SELECT b, v, count(*) AS n FROM (SELECT b, v FROM links UNION ALL SELECT b, u FROM links) GROUP BY ALL)
        SELECT f.binary_id, f.address, name, coalesce(n, 0)::BIGINT AS degree, count(*) OVER () AS matches FROM f LEFT JOIN d ON d.b = f.binary_id AND d.v = f.address
        WHERE contains(lower(name), '{PART}') ORDER BY degree DESC, f.binary_id, f.address LIMIT {LISTED}""",
    "f29_byte_tokens": f"""WITH {_F}, h AS (SELECT binary_id, address, hex(encode(name)) AS x FROM f WHERE name IS NOT NULL),
        i AS (SELECT *, [{CLS}] || list_transform(range(0, length(x), 2), lambda k: ('0x' || x[k + 1:k + 2])::INT) || [{SEP}] AS ids FROM h)
        SELECT binary_id, address, array_to_string(list_resize(ids, {TOKENS}, {PAD}), ' ') AS ids, least(len(ids), {TOKENS})::INT AS n_seen FROM i""",
    "f30_limits": """WITH m AS (SELECT model, capacity_tokens AS c, greatest(256, least(8192, capacity_tokens // 8))::INT AS max_output FROM model_limits WHERE capacity_tokens IS NOT NULL)
        SELECT model, max_output, greatest(2000, (c - max_output - 600) * 3)::INT AS prompt_chars, greatest(1, max_output // 260)::INT AS chunk FROM m""",
    "f32_shortened": f"SELECT doc_id, md5(substring(text, 1, {BATCH - len(MARK)}) || chr(10) || '{MARK[1:]}') AS text_md5 FROM documents WHERE length(text) > {BATCH}",
    "f36_param_types": f"""WITH {_F}, x AS (SELECT binary_id, address, generate_subscripts(params, 1) - 1 AS pos, unnest(params) AS p FROM f),
        y AS (SELECT binary_id, address, pos::INT AS pos, trim(coalesce(p.data_type, '')) AS t, p.size AS size, length(regexp_replace(regexp_extract(trim(coalesce(p.data_type, '')), '[* ]+$'), ' ', '', 'g')) AS depth FROM x WHERE p IS NOT NULL)
        SELECT binary_id, address, pos, ({_ALIAS}) || repeat('*', depth) AS resolved FROM y""",
    "l9_structs": _P3 + f""", t AS (SELECT synth_id, pos, json_extract_string(item, '$.name') AS name, {_NUMBER.format("ts")} AS total_size FROM got WHERE level = 0),
        m AS (SELECT binary_id, name, min(t.synth_id) AS synth_id, arg_min(coalesce(total_size, -1), (t.synth_id, pos)) AS z FROM t JOIN (SELECT DISTINCT synth_id, binary_id FROM synthesis) s ON s.synth_id = t.synth_id WHERE name IS NOT NULL GROUP BY 1, 2)
        SELECT binary_id, name, synth_id, nullif(z, -1) AS total_size FROM m""",
    "w12_votes": f"""WITH h AS (SELECT DISTINCT ON (doc_id) doc_id, hex(encode(text)) AS h, strlen(text)::INT AS n FROM documents WHERE strlen(text) > 0),
        w AS (SELECT doc_id, h, n, unnest(range(0, 1 + {STRIDE} * ceil(greatest(n - {WINDOW}, 0) / {STRIDE})::BIGINT, {STRIDE})) AS start FROM h),
        c AS (SELECT doc_id, start, least({WINDOW}, n - start) AS len, unnest(range(0, least({WINDOW}, n - start))) AS i, h[2 * (start + i) + 1:2 * (start + i) + 2] AS x FROM w),
        k AS (SELECT *, min(CASE WHEN x BETWEEN '41' AND '5A' THEN i END) OVER (PARTITION BY doc_id, start) AS first FROM c),
        v AS (SELECT doc_id, start + i AS p, CASE WHEN x BETWEEN '41' AND '5A' THEN 1 WHEN x BETWEEN '61' AND '7A' AND i > first THEN 2 ELSE 0 END AS l, least(i + 1, len - i) / {WINDOW}.0 AS c FROM k),
        t AS (SELECT doc_id, p, l, sum(c) AS c FROM v GROUP BY ALL), best AS (SELECT doc_id, p, arg_max(l, (c, l)) AS l FROM t GROUP BY ALL)
        SELECT doc_id, (p // {STRIDE} * {STRIDE})::INT AS start, string_agg(l::VARCHAR, '' ORDER BY p) AS labels FROM best GROUP BY 1, 2""",
    "w14_painted": f"""WITH {_F}, e AS (SELECT binary_id, address, unnest(range(address, address + size)) AS b FROM f WHERE size > 0), l AS (SELECT binary_id, b, max(address) AS address FROM e GROUP BY ALL)
        SELECT binary_id, address, count(*) AS n_bytes FROM l GROUP BY ALL""",
    "f14_entries": f"""WITH {_P}, j AS (SELECT response_id, coalesce(try_cast(raw AS JSON), try_cast(nullif(regexp_extract(raw, '(?s)[\\[{{].*[\\]}}]'), '') AS JSON)) AS j FROM q WHERE raw IS NOT NULL),
        o AS (SELECT response_id, CASE json_type(j) WHEN 'OBJECT' THEN [j] WHEN 'ARRAY' THEN json_extract(j, '$[*]') END AS l FROM j),
        e AS (SELECT response_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS e FROM o), v AS (SELECT response_id, pos, json_extract_string(e, '$.name') AS name, json_extract_string(e, '$.confidence') AS said FROM e),
        d AS (SELECT *, try_cast(trim(rtrim(trim(said), '%')) AS DOUBLE) AS d FROM v)
        SELECT response_id, pos::INT AS pos, name, CASE WHEN d IS NULL OR isnan(d) THEN 0 ELSE greatest(0, least(100, round_even(CASE WHEN d > 0 AND d < 1 THEN d * 100 ELSE d END, 0))) END::INT AS score FROM d WHERE name <> ''""",
    "x1_neighbours": f"""WITH {_LINKS} SELECT b AS binary_id, v AS address, 'caller' AS side, u AS neighbour, row_number() OVER (PARTITION BY b, v ORDER BY u)::INT AS rank FROM links WHERE u <> v QUALIFY rank <= {CALLERS}
        UNION ALL SELECT b, u, 'callee', v, row_number() OVER (PARTITION BY b, u ORDER BY v)::INT AS rank FROM links WHERE u <> v QUALIFY rank <= {CALLEES}""",
    "x2_names": f"""WITH {_F}, {_L} SELECT f.binary_id, f.address, coalesce(nullif(last.name, ''), nullif(f.name, ''), printf('FUN_%08x', f.address)) AS shown FROM f LEFT JOIN last ON last.binary_id = f.binary_id AND last.address = f.address""",
    "x12_pending": f"""WITH {_F}, {_L}, w AS (SELECT f.binary_id, f.address, refined, CASE WHEN result_id IS NULL THEN 'never' ELSE {_REASON} END AS reason
        FROM (SELECT binary_id, address FROM f) f LEFT JOIN (SELECT result_id, binary_id AS b, address AS a, name, error, skipped, confidence, refined FROM last) l ON b = f.binary_id AND a = f.address) SELECT binary_id, address, reason FROM w WHERE NOT coalesce(refined, false) AND reason <> ''""",
    "x14_unapplied": f"WITH {_R} SELECT result_id FROM r WHERE signature <> '' AND NOT coalesce(signature_applied, false) AND NOT coalesce(skipped, false) AND coalesce(error, '') = ''",
    "x15_renamed": f"""WITH {_L}, j AS (SELECT DISTINCT ON (synth_id) synth_id, binary_id, regexp_extract(raw, '(?s)[\\[{{].*[\\]}}]')::JSON AS j FROM synthesis),
        g AS (SELECT synth_id, binary_id, CASE WHEN json_exists(j, '$.name_refinements') THEN json_extract(j, '$.name_refinements') ELSE json_extract(j, '$.synthesis.name_refinements') END AS g FROM j),
        m AS (SELECT synth_id, binary_id, g, unnest(json_keys(g)) AS k FROM g WHERE json_type(g) = 'OBJECT'),
        a AS (SELECT binary_id, {_HEX} AS address, arg_min(json_extract_string(g, '$."' || k || '"'), synth_id) AS new FROM m WHERE json_extract_string(g, '$."' || k || '"') <> '' GROUP BY ALL)
        SELECT last.binary_id, last.address, name AS old, new FROM last JOIN a ON a.binary_id = last.binary_id AND a.address = last.address""",
    "x18_rates": f"""WITH {_L}, d AS (SELECT binary_id, count(*) FILTER (NOT coalesce(skipped, false) AND coalesce(error, '') = '') AS n,
            count(*) FILTER (NOT coalesce(skipped, false) AND coalesce(error, '') = '' AND name IS DISTINCT FROM original_name) AS k FROM last GROUP BY 1)
        SELECT binary_id, CASE WHEN n > 0 THEN round(k * 100 / n, 1) ELSE 0 END::DOUBLE AS rate FROM d""",
    "x20_addresses_by_name": f"WITH {_L} SELECT binary_id, name, arg_max(address, result_id) AS address FROM last WHERE name <> '' GROUP BY ALL",
    "x30_split": "SELECT doc_id, CASE WHEN ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % 10 = 0 THEN 'held_out' ELSE 'train' END AS part FROM documents WHERE doc_id IS NOT NULL",
    "t3_after_reset": """WITH z AS (SELECT user_id, max((ts, event_id)) AS z FROM events WHERE event_type = 'signup' GROUP BY 1)
        SELECT e.user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events e LEFT JOIN z ON z.user_id = e.user_id
        WHERE (z IS NULL OR (ts, event_id) > z) AND e.user_id IS NOT NULL GROUP BY ALL""",
}

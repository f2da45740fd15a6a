"""Classification of functions and results, statistics, and checks of results against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import names, parsing
from ferrule.operators import nested
from ferrule.session import cut

# fixed values: limits of size classes, marks of doubt
SIZE_CLASSES = [(16, "trivial"), (64, "small"), (256, "medium")]
HEDGES = [
    "cannot determine", "could not determine", "unable to determine", "cannot tell", "hard to tell", "unclear", "not clear", "no clear",
    "unknown purpose", "purpose is unknown", "insufficient evidence", "no evidence", "too obfuscated", "speculative", "wild guess", "just a guess",
]
KINDS = ["duplicate_name", "argument_count", "return_value", "known_signature", "signature_name", "unsupported_confidence"]


def size_class(size: Column, is_thunk: Column) -> Column:
    """thunk, else trivial, small, medium or large by size; null size gives null."""
    out = F.when(F.coalesce(is_thunk, F.lit(False)), "thunk")
    for limit, name in SIZE_CLASSES:
        out = out.when(size <= limit, name)
    return out.when(size.isNotNull(), "large")


def class_label(classification: Column) -> Column:
    """Lower case; null and blank are `unknown`."""
    return F.coalesce(F.nullif(F.lower(F.trim(classification)), F.lit("")), F.lit("unknown"))


def refinement_reason(threshold: int = 80, longest: int = 240) -> Column:
    """Why a result should be made again, the empty text if it shouldn't: error, no name, generic name, low confidence."""
    error = F.col("error")
    shown = F.when(F.length(error) > longest, F.concat(F.substring(error, 1, longest), F.lit("…"))).otherwise(error)
    return (
        F.when(F.coalesce("skipped", F.lit(False)), "")
        .when(F.coalesce(error, F.lit("")) != "", shown)
        .when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name")
        .when(names.is_generic(F.col("name")), "generic name")
        .when(F.coalesce("confidence", F.lit(0)) < threshold, "low confidence")
        .otherwise("")
    )


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def result_measures(high: int = 80, medium: int = 50) -> dict[str, Column]:
    """0/1 measures of one result, each row in exactly one of skipped, errors and analyzed."""
    skipped = F.coalesce("skipped", F.lit(False))
    failed = ~skipped & (F.coalesce("error", F.lit("")) != "")
    done = ~skipped & ~failed
    renamed = ~F.col("name").eqNullSafe(F.col("original_name"))
    conf = F.coalesce("confidence", F.lit(0))
    return {
        "skipped": _is(skipped), "errors": _is(failed), "analyzed": _is(done), "renamed": _is(done & renamed), "confirmed": _is(done & ~renamed),
        "high": _is(done & (conf >= high)), "medium": _is(done & (conf >= medium) & (conf < high)), "low": _is(done & (conf < medium)),
        "llm_calls": F.when(done, F.coalesce("llm_calls", F.lit(0))).otherwise(0),
    }


def result_stats(results: DataFrame, keys: list[str], sign: Column | None = None) -> DataFrame:
    """Sums of the measures; with a sign column of +1 and -1 the aggregate takes replaced results back."""
    weight = F.lit(1) if sign is None else sign
    return results.groupBy(*keys).agg(*[F.sum(m * weight).alias(n) for n, m in result_measures().items()])


def usable() -> Column:
    return ~F.coalesce("skipped", F.lit(False)) & (F.coalesce("error", F.lit("")) == "") & (F.coalesce("name", F.lit("")) != "")


def duplicate_names(results: DataFrame) -> DataFrame:
    """(binary_id, name, address) of usable results whose name another one of the binary has too.

    One row each: a name that many functions share isn't gathered into one list.
    """
    held = results.where(usable()).select("binary_id", "name", "address").distinct()
    shared = held.groupBy("binary_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return held.join(shared, ["binary_id", "name"])


def signature_keys(signatures: DataFrame) -> DataFrame:
    """(key, sig_id) of every spelling of every signature; the last signature wins a spelling."""
    spelled = signatures.select("sig_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelling"))
    return spelled.where("spelling IS NOT NULL AND spelling <> ''").groupBy(names.match_key(F.col("spelling")).alias("key")).agg(F.max("sig_id").alias("sig_id"))


def match_signatures(results: DataFrame, signatures: DataFrame) -> DataFrame:
    """results with the sig_id whose name or alias theirs is; the planner broadcasts the signatures if they are small."""
    return results.withColumn("key", names.match_key(F.col("name"))).join(signature_keys(signatures), "key").drop("key")


def conflicts(results: DataFrame, signatures: DataFrame) -> DataFrame:
    """(kind, binary_id, address, detail): results that contradict each other, their own text or a known signature."""
    good = results.where(usable())
    own = good.withColumn("s", parsing.signature(F.col("signature")))
    known = signatures.select("sig_id", parsing.signature(F.col("signature")).alias("k"))
    against = match_signatures(own, signatures).join(known, "sig_id").where("NOT s.variadic AND NOT k.variadic AND NOT s.unspecified")
    void = lambda c: F.regexp_replace(F.col(f"{c}.return_type"), " ", "") == "void"
    prose = F.lower(F.concat_ws(" ", F.coalesce("comments", F.lit("")), F.coalesce("reasoning", F.lit(""))))
    hedge = F.get(F.filter(F.array(*[F.lit(h) for h in HEDGES]), lambda h: F.instr(prose, h) > 0), F.lit(0))
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "binary_id", "address", detail.alias("detail"))
    found = [
        row(duplicate_names(results), "duplicate_name", F.col("name")),
        row(
            against.withColumn("d", F.when(F.col("s.n_params") != F.col("k.n_params"), "arguments").when(void("s") != void("k"), "return")).where("d IS NOT NULL"),
            "known_signature", F.col("d"),
        ),
        row(own.where("s.name <> name"), "signature_name", F.col("s.name")),
        row(good.where("confidence >= 80").withColumn("h", hedge).where("h IS NOT NULL"), "unsupported_confidence", F.col("h")),
    ]
    return reduce(DataFrame.unionByName, found)


def unify_structs(proposals: DataFrame) -> DataFrame:
    """(binary_id, name, size, offset, field, data_type, field_size): one row for each field of each unified struct.

    Proposals of one name in a binary are one struct. At each offset the most specific type wins, then the most
    telling name, then the earliest proposal. The size covers the largest proposal and the last chosen field.
    """
    p = proposals.dropDuplicates(["proposal_id"])
    f = p.select("binary_id", "name", "proposal_id", F.posexplode("fields").alias("pos", "f")).where("f.offset IS NOT NULL")
    # fixed values: vague types and names
    vague_type = F.lower(F.coalesce("f.data_type", F.lit("undefined"))).isin("undefined", "undefined4", "undefined8")
    low = F.lower(F.coalesce("f.name", F.lit("")))
    vague_name = low.rlike("field|unk|undefined|pad")
    rank = F.struct(
        F.when(vague_type, 0).otherwise(-1).alias("t"), F.when(vague_name, 0).otherwise(-F.length(low)).alias("n"), "proposal_id", "pos",
        F.col("f.name").alias("field"), F.col("f.data_type").alias("data_type"), F.col("f.size").alias("field_size"),
    )
    best = f.groupBy("binary_id", "name", F.col("f.offset").alias("offset")).agg(F.min(rank).alias("b"))
    ends = best.groupBy("binary_id", "name").agg(F.max(F.col("offset") + F.coalesce("b.field_size", F.lit(0))).alias("end"))
    sizes = p.groupBy("binary_id", "name").agg(F.coalesce(F.max("total_size"), F.lit(0)).alias("largest"))
    return (
        best.join(ends, ["binary_id", "name"])
        .join(sizes, ["binary_id", "name"])
        .select("binary_id", "name", F.greatest("largest", "end").alias("size"), "offset", "b.field", "b.data_type", "b.field_size")
    )


def answers_by_address(responses: DataFrame) -> DataFrame:
    """(binary_id, address, response_id, pos): the last answer that each function has, by time, response and place in it.

    An answer to a prompt with an address of its own is that function's, at pos -1, whatever it states: the prompt held one
    function. Otherwise each entry, an item of a list or the one object, answers the function whose address it states;
    0 is no address. Entries are read as in `nested.list_items`, faulty JSON beyond spare commas has none.
    """
    keys = ["response_id", "binary_id", "address", "received_at"]
    prompts = cut(responses.select(*keys, "raw"))
    several = nested.parse_answers(prompts.where("address IS NULL AND raw IS NOT NULL"), "response_id", "raw", repair=True)
    entries = nested.list_items(several, "answer", ["record"])
    stated = entries.select(F.col("record").alias("response_id"), "pos", parsing.address(F.try_variant_get("value", "$.address", "string")).alias("address")).where("address <> 0")
    own = prompts.where("address IS NOT NULL").select(*keys, F.lit(-1).alias("pos"))
    rows = own.unionByName(stated.join(prompts.select("response_id", "binary_id", "received_at"), "response_id"))
    last = F.max(F.struct("received_at", "response_id", "pos")).alias("last")
    return rows.groupBy("binary_id", "address").agg(last).select("binary_id", "address", "last.response_id", "last.pos")

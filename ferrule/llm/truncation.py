"""Texts that lost their end, found by a self-join on hashed prefixes.

Texts are read as tokens. Every place in every text gives the hash of all tokens up to it, and hashes of the last few
tokens up to it, with the token that follows (or the end): what a prefix is known to continue with elsewhere. The ends of
the values that may be cut are joined to that table. A value is cut

* where it is, as a whole, a prefix of longer texts and hardly any text ends there,
* else where the texts that share its last tokens (the longest such prefix that enough of them have) go on and hardly ever end there,
* or where its last word is a strict prefix of the words that stand at this place elsewhere.

Without such evidence a value is no case. For JSON answers an exact check confirms it: their brackets must be open. (Both
must hold, so values with closed brackets are left out before the join.)

Names, numbers and words that can stand in for each other are one token in a prefix, so that copies which differ in
them alone count as copies. Which words these are is counted in the corpus: a word is kept if it makes up at least
one in `1 / KEPT_SHARE` of all tokens and few different words follow it; the list is bounded by that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut, cut_counting, ship

#: At most 1 / KEPT_SHARE words are kept as they are; a word with more than MANY_FOLLOWERS (effective number) isn't.
KEPT_SHARE, MANY_FOLLOWERS = 1e-5, 8.0
#: Numbers of tokens in a hashed prefix, the longest first; such a prefix counts if SEEN other places have it. A prefix from the
#: text's start on has the number WHOLE; it is longer than the others, and for JSON one longer copy is enough if none ends there.
LENGTHS, SEEN, WHOLE = (6, 4, 3, 2, 1), 4, 99
#: A place is an end if at least this share of the same places elsewhere is one (JSON: that share of all texts ends, whose
#: brackets are checked too); a word is cut if longer words outnumber it so often.
END_SHARE, JSON_END_SHARE, LONGER_RATIO = 0.05, 0.5, 5
#: Size limit of the filter that keeps prefixes nobody asks for from the shuffle: 32 MB. A full one only filters less.
FILTER_BITS = 1 << 28
#: Tokens that are hashed at once in a task.
SLICE = 1 << 20

_UP, _LOW = "A-ZÀ-ÞА-Я", "a-zß-ÿа-яё"
TOKEN = rf"[{_LOW}]++|0x[0-9a-fA-F]*+|[0-9][0-9a-fA-F]*(?!\p{{L}})|[{_UP}]+(?![{_LOW}])|[{_UP}][{_LOW}]++|\p{{L}}|\S"
STOPS = ".!?。！？…"
#: Tokens without a hash of their own; hashes of words are odd, all others even.
END, STOP, ANY_WORD = 0, 2, 4
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def tokens(text: Column) -> Column:
    """Words (camel case split), numbers, punctuation."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_hashes(words: Column) -> Column:
    """A long for each token; all numbers are one token, all marks at the end of a sentence too."""
    h = F.xxhash64
    starts = lambda w, low, high: (w >= low) & (w < high)
    is_word = lambda w: starts(w, "a", "{") | starts(w, "A", "[") | ((w >= "\u0080") & w.rlike(r"^\p{L}"))
    return F.transform(
        words,
        lambda w: F.when(is_word(w), h(w).bitwiseOR(F.lit(1)))
        .when(starts(w, "0", ":"), h(F.lit("0")).bitwiseAND(F.lit(-2)))
        .when(w.isin(*STOPS), F.lit(STOP).cast("bigint"))
        .otherwise(h(w).bitwiseAND(F.lit(-2))),
    )


def unmarked(text: str) -> str:
    """The text without the marks that may follow a cut (fences, dots of omission, a note in brackets of any length) and the blanks
    before them; a text without marks as it is."""
    at = len(text)
    while True:
        end = at
        while end and text[end - 1].isspace():
            end -= 1
        mark = next((m for m in ("```", "…", "...") if text.endswith(m, 0, end)), None)
        if mark:
            at = end - len(mark)
        elif text.endswith("]", 0, end):
            start = text.rfind("[", 0, end)
            note = text[start + 1 : end - 1]
            if start < 0 or not note or any(c in note for c in ']{}":,'):
                break
            at = start
        else:
            break
    return text if at == len(text) else text[:end]


def open_brackets(text: Column) -> Column:
    """Whether JSON begins in the text and isn't closed at its end; null if none begins. Other faults don't matter.

    All but quotes and brackets is dropped in one pass, then the quoted stretches.
    """
    signs = F.regexp_replace(F.regexp_extract(text, r"(?s)[\[{].*", 0), r'(?s)\\.|[^"\\\[\]{}]++', "")
    n = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    judged = lambda x: F.when(x != "", x.contains('"') | (n(x, "[{") > n(x, "]}")))
    return F.transform(F.array(signs), lambda x: F.when(x != "", F.coalesce(judged(F.regexp_replace(x, '"[^"]*"', "")), F.lit(False))))[0]


def ending(text: str, structured: bool, still: bool | None = None) -> tuple[str, str] | None:
    """(kind, what stands before the marks of a cut) of a value that may be cut, None for one that ends well.

    Kinds: `json`, brackets are open (`still`, from `open_brackets`); `prose`, the last sentence has no mark at its end.
    """
    core = unmarked(text)
    if structured and still is not None:
        if still:
            return "json", core.rstrip()
        core = core[max(core.rfind("]"), core.rfind("}")) + 1 :]
        if not any(c.isalpha() for c in core):
            return None
    if not core.strip():
        return ("prose", text) if text.strip() and not structured else None
    marked = len(core) < len(text.rstrip()) and not text.rstrip().endswith("```")
    return None if core.rstrip()[-1] in STOPS and not marked else ("prose", core)


def _prefixes(h: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, where it is one, hash) of the prefixes that end with each position, by differences of one running sum.

    `place` counts within each text; a prefix is the WHOLE text up to there or its last tokens.
    """
    n = len(h)
    power, back = np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, _BACK, np.uint64))
    total = np.append(np.uint64(0), np.cumsum(h * power))
    at = np.arange(n)
    begin = at - place
    whole = (total[1:] - total[begin]) * back[begin] ^ place.astype(np.uint64)
    for length in (WHOLE, *LENGTHS):
        if length == WHOLE:
            out, ok = whole, place >= LENGTHS[0]
        else:
            out, ok = (total[1:] - total[np.maximum(at + 1 - length, 0)]) * back ^ np.uint64(length), place >= length - 1
        out = out * _MIX
        yield length, ok, out ^ (out >> np.uint64(29))


def _skeleton(h: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Hashes as unsigned numbers, those of words that aren't kept all alike."""
    return np.where((h & 1 == 1) & ~np.isin(h, kept), ANY_WORD, h).view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, place in the text) of whole texts, about SLICE tokens at a time."""
    for batch in batches:
        lists = batch.column(0)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lengths)
        low = 0
        while low < len(lengths):
            start = int(ends[low] - lengths[low])
            high = max(low + 1, int(np.searchsorted(ends, start + SLICE, "right")))
            part = lengths[low:high]
            if part.sum():
                place = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                yield flat[start : int(ends[high - 1])], place
            low = high


def _counted(a: np.ndarray, b: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """How often each pair comes, as a batch of three columns."""
    mixed = (a.view(np.uint64) * _MIX) ^ (b.view(np.uint64) * _BASE)
    _, first, n = np.unique(mixed, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(n.astype(np.int64))], names=names)


def _following(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    after = np.append(h[1:], END)
    after[np.append(place[1:] == 0, True)] = END
    return after


def value_id(field: str, value: str) -> Column:
    return F.md5(F.concat_ws("\u0001", field, value))


def token_table(values: DataFrame, structured: tuple[str, ...]) -> DataFrame:
    """(vid, field, value, still, words, h) of the distinct non-blank values; copies count once everywhere.

    The only place at which whole texts are shuffled, and the only one at which they are cut into tokens.
    """
    once = values.where(F.col("value").rlike(r"\S")).select(value_id("field", "value").alias("vid"), "field", "value").distinct()
    read = once.select("vid", "field", "value", F.when(F.col("field").isin(*structured), open_brackets(F.col("value"))).alias("still"), tokens(F.col("value")).alias("words"))
    return cut(read.withColumn("h", token_hashes(F.col("words"))))


def kept_words(texts: DataFrame) -> np.ndarray:
    """Hashes of the words that prefixes keep: at most 1 / KEPT_SHARE of them, so their list has a proven bound."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, place in _slices(batches):
            yield _counted(h, _following(h, place), ["w", "f", "n"])

    followed = texts.select("h").mapInArrow(pairs, "w bigint, f bigint, n bigint").groupBy("w", "f").agg(F.sum("n").alias("n"))
    words = cut(followed.groupBy("w").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn")))
    total = words.agg(F.sum("n")).first()[0] or 0
    followers = F.exp(F.log("n") - F.col("nlogn") / F.col("n"))
    rows = words.where((F.col("n") >= KEPT_SHARE * total) & (followers < MANY_FOLLOWERS)).select("w").limit(int(1 / KEPT_SHARE)).collect()
    return np.sort(np.array([r.w for r in rows], np.int64))


def tails(texts: DataFrame, kept: np.ndarray, structured: tuple[str, ...]) -> DataFrame:
    """(vid, kind, length, ctx, before, word): the last tokens of the values that may be cut.

    `ctx` ends with the last token, `before` just ahead of it; `word` is the last token if it may be part of a longer one.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for vid, field, value, still in zip(batch["vid"], batch["field"], batch["value"], batch["still"]):
                found = ending(value, field in structured, still)
                if found:
                    rows.append((vid, *found))
            yield pd.DataFrame(rows, columns=["vid", "kind", "core"])

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for vid, kind, word, h in zip(batch["vid"], batch["kind"], batch["word"], batch["h"]):
                n = len(h)
                for length, ok, hashes in _prefixes(_skeleton(np.asarray(h, np.int64), kept), np.arange(n)):
                    if ok[-1]:
                        signed = hashes.view(np.int64)
                        ahead = length != WHOLE and n > length
                        rows.append((vid, kind, length, int(signed[-1]), int(signed[-2]) if ahead else 0, word if ahead else None))
            yield pd.DataFrame(rows, columns=["vid", "kind", "length", "ctx", "before", "word"])

    words = tokens(F.col("core"))
    cores = texts.select("vid", "field", "value", "still").mapInPandas(ends, "vid string, kind string, core string").withColumn("words", words)
    word = F.try_element_at("words", F.lit(-1))
    held = cores.select("vid", "kind", F.when(word.rlike(r"^\p{L}") & F.col("core").rlike(r"\S\z"), word).alias("word"), token_hashes(F.col("words")).alias("h"))
    return held.where(F.size("h") > 0).mapInPandas(last, "vid string, kind string, length int, ctx bigint, before bigint, word string")


def _filter(wanted: DataFrame, n: int) -> np.ndarray:
    """A bitmap of hashes, at most FILTER_BITS large whatever their number."""
    bits = min(FILTER_BITS, 1 << max(16, (64 * n).bit_length()))
    at = F.col("ctx").bitwiseAND(F.lit(bits - 1))
    words = wanted.select(F.shiftright(at, 6).alias("i"), F.expr(f"shiftleft(1L, cast((ctx & {bits - 1}) & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("i").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def continuations(texts: DataFrame, kept: np.ndarray, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(ctx, f, n): how often a wanted prefix is followed by a token or END, counted in the tasks before the shuffle.

    wanted: (ctx). Prefixes that aren't wanted are left out by a filter, so a few of them remain.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((kept, _filter(wanted, n_wanted)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, bits = shared.value
        mask = np.uint64(64 * len(bits) - 1)
        for h, place in _slices(batches):
            s, after = _skeleton(h, kept), _following(h, place)
            for _, ok, ctx in _prefixes(s, place):
                at = ctx & mask
                ok &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                if ok.any():
                    yield _counted(ctx[ok].view(np.int64), after[ok], ["ctx", "f", "n"])

    return texts.select("h").mapInArrow(count, "ctx bigint, f bigint, n bigint").groupBy("ctx", "f").agg(F.sum("n").alias("n"))


def evidence(texts: DataFrame, structured: tuple[str, ...]) -> DataFrame:
    """(vid, kind, end_share, longer, same) of the values that may be cut: what the self-join knows of their ends.

    `end_share` is the share of ends among the other places with the longest prefix that enough of them have; longer and same
    count the words at this place that begin with the last word, or are it. Null where nothing is known.
    """
    kept = kept_words(texts)
    ends = cut(tails(texts, kept, structured))
    needed = ends.where("word IS NOT NULL").select("before", "word").distinct()
    wanted, n_wanted = cut_counting(ends.select("ctx").unionByName(needed.select(F.col("before").alias("ctx"))).distinct(), F.lit(True))
    table = cut(continuations(texts, kept, wanted, n_wanted))

    of = lambda *fs: F.coalesce(F.sum(F.when(F.col("f").isin(*fs), F.col("n"))), F.lit(0))
    places = table.groupBy("ctx").agg(F.sum("n").alias("total"), of(END, STOP).alias("n_end"), of(END).alias("n_over"))
    asked = table.where(F.col("f").bitwiseAND(F.lit(1)) == 1).join(needed.select(F.col("before").alias("ctx")).distinct(), "ctx", "left_semi")
    spelled = texts.select(F.explode("words").alias("w")).where(F.col("w").rlike(r"^\p{L}")).distinct().select("w", F.xxhash64("w").bitwiseOR(F.lit(1)).alias("f"))
    follows = asked.join(spelled.join(asked.select("f").distinct(), "f", "left_semi"), "f")
    prefixes = follows.select(
        F.col("ctx").alias("before"), "n", F.length("w").alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring("w", F.lit(1), k))).alias("word")
    )
    is_longer = F.col("len") > F.length("word")
    longer = prefixes.join(needed, ["before", "word"], "left_semi").groupBy("before", "word").agg(
        F.sum(F.when(is_longer, F.col("n")).otherwise(0)).alias("longer"), F.sum(F.when(is_longer, 0).otherwise(F.col("n"))).alias("exact")
    )
    # the value's own end is in both tables once and doesn't count; behind a mark of a cut it is no end in the text, so nothing is taken off
    over = F.when(F.col("kind") == "json", F.col("n_over")).otherwise(F.col("n_end"))
    return (
        ends.join(places, "ctx", "left")
        .join(longer, ["before", "word"], "left")
        .withColumn("others", F.coalesce("total", F.lit(1)) - 1)
        .withColumn("other_ends", F.greatest(F.coalesce(over, F.lit(1)) - 1, F.lit(0)))
        .withColumn("same", F.greatest(F.coalesce("exact", F.lit(1)) - 1, F.lit(0)))
        .withColumn("copied", (F.col("length") == WHOLE) & (F.col("kind") == "json") & (F.col("others") >= 1) & (F.col("other_ends") == 0))
        .withColumn("seen", F.col("copied") | (F.col("others") >= SEEN))
        .withColumn("known", (F.coalesce("longer", F.lit(0)) + F.col("same")) >= SEEN)
        .groupBy("vid", "kind")
        .agg(
            F.max_by(F.when(F.col("seen"), F.col("other_ends") / F.col("others")), F.when(F.col("seen"), F.col("length"))).alias("end_share"),
            F.max_by(F.when(F.col("known"), F.struct("longer", "same")), F.when(F.col("known"), F.col("length"))).alias("part"),
        )
        .select("vid", "kind", "end_share", "part.longer", "part.same")
    )


def truncated(values: DataFrame, structured: tuple[str, ...] = ("raw",)) -> DataFrame:
    """The values (field, record_id) whose end is missing; values: (field, record_id, value), any further columns.

    structured: fields whose values are JSON answers, perhaps with fences and prose around them. Null and blank values
    are no cases. A repeated record is given once. A value on whose end the corpus has no evidence isn't a case, be it
    prose or JSON.
    """
    ship(values.sparkSession)
    judged = evidence(token_table(values, structured), structured)
    mid_word = F.coalesce((F.col("longer") > 0) & (F.col("longer") > LONGER_RATIO * F.col("same")), F.lit(False))
    goes_on = F.coalesce(F.col("end_share") < F.when(F.col("kind") == "json", JSON_END_SHARE).otherwise(END_SHARE), F.lit(False))
    cases = judged.where(mid_word | goes_on).select("vid")
    return values.select("field", "record_id", value_id("field", "value").alias("vid")).join(cases, "vid", "left_semi").select("field", "record_id").distinct()


def truncation_rates(values: DataFrame, found: DataFrame, source: str = "model") -> DataFrame:
    """(field, source, n_values, n_cut, share) over the distinct records with a non-empty value; null is a source."""
    records = values.where("value IS NOT NULL AND value <> ''").select("field", "record_id", source).dropDuplicates(["field", "record_id"])
    return (
        records.join(found.select("field", "record_id", F.lit(1).alias("hit")), ["field", "record_id"], "left")
        .groupBy("field", source)
        .agg(F.count(F.lit(1)).alias("n_values"), F.count("hit").alias("n_cut"))
        .withColumn("share", F.col("n_cut") / F.col("n_values"))
    )

"""Keyword-stuffed pages and link lists, as robust outliers of their language.

Each page becomes a vector of word density, entropy, repetition, link and function-word features. For each group (the
language that the function words tell, else the declared one, else the script) location and scatter are estimated
robustly: medians and median deviations first, then concentration steps that take the mean and covariance of the
pages nearest to the centre. A page is flagged if its Mahalanobis distance is large and its whitened deviation points
into the directions in which spam differs: few function words, long runs of bare content words, repeated phrases,
bare links.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut, ship

# fixed values: frequent function words
FUNCTION_WORDS = {
    "en": "the a an of to in and that it its is are was were be been by for on with as at this which or not from if then so but can has have had he they we you i my your our their there when where while what who all each into than only also after before no one two do does did may must will would could should s t us",
    "de": "der die das ein eine einen einem eines und oder nicht von zu zur zum in im am an auf aus bei mit für ist sind war wird werden hat haben er sie es wir ihr sich den dem des als auch dass wenn aber so nach über unter bis vor durch um wie nur noch alle",
    "fr": "le la les l un une des du de d et ou ne pas est sont était à au aux en dans sur par pour avec ce cette ces il elle on nous vous qui que qu se s son sa ses leur n y si mais comme plus puis où",
    "es": "el la los las un una unos unas de del y o no es son era en a al con por para que se su sus lo le como más pero si ya está cada este esta sin sobre quién cuando",
    "ru": "и в не на что с по из к у за от до для о об при как это его её их он она они мы вы то же бы ли или но а если так только также где когда уже был была было были",
}
WORDS = {lang: frozenset(w.split()) for lang, w in FUNCTION_WORDS.items()}
EVERY = frozenset().union(*WORDS.values())
# patterns of Java's engine, for text in lower case
LINK = r"(?:https?|hxxps?|ftp)://\S++|www\.\S++|(?<!\w)(?=[\w-]++\.)(?:[\w.-]+\.[a-z]{2,8}/\S*+|[\w-]++(?:\.[\w-]+)*\.(?:com|net|org|example|html?)(?!\w))"
TAG, NUMBERED, LINKED = "<[^<>]*+>", r"\]\s*+\(\d++\)", ""
#: What every text with a link has.
MAYBE_LINK = r"://|www\.|\.[a-z]"
INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad\ue000]")
#: The first group only tells signs that a mark can begin with, so that most letters are passed by at once.
CODE = (
    r"(?m)(?=[{}=%\\^~&+;\s*(#0-9a-f-])(?:[{}=%\\^~&+]|;\s*+$|(?<=\w) ?\*|->|\(\)"
    r"|(?:(?<!\w)(?=[0-9a-f])|(?=\d))(?:0x[0-9a-f]++|(?<![\w.])(?=[a-f]*+\d)[0-9a-f]{4,}+(?!\w)|(?<!\w)\d\d?:\d\d|(?<![\d.])\d{3,}+(?![\d.])"
    r"|(?<!\w)[0-9a-f]{2}(?= [0-9a-f]{2}(?!\w)))|^\s*+#\s*+(?:define|include|ifn?def|endif|pragma)(?!\w))"
)
SENTENCE = r"[.!?。]+(?=\s|$)"
#: Digits and signs that stand for letters inside of a word, and those letters; an 8 marks such a word but stays.
LEET, LEET_FOR = "013457@$", "oieastas"

FEATURES = ("function_words", "run", "repeated", "entropy", "links", "code", "sentences", "variety")
#: Spam lies where these are larger (+) or smaller (-); the weights say how much a direction counts.
DIRECTIONS = (-1.0, 1.0, 0.7, -0.3, 1.0, -1.75, -0.4, 0.0)
#: Concentration steps, the share of pages they keep, squared distance and cosine from which a page is flagged.
STEPS, KEPT, DISTANCE, COSINE = 2, 0.75, 13.0, 0.37


_BASE, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


@cache
def _classes() -> np.ndarray:
    """A bit set for each code point: 1 letter, 2 letter or digit, 4 sign that may stand for a letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(len(out)):
        x = chr(c)
        if x.isalnum():
            out[c] = 2 if x.isdecimal() else 3
    for x in LEET + "8":
        out[ord(x)] |= 4
    return out


def _runs(inside: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches inside, none of which crosses pages."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.append(True, page[1:] != page[:-1])
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    return np.flatnonzero(inside & (~before | edge)), np.flatnonzero(inside & (~after | np.append(edge[1:], True))) + 1


def _word_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of code[start:end] for each pair."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(size.max()) + 1, _BASE, np.uint64))
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    total = np.cumsum(code[np.repeat(start, size) + place].astype(np.uint64) * powers[place])
    last = total[first + size - 1]
    h = (last - np.append(np.uint64(0), last[:-1]) ^ size.astype(np.uint64)) * _MIX
    return h ^ (h >> np.uint64(31))


@cache
def _known() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all function words in order, and a bit for each language that has the word."""
    listed = sorted(EVERY)
    code = np.array([ord(c) for c in "".join(listed)], np.uint32)
    end = np.cumsum([len(w) for w in listed])
    hashes = _word_hashes(code, end - [len(w) for w in listed], end)
    bits = np.array([sum((w in words) << i for i, words in enumerate(WORDS.values())) for w in listed], np.uint8)
    order = np.argsort(hashes)
    return hashes[order], bits[order]


def _languages(word: np.ndarray) -> np.ndarray:
    """The bits of the languages that have each hashed word as a function word."""
    hashes, bits = _known()
    at = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
    return np.where(hashes[at] == word, bits[at], 0)


def _tally(page: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(page, number) of each distinct pair."""
    order = np.lexsort((key, page))
    p, k = page[order], key[order]
    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (k[1:] != k[:-1]))) if len(p) else np.zeros(0, np.int64)
    return p[new], np.diff(np.append(new, len(p)))


def page_features(texts: pd.Series, links: np.ndarray, code_marks: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language told by function words, "" for none; values of FEATURES by page) of cleaned pages in lower case.

    All pages of a batch are one array of code points; words are stretches of letters in it, known by hashes.
    """
    n_pages, lengths = len(texts), texts.str.len().to_numpy(np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    page = np.repeat(np.arange(n_pages), lengths)
    by = lambda at, w=None: np.bincount(at, w, n_pages).astype(float)
    kind = _classes()[code]
    # words disguised by digits and signs
    start, end = _runs(kind > 1, page)
    if len(start):
        has = lambda what: np.add.reduceat((kind & what > 0).astype(np.int64), np.stack([start, np.minimum(end, len(code) - 1)], 1).ravel())[::2] > 0
        free = (start == 0) | ~np.isin(code[start - 1], [ord("_"), ord("#")]) | (page[start] != page[start - 1])
        hexadecimal = (code[start] == ord("0")) & (code[np.minimum(start + 1, len(code) - 1)] == ord("x"))
        mixed = has(1) & has(4) & free & ~hexadecimal
        at = np.repeat(start[mixed], (end - start)[mixed])
        at = at + np.arange(len(at)) - np.repeat(np.cumsum((end - start)[mixed]) - (end - start)[mixed], (end - start)[mixed])
        to = np.arange(128, dtype=np.uint32)
        to[[ord(c) for c in LEET]] = [ord(c) for c in LEET_FOR]
        at = at[code[at] < 128]
        code[at] = to[code[at]]
        kind = _classes()[code]
    start, end = _runs(kind & 1 > 0, page)
    word, where, size = _word_hashes(code, start, end), page[start] if len(start) else start, end - start
    n = by(where)
    tongues = _languages(word)
    is_function = tongues > 0
    hits = np.stack([by(where[is_function], tongues[is_function] >> i & 1) for i in range(len(WORDS))])
    told = np.where((n > 0) & (hits.max(0) >= 0.12 * n), np.array(list(WORDS))[hits.argmax(0)], "")
    low, high = _runs(~is_function, where)
    bare = by(where[low] if len(low) else low, np.where(high - low >= 6, high - low, 0))
    pair = (where[1:] == where[:-1]) & ~is_function[1:] & ~is_function[:-1] & (size[1:] > 2) & (size[:-1] > 2)
    at, times = _tally(where[:-1][pair], (word[:-1] * _BASE ^ word[1:])[pair])
    repeated = by(at, np.where(times > 1, times, 0)) / np.maximum(1, n - 1)
    at, times = _tally(where, word)
    share = times / n[at] if len(at) else times
    entropy = by(at, -share * np.log(np.maximum(share, 1e-300))) / np.log(np.maximum(n, 2))
    several, some = n + 1, np.maximum(1, n)
    out = np.stack([
        np.sqrt(by(where, is_function) / some), bare / some, np.sqrt(repeated), np.where(n > 0, entropy, 0.0), np.log1p(10 * links / several),
        5 * code_marks / several, np.log1p(10 * sentences / several), by(at) / np.maximum(1.0, n**0.8),
    ], 1)
    # scripts without blanks: sequences of three characters in place of words
    wide = by(page, (code >= 0x3040) & (code < 0x9FFF))
    asian = wide > 0.2 * np.maximum(1, lengths)
    if asian.any():
        three = np.flatnonzero((page[2:] == page[:-2]) & asian[page[2:]]) if len(code) > 2 else np.zeros(0, np.int64)
        c = code.astype(np.uint64)
        at, _ = _tally(page[three], (c[three] << np.uint64(42)) | (c[three + 1] << np.uint64(21)) | c[three + 2])
        again, per = 1 - by(at) / np.maximum(1, by(page[three])), np.maximum(1.0, wide / 3)
        flat = np.zeros(n_pages)
        signs = np.stack([flat + 0.5, flat, again, flat + 1, links / per, flat, sentences / per, 1 - again], 1)
        out[asian], told = signs[asian], np.where(asian, "ja", told)
    return told, out


def _plain(text: Column) -> Column:
    """Text without entities, compatibility forms and invisible marks, in Arrow batches."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        spelled = (html.unescape(t) if "&" in t else t for t in texts)
        return pd.Series([t if t.isascii() else INVISIBLE.sub("", unicodedata.normalize("NFKC", t)) for t in spelled], dtype=object)

    return plain(text)


def page_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, grp, page, FEATURES...) of every page with at least one visible character; whole texts are read.

    `page` is a hash of the text, the same for all its copies. Tags, links and marks are found by the engine's own patterns,
    words in arrays of a whole batch.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low, upto = 0, batch["_clean"].str.len().cumsum().to_numpy()
            while low < len(batch):  # some million characters at a time
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + (1 << 21), "right")))
                part = batch.iloc[low:high]
                told, values = page_features(part["_clean"].reset_index(drop=True), *(part[c].to_numpy(float) for c in ("_links", "_code", "_sentences")))
                grp = np.where(told != "", told, part["_declared"].where(part["_declared"].isin(list(WORDS)), "none"))
                yield pd.DataFrame({key: part[key].to_numpy(), "grp": grp, "page": part["page"].to_numpy(), **{f: values[:, i] for i, f in enumerate(FEATURES)}})
                low = high

    seen = docs.where(F.col(text).rlike(r"\S")).select(
        key, F.md5(F.encode(text, "utf-8")).alias("page"), F.split(F.lower(F.coalesce(F.col(lang), F.lit(""))), "-")[0].alias("_declared"),
        _plain(F.regexp_replace(text, TAG, " ")).alias("_text"),
    )
    low = seen.withColumn("_text", F.lower("_text")).where(F.col("_text").rlike(r"\S"))
    linked = F.when(F.col("_text").rlike(MAYBE_LINK), F.regexp_replace("_text", LINK, LINKED)).otherwise(F.col("_text"))
    marked = low.withColumn("_text", F.regexp_replace(linked, NUMBERED, "] "))
    clean = marked.withColumn("_clean", F.translate("_text", LINKED, " ")).withColumn("_links", F.length("_text") - F.length(F.translate("_text", LINKED, "")))
    counted = clean.select(key, "page", "_declared", "_clean", "_links", F.regexp_count("_clean", F.lit(CODE)).alias("_code"), F.regexp_count("_clean", F.lit(SENTENCE)).alias("_sentences"))
    return counted.mapInPandas(run, f"`{key}` {kind}, grp string, page string, " + ", ".join(f"{f} double" for f in FEATURES))


def _moments(x: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of each group; the groups are the languages with a word list and two more, so few."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    rows = x.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs],
    )
    out = {}
    for r in rows.collect():
        cov = np.zeros((len(FEATURES),) * 2)
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[r.grp] = (np.array([r[f"m{i}"] for i in range(len(FEATURES))]), cov)
    return out


def robust_fit(vectors: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Robust location and whitening matrix of each group.

    Starts from medians and median absolute deviations, then keeps, STEPS times, the KEPT nearest share of each group.
    All pages take part, but copies of a text count once in a group, else the copies of one page could make up most of it
    and would be its centre. Only one row for each group and quantile comes to the driver.
    """
    vectors = cut(vectors.dropDuplicates(["grp", "page"]))
    medians = vectors.groupBy("grp").agg(*[F.percentile_approx(f, 0.5, 10000).alias(f) for f in FEATURES]).collect()
    centre = {r.grp: np.array([r[f] for f in FEATURES]) for r in medians}
    shift = lambda f, i: F.abs(F.col(f) - F.create_map(*[y for g, c in centre.items() for y in (F.lit(g), F.lit(float(c[i])))])[F.col("grp")])
    spreads = vectors.select("grp", *[shift(f, i).alias(f) for i, f in enumerate(FEATURES)]).groupBy("grp").agg(*[F.percentile_approx(f, 0.5, 10000).alias(f) for f in FEATURES]).collect() if centre else []
    fit = {r.grp: (centre[r.grp], np.diag(1 / np.maximum([1.4826 * r[f] for f in FEATURES], FLOOR))) for r in spreads}
    for _ in range(STEPS if fit else 0):
        scored = score(vectors, fit)
        cuts = {r.grp: r.q for r in scored.groupBy("grp").agg(F.percentile_approx("d2", KEPT, 10000).alias("q")).collect()}
        limit = F.create_map(*[y for g, q in cuts.items() for y in (F.lit(g), F.lit(float(q)))])[F.col("grp")]
        fit = {}
        for grp, (mean, cov) in _moments(scored.where(F.col("d2") <= limit)).items():
            # a kept share has less scatter than the whole; the floor keeps features that hardly vary from exploding
            values, base = np.linalg.eigh(1.6 * cov + np.diag(FLOOR**2))
            fit[grp] = (mean, base @ np.diag(values**-0.5) @ base.T)
    return fit


FLOOR = np.array([0.06, 0.08, 0.08, 0.04, 0.15, 0.15, 0.12, 0.15])


def score(vectors: DataFrame, fit: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """vectors + (d2, cosine): squared distance and the cosine between the whitened deviation and the spam directions.

    The fit, a row for each language and two more, is joined to the pages as arrays.
    """
    towards = F.array(*[F.lit(float(v)) for v in np.array(DIRECTIONS) / np.linalg.norm(DIRECTIONS)])
    rows = [(g, [float(v) for v in mean], [[float(v) for v in column] for column in white.T]) for g, (mean, white) in fit.items()]
    groups = vectors.sparkSession.createDataFrame(rows, "grp string, _m array<double>, _w array<array<double>>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    kept = [c for c in vectors.columns if c not in ("d2", "cosine")]
    off = F.zip_with(F.array(*FEATURES), "_m", lambda x, m: x - m)
    z = vectors.join(F.broadcast(groups), "grp").select(*kept, "_w", off.alias("_off")).select(*kept, F.transform("_w", lambda w: dot(F.col("_off"), w)).alias("_z"))
    both = z.select(*kept, dot(F.col("_z"), F.col("_z")).alias("d2"), dot(F.col("_z"), towards).alias("_along"))
    return both.select(*kept, "d2", (F.col("_along") / F.sqrt(F.greatest("d2", F.lit(1e-12)))).alias("cosine"))


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """vectors and scores of the pages flagged; null, empty and blank texts are never flagged, repeated rows once."""
    vectors = cut(page_vectors(docs, key, text, lang))
    fit = robust_fit(vectors)
    return score(vectors, fit).where((F.col("d2") >= DISTANCE) & (F.col("cosine") >= COSINE)).dropDuplicates([key])

"""Functions on symbol names: generic names, normalised keys, word tokens, accuracy against a better name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: prefixes and names that say nothing
GENERIC_PREFIXES = ["fun_", "sub_", "loc_", "lab_", "unk_", "func_", "nullsub_", "j_", "case_"]
GENERIC_NAMES = [
    "callback", "do_something", "do_work", "entry", "func", "function", "handler", "helper", "main_logic", "process",
    "process_data", "routine", "stub", "subroutine", "unknown", "unnamed", "utility", "utility_function", "wrapper",
]
# fixed values: words of one group mean the same; noise words mean nothing
SYNONYMS = [
    ["search", "find", "lookup"], ["node", "entry", "element"], ["buffer", "buf"], ["encode", "encrypt"],
    ["decode", "decrypt"], ["delete", "remove"], ["create", "make", "new", "alloc"], ["insert", "add", "push"],
    ["string", "str"], ["print", "display", "show"], ["count", "num", "size", "length"],
]
NOISE = ["or", "from", "the", "a", "an", "of", "to", "and", "is", "in"]


def is_generic(name: Column) -> Column:
    """True for null, blank, placeholder and empty-worded names."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (low == "") | low.rlike("^(" + "|".join(GENERIC_PREFIXES) + ")") | low.isin(GENERIC_NAMES)


def match_key(name: Column) -> Column:
    """Leading underscores dropped, lower case: equal for all spellings of a library function."""
    return F.lower(F.ltrim(name, F.lit("_")))


def word_tokens(name: Column) -> Column:
    """Lower-case words of a snake_case or camelCase name without noise words; the empty list for null."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "_", " "), "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.trim(spaced)), r"\s+"), lambda w: (w != "") & ~w.isin(NOISE))


def _canonical(words: Column) -> Column:
    first = {w: g[0] for g in SYNONYMS for w in g}
    table = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)))


def symbol_accuracy(predicted: Column, truth: Column) -> Column:
    """1 equal; .9 the same words; .8 every true word or a synonym is there; else .7 of the share that is; 0 without words."""
    p, t = F.array_distinct(word_tokens(predicted)), F.array_distinct(word_tokens(truth))
    known = _canonical(p)
    table = F.create_map(*[F.lit(x) for w, c in {w: g[0] for g in SYNONYMS for w in g}.items() for x in (w, c)])
    hit = F.filter(t, lambda w: F.array_contains(known, F.coalesce(F.try_element_at(table, w), w)))
    recall = F.size(hit) / F.size(t)
    return (
        F.when(predicted == truth, 1.0)
        .when((F.size(p) == 0) | (F.size(t) == 0), 0.0)
        .when((F.size(F.array_except(p, t)) == 0) & (F.size(F.array_except(t, p)) == 0), 0.9)
        .when(F.size(hit) == F.size(t), 0.8)
        .otherwise(recall * 0.7)
    )

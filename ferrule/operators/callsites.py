"""Calls written in C bodies, and results whose signature doesn't agree with how they are called."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import parsing
from ferrule.operators import review
from ferrule.session import ship
from ferrule.sources.documents import CONTROL

#: Comments, strings and characters that close in their line, names, any other sign.
_TOKEN = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_]\w*|\S", re.DOTALL)
_SITES = "block int, pos int, name string, n_args int, uses_return boolean"
#: The rules of sources.documents: where a text is split into functions, and the comments in front of a body.
_BLOCK, _LEADING = re.compile(r"^(?=/\*\*$)", re.MULTILINE), re.compile(r"\s*/\*.*?\*/\s*", re.DOTALL)


def bodies_of(text: str) -> list[tuple[int, int, int]]:
    """(block, start, end) of every exported function in a text, its two leading comments left out."""
    cuts = [0, *(m.start() for m in _BLOCK.finditer(text) if m.start() > 0), len(text)]
    out = []
    for block, (start, end) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2):
            comment = _LEADING.match(text, start, end)
            start = comment.end() if comment else start
        out.append((block, start, end))
    return out


def sites_of(code: str, start: int = 0, end: int | None = None) -> list[tuple[int, str, int, bool]]:
    """(start, name, n_args, uses_return) of every closed call behind the first brace, found in one pass with a stack.

    A name outside of all brackets whose closed list is followed by a brace is a further definition, not a call.
    """
    end = len(code) if end is None else end
    body = code.find("{", start, end)
    if body < 0:
        return []
    found, stack, before, last = [], [], "", None  # before: the last token; last: (start, name, token before it)
    headed = None  # the call that was just closed outside of all brackets
    for m in _TOKEN.finditer(code, body, end):
        token = m.group()
        if token.startswith(("/*", "//")):
            continue
        if token == "{" and headed:
            found.pop()
        headed = None
        if stack and token not in ")]}":
            stack[-1][2] = True
        if token in "([{":
            stack.append([last if token == "(" else None, 0, False])
        elif token in ")]}":
            if stack:
                call, commas, filled = stack.pop()
                if call:
                    found.append((call[0], call[1], commas + 1 if commas or filled else 0, call[2]))
                    headed = None if stack else found[-1]
        elif token == "," and stack:
            stack[-1][1] += 1
        named = (token[0].isalpha() or token[0] == "_") and token not in CONTROL
        last = (m.start(), token, before not in ("", ";", "{", "}", ":", "else", "do")) if named else None
        before = token
    return sorted(found)


def call_sites(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, pos, name, n_args, uses_return) of the calls in the bodies of each text; keywords aren't calls.

    A text holds one function for each block that a line `/**` opens, positions are those in the text. A text without a
    brace, an empty and a null one have none, a call that isn't closed is none. Arguments are split at commas outside of
    inner brackets and strings; a quote that isn't closed in its line is an ordinary sign. The value is used unless a
    statement, a block or a label ends before the call, or `else` or `do` stands there.
    """
    ship(texts.sparkSession)
    given = texts.where(F.col(text).contains("{") & F.col(text).contains("(")).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, block, *s) for k, t in zip(b["key"], b["text"]) for block, start, end in bodies_of(t) for s in sites_of(t, start, end)]
            yield pd.DataFrame(rows, columns=["key", "block", "pos", "name", "n_args", "uses_return"])

    kind = texts.schema[key].dataType.simpleString()
    return given.mapInPandas(scan, f"key {kind}, {_SITES}").withColumnRenamed("key", key)


def callee_names(results: DataFrame) -> DataFrame:
    """(binary_id, name, address): the names by which calls may mean a usable result.

    Its own name, unless another one of its binary has it too, and its original name; a name that is left with several
    functions means none of them.
    """
    good = results.where(review.usable())
    shared = review.duplicate_names(results).select("binary_id", "name").distinct()
    own = good.select("binary_id", "name", "address").join(shared, ["binary_id", "name"], "left_anti")
    old = good.select("binary_id", F.col("original_name").alias("name"), "address").where("name <> ''")
    return own.unionByName(old).groupBy("binary_id", "name").agg(F.min("address").alias("address"), F.max("address").alias("_most")).where("address = _most").drop("_most")


def call_conflicts(results: DataFrame, bodies: DataFrame, key: str, text: str) -> DataFrame:
    """(kind, binary_id, address, key, block, detail): results that a body of their binary calls otherwise than they declare.

    argument_count: all calls in the body pass one number of arguments, and it isn't the declared one (variadic and
    unspecified signatures declare none). return_value: declared void, but a call's value is used. bodies: (binary_id,
    key, text), each block of a text is a body; one without a binary calls nothing. Calls are summed by body and name
    before they meet the results.
    """
    calls = call_sites(bodies.where("binary_id IS NOT NULL").select("binary_id", key, text).dropDuplicates([key]).withColumn("_k", F.struct("binary_id", key)), "_k", text)
    summed = calls.groupBy("_k.binary_id", F.col(f"_k.{key}").alias(key), "block", "name").agg(F.min("n_args").alias("least"), F.max("n_args").alias("most"), F.max("uses_return").alias("used"))
    declared = results.where(review.usable()).select("binary_id", "address", parsing.signature(F.col("signature")).alias("s")).where("s IS NOT NULL")
    met = summed.join(callee_names(results), ["binary_id", "name"]).join(declared, ["binary_id", "address"])
    by_body = met.groupBy("binary_id", "address", key, "block").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("used").alias("used"), F.first("s").alias("s"))
    row = lambda kind, where, detail: by_body.where(where).select(F.lit(kind).alias("kind"), "binary_id", "address", key, "block", detail.alias("detail"))
    counts = F.format_string("%d declared, %d passed", F.col("s.n_params"), F.col("least"))
    return row("argument_count", "least = most AND NOT s.variadic AND NOT s.unspecified AND s.n_params <> least", counts).unionByName(
        row("return_value", "used AND replace(s.return_type, ' ', '') = 'void'", F.lit("used"))
    )

"""Values as models write them: numbers, confidences, fences, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def address(text: Column) -> Column:
    """0x.. is hexadecimal, a number without leading zeros decimal, any other hexadecimal digits hexadecimal; else null.

    Numbers that do not fit into a long give null.
    """
    t = F.lower(F.trim(text))
    return (
        F.when(t.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, 10).try_cast("bigint"))
        .when(t.rlike("^(0+|[1-9][0-9]{0,18})$"), t.try_cast("bigint"))
        .when(t.rlike("^[0-9a-f]{1,16}$"), F.conv(t, 16, 10).try_cast("bigint"))
    )


def confidence(text: Column) -> Column:
    """A score of 0 to 100: a trailing % is dropped, a value between 0 and 1 is a share; 0 where it is no number.

    Halves are rounded to the even neighbour.
    """
    value = F.trim(F.rtrim(F.trim(text), F.lit("%"))).try_cast("double")
    scaled = F.when((value > 0) & (value < 1), value * 100).otherwise(value)
    whole = F.rint(scaled).try_cast("int")
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), whole)))


def strip_fences(text: Column) -> Column:
    """What stands inside the first fenced block, else the trimmed text."""
    inner = F.regexp_extract(text, r"(?s)```[a-zA-Z]*[ \t]*\n(.*?)\n?```", 1)
    return F.when(text.rlike(r"(?s)```[a-zA-Z]*[ \t]*\n.*?```"), inner).otherwise(F.trim(text))


SIGNATURE = r"(?s)^\s*(.*?)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\((.*)\)\s*;?\s*$"


def signature(text: Column) -> Column:
    """struct(return_type, name, n_params, variadic, unspecified) of `type name(params)`, null if it is not one.

    Parameters are split at commas outside of one level of parentheses. `(void)` has none, `()` is unspecified.
    """
    inner = F.trim(F.regexp_extract(text, SIGNATURE, 3))
    flat = F.regexp_replace(inner, r"\([^()]*\)", "")
    parts = F.filter(F.transform(F.split(flat, ","), lambda p: F.trim(p)), lambda p: p != "")
    real = F.filter(parts, lambda p: p != "...")
    void = (F.size(real) == 1) & (F.get(real, F.lit(0)) == "void")
    return F.when(
        text.rlike(SIGNATURE),
        F.struct(
            F.regexp_extract(text, SIGNATURE, 1).alias("return_type"),
            F.regexp_extract(text, SIGNATURE, 2).alias("name"),
            F.when(void, 0).otherwise(F.size(real)).alias("n_params"),
            (F.size(parts) > F.size(real)).alias("variadic"),
            (F.size(parts) == 0).alias("unspecified"),
        ),
    )


# fixed values: names of one type
TYPE_ALIASES = {
    "uint": "int", "byte": "char", "undefined4": "int", "undefined8": "long", "undefined2": "short", "undefined1": "char",
    "bool": "int", "dword": "int", "qword": "long", "word": "short",
}


def plain_type(text: Column) -> Column:
    """A C type without const and signedness, aliases resolved, stars kept."""
    bare = F.trim(F.regexp_replace(F.replace(F.replace(F.replace(text, F.lit("const"), F.lit("")), F.lit("unsigned"), F.lit("")), F.lit("signed"), F.lit("")), r"\s+", " "))
    base = F.regexp_replace(bare, r"\s*\**$", "")
    stars = F.substring(bare, F.length(base) + 1, F.length(bare))
    table = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    return F.trim(F.concat(F.coalesce(F.try_element_at(table, base), base), stars))


def param_types(text: Column) -> Column:
    """Plain types of a signature's parameters, split at every comma; a name behind a type or a star is dropped."""
    inner = F.trim(F.regexp_extract(text, SIGNATURE, 3))
    each = lambda p: F.when(p.rlike(r"\*\s*\w*$"), F.regexp_replace(p, r"\w*$", "")).otherwise(F.regexp_replace(p, r"\s+\S+$", ""))
    parts = F.transform(F.split(inner, ","), lambda p: plain_type(F.trim(each(F.trim(p)))))
    return F.when((inner == "") | (inner == "void"), F.array().cast("array<string>")).otherwise(parts)


def type_accuracy(predicted: Column, truth: Column) -> Column:
    """1 for equal texts; else .4 for the return type, .3 for the number of parameters, .3 for the share that agrees."""
    p, t = param_types(predicted), param_types(truth)
    back = lambda c: plain_type(F.regexp_extract(c, SIGNATURE, 1))
    same = F.size(F.filter(F.arrays_zip(p.alias("p"), t.alias("t")), lambda x: x["p"] == x["t"]))
    most = F.greatest(F.size(p), F.size(t))
    agree = F.when(most == 0, 0.3).when((F.size(p) == 0) | (F.size(t) == 0), 0.0).otherwise(0.3 * same / most)
    parts = F.when(back(predicted) == back(truth), 0.4).otherwise(0.0) + F.when(F.size(p) == F.size(t), 0.3).otherwise(0.0) + agree
    return F.when(predicted == truth, 1.0).otherwise(parts)


# fixed values: built-in types by name
BUILTIN_TYPES = {
    "byte": "byte", "char": "char", "short": "short", "int": "int", "long": "long", "long long": "longlong",
    "uint8_t": "byte", "uint16_t": "ushort", "uint32_t": "uint", "uint64_t": "ulonglong",
    "int8_t": "char", "int16_t": "short", "int32_t": "int", "int64_t": "longlong",
    "unsigned int": "uint", "unsigned long": "ulong", "unsigned short": "ushort",
}


def resolved_type(text: Column, size: Column) -> Column:
    """The built-in type that a C type means, with a star for each pointer level.

    An unknown type, and null, is an undefined one of the size 1, 2, 4 or 8, else of 4; behind a pointer of 8.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    depth = F.length(F.regexp_replace(F.regexp_extract(t, "[* ]+$", 0), " ", ""))
    base = F.lower(F.trim(F.regexp_replace(t, "[* ]+$", "")))
    table = F.create_map(*[F.lit(x) for kv in BUILTIN_TYPES.items() for x in kv])
    sized = F.when(depth > 0, "undefined8").when(size.isin(1, 2, 4, 8), F.concat(F.lit("undefined"), size.cast("string"))).otherwise("undefined4")
    return F.concat(F.coalesce(F.try_element_at(table, base), sized), F.repeat(F.lit("*"), depth))

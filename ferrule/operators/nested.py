"""Deeply nested records to related flat tables.

JSON answers are read as VARIANT, so a value may have any shape. Every array level becomes the rows of a child table:
a row has its record, its own key (`path`: the positions from the outermost list, joined by `.`), its parent's key
and its position. The merged schema of a level is inferred from all of its items and tells the columns of its flat
table. Levels are followed until one is empty; each is cut from its lineage, so no level is computed twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut

#: A text from its first bracket to its last.
BODY = r"(?s)[\[{].*[\]}]"


def _opened(df: DataFrame, variant: str, keep: list[str]) -> DataFrame:
    """keep + (variant, shape): a JSON text inside of JSON, fenced or encoded twice too, is read as what it spells; `shape`
    begins with the value's type.

    The result is written before anything filters on the shape, else the planner would copy the parsing into each use.
    """
    def spelled(value: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        whole = F.try_parse_json(F.when(text.rlike(r'^\s*[\[{"]'), text))
        fenced = F.try_parse_json(F.when(text.rlike(r"^\s*```"), F.regexp_extract(text, BODY, 0)))
        return F.when(F.schema_of_variant(value) == "STRING", F.coalesce(whole, fenced, value)).otherwise(value)

    once = df.select(*keep, spelled(F.col(variant)).alias(variant))
    twice = once.select(*keep, spelled(F.col(variant)).alias(variant))
    return cut(twice.select(*keep, variant, F.substring(F.schema_of_variant(variant), 1, 16).alias("shape")))


def parse_answers(df: DataFrame, record: str, raw: str, repair: bool = False) -> DataFrame:
    """(record, answer): the JSON of each answer as VARIANT: the whole text, else from its first bracket to its last.

    Fences and prose around the JSON are dropped. Null, empty and faulty texts give null; with `repair`, a text that is
    faulty otherwise is read without the commas that stand before a closing bracket.
    """
    body = F.regexp_extract(raw, BODY, 0)
    tries = [F.try_parse_json(raw), F.try_parse_json(F.when(body != "", body))]
    if repair:
        tries.append(F.try_parse_json(F.when(body != "", F.regexp_replace(body, r",(\s*[}\]])", "$1"))))
    return df.select(F.col(record).alias("record"), F.coalesce(*tries).alias("answer"))


def _children(df: DataFrame, variant: str, keep: list[str]) -> DataFrame:
    """Members of objects and lists: keep + (pos, key, value)."""
    view = df.where("shape LIKE 'ARRAY%' OR shape LIKE 'OBJECT%'").select(*keep, F.col(variant).alias("_v"))
    return view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(*keep, "pos", "key", "value")


def members(df: DataFrame, variant: str, keep: list[str]) -> DataFrame:
    """keep + (pos, key, value): the members of VARIANT objects and lists; other values have none."""
    return _children(_opened(df, variant, keep), variant, keep)


def list_items(df: DataFrame, variant: str, keep: list[str]) -> DataFrame:
    """keep + (pos, value): the members of a VARIANT list, or the one object in a list's place at 0; other values have none."""
    opened = _opened(df, variant, keep)
    listed = _children(opened.where("shape LIKE 'ARRAY%'"), variant, keep).select(*keep, "pos", "value")
    return listed.unionByName(opened.where("shape LIKE 'OBJECT%'").select(*keep, F.lit(0).alias("pos"), F.col(variant).alias("value")))


def find_member(answers: DataFrame, key: str) -> DataFrame:
    """(record, node): the value under `key`, in the answer itself or in the nearest wrapper that has it, at any depth.

    answers: (record, answer). An answer that is a bare list, with no such member inside, counts as the list itself.
    """
    level = _opened(answers, "answer", ["record"])
    bare, found = level.where("shape LIKE 'ARRAY%'").select("record", F.col("answer").alias("node")), None
    while True:
        looked = cut(level.withColumn("node", F.when(F.col("shape").startswith("OBJECT"), F.try_variant_get("answer", f"$.{key}", "variant"))))
        hit = looked.where("node IS NOT NULL").select("record", "node")
        found = hit if found is None else found.unionByName(hit)
        inner = _children(looked.where("node IS NULL"), "answer", ["record"]).select("record", F.col("value").alias("answer"))
        level = _opened(inner, "answer", ["record"]).where("shape LIKE 'ARRAY%' OR shape LIKE 'OBJECT%'")
        if level.isEmpty():
            break
    return found.unionByName(bare.join(found, "record", "left_anti"))


def _items(nodes: DataFrame) -> DataFrame:
    """(record, parent, level, node) to one row for each item: a list's members, or the one object in a list's place.

    Null and empty items keep their positions and are then left out.
    """
    keys = ["record", "parent", "level"]
    opened = _opened(nodes, "node", keys)
    one = opened.where("shape LIKE 'OBJECT%'").select(*keys, F.lit(0).alias("pos"), F.col("node").alias("item"))
    many = _children(opened.where("shape LIKE 'ARRAY%'"), "node", keys).select(*keys, "pos", F.col("value").alias("item"))
    items = cut(
        one.unionByName(many)
        .withColumn("kind", F.substring(F.schema_of_variant("item"), 1, 16))
        .withColumn("blank", F.coalesce(F.trim(F.try_variant_get("item", "$", "string")) == "", F.lit(False)))
    )
    here = F.concat(F.when(F.col("parent").isNull(), "").otherwise(F.concat("parent", F.lit("."))), F.col("pos").cast("string"))
    full = ~F.col("kind").isin("VOID", "OBJECT<>", "ARRAY<>", "ARRAY<VOID>") & ~((F.col("kind") == "STRING") & F.col("blank"))
    return items.where(full).select(*keys, "pos", here.alias("path"), "item")


def explode_levels(nodes: DataFrame, child_key: str) -> DataFrame:
    """All items at any depth: (record, parent, level, pos, path, item).

    nodes: (record, node), `node` a VARIANT list, object or JSON text. The items under an item's `child_key` are its
    children. (record, path) is an item's key and (record, parent) its parent's; parent is null at the top level.
    """
    level, out = nodes.select("record", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), "node"), None
    while True:
        items = _items(level)
        out = items if out is None else out.unionByName(items)
        if items.isEmpty():
            return out
        child = F.try_variant_get("item", f"$.{child_key}", "variant")
        level = items.select("record", F.col("path").alias("parent"), (F.col("level") + 1).alias("level"), child.alias("node"))


def _object_members(ddl: str) -> dict[str, str]:
    """The members of an OBJECT<...> type and their types; names may be quoted by backticks."""
    body, fields, depth, start, quoted = re.sub(r"^OBJECT<|>$", "", ddl), {}, 0, 0, False
    for i, c in enumerate(body + ","):
        quoted ^= c == "`"
        depth += 0 if quoted else (c == "<") - (c == ">")
        if c == "," and depth == 0 and not quoted:
            name, kind = re.fullmatch(r"(?s)(`(?:[^`]|``)*`|[^:]*)(?:: )?(.*)", body[start:i].strip()).groups()
            if kind:
                fields[name[1:-1].replace("``", "`") if name.startswith("`") else name] = kind
            start = i + 1
    return fields


def merged_schema(items: DataFrame) -> dict[str, str]:
    """The members that items have and their merged types, in the order of their names; {} for no items.

    Types that don't agree come out as VARIANT. The schema is one value, as large as the names that occur.
    """
    ddl = items.where(F.schema_of_variant("item").startswith("OBJECT")).select(F.schema_of_variant_agg("item")).first()[0] or ""
    return _object_members(ddl)


def _members_below(schema: dict[str, str], above: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """(path, type) of all members, those of object members in their place."""
    out = []
    for name, kind in schema.items():
        inner = _object_members(kind) if kind.startswith("OBJECT<") else {}
        out += _members_below(inner, (*above, name)) if inner else [((*above, name), kind)]
    return out


def _at(path: tuple[str, ...]) -> str:
    return "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in path)


def flat_table(items: DataFrame, columns: list[str] | None = None, child_key: str | None = None) -> DataFrame:
    """The items of one or more levels as a flat table: keys and one text column for each scalar member.

    Columns come from the merged schema of the items: `columns` first, which are there even if no item has them, then
    all others by name; members of object members are columns like `notes.weight`. A member whose name is one of the keys
    gets the prefix `item_`. Lists are left to `list_tables`, also the objects of a member that is scalar elsewhere, and
    the items under `child_key` are rows of their own.
    """
    keys = ["record", "level", "parent", "pos", "path"]
    found = [path for path, kind in _members_below(merged_schema(items)) if not kind.startswith(("ARRAY", "OBJECT", "VOID")) and path != (child_key,)]
    first = [(n,) for n in columns or []]
    scalar = lambda p: F.when(~F.schema_of_variant(F.try_variant_get("item", _at(p), "variant")).rlike("^(ARRAY|OBJECT)"), F.try_variant_get("item", _at(p), "string"))
    name = lambda p: f"item_{'.'.join(p)}" if p[0] in keys and len(p) == 1 else ".".join(p)
    return items.select(*keys, *[scalar(p).alias(name(p)) for p in [*first, *(p for p in found if p not in first)]])


def list_tables(items: DataFrame, child_key: str | None = None) -> dict[str, DataFrame]:
    """Every list member at any depth, by its name (`notes.seen_in`, `a[].b` for lists in the items of a list `a`).

    Each is a table like that of `explode_levels`; `parent` is the path of the item that has the list, `path` goes on
    from there. Members are told by the merged schema; one without a list or object in any item has no table.
    """
    out, left = {}, [("", items, child_key)]
    while left:
        above, level, skip = left.pop()
        for path, kind in _members_below(merged_schema(level)):
            if path == (skip,) or not kind.startswith(("ARRAY", "VARIANT")):
                continue
            node = F.try_variant_get("item", _at(path), "variant")
            inner = _items(level.select("record", F.col("path").alias("parent"), (F.col("level") + 1).alias("level"), node.alias("node")).where("node IS NOT NULL"))
            left += [(above + ("[]." if above else "") + ".".join(path), inner, None)] if not inner.isEmpty() else []
        if level is not items:
            out[above] = level
            deeper = _items(level.where(F.schema_of_variant("item").startswith("ARRAY")).select("record", F.col("path").alias("parent"), (F.col("level") + 1).alias("level"), F.col("item").alias("node")))
            left += [(above + "[]", deeper, None)] if not deeper.isEmpty() else []
    return out


def number(text: Column) -> Column:
    """A whole number written in decimal or as 0x..., else null, also where it doesn't fit into a long."""
    t = F.trim(text)
    return F.when(t.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, 10).try_cast("bigint")).when(
        t.rlike(r"^[+-]?\d{1,19}$"), t.try_cast("bigint")
    )


def array_items(df: DataFrame, record: str, array: str, value: str = "item") -> DataFrame:
    """(record, pos, value) of the non-null, non-empty elements of an array column; positions are those in the list.

    A text of blanks and a struct whose members are all null are empty. Repeated rows of one record count once.
    """
    got = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.posexplode(array).alias("pos", value)).where(F.col(value).isNotNull())
    kind = got.schema[value].dataType
    if kind.typeName() == "string":
        got = got.where(F.trim(value) != "")
    elif kind.typeName() == "struct":
        got = got.where(F.coalesce(*[F.col(value)[f.name].isNotNull() | F.lit(None) for f in kind.fields], F.lit(False)))
    return got.dropDuplicates(["record", "pos"])

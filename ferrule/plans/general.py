"""Queries of the general problems (1, 3, 4) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import hierarchy, nested
from ferrule.operators.skew import heavy_keys, key_profile
from ferrule.session import table

HEAVY_SHARE = 0.02


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(*hierarchy.call_links(table(spark, sf, "call_graph")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select(F.col("scope").alias("binary_id"), F.col("node").alias("address"), "path")


def p1_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The functions of every cycle, named by its smallest address."""
    return _tree(spark, sf).where("in_cycle").select(F.col("scope").alias("binary_id"), F.col("step").alias("cycle"), F.col("node").alias("address"))


def p1_below(spark: SparkSession, sf: str) -> DataFrame:
    """All functions below each function."""
    found = hierarchy.descendants(_tree(spark, sf))
    return found.select(F.col("scope").alias("binary_id"), F.col("node").alias("address"), "below")


def p1_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Depth and top function of each function."""
    return _tree(spark, sf).select(F.col("scope").alias("binary_id"), F.col("node").alias("address"), "depth", "top", "in_cycle")


def _synthesis_items(spark: SparkSession, sf: str) -> DataFrame:
    answers = (
        table(spark, sf, "synthesis")
        .where("synth_id IS NOT NULL AND raw IS NOT NULL")
        .select("synth_id", "raw")
        .distinct()
    )
    return nested.explode_levels(nested.find_member(nested.parse_answers(answers, "synth_id", "raw"), "structs"), "fields")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    keys = lambda df, kind, path: df.select(F.lit(kind).alias("kind"), F.col("record").alias("record_id"), path.alias("path"))
    signatures = table(spark, sf, "signatures").select("sig_id", F.col("indicators.constants").alias("constants"))
    return (
        keys(_synthesis_items(spark, sf), "synthesis", F.col("path"))
        .unionByName(keys(nested.array_items(table(spark, sf, "proposals"), "proposal_id", "fields"), "proposal", F.col("pos").cast("string")))
        .unionByName(keys(nested.array_items(signatures, "sig_id", "constants"), "signature", F.col("pos").cast("string")))
        .distinct()
    )


def _flat(items: DataFrame, names: list[str], numbers: list[str], keys: list[str]) -> DataFrame:
    """The items' flat table: keys, names, numbers, and all further members that any item has."""
    flat = nested.flat_table(items, [*names, *numbers], "fields").withColumnRenamed("record", "synth_id")
    rest = [c for c in flat.columns if c not in [*names, *numbers, "synth_id", "level", "parent", "pos", "path"]]
    return flat.select("synth_id", *keys, *names, *[nested.number(F.col(n)).alias(n) for n in numbers], *[F.col(f"`{c.replace('`', '``')}`") for c in rest]).distinct()


def p3_structs(spark: SparkSession, sf: str) -> DataFrame:
    """The structs of all syntheses: the top level's flat table, with the columns of the merged schema."""
    return _flat(_synthesis_items(spark, sf).where("level = 0"), ["name"], ["total_size"], ["path", "pos"])


def p3_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of all syntheses at any depth, each with its parent's key, with the columns of the merged schema."""
    return _flat(_synthesis_items(spark, sf).where("level > 0"), ["name", "data_type"], ["offset", "size"], ["parent", "path", "level", "pos"])


def p3_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The items of all other lists in structs and fields, each with the path of its struct or field and its place; objects as JSON."""
    tables = nested.list_tables(_synthesis_items(spark, sf), "fields")
    rows = [t.select(F.col("record").alias("synth_id"), F.lit(n).alias("list"), "parent", "pos", F.try_variant_get("item", "$", "string").alias("value")) for n, t in sorted(tables.items())]
    none = spark.createDataFrame([], "synth_id long, list string, parent string, pos int, value string")
    return reduce(DataFrame.unionByName, rows, none).distinct()


def p3_constants(spark: SparkSession, sf: str) -> DataFrame:
    """The constants of all signatures, one row each."""
    src = table(spark, sf, "signatures").select("sig_id", F.col("indicators.constants").alias("constants"))
    return nested.array_items(src, "sig_id", "constants", "constant").select(F.col("record").alias("sig_id"), "pos", "constant")


def p3_proposal_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of all struct proposals, one row each."""
    got = nested.array_items(table(spark, sf, "proposals"), "proposal_id", "fields", "f")
    return got.select(F.col("record").alias("proposal_id"), "pos", "f.name", "f.data_type", "f.offset", "f.size")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys(table(spark, sf, "call_edges"), "callee", "edge_id", HEAVY_SHARE).select("callee")


def p4_callers(spark: SparkSession, sf: str) -> DataFrame:
    return key_profile(
        table(spark, sf, "call_edges"),
        ["callee"],
        {"n_edges": ["edge_id"], "n_callers": ["binary_id", "caller"]},
        latest={"last_seen": "seen_at"},
        modes={"main_ref_type": "ref_type"},
    )


QUERIES = {"p1_found": p1_found, "p1_tree": p1_tree, "p1_cycles": p1_cycles, "p1_below": p1_below, "p3_found": p3_found, "p3_structs": p3_structs, "p3_fields": p3_fields, "p3_lists": p3_lists, "p3_constants": p3_constants, "p3_proposal_fields": p3_proposal_fields, "p4_found": p4_found, "p4_callers": p4_callers}

_P1 = """
        WITH RECURSIVE nodes AS (
            SELECT DISTINCT binary_id AS b, address AS v FROM call_graph WHERE binary_id IS NOT NULL AND address IS NOT NULL),
        listed AS (
            SELECT binary_id AS b, unnest(callers) AS u, address AS v FROM call_graph
            UNION SELECT binary_id, address, unnest(callees) FROM call_graph),
        e AS (
            SELECT l.b, l.u, l.v FROM listed l JOIN nodes x ON x.b = l.b AND x.v = l.u JOIN nodes y ON y.b = l.b AND y.v = l.v),
        reach AS (
            SELECT b, u, v FROM e UNION SELECT r.b, r.u, e.v FROM reach r JOIN e ON e.b = r.b AND e.u = r.v),
        mutual AS (
            SELECT a.b, a.u AS v, min(a.v) AS m FROM reach a JOIN reach c ON c.b = a.b AND c.u = a.v AND c.v = a.u GROUP BY a.b, a.u),
        step AS (
            SELECT n.b, n.v, coalesce(m.m, n.v) AS s, m.m IS NOT NULL AS in_cycle,
                   CASE WHEN m.m IS NULL THEN '' ELSE '@' END || coalesce(m.m, n.v) AS name
            FROM nodes n LEFT JOIN mutual m ON m.b = n.b AND m.v = n.v),
        above AS (
            SELECT DISTINCT r.b, y.s, x.s AS up, x.name FROM reach r JOIN step x ON x.b = r.b AND x.v = r.u JOIN step y ON y.b = r.b AND y.v = r.v
            WHERE x.s <> y.s),
        deep AS (SELECT s.b, s.s, s.name, (SELECT count(*) FROM above a WHERE a.b = s.b AND a.s = s.s) AS depth
                 FROM (SELECT DISTINCT b, s, name FROM step) s),
        paths AS (
            SELECT d.b, d.s, d.depth, coalesce(string_agg(a.name, '/' ORDER BY u.depth) || '/', '') || d.name AS path,
                   coalesce(arg_min(a.up, u.depth), d.s) AS top
            FROM deep d LEFT JOIN above a ON a.b = d.b AND a.s = d.s LEFT JOIN deep u ON u.b = a.b AND u.s = a.up
            GROUP BY d.b, d.s, d.depth, d.name)"""

_P3 = """
        WITH RECURSIVE body AS (
            SELECT DISTINCT synth_id, regexp_extract(raw, '(?s)[\\[{].*[\\]}]')::JSON AS j FROM synthesis WHERE raw IS NOT NULL),
        top AS (
            SELECT synth_id, CASE WHEN json_exists(j, '$.structs') THEN json_extract(j, '$.structs') ELSE json_extract(j, '$.synthesis.structs') END AS n
            FROM body),
        opened AS (
            SELECT synth_id, CASE WHEN json_type(n) = 'VARCHAR' THEN json_extract_string(n, '$')::JSON ELSE n END AS n FROM top),
        items AS (
            SELECT synth_id, NULL::VARCHAR AS parent, 0 AS level, i AS pos, i::VARCHAR AS path,
                   CASE WHEN json_type(n) = 'OBJECT' THEN n ELSE json_extract(n, '$[' || i || ']') END AS item
            FROM (SELECT *, unnest(range(CASE json_type(n) WHEN 'ARRAY' THEN json_array_length(n)::BIGINT WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS i FROM opened)
            UNION ALL
            SELECT synth_id, path, level + 1, i, path || '.' || i,
                   CASE WHEN json_type(f) = 'OBJECT' THEN f ELSE json_extract(f, '$[' || i || ']') END
            FROM (SELECT *, unnest(range(CASE json_type(f) WHEN 'ARRAY' THEN json_array_length(f)::BIGINT WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS i
                  FROM (SELECT *, json_extract(item, '$.fields') AS f FROM items))),
        full_items AS (
            SELECT DISTINCT * FROM items WHERE item IS NOT NULL AND json_type(item) <> 'NULL' AND item::VARCHAR NOT IN ('{}', '[]', '""')),
        got AS (SELECT *, json_extract_string(item, '$.offset') AS o, json_extract_string(item, '$.size') AS z,
                       json_extract_string(item, '$.total_size') AS ts FROM full_items)"""

_P3_LISTS = """
        SELECT DISTINCT proposal_id, i - 1 AS pos, f FROM (
            SELECT proposal_id, generate_subscripts(fields, 1) AS i, unnest(fields) AS f FROM proposals) WHERE f IS NOT NULL"""

_P3_CONSTANTS = """
        SELECT DISTINCT sig_id, i - 1 AS pos, c AS constant FROM (
            SELECT sig_id, generate_subscripts(indicators.constants, 1) AS i, unnest(indicators.constants) AS c FROM signatures)
        WHERE c IS NOT NULL AND trim(c) <> ''"""

_NUMBER = "CASE WHEN {0} ILIKE '0x%' OR regexp_matches({0}, '^[+-]?[0-9]+$') THEN {0}::BIGINT END"

SQL = {
    "p3_found": _P3 + f"""
        SELECT 'synthesis' AS kind, synth_id AS record_id, path FROM full_items
        UNION ALL SELECT 'proposal', proposal_id, pos::VARCHAR FROM ({_P3_LISTS})
        UNION ALL SELECT 'signature', sig_id, pos::VARCHAR FROM ({_P3_CONSTANTS})""",
    "p3_structs": _P3 + f"""
        SELECT synth_id, path, pos::INT AS pos, json_extract_string(item, '$.name') AS name, {_NUMBER.format("ts")} AS total_size FROM got WHERE level = 0""",
    "p3_fields": _P3 + f"""
        SELECT synth_id, parent, path, level, pos::INT AS pos, json_extract_string(item, '$.name') AS name,
               json_extract_string(item, '$.data_type') AS data_type, {_NUMBER.format("o")} AS "offset", {_NUMBER.format("z")} AS size, json_extract_string(item, '$.notes.weight') AS "notes.weight"
        FROM got WHERE level > 0""",
    "p3_lists": _P3 + """
        SELECT DISTINCT synth_id, 'notes.seen_in' AS list, path AS parent, i::INT AS pos, json_extract_string(item, '$.notes.seen_in[' || i || ']') AS value
        FROM (SELECT *, unnest(range(coalesce(json_array_length(item, '$.notes.seen_in'), 0)::BIGINT)) AS i FROM full_items) WHERE trim(value) <> ''""",
    "p3_constants": f"SELECT sig_id, pos::INT AS pos, constant FROM ({_P3_CONSTANTS})",
    "p3_proposal_fields": f'''SELECT proposal_id, pos::INT AS pos, f.name, f.data_type, f."offset", f.size FROM ({_P3_LISTS})''',
    "p1_found": _P1 + """
        SELECT s.b AS binary_id, s.v AS address, p.path FROM step s JOIN paths p ON p.b = s.b AND p.s = s.s""",
    "p1_tree": _P1 + """
        SELECT s.b AS binary_id, s.v AS address, p.depth::INT AS depth, p.top, s.in_cycle
        FROM step s JOIN paths p ON p.b = s.b AND p.s = s.s""",
    "p1_cycles": _P1 + """
        SELECT b AS binary_id, s AS cycle, v AS address FROM step WHERE in_cycle""",
    "p1_below": _P1 + """
        SELECT r.b AS binary_id, r.u AS address, r.v AS below FROM reach r
        JOIN step x ON x.b = r.b AND x.v = r.u JOIN step y ON y.b = r.b AND y.v = r.v WHERE x.s <> y.s""",
    "p4_found": """
        SELECT callee FROM call_edges WHERE callee IS NOT NULL
        GROUP BY callee HAVING count(*) >= 0.02 * (SELECT count(*) FROM call_edges)""",
    "p4_callers": """
        WITH mode AS (
            SELECT callee, ref_type AS main_ref_type FROM (
                SELECT callee, ref_type, row_number() OVER (PARTITION BY callee ORDER BY count(*) DESC, ref_type) AS rn
                FROM call_edges WHERE callee IS NOT NULL AND ref_type IS NOT NULL GROUP BY callee, ref_type)
            WHERE rn = 1)
        SELECT e.*, main_ref_type FROM (
            SELECT callee, count(*) AS n_rows, count(DISTINCT edge_id) AS n_edges,
                   count(DISTINCT CASE WHEN binary_id IS NOT NULL AND caller IS NOT NULL
                                       THEN binary_id || '/' || caller END) AS n_callers,
                   max(seen_at) AS last_seen
            FROM call_edges WHERE callee IS NOT NULL GROUP BY callee) e
        LEFT JOIN mode m ON e.callee = m.callee""",
}

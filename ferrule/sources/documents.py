"""Readers and writers of the analysis formats: result documents, signature files, address lists, C sources, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import parsing

ANALYSIS = """struct<binary: struct<name: string>, stats: map<string, string>,
    functions: array<struct<address: string, original_name: string, name: string, signature: string, confidence: int>>,
    call_graph: struct<edges: array<array<string>>>>"""
SIGNATURES = "name string, aliases array<string>, description string, signature string, indicators struct<constants: array<string>, patterns: array<string>, strings: array<string>>"


def read_analyses(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """(file, doc): one row for each analysis document, a file or (not wholetext) a line; what isn't JSON has a null doc."""
    text = spark.read.text(path, wholetext=wholetext).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.from_json("value", ANALYSIS).alias("doc"))


def analysis_functions(docs: DataFrame) -> DataFrame:
    """(file, address, original_name, name, signature, confidence); rows whose address can't be read are left out."""
    f = docs.select("file", F.explode("doc.functions").alias("f"))
    return f.select("file", parsing.address(F.col("f.address")).alias("address"), "f.original_name", "f.name", "f.signature", "f.confidence").where("address IS NOT NULL")


def analysis_edges(docs: DataFrame) -> DataFrame:
    """(file, caller, callee) of the well-formed pairs."""
    e = docs.select("file", F.explode("doc.call_graph.edges").alias("e")).where(F.size("e") == 2)
    return e.select("file", parsing.address(F.col("e")[0]).alias("caller"), parsing.address(F.col("e")[1]).alias("callee")).where(
        "caller IS NOT NULL AND callee IS NOT NULL"
    )


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Signature files, one JSON list each; category is the file's stem."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.schema(SIGNATURES).option("multiLine", True).json(path).withColumn("category", stem)


def address_selection(lines: DataFrame, column: str = "value") -> DataFrame:
    """Addresses of a selection: comments after # dropped, fields at commas, the first word of each; bad ones raise an error."""
    field = F.explode(F.split(F.regexp_replace(column, "#.*", ""), ",")).alias("field")
    word = F.regexp_extract(F.trim("field"), r"^(\S+)", 1)
    known = lines.select(field).where(F.trim("field") != "").select(word.alias("word")).withColumn("address", parsing.address(F.col("word")))
    return known.select(F.coalesce("address", F.raise_error(F.concat(F.lit("no address: "), "word")).cast("bigint")).alias("address")).distinct()


#: The types are one run of signs in which no word begins with a digit: repeated groups would overflow the stack on long lines of prose.
C_FUNCTION = r"(?m)^(?:static[ \t]+)?(?=[A-Za-z_])(?![\w \t*]*[ \t*]\d\w*[ \t*]+\w)([\w \t*]*[ \t*])(\w+)[ \t]*\(([^(){};]*)\)\s*\{"
CONTROL = ["if", "for", "while", "switch", "return", "sizeof", "else", "do"]


def c_functions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, name, signature) of the function definitions in C sources, in order."""
    names, types, params = (F.regexp_extract_all(text, F.lit(C_FUNCTION), g) for g in (2, 1, 3))
    rows = texts.select(key, F.posexplode(F.arrays_zip(names.alias("n"), types.alias("t"), params.alias("p"))).alias("pos", "f"))
    sig = F.concat(F.trim("f.t"), F.lit(" "), F.col("f.n"), F.lit("("), F.trim("f.p"), F.lit(")"))
    return rows.where(~F.col("f.n").isin(CONTROL)).select(key, "pos", F.col("f.n").alias("name"), sig.alias("signature"))


def export_rows(results: DataFrame) -> DataFrame:
    """(binary_id, address, json): each finished result as one JSON object, ready for a sorted text write."""
    good = results.where("NOT coalesce(skipped, false) AND coalesce(error, '') = ''")
    body = F.to_json(F.struct(F.format_string("0x%08x", "address").alias("address"), "original_name", "name", "signature", "confidence", "classification", "comments"))
    return good.select("binary_id", "address", body.alias("json"))


def write_export(results: DataFrame, path: str) -> None:
    """JSON lines in folders by binary, sorted by address inside; ranges spread a large binary over several files."""
    rows = export_rows(results)
    rows.repartitionByRange("binary_id", "address").sortWithinPartitions("binary_id", "address").select("binary_id", "json").write.partitionBy("binary_id").mode("overwrite").text(path)


def log_line(at: Column, level: Column, kind: Column, message: Column, error: Column) -> Column:
    """`time LEVEL kind message`, with the error appended where the message doesn't have it."""
    base = F.concat_ws(" ", F.date_format(at, "yyyy-MM-dd HH:mm:ss"), level, kind, message)
    return F.when((F.coalesce(error, F.lit("")) != "") & (F.instr(message, error) == 0), F.concat(base, F.lit(": "), error)).otherwise(base)


#: Where a text is split into exported functions, and a comment in front of a body: the tags, then the brief as prose.
BLOCK, LEADING = r"(?md)^(?=/\*\*$)", r"(?s)\A\s*/\*.*?\*/\s*"
# fixed values: the format of placeholder names; a call is a C name and a parenthesis
CALL, PLACEHOLDER = r"([A-Za-z_][A-Za-z0-9_]*)\s*\(", r"^(?:thunk_)?FUN_([0-9a-fA-F]{8})$"


def source_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, text): the exported functions of each text, which begin at lines `/**`; a text without such a line is one block."""
    return texts.select(F.col(key).alias("key"), F.posexplode(F.split(text, BLOCK)).alias("block", "text"))


def source_edges(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (caller, callee) addresses recovered from exported functions, one or more in each text.

    The comment's @name and @address tell the caller, names before `(` in the body the callees: a known name's address
    (the last function with it), else the address in a placeholder name; other names are dropped. Recursion stays. The
    body begins at the first brace behind the two leading comments.
    """
    head = F.regexp_extract("text", r"@address\s+(0x[0-9a-fA-F]+)", 1)
    own = F.regexp_extract("text", r"@name\s+(\S+)", 1)
    body = F.regexp_extract(F.regexp_replace(F.regexp_replace("text", LEADING, ""), LEADING, ""), r"(?s)\{(.*)$", 1)
    rows = source_blocks(texts, key, text).select("key", "block", own.alias("name"), parsing.address(head).alias("caller"), F.array_distinct(F.regexp_extract_all(body, F.lit(CALL), F.lit(1))).alias("called"))
    rows = rows.where("caller IS NOT NULL AND name <> ''")
    known = rows.groupBy(F.col("name").alias("callee_name")).agg(F.max(F.struct("key", "block", "caller"))["caller"].alias("known"))
    calls = rows.select("caller", F.explode("called").alias("callee_name")).where(~F.col("callee_name").isin(CONTROL)).distinct()
    digits = F.regexp_extract("callee_name", PLACEHOLDER, 1)
    placeholder = F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))
    return calls.join(known, "callee_name", "left").select("caller", F.coalesce("known", placeholder).alias("callee")).where("callee IS NOT NULL").distinct()

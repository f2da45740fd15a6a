from pyspark.sql import functions as F

from ferrule.functions import code, names, parsing
from ferrule.operators import ranges, reach, review
from ferrule.plans import reference
from ferrule.sources import documents as io
from ferrule.streaming import folds


def values(spark, column, *rows, ddl="a string"):
    return [r.x for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl).select(column.alias("x")).collect()]


def test_names(spark):
    assert values(spark, names.is_generic(F.col("a")), "FUN_1", " ", None, "Helper", "parse_block") == [True, True, True, True, False]
    acc = names.symbol_accuracy(F.col("a"), F.col("b"))
    pairs = [("x", "x"), ("init_key", "key_init"), ("linked_list_search", "linked_list_find"), ("foo", "bar"), ("", "bar"), ("readNode", "read_list_of_node")]
    assert [round(v, 4) for v in values(spark, acc, *pairs, ddl="a string, b string")] == [1.0, 0.9, 0.8, 0.0, 0.0, round(0.7 * 2 / 3, 4)]


def test_parsing(spark):
    assert values(spark, parsing.address(F.col("a")), "0x10", "48", "00105300", "beef", "zz", None, "") == [16, 48, 0x105300, 0xBEEF, None, None, None]
    assert values(spark, parsing.confidence(F.col("a")), "85%", "0.5", "0.125", "120", "-3", "high", None, "2.5") == [85, 50, 12, 100, 0, 0, 0, 2]
    assert values(spark, parsing.strip_fences(F.col("a")), "```json\n{}\n```", " x ", "```\nopen") == ["{}", "x", "```\nopen"]
    s = parsing.signature(F.col("a"))
    got = values(spark, s, "void *f(int a, void (*cb)(int, int));", "int g(void)", "int h()", "int k(char *f, ...)", "nonsense", None)
    assert [(g.name, g.n_params, g.variadic, g.unspecified) if g else None for g in got] == [
        ("f", 2, False, False), ("g", 0, False, False), ("h", 0, False, True), ("k", 1, True, False), None, None,
    ]


def test_code(spark):
    flat = "while (true) {\n switch(s) {\n" + "".join(f"case {i}:\n" for i in range(4)) + "}}"
    assert values(spark, code.obfuscation(F.col("a")), flat, flat + "case 0x4:\n" * 12 + "\n" * 200 + "x", "plain", None) == [
        ["control_flow_flattening"], ["control_flow_flattening", "vm_protection"], [], None,
    ]
    assert values(spark, code.crypto_algorithms(F.col("a")), "0x9E3779B9", "0x63, 0x7c", "") == [["TEA delta"], ["AES S-box"], []]
    assert values(spark, code.negative_literals(F.col("a")), "x + -5", "x + -0x1a", "x - 5") == ["x - 5", "x - 0x1a", "x - 5"]


def test_ranges(spark):
    f = spark.createDataFrame([(1, 0, 10), (1, 8, 10000), (2, 5, 0), (1, None, 4)], "b long, address long, size int")
    p = spark.createDataFrame([(1, 9), (1, 10), (1, 10007), (1, 10008), (2, 5), (1, None)], "b long, at long")
    got = sorted((r.at, r.address) for r in ranges.contained(p, f, ["b"], "at", "address", "size", cell=16).collect())
    assert got == [(9, 0), (9, 8), (10, 8), (10007, 8)]
    df = spark.createDataFrame([(k, i, i % 3) for k in (1, 2) for i in range(40)], "k int, i int, v int")
    got = {(r.k, r.i): r.s for r in ranges.running_total(df, ["k"], "i", F.col("v"), "s", 7).collect()}
    assert got == {(k, i): sum(j % 3 for j in range(i + 1)) for k in (1, 2) for i in range(40)}
    d = spark.createDataFrame([("n700", "x" * 700), ("n0", ""), ("null", None), ("n5", "abcde")], "k string, t string")
    assert sorted(tuple(r) for r in ranges.byte_windows(d, "k", "t").collect()) == [("n5", 0, 5), ("n700", 0, 512), ("n700", 256, 444)]
    assert sorted(tuple(r) for r in ranges.byte_windows(d, "k", "t", keep_tail=False).collect()) == [("n5", 0, 5), ("n700", 0, 512)]


def test_unify_and_stats(spark):
    ddl = "proposal_id long, binary_id long, name string, total_size int, fields array<struct<name:string,data_type:string,offset:int,size:int>>"
    rows = [(1, 1, "s", 24, [("field_0", "undefined4", 0, 4), ("len", "int", 8, 4)]), (2, 1, "s", 64, [("count", "int", 0, 4), (None, None, 8, None)]), (3, 1, "t", None, None)]
    got = sorted((r.name, r.size, r.offset, r.field) for r in review.unify_structs(spark.createDataFrame([*rows, rows[0]], ddl)).collect())
    assert got == [("s", 64, 0, "count"), ("s", 64, 8, "len")]


def test_io(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"binary":{"name":"b"},"functions":[{"address":"0x10","name":"f","confidence":3},{"address":"??"}],"call_graph":{"edges":[["0x10","20"],["1"]]}}')
    (tmp_path / "b.json").write_text("broken")
    docs = io.read_analyses(spark, str(tmp_path))
    assert [(r.address, r.name) for r in io.analysis_functions(docs).collect()] == [(16, "f")]
    assert [(r.caller, r.callee) for r in io.analysis_edges(docs).collect()] == [(16, 20)]
    lines = spark.createDataFrame([("0x10, 20 name # note",), ("# only",), ("",)], "value string")
    assert sorted(r.address for r in io.address_selection(lines).collect()) == [16, 20]
    src = spark.createDataFrame([(1, "static int f(int a)\n{\n if (x) {}\n}\nchar *g(void)\n{ }\n")], "id int, t string")
    assert [(r.name, r.signature) for r in io.c_functions(src, "id", "t").collect()] == [("f", "int f(int a)"), ("g", "char * g(void)")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2025-01-01 {i % 5:02d}:10:00", "click" if i % 2 else "view", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("t")).drop("t")
    df.write.parquet(str(tmp_path / "events"))
    stream = folds.drain(spark, str(tmp_path / "events"), folds.hourly_counts, df.schema)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, folds.hourly_counts(df).collect()))


def test_types(spark):
    pairs = [("void foo(undefined4 x)", "void foo(int x)"), ("int f(void)", "int f()"), ("void f(int a)", "int f(int a, char *b)"), ("x", "x")]
    got = values(spark, F.round(parsing.type_accuracy(F.col("a"), F.col("b")), 4), *pairs, ddl="a string, b string")
    assert got == [1.0, 1.0, 0.15, 1.0]
    assert values(spark, parsing.plain_type(F.col("a")), "const unsigned  char *", "undefined8 * *", "uint") == ["char *", "undefined8 * *", "int"]


def test_chains(spark):
    links = [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 2, 4), (2, 0, 1), (2, 1, 0), (3, 5, 5), (3, 5, 6)]
    nodes = spark.createDataFrame(sorted({(s, x) for s, a, c in links for x in (a, c)}), "scope long, node long")
    got = reach.chains(nodes, spark.createDataFrame(links, "scope long, above long, below long")).collect()
    assert sorted((r.scope, r.chain, r.pos, r.node) for r in got) == [(1, 0, 0, 0), (1, 0, 1, 1), (1, 0, 2, 2)]


def test_source_edges(spark):
    text = "/**\n * @name %s\n * @address %s\n */\nint %s(void)\n{\n  %s\n}"
    rows = [
        (1, text % ("a", "0x10", "a", "b(); if (x) { b(1); } FUN_0045f2c0(); gone();")), (2, text % ("b", "0x20", "b", "b(); thunk_FUN_00456700();")), (3, "prose a()"), (4, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in io.source_edges(df, "doc_id", "text").collect()) == [(16, 32), (16, 0x45F2C0), (32, 32), (32, 0x456700)]


def test_runs_and_scores(spark):
    df = spark.createDataFrame([("a", "122200120110"), ("b", "222"), ("c", ""), ("d", None)], "k string, l string")
    assert sorted(tuple(r) for r in ranges.label_runs(df, "k", F.col("l")).collect()) == [("a", 0, 4), ("a", 6, 8), ("a", 9, 10), ("a", 10, 11)]
    rows = spark.createDataFrame([(1, "x", "x"), (1, "x", "y"), (1, None, "x"), (1, "z", None)], "g int, t string, p string")
    got = {r.label: (r.tp, r.fp, r.fn, r.f1) for r in ranges.class_scores(rows, ["g"], "t", "p").collect()}
    assert got == {"x": (1, 0, 1, 2 / 3), "y": (0, 1, 0, 0.0), "z": (0, 0, 1, 0.0)}


def test_source_edges_of_several_functions(spark):
    block = "/**\n * @name %s\n * @brief not {gone()\n * @address %s\n */\nint %s(void)\n{\n  %s\n}\n\n"
    rows = [(1, block % ("a", "0x10", "a", "c();") + block % ("b", "0x20", "b", "a();")), (2, block % ("c", "0x30", "c", "b();") + block % ("gone", "0x40", "gone", ""))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in io.source_edges(df, "doc_id", "text").collect()) == [(16, 48), (32, 16), (48, 32)]


def test_answers_by_address(spark):
    rows = [
        (1, 1, 16, 1, '{"address": "48", "name": "own"}'), (2, 1, None, 2, 'So:\n```json\n[{"address": "0x10", "name": "a"}, {"address": 32}, {"address": "0x20"}, {"address": 0}, {}, 7,]\n```'),
        (3, 1, None, 1, '[{"address": "0x20"}, {"address": "64"}]'), (4, 1, None, 3, "no json"), (5, 2, None, 3, '{"address": "00000010"}'), (6, 2, 20, 1, None), (7, 2, None, 1, None),
    ]
    df = spark.createDataFrame(rows, "response_id long, binary_id long, address long, received_at int, raw string")
    got = sorted((r.binary_id, r.address, r.response_id, r.pos) for r in review.answers_by_address(df).collect())
    assert got == [(1, 16, 2, 0), (1, 32, 2, 2), (1, 64, 3, 1), (2, 16, 5, 0), (2, 20, 6, -1)]
    assert review.answers_by_address(df.limit(0)).count() == 0


def test_c_functions_of_any_language(spark, tmp_path):
    code = "static int f(int a)\n{\n}\n"
    rows = [(1, code, "c"), (2, code, None), (3, code, "de"), (4, "word " * 50000 + "{(\nunsigned long *g(void) {}\nint 3x h(int a) {}", "en"), (5, None, "c"), (6, "no code", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in reference.s16_c_functions(spark, str(tmp_path)).collect())
    assert got == [(1, "f", "int f(int a)"), (2, "f", "int f(int a)"), (3, "f", "int f(int a)"), (4, "g", "unsigned long * g(void)")]


def test_saved_documents_drop_malformed_pairs(spark, tmp_path):
    lines = ['{"binary":{"name":"7"},"call_graph":{"edges":[["0x10","0x20"],["0x10"],[null,"0x20"],["0x10","0x20","0x30"],["x","0x20"]]}}', '{"functions":[{"address":"0x10","name":"f"},{"address":"?"}]}', "no json", ""]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "saved"))
    found = io.read_analyses(spark, str(tmp_path / "saved"), wholetext=False)
    assert [(r.caller, r.callee) for r in io.analysis_edges(found).collect()] == [(16, 32)]
    assert [(r.address, r.name) for r in io.analysis_functions(found).collect()] == [(16, "f")]

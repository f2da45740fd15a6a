import json

from pyspark.sql import functions as F

from ferrule.operators import nested, skew


def items(spark, raws):
    df = spark.createDataFrame([(i, r, "extra") for i, r in enumerate(raws)], "synth_id long, raw string, item string")
    found = nested.find_member(nested.parse_answers(df, "synth_id", "raw"), "structs")
    return nested.explode_levels(found, "fields")


def test_any_shape(spark):
    one = {"structs": [{"name": "a", "fields": [{}, {"name": "x", "fields": [None, {"name": "y"}]}]}, None, {"name": "b", "fields": None}]}
    raws = [
        json.dumps(one), "```json\n" + json.dumps({"synthesis": one}) + "\n```", json.dumps({"structs": json.dumps(one["structs"])}),
        json.dumps({"structs": {"name": "s", "fields": {"name": "f"}}}), None, "", "no json", '{"structs": [', "[]", "12",
        json.dumps({"structs": []}), json.dumps(one["structs"]), "Sure: " + json.dumps(one), json.dumps({"structs": ["", "  ", "plain", [], {"path": 1}]}),
    ]
    got = items(spark, raws)
    paths = {}
    for r in got.collect():
        paths.setdefault(r.record, []).append(r.path)
        assert (r.parent is None) == (r.level == 0) and r.path.split(".")[-1] == str(r.pos)
    full = sorted(["0", "0.1", "0.1.1", "2"])
    assert {k: sorted(v) for k, v in paths.items()} == {0: full, 1: full, 2: full, 3: ["0", "0.0"], 11: full, 12: full, 13: ["2", "4"]}
    flat = nested.flat_table(got.where("record = 13 AND pos = 4")).collect()
    assert flat[0].item_path == "1" and flat[0].path == "4"
    assert set(nested.merged_schema(got.where("record = 0"))) == {"name", "fields"}


def test_empty_tables(spark):
    assert items(spark, []).count() == 0
    assert nested.merged_schema(items(spark, [])) == {}
    empty = spark.createDataFrame([], "sig_id long, constants array<string>")
    assert nested.array_items(empty, "sig_id", "constants").count() == 0


def test_array_items(spark):
    rows = [(1, ["a", None, "", "  ", "b"]), (1, ["a", None, "", "  ", "b"]), (2, None), (3, []), (None, ["z"])]
    df = spark.createDataFrame(rows, "sig_id long, constants array<string>")
    assert sorted((r.record, r.pos, r["item"]) for r in nested.array_items(df, "sig_id", "constants").collect()) == [(1, 0, "a"), (1, 4, "b")]
    structs = spark.createDataFrame([(1, [(None, None), ("x", None)])], "id long, f array<struct<record:string,pos:int>>")
    assert [r.pos for r in nested.array_items(structs, "id", "f").collect()] == [1]


def test_profile_against_brute_force(spark):
    rows = [(1, i % 50, i % 7, i % 3 or None) for i in range(300)] + [(2, None, 1, None), (None, 1, 1, 1), (3, 9, None, 5), (3, 9, None, 5)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k long, v long, w long, t long, n_rows int")
    got = {r.k: r for r in skew.key_profile(df, ["k"], {"nv": ["v"], "nvw": ["v", "w"]}, {"top": "t"}, {"mode": "w"}).collect()}
    for k in (1, 2, 3):
        mine = [r for r in rows if r[0] == k]
        assert got[k].n_rows == len(mine)
        assert got[k].nv == len({r[1] for r in mine} - {None})
        assert got[k].nvw == len({(r[1], r[2]) for r in mine if None not in (r[1], r[2])})
        assert got[k].top == max((r[3] for r in mine if r[3] is not None), default=None)
        ws = [r[2] for r in mine if r[2] is not None]
        assert got[k].mode == (min(set(ws), key=lambda w: (-ws.count(w), w)) if ws else None)
    assert {r.k for r in skew.heavy_keys(df, "k", "v", 0.02).collect()} == {1}
    assert {r.k for r in skew.heavy_keys(df, "k", "v", 2 / 304).collect()} == {1, 3}
    none = df.where("false")
    assert skew.heavy_keys(none, "k", "v", 0.02).count() == 0
    assert skew.key_profile(none, ["k"], {"nv": ["v"]}).count() == 0


def test_list_items_and_repair(spark):
    raws = ['[{"a": 1}, 2]', '{"a": [1, 2,],}', "x", None, "", 'so:\n```json\n{"a": "b,}"}\n```', "7", "[]"]
    df = spark.createDataFrame(list(enumerate(raws)), "i long, raw string")
    plain = {r.record for r in nested.parse_answers(df, "i", "raw").where("answer IS NOT NULL").collect()}
    assert plain == {0, 5, 6, 7}
    items = nested.list_items(nested.parse_answers(df, "i", "raw", repair=True), "answer", ["record"])
    got = items.select("record", "pos", F.to_json("value").alias("v")).collect()
    assert sorted((r.record, r.pos, r.v) for r in got) == [(0, 0, '{"a":1}'), (0, 1, "2"), (1, 0, '{"a":[1,2]}'), (5, 0, '{"a":"b,}"}')]


def test_all_members_reach_a_table(spark):
    field = {"name": "x", "size": 4, "notes": {"seen_in": ["f", "", "g"], "weight": 0.5, "by": [{"who": "a", "tags": ["t"]}]}, "grid": [[1, 2], [3]]}
    got = items(spark, [json.dumps({"structs": [{"name": "s", "fields": [{"name": "y", "notes": {}}, field]}]}), json.dumps({"structs": [{"name": "t", "mixed": 1}, {"mixed": ["u"]}]})])
    fields = nested.flat_table(got.where("level > 0"), ["name", "offset"], "fields")
    assert fields.columns == ["record", "level", "parent", "pos", "path", "name", "offset", "notes.weight", "size"]
    assert [r["notes.weight"] for r in fields.orderBy("pos").collect()] == [None, "0.5"]
    structs = nested.flat_table(got.where("level = 0"), child_key="fields")
    assert structs.columns[5:] == ["mixed", "name"] and sorted(str(r.mixed) for r in structs.collect()) == ["1", "None", "None"]
    tables = nested.list_tables(got, "fields")
    seen = {n: sorted((r.record, r.parent, r.pos, r.v) for r in t.select("record", "parent", "pos", F.to_json("item").alias("v")).collect()) for n, t in tables.items()}
    assert seen == {
        "notes.seen_in": [(0, "0.1", 0, '"f"'), (0, "0.1", 2, '"g"')], "notes.by": [(0, "0.1", 0, '{"tags":["t"],"who":"a"}')], "notes.by[].tags": [(0, "0.1.0", 0, '"t"')],
        "grid": [(0, "0.1", 0, "[1,2]"), (0, "0.1", 1, "[3]")], "grid[]": [(0, "0.1.0", 0, "1"), (0, "0.1.0", 1, "2"), (0, "0.1.1", 0, "3")], "mixed": [(1, "1", 0, '"u"')],
    }

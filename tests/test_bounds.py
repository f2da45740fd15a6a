"""Cases that a limit used to lose: deep wrappers, long numbers, wide ranges, late files, missing times."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ferrule import session
from ferrule.functions import parsing
from ferrule.operators import nested, ranges
from ferrule.streaming import folds


def test_wrappers_of_any_depth(spark):
    rows = []
    for depth in range(9):
        inner = {"structs": [{"name": f"s{depth}"}]}
        for level in range(depth):
            inner = {"answer": inner} if level % 3 else ([inner] if level else {"text": json.dumps(inner)})
        rows.append((depth, json.dumps(inner)))
    rows += [(20, json.dumps({"out": "```json\n" + json.dumps({"structs": [{"name": "s20"}]}) + "\n```"}))]
    rows += [(21, json.dumps({"out": json.dumps(json.dumps({"structs": [{"name": "s21"}]}))})), (22, '{"note": "see [1] and {x}"}'), (23, None), (24, "")]
    answers = nested.parse_answers(spark.createDataFrame(rows, "id long, raw string"), "id", "raw")
    items = nested.explode_levels(nested.find_member(answers, "structs"), "fields")
    got = {r.record: r["name"] for r in nested.flat_table(items, ["name"], "fields").collect()}
    assert got == {i: f"s{i}" for i in [*range(9), 20, 21]}


def test_long_numbers(spark):
    texts = ["0x7fffffffffffffff", "0xffffffffffffffff", "9223372036854775807", "9223372036854775808", "0x1", "-5", "", None, "12ab"]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(nested.number(F.col("t")).alias("n")).collect()]
    assert got == [2**63 - 1, None, 2**63 - 1, None, 1, -5, None, None, None]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(parsing.address(F.col("t")).alias("n")).collect()]
    assert got == [2**63 - 1, None, 2**63 - 1, None, 1, None, None, None, 0x12AB]


def test_painted_against_bytes(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 300), rng.choice([None, 0, 1, 7, 40, 200])) for k in range(3) for _ in range(25)] + [(9, 5, 3_000_000_000), (9, 10, 4)]
    want = {}
    for k in range(3):
        owner = {}
        for s, n in sorted((s, n) for key, s, n in rows if key == k and n):
            owner |= dict.fromkeys(range(s, s + n), s)
        for s in owner.values():
            want[k, s] = want.get((k, s), 0) + 1
    want |= {(9, 5): 3_000_000_000 - 4, (9, 10): 4}
    df = spark.createDataFrame(rows, "k long, s long, n long")
    assert {(r.k, r.s): r.n_bytes for r in ranges.painted(df, ["k"], "s", "n", cell=4096).where("k < 9").collect()} == {x: v for x, v in want.items() if x[0] < 9}
    small = ranges.painted(df.where("k < 9"), ["k"], "s", "n", cell=16)
    assert {(r.k, r.s): r.n_bytes for r in small.collect()} == {x: v for x, v in want.items() if x[0] < 9}
    wide = ranges.painted(df.where("k = 9"), ["k"], "s", "n", cell=1 << 20)
    assert {(r.k, r.s): r.n_bytes for r in wide.collect()} == {x: v for x, v in want.items() if x[0] == 9}


def test_label_runs(spark):
    rows = [(1, "012201122"), (2, "22"), (3, ""), (4, None), (5, "1"), (6, "2212")]
    got = {tuple(r) for r in ranges.label_runs(spark.createDataFrame(rows, "k long, t string"), "k", F.col("t")).collect()}
    assert got == {(1, 1, 4), (1, 5, 6), (1, 6, 9), (5, 0, 1), (6, 2, 4)}


def test_files_out_of_order(spark):
    """A file with much older events that comes later counts like any other."""
    path = f"{session.scratch_dir(spark)}/events-{uuid.uuid4().hex}"
    one = spark.sql("SELECT 1L AS event_id, TIMESTAMP_NTZ '2024-03-05 10:10:00' AS ts, 'a' AS event_type, 2.0D AS value")
    one.write.parquet(f"{path}/events-1.parquet")
    late = spark.sql("SELECT 2L AS event_id, TIMESTAMP_NTZ '2024-03-01 07:00:00' AS ts, 'a' AS event_type, 3.0D AS value UNION ALL SELECT 3L, TIMESTAMP_NTZ '2024-03-05 10:20:00', 'a', 5.0D")
    late.write.parquet(f"{path}/events-2.parquet")
    got = folds.drain(spark, f"{path}/*", folds.hourly_counts, one.schema, "*.parquet")
    assert {(r.hour.day, r.n, float(r.total)) for r in got.collect()} == {(1, 1, 3.0), (5, 2, 7.0)}


def test_no_shared_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())

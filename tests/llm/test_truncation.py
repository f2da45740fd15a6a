import random

from pyspark.sql import functions as F

from ferrule.llm import truncation as tr


def test_brackets(spark):
    texts = ['{"a": "}"}', '{"a": "b', '[{"a": 1}', "{name: 1,}", "prose", '{"a": "' + "x\\" * 50_000, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tr.open_brackets(F.col("t"))).collect()
    assert dict(map(tuple, rows)) == dict(enumerate([False, True, True, False, None, True, None, None]))
    note = "[" + "connection reset while the answer was still being received from the server" + "]"
    assert tr.unmarked("half a wor…") == "half a wor" and tr.unmarked(f'{{"a\n```\n{note} ').rstrip() == '{"a'
    assert tr.unmarked("a" + "... " * 100_000) == "a" and tr.unmarked('x["a"]') == 'x["a"]'
    assert tr.ending("It ends.", False) is None and tr.ending("It goes o", False) == ("prose", "It goes o")
    assert tr.ending('{"a', True, True) == ("json", '{"a') and tr.ending('{"a": 1} so the fun', True, False) == ("prose", " so the fun")


def test_evidence_is_needed(spark):
    """A single cut answer isn't a case: nothing shows how it would go on. A longer copy is evidence enough."""
    cut = '{"name": "walk", "items": [{"size": 3, "note": "The fun'
    rows = [("raw", 1, "m", cut), ("raw", 2, "m", cut), ("raw", 3, "m", None)]
    schema = "field string, record_id long, model string, value string"
    assert tr.truncated(spark.createDataFrame(rows, schema)).count() == 0
    rows.append(("raw", 4, "m", '{"name": "walk", "items": [{"size": 3, "note": "The fun begins here."}]}'))
    found = {tuple(r) for r in tr.truncated(spark.createDataFrame(rows, schema)).collect()}
    assert found == {("raw", 1), ("raw", 2)}


def corpus(rng, n):
    nouns = ["table", "block", "stream", "header", "record", "vector", "socket", "page"]
    forms = [
        "The function walks the {a} and copies every {b} it finds.",
        "Its only effect is a write to the {a} behind the {b}.",
        "When the {a} is full, the code falls back to the {b} and retries once.",
        "See also the {a}",
    ]
    pick = lambda: rng.choice(forms).format(a=rng.choice(nouns), b=rng.choice(nouns))
    return [" ".join(x if x.endswith(".") else x + "." for x in (pick(), pick())) for _ in range(n)]


def test_held_out(spark):
    rng = random.Random(6)
    full = corpus(rng, 600)
    rows, truth = [], set()
    for i, t in enumerate(full):
        if i % 6 == 0:
            at = rng.randint(20, len(t) - 2)
            while t[:at].rstrip()[-1:] in ".,":
                at = rng.randint(20, len(t) - 2)
            rows.append(("comments", i, "m", t[:at]))
            truth.add(("comments", i))
        elif i % 6 == 1:
            rows.append(("comments", i, None, t.rstrip(".")))  # a missing full stop alone
        else:
            rows.append(("comments", i, "m", t))
    rows += [("comments", 900, "m", None), ("comments", 901, "m", ""), ("comments", 902, "m", " \n "), rows[0]]
    for i in range(40):
        doc = '{"name": "n%d", "items": [{"size": %d, "note": "The function walks the table."}]}' % (i, i)
        cut = i % 4 == 0
        rows.append(("raw", i, "m", doc[: 30 + i // 2] if cut else doc + ("\n```" if i % 2 else "")))
        if cut:
            truth.add(("raw", i))
    rows.append(("raw", 50, "m", '{"name": "n1", "items": [],}'))
    values = spark.createDataFrame([(*r, 0) for r in rows], "field string, record_id long, model string, value string, n int")
    found_df = tr.truncated(values).cache()
    found = {tuple(r) for r in found_df.collect()}
    assert found_df.count() == len(found)
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 0.1 * len(truth)
    rates = {(r.field, r.model): (r.n_values, r.n_cut) for r in tr.truncation_rates(values, found_df).collect()}
    assert rates["raw", "m"][0] == 41 and ("comments", None) in rates


def test_empty(spark):
    none = spark.createDataFrame([], "field string, record_id long, model string, value string")
    assert tr.truncated(none).count() == 0

import os
import random

import pytest

from ferrule.llm import encode as enc

tokenizers = pytest.importorskip("tokenizers")
PATH = f"{enc.TOKENIZERS}/{enc.BYTE_BPE}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return enc.Vocabulary(f.read())


def split(vocabulary, texts):
    ids, counts = vocabulary.encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_every_code_point(vocabulary, reference):
    points = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    for i in range(0, len(points), 200_000):
        texts = [f"a{x}b 1{x} {x}.{x}" for x in points[i : i + 200_000]]
        assert split(vocabulary, texts) == reference(texts)


def test_random_texts(vocabulary, reference):
    rng = random.Random(1)
    letters = "a'srevlltdm 1\n\t　 .é9  ''\x00🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(50_000)]
    assert split(vocabulary, texts) == reference(texts)


def test_long_and_special(vocabulary, reference):
    texts = ["a" * 100_000, " " * 50_000, "ab" * 30_000 + "\n", "x<|endoftext|>y", "don't we'll 'tis"]
    assert split(vocabulary, texts) == reference(texts)


def test_frames(spark, reference):
    rows = [(1, "Hello world", "ids"), (2, "", None), (3, None, None), (1, "Hello world", "ids"), (4, "naïve\n\n  text 🙂", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = enc.encode(df, offsets=True)
    back = {r.doc_id: list(r.ids) for r in got.collect()}
    assert got.count() == 5 and back[2] == back[3] == [] and back[1] == reference(["Hello world"])[0]
    assert {r.doc_id: r.text for r in enc.decode(got).collect()} == {1: "Hello world", 2: "", 3: "", 4: "naïve\n\n  text 🙂"}
    for r in got.collect():
        if r.doc_id == 4:
            raw = rows[4][1].encode()
            assert r.starts[0] == 0 and len(r.starts) == len(r.ids) and r.starts[-1] < len(raw)
    assert {r.doc_id: r.n_tokens for r in enc.token_counts(df).collect()}[4] == len(back[4])
    assert enc.encode(df.where("false")).count() == 0

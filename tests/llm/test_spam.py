import random

from ferrule.llm import spam


def pages(rng, n):
    nouns = ["table", "block", "stream", "header", "record", "vector", "socket", "page", "file", "clock"]
    say = lambda: f"The {rng.choice(nouns)} is kept in the {rng.choice(nouns)} while it waits for a {rng.choice(nouns)}, and that is what the {rng.choice(nouns)} shows."
    code = lambda: f"int f{rng.randint(0, 99)}(void)\n{{\n  if (x == 0x{rng.randint(1, 999):x}) {{\n    return {rng.randint(0, 9)};\n  }}\n}}\n"
    rows, truth = [], set()
    for i in range(n):
        if i % 12 == 0:
            k = rng.choice(["cheap probe clip", "best hex viewer", "free loader download"])
            body = rng.choice([", ".join([k] * 25), "\n".join(f"{k} https://x{j}.example/y" for j in range(20)), " ".join("#" + k.replace(" ", "_") for _ in range(30))])
            truth.add(i)
        elif i % 12 == 1:
            body = "".join(code() for _ in range(8))
        else:
            body = " ".join(say() for _ in range(rng.randint(4, 12)))
        rows.append((i, body, "en"))
    return rows, truth


def test_found(spark):
    rows, truth = pages(random.Random(2), 480)
    rows += [(1000, None, "en"), (1001, "", None), (1002, " \n", "xx"), rows[0], (1003, "a", "en"), (1004, "the of and " * 20000, "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, links double")
    got = [r.doc_id for r in spam.spam_pages(df).select("doc_id").collect()]
    assert len(got) == len(set(got)) and not {1000, 1001, 1002} & set(got)
    assert len(truth & set(got)) >= 0.95 * len(truth) and len(set(got) - truth) <= 3


def test_cleaned(spark):
    """Long tags are no links, disguised words of any length are read, blanks of any kind are no page, code is no spam."""
    tag = '<a href="http://x.example/' + "y" * 300 + '">'
    rows = [(1, tag + " plain words here", "en"), (2, "\u00a0\u2003", "en"), (3, "pr0gr4mm3r" * 6 + " ends", "en"), (4, "deb u&#103;ger &amp; more", "xx"), (5, tag + "only", None)]
    got = {r.doc_id: r for r in spam.page_vectors(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(got) == {1, 3, 4, 5} and got[1].links == 0 and got[5].links == 0
    # one word of 60 letters and another
    assert abs(got[3].variety - 2 / 2**0.8) < 1e-9 and got[3].code == 0
    headers = [(i, "".join(f"#define NAME_{j} 0x{i * 131 + j:x}\n#include \"part_{j}.h\"\n" for j in range(20)), "en") for i in range(30)]
    texts, truth = pages(random.Random(8), 300)
    df = spark.createDataFrame([*[(1000 + i, *r) for i, *r in headers], *texts], "doc_id long, text string, lang string")
    found = {r.doc_id for r in spam.spam_pages(df).select("doc_id").collect()}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 2


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert spam.spam_pages(none).count() == 0


def test_copies_are_a_third(spark):
    rows, truth = pages(random.Random(6), 360)
    spam_page = next(r[1] for r in rows if r[0] in truth)
    ordinary = next(r[1] for r in rows if r[0] % 12 == 5)
    for copied, is_spam in [(spam_page, True), (ordinary, False)]:
        # one page is a third of all rows and nine in ten of the pages that count as German
        words = [("Kopf", "Datei", "Block"), ("Satz", "Liste", "Strom"), ("Wert", "Tabelle", "Takt")] * 7
        small = [(5000 + i, f"Der {a} ist in der {b} und wird von dem {c} auch nicht mehr als {i} mal für die {a} aus dem {c} geholt.", "de") for i, (a, b, c) in enumerate(words)]
        copies = [(10000 + i, copied, "de") for i in range(len(rows) // 2)]
        df = spark.createDataFrame([*rows, *small, *copies], "doc_id long, text string, lang string")
        got = {r.doc_id for r in spam.spam_pages(df).select("doc_id").collect()}
        want = truth | ({i for i, *_ in copies} if is_spam else set())
        assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 3

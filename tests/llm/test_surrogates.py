"""Surrogates on input that patterns could choke on, in scripts without case, and on a nearly full domain."""

import time

import pytest
from pyspark.sql import functions as F

from foliant.llm import surrogates

SHAPE = "doc_id long, text string"


def run(spark, texts, shape=SHAPE):
    return {r.doc_id: r for r in surrogates.replaced(spark.createDataFrame(list(enumerate(texts)), shape), "k").collect()}


def test_long_input_neither_exhausts_the_stack_nor_takes_long(spark):
    texts = [
        "x@" + "a." * 2000 + "1", "x@" + "a." * 40_000 + "com", "Mr " + "X" + "a" * 20_000 + " came", "password=" + "z" * 20_000, "+" + "1-" * 50_000,
        "a" * 500_000, "A" * 300_000, "1.2.3." * 50_000, "f" * 300_000, "@" * 100_000, "Mr " * 100_000, "a.b-c_d%" * 50_000 + "@", "4111 " * 60_000, "王" * 200_000, ("word " * 9 + "bob@mail.org ") * 20_000,
    ]
    began = time.time()
    got = run(spark, texts)
    assert time.time() - began < 120
    assert all(len(r.text) > 0 for r in got.values()) and got[14].n_entities == 20_000 and "bob@" not in got[14].text
    assert got[2].n_entities == 1 and "aaaaaaaa" not in got[2].text and "zzzzzzzz" not in got[3].text


@pytest.mark.parametrize(("text", "gone", "stays"), [
    ("Mr Łął came", "Łął", "came"), ("Dr Արամյան said", "Արամյան", "said"), ("ο κύριος Νίκος Παπαδόπουλος εδώ", "Παπαδόπουλος", "εδώ"), ("господин Иван Петров и др", "Петров", "господин"),
    ("السيد محمد الأحمد هنا", "محمد", "السيد"), ("מר כהן כאן", "כהן", "מר"), ("我昨天看见王小明先生了", "王小明", "先生了"), ("昨日は田中さんが", "田中", "さんが"), ("오늘 김철수 씨가", "김철수", "씨가"), ("오늘 날씨가", "", "오늘 날씨가"), ("오늘 김철수 씨 왔다", "김철수", "씨 왔다"),
])
def test_names_of_any_script(spark, text, gone, stays):
    r = run(spark, [text])[0]
    assert stays in r.text and (not gone or (gone not in r.text and r.n_entities == 1))
    if gone:
        scripts = [n for n in ("Latin", "Armenian", "Greek", "Cyrillic", "Arabic", "Hebrew", "Han", "Hangul")]
        count = lambda t: [len(__import__("regex").findall(rf"\p{{{s}}}", t)) > 0 for s in scripts]
        assert count(r.text) == count(text)


def test_given_names_follow_title_and_script(spark):
    r = run(spark, ["κύριος Νίκος Παπαδόπουλος", "κυρία Ελένη Παπαδόπουλος", "господин Иван Петров", "Mrs Jane Miller", "Mr. Jane Miller"])
    words = [r[k].text.split() for k in range(5)]
    for k, (g, script) in enumerate([("m", "greek"), ("f", "greek"), ("m", "cyrillic"), ("f", "latin"), ("m", "latin")]):
        assert words[k][1] in surrogates.GIVEN[g, script]
    assert words[0][2] == words[1][2] and words[3][2] == words[4][2]


def test_a_nearly_full_domain_stays_distinct(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("name", a + b) for a in letters for b in letters if (a, b) not in (("q", "q"), ("x", "z"))]
    got = surrogates.surrogates(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()
    drawn = [r.surrogate for r in got]
    assert len(drawn) == len(set(drawn)) == len(rows) and not set(drawn) & {c for _, c in rows}


def test_keys_matter_and_names_of_its_own_columns(spark):
    rows = [(1, "Mr Miller", 5, 6, [1], "a", 7), (1, "Mr Miller", 5, 6, [1], "a", 7), (None, "Ms Miller", 5, 6, [1], "a", 7), (2, None, 1, 1, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities long, _row long, _gaps array<int>, _mentions string, _found long")
    out = surrogates.replaced(docs, "k")
    assert out.columns == ["doc_id", "text", "_row", "_gaps", "_mentions", "_found", "n_entities"]
    got = out.orderBy(F.col("doc_id").desc_nulls_last()).collect()
    assert [tuple(r)[2:6] for r in got[1:]] == [(6, [1], "a", 7)] * 3 and got[0].n_entities == 0
    assert got[1].text == got[2].text and got[3].text[3:] == got[1].text[3:] != "Miller"
    assert surrogates.replaced(docs, "other").where("doc_id = 1").head().text != got[1].text

"""Line dedup where words are hot, rows share a doc_id, and columns bear the operator's own names."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import line_dedup

SHAPE = "doc_id long, text string"


def brute(rows):
    """(doc_id, line) of all lines to remove."""
    lines, inverted, want = [], defaultdict(list), set()
    for i, t in sorted(rows):
        for n, line in enumerate(t.split("\n")):
            s = frozenset(line.lower().split())
            if s:
                common = Counter(j for w in s for j in inverted[w])
                if any(5 * c >= 4 * (len(s) + len(lines[j]) - c) for j, c in common.items()):
                    want.add((i, n))
                for w in s:
                    inverted[w].append(len(lines))
                lines.append(s)
    return want


@pytest.mark.parametrize("cell", [40, 8192])
def test_hot_words_are_dealt_over_a_grid(spark, cell, monkeypatch):
    """Lines that share their words, of which some match: all meet, however many cells they are dealt over."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, "\n".join(" ".join(r.sample(words, r.randint(8, 30))) for _ in range(3))) for k in range(500)]
    rows += [(1000 + k, rows[k][1].replace("w1 ", "")) for k in range(60)]
    monkeypatch.setattr(line_dedup, "CELL", cell)
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    docs = spark.createDataFrame(rows, SHAPE).repartition(5)
    source = docs.select(F.col("text").cast("binary").alias("text"))
    levels = spark.sparkContext.broadcast(line_dedup.rarity(source, 1000))
    known, parts = line_dedup.hot(source, levels, 1000)
    assert (len(known) > 20 and parts.max() > 3) == (cell == 40)
    got = {(x.doc_id, x.line) for x in line_dedup.removals(docs).collect()}
    assert got == brute(rows) and len(got) > 100


def test_many_sketches_are_added_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FAN_IN", 2)
    monkeypatch.setattr(line_dedup, "TASK_BYTES", 10)
    rows = [(k, f"all of them have these words {k % 7}") for k in range(64)]
    texts = spark.createDataFrame(rows, SHAPE).repartition(9).select(F.col("text").cast("binary").alias("text"))
    levels = line_dedup.rarity(texts, 90)
    assert Counter(levels[levels > 0].tolist()) == {7: 6, 4: 7}


def test_rows_that_share_a_doc_id(spark):
    first, again = "alpha beta gamma delta epsilon", "totally unrelated first line here"
    rows = [(1, f"{first}\nx1 x2 x3 x4 x5"), (2, f"{again}\n{first}"), (2, "q1 q2 q3 q4 q5\nw1 w2 w3 w4 w5 unique"), (None, f"n1 n2 n3 n4 n5 n6\n{first}"), (None, "m1 m2 m3 m4 m5\nm6 m7 m8 m9 m0")]
    got = sorted(x.text for x in line_dedup.deduplicated(spark.createDataFrame(rows, SHAPE)).collect())
    assert got == sorted(["x1 x2 x3 x4 x5", again, rows[2][1], rows[3][1], rows[4][1]])


def test_names_of_its_own_columns(spark):
    rows = [(1, "one two three four five", 77, 8, [1], "x"), (2, "one two three four five\nmore", 78, 9, [0], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _row long, _gone array<int>, lines string")
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(x) for x in out.collect()) == [rows[0], (2, "more", 78, 9, [0], "y")]


def test_a_very_long_text(spark):
    r = random.Random(6)
    line = " ".join(f"u{r.random()}" for _ in range(200_000))  # 4 MB in a line
    many = "\n".join(f"a{k} b{k} c{k} d{k} e{k} f{k}" for k in range(40_000))
    rows = [(1, line), (2, f"{many}\n{line} more\nanother line altogether"), (3, many)]
    got = {x.doc_id: (x.n_lines, x.n_removed) for x in line_dedup.report(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {1: (1, 0), 2: (40_002, 1), 3: (40_000, 40_000)}

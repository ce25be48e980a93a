"""Cases of the first advice: near copies at 0.8 in the pipeline, secrets without digits, scripts, rows that share a doc_id."""

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import line_dedup, surrogates
from foliant.llm.common import table

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string"


def test_pipeline_drops_near_copies_from_80_percent(spark):
    def shingles(text):
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    base = [f"w{k}" for k in range(204)]
    cut = [base[:k] + ["new"] * (204 - k) for k in (182, 181, 178, 170)]
    sf = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in sf.collect()]
    rows += [(100_000 + k, " ".join(w)) for k, w in enumerate([base, *cut])]
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    between = 0
    for a in sets:
        for b in sets:
            least, most = sorted((len(sets[a]), len(sets[b])))
            if a < b and least and 100 * least >= 80 * most and 100 * (both := len(sets[a] & sets[b])) >= 80 * (least + most - both):
                between += 100 * both < 85 * (least + most - both)
                x, y = sorted((root(a), root(b)))
                label[y] = x
    assert between
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SHAPE), "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i in sets if root(i) == i)


def test_secrets_without_digits(spark):
    secrets = ["hunter", "AKIA" + "QWERTYUIOPASDFGH", "abcdef" * 6, "ABCDEF" * 6]
    texts = [f"the password={secrets[0]} of ours", *(f"our key {s} here" for s in secrets[1:])]
    rows = list(enumerate(texts)) + [(10 + k, t + " 7") for k, t in enumerate(texts)] + [(20, "nothing to see")]
    got = {r.doc_id: r for r in surrogates.replaced(spark.createDataFrame(rows, SHAPE), "k").collect()}
    for k, s in enumerate(secrets):
        assert got[k].n_entities == 1 and s not in got[k].text and got[10 + k].text == got[k].text + " 7"
    assert (got[20].n_entities, got[20].text) == (0, "nothing to see")


def test_line_dedup_tells_rows_of_one_doc_id_apart(spark):
    same = "one line that both of them have"
    texts = [(i, f"{same}\nunique words {k} of document {k} number {k}\n{tail}") for i in (None, 7) for k, tail in ((f"a{i}", same), (f"b{i}", f"more of b{i} only here"))]
    rows = [*texts, texts[0]]
    order = {(i, t): r._row for i, t, r in ((r.doc_id, r.text, r) for r in line_dedup.keyed(spark.createDataFrame(rows, SHAPE)).collect())}
    seen, want = set(), {}
    for i, t in sorted(order, key=lambda x: (x[0] is not None, x[0] or 0, order[x])):
        want[i, t] = "\n".join(x for x in t.split("\n") if not (x in seen or seen.add(x)))
    got = line_dedup.deduplicated(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(r.text for r in got) == sorted(want[x] for x in rows)


def test_surrogates_stay_distinct_in_any_script(spark, monkeypatch):
    words = ["пароль", "ամիրյան", "אבגדה", "مرحبا", "대한민국", "漢字仮名", "ひらがな", "สวสด", "ⲁⲃⲅ", "ßþĸ"]
    drawn = spark.createDataFrame([("secret", w) for w in words], "kind string, canon string")
    for r in drawn.withColumn("d", surrogates._draw(F.col("canon"), F.col("kind"), F.lit(0), "k")).withColumn("s", surrogates.surrogate(F.col("canon"), F.col("kind"), F.col("d"))).collect():
        assert all(a != b or a in "пароль" for a, b in zip(r.canon, r.s, strict=True)) or r.s != r.canon, r
    monkeypatch.setattr(surrogates, "ATTEMPTS", 1)
    digits = [("secret", str(k)) for k in range(10)]  # all values of their format are entities
    ips = [("ip", f"1.2.3.{k}") for k in range(5)]
    rows = digits + ips + [("email", f"{c}@a.io") for c in "abc"]
    got = surrogates.surrogates(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()
    assert sorted((r.kind, r.canon) for r in got) == sorted(rows)
    assert len({(r.kind, r.surrogate) for r in got}) == len(rows) and not {(r.kind, r.surrogate) for r in got} & set(rows)
    docs = spark.createDataFrame([(k, f"password={k}") for k in range(10)], SHAPE)
    texts = {r.text for r in surrogates.replaced(docs, "k").collect()}
    assert len(texts) == 10 and not texts & {f"password={k}" for k in range(10)}


def test_line_pairs_keep_the_flag_of_any_word():
    words = [f"t{k}" for k in range(32)]
    levels, none = SimpleNamespace(value=np.ones(1 << 20, np.uint8)), SimpleNamespace(value=(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    token = {w: int(line_dedup._Lines([w.encode()], levels.value).token[0]) for w in words}
    words.sort(key=token.get)
    y, with_all, without_first = words[1:31], words[1:32], [words[0], *words[2:31]]
    texts = [" ".join(x).encode() for x in (with_all, without_first, y)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "row": pa.array([0, 0, 0], pa.int64()), "text": pa.array(texts, pa.binary())})
    sent = list(line_dedup._send(levels, none, 1)(iter([batch])))
    pairs = [p for out in line_dedup._match(1)(iter(sent)) for p in out.to_pylist() if p["doc_id"] == 3]
    assert {p["x_doc"]: p["more"] for p in pairs}[1]

"""Out-of-fold predictions matter, and names of its own columns do no harm."""

import random

import numpy as np

from foliant.llm import toxicity

SHAPE = "doc_id long, text string"


def test_later_models_learn_from_out_of_fold_predictions(spark):
    """The first category is noise, which a model learns by heart; the second equals it. Predictions for what the first
    model was fitted on look like the answer, those for what it has not seen do not."""
    r = random.Random(8)
    words = [f"v{k}" for k in range(150)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(20))) for i in range(240)], SHAPE)
    noise = [r.randrange(2) for _ in range(240)]
    labels = spark.createDataFrame([(i, n, n) for i, n in enumerate(noise)], "doc_id long, a int, b int")
    right, wrong = (toxicity.fit(docs, labels, ["a", "b"], in_fold=f).chain[1][0] for f in (False, True))
    assert wrong > 3 and right < wrong / 3
    assert (toxicity.fit(docs, labels, ["a", "b"]).weights[0] != 0).sum() > 50


def test_features_are_ranked_in_spark_as_by_hand(spark):
    rows = [(i, "bad words here" if i % 3 == 0 else "good words here") for i in range(60)] + [(100, "rare"), (101, None)]
    docs = spark.createDataFrame(rows, SHAPE)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(100, 1), (101, 0)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, ["toxic"])
    _, hashes = toxicity.feature_sets([b"bad"])
    good = toxicity.feature_sets([b"good"])[1]
    assert set(hashes.tolist()) <= set(chain.known.tolist()) and set(good.tolist()) <= set(chain.known.tolist())
    assert not set(toxicity.feature_sets([b"rare"])[1].tolist()) & set(chain.known.tolist())
    p = chain.scores([b"bad words", b"good words", None])[:, 0]
    assert p[0] > 0.9 and p[1] < 0.1


def test_names_of_its_own_columns(spark):
    rows = [(1, "some text", 5.0, "t", 1), (1, "some text", 5.0, "t", 1), (None, None, 6.0, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double, _text string, class int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, toxicity.chained_labels(labels), toxicity.NAMES)
    out = toxicity.scored(docs, chain)
    assert out.columns == ["doc_id", "text", "_text", "class", "p_low_quality", "p_toxic"] and out.count() == 3
    assert sorted(map(str, toxicity.accepted(docs, labels).collect())) == sorted(map(str, docs.collect()))


def test_a_very_long_text(spark):
    long = "word " * 2_000_000 + "grumble"
    chain = toxicity.Chain(["toxic"], np.sort(toxicity.feature_sets([b"grumble"])[1]), [np.ones(len(toxicity.feature_sets([b"grumble"])[1]))], [np.array([-0.5])])
    got = toxicity.scored(spark.createDataFrame([(1, long), (2, "x")], SHAPE), chain).select("doc_id", "p_toxic").collect()
    assert {r.doc_id: r.p_toxic > 0.5 for r in got} == {1: True, 2: False}

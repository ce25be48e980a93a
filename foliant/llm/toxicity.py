"""Toxicity: a chain of linear classifiers. Each category's model also sees the probabilities of the categories
before it; for training these are out-of-fold predictions, so that they are as unsure as at scoring time.

Features are the words (A-Z lower-cased, letters and digits) of the whole text, and the words' beginnings of 4 to
7 bytes, which catch the stems of inflected ones: present or not. For each category those FEATURES of them are used
that a chi-square test over the training sample ranks highest; they are counted and ranked in Spark, and no others reach
the driver. The models are fitted by Newton steps with an L2 penalty on the driver, on a sample: at most PER_CLASS
labelled documents of each value of the last category, smallest hashes of doc_id first, weighted back to their share
of all labelled documents. All documents are scored where they lie, without a shuffle; what is broadcast are the
features' hashes and weights.

`labels` has one toxicity category, `toxic`. The chain here is low_quality (quality 0) before toxic.

Cases: a null text has no words. Labels that are null, or of documents that do not exist, are ignored; several
labels of a document, or several documents of a label, all count. Ties of features go to the smaller hash. With no labels,
or just one value in them, the probability of a category is the share of that value (0 without labels). Repeated rows
are scored each. Very long texts are hashed in blocks. Extra columns pass through accepted() untouched, whatever their
names; scored() replaces columns with the names of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import kernels as K
from foliant.llm.common import extended, file_count, forget, input_bytes, saved, table

PER_CLASS = 3000
FEATURES = 256
#: Sample documents that a feature must occur in.
LEAST_DOCUMENTS = 5
FOLDS = 5
PENALTY = 0.05
THRESHOLD = 0.5
STEMS = (4, 5, 6, 7)


def fit_linear(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = PENALTY, steps: int = 12) -> np.ndarray:
    """Weights of a logistic regression, the intercept last: damped Newton steps. The intercept is not penalised."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * b * b).sum())

    now = loss(beta)
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step, size = np.linalg.solve(hess, grad), 1.0
        while (then := loss(beta - size * step)) > now and size > 1e-4:
            size /= 2
        if then >= now - 1e-9 * abs(now):
            break
        beta, now = beta - size * step, then
    return beta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Chain:
    """Fitted models: names of the categories, the hashes of the features and weights (features, earlier categories, intercept)."""

    names: list[str]
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: list[np.ndarray] = field(default_factory=list)
    chain: list[np.ndarray] = field(default_factory=list)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """A row of probabilities for each text."""
        out = np.zeros((len(texts), len(self.names)))
        hits = presence(texts, self.known)
        for k in range(len(self.names)):
            z = out[:, :k] @ self.chain[k][:-1] + self.chain[k][-1]
            z += np.bincount(hits[0], self.weights[k][hits[1]], len(texts))
            out[:, k] = _sigmoid(z)
        return out


def _features(words: K.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of word, hash) of all words and of the beginnings of longer ones."""
    length = words.end - words.start
    whole, *stems = words.prefix_hashes([None, *STEMS])
    yield np.arange(len(words)), whole
    for n, h in zip(STEMS, stems, strict=True):
        own = np.flatnonzero(length > n)
        yield own, h[own] ^ np.uint64(n)


def presence(texts: list[bytes | None], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, of the known (sorted) feature hashes that occur in the texts."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = K.split(texts, K.ALNUM, lower=True)
    doc, pairs = words.doc_of(), []
    for own, h in _features(words):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        pairs.append(doc[own[hit]] * len(known) + at[hit])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // len(known), pairs % len(known)


def feature_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) pairs, each once, of all features."""
    words = K.split(texts, K.ALNUM, lower=True)
    own, h = (np.concatenate(x) for x in zip(*_features(words), strict=True))
    doc = words.doc_of()[own]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[fresh], h[fresh]


def _feature_counts(classes: int):
    """How many documents of each class have a feature."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("class").to_numpy()
            for lo, hi in K.groups(texts):
                doc, h = feature_sets(texts[lo:hi])
                known, index = np.unique(h, return_inverse=True)
                counts = np.bincount(index * classes + own[lo:hi][doc], minlength=len(known) * classes).reshape(-1, classes)
                yield pa.RecordBatch.from_pydict({"feature": known.view(np.int64), **{f"n{k}": counts[:, k].astype(np.int64) for k in range(classes)}})

    return run


def _presence(known):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in K.groups(texts):
                doc, index = presence(texts[lo:hi], known.value)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                rows = [index[a:b].astype(np.int32) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "class": batch.column("class").slice(lo, hi - lo), "features": pa.array(rows, pa.list_(pa.int32()))})

    return run


def _ranked(counts: DataFrame, weights: np.ndarray, sizes: np.ndarray, positive: np.ndarray, top: int) -> np.ndarray:
    """The features whose presence depends most on a category (chi-square over weighted documents)."""
    total, pos = float(weights @ sizes), float((weights * positive) @ sizes)
    if not 0 < pos < total:
        return np.zeros(0, np.uint64)
    n = [F.col(f"n{k}") for k in range(len(weights))]
    seen = sum((x * float(w) for x, w in zip(n, weights, strict=True)), F.lit(0.0))
    seen_pos = sum((x * float(w) for x, w, p in zip(n, weights, positive, strict=True) if p), F.lit(0.0))
    expect = seen * (pos / total)
    rest, rest_expect = pos - seen_pos, pos - expect
    chi = (seen_pos - expect) * (seen_pos - expect) / F.greatest(expect, F.lit(1e-9)) + (rest - rest_expect) * (rest - rest_expect) / F.greatest(rest_expect, F.lit(1e-9))
    best = counts.where(sum(n, F.lit(0)) >= LEAST_DOCUMENTS).select("feature", chi.alias("chi")).where("chi > 0").orderBy(F.desc("chi"), "feature").limit(top)
    return np.sort(np.array([r.feature for r in best.collect()], np.int64).view(np.uint64))


def _none(names: list[str]) -> Chain:
    return Chain(names, weights=[np.zeros(0)] * len(names), chain=[np.r_[np.zeros(k), -40.0] for k in range(len(names))])


def fit(docs: DataFrame, labels: DataFrame, names: list[str], per_class: int = PER_CLASS, top: int = FEATURES, folds: int = FOLDS, in_fold: bool = False) -> Chain:
    """A chain over the 0/1 columns `names` of labels, in that order. in_fold: later models are trained with predictions
    for what earlier ones were fitted on, for comparison only."""
    known = labels.select("doc_id", *[F.col(n).cast("double").alias(n) for n in names]).dropna()
    counts = {r[0]: r[1] for r in known.groupBy(names[-1]).count().collect()}
    parts = [known.where(F.col(names[-1]) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in sorted(counts)]
    if not parts:
        return _none(names)
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionByName(p)
    # a class for each combination of labels
    classes = 1 << len(names)
    own = sum((F.when(F.col(n) > 0, 1 << k).otherwise(0) for k, n in enumerate(names)), F.lit(0))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    # at most per_class rows of each value
    found = saved(texts.join(F.broadcast(sample.select("doc_id", own.cast("int").alias("class"))), "doc_id").repartition(8), "labelled")  # 2 * per_class documents
    sizes = np.zeros(classes)
    for r in found.groupBy("class").count().collect():
        sizes[r[0]] = r[1]
    if not sizes.sum():
        forget(found)
        return _none(names)
    value = np.array([[c >> k & 1 for k in range(len(names))] for c in range(classes)], float)
    drawn = {v: max(1.0, sizes[value[:, -1] == float(v > 0)].sum()) for v in counts}
    weights = np.array([next((counts[v] / drawn[v] for v in counts if float(v > 0) == last), 0.0) for last in value[:, -1]])
    weights *= sizes.sum() / max(float(weights @ sizes), 1e-300)
    per_task = found.select("text", "class").mapInArrow(_feature_counts(classes), "feature long, " + ", ".join(f"n{k} long" for k in range(classes)))
    seen = saved(per_task.groupBy("feature").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(classes)]), "features", file_count(input_bytes(found)))
    picked = [_ranked(seen, weights, sizes, value[:, k], top) for k in range(len(names))]
    forget(seen)
    words = np.unique(np.concatenate(picked))
    rows = found.mapInArrow(_presence(docs.sparkSession.sparkContext.broadcast(words)), "doc_id long, class int, features array<int>").collect()
    forget(found)
    rows = sorted((r.doc_id, r["class"], tuple(r.features)) for r in rows)
    ids, own_class = [r[0] for r in rows], np.array([r[1] for r in rows])
    y, w = value[own_class], weights[own_class]
    x = np.zeros((len(rows), len(words)))
    for i, r in enumerate(rows):
        x[i, list(r[2])] = 1
    fold = (K.mix(np.array(ids, np.int64).astype(np.uint64)) % np.uint64(folds)).astype(int)
    out = Chain(names, words)
    before = np.zeros((len(rows), 0))
    for k in range(len(names)):
        cols = np.searchsorted(words, picked[k])
        own_x = np.c_[x[:, cols], before]
        beta = _fit_or_prior(own_x, y[:, k], w)
        full = np.zeros(len(words))
        full[cols] = beta[: len(cols)]
        out.weights.append(full)
        out.chain.append(beta[len(cols) :])
        if k < len(names) - 1:
            guess = _sigmoid(np.c_[own_x, np.ones(len(rows))] @ beta) if in_fold else np.zeros(len(rows))
            for f in range(0 if in_fold else folds):
                rest, held = fold != f, fold == f
                if held.any():
                    b = _fit_or_prior(own_x[rest], y[rest, k], w[rest]) if rest.any() else beta
                    guess[held] = _sigmoid(np.c_[own_x[held], np.ones(held.sum())] @ b)
            before = np.c_[before, guess]
    return out


def _fit_or_prior(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        return np.r_[np.zeros(x.shape[1]), 40.0 if len(y) and y[0] else -40.0]
    return fit_linear(x, y, w)


def _score(chain, keep: list[str]):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(batch, chain.value)
            out = batch.select(keep)
            for k, n in enumerate(chain.value.names):
                out = out.append_column(f"p_{n}", pa.array(p[:, k]))
            yield out

    return run


def _probabilities(batch: pa.RecordBatch, chain: Chain) -> np.ndarray:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    return np.concatenate([np.zeros((0, len(chain.names))), *(chain.scores(texts[lo:hi]) for lo, hi in K.groups(texts))])


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with a column p_<category> for each category."""
    model, new = docs.sparkSession.sparkContext.broadcast(chain), {f"p_{n}".lower() for n in chain.names}
    keep = [c for c in docs.columns if c.lower() not in new]
    shape = extended(docs.select(*keep).schema, ", ".join(f"p_{n} double" for n in chain.names))
    return docs.select(*keep).mapInArrow(_score(model, keep), shape)


def chained_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


NAMES = ["low_quality", "toxic"]


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the chain holds toxic; all columns stay."""
    chain = fit(docs, chained_labels(labels), NAMES)
    model = docs.sparkSession.sparkContext.broadcast(chain)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(batch, model.value)[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, chained_labels(table(spark, sf_dir, "labels")), NAMES)
    out = scored(docs, chain).drop("text")
    return out.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)

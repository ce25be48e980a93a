"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned against training windows.

Benchmark items are lower-cased (A-Z), split into words and cut into n-grams; an item of fewer words is
one n-gram. Their hashes are broadcast in slices of at most SLICE_BYTES of item text, as sorted arrays over one buffer
of words: some five times as much as the text. A hash that a document's rolling window meets is verified on the words
themselves. A benchmark of one slice takes one pass, in which nothing is shuffled. A larger one takes a pass for each
slice, of which only the hits are kept, in the shared folder, and a last one in which documents with hits meet them.

Cases: a null or empty text has no words and no hit. Repeated documents are judged each on their own;
repeated items count once per item_id; an item without words, or null, is ignored; a null item_id marks
words as hit without being listed. An empty benchmark leaves all documents clean. Very long texts are hashed in
blocks. Extra columns of documents pass through clean() untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import kernels as K
from foliant.llm.common import few, free, saved, table

NGRAM = 10
SLICE_BYTES = 16 << 20


@dataclass
class Grams:
    """n-grams of one width: sorted hashes, where each begins and ends in the index's buffer, and its item."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    item: np.ndarray


@dataclass
class Index:
    """The n-grams of a slice of the benchmark by width, over the words of all items, joined by blanks."""

    buf: np.ndarray
    names: list
    grams: dict[int, Grams]

    def owners(self, width: int, h: int, words: bytes) -> list:
        """The items that have an n-gram of this hash and these words."""
        g = self.grams[width]
        lo, hi = np.searchsorted(g.hashes, np.uint64(h), "left"), np.searchsorted(g.hashes, np.uint64(h), "right")
        return [self.names[g.item[k]] for k in range(lo, hi) if self.buf[g.begin[k] : g.end[k]].tobytes() == words]


def build(items: list[tuple], n: int) -> Index:
    """The index of (item_id, text) pairs."""
    words = K.split([bytes(t or b"") for _, t in items], K.ALNUM, lower=True)
    size = words.end - words.start
    end = np.cumsum(size + 1)
    begin = end - size - 1
    buf = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    buf[at + np.repeat(begin, size)] = words.buf[at + np.repeat(words.start, size)]
    one, lengths, doc = words.hashes(), np.diff(words.first), words.doc_of()
    grams = {}
    for width in sorted({min(n, k) for k in lengths.tolist() if k}):
        own = np.flatnonzero((lengths == width) | ((lengths > width) & (width == n)))
        pick = np.concatenate([np.arange(words.first[i], words.first[i + 1]) for i in own.tolist()])
        hashes, first = K.windows(one[pick], np.r_[0, np.cumsum(lengths[own])], width)
        order = np.argsort(hashes, kind="stable")
        first = pick[first[order]]
        grams[width] = Grams(hashes[order], begin[first].astype(np.int32), (end[first + width - 1] - 1).astype(np.int32), doc[first].astype(np.int32))
    return Index(buf, [i for i, _ in items], grams)


def _hits(texts: list[bytes | None], index: Index) -> tuple[K.Words, np.ndarray, list[set]]:
    """Words, a mask of those that are hit, and for each text the items with occurring n-grams."""
    words = K.split(texts, K.ALNUM, lower=True)
    one, hit, items = words.hashes(), np.zeros(len(words), bool), [set() for _ in texts]
    for width, grams in index.grams.items():
        hashes, at = K.windows(one, words.first, width)
        known = grams.hashes[np.minimum(np.searchsorted(grams.hashes, hashes), len(grams.hashes) - 1)] == hashes
        for k in np.flatnonzero(known).tolist():
            i = int(at[k])
            if owners := index.owners(width, int(hashes[k]), b" ".join(words.text(j) for j in range(i, i + width))):
                hit[i : i + width] = True
                items[int(np.searchsorted(words.first, i, "right")) - 1].update(owners)
    return words, hit, items


def _scan(index, hit: str, listed: str, then):
    """Adds the hits to the columns hit (a bit for each word) and listed (items); what `then` makes of such batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            masks, items = [], []
            for lo, hi in K.groups(texts):
                words, own, found = _hits(texts[lo:hi], index.value)
                masks += [np.packbits(own[a:b]).tobytes() for a, b in zip(words.first, words.first[1:])]
                items += [sorted({str(x) for x in f if x is not None}) for f in found]
            yield batch.append_column(hit, pa.array(masks, pa.binary())).append_column(listed, pa.array(items, pa.list_(pa.string())))

    return K.tidy(lambda batches: then(run(batches)))


def _merge(hit: str, listed: str, several: str, then):
    """The same from the hits of all slices: a column of (mask, items) pairs, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, items = [], []
            for found in batch.column(several).to_pylist():
                both = np.zeros(0, np.uint8)
                for part in found or ():
                    mask = np.frombuffer(part["mask"], np.uint8)
                    both = mask if not len(both) else both | mask
                masks.append(both.tobytes())
                items.append(sorted({x for part in found or () for x in part["items"]}))
            rest = batch.select([c for c in batch.schema.names if c != several])
            yield rest.append_column(hit, pa.array(masks, pa.binary())).append_column(listed, pa.array(items, pa.list_(pa.string())))

    return K.tidy(lambda batches: then(run(batches)))


def _only_hits(key: str, hit: str, listed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column(hit).to_pylist()
            keep = pa.array([any(m) for m in masks], pa.bool_())
            yield pa.RecordBatch.from_pydict({"key": batch.column(key), "mask": batch.column(hit), "items": batch.column(listed)}).filter(keep)

    return run


def marked(docs: DataFrame, benchmark: DataFrame, make, n: int = NGRAM, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """What make(hit, listed) gives, (function over batches, schema): of batches of docs with columns of these names,
    a bit for each word that is hit, and the items."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    slices = -(-total // slice_bytes) or 1
    hit, listed, several, key = free(docs, "_hit", "_items", "_several", "_key")
    then, schema = make(hit, listed)

    def index(k: int):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(slices)) == k)
        return spark.sparkContext.broadcast(build([tuple(r) for r in part.collect()], n))  # slice_bytes of text, about

    if slices == 1:
        return docs.mapInArrow(_scan(index(0), hit, listed, then), schema)
    keyed, found = docs.withColumn(key, F.xxhash64("text")), None
    for k in range(slices):
        own = index(k)
        hits = saved(keyed.select(key, "text").mapInArrow(_scan(own, hit, listed, _only_hits(key, hit, listed)), "key long, mask binary, items array<string>").dropDuplicates(["key"]), "decontaminate")
        own.unpersist()
        found = hits if found is None else found.unionByName(hits)
    met = saved(found.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("mask", "items")).alias(several)), "decontaminate")
    joined = keyed.join(F.broadcast(met) if few(met, lists=several) else met, key, "left").select(*docs.columns, several)
    return joined.mapInArrow(_merge(hit, listed, several, then), schema)


def _digest(hit: str, listed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            masks, items = (batch.column(c).to_pylist() for c in (hit, listed))
            counts = np.concatenate([np.diff(K.split(texts[lo:hi], K.ALNUM, lower=True).first) for lo, hi in K.groups(texts)] or [np.zeros(0, np.int64)])
            hits = [int(np.bitwise_count(np.frombuffer(m, np.uint8)).sum()) for m in masks]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(counts.astype(np.int64)), "n_hit": pa.array(hits, pa.int64()),
                "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
                "contaminated": pa.array([h > 0 for h in hits]),
            })

    return run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def report(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """For each document the number of words, of hit words and of items, and a digest of the items."""
    return marked(docs.select("doc_id", "text"), benchmark, _digest, n, slice_bytes)


def _cut(keep: list[str], whole: bool, schema):
    """Removes the words that are hit from text, or the documents with any (whole)."""

    def make(hit: str, listed: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                masks = batch.column(hit).to_pylist()
                if whole:
                    yield batch.filter(pa.array([not any(m) for m in masks], pa.bool_())).select(keep)
                    continue
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                for i, mask in enumerate(masks):
                    if any(mask):
                        words = K.split([texts[i]], K.ALNUM, lower=True)
                        own = np.unpackbits(np.frombuffer(mask, np.uint8))[: len(words)].astype(bool)
                        turn = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                        kept, last = [], 0
                        for lo, hi in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                            kept.append(texts[i][last : int(words.start[lo])])
                            last = int(words.end[hi - 1])
                        texts[i] = b"".join([*kept, texts[i][last:]])
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, "text", pa.array(texts, pa.binary()).view(pa.string())).select(keep)

        return run, schema

    return make


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = NGRAM, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs without the contaminated spans ("spans") or documents ("documents"); all columns stay."""
    return marked(docs, benchmark, _cut(docs.columns, remove == "documents", docs.schema), n, slice_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH lower_docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM grams),
wins AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM lower_docs, widths)),
hits AS (SELECT doc_id, wins.n, s, item_id FROM wins JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM hits, (SELECT unnest(range(0, 10)) AS k) WHERE k < n GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lower_docs d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

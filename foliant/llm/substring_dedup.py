"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt into parts: runs in the order of (doc_id, hash of the text) of about as many bytes each, between bounds
that a sort of these pairs over all documents gives. A part is read in pages, runs of its documents of about PAGE_BYTES,
so that a page is the same whenever it is computed and (page, offset of a word in it) sorts like (doc_id, position). Each
page hashes all its windows and sends them, packed, to hash buckets; a bucket finds the windows that occur before and
sends their offsets back to their pages, where they merge into removal intervals.

Sizes: a window costs hash_bytes + about 1.2 bytes of shuffle. Each page sends a window once however
often it holds it, so that a bucket gets at most one entry per page of the most frequent window.
Texts travel once, zstd-compressed, to their parts; both users of a part read the same exchange. A part's texts are held
whole (PAGE_BYTES of them, or the PARTS-th part of all where that is more), its windows a page at a time. The bounds are
at most PARTS numbers on the driver.
Two windows count as equal if (8 * hash_bytes + log2(buckets)) bits of hash agree, 72 and more here.

Cases: a null or empty text has no words and loses none. Ties (the same doc_id twice): ordered by a hash of the
text; equal rows are interchangeable. A null doc_id sorts first. Very long texts are pages of their own, hashed in blocks.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm import kernels as K
from foliant.llm.common import as_bytes, forget, input_bytes, saved, table

WIDTH = 20
PAGE_BYTES = 2 << 20
PARTS = 1 << 20
#: Pages of a part: what the low bits of a page's number count.
PAGE_BITS = 20
SORT_PARTS = 64
BUCKET_BYTES = 4 << 20
FLUSH_BYTES = 8 << 20
FIRST = -(2**63)
_ID = np.dtype("<i8")


def boundaries(docs: DataFrame, part_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (doc_id, hash of the text) that begin all parts but the first. Only pairs and sizes are sorted, over many
    tasks; their sums by task, and the bounds, reach the driver."""
    pair = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("i"), F.xxhash64("text").alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("n"))
    tasks = max(1, input_bytes(docs) // (SORT_PARTS * PAGE_BYTES))
    ranged = saved(pair.repartitionByRange(tasks, "i", "h").sortWithinPartitions("i", "h").withColumn("at", F.monotonically_increasing_id()), "substring-order")
    task, sums, total = F.shiftright("at", 33), [], 0
    for p, n in sorted(tuple(r) for r in ranged.groupBy(task.alias("p")).agg(F.sum("n")).collect()):
        sums.append((p, total))
        total += n
    before = docs.sparkSession.createDataFrame(sums, "p int, before long")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("at"))
    marked = ranged.withColumn("p", task.cast("int")).join(F.broadcast(before), "p").withColumn("upto", upto)
    ends = marked.where(F.floor((F.col("upto") - F.col("n")) / part_bytes) != F.floor(F.col("upto") / part_bytes)).select("i", "h").distinct()
    found = sorted(tuple(r) for r in ends.collect())
    forget(ranged)
    return np.array([i for i, _ in found], np.int64), np.array([h for _, h in found], np.int64)


def part_of(ids: np.ndarray, hashes: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bounds a document is behind: the bounds are the last documents of their parts."""
    lo, hi = np.searchsorted(cuts[0], ids, "left"), np.searchsorted(cuts[0], ids, "right")
    for k in np.flatnonzero(lo < hi).tolist():  # bounds of the same doc_id
        lo[k] += np.searchsorted(cuts[1][lo[k] : hi[k]], hashes[k], "left")
    return lo


def _pack(rows: list[tuple[int, int, int, bytes | None]]) -> bytes:
    """(null id, id, hash, text) of documents."""
    numbers = np.array([(gone, i, h, -1 if t is None else len(t)) for gone, i, h, t in rows], _ID).T
    return zstandard.compress(np.array([len(rows)], _ID).tobytes() + np.ascontiguousarray(numbers).tobytes() + b"".join(t or b"" for *_, t in rows), 3)


def _unpack(blobs: list[bytes]) -> tuple[list[int | None], list[bytes | None]]:
    """The part's documents in order."""
    rows = []
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n = int(np.frombuffer(raw, _ID, 1)[0])
        gone, ids, hashes, sizes = np.frombuffer(raw, _ID, 4 * n, 8).reshape(4, n).tolist()
        at = 8 + 32 * n
        for g, i, h, size in zip(gone, ids, hashes, sizes, strict=True):
            end = at + max(size, 0)
            rows.append((i, h, g, None if size < 0 else raw[at:end]))
            at = end
    rows.sort(key=lambda r: (r[0], r[1], r[3] or b""))
    return [None if r[2] else r[0] for r in rows], [r[3] for r in rows]


def _to_parts(cuts):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush():
            keys = sorted(held)
            out = pa.RecordBatch.from_pydict({"part": pa.array(keys, pa.int32()), "docs": pa.array([_pack(held[k]) for k in keys], pa.binary())})
            held.clear()
            return out

        for batch in batches:
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids, hashes, texts = batch.column("doc_id").fill_null(FIRST).to_numpy(), batch.column("h").to_numpy(), batch.column("text")
            for i, part in enumerate(part_of(ids, hashes, cuts.value).tolist()):
                text = texts[i].as_py()
                held.setdefault(part, []).append((int(null[i]), int(ids[i]), int(hashes[i]), text))
                size += len(text or b"") + 16
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _page_windows(texts: list[bytes | None], width: int) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and for each window its two hashes and the offset of its first word."""
    words = K.split(texts, K.SPACE)
    one = words.hashes()
    a, at = K.windows(one, words.first, width)
    b, _ = K.windows(one, words.first, width, 0xD1342543DE82EF95)
    return words, a, b, at


def _first_in_page(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A mask of the windows that do not occur earlier in the page."""
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    first = np.ones(len(a), bool)
    first[order[1:]] = ~same  # lexsort is stable: of equal windows the earliest comes first
    return first


def _pages(part: int, texts: list[bytes | None], page_bytes: int) -> Iterator[tuple[int, int, int]]:
    """(page, first, last) of a part's pages: runs of its documents."""
    for k, (lo, hi) in enumerate(K.groups(texts, page_bytes)):
        yield part << PAGE_BITS | k, lo, hi


def _emit_windows(width: int, buckets: int, hash_bytes: int, page_bytes: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.trim()
        _, texts = _unpack([blob for batch in batches for blob in batch.column("docs").to_pylist()])
        for page, first, last in _pages(key[0].as_py(), texts, page_bytes):
            _, a, b, at = _page_windows(texts[first:last], width)
            keep = _first_in_page(a, b)
            a, b, at = a[keep], b[keep], at[keep]
            bucket = (b & np.uint64(buckets - 1)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, at = bucket[order], at[order]
            raw = a[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :hash_bytes]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            lo, hi = np.r_[0, cut], np.r_[cut, len(bucket)]
            if not len(bucket):
                continue
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(bucket[lo].astype(np.int32), pa.int32()),
                "page": pa.array([page] * len(lo), pa.int64()),
                "hashes": pa.array([raw[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()),
                "at": pa.array([pack_offsets(at[i:j]) for i, j in zip(lo, hi, strict=True)], pa.binary()),
            })

    return run


def pack_offsets(at: np.ndarray) -> bytes:
    """Ascending offsets as compressed gaps; low and high bytes apart, as the high ones are mostly zero."""
    gaps = np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(gaps.T).tobytes(), 1)


def unpack_offsets(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _find_repeats(hash_bytes: int):
    def run(rows: pa.Table) -> pa.Table:
        K.trim()
        rows = rows.sort_by("page")
        pages = rows.column("page").to_pylist()
        blobs = rows.column("hashes").to_pylist()
        counts = np.array([len(b) // hash_bytes for b in blobs])
        wide = np.zeros((int(counts.sum()), 8), np.uint8)
        wide[:, :hash_bytes] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, hash_bytes)
        h = wide.view("<u8").ravel()
        order = np.argsort(h, kind="stable")  # rows come by page, and offsets ascend
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        ends = np.cumsum(counts)
        out_page, out_at = [], []
        offsets = rows.column("at").to_pylist()
        for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            hit = np.flatnonzero(again[end - n : end])
            if len(hit):
                out_page.append(pages[i])
                out_at.append(pack_offsets(unpack_offsets(offsets[i])[hit]))
        return pa.table({"part": pa.array([p >> PAGE_BITS for p in out_page], pa.int32()), "page": pa.array(out_page, pa.int64()), "hits": pa.array(out_at, pa.binary())})

    return run


def _apply(width: int, with_text: bool, page_bytes: int):
    def run(key: tuple[pa.Scalar, ...], parts: pa.Table, hits: pa.Table) -> pa.Table:
        K.trim()
        ids, texts = _unpack(parts.column("docs").to_pylist())
        found: dict[int, list] = {}
        for page, blob in zip(hits.column("page").to_pylist(), hits.column("hits").to_pylist(), strict=True):
            found.setdefault(page, []).append(unpack_offsets(blob))
        out = [_removed(ids[lo:hi], texts[lo:hi], found.get(page, []), width, with_text) for page, lo, hi in _pages(key[0].as_py(), texts, page_bytes)] if ids else []
        return pa.concat_tables(out or [_removed([], [], [], width, with_text)])

    return run


def _removed(ids: list, texts: list, gone_at: list[np.ndarray], width: int, with_text: bool) -> pa.Table:
    """The documents of a page without the words that windows at these offsets, or repeats within the page, cover."""
    words, a, b, at = _page_windows(texts, width)
    own = at[~_first_in_page(a, b)]
    gone = K.covered(len(words), np.concatenate([own, *gone_at]), width)
    removed = np.add.reduceat(np.r_[gone, False], words.first[:-1]) if len(ids) else np.zeros(0)
    removed = np.where(np.diff(words.first) > 0, removed, 0)
    kept = []
    for i, text in enumerate(texts):
        own_words = (text or b"").split()  # bytes.split: the six white-space bytes of SPACE
        if removed[i]:
            mask = gone[words.first[i] : words.first[i + 1]].tolist()
            own_words = [w for w, x in zip(own_words, mask, strict=True) if not x]
        kept.append(b" ".join(own_words))
    out = {
        "doc_id": pa.array(ids, pa.int64()),
        "n_words": pa.array(np.diff(words.first).astype(np.int64)),
        "n_removed": pa.array(removed.astype(np.int64)),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    }
    if with_text:
        out["kept"] = pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())
    return pa.table(out)


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False, hash_bytes: int = 8, pages: int | None = None, buckets: int | None = None, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Removes every word that a window repeating an earlier one covers: doc_id, n_words, n_removed, kept_sha256 and, if asked,
    kept. pages: how many parts documents are dealt into."""
    size = 2 * input_bytes(docs)
    part_bytes = max(1, size // pages) if pages else max(page_bytes, size // PARTS)
    buckets = buckets or 1 << max(4, (2 * size // BUCKET_BYTES).bit_length())
    cuts = docs.sparkSession.sparkContext.broadcast(boundaries(docs, part_bytes))
    parts = docs.select("doc_id", as_bytes(), F.xxhash64("text").alias("h")).mapInArrow(_to_parts(cuts), "part int, docs binary")
    sent = parts.groupBy("part").applyInArrow(_emit_windows(width, buckets, hash_bytes, page_bytes), "bucket int, page long, hashes binary, at binary")
    hits = sent.groupBy("bucket").applyInArrow(_find_repeats(hash_bytes), "part int, page long, hits binary")
    kept = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return parts.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_apply(width, with_text, page_bytes), kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, s, array_to_string(words[s : s + 19], ' ') AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM later, (SELECT unnest(range(0, 20)) AS k)),
each AS (SELECT w.doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) w),
kept AS (SELECT e.doc_id, count(*) AS n, count(g.i) AS gone, coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS text
         FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

"""MinHash near-dedup: bands find candidates, odd sketches rank them, full shingle sets confirm them.

1. Each document gives its set of 5-word shingles: its size, a 128-bit key of the set, HASHES minima in
   bands of ROWS, and an odd sketch: the minima folded into a parity bitmap, in which XOR and a population
   count estimate the similarity.
2. Documents of equal sets are one class, named by its smallest doc_id; what follows sees one of each.
3. Every class is tied to the smallest of each bucket that it shares (a star: no pairs within a group).
4. Ties that the sizes and sketches allow are confirmed on the full sets, and confirmed ones merged.
5. Buckets that still hold several components are searched in rounds: each class outside the bucket's main
   component takes its K nearest classes in other components, confirmed ones merge. Here the odd sketches are
   of the whole sets, two bits a shingle or more: at least as many shingles are in just one of two sets as bits
   differ, so nothing is lost by them, and few pairs pass that are not linked. K grows until no class has
   candidates left untested, so no link that shares a bucket is lost. Large buckets are salted on both sides. What is
   known of buckets is broadcast where it is few rows, so that no bucket's members are gathered to meet it; in a join
   that is too large for that Spark splits large buckets.

Bands: two documents at a similarity of 0.85 share no bucket with a probability of (1 - 0.85**4)**20 = 4e-7.
The sketch's limit lets them pass unless 33 of their 80 minima or more differ (12 are expected).

Cases: a document without words, or without text, has an empty set and stands alone; fewer than five words
are one shingle. A null doc_id stands alone. Rows that share a doc_id are one document: their sets are all
linked to it. Very long texts are hashed in blocks; a document's set is held whole (8 bytes a word). Extra columns are
ignored by labelled() and pass through deduplicated(), whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import kernels as K
from foliant.llm.common import as_bytes, dealt, few, file_count, forget, input_bytes, saved, table
from foliant.llm.components import components

SHINGLE = 5
PERCENT = 85
ROWS, BANDS = 4, 20
SKETCH_WORDS = 4
SALT_ROWS = 512
ROUNDS = (4, 32, 256, 4096, None)

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    words = K.split(texts, K.SPACE, lower=True)
    one, lengths = words.hashes(), np.diff(words.first)
    hashes, at = K.windows(one, words.first, SHINGLE)
    cut = np.searchsorted(at, words.first)
    sets = []
    for i, n in enumerate(lengths.tolist()):
        if n >= SHINGLE:
            sets.append(np.unique(hashes[cut[i] : cut[i + 1]]))
        elif n:
            lo = words.first[i]
            sets.append(K.windows(one[lo : lo + n], np.array([0, n]), n)[0] ^ np.uint64(n))
        else:
            sets.append(hashes[:0])
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return np.concatenate([*sets, hashes[:0]]), first


@K.tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in K.groups(texts):
            values, first = shingle_sets(texts[lo:hi])
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            starts = first[:-1][full]
            keys = np.zeros((hi - lo, 2), np.uint64)
            minima = np.zeros((len(full), ROWS * BANDS), np.uint32)
            if len(full):
                keys[full, 0] = np.add.reduceat(K.mix(values), starts)
                keys[full, 1] = np.add.reduceat(K.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                short = (values >> np.uint64(32)).astype(np.uint32)
                for j in range(ROWS * BANDS):
                    minima[:, j] = np.minimum.reduceat(short * _A[j] + _B[j], starts)
            tagged = K.mix(minima.astype(np.uint64) ^ (np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) << np.uint64(32)))
            sketch = K.parity_bits(tagged.ravel(), np.arange(len(full) + 1) * ROWS * BANDS, SKETCH_WORDS)
            bands = K.mix(tagged.reshape(len(full), BANDS, ROWS).cumsum(2)[:, :, -1] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            ids = batch.column("doc_id").slice(lo, hi - lo)
            all_bands: list = [None] * (hi - lo)
            all_sketch: list = [None] * (hi - lo)
            for i, k in enumerate(full.tolist()):
                all_bands[k], all_sketch[k] = bands[i], sketch[i].tobytes()
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "n": pa.array(sizes, pa.int64()),
                "k1": pa.array(keys[:, 0].view(np.int64)), "k2": pa.array(keys[:, 1].view(np.int64)),
                "bands": pa.array(all_bands, pa.list_(pa.int64())), "sketch": pa.array(all_sketch, pa.binary()),
            })


@K.tidy
def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in K.groups(texts):
            values, first = shingle_sets(texts[lo:hi])
            sets = [values[first[i] : first[i + 1]] for i in range(hi - lo)]
            parity = [K.parity_bits(K.mix(v), np.array([0, len(v)]), parity_words(len(v))).tobytes() for v in sets]
            yield pa.RecordBatch.from_pydict({"node": batch.column("doc_id").slice(lo, hi - lo), "shingles": pa.array([v.tobytes() for v in sets], pa.binary()), "parity": pa.array(parity, pa.binary())})


def _confirm(percent: int):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _limit(percent: int) -> int:
    """Differing sketch bits up to which a pair may have the similarity: 33 differing minima of 80 at 85 %."""
    hashes, size = ROWS * BANDS, 64 * SKETCH_WORDS
    p = 1 - percent / 100
    differing = hashes * p + 6 * (hashes * p * (1 - p)) ** 0.5 + 1
    expected = size / 2 * (1 - np.exp(-4 * differing / size))
    return int(expected + 3 * (size * 0.25) ** 0.5 / 2)


def parity_words(n: int) -> int:
    """Words of 64 bits in the sketch of a whole set of n shingles."""
    return 1 << max(2, (2 * n - 1) // 64).bit_length()


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while sketch.shape[1] > words:
        sketch = sketch[:, : sketch.shape[1] // 2] ^ sketch[:, sketch.shape[1] // 2 :]
    return sketch


def _pairs(k: int | None, percent: int):
    def fits(y, x, apart):
        least, most = np.minimum(y["n"], x["n"]), np.maximum(y["n"], x["n"])
        return ((100 + percent) * apart.astype(np.int64) <= (100 - percent) * (y["n"] + x["n"])) & (y["component"] != x["component"]) & (100 * least >= percent * most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.trim()
        rows = pa.Table.from_batches(list(batches))  # 2 * SALT_ROWS at most, about
        cols = {c: rows.column(c).to_numpy() for c in ("node", "n", "component")}
        sketches = rows.column("parity").to_pylist()
        words = np.array([len(s) // 8 for s in sketches])
        role = rows.column("asks").to_numpy()
        sides = {}
        for asks in (True, False):
            for w in np.unique(words[role == asks]).tolist():
                own = np.flatnonzero((role == asks) & (words == w))
                sides[asks, w] = {c: v[own] for c, v in cols.items()} | {"sketch": np.frombuffer(b"".join(sketches[i] for i in own), "<u8").reshape(-1, w)}
        for (asks, wy), y in sides.items():
            for wx in (wy // 2, wy, 2 * wy) if asks else ():
                if (x := sides.get((False, wx))) is None:
                    continue
                w = min(wx, wy)
                y2, x2 = y | {"sketch": _fold(y["sketch"], w)}, x | {"sketch": _fold(x["sketch"], w)}
                for i, j, m in K.candidates(y2, x2, k, fits):  # of a block of askers at a time
                    yield pa.RecordBatch.from_pydict({"y": y["node"][i], "x": x["node"][j], "more": m})

    return run


def labelled(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    source, files = docs.select("doc_id", as_bytes()), file_count(input_bytes(docs))
    marked = saved(source.mapInArrow(_features, "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch binary"), "minhash")
    limit = _limit(percent)
    classes = marked.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("r"))
    nodes = saved(classes.select("k1", "k2", "n", F.col("r.doc_id").alias("node"), "r.bands", "r.sketch"), "classes", files)
    made = [marked, nodes]

    def keep(df: DataFrame, what: str) -> DataFrame:
        made.append(saved(df, what, files))
        return made[-1]

    def met(df: DataFrame, known: DataFrame, on: str, how: str = "inner") -> DataFrame:
        """df joined with a written table of one row for each value of `on`."""
        return df.join(F.broadcast(known) if few(known) else known, on, how)

    rows = nodes.select("node", "n", "sketch", F.explode("bands").alias("band"))
    shared = keep(rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").drop("most"), "shared")
    members = keep(met(rows, shared, "band"), "members")

    wanted = keep(members.select("node").distinct(), "candidates")
    found = source.withColumnRenamed("doc_id", "node").join(F.broadcast(wanted) if few(wanted) else wanted, "node", "left_semi")
    sets = saved(found.select(F.col("node").alias("doc_id"), "text").mapInArrow(_emit_sets, "node long, shingles binary, parity binary"), "sets")
    made.append(sets)

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long")

    light = members.select("node", "n", "sketch").distinct()
    stars = members.where("node <> least").select("node", "least", "n", "sketch").distinct()
    heads = light.select(F.col("node").alias("least"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    near = stars.join(heads, "least").where(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
    apart = sum((F.bit_count(F.conv(F.substring(F.hex("sketch"), 8 * i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(F.hex("s2"), 8 * i + 1, 8), 16, 10).cast("long"))) for i in range(8 * SKETCH_WORDS // 4)), F.lit(0))
    links = confirmed(near.where(apart <= limit).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    label = components(links, files)
    shapes = sets.select("node", "parity").join(light.select("node", "n"), "node")
    asking = None
    for k in ROUNDS:
        held = members.select("band", "node")
        if asking is not None:  # only those with candidates left untested ask again, in their buckets
            buckets = keep(met(held, asking, "node", "left_semi").select("band").distinct(), "buckets")
            held = met(held, buckets, "band", "left_semi")
        known = shapes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        now = keep(held.join(known, "node"), "open")
        sums = now.groupBy("band", "component").count().groupBy("band").agg(F.count("*").alias("components"), F.sum("count").alias("size"), F.max_by("component", F.struct("count", "component")).alias("main"))
        mixed = keep(sums.where("components > 1").select("band", "main", F.ceil(F.col("size") / SALT_ROWS).cast("int").alias("salts")), "mixed")
        spread = met(now, mixed, "band")
        ask = spread.where("component <> main") if asking is None else met(spread, asking, "node", "left_semi")
        askers = keep(ask.groupBy("band").count().select("band", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("parts")), "askers")
        # a grid of cells: those asked are in one row of a bucket's cells, those that ask in one column
        rows = met(spread, askers, "band").withColumns({"salt": F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "asks": F.lit(False)})
        ask = met(ask, askers, "band").withColumns({"salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "part": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "asks": F.lit(True)})
        cols = ["band", "salt", "part", "asks", "node", "n", "component", "parity"]
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes, but much to compare
        tried = dealt(rows.select(cols).unionByName(ask.select(cols)), parts, "band", "salt", "part").groupBy("band", "salt", "part").applyInArrow(_pairs(k, percent), "y long, x long, more boolean")
        pairs = keep(tried.groupBy("y", "x").agg(F.max("more").alias("more")), "pairs")
        new = confirmed(pairs.select(F.least("y", "x").alias("a"), F.greatest("y", "x").alias("b")).distinct())
        own = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        other = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        joined = keep(new.join(own, "a", "left").join(other, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "merges")
        if not joined.isEmpty():
            label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(joined), files)
        asking = keep(pairs.where("more").select(F.col("y").alias("node")).distinct(), "asking")
        if asking.isEmpty():
            break
    for table_ in made[2:]:
        forget(table_)
    classed = nodes.select("k1", "k2", "n", "node").join(label, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("c"))
    # copies of one class may hold a third of all rows: those that are no smallest doc_id are a plain join, which Spark splits
    out = marked.select("doc_id", "n", "k1", "k2").join(classed, ["k1", "k2", "n"], "left").withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without those that are not the smallest doc_id of their component; all columns stay."""
    gone = saved(labelled(docs, percent).where("not kept").select("doc_id").distinct(), "near-copies", file_count(input_bytes(docs)))
    return docs.join(F.broadcast(gone) if few(gone) else gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, w.doc_id = c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = w.doc_id
"""

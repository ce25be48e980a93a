"""Nearest neighbours by inner product: a block matrix join of int8 tiles with error bounds.

Vectors are quantised to int8 with a scale each. A tile is the product of a block of queries with a block
of candidates; the products of int8 are integers, summed over EXACT_DIMS components at a time, where they stay below
2**24, so that a float32 matrix product has them exactly. With |error of a component| <= scale / 2 the true product
lies within

    s_c / 2 * |q|_1 + s_q / 2 * |c'|_1      (c' the candidate as quantised)

of the tile's value. Pairs whose upper bound stays below the query's 20th best lower bound are dropped
without loss; the rest is computed again on the original vectors in double precision, term by term in the
order of the components, and a heap for each query keeps the best. The search is exact.

Queries are taken in passes of PASS_QUERIES at most: a pass broadcasts its queries, and each task multiplies blocks of
QUERY_BLOCK of them with the blocks of its candidates. Where there are several passes they run one after another, each
written to the shared folder, so that no more than a pass's queries are held anywhere. The heaps of all tasks are merged
by rank.

Cases: vectors that are null, zero or hold null or non-finite components take no part, nor do those whose
length differs from most. Ties go to the smaller vec_id. A repeated vec_id is a row of its own as a candidate,
and never its own neighbour; as a query it counts once (the vector that sorts first). Extra columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import saved, table

TOP = 20
PASS_QUERIES = 32_768
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 2048
#: 127 * 127 * 1024 < 2**24
EXACT_DIMS = 1024


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 components and the scale of each row."""
    scale = np.abs(v).max(1) / 127
    return np.rint(v / scale[:, None]).astype(np.int8), scale


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row inner products, in double precision and in the order of the components."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of int8 values held as float32."""
    if a.shape[1] <= EXACT_DIMS:
        return a @ b.T
    return sum((a[:, d : d + EXACT_DIMS] @ b[:, d : d + EXACT_DIMS].T).astype(float) for d in range(0, a.shape[1], EXACT_DIMS))


class _Heaps:
    """For each query of a block a heap of its best candidates so far: (score, -id), the worst on top."""

    def __init__(self, n: int, top: int):
        self.top, self.heaps, self.floor = top, [[] for _ in range(n)], np.full(n, -np.inf)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for row, score, i in zip(rows.tolist(), scores.tolist(), ids.tolist(), strict=True):
            heap = self.heaps[row]
            if len(heap) < self.top:
                heapq.heappush(heap, (score, -i))
            elif (score, -i) > heap[0]:
                heapq.heapreplace(heap, (score, -i))
            if len(heap) == self.top:
                self.floor[row] = heap[0][0]


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _search(queries, dims: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = queries.value
        q8, qs = quantise(q)
        q8, q1 = q8.astype(np.float32), np.abs(q).sum(1)
        best = [_Heaps(len(qid[i : i + QUERY_BLOCK]), top) for i in range(0, len(qid), QUERY_BLOCK)]
        for batch in batches:
            ids, all_c = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dims)
            for lo in range(0, len(ids), CANDIDATE_BLOCK):
                cid, c = ids[lo : lo + CANDIDATE_BLOCK], all_c[lo : lo + CANDIDATE_BLOCK]
                c8, cs = quantise(c)
                c1 = np.abs(c8.astype(np.int64)).sum(1) * cs
                c8 = c8.astype(np.float32)
                for b, held in enumerate(best):
                    at = slice(b * QUERY_BLOCK, (b + 1) * QUERY_BLOCK)
                    near = tile(q8[at], c8) * (qs[at, None] * cs[None, :])
                    slack = (0.5 * q1[at, None] * cs[None, :] + 0.5 * qs[at, None] * c1[None, :]) * (1 + 1e-9) + 1e-12
                    low = near - slack
                    own = qid[at, None] == cid[None, :]
                    low[own] = -np.inf
                    floor = held.floor
                    if len(cid) >= top:
                        floor = np.maximum(floor, np.partition(low, -top, axis=1)[:, -top])
                    rows, cols = np.nonzero((near + slack >= floor[:, None]) & ~own)
                    held.add(rows, exact(q[at][rows], c[cols]), cid[cols])
        for b, held in enumerate(best):
            own = [(int(qid[b * QUERY_BLOCK + row]), -i, score) for row, heap in enumerate(held.heaps) for score, i in heap]
            yield pa.RecordBatch.from_pydict({c: pa.array([o[k] for o in own], t) for k, (c, t) in enumerate({"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}.items())})

    return run


def nearest(vectors: DataFrame, is_query, top: int = TOP, pass_queries: int = PASS_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest of each row for which the column is_query holds."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    if sizes:
        dims = sizes.d
        rows = rows.where(F.size("v") == dims)
        asked = rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v"))
        passes = -(-asked.count() // pass_queries)
        for k in range(passes):
            part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == k)
            got = part.toArrow().sort_by("vec_id")
            queries = spark.sparkContext.broadcast((got.column("vec_id").to_numpy(), _matrix(got.column("v").combine_chunks(), dims)))
            found = rows.select("vec_id", "v").mapInArrow(_search(queries, dims, top), "query_id long, vec_id long, score double")
            if passes == 1:
                out = found
            else:
                out = out.unionByName(saved(_ranked(found, top).drop("rank"), "nearest"))
                queries.unpersist()
    return _ranked(out, top).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

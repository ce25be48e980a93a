"""Sharding by Hilbert-curve order: several metadata dimensions quantised, sorted by curve index, cut into runs.

The law is `rows`: runs of the sorted order whose counts differ by at most one. Each dimension is quantised
at its own quantiles over all rows, so that crowded values are spread: numbers at approximate ones, strings at those of
their distinct values' counts, whatever beginnings they share. Rows in one cell of the curve are ordered by the
checksum of the text and doc_id, which keeps equal texts side by side. Files cut from such runs have narrow ranges in
every dimension, which min/max statistics prune on.

The order is global without a single task: rows are range-partitioned and sorted by all keys (so a crowded
cell is split as well), written once, and counted by partition; only those counts reach the driver.

Cases: a null text has size 16 and checksum 0, as an empty one; nulls in a dimension come first; repeated
rows are separate rows with slots of their own; an empty table gives no rows; extra columns are ignored, whatever
their names. Texts are not read beyond their sizes and checksums, so very long ones do no harm.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import file_count, forget, input_bytes, saved, table

SHARDS = 40
BITS = 8
#: Rows of a partition of the global order, and distinct strings whose counts may go to the driver.
PART_ROWS = 1_000_000
DISTINCT_ROWS = 100_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of points (rows) with coordinates below 2**bits: inverse undo and Gray encoding over all rows at once."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - np.uint64(1)), flip)
        q >>= np.uint64(1)
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def _cells(column: pa.Array, cuts: list) -> np.ndarray:
    """The cell of each value: how many cuts it reaches. Nulls are in the first."""
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        own = np.array([bisect.bisect_right(cuts, v.encode()) for v in coded.dictionary.to_pylist()] + [0], np.int64)
        return own[coded.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)]
    return np.searchsorted(np.array(cuts, float), column.to_numpy(zero_copy_only=False), "right")


def _index(cuts: list[list], bits: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [_cells(batch.column(n), b) for b, n in zip(cuts, names, strict=True)]
            index = hilbert_index(np.stack(cells, 1), bits) if len(batch) else np.zeros(0, np.int64)
            yield batch.select(["doc_id", "size", "text_crc32"]).append_column("curve", pa.array(index, pa.int64()))

    return run


def _string_cuts(points: DataFrame, name: str, rows: int, bits: int) -> list[bytes]:
    """The values (as bytes) at which rows, sorted by them, go over a multiple of rows / 2**bits: 2**bits at most."""
    counts = saved(points.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("binary").alias("v")).count(), "hilbert-values", file_count(input_bytes(points)))
    step = max(1, -(-rows // (1 << bits)))
    if counts.limit(DISTINCT_ROWS + 1).count() <= DISTINCT_ROWS and (counts.agg(F.sum(F.length("v"))).head()[0] or 0) <= 16 << 20:
        cuts, total = [], 0
        for v, n in sorted((bytes(r.v), r["count"]) for r in counts.collect()):
            if total // step != (total + n) // step:
                cuts.append(v)
            total += n
    else:  # the same over sorted partitions
        parts = max(4, counts.count() // PART_ROWS)
        ranged = saved(counts.repartitionByRange(parts, "v").sortWithinPartitions("v").withColumn("at", F.monotonically_increasing_id()), "hilbert-sorted")
        part = F.shiftright("at", 33)
        before, sums = 0, {}
        for p, n in sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).agg(F.sum("count")).collect()):  # one row for each partition
            sums[p], before = before, before + n
        starts = points.sparkSession.createDataFrame(list(sums.items()), "p long, before long")
        upto = F.col("before") + F.sum("count").over(Window.partitionBy("p").orderBy("at"))
        crossed = F.floor((F.col("upto") - F.col("count")) / step) != F.floor(F.col("upto") / step)
        own = ranged.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("upto", upto).where(crossed)
        cuts = sorted(bytes(r.v) for r in own.select("v").collect())
        forget(ranged)
    forget(counts)
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS, dims: tuple[str, ...] = ("source", "lang", "size", "doc_id"), bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: only the law `key` has one)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.withColumns({"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(text)})
    names = [f"_d{i}" for i in range(len(dims))]
    strings = [n for n, d in zip(names, dims, strict=True) if dict(base.dtypes)[d] == "string"]
    number = lambda d: F.coalesce(F.col(d).cast("double"), F.lit(float("-inf")))
    points = base.select("doc_id", "size", "text_crc32", *[(F.col(d) if n in strings else number(d)).alias(n) for d, n in zip(dims, names, strict=True)])
    points = saved(points, "hilbert-points")  # narrow: the texts are read once
    steps = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    numbers = points.agg(F.count("*").alias("n"), *[F.percentile_approx(n, steps, 10_000).alias(n) for n in names if n not in strings]).head()
    cuts = [_string_cuts(points, n, numbers["n"], bits) if n in strings else sorted(numbers[n] or []) for n in names]
    cuts = [c[: (1 << bits) - 1] for c in cuts]
    curved = points.mapInArrow(_index(cuts, bits, names), "doc_id long, size long, text_crc32 long, curve long")
    parts = max(4, numbers["n"] // PART_ROWS)
    keys = ["curve", "text_crc32", "doc_id", "size"]
    ranged = curved.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    ranged = saved(ranged, "hilbert-order")
    part = F.shiftright("_row", 33)
    counts = sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).count().collect())  # one row for each partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    starts = spark.createDataFrame(before, "_p long, _before long")
    rank = F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)
    # the first total % shards runs are one row longer
    short, extra = divmod(total, shards)
    long_rows = extra * (short + 1)
    after = F.lit(extra) + F.floor((F.col("rank") - long_rows) / F.lit(max(short, 1)))
    which = F.when(F.col("rank") < long_rows, F.floor(F.col("rank") / F.lit(short + 1))).otherwise(after)
    begin = F.when(F.col("shard") < extra, F.col("shard") * (short + 1)).otherwise(long_rows + (F.col("shard") - extra) * short)
    out = ranged.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn("rank", rank).withColumn("shard", which.cast("int"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

"""Tensor operators on coordinate tables: one row for each element, (tensor_id, coordinates, v).

Reductions are groupings, matrix products and convolutions equi-joins with weight tables (broadcast if they are small)
followed by a sum, so that padding taps are skipped, never multiplied. Operators on whole tensors, without a shuffle, are
in blocks.py; this form is for elements that already are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.bounds import small


def coordinates(vectors: DataFrame, shape: tuple[int, ...], names: str = "chw") -> DataFrame:
    """(vec_id, one column for each axis, v) from an array column: a projection of the position."""
    flat = vectors.select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    step = 1
    for n, name in reversed(list(zip(shape, names, strict=True))):
        flat = flat.withColumn(name, (F.floor(F.col("i") / step) % n).cast("int"))
        step *= n
    return flat.select("vec_id", *names, "v")


def reduce_mean(x: DataFrame, keep: list[str]) -> DataFrame:
    return x.groupBy(*keep).agg(F.avg("v").alias("v"))


def softmax(x: DataFrame, over: list[str]) -> DataFrame:
    w = Window.partitionBy(*over)
    e = x.withColumn("e", F.exp(F.col("v") - F.max("v").over(w)))
    return e.withColumn("v", F.col("e") / F.sum("e").over(w)).drop("e")


def matmul(a: DataFrame, b: DataFrame, batch: list[str]) -> DataFrame:
    """a (batch, i, k, v) times b (k, j, w) or (batch, k, j, w)."""
    keys = ["k", *[c for c in batch if c in b.columns]]
    return a.join(b if len(keys) > 1 else small(b), keys).groupBy(*batch, "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def conv(x: DataFrame, w: DataFrame, size: tuple[int, int], stride: int = 1, pad: int = 0, dilation: int = 1, depthwise: bool = False, kernel: tuple[int, int] = (3, 3), pad_w: int | None = None) -> DataFrame:
    """x (vec_id, c, h, w, v); every input cell meets the taps of its channel, and is summed where it lands."""
    pad_w = pad if pad_w is None else pad_w
    out = [(n + 2 * p - dilation * (k - 1) - 1) // stride + 1 for n, p, k in zip(size, (pad, pad_w), kernel, strict=True)]
    on = F.col("c") == (F.col("oc") if depthwise else F.col("ic"))
    y, z = F.col("h") + pad - F.col("kh") * dilation, F.col("w") + pad_w - F.col("kw") * dilation
    hit = x.join(small(w), on).withColumns({"y": y, "z": z}).where((F.col("y") % stride == 0) & (F.col("z") % stride == 0) & F.col("y").between(0, (out[0] - 1) * stride) & F.col("z").between(0, (out[1] - 1) * stride))
    return hit.groupBy("vec_id", F.col("oc").alias("c"), (F.col("y") / stride).cast("int").alias("h"), (F.col("z") / stride).cast("int").alias("w")).agg(F.sum(F.col("v") * F.col("wv")).alias("v"))


def conv_transpose(x: DataFrame, w: DataFrame, stride: int) -> DataFrame:
    hit = x.join(small(w), F.col("c") == F.col("ic"))
    return hit.groupBy("vec_id", F.col("oc").alias("c"), (F.col("h") * stride + F.col("kh")).alias("h"), (F.col("w") * stride + F.col("kw")).alias("w")).agg(F.sum(F.col("v") * F.col("wv")).alias("v"))


def pool(x: DataFrame, how: str, size: int, kernel: int, stride: int, pad: int = 0, count_pad: bool = False) -> DataFrame:
    """Maximum or average over windows; padded cells do not take part, unless counted in the divisor."""
    out = (size + 2 * pad - kernel) // stride + 1
    taps = F.array(*map(F.lit, range(kernel)))
    each = x.withColumn("kh", F.explode(taps)).withColumn("kw", F.explode(taps)).withColumns({"y": F.col("h") + pad - F.col("kh"), "z": F.col("w") + pad - F.col("kw")})
    each = each.where((F.col("y") % stride == 0) & (F.col("z") % stride == 0) & F.col("y").between(0, (out - 1) * stride) & F.col("z").between(0, (out - 1) * stride))
    value = F.max("v") if how == "max" else F.sum("v") / (F.lit(kernel * kernel) if count_pad else F.count("v"))
    return each.groupBy("vec_id", "c", (F.col("y") / stride).cast("int").alias("h"), (F.col("z") / stride).cast("int").alias("w")).agg(value.alias("v"))


def resize_nearest(x: DataFrame, scale: int) -> DataFrame:
    """Asymmetric, floor: each cell becomes a block of scale by scale."""
    steps = F.array(*map(F.lit, range(scale)))
    return x.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps)).select("vec_id", "c", (F.col("h") * scale + F.col("a")).alias("h"), (F.col("w") * scale + F.col("b")).alias("w"), "v")


def slice_axis(x: DataFrame, axis: str, start: int, end: int, step: int = 1, size: int | None = None) -> DataFrame:
    """Negative bounds count from the end (size is needed then); an empty range is an error."""
    start, end = (b + size if b < 0 else b for b in (start, end))
    end = end if size is None else min(end, size)
    if step < 1 or start >= end:
        raise ValueError("empty slice, or a step below one")
    at = F.col(axis)
    return x.where((at >= start) & (at < end) & ((at - start) % step == 0)).withColumn(axis, ((at - start) / step).cast("int"))


def concat(parts: list[DataFrame], axis: str, sizes: list[int]) -> DataFrame:
    out, offset = None, 0
    for part, size in zip(parts, sizes, strict=True):
        part = part.withColumn(axis, F.col(axis) + offset)
        out = part if out is None else out.unionByName(part)
        offset += size
    return out


def winner(values: Column) -> tuple[Column, Column]:
    """Class and softmax probability of the first maximum of an array, without the softmax of the others."""
    top = F.array_max(values)
    return (F.array_position(values, top) - 1).cast("int"), 1 / F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))

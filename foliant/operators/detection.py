"""Post-processing of detection maps: threshold, dilation, components, boundaries, upright rectangle scores.

Masks are batches of maps (n, height, width); the functions on pixels below take tables of (vec_id, h, w).
Rotated rectangles are in rectangles.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(maps: np.ndarray, t: float) -> np.ndarray:
    """Pixels strictly above t."""
    return maps > t


def dilated(mask: np.ndarray) -> np.ndarray:
    """Each pixel spreads right, down and diagonally, within the map."""
    out = mask.copy()
    out[:, :, 1:] |= mask[:, :, :-1]
    out[:, 1:] |= out[:, :-1].copy()
    return out


def edge(mask: np.ndarray) -> np.ndarray:
    """Pixels at the edge of the map, or with one of four neighbours not set."""
    inner = np.zeros_like(mask)
    inner[:, 1:-1, 1:-1] = mask[:, :-2, 1:-1] & mask[:, 2:, 1:-1] & mask[:, 1:-1, :-2] & mask[:, 1:-1, 2:]
    return mask & ~inner


def labels(mask: np.ndarray) -> np.ndarray:
    """For each pixel the smallest position (row-major) of its 8-connected component; -1 elsewhere.

    Runs of pixels in a row are the nodes; runs of neighbouring rows that touch are linked, and take the smallest
    label that they reach, over links and over their label's own label, until none changes."""
    n, height, width = mask.shape
    wide = np.zeros((n * height, width + 1), np.int8)
    wide[:, :width] = mask.reshape(-1, width)
    turn = np.diff(np.r_[np.int8(0), wide.ravel()])
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    out = np.full(mask.shape, -1, np.int64)
    if not len(start):
        return out
    row, x0, x1 = start // (width + 1), start % (width + 1), end - 1 - start // (width + 1) * (width + 1)
    # runs of the row above whose end is not left of the neighbourhood, and whose start is not right of it
    above = (row - 1) * (width + 1)
    lo, hi = np.searchsorted(end - 1, above + x0 - 1, "left"), np.searchsorted(start, above + x1 + 1, "right")
    lo, hi = np.where(row % height > 0, lo, 0), np.where(row % height > 0, hi, 0)
    some = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(start)), some)
    b = np.arange(some.sum()) + np.repeat(lo - (np.cumsum(some) - some), some)
    touch = row[b] == row[a] - 1
    a, b = a[touch], b[touch]
    label = np.arange(len(start))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    first = row % height * width + x0
    length = x1 - x0 + 1
    at = np.arange(length.sum()) + np.repeat(row * width + x0 - (np.cumsum(length) - length), length)
    out.ravel()[at] = np.repeat(first[label], length)
    return out


def threshold(maps: DataFrame, t: float) -> DataFrame:
    """Pixels strictly above t."""
    return maps.where(F.col("v") > t).select("vec_id", "h", "w")


def dilate(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Each pixel spreads right, down and diagonally, within the map."""
    step = F.explode(F.array(F.lit(0), F.lit(1)))
    spread = pixels.withColumn("a", step).withColumn("b", step).select("vec_id", (F.col("h") + F.col("a")).alias("h"), (F.col("w") + F.col("b")).alias("w"))
    return spread.where((F.col("h") < height) & (F.col("w") < width)).distinct()


def label_map(cells: list[tuple[int, int]], width: int) -> list[int]:
    """For each of a map's pixels the smallest position of its component."""
    if not cells:
        return []
    mask = np.zeros((1, max(y for y, _ in cells) + 1, width), bool)
    mask[0][tuple(np.array(cells).T)] = True
    return labels(mask)[0][tuple(np.array(cells).T)].tolist()


def boundary(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels at the edge of the map, or with one of four neighbours not set."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    around = pixels.withColumn("d", near).select("vec_id", (F.col("h") + F.col("d.a")).alias("h"), (F.col("w") + F.col("d.b")).alias("w"))
    inner = around.groupBy("vec_id", "h", "w").count().where("count = 4").select("vec_id", "h", "w")
    return pixels.join(inner, ["vec_id", "h", "w"], "left_anti")


def rectangle_scores(maps: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mean of the map within each upright box (vec_id, box_id, x0, y0, x1, y1), ends included: an equi-join on the map, then a range."""
    inside = F.col("w").between(F.col("x0"), F.col("x1")) & F.col("h").between(F.col("y0"), F.col("y1"))
    return maps.join(boxes, "vec_id").where(inside).groupBy("vec_id", "box_id").agg(F.avg("v").alias("score"))


def input_side(side: Column, ratio: Column) -> Column:
    """A detector input side: scaled, to the nearest multiple of 32, 32 at least."""
    return F.greatest(F.lit(32), (F.floor(side * ratio / 32 + 0.5) * 32).cast("int"))

"""Rotated rectangles around the components of detection maps, and the boxes that are left of them.

The geometry of one map runs in NumPy, as hulls and smallest rectangles are folds over few points; maps are spread over tasks
by find_boxes(), which shuffles nothing. Filters, order and restoration are column expressions, too, for tables of boxes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import detection

#: The least sides of a fitted and of an expanded rectangle, and what a restored side must be above.
LEAST_FITTED, LEAST_EXPANDED, ABOVE_RESTORED = 3.0, 5.0, 4.0


class ResourceLimit(ValueError):
    """More of something than the caller allows."""


@dataclass(frozen=True)
class BoxOptions:
    """How maps become boxes. dilate: pixels spread first. candidates: more boxes in a map are an error."""

    bitmap: float = 0.3
    score: float = 0.6
    unclip: float = 1.6
    dilate: bool = False
    candidates: int = 1000


@dataclass(frozen=True)
class Rectangle:
    """Extents along the unit vector u and along v, which is u turned left."""

    u: tuple[float, float]
    low: tuple[float, float]
    high: tuple[float, float]

    @property
    def sides(self) -> tuple[float, float]:
        return self.high[0] - self.low[0], self.high[1] - self.low[1]

    def corners(self, grown: float = 0.0) -> np.ndarray:
        """(4, 2), in order around it."""
        (a, b), (c, d) = np.subtract(self.low, grown), np.add(self.high, grown)
        uv = np.array([(a, b), (c, b), (c, d), (a, d)])
        return uv @ np.array([self.u, (-self.u[1], self.u[0])])


def hull(points) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise from the leftmost point, without collinear points."""
    points = sorted(set(map(tuple, points)))
    if len(points) < 3:
        return points

    def half(ps) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def smallest(points) -> Rectangle | None:
    """The rectangle of least area around a hull with a side along one of its edges, the first of several; None without
    three points."""
    p = np.asarray(points, float)
    if len(p) < 3:
        return None
    edges = np.roll(p, -1, axis=0) - p
    u = edges / np.hypot(*edges.T)[:, None]
    along, across = p @ u.T, p @ np.c_[-u[:, 1], u[:, 0]].T
    low, high = np.array([along.min(0), across.min(0)]), np.array([along.max(0), across.max(0)])
    best = int(np.argmin((high - low).prod(0)))
    return Rectangle(tuple(u[best].tolist()), tuple(low[:, best].tolist()), tuple(high[:, best].tolist()))


def score(probabilities: np.ndarray, r: Rectangle) -> float:
    """Mean of the map's pixels within the rectangle, ends included; 0 without any."""
    height, width = probabilities.shape
    (x0, y0), (x1, y1) = r.corners().min(0), r.corners().max(0)
    ys, xs = np.arange(max(0, int(np.floor(y0))), min(height - 1, int(np.ceil(y1))) + 1), np.arange(max(0, int(np.floor(x0))), min(width - 1, int(np.ceil(x1))) + 1)
    x, y = np.meshgrid(xs, ys)
    along, across = x * r.u[0] + y * r.u[1], y * r.u[0] - x * r.u[1]
    tiny = 1e-9  # projections of corner pixels must not fall out by rounding
    inside = (along >= r.low[0] - tiny) & (along <= r.high[0] + tiny) & (across >= r.low[1] - tiny) & (across <= r.high[1] + tiny)
    return float(probabilities[y[inside], x[inside]].astype(float).mean()) if inside.any() else 0.0


def growth(sides: tuple[float, float], ratio: float) -> float:
    """How far each side moves out: area times ratio over perimeter."""
    around = 2 * (sides[0] + sides[1])
    return sides[0] * sides[1] * ratio / around if around > 0 and ratio > 0 else 0.0


def clockwise(corners: np.ndarray) -> np.ndarray:
    """Four corners as left top, right top, right bottom, left bottom: two leftmost, two rightmost, each pair by height."""
    p = corners[np.lexsort((corners[:, 1], corners[:, 0]))]
    left, right = (q if q[0, 1] < q[1, 1] else q[::-1] for q in (p[:2], p[2:]))
    return np.array([left[0], right[0], right[1], left[1]])


def fitted(points: np.ndarray) -> Rectangle | None:
    """The smallest rectangle around the boundary (x, y) of a component; None for two points or fewer."""
    return smallest(hull(points.tolist())) if len(points) > 2 else None


def boxes_of(probabilities: np.ndarray, options: BoxOptions = BoxOptions(), ratios: tuple[float, float] = (1.0, 1.0), source: tuple[int, int] | None = None) -> list[tuple[np.ndarray, float]]:
    """(corners, score) of a map, in the order of the components' first pixels. ratios: map size over source size, in x and
    y. source: width and height to clamp to; the map's own, before the ratios, if there is none."""
    height, width = probabilities.shape
    mask = detection.bitmap(probabilities[None], options.bitmap)
    mask = detection.dilated(mask) if options.dilate else mask
    labels = detection.labels(mask)[0]
    y, x = np.nonzero(detection.edge(mask)[0])
    own = labels[y, x]
    order = np.argsort(own, kind="stable")
    out = []
    for points in np.split(np.c_[x, y][order], np.flatnonzero(np.diff(own[order])) + 1) if len(own) else []:
        r = fitted(points)
        if r is None or min(r.sides) < LEAST_FITTED:
            continue
        s = score(probabilities, r)
        grown = growth(r.sides, options.unclip)
        if not np.isfinite(s) or s < options.score or min(r.sides) + 2 * grown < LEAST_EXPANDED:
            continue
        corners = clockwise(r.corners(grown))
        if source:
            corners = np.clip(corners / ratios, 0, np.subtract(source, 1))
        else:
            corners = np.clip(corners, 0, (width - 1, height - 1)) / ratios
        if min(np.hypot(*(corners[0] - corners[1])), np.hypot(*(corners[0] - corners[3]))) <= ABOVE_RESTORED:
            continue
        if len(out) == options.candidates:
            raise ResourceLimit(f"more than {options.candidates} boxes in a map")
        out.append((corners, s))
    return out


BOX_COLUMNS = ["x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"]


def find_boxes(maps: DataFrame, options: BoxOptions = BoxOptions(), key: str = "vec_id", data: str = "embedding") -> DataFrame:
    """(key, box_id, x0, y0, ... x3, y3, score) of maps with columns height, width and data (row-major); if there, also
    x_ratio and y_ratio, and source_width and source_height. Rows without a map give no boxes."""
    kind, extra = maps.schema[key].dataType.simpleString(), [c for c in ("x_ratio", "y_ratio", "source_width", "source_height") if c in maps.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for r in batch.to_pylist():
                if r[data] is None:
                    continue
                found = boxes_of(np.array(r[data], float).reshape(r["height"], r["width"]), options, (r.get("x_ratio") or 1.0, r.get("y_ratio") or 1.0), (r["source_width"], r["source_height"]) if r.get("source_width") else None)
                keys += [r[key]] * len(found)
                rows += [(i, *corners.ravel().tolist(), s) for i, (corners, s) in enumerate(found)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[1:])], [key, "box_id", *BOX_COLUMNS, "score"])

    shape = f"{key} {kind}, box_id int, " + ", ".join(f"{c} double" for c in [*BOX_COLUMNS, "score"])
    return maps.select(key, "height", "width", data, *extra).mapInArrow(run, shape)


# --- the same on tables of boxes ----------------------------------------------------------------------------


def expansion(width: Column, height: Column, ratio: float) -> Column:
    """How far a box of that size grows on each side: area times ratio over perimeter; 0 for an empty box."""
    return F.coalesce(F.try_divide(width * height * ratio, 2 * (width + height)), F.lit(0.0))


def keeps(width: Column, height: Column, scored: Column, options: BoxOptions = BoxOptions()) -> Column:
    """Whether a fitted rectangle passes: its own short side, its score, its short side when grown."""
    short = F.least(width, height)
    return (short >= LEAST_FITTED) & (scored >= options.score) & (short + 2 * expansion(width, height, options.unclip) >= LEAST_EXPANDED)


def ordered(points: list[tuple[Column, Column]]) -> Column:
    """Four points as an array of structs (x, y): left top, right top, right bottom, left bottom."""
    s = F.array_sort(F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points]))
    up = lambda i: s[i]["y"] < s[i + 1]["y"]
    pick = lambda i, first: F.when(up(i), s[i if first else i + 1]).otherwise(s[i + 1 if first else i])
    return F.array(pick(0, True), pick(2, True), pick(2, False), pick(0, False))


def restored(x: Column, ratio: Column, side: Column) -> Column:
    """A coordinate in the source image, within it."""
    return F.greatest(F.lit(0.0), F.least(x / ratio, side - 1.0))


def within(candidates: DataFrame, key: str, most: int) -> DataFrame:
    """The candidates; more than `most` of one key are an error, not cut."""
    failed = F.raise_error(F.concat(F.lit(f"more than {most} boxes for "), F.col(key).cast("string"))).cast("boolean")
    n = free_name(candidates, "_n")
    counted = candidates.withColumn(n, F.count("*").over(Window.partitionBy(key)))
    return counted.where(F.when(F.col(n) <= most, True).otherwise(failed)).drop(n)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it as long as df has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def rotated_scores(maps: DataFrame, shape: tuple[int, int], rectangles: DataFrame, key: str = "vec_id", data: str = "embedding") -> DataFrame:
    """(key, box_id, score): the mean of the map within each rectangle (key, box_id, ux, uy, low_u, high_u, low_v, high_v).
    Rectangles go to their maps by an equi-join; pixels are never exploded."""
    box = F.struct("box_id", "ux", "uy", "low_u", "high_u", "low_v", "high_v")
    both = maps.select(key, data).join(rectangles.groupBy(key).agg(F.collect_list(box).alias("boxes")), key)
    kind = maps.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                p = np.array(r[data], float).reshape(shape)
                out += [(r[key], b["box_id"], score(p, Rectangle((b["ux"], b["uy"]), (b["low_u"], b["low_v"]), (b["high_u"], b["high_v"])))) for b in r["boxes"]]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(key).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], [key, "box_id", "score"])

    return both.mapInArrow(run, f"{key} {kind}, box_id int, score double")


def component_rectangles(maps: DataFrame, shape: tuple[int, int], threshold: float, key: str = "vec_id", data: str = "embedding") -> DataFrame:
    """(key, label, area): the smallest rectangle of each component that spans one; label is its first pixel."""
    kind = maps.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(data).is_valid())
            mask = detection.bitmap(batch.column(data).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape), threshold)
            n, y, x = np.nonzero(detection.edge(mask))
            own = detection.labels(mask)[n, y, x]
            order = np.lexsort((own, n))
            n, own, points = n[order], own[order], np.c_[x, y][order]
            cut = np.flatnonzero((np.diff(n) != 0) | (np.diff(own) != 0)) + 1
            out = [(int(n[lo]), int(own[lo]), r.sides[0] * r.sides[1]) for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(n)], strict=True) if hi > lo and (r := fitted(points[lo:hi]))]
            at, labels, areas = list(zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(labels, pa.int64()), pa.array(areas, pa.float64())], [key, "label", "area"])

    return maps.select(key, data).mapInArrow(run, f"{key} {kind}, label long, area double")

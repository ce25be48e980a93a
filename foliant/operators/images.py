"""Pixels, boxes and pages: channels, resizing, crops, box growth, file names, reading order.

Images are (height, width, 3) arrays of bytes, blue first, as Spark's image source has them; tables of them have columns
height, width, data (rows one after another, no gaps).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

#: Fixed value: tops closer than this belong to one row of text.
ROW_TOLERANCE = 10
#: Fixed value: the share of the wider of box and column by which they must overlap.
COLUMN_OVERLAP = 0.45
#: Boxes of whole pages that are put in order at once; a larger page is taken whole.
PAGE_ROWS = 1 << 16
#: Per channel mean and deviation of a detector's input, sizes of the other two inputs, and their padding.
DET_MEAN, DET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
CLS_SIZE, CLS_PADDING = (80, 160), -1.0
REC_HEIGHT, REC_PADDING = 48, 128 * 2 / 255 - 1
#: Fixed value: a crop so many times as high as wide is turned.
TALL = 1.5


def channels(argb: Column) -> tuple[Column, Column, Column]:
    """Blue, green and red of packed pixels."""
    return tuple(F.shiftrightunsigned(argb, n).bitwiseAND(F.lit(255)).cast("int") for n in (0, 8, 16))


def unclip(width: Column, height: Column, ratio: float) -> Column:
    """How far a box of that size grows on each side: area times ratio over perimeter; 0 for an empty box."""
    return F.coalesce(F.try_divide(width * height * ratio, 2 * (width + height)), F.lit(0.0))


def side(dx: Column, dy: Column) -> Column:
    """The length of a crop's side, to the nearest whole number, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.hypot(dx.cast("double"), dy.cast("double")) + 0.5).cast("int"))


def with_extension(name: Column, extension: str) -> Column:
    """The name with its extension replaced; a dot at the start begins none."""
    return F.concat(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1"), F.lit(extension))


# --- resizing and crops -------------------------------------------------------------------------------------


def _between(out: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of the output the two source places around its middle, within the image, and the second one's weight."""
    at = (np.arange(out) + 0.5) * size / out - 0.5
    low = np.floor(at).astype(int)
    return np.clip(low, 0, size - 1), np.clip(low + 1, 0, size - 1), at - low


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel middles on pixel middles; (height, width, 3) doubles."""
    x = image.astype(float)
    y0, y1, wy = _between(height, image.shape[0])
    x0, x1, wx = _between(width, image.shape[1])
    wx, wy = wx[None, :, None], wy[:, None, None]
    top = x[y0][:, x0] + (x[y0][:, x1] - x[y0][:, x0]) * wx
    bottom = x[y1][:, x0] + (x[y1][:, x1] - x[y1][:, x0]) * wx
    return top + (bottom - top) * wy


def detector_size(width: int, height: int, limit: int) -> tuple[int, int]:
    """Width and height of a detector's input: the longer side within the limit, both multiples of 32, 32 at least."""
    ratio = min(1.0, limit / max(width, height))
    return tuple(max(32, int(np.floor(n * ratio / 32 + 0.5)) * 32) for n in (width, height))


def detector_input(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """(3, height, width), normalised."""
    x = (resized(image, height, width) / 255 - DET_MEAN) / DET_STD
    return x.transpose(2, 0, 1)


def _fitted(image: np.ndarray, height: int, target: int, padding: float) -> np.ndarray:
    width = min(target, -(-height * image.shape[1] // image.shape[0]))
    out = np.full((3, height, target), padding)
    out[:, :, :width] = (resized(image, height, width) * 2 / 255 - 1).transpose(2, 0, 1)
    return out


def classifier_input(image: np.ndarray) -> np.ndarray:
    """(3, 80, 160): scaled to the height, padded on the right."""
    return _fitted(image, *CLS_SIZE, CLS_PADDING)


def recogniser_input(image: np.ndarray, target: int) -> np.ndarray:
    """(3, 48, target): scaled to the height, padded on the right."""
    return _fitted(image, REC_HEIGHT, target, REC_PADDING)


def crop_size(quad) -> tuple[int, int]:
    """Width and height of a crop: its upper and its left side, to the nearest whole number. Sides below one are an error."""
    p = np.asarray(quad, float).reshape(4, 2)
    sides = np.hypot(*(p[1] - p[0])), np.hypot(*(p[3] - p[0]))
    if not np.isfinite(p).all() or not np.isfinite(sides).all() or min(sides) < 1:
        raise ValueError("a box with a side below one, or that is not finite")
    return tuple(max(1, int(np.floor(s + 0.5))) for s in sides)


def projection(quad) -> np.ndarray:
    """The 3 x 3 matrix that takes the unit square to the corners, in order around it."""
    p = np.asarray(quad, float).reshape(4, 2)
    bend = p[0] - p[1] + p[2] - p[3]
    g = h = 0.0
    if (np.abs(bend) > 1e-12).any():
        sides = np.array([p[1] - p[2], p[3] - p[2]])
        det = sides[0, 0] * sides[1, 1] - sides[1, 0] * sides[0, 1]
        if not np.isfinite(det) or abs(det) <= 1e-12:
            raise ValueError("a degenerate box")
        g = (bend[0] * sides[1, 1] - sides[1, 0] * bend[1]) / det
        h = (sides[0, 0] * bend[1] - bend[0] * sides[0, 1]) / det
    rows = np.array([p[1] - p[0] + g * p[1], p[3] - p[0] + h * p[3], p[0]]).T
    return np.vstack([rows, [g, h, 1.0]])


def crop(image: np.ndarray, quad) -> np.ndarray:
    """The image within four corners, upright; turned if it is tall. Bilinear, to the nearest byte, halves up."""
    width, height = crop_size(quad)
    v, u = np.meshgrid(np.arange(height) / height, np.arange(width) / width, indexing="ij")
    x, y, scale = np.tensordot(projection(quad), np.stack([u, v, np.ones_like(u)]), 1)
    if not (np.isfinite(scale) & (np.abs(scale) > 1e-12)).all():
        raise ValueError("a box that has no projection")
    x, y = x / scale, y / scale
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    wx, wy = (x - x0)[..., None], (y - y0)[..., None]
    at = lambda yy, xx: image[np.clip(yy, 0, image.shape[0] - 1), np.clip(xx, 0, image.shape[1] - 1)].astype(float)
    top = at(y0, x0) + (at(y0, x0 + 1) - at(y0, x0)) * wx
    bottom = at(y0 + 1, x0) + (at(y0 + 1, x0 + 1) - at(y0 + 1, x0)) * wx
    out = np.floor(np.clip(top + (bottom - top) * wy, 0, 255) + 0.5).astype(np.uint8)
    out = np.minimum(out, 255)
    return np.rot90(out, -1) if height >= width * TALL else out


def pixels(r: dict) -> np.ndarray:
    """The image of a row."""
    return np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)


def tensors(images: DataFrame, f: Callable, key: str = "image") -> DataFrame:
    """(key, shape, data): f of each image, a tensor. Images without data give none. Nothing is shuffled."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["data"] is not None:
                    x = f(pixels(r))
                    yield pa.RecordBatch.from_arrays([pa.array([r[key]], batch.schema.field(key).type), pa.array([list(x.shape)], pa.list_(pa.int32())), pa.array([x.astype(np.float32).ravel()], pa.list_(pa.float32()))], [key, "shape", "data"])

    return images.select(key, "height", "width", "data").mapInArrow(run, f"{key} {kind}, shape array<int>, data array<float>")


def crops(images: DataFrame, boxes: DataFrame, key: str = "image") -> DataFrame:
    """(key, box_id, height, width, data) of boxes (key, box_id, quad: eight numbers). An image is read once: its boxes come
    to it as one list, and its crops are cut in one batch."""
    lists = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("box_id", "quad"))).alias("boxes"))
    both, kind = images.select(key, "height", "width", "data").join(lists, key), images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cut = [crop(pixels(r), b["quad"]) for b in r["boxes"]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[key]] * len(cut), batch.schema.field(key).type), pa.array([b["box_id"] for b in r["boxes"]], pa.int32()),
                    pa.array([c.shape[0] for c in cut], pa.int32()), pa.array([c.shape[1] for c in cut], pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary()),
                ], [key, "box_id", "height", "width", "data"])

    return both.mapInArrow(run, f"{key} {kind}, box_id int, height int, width int, data binary")


# --- reading order ------------------------------------------------------------------------------------------


def in_rows(tops: list[float], lefts: list[float]) -> list[int]:
    """Stable insertion by row, then left edge. Rows are judged pairwise, which is no order that sorting could use:
    a box goes behind the last one, from the end, that does not come after it."""
    return _rows(np.zeros(min(len(tops), 1), int), np.array(tops, float), np.array(lefts, float)).tolist()


def _rows(starts: np.ndarray, tops: np.ndarray, lefts: np.ndarray) -> np.ndarray:
    """in_rows() of many pages, which begin at starts: their boxes, page by page. A step inserts a box in every page."""
    sizes, out = np.diff(starts, append=len(tops)), np.arange(len(tops))
    for group in _alike(sizes):
        first, size, place = starts[group], sizes[group], np.arange(sizes[group[0]])[:, None]
        # the boxes of a page in order so far
        inside = place < size
        box = np.where(inside, first + place, 0)
        top, left = tops[box], lefts[box]
        for step in range(1, len(place)):
            m = np.count_nonzero(size > step)
            new, own = first[:m] + step, np.arange(m)
            y, x = tops[new], lefts[new]
            at, low, reach = np.zeros(m, int), step, 16
            while low and not at.all():  # from the end, further each time
                low, reach = max(step - reach, 0), reach * 4
                tops_there, lefts_there = top[low:step, :m], left[low:step, :m]
                behind = np.where(np.abs(y - tops_there) < ROW_TOLERANCE, x >= lefts_there, y >= tops_there)
                at = np.where(behind, place[low + 1:step + 1], 0).max(axis=0)
            low = at.min()
            moves = place[low + 1:step + 1] > at
            for values, value in ((box, new), (top, y), (left, x)):
                values[low + 1:step + 1, :m] = np.where(moves, values[low:step, :m], values[low + 1:step + 1, :m])
                values[at, own] = value
        out[(first + place)[inside]] = box[inside]
    return out


def lines_in_order(boxes: DataFrame) -> DataFrame:
    """(page, idx, k): the place k of each box (page, idx, x0, y0, x1, y1) in its page, left to right. Boxes of one idx
    are taken by their sides."""
    return _by_page(boxes, ["y0", "x0"], _rows)


def in_columns(boxes: list[tuple[float, float, float, float]], right_to_left: bool = False) -> list[int]:
    """The order of boxes (x0, y0, x1, y1) by column, then from the top. Boxes are taken by their middles from the left;
    each joins the column that it overlaps most, by COLUMN_OVERLAP or more of the wider of the two, the first of
    several, or begins one. A column spans all its boxes, and is as wide as its widest."""
    return _columns(np.zeros(min(len(boxes), 1), int), *np.array(boxes, float).reshape(-1, 4).T, right_to_left=right_to_left).tolist()


def _columns(starts: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, right_to_left: bool) -> np.ndarray:
    """in_columns() of many pages, which begin at starts: their boxes, page by page. A step takes a box of every page."""
    sizes = np.diff(starts, append=len(x0))
    page = np.repeat(np.arange(len(starts)), sizes)
    column = np.zeros(len(x0), int)
    with np.errstate(invalid="ignore"):
        by_middle, width = np.lexsort(((x0 + x1) * 0.5, page)), x1 - x0
        for group in _alike(sizes):
            # left, right and width of the columns that a page may have
            left, right, widest = (np.full((sizes[group[0]], len(group)), v) for v in (np.inf, -np.inf, 0.0))
            count = np.zeros(len(group), int)
            for step in range(sizes[group[0]]):
                m = np.count_nonzero(sizes[group] > step)
                at, own = by_middle[starts[group[:m]] + step], np.arange(m)
                lo, hi, w = x0[at], x1[at], width[at]
                n = max(count[:m].max(), 1)
                a, b, c = left[:n, :m], right[:n, :m], widest[:n, :m]
                over, most = np.where(b < hi, b, hi) - np.where(a > lo, a, lo), np.where(c > w, c, w)
                shares = np.divide(over, most, out=np.zeros_like(over), where=(over > 0) & (most > 0) & (most < np.inf))
                best = shares.argmax(axis=0)
                begins = shares[best, own] < COLUMN_OVERLAP
                best = np.where(begins, count[:m], best)
                count[:m] += begins
                a, b, c = left[best, own], right[best, own], widest[best, own]
                left[best, own] = np.where(begins | (lo < a), lo, a)
                right[best, own] = np.where(begins | (hi > b), hi, b)
                widest[best, own] = np.where(begins | (w > c), w, c)
                column[at] = best
        return np.lexsort(((y0 + y1) * 0.5, y0, -column if right_to_left else column, page))


def columns_in_order(boxes: DataFrame, right_to_left: bool = False) -> DataFrame:
    """(page, idx, k): the place k of each box (page, idx, x0, y0, x1, y1) in its page, column by column. Boxes of one
    idx are taken by their sides."""
    return _by_page(boxes, ["x0", "y0", "x1", "y1"], functools.partial(_columns, right_to_left=right_to_left))


def _alike(sizes: np.ndarray) -> list[np.ndarray]:
    """The pages in groups whose sizes differ by less than a factor of two, the largest of a group first."""
    order = np.argsort(-sizes, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(np.frexp(sizes[order] - 0.5)[1])) + 1) if len(order) else []


def _by_page(boxes: DataFrame, sides: list[str], order: Callable[..., np.ndarray]) -> DataFrame:
    """(page, idx, k) of boxes (page, idx, sides): order(starts, *sides) gives the boxes of whole pages, which lie one after
    another by idx, page by page in their order. Many pages come to it at once; the page that a chunk ends in waits for
    the rest of it."""
    kind = boxes.schema["page"].dataType
    nth = F.row_number().over(Window.partitionBy("page").orderBy(F.asc_nulls_last("idx"), *sides))
    rows = boxes.select("page", F.col("idx").cast("int").alias("idx"), *[F.col(c).cast("double").alias(c) for c in sides]).withColumn("nth", nth)

    def placed(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = [t.column(c).to_numpy() for c in sides]
        k = np.arange(len(t)) - np.repeat(starts, np.diff(starts, append=len(t)))
        out = t.select(["page", "idx"]).take(order(starts, *values)).append_column("k", pa.array(k, pa.int32()))
        yield from out.combine_chunks().to_batches(PAGE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, PAGE_ROWS
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < enough:
                continue
            t = pa.Table.from_batches(held)
            starts = np.flatnonzero(t.column("nth").to_numpy() == 1)
            if starts[-1]:
                yield from placed(t.slice(0, starts[-1]), starts[:-1])
                t = t.slice(starts[-1])
            held, n = t.to_batches(), len(t)
            enough = max(PAGE_ROWS, 2 * n)
        if n:
            t = pa.Table.from_batches(held)
            yield from placed(t, np.flatnonzero(t.column("nth").to_numpy() == 1))

    return rows.mapInArrow(run, StructType([StructField("page", kind), StructField("idx", IntegerType()), StructField("k", IntegerType())]))


def page_texts(lines: DataFrame, page: str = "page", place: str = "k", text: str = "text") -> DataFrame:
    """(page, text): the lines of each page in order, joined by line ends; null lines are empty."""
    own = F.array_sort(F.collect_list(F.struct(F.col(place).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return lines.groupBy(page).agg(F.array_join(F.transform(own, lambda s: s.t), "\n").alias("text"))


def largest_first(lines: DataFrame, width: str = "width", place: str = "idx") -> DataFrame:
    """(width, lines, work, k): groups of lines of one width, those with the most work (width times lines) first, ties as
    they first appear. Groups are as few as there are widths."""
    groups = lines.groupBy(width).agg(F.count("*").alias("lines"), F.min(place).alias("_first")).withColumn("work", F.col(width) * F.col("lines"))
    k = F.row_number().over(Window.orderBy(F.desc("work"), "_first")) - 1
    return groups.withColumn("k", k).drop("_first")

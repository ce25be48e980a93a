"""From pictures to lines of text, as DataFrames: detect, cut, turn, recognise, order.

    engine = Ocr.load(spark, "det.onnx", "rec.onnx", "labels.txt", "cls.onnx")
    lines = engine.recognise(files.pictures(spark, folder))
    pages = engine.pages(lines)

Two passes over Arrow batches: pictures become boxes and crops where they lie; crops are dealt out over tasks by picture
and box, so that a picture of many lines does not hold up a task, and become text, those of one width together. Only
lines, not pixels, are shuffled for the reading order. Models are broadcast as bytes and bound once a shape in each worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import blocks, images, rectangles
from foliant.plans.graph import session
from foliant.sources.files import DICTIONARY_BYTES

#: Widths of a recogniser's input.
WIDTHS = (192, 320, 480, 640, 960)
ORDERS = ("horizontal", "vertical_ltr", "vertical_rtl")


@dataclass(frozen=True)
class Options:
    """limit: the longer side of a detector's input. turned: the score above which a line is turned round. order: one of ORDERS."""

    boxes: rectangles.BoxOptions = field(default_factory=rectangles.BoxOptions)
    limit: int = 960
    turned: float = 0.9
    order: str = "horizontal"
    widest: int = WIDTHS[-1]

    def __post_init__(self):
        if self.order not in ORDERS or self.limit < 32 or self.widest not in WIDTHS:
            raise ValueError("an order, side limit or width that is not known")


def width_bucket(width: int, height: int, widest: int = WIDTHS[-1]) -> int:
    """The least width that a line of that size fits in, scaled to the recogniser's height; the widest for longer ones."""
    need = -(-images.REC_HEIGHT * width // height)
    allowed = [w for w in WIDTHS if w <= widest]
    return next((w for w in allowed if w >= need), allowed[-1])


def labels(path: str) -> list[str]:
    """A label file's classes: the blank, its lines, a space."""
    raw = Path(path).read_bytes()
    if len(raw) > DICTIONARY_BYTES:
        raise ValueError("a label file that is too large")
    lines = raw.decode("utf-8-sig").replace("\r\n", "\n").removesuffix("\n").split("\n")
    if not any(x.strip() for x in lines):
        raise ValueError("a label file without labels")
    return ["", *lines, " "]


def decode(probabilities: np.ndarray) -> tuple[list[int], float]:
    """Classes that a greedy decoder emits of (steps, classes), and the mean of their probabilities; 0 without any."""
    if not np.isfinite(probabilities).all():
        raise ValueError("probabilities that are not finite")
    best = probabilities.argmax(1)
    emit = np.flatnonzero((best != 0) & (best != np.r_[0, best[:-1]]))
    return best[emit].tolist(), float(probabilities[emit, best[emit]].astype(float).mean()) if len(emit) else 0.0


LINE_SCHEMA = "image string, box_id int, box array<double>, det double, cls int, cls_score double, rotated boolean, width int, text string, score double"


@dataclass
class Ocr:
    spark: SparkSession
    detector: bytes
    recogniser: bytes
    classes: list[str]
    classifier: bytes | None = None
    options: Options = field(default_factory=Options)

    @classmethod
    def load(cls, spark: SparkSession, detector: str, recogniser: str, dictionary: str, classifier: str | None = None, options: Options | None = None) -> Ocr:
        """From files on the driver."""
        return cls(spark, Path(detector).read_bytes(), Path(recogniser).read_bytes(), labels(dictionary), Path(classifier).read_bytes() if classifier else None, options or Options())

    def detect(self, pictures: DataFrame) -> DataFrame:
        """(image, box_id, box, det, height, width, data) of the lines of pictures (image, height, width, data): their crops."""
        model, options = self.spark.sparkContext.broadcast(self.detector), self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = session(model.value)
            for batch in batches:
                for r in batch.to_pylist():
                    if r["data"] is None:
                        continue
                    picture = images.pixels(r)
                    width, height = images.detector_size(r["width"], r["height"], options.limit)
                    maps = net.run(images.detector_input(picture, height, width)[None].astype(np.float32))
                    found = rectangles.boxes_of(maps.reshape(maps.shape[-2:]), options.boxes, (width / r["width"], height / r["height"]), (r["width"], r["height"]))
                    for i, (corners, score) in enumerate(found):
                        cut = np.ascontiguousarray(images.crop(picture, corners))
                        yield pa.RecordBatch.from_pydict({
                            "image": [r["image"]], "box_id": pa.array([i], pa.int32()), "box": pa.array([corners.ravel().tolist()], pa.list_(pa.float64())), "det": [score],
                            "height": pa.array([cut.shape[0]], pa.int32()), "width": pa.array([cut.shape[1]], pa.int32()), "data": pa.array([cut.tobytes()], pa.binary()),
                        })

        return pictures.select("image", "height", "width", "data").mapInArrow(run, "image string, box_id int, box array<double>, det double, height int, width int, data binary")

    def read(self, crops: DataFrame) -> DataFrame:
        """LINE_SCHEMA of crops as detect() gives them; cls is null without a classifier."""
        context, options = self.spark.sparkContext, self.options
        recogniser, classes = context.broadcast(self.recogniser), context.broadcast(self.classes)
        classified = self._classified(crops)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = session(recogniser.value)
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    line = images.pixels(r)
                    line = blocks.rotate180(line.transpose(2, 0, 1)).transpose(1, 2, 0) if r["rotated"] else line
                    target = width_bucket(r["width"], r["height"], options.widest)
                    p = net.run(images.recogniser_input(line, target)[None].astype(np.float32))
                    if p.shape[-1] != len(classes.value):
                        raise ValueError(f"{p.shape[-1]} classes for {len(classes.value)} labels")
                    ids, score = decode(p.reshape(-1, p.shape[-1]))
                    out.append((target, "".join(classes.value[i] for i in ids), score))
                width, text, score = list(zip(*out, strict=True)) if out else ([], [], [])
                keep = batch.select(["image", "box_id", "box", "det", "cls", "cls_score", "rotated"])
                yield keep.append_column("width", pa.array(width, pa.int32())).append_column("text", pa.array(text, pa.string())).append_column("score", pa.array(score, pa.float64()))

        return classified.mapInArrow(run, LINE_SCHEMA)

    def _classified(self, crops: DataFrame) -> DataFrame:
        """crops with cls, cls_score and rotated."""
        dealt = crops.repartition("image", "box_id")
        if self.classifier is None:
            return dealt.withColumns({"cls": F.lit(None).cast("int"), "cls_score": F.lit(None).cast("double"), "rotated": F.lit(False)})
        model, turned = self.spark.sparkContext.broadcast(self.classifier), self.options.turned

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = session(model.value)
            for batch in batches:
                p = [net.run(images.classifier_input(images.pixels(r))[None].astype(np.float32)).ravel() for r in batch.to_pylist()]
                if any(len(x) != 2 or not np.isfinite(x).all() for x in p):
                    raise ValueError("a classifier without two finite classes")
                label = [int(x[1] > x[0]) for x in p]
                score = [float(x[k]) for x, k in zip(p, label, strict=True)]
                batch = batch.append_column("cls", pa.array(label, pa.int32())).append_column("cls_score", pa.array(score, pa.float64()))
                yield batch.append_column("rotated", pa.array([k != 0 and s > turned for k, s in zip(label, score, strict=True)], pa.bool_()))

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in crops.schema.fields)
        return dealt.mapInArrow(run, f"{fields}, cls int, cls_score double, rotated boolean")

    def ordered(self, lines: DataFrame) -> DataFrame:
        """lines with k, the place of each in its picture."""
        xs, ys = (F.transform(F.sequence(F.lit(c), F.lit(6 + c), F.lit(2)), lambda i: F.col("box")[i]) for c in (0, 1))
        # the reading order takes boxes as they were found
        places = lines.select(F.col("image").alias("page"), F.col("box_id").alias("idx"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
        order = images.lines_in_order(places) if self.options.order == "horizontal" else images.columns_in_order(places, self.options.order == "vertical_rtl")
        return lines.join(order.select(F.col("page").alias("image"), F.col("idx").alias("box_id"), "k"), ["image", "box_id"])

    def recognise(self, pictures: DataFrame) -> DataFrame:
        """LINE_SCHEMA and k of all lines of the pictures."""
        return self.ordered(self.read(self.detect(pictures)))

    def pages(self, lines: DataFrame) -> DataFrame:
        """(image, text): lines in order, joined by line ends. Pictures without lines are not there."""
        return images.page_texts(lines, "image")


def resorted(lines: DataFrame, order: list[str], page: str = "image") -> DataFrame:
    """lines with k anew: their places by other columns."""
    return lines.drop("k").withColumn("k", F.row_number().over(Window.partitionBy(page).orderBy(*order)) - 1)


def prediction_records(lines: DataFrame) -> DataFrame:
    """(file, lines) as prediction files have them: a class that is not there is -1."""
    line = F.struct("text", F.col("score").alias("rec"), "det", F.coalesce("cls", F.lit(-1)).alias("cls"), F.coalesce("cls_score", F.lit(0.0)).alias("cls_score"), F.col("rotated").alias("rotate"), "box")
    own = F.array_sort(F.collect_list(F.struct("k", line.alias("line"))))
    return lines.groupBy(F.col("image").alias("file")).agg(F.transform(own, lambda s: s["line"]).alias("lines"))


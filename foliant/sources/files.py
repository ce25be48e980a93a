"""Readers and writers of the formats around the engine: prediction lines, label dictionaries, noisy logs, raw floats, manifests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.functions import text as texts

#: Bytes that a label dictionary may have.
DICTIONARY_BYTES = 1 << 20


def predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Prediction lines (JSON, one record a file); blank lines are skipped. A line that is no such record, or a
    second record of one file, is an error; so is a record whose lines are no list. The schema is DDL and has a column file."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    listed = F.get_json_object("value", "$.lines")
    bad = listed.isNotNull() & ~F.startswith(F.ltrim(listed), F.lit("["))
    lines = lines.withColumn("value", F.when(~bad, F.col("value")).otherwise(F.raise_error(F.lit("lines are no list"))))
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    n = F.count("*").over(Window.partitionBy("file"))
    failed = F.raise_error(F.concat(F.lit("no file, or one listed twice: "), F.coalesce(F.col("file").cast("string"), F.lit("null"))))
    checked = parsed.withColumn("file", F.when(F.col("file").isNotNull() & (n == 1), F.col("file")).otherwise(failed))
    return checked


def write_predictions(rows: DataFrame, path: str, digits: int | None = None) -> None:
    """One JSON record a line; as many files as rows has partitions. digits: significant digits of floats, also in arrays
    and structs; all that they have if not given."""
    shown = rows if digits is None else rows.select(*[significant(F.col(f.name), f.dataType, digits).alias(f.name) for f in rows.schema.fields])
    shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def significant(c: Column, kind: T.DataType, digits: int) -> Column:
    """Floats with that many significant digits, in whatever they are nested."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.format_string(f"%.{digits - 1}e", c.cast("double")).cast("double")).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: significant(x, kind.elementType, digits))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[significant(c[f.name], f.dataType, digits).alias(f.name) for f in kind.fields]))
    return c


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(class, label) of a UTF-8 label file: class 0 is the blank, the last one a space. A byte order mark goes, as
    do carriage returns before line ends; blank labels count. A file that is too large, or all blank, is an error."""
    files = spark.read.format("binaryFile").load(path).select("length", F.col("content").cast("string").alias("t"))
    text = F.regexp_replace(F.regexp_replace("t", "^﻿", ""), r"\r?\n\z", "")
    good = (F.col("length") <= DICTIONARY_BYTES) & (F.trim(F.regexp_replace(text, r"\s", "")) != "")
    lines = F.split(F.when(good, text).otherwise(F.raise_error(F.lit("label file is too large, or blank"))), "\r?\n")
    return files.select(F.posexplode(F.concat(F.array(F.lit("")), lines, F.array(F.lit(" ")))).alias("class", "label"))


def last_json(logs: DataFrame, schema: str) -> DataFrame:
    """Of logs (path, n, value), one row a line, the last line of each path that is a JSON object of the schema."""
    parsed = logs.where(F.ltrim("value").startswith("{")).select("path", "n", F.from_json("value", schema).alias("r"))
    found = parsed.where(F.coalesce(*[F.col(f"r.{c}").cast("string") for c in parsed.schema["r"].dataType.names]).isNotNull())
    return found.groupBy("path").agg(F.max_by("r", "n").alias("r")).select("path", "r.*")


def is_listed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, what) of each file (path, content) or line of the manifest (path, sha256) that does not agree:
    missing, extra, changed."""
    have = files.select("path", F.sha2("content", 256).alias("have"))
    both = have.join(manifest.select("path", F.lower("sha256").alias("want")), "path", "full")
    what = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") != F.col("want"), "changed")
    return both.select("path", what.alias("what")).where("what IS NOT NULL")


def model_format(content: Column) -> Column:
    """By the first four bytes; the name of a file says nothing."""
    return F.when(F.substring(content, 1, 4) == F.lit(b"LWM0"), "lwm").otherwise("onnx")


# --- images -------------------------------------------------------------------------------------------------

#: Names of files that are pictures.
PICTURES = r"(?i)\.(jpe?g|png)$"


def picture_files(spark: SparkSession, folder: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """(path, name, content) of the pictures in a folder, by name; those from `start` on, `limit` of them if given."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(PICTURES)).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content").orderBy("name")
    files = files.offset(start) if start else files
    return files if limit is None else files.limit(limit)


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(image, height, width, data: blue, green, red bytes) of the pictures in a folder. Files that cannot be read are left out;
    grey ones, and ones with transparency, become three channels."""
    raw = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*").where(F.col("origin").rlike(PICTURES))
    # three bytes a pixel as they are; one is repeated, of four the last is dropped
    step = F.expr("sequence(0, height * width - 1)")
    one = F.unhex(F.array_join(F.transform(step, lambda i: F.repeat(F.hex(F.substring("data", i + 1, F.lit(1))), F.lit(3))), ""))
    four = F.unhex(F.array_join(F.transform(step, lambda i: F.hex(F.substring("data", i * 4 + 1, F.lit(3)))), ""))
    data = F.when(F.col("nChannels") == 3, F.col("data")).when(F.col("nChannels") == 1, one).otherwise(four)
    return raw.select(F.element_at(F.split("origin", "/"), -1).alias("image"), "height", "width", data.alias("data"))


# --- ground truth, stage inputs, raw floats, reports --------------------------------------------------------


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(file, gt, bbox, text) of a metadata file with images[].file and images[].lines[]."""
    shape = "images array<struct<file:string,lines:array<struct<bbox:array<double>,text:string>>>>"
    images = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("images").alias("i"))
    return images.select("i.file", F.posexplode("i.lines").alias("gt", "l")).select("file", "gt", "l.bbox", "l.text")


def stage_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(stem, width, text, score, cls, cls_score, rotated) of tab-separated lines of seven fields; the text is in base 64."""
    shape = "stem string, width int, text64 string, score double, cls int, cls_score double, rotated boolean"
    rows = spark.read.schema(shape).option("sep", "\t").option("mode", "FAILFAST").option("quote", "").csv(path)
    return rows.select("stem", "width", F.unbase64("text64").cast("string").alias("text"), "score", "cls", "cls_score", "rotated")


def raw_floats(spark: SparkSession, path: str) -> DataFrame:
    """(path, values) of files of little-endian 32-bit floats."""
    return spark.read.format("binaryFile").load(path).select("path", texts.floats(F.col("content")).alias("values"))


def write_raw_floats(rows: DataFrame, folder: str) -> None:
    """Writes rows (name, values) as files of little-endian 32-bit floats below folder, each by the task that has it. The folder is
    one that all executors share; a file that is written again, by a task that is tried again, is the same."""
    import pathlib

    def write(batches):
        for batch in batches:
            for name, values in zip(batch["name"], batch["values"], strict=True):
                target = pathlib.Path(folder) / name
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(target.name + ".part")
                part.write_bytes(np.asarray(values, "<f4").tobytes())
                part.replace(target)
            yield batch[["name"]]

    rows.select("name", "values").mapInPandas(write, "name string").count()


def markdown(rows: DataFrame, title: str, digits: int = 3) -> DataFrame:
    """One row, value: a heading and a table of the rows, in their order by the first column. For reports: few rows."""
    shown = [F.coalesce(F.format_number(c, digits) if isinstance(f.dataType, T.DoubleType | T.FloatType) else c.cast("string"), F.lit("n/a")) for f in rows.schema.fields for c in [F.col(f.name)]]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(s, F.lit("|"), F.lit("\\|")) for s in shown]), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rows.columns[0]).alias("k"), line.alias("l")))), lambda s: s["l"])
    return rows.agg(F.concat_ws("\n", F.lit("\n".join(head)), body).alias("value"))


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """The rows as JSON lines in path/json, and as a table in path/markdown."""
    rows.write.json(f"{path}/json")
    markdown(rows, title).coalesce(1).write.text(f"{path}/markdown")

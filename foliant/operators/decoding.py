"""CTC decoding and class decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.bounds import small


def collapse(steps: DataFrame, line: str = "line", t: str = "t") -> DataFrame:
    """The steps that a greedy decoder emits: class neither blank (0) nor that of the step before (0 at first)."""
    before = F.lag("class", 1, 0).over(Window.partitionBy(line).orderBy(t))
    return steps.withColumn("before", before).where((F.col("class") != 0) & (F.col("class") != F.col("before"))).drop("before")


def texts(steps: DataFrame, dictionary: DataFrame, line: str = "line") -> DataFrame:
    """(line, text, score, emitted) of all lines, also those that emit nothing. The dictionary is (class, label)."""
    out = collapse(steps, line).join(small(dictionary), "class", "left").groupBy(line).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "label"))), lambda s: s.label), "").alias("text"),
        F.avg("prob").alias("score"), F.count("*").alias("emitted"),
    )
    lines = steps.select(line).distinct()
    return lines.join(out, line, "left").select(line, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("emitted", F.lit(0)).alias("emitted"))

"""Session and plan helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if {"text", "html"} & set(out.columns):
        small_batches(spark)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one will do in
    local mode only, as tests run; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes of a Parquet row group that saved() writes: what a task buffers on writing, and what one reads at least.
ROW_GROUP_BYTES = 16 << 20


#: Input bytes that a file of a result stands for, and one of a small intermediate table; the least of either.
FILE_BYTES, RESULT_FILES = 64 << 20, 12
SMALL_FILE_BYTES, SMALL_FILES = 64 << 20, 3


def file_count(size: int) -> int:
    """Files of a small intermediate table of a job on that many bytes: few, as on local file systems Hadoop starts a process
    or more for each file and folder that a task makes, but more with more data."""
    return max(SMALL_FILES, size // SMALL_FILE_BYTES)


def result_count(size: int) -> int:
    """Files of a table that is as large as what it was made of."""
    return max(RESULT_FILES, size // FILE_BYTES)


def in_few_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """A result that is as large as docs."""
    return out.coalesce(result_count(input_bytes(docs)))


#: Where the shared folder is a mounted file system: no checksum file beside each file. Holds for these writes only.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def saved(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it again: cuts the lineage, survives lost executors. files: as
    many tasks at most in the last stage, and so files; for tables that are cheap to finish."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{what}-{uuid.uuid4().hex}"
    writer = (df if files is None else df.coalesce(files)).write.option("parquet.block.size", ROW_GROUP_BYTES)
    for key, value in PLAIN_FILES.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing reads it any more."""
    path = getattr(df, "_foliant_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the sizes of the tables that df reads; measured where it has none. Sizes partitions and
    buckets only, never results. The plan's own estimate would multiply the sizes of joined tables."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 50:
        size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()[0] or 0
    return size


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own: the given ones, with underscores after those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: What may be broadcast: rows, and elements of lists in them.
BROADCAST_ROWS = 500_000
BROADCAST_ELEMENTS = 2_000_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS, lists: str | None = None) -> bool:
    """Whether df may be broadcast; counted, not estimated. lists: a column of arrays, whose elements count too."""
    if df.limit(rows + 1).count() > rows:
        return False
    return lists is None or (df.agg(F.sum(F.size(lists))).head()[0] or 0) <= BROADCAST_ELEMENTS


def dealt(df: DataFrame, n: int, *cols) -> DataFrame:
    """df dealt out over n partitions by cols."""
    return df.repartition(n, *cols)


#: Rows of texts that Spark hands to Python at once; its default of 10,000 is too many for long texts.
BATCH_ROWS = 400
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets Parquet's reader and Python get BATCH_ROWS rows at once at most, and Python about BATCH_BYTES: settings of the
    session, as Spark reads them when a query runs, not when it is built. They have no bearing on results."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, BATCH_ROWS)


def as_bytes(name: str = "text"):
    """The column as UTF-8 bytes: what Python gets without decoding."""
    return F.col(name).cast("binary").alias(name)


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with further columns."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])

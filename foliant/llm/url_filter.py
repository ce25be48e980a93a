"""URL filters: a sort-merge range join of urls with nested prefix rules.

A key is the reversed host and the path: org.example/es/1. All keys that start with a rule's key form an
interval. As a rule also holds for subdomains, each url has one key for each suffix of its host. Keys and
rules are dealt into ranges; a rule goes to every range that its interval meets. A sorted sweep of each
range keeps the stack of the rules that hold at the current key, so each row is seen once and memory is
the depth of nesting. Range bounds are cut from sorted samples of (key, page): they only balance the ranges,
and as they include the page, a very frequent key is split over several.

The longest rule wins (characters of host and path, then of host); with none the verdict is `default`.

Cases: a null url, or one without ://, has an empty host and path and meets no rule. Repeated rows come
out as often as they came in; they are counted, swept once for COPIES of them, and written out in as many tasks. Ties of
rules go to the longer host, then to the later rule text. A null page_id is kept. Very long urls are keys like others; range
bounds look at CUT_CHARS of them. Extra columns are ignored, whatever their names. No rules: all get the default.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import dealt, input_bytes, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
SAMPLE = 20_000
CUT_CHARS = 256
COPIES = 65_536
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url) -> dict:
    """Host and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return {"host": F.coalesce(F.translate(host, *_ASCII), F.lit("")), "path": F.coalesce(path, F.lit(""))}


def _reversed(host: str) -> str:
    return ".".join(reversed(host.split(".")))


def _deal(cuts: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist(), strict=True)
            yield batch.append_column("range", pa.array([bisect.bisect_right(cuts, k) for k in keys], pa.int32()))

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range and key, rules before urls of the same key. The stack lives on from batch to batch."""
    stack: list[tuple[str, str]] = []
    at = None
    for batch in batches:
        best = []
        rules = batch.column("rule").to_pylist()
        for where, key, rule in zip(batch.column("range").to_pylist(), batch.column("key").to_pylist(), rules, strict=True):
            if where != at:
                stack, at = [], where
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule))
            best.append(stack[-1][1] if stack else None)
        out = batch.append_column("best", pa.array(best, pa.string()))
        yield out.filter(pa.array([r is None for r in rules])).select(["page_id", "url", "k", "n", "best"])


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    spark = pages.sparkSession
    size = input_bytes(pages)
    ranges = ranges or max(8, min(2000, size // (2 << 20)), size // (128 << 20))
    copies = pages.groupBy("page_id", "url").agg(F.count("*").alias("n"))
    counted = copies.select("page_id", "url", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int"))).alias("k"))
    counted = counted.withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("k") * COPIES).cast("long"))
    each = counted.withColumns(parts(F.col("url"))).withColumn("labels", F.reverse(F.split("host", r"\.")))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.concat(F.array_join(F.slice("labels", F.lit(1), k), "."), F.col("path")))
    probes = each.select("page_id", "url", "k", "n", F.explode(suffixes).alias("key"), F.xxhash64("page_id", "k").alias("tie"), F.lit(None).cast("string").alias("rule"))
    seen = probes.select(F.substring("key", 1, CUT_CHARS).alias("key"), "tie", F.xxhash64("key", "tie").alias("h")).orderBy("h").limit(max(SAMPLE, 4 * ranges)).collect()  # by hash: any even sample will do
    keys = sorted((r.key, r.tie) for r in seen)
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    def spans(key: str) -> range:
        """The ranges that meet all that starts with key."""
        low, high = bisect.bisect_right(cuts, (key, -(2**63))), bisect.bisect_right(cuts, (key + chr(0x10FFFF), 2**63))
        return range(low, high + 1)

    order = {f"{h}{p}": (len(h) + len(p), len(h), v) for v, h, p in rules}
    rows = [(None, None, 0, 0, _reversed(h) + p, -(2**63), f"{h}{p}", r) for _, h, p in rules for r in spans(_reversed(h) + p)]
    ruled = spark.createDataFrame(rows, "page_id long, url string, k int, n long, key string, tie long, rule string, range int")
    ranged = probes.mapInArrow(_deal(cuts), ruled.schema)
    swept = dealt(ranged.unionByName(ruled), ranges, "range").sortWithinPartitions("range", "key", F.col("rule").isNull(), "rule")
    met = swept.mapInArrow(_sweep, "page_id long, url string, k int, n long, best string")
    weight = spark.createDataFrame([(r, *o) for r, o in order.items()], "best string, length int, host_length int, verdict string") if rules else spark.createDataFrame([], "best string, length int, host_length int, verdict string")
    won = met.join(F.broadcast(weight), "best", "left").groupBy("page_id", "url", "k", "n").agg(F.max(F.struct("length", "host_length", "best", "verdict")).alias("w"))
    out = won.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumns(parts(F.col("url")))
    return out.select("page_id", "host", "path", F.col("w.best").alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
  (SELECT arg_max(h || r.p, length(h || r.p)) FROM rules r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, r.p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || r.p)) FROM rules r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, r.p)), 'allow') AS verdict
FROM p
"""

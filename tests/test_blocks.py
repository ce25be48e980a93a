"""Block kernels against loops, against the coordinate form, and on hand-computed values; ranks and checksums against brute force."""

import io
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.functions import elementwise as E
from foliant.functions import text
from foliant.operators import blocks as B
from foliant.operators import evaluation, tensor
from foliant.sources import models
from tests.test_models import CASES, onnx

rng = np.random.default_rng(5)


def by_hand(x, w, strides, pads, dilations, group):
    n, c, h, width = x.shape
    out, per, kh, kw = w.shape
    size = [B.window_count(s, k, st, a, b, d) for s, k, st, a, b, d in zip((h, width), (kh, kw), strides, pads[:2], pads[2:], dilations, strict=True)]
    y = np.zeros((n, out, *size))
    for o, i, j, p, q, k in itertools.product(range(out), range(size[0]), range(size[1]), range(kh), range(kw), range(per)):
        yy, xx = i * strides[0] - pads[0] + p * dilations[0], j * strides[1] - pads[1] + q * dilations[1]
        if 0 <= yy < h and 0 <= xx < width:
            y[:, o, i, j] += x[:, o // (out // group) * per + k, yy, xx] * w[o, k, p, q]
    return y


@pytest.mark.parametrize(("c", "out", "group", "kernel", "strides", "pads", "dilations"), [
    (4, 6, 2, (3, 3), (1, 1), (1, 1, 1, 1), (1, 1)), (4, 4, 4, (3, 3), (2, 2), (1, 0, 2, 1), (1, 1)), (3, 2, 1, (2, 2), (1, 1), (0, 0, 1, 1), (1, 1)),
    (2, 2, 1, (3, 5), (2, 1), (2, 3, 0, 1), (2, 2)), (1, 1, 1, (7, 1), (1, 1), (3, 0, 3, 0), (1, 1)), (2, 3, 1, (7, 7), (1, 1), (3, 3, 3, 3), (1, 1)), (3, 3, 1, (1, 1), (3, 2), (0, 0, 0, 0), (1, 1)),
])
def test_convolutions(c, out, group, kernel, strides, pads, dilations):
    x, w, bias = rng.normal(size=(2, c, 9, 8)), rng.normal(size=(out, c // group, *kernel)), rng.normal(size=out)
    want = by_hand(x, w, strides, pads, dilations, group)
    assert np.allclose(B.conv(x, w, None, strides, pads, dilations, group), want)
    assert np.allclose(B.conv(x, w, bias, strides, pads, dilations, group), want + bias[:, None, None])
    if group == 1:
        act = B.epilogue(residual=want, activation="relu")
        assert np.allclose(B.prepared(w, bias, strides, pads, dilations, rows=7)(x), want + bias[:, None, None])
        assert np.allclose(B.prepared(w, None, strides, pads, dilations, act)(x), np.maximum(2 * want, 0))
    # the transposed form is the adjoint
    z = rng.normal(size=want.shape)
    back = B.conv_transpose(z, w, None, strides, pads, dilations, group)
    if back.shape == x.shape:  # no cell fell behind the last window
        assert np.isclose((want * z).sum(), (back * x).sum())


def test_taps_outside_are_skipped():
    w = np.ones((1, 1, 3, 3))
    w[0, 0, 0, 0] = np.inf
    assert B.conv(np.ones((1, 1, 1, 1)), w, pads=(1, 1, 1, 1)).item() == 1.0
    with pytest.raises(ValueError):
        B.prepared(w)


def test_hand_computed_values():
    # fixed values
    assert np.allclose(B.softmax(np.array([1000.0, 1001.0, 1002.0])).sum(), 1) and np.isfinite(B.softmax(np.array([1000.0, 1001.0, 1002.0]))).all()
    assert B.reduce_mean(np.array([[1.0, 3], [5, 7]]), (1,), keepdims=False).tolist() == [2, 6]
    assert B.reduce_mean(np.arange(1.0, 13).reshape(2, 2, 3), (-1, -2)).ravel().tolist() == [3.5, 9.5]
    assert B.concat(np.array([[1, 2]]), np.array([[3, 4]]), axis=1).tolist() == [[1, 2, 3, 4]]
    assert B.slice_(np.array([[1, 2, 3], [4, 5, 6]]), [1], [9], axes=[1]).ravel().tolist() == [2, 3, 5, 6]
    assert B.slice_(np.arange(12).reshape(2, 6), [-5], [-1], [-1], [2]).ravel().tolist() == [1, 3, 7, 9]
    assert B.max_pool(np.array([[1.0, 2], [3, 4]])[None, None], (2, 2)).item() == 4
    assert B.resize_nearest(np.array([[1, 2], [3, 4]]), (2, 2)).ravel().tolist() == [1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 4, 4]
    assert B.conv_transpose(np.ones((1, 1, 1, 1)), np.arange(2.0, 6).reshape(1, 1, 2, 2), np.array([1.0]), (2, 2)).ravel().tolist() == [3, 4, 5, 6]
    assert B.unsqueeze(np.zeros((2, 3)), (-1, 0)).shape == (1, 2, 3, 1) and B.squeeze(np.zeros((1, 2, 1))).shape == (2,)
    assert B.matmul(np.zeros((2, 1, 3, 4)), np.zeros((1, 5, 4, 6))).shape == (2, 5, 3, 6)
    assert B.add(np.arange(12.0), np.array([-2.0])).tolist() == [k - 2 for k in range(12)]
    assert B.div(np.array([1.0, -1, 0]), np.zeros(3)).tolist()[:2] == [math.inf, -math.inf] and math.isnan(B.div(np.zeros(1), np.zeros(1))[0])


def test_errors():
    x = np.zeros((2, 3, 4))
    for f in (
        lambda: B.add(x, np.zeros((2, 4))), lambda: B.reduce_mean(x, (0, -3)), lambda: B.softmax(x, 3), lambda: B.matmul(x, x), lambda: B.transpose(x, (0, 0, 1)), lambda: B.reshape(x, (-1, -1)), lambda: B.reshape(x, (5, -1)),
        lambda: B.squeeze(x, (0,)), lambda: B.unsqueeze(x, (0, 0)), lambda: B.concat(x, x[:, :, :2], axis=0), lambda: B.slice_(x, [2], [2]), lambda: B.slice_(x, [0], [2], steps=[-1]), lambda: B.resize_nearest(x, (0.1, 1)),
        lambda: B.conv(x[None], np.zeros((2, 1, 1, 1))), lambda: B.max_pool(x[None], (5, 5)), lambda: B.batch_norm(x, *[np.zeros(4)] * 4), lambda: B.batch_norm(x, *[np.zeros(3)] * 4, epsilon=0),
    ):
        with pytest.raises(ValueError):
            f()
    assert B.reshape(x, (0, -1)).shape == (2, 12)


@pytest.mark.parametrize(("size", "kernel", "stride", "before", "after"), [(8, 2, 3, 0, 0), (5, 2, 2, 1, 1), (7, 3, 2, 0, 0), (6, 3, 3, 1, 2)])
def test_pools(size, kernel, stride, before, after):
    x = rng.normal(size=(1, 2, size, size))
    n = B.window_count(size, kernel, stride, before, after, ceil=True)
    pads = (before, before, after, after)
    top, mean, all_cells = B.max_pool(x, (kernel,) * 2, (stride,) * 2, pads, True), B.average_pool(x, (kernel,) * 2, (stride,) * 2, pads, True), B.average_pool(x, (kernel,) * 2, (stride,) * 2, pads, True, True)
    assert top.shape == (1, 2, n, n) and (n - 1) * stride < size + before
    for i, j in itertools.product(range(n), repeat=2):
        a, b = (slice(max(0, k * stride - before), max(0, k * stride - before + kernel)) for k in (i, j))
        cells = x[:, :, a, b]
        if cells.size:
            assert np.allclose(top[:, :, i, j], cells.max((2, 3))) and np.allclose(mean[:, :, i, j], cells.mean((2, 3))) and np.allclose(all_cells[:, :, i, j], cells.sum((2, 3)) / kernel**2)


def test_both_encodings_agree(spark):
    x = rng.normal(size=(3, 2, 4, 4))
    vectors = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    cells = tensor.coordinates(vectors, (2, 4, 4))
    w = rng.normal(size=(3, 2, 3, 3))
    table = spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(w) for i in [i]], "oc int, ic int, kh int, kw int, wv double")
    for block, coordinates in (
        (B.over(vectors, (2, 4, 4), "chw", lambda t: B.conv(t, w, pads=(1, 1, 1, 1))), tensor.conv(cells, table, (4, 4), pad=1)),
        (B.over(vectors, (2, 4, 4), "chw", lambda t: B.softmax(t, 1)), tensor.softmax(cells, ["vec_id", "h", "w"])),
        (B.over(vectors, (2, 4, 4), "chw", lambda t: B.max_pool(t, (2, 2), (2, 2))), tensor.pool(cells, "max", 4, 2, 2)),
    ):
        key = lambda df: {(r.vec_id, r.c, r.h, r.w): round(r.v, 9) for r in df.collect()}
        assert key(block) == key(coordinates)
        assert "Exchange" not in block._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(1, [1.0] * 32), (2, None)], "vec_id long, embedding array<double>")
    assert B.over(odd, (2, 4, 4), "chw", B.relu).count() == 32
    with pytest.raises(Exception, match="a tensor of 3 values"):
        B.over(spark.createDataFrame([(1, [1.0] * 3)], "vec_id long, embedding array<double>"), (2, 4, 4), "chw", B.relu).collect()


def test_elementwise_nulls_and_reference_values(spark):
    x = [-3.0, -0.5, 0.0, 0.25, 4.0]
    rows = spark.createDataFrame([(v,) for v in [*x, None]], "x double")
    pairs = {"relu": (E.relu, B.relu), "sigmoid": (E.sigmoid, B.sigmoid), "erf": (E.erf, B.erf), "hard_sigmoid": (E.hard_sigmoid, B.hard_sigmoid), "hard_swish": (E.hard_swish, B.hard_swish), "gelu": (E.gelu, B.gelu)}
    got = rows.select("x", *[column(F.col("x")).alias(n) for n, (column, _) in pairs.items()]).toPandas()
    for n, (_, block) in pairs.items():
        assert np.allclose(got[n][:5], block(np.array(x))) and pd.isna(got[n][5])
    assert np.allclose(B.erf(np.array(x)), [math.erf(v) for v in x], atol=2e-7)


def test_exact_ranks(spark):
    r = np.random.default_rng(9)
    groups = {"a": r.integers(0, 50, 30_001).astype(float), "b": r.normal(size=20_000), "c": np.array([5.0]), "d": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)], "g string, x double").repartition(6)
    got = {x.g: x.median for x in evaluation.upper_median(rows, "g", "x").collect()}
    assert got == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}
    ranks = {x.g: (x.p1, x.p95, x.all) for x in evaluation.nearest_rank(rows, "g", "x", {"p1": 0.01, "p95": 0.95, "all": 1.0}).collect()}
    assert ranks == {g: tuple(sorted(v)[max(1, math.ceil(len(v) * f)) - 1] for f in (0.01, 0.95, 1.0)) for g, v in groups.items()}


def test_checksums(spark):
    blobs = [b"", b"a", None, b"abc" * 50, bytes(range(256)) * 40]
    assert text.fnv1a_columns(blobs) == [None if b is None else text.fnv1a(b) for b in blobs]
    assert text.fnv1a(b"abcdef", (2, 4)) == text.fnv1a(b"ab\0\0ef") and text.fnv1a(b"abc", (2, 9)) == text.fnv1a(b"ab\0") and text.fnv1a(b"a", (2, 4)) == text.fnv1a(b"a")
    got = spark.createDataFrame([([1.0, -0.0],), ([float("nan")],), (None,), ([],)], "v array<float>").select(text.bit_checksum(F.col("v")).alias("h")).collect()
    want = text.FNV_OFFSET
    for bits in (0x3F800000, 0x80000000):
        want = (want ^ bits) * text.FNV_PRIME & (2**64 - 1)
    assert [r.h for r in got] == [f"{want:016x}", f"{(text.FNV_OFFSET ^ 0x7FC00000) * text.FNV_PRIME & (2**64 - 1):016x}", None, f"{text.FNV_OFFSET:016x}"]


def test_models_from_files_and_streams(tmp_path):
    raw = onnx(*CASES["pools"])
    (tmp_path / "m").write_bytes(raw)
    stream = io.BytesIO(raw)
    for g in (models.read_file(str(tmp_path / "m")), models.read_stream(stream)):
        assert [n.op for n in g.nodes] == ["MaxPool", "AveragePool"]
    assert not stream.closed
    with pytest.raises(models.ResourceLimit):
        models.read_stream(io.BytesIO(raw), models.Limits(file_bytes=20))
    (tmp_path / "none").write_bytes(b"")
    with pytest.raises(models.InvalidModel):
        models.read_file(str(tmp_path / "none"))


def test_distances_count_characters(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    truth = spark.createDataFrame([("f", 0, *box, "纯臻a"), ("f", 1, 5.0, 5.0, 6.0, 6.0, "x")], "file string, gt int, g_x0 double, g_y0 double, g_x1 double, g_y1 double, expected string")
    found = spark.createDataFrame([("f", 0, *box, "纯b")], "file string, pred int, p_x0 double, p_y0 double, p_x1 double, p_y1 double, actual string")
    files = spark.createDataFrame([("f", 3.0), ("g", 5.0)], "file string, elapsed_ms double")
    rows = {r.file: r for r in evaluation.report(truth, found, files).collect()}
    assert (rows["f"].edit_distance, rows["f"].reference_characters, rows["f"].missing_lines, rows["f"].recall) == (2, 3, 1, 0.5)
    assert (rows["g"].matched_lines, rows["g"].precision, rows[None].elapsed_ms, rows[None].cer) == (0, 0.0, 4.0, 2 / 3)

"""All queries of the library and the DuckDB SQL each is held against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import elementwise as E
from foliant.functions import text as texts
from foliant.operators import blocks, decoding, detection, evaluation, images, rectangles, tensor
from foliant.sources import files
from foliant.streaming import pages as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Coordinates of the vectors as [64], [8, 8], [1, 8, 8] and [4, 4, 4].
_FLAT = "WITH e AS (SELECT vec_id, unnest(range(64))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_MAP = _FLAT + ", x AS (SELECT vec_id, 0 AS c, i // 8 AS h, i % 8 AS w, v FROM e)"
_CUBE = _FLAT + ", x AS (SELECT vec_id, i // 16 AS c, i // 4 % 4 AS h, i % 4 AS w, v FROM e)"


def _pattern(i: str) -> str:
    return f"((({i}) * 17) % 257 - 128) / 127.0::DOUBLE"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return tensor.coordinates(_t(spark, sf, "embeddings"), (64,), "i")


def _map(spark: SparkSession, sf: str) -> DataFrame:
    return tensor.coordinates(_t(spark, sf, "embeddings"), (1, 8, 8), "chw")


def _cube(spark: SparkSession, sf: str) -> DataFrame:
    return tensor.coordinates(_t(spark, sf, "embeddings"), (4, 4, 4), "chw")


_MAP_SHAPE, _CUBE_SHAPE = (1, 8, 8), (4, 4, 4)


def pattern(*shape: int) -> np.ndarray:
    """Weights for queries. The fill that the SQL has, too."""
    return (np.arange(int(np.prod(shape))) * 17 % 257 - 128).reshape(shape) / 127


def _blocks(spark: SparkSession, sf: str, shape: tuple[int, ...], names: str | list[str], f) -> DataFrame:
    """The elements of f of each vector as a tensor of that shape; rounded."""
    return _rounded(blocks.over(_t(spark, sf, "embeddings"), shape, names, f))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("v",)})


# --- decoding -----------------------------------------------------------------------------------------------

_STEPS = """WITH s AS (SELECT vec_id // 8 AS line, vec_id % 8 AS t, list_position(embedding, list_max(embedding)) - 1 AS top,
  1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)))) AS prob FROM embeddings),
steps AS (SELECT line, t, (top % 4)::INT AS class, prob FROM s)"""


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    top, prob = tensor.winner(F.col("embedding").cast("array<double>"))
    return _t(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("line"), (F.col("vec_id") % 8).alias("t"), (top % 4).alias("class"), prob.alias("prob"))


def _dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, " ")], "class int, label string")


@query("ctc_projection", _STEPS + """, p AS (SELECT *, lag(class, 1, 0) OVER (PARTITION BY line ORDER BY t) AS before FROM steps),
k AS (SELECT line, string_agg(CASE class WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE ' ' END, '' ORDER BY t) AS text, avg(prob) AS score, count(*) AS emitted FROM p WHERE class <> 0 AND class <> before GROUP BY line)
SELECT l.line, coalesce(text, '') AS text, round(coalesce(score, 0), 6) AS score, coalesce(emitted, 0) AS emitted FROM (SELECT DISTINCT line FROM steps) l LEFT JOIN k USING (line)""")
def ctc_projection(spark, sf):
    return _rounded(decoding.texts(_steps(spark, sf), _dictionary(spark)), "score")


@query("projection_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS class, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)))), 6) AS prob FROM embeddings")
def projection_argmax(spark, sf):
    top, prob = tensor.winner(F.col("embedding").cast("array<double>"))
    return _rounded(_t(spark, sf, "embeddings").select("vec_id", top.alias("class"), prob.alias("prob")), "prob")


@query("ctc_collapse", _STEPS + " SELECT line, t, class FROM (SELECT *, lag(class, 1, 0) OVER (PARTITION BY line ORDER BY t) AS before FROM steps) WHERE class <> 0 AND class <> before")
def ctc_collapse(spark, sf):
    return decoding.collapse(_steps(spark, sf)).select("line", "t", "class")


@query("dictionary_lookup", _STEPS + " SELECT line, t, CASE class WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE ' ' END AS label FROM steps")
def dictionary_lookup(spark, sf):
    found = _steps(spark, sf).join(F.broadcast(_dictionary(spark)), "class", "left")
    return found.select("line", "t", F.coalesce("label", F.lit("")).alias("label"))


@query("cls_decide", "SELECT vec_id, (b > a)::INT * 180 AS degrees, (b > a AND b > 0.1) AS rotate FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)")
def cls_decide(spark, sf):
    a, b = (F.col("embedding")[k].cast("double") for k in (0, 1))
    return _t(spark, sf, "embeddings").select("vec_id", F.when(b > a, 180).otherwise(0).alias("degrees"), ((b > a) & (b > 0.1)).alias("rotate"))


# --- element-wise -------------------------------------------------------------------------------------------

_ERF = "(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x}))))"


def _erf_sql(x: str) -> str:
    return _ERF.format(x=x, t=f"(1 / (1 + 0.3275911 * abs({x})))")


_ELEMENTWISE = {
    "relu": (lambda x: E.relu(x), "greatest(0, v)"),
    "sigmoid": (lambda x: E.sigmoid(x), "1 / (1 + exp(-v))"),
    "erf": (lambda x: E.erf(x), _erf_sql("v")),
    "hard_sigmoid": (lambda x: E.hard_sigmoid(x), "greatest(0, least(1, 0.2 * v + 0.5))"),
    "sqrt": (lambda x: F.sqrt(F.abs(x)), "sqrt(abs(v))"),
    "pow": (lambda x: F.pow(F.abs(x), F.lit(1.5)), "pow(abs(v), 1.5)"),
    "gelu": (lambda x: E.gelu(x), f"({_erf_sql('v / sqrt(2::DOUBLE)')} + 1) * v * 0.5"),
    "hard_swish": (lambda x: E.hard_swish(x), "greatest(0, least(1, v / 6 + 0.5)) * v"),
    "add": (lambda x: x + (F.col("i") % 7 - 3), "v + (i % 7 - 3)"),
    "sub": (lambda x: x - (F.col("i") % 7 - 3), "v - (i % 7 - 3)"),
    "mul": (lambda x: x * (F.col("i") % 7 - 3), "v * (i % 7 - 3)"),
    "div": (lambda x: E.divide(x, (F.col("i") % 7 + 1).cast("double")), "v / (i % 7 + 1)"),
}


def _elementwise(value):
    return lambda spark, sf: _rounded(_flat(spark, sf).select("vec_id", "i", value(F.col("v")).alias("v")))


for _name, (_value, _sql) in _ELEMENTWISE.items():
    QUERIES[f"ew_{_name}"] = _elementwise(_value)
    ORACLES[f"ew_{_name}"] = f"{_FLAT} SELECT vec_id, i, round({_sql}, 6)::DOUBLE AS v FROM e"


@query("broadcast_channel", _CUBE + f" SELECT vec_id, c, h, w, round(v * ({_pattern('c')}), 6) AS v FROM x")
def broadcast_channel(spark, sf):
    factor = spark.createDataFrame([(c, float(f)) for c, f in enumerate(pattern(4))], "c int, f double")
    return _rounded(_cube(spark, sf).join(F.broadcast(factor), "c").select("vec_id", "c", "h", "w", (F.col("v") * F.col("f")).alias("v")))


_BN = "(v - 0.01 * c) * ((1 + 0.5 * c) / sqrt(0.5 + 0.1 * c + 1e-5)) + 0.25 * c"


@query("batch_norm", _CUBE + f" SELECT vec_id, c, h, w, round({_BN}, 6)::DOUBLE AS v FROM x")
def batch_norm(spark, sf):
    p = spark.createDataFrame([(c, 0.01 * c, 0.5 + 0.1 * c, 1 + 0.5 * c, 0.25 * c) for c in range(4)], "c int, m double, s double, g double, b double")
    x = _cube(spark, sf).join(F.broadcast(p), "c")
    return _rounded(x.select("vec_id", "c", "h", "w", E.batch_norm(F.col("v"), F.col("m"), F.col("s"), F.col("g"), F.col("b")).alias("v")))


# --- reductions and products --------------------------------------------------------------------------------


@query("reduce_mean_axes", _CUBE + " SELECT vec_id, h, round(avg(v), 6) AS v FROM x GROUP BY ALL")
def reduce_mean_axes(spark, sf):
    return _blocks(spark, sf, _CUBE_SHAPE, "h", lambda x: blocks.reduce_mean(x, (1, -1), keepdims=False))


@query("global_avg_pool", _CUBE + " SELECT vec_id, c, round(avg(v), 6) AS v FROM x GROUP BY ALL")
def global_avg_pool(spark, sf):
    return _blocks(spark, sf, _CUBE_SHAPE, "c", lambda x: blocks.reduce_mean(x, (2, 3), keepdims=False))


@query("softmax", _CUBE + ", m AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id, h, w)) AS q FROM x) SELECT vec_id, c, h, w, round(q / sum(q) OVER (PARTITION BY vec_id, h, w), 6) AS v FROM m")
def softmax(spark, sf):
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.softmax(x, 1))


@query("matmul", _MAP + f" SELECT vec_id, h AS i, j, round(sum(v * ({_pattern('w * 8 + j')})), 6) AS v FROM x, (SELECT unnest(range(8))::INT AS j) GROUP BY ALL")
def matmul(spark, sf):
    b = pattern(8, 8)
    return _blocks(spark, sf, (8, 8), "ij", lambda x: blocks.matmul(x, b))


@query("batched_matmul", _MAP + " SELECT a.vec_id, a.h AS i, b.w AS j, round(sum(a.v * b.v), 6) AS v FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.w = b.h GROUP BY ALL")
def batched_matmul(spark, sf):
    return _blocks(spark, sf, (8, 8), "ij", lambda x: blocks.matmul(x, x))


# --- layout -------------------------------------------------------------------------------------------------


@query("transpose", _CUBE + " SELECT vec_id, w AS c, h, c AS w, round(v, 6) AS v FROM x")
def transpose(spark, sf):
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.transpose(x, (0, 3, 2, 1)))


@query("reshape", _FLAT + " SELECT vec_id, i // 32 AS a, i % 32 AS b, round(v, 6) AS v FROM e")
def reshape(spark, sf):
    return _blocks(spark, sf, (64,), "ab", lambda x: blocks.reshape(x, (0, 2, -1)))


@query("squeeze_unsqueeze", _MAP + " SELECT vec_id, h, 0 AS n, w, round(v, 6) AS v FROM x")
def squeeze_unsqueeze(spark, sf):
    return _blocks(spark, sf, (1, 8, 8), ["h", "n", "w"], lambda x: blocks.unsqueeze(blocks.squeeze(x, (1,)), (2,)))


@query("concat", _CUBE + " SELECT vec_id, c, h, w, round(v, 6) AS v FROM x UNION ALL SELECT vec_id, c + 4, h, w, round(-v, 6) FROM x")
def concat(spark, sf):
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.concat(x, -x, axis=1))


@query("slice", _MAP + " SELECT vec_id, h, (w - 3) // 2 AS w, round(v, 6) AS v FROM x WHERE w >= 3 AND w < 7 AND (w - 3) % 2 = 0")
def slice_(spark, sf):
    return _blocks(spark, sf, (8, 8), "hw", lambda x: blocks.slice_(x, [-5], [-1], axes=[-1], steps=[2]))


@query("resize_nearest", _CUBE + " SELECT vec_id, c, oh AS h, ow AS w, round(v, 6) AS v FROM x, (SELECT unnest(range(8))::INT AS oh) a, (SELECT unnest(range(8))::INT AS ow) b WHERE h = oh // 2 AND w = ow // 2")
def resize_nearest(spark, sf):
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.resize_nearest(x, (2, 2)))


@query("rotate180", _MAP + " SELECT vec_id, 7 - h AS h, 7 - w AS w, round(v, 6) AS v FROM x")
def rotate180(spark, sf):
    return _blocks(spark, sf, (8, 8), "hw", blocks.rotate180)


# --- windows ------------------------------------------------------------------------------------------------


def _conv_sql(view: str, oc: int, ic: int, kh: int, kw: int, out: tuple[int, int], stride=1, pad=(0, 0), dilation=1, depthwise=False) -> str:
    """The gather form: each output cell collects its taps."""
    weight = _pattern(f"((o * {ic} + {'0' if depthwise else 'c'}) * {kh} + a) * {kw} + b")
    grid = ", ".join(f"(SELECT unnest(range({n}))::INT AS {v})" for v, n in (("o", oc), ("y", out[0]), ("z", out[1]), ("a", kh), ("b", kw)))
    where = f"h = y * {stride} - {pad[0]} + a * {dilation} AND w = z * {stride} - {pad[1]} + b * {dilation}" + (" AND c = o" if depthwise else "")
    return f"{view} SELECT vec_id, o AS c, y AS h, z AS w, round(sum(v * ({weight})), 6) AS v FROM x, {grid} WHERE {where} GROUP BY ALL"


_CONVS = {
    "conv3x3": (_MAP_SHAPE, _MAP, (2, 1, 3, 3), (8, 8), {"pad": 1}),
    "conv_stride2": (_MAP_SHAPE, _MAP, (2, 1, 3, 3), (4, 4), {"stride": 2, "pad": 1}),
    "conv_dilated": (_MAP_SHAPE, _MAP, (1, 1, 3, 3), (8, 8), {"pad": 2, "dilation": 2}),
    "conv_depthwise": (_CUBE_SHAPE, _CUBE, (4, 1, 3, 3), (4, 4), {"pad": 1, "depthwise": True}),
    "conv_pointwise": (_CUBE_SHAPE, _CUBE, (3, 4, 1, 1), (4, 4), {}),
    "conv_wide": (_MAP_SHAPE, _MAP, (1, 1, 1, 7), (8, 8), {"pad": 0, "pad_w": 3}),
}


def _conv(shape, w, kw):
    def run(spark, sf):
        weights, pad = pattern(*w), kw.get("pad", 0)
        pads, group = (pad, kw.get("pad_w", pad)) * 2, shape[0] if kw.get("depthwise") else 1
        strides, dilations = (kw.get("stride", 1),) * 2, (kw.get("dilation", 1),) * 2
        return _blocks(spark, sf, shape, "chw", lambda x: blocks.conv(x, weights, None, strides, pads, dilations, group))

    return run


for _name, (_view, _sql, _w, _out, _kw) in _CONVS.items():
    QUERIES[_name] = _conv(_view, _w, _kw)
    ORACLES[_name] = _conv_sql(_sql, *_w, _out, _kw.get("stride", 1), (_kw.get("pad", 0), _kw.get("pad_w", _kw.get("pad", 0))), _kw.get("dilation", 1), _kw.get("depthwise", False))


@query("conv_epilogue", _conv_sql(_MAP, 2, 1, 3, 3, (8, 8), 1, (1, 1)).replace("round(sum", "greatest(0, round(sum").replace(", 6) AS v FROM x", " + 0.125 * any_value(o), 6))::DOUBLE AS v FROM x"))
def conv_epilogue(spark, sf):
    weights, bias = pattern(2, 1, 3, 3), np.array([0.0, 0.125])

    def rounded_bias(y):  # the SQL rounds before the activation
        return blocks.epilogue(activation="relu")(np.round(blocks.epilogue(bias=bias)(y), 6))

    return _blocks(spark, sf, _MAP_SHAPE, "chw", lambda x: blocks.conv(x, weights, pads=(1, 1, 1, 1), epilogue=rounded_bias))


@query("conv_transpose", _CUBE + f" SELECT vec_id, o AS c, h * 2 + a AS h, w * 2 + b AS w, round(sum(v * ({_pattern('((o * 4 + c) * 2 + a) * 2 + b')})), 6) AS v FROM x, (SELECT unnest(range(2))::INT AS o), (SELECT unnest(range(2))::INT AS a), (SELECT unnest(range(2))::INT AS b) GROUP BY ALL")
def conv_transpose(spark, sf):
    # the SQL numbers the weights by output channel first
    weights = pattern(2, 4, 2, 2).transpose(1, 0, 2, 3)
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.conv_transpose(x, weights, strides=(2, 2)))


_POOL = _CUBE + " SELECT vec_id, c, y AS h, z AS w, round({f}, 6) AS v FROM x, (SELECT unnest(range({n}))::INT AS y), (SELECT unnest(range({n}))::INT AS z) WHERE h BETWEEN y * {s} - {p} AND y * {s} - {p} + {k} - 1 AND w BETWEEN z * {s} - {p} AND z * {s} - {p} + {k} - 1 GROUP BY ALL"


@query("max_pool", _POOL.format(f="max(v)", n=2, s=2, p=0, k=2))
def max_pool(spark, sf):
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.max_pool(x, (2, 2), (2, 2)))


@query("avg_pool", _POOL.format(f="sum(v) / count(*)", n=2, s=2, p=1, k=3))
def avg_pool(spark, sf):
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.average_pool(x, (3, 3), (2, 2), (1, 1, 1, 1)))


@query("avg_pool_count_pad", _POOL.format(f="sum(v) / 9", n=2, s=2, p=1, k=3))
def avg_pool_count_pad(spark, sf):
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.average_pool(x, (3, 3), (2, 2), (1, 1, 1, 1), count_include_pad=True))


# --- detection ----------------------------------------------------------------------------------------------

_PIXELS = _MAP + ", px AS (SELECT vec_id, h, w FROM x WHERE v > 0.05)"


def _pixels(spark, sf, f=lambda mask: mask):
    """The pixels (vec_id, h, w) of what f makes of the maps above the threshold."""
    return blocks.over(_t(spark, sf, "embeddings"), (8, 8), "hw", lambda x: f(detection.bitmap(x, 0.05)), only=lambda y: y).drop("v")


QUERIES["det_threshold"], ORACLES["det_threshold"] = _pixels, _PIXELS + " SELECT * FROM px"


@query("det_dilate", _PIXELS + " SELECT DISTINCT vec_id, h + a AS h, w + b AS w FROM px, (SELECT unnest(range(2))::INT AS a), (SELECT unnest(range(2))::INT AS b) WHERE h + a < 8 AND w + b < 8")
def det_dilate(spark, sf):
    return _pixels(spark, sf, detection.dilated)


@query("det_components", _PIXELS.replace("WITH e", "WITH RECURSIVE e") + ", r(vec_id, h, w, src) AS (SELECT vec_id, h, w, h * 8 + w FROM px UNION SELECT p.vec_id, p.h, p.w, r.src FROM r JOIN px p ON p.vec_id = r.vec_id AND abs(p.h - r.h) <= 1 AND abs(p.w - r.w) <= 1) SELECT vec_id, h, w, min(src)::BIGINT AS label FROM r GROUP BY ALL")
def det_components(spark, sf):
    labels = blocks.over(_t(spark, sf, "embeddings"), (8, 8), "hw", lambda x: detection.labels(detection.bitmap(x, 0.05)), value="label", only=lambda y: y >= 0)
    return labels.withColumn("label", F.col("label").cast("long"))


@query("det_boundary", _PIXELS + " SELECT p.vec_id, p.h, p.w FROM px p LEFT JOIN px q ON p.vec_id = q.vec_id AND abs(p.h - q.h) + abs(p.w - q.w) = 1 GROUP BY ALL HAVING count(q.h) < 4")
def det_boundary(spark, sf):
    return _pixels(spark, sf, detection.edge)


@query("det_rect_score", _MAP + " SELECT vec_id, b AS box_id, round(avg(v), 6) AS score FROM x, (SELECT unnest(range(3))::INT AS b) WHERE w BETWEEN b AND b + 3 AND h BETWEEN vec_id % 4 AND vec_id % 4 + 2 GROUP BY ALL")
def det_rect_score(spark, sf):
    lo = (F.col("vec_id") % 4).cast("int")
    boxes = _t(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*map(F.lit, range(3)))).alias("box_id")).select("vec_id", "box_id", F.col("box_id").alias("x0"), (F.col("box_id") + 3).alias("x1"), lo.alias("y0"), (lo + 2).alias("y1"))
    return _rounded(detection.rectangle_scores(_map(spark, sf), boxes), "score")


@query("det_shape_policy", "WITH s AS (SELECT p_partkey, 37 * p_size AS w, 23 * p_size + 11 AS h FROM part), r AS (SELECT *, least(1, 960 / greatest(w, h)::DOUBLE) AS k FROM s) SELECT p_partkey, greatest(32, floor(w * k / 32 + 0.5) * 32)::INT AS dw, greatest(32, floor(h * k / 32 + 0.5) * 32)::INT AS dh FROM r")
def det_shape_policy(spark, sf):
    w, h = 37 * F.col("p_size"), 23 * F.col("p_size") + 11
    ratio = F.least(F.lit(1.0), F.lit(960.0) / F.greatest(w, h))
    return _t(spark, sf, "part").select("p_partkey", detection.input_side(w, ratio).alias("dw"), detection.input_side(h, ratio).alias("dh"))


@query("rec_width_bucket", "WITH s AS (SELECT doc_id, ceil(48 * (n_chars % 1500 + 1) / (20 + doc_id % 40)::DOUBLE)::INT AS need FROM documents) SELECT doc_id, CASE WHEN need <= 192 THEN 192 WHEN need <= 320 THEN 320 WHEN need <= 480 THEN 480 WHEN need <= 640 THEN 640 ELSE 960 END AS bucket FROM s")
def rec_width_bucket(spark, sf):
    need = F.ceil(48 * (F.col("n_chars") % 1500 + 1) / (20 + F.col("doc_id") % 40).cast("double"))
    bucket = F.lit(960)
    for width in (640, 480, 320, 192):
        bucket = F.when(need <= width, width).otherwise(bucket)
    return _t(spark, sf, "documents").select("doc_id", bucket.alias("bucket"))


# --- evaluation ---------------------------------------------------------------------------------------------

_BOXES = """WITH b AS (SELECT l_orderkey AS file, l_linenumber AS n, l_partkey % 40 AS x, l_suppkey % 20 AS y, 10 + l_quantity AS s FROM lineitem),
g AS (SELECT file, n AS gt, x::DOUBLE AS x0, y::DOUBLE AS y0, x + s AS x1, y + 20.0::DOUBLE AS y1 FROM b WHERE n <= 4),
p AS (SELECT file, n AS pred, x::DOUBLE AS x0, y::DOUBLE AS y0, x + s AS x1, y + 20.0::DOUBLE AS y1 FROM b WHERE n > 3),
i AS (SELECT g.file, gt, pred, greatest(0, least(g.x1, p.x1) - greatest(g.x0, p.x0)) * greatest(0, least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS common,
  (g.x1 - g.x0) * (g.y1 - g.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS areas FROM g JOIN p USING (file)),
pairs AS (SELECT file, gt, pred, common / (areas - common) AS iou FROM i WHERE areas - common > 0 AND common / (areas - common) >= 0.2)"""


def _overlaps(spark, sf):
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 20).cast("double")
    b = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("n"), x.alias("x0"), y.alias("y0"), (x + 10 + F.col("l_quantity")).alias("x1"), (y + 20).alias("y1"))

    def side(p: str, key: str, cond: str) -> DataFrame:
        return b.where(cond).select("file", F.col("n").alias(key), *[F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")])

    return evaluation.overlaps(side("g_", "gt", "n <= 4"), side("p_", "pred", "n > 3"), 0.2)


@query("iou_pairs", _BOXES + " SELECT file, gt, pred, round(iou, 6) AS iou FROM pairs")
def iou_pairs(spark, sf):
    return _rounded(_overlaps(spark, sf), "iou")


@query("iou_greedy_match", None)
def iou_greedy_match(spark, sf):
    return _rounded(evaluation.greedy_matches(_overlaps(spark, sf)), "iou")


ORACLES["iou_greedy_match"] = _BOXES.replace("WITH b", "WITH RECURSIVE b") + """,
o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY -iou, gt, pred) AS k FROM pairs),
m(file, k, gs, ps, hit) AS (SELECT DISTINCT file, 0::BIGINT, []::INT[], []::INT[], false FROM o UNION ALL
  SELECT file, k, CASE WHEN f THEN list_append(gs, gt) ELSE gs END, CASE WHEN f THEN list_append(ps, pred) ELSE ps END, f
  FROM (SELECT o.file, o.k, o.gt, o.pred, gs, ps, NOT list_contains(gs, o.gt) AND NOT list_contains(ps, o.pred) AS f FROM m JOIN o ON o.file = m.file AND o.k = m.k + 1))
SELECT o.file, o.gt, o.pred, round(o.iou, 6) AS iou FROM m JOIN o ON o.file = m.file AND o.k = m.k WHERE m.hit"""


@query("cer_report", "WITH t AS (SELECT file, levenshtein(a, b) AS d, length(a) AS n FROM (SELECT c_nationkey AS file, c_name AS a, reverse(c_name) AS b FROM customer)) SELECT file, sum(d)::BIGINT AS distance, sum(n)::BIGINT AS characters, round(sum(d) / sum(n), 6) AS cer FROM t GROUP BY ROLLUP (file)")
def cer_report(spark, sf):
    t = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), F.levenshtein("c_name", F.reverse("c_name")).alias("d"), F.length("c_name").alias("n"))
    out = t.rollup("file").agg(F.sum("d").alias("distance"), F.sum("n").alias("characters"))
    return out.withColumn("cer", F.round(F.try_divide("distance", "characters"), 6))


_DIFF = "WITH a AS (SELECT l_orderkey AS file, l_linenumber AS n, l_returnflag AS t, l_quantity AS q FROM lineitem WHERE l_partkey % 10 <> 0), b AS (SELECT l_orderkey AS file, l_linenumber AS n, l_linestatus AS t, l_quantity + l_tax AS q FROM lineitem WHERE l_partkey % 10 <> 1)"


def _sides(spark, sf):
    t = _t(spark, sf, "lineitem")
    keys = [F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("n")]
    return t.where("l_partkey % 10 <> 0").select(*keys, F.col("l_returnflag").alias("t"), F.col("l_quantity").alias("q")), t.where("l_partkey % 10 <> 1").select(*keys, F.col("l_linestatus").alias("t2"), (F.col("l_quantity") + F.col("l_tax")).alias("q2"))


@query("prediction_diff", _DIFF + " SELECT count(*) AS lines, count(*) FILTER (WHERE a.t <> b.t) AS text_mismatches, count(*) FILTER (WHERE abs(a.q - b.q) > 0.05) AS box_mismatches, round(max(abs(a.q - b.q)), 6) AS max_delta FROM a JOIN b USING (file, n)")
def prediction_diff(spark, sf):
    a, b = _sides(spark, sf)
    delta = F.abs(F.col("q") - F.col("q2"))
    return a.join(b, ["file", "n"]).agg(F.count("*").alias("lines"), F.count_if(F.col("t") != F.col("t2")).alias("text_mismatches"), F.count_if(delta > 0.05).alias("box_mismatches"), F.round(F.max(delta), 6).alias("max_delta"))


@query("missing_extra_files", _DIFF + " SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'missing' ELSE 'extra' END AS what FROM (SELECT DISTINCT file FROM a) a FULL JOIN (SELECT DISTINCT file FROM b) b ON a.file = b.file WHERE a.file IS NULL OR b.file IS NULL")
def missing_extra_files(spark, sf):
    return evaluation.missing_and_extra(*_sides(spark, sf))


def _rounded4(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("total", F.round("total", 4))


# --- profiles and plans -------------------------------------------------------------------------------------


@query("profile_by_operator", "SELECT event_type AS op, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1")
def profile_by_operator(spark, sf):
    return _rounded4(evaluation.profile(_t(spark, sf, "events"), [F.col("event_type").alias("op")], "value"))


@query("profile_hot_nodes", "SELECT op, node, round(total, 4) AS total, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY round(total, 4) DESC, node) AS k FROM (SELECT event_type AS op, user_id AS node, sum(value) AS total FROM events GROUP BY 1, 2)) WHERE k <= 8")
def profile_hot_nodes(spark, sf):
    keys = [F.col("event_type").alias("op"), F.col("user_id").alias("node")]
    return evaluation.hottest(_rounded4(evaluation.profile(_t(spark, sf, "events"), keys, "value")), "op", "node", 8).select("op", "node", "total", "k")


@query("latency_percentiles", "SELECT event_type AS op, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    e = _t(spark, sf, "events").withColumnRenamed("event_type", "op")
    ranks = evaluation.nearest_rank(e, "op", "value", {"p50": 0.5, "p95": 0.95})
    return ranks.join(e.groupBy("op").agg(F.round(F.avg("value"), 6).alias("mean")), "op")


@query("upper_median", "SELECT op, value AS median FROM (SELECT event_type AS op, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k = n // 2 + 1")
def upper_median(spark, sf):
    return evaluation.upper_median(_t(spark, sf, "events").withColumnRenamed("event_type", "op"), "op", "value")


@query("regression_gates", "WITH m AS (SELECT event_type AS metric, avg(value) AS v FROM events GROUP BY 1), g(metric, rule, lim) AS (VALUES ('click', '<', 20.0), ('view', '<=', 5.0), ('error', '>=', 0.95)) SELECT metric, rule, lim::DOUBLE AS lim, round(v, 6) AS v FROM m JOIN g USING (metric) WHERE NOT CASE rule WHEN '<' THEN v < lim WHEN '<=' THEN v <= lim ELSE v >= lim END")
def regression_gates(spark, sf):
    m = _t(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))
    g = spark.createDataFrame([("click", "<", 20.0), ("view", "<=", 5.0), ("error", ">=", 0.95)], "metric string, rule string, lim double")
    return _rounded(evaluation.violations(m, F.broadcast(g)), "v")


@query("run_contract_diff", "SELECT a.o_orderkey AS run, a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS status_differs, a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS priority_differs FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def run_contract_diff(spark, sf):
    """Each run against the next one."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return evaluation.contract_differences(o, o.withColumn("run", F.col("run") - 1), "run", ["status", "priority"])


@query("width_histogram", ORACLES["rec_width_bucket"].replace("SELECT doc_id, CASE", "SELECT bucket, count(*) AS n FROM (SELECT CASE") + ") GROUP BY 1")
def width_histogram(spark, sf):
    return rec_width_bucket(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"))


@query("block_winner", "WITH s AS (SELECT l_suppkey AS shape, l_linenumber % 3 AS block, quantile_disc(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY 1, 2), b AS (SELECT shape, count(*) AS n, arg_min(block, median) AS best, min(median) AS least, max(median) FILTER (WHERE block = 0) AS base FROM s GROUP BY 1) SELECT shape, best, round(least, 2) AS least, least <= 0.97 * base AS wins FROM b WHERE n = 3")
def block_winner(spark, sf):
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)").alias("median")
    s = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("shape"), (F.col("l_linenumber") % 3).alias("block")).agg(median)
    b = s.groupBy("shape").agg(F.count("*").alias("n"), F.min_by("block", "median").alias("best"), F.min("median").alias("least"), F.max(F.when(F.col("block") == 0, F.col("median"))).alias("base"))
    return b.where("n = 3").select("shape", "best", F.round("least", 2).alias("least"), (F.col("least") <= 0.97 * F.col("base")).alias("wins"))


_SPANS = "WITH s AS (SELECT o_custkey AS grp, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS birth, datediff('day', DATE '1990-01-01', o_orderdate::DATE) + 30 + o_orderkey % 200 AS death, floor(o_totalprice)::BIGINT AS size FROM orders)"


def _spans(spark, sf):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), "o_orderkey", day.alias("birth"), (day + 30 + F.col("o_orderkey") % 200).alias("death"), F.floor("o_totalprice").alias("size"))


@query("workspace_live_bound", _SPANS + " SELECT a.grp, max(total)::BIGINT AS bound FROM (SELECT a.grp, a.birth, sum(b.size) AS total FROM (SELECT DISTINCT grp, birth FROM s) a JOIN s b ON a.grp = b.grp AND b.birth <= a.birth AND a.birth <= b.death GROUP BY 1, 2) a GROUP BY 1")
def workspace_live_bound(spark, sf):
    return evaluation.live_bound(_spans(spark, sf))


@query("lifetime_overlap", _SPANS.replace("SELECT o_custkey", "SELECT o_orderkey AS id, o_custkey") + " SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.grp = b.grp AND a.id < b.id AND a.birth <= b.death AND b.birth <= a.death")
def lifetime_overlap(spark, sf):
    """All pairs that overlap, within a group: as many as the answer has, and those that the join looks at."""
    s = _spans(spark, sf)
    a = s.select("grp", F.col("o_orderkey").alias("a"), F.col("birth").alias("ab"), F.col("death").alias("ad"))
    b = s.select("grp", F.col("o_orderkey").alias("b"), F.col("birth").alias("bb"), F.col("death").alias("bd"))
    return a.join(b, "grp").where("a < b AND ab <= bd AND bb <= ad").select("a", "b")


@query("page_text", "SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def page_text(spark, sf):
    return images.page_texts(_t(spark, sf, "conversations"), "conv_id", "turn")


# --- reports over runs --------------------------------------------------------------------------------------


@query("profile_nodes", "SELECT user_id % 3 AS model, user_id AS node, event_type AS op, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def profile_nodes(spark, sf):
    keys = [(F.col("user_id") % 3).alias("model"), F.col("user_id").alias("node"), F.col("event_type").alias("op")]
    return _rounded4(evaluation.profile(_t(spark, sf, "events"), keys, "value"))


@query("profile_merge", "SELECT event_type AS op, count(*) FILTER (WHERE value > 1) AS calls, round(sum(value) FILTER (WHERE value > 1), 4) AS total FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 1) > 0")
def profile_merge(spark, sf):
    """Profiles of three models in one; operators without calls go."""
    op = F.col("event_type").alias("op")
    stages = [_t(spark, sf, "events").where(F.col("user_id") % 3 == k).groupBy(op).agg(F.count_if(F.col("value") > 1).alias("calls"), F.sum(F.when(F.col("value") > 1, F.col("value"))).alias("total")) for k in range(3)]
    return evaluation.merged_profiles(stages).withColumn("total", F.round("total", 4))


@query("rounded_per_call", "SELECT l_suppkey AS op, ((sum(l_partkey) + count(*) // 2) // count(*))::BIGINT AS mean FROM lineitem GROUP BY 1")
def rounded_per_call(spark, sf):
    return _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("op")).agg(evaluation.rounded_mean(F.sum("l_partkey"), F.count("*")).alias("mean"))


@query("throughput_change", "WITH m AS (SELECT l_linenumber AS run, avg(l_quantity) AS mean FROM lineitem GROUP BY 1) SELECT run, round(CASE WHEN mean > 0 THEN 1000 / mean ELSE 0 END, 6)::DOUBLE AS per_second, round((mean / (SELECT mean FROM m WHERE run = 1) - 1) * 100, 6)::DOUBLE AS change FROM m")
def throughput_change(spark, sf):
    m = _t(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("run")).agg(F.avg("l_quantity").alias("mean"))
    base = m.where("run = 1").select(F.col("mean").alias("base"))  # one row
    out = m.join(F.broadcast(base)).select("run", evaluation.per_second(F.col("mean")).alias("per_second"), evaluation.change_percent(F.col("mean"), F.col("base")).alias("change"))
    return _rounded(out, "per_second", "change")


@query("workspace_totals", "SELECT count(*) AS plans, sum(p_size)::BIGINT AS before, sum(p_size // 2 + 1)::BIGINT AS after, round(CASE WHEN sum(p_size // 2 + 1) > 0 THEN sum(p_size // 3) / sum(p_size // 2 + 1) ELSE 1 END, 6)::DOUBLE AS efficiency FROM part")
def workspace_totals(spark, sf):
    size = F.col("p_size").cast("long")
    return _rounded(evaluation.workspace_totals(_t(spark, sf, "part"), size, F.floor(size / 2) + 1, F.floor(size / 3)), "efficiency")


@query("tensor_close", _FLAT + ", d AS (SELECT vec_id, abs(v - round(v, 3)) AS d, 0.0001 + 0.001 * abs(v) AS most FROM e) SELECT vec_id, round(max(d), 6) AS max_delta, round(avg(d), 6) AS mean_delta, count(*) FILTER (WHERE d > most) AS off FROM d GROUP BY 1")
def tensor_close(spark, sf):
    x = _flat(spark, sf)
    return _rounded(evaluation.closeness(x, x.select("vec_id", "i", F.round("v", 3).alias("v")), ["vec_id", "i"], "vec_id", 1e-4, 1e-3), "max_delta", "mean_delta")


@query("file_sets", "SELECT 'both' AS what, count(*) AS n FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 20) UNION ALL SELECT 'either', count(*) FROM (SELECT l_partkey FROM lineitem UNION SELECT p_partkey FROM part WHERE p_size > 20) UNION ALL SELECT 'first', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 20)")
def file_sets(spark, sf):
    a, b = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")), _t(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("k"))
    both = a.distinct().withColumn("a", F.lit(1)).join(b.distinct().withColumn("b", F.lit(1)), "k", "full")  # one pass for all three
    n = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("x"), F.count("*").alias("y"), F.count_if(F.col("b").isNull()).alias("z"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col(c).alias("n")) for w, c in (("both", "x"), ("either", "y"), ("first", "z"))])).alias("r")).select("r.*")


@query("running_peak", "SELECT event_id, user_id, round(max(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS peak FROM events")
def running_peak(spark, sf):
    return _t(spark, sf, "events").select("event_id", "user_id", F.round(evaluation.running_peak("user_id", "event_id", "value"), 6).alias("peak"))


# --- pixels, boxes and texts --------------------------------------------------------------------------------


@query("argb_to_bgr", "SELECT l_orderkey, l_linenumber, (v & 255)::INT AS b, (v >> 8 & 255)::INT AS g, (v >> 16 & 255)::INT AS r FROM (SELECT l_orderkey, l_linenumber, l_partkey::BIGINT * 7919 AS v FROM lineitem)")
def argb_to_bgr(spark, sf):
    b, g, r = images.channels(F.col("l_partkey").cast("long") * 7919)
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", b.alias("b"), g.alias("g"), r.alias("r"))


@query("box_unclip", "SELECT l_orderkey, l_linenumber, round(l_quantity * (l_linenumber + 2) * 1.5::DOUBLE / (2 * (l_quantity + l_linenumber + 2)), 6)::DOUBLE AS distance FROM lineitem")
def box_unclip(spark, sf):
    return _rounded(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rectangles.expansion(F.col("l_quantity"), F.col("l_linenumber") + 2, 1.5).alias("distance")), "distance")


@query("crop_size", "SELECT p_partkey, w, h, h >= 1.5 * w AS rotated FROM (SELECT p_partkey, greatest(1, floor(sqrt(p_size * p_size + 9.0) + 0.5))::INT AS w, greatest(1, floor(sqrt((p_partkey % 50) * (p_partkey % 50) + 4.0) + 0.5))::INT AS h FROM part)")
def crop_size(spark, sf):
    w, h = images.side(F.col("p_size"), F.lit(3)), images.side(F.col("p_partkey") % 50, F.lit(2))
    return _t(spark, sf, "part").select("p_partkey", w.alias("w"), h.alias("h")).withColumn("rotated", F.col("h") >= 1.5 * F.col("w"))


@query("file_names", "SELECT page_id, CASE WHEN strpos(reverse(url), '.') BETWEEN 1 AND length(url) - 1 THEN left(url, length(url) - strpos(reverse(url), '.')) ELSE url END || '.jpg' AS name FROM pages")
def file_names(spark, sf):
    return _t(spark, sf, "pages").select("page_id", images.with_extension(F.col("url"), ".jpg").alias("name"))


@query("reading_order", None)
def reading_order(spark, sf):
    """Boxes of a page in columns; tests hold it against hand-made pages."""
    boxes = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("idx"), (F.col("l_partkey") % 100).cast("double").alias("x0"), (F.col("l_suppkey") % 100).cast("double").alias("y0"))
    return images.lines_in_order(boxes.withColumns({"x1": F.col("x0") + 30, "y1": F.col("y0") + 12}))


@query("text_nfc", "SELECT doc_id, nfc_normalize(replace(text, chr(13) || chr(10), chr(10))) AS text FROM documents")
def text_nfc(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", texts.nfc(F.col("text")).alias("text"))


@query("asset_hashes", "SELECT item_id, sha256(text) AS sha256 FROM benchmark")
def asset_hashes(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


# --- broadcasts, groups, padding on four sides --------------------------------------------------------------


@query("broadcast_nd", _CUBE + f" SELECT vec_id, c, h, w, round(v + ({_pattern('c * 4 + w')}), 6) AS v FROM x")
def broadcast_nd(spark, sf):
    """(4, 4, 4) plus (4, 1, 4): sizes of one are spread, axes are counted from the right."""
    other = pattern(4, 1, 4)
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.add(x, other))


@query("broadcast_outer", _FLAT + ", a AS (SELECT vec_id, i, v FROM e WHERE i < 4), b AS (SELECT vec_id, i - 4 AS j, v FROM e WHERE i BETWEEN 4 AND 7) SELECT a.vec_id, a.i, b.j, round(a.v * b.v, 6) AS v FROM a JOIN b USING (vec_id)")
def broadcast_outer(spark, sf):
    return _blocks(spark, sf, (64,), "ij", lambda x: blocks.mul(x[:, :4, None], x[:, None, 4:8]))


@query("projection_bias_argmax", _FLAT + f""", z AS (SELECT vec_id, t, j, sum(v * ({_pattern('k * 5 + j')})) + ({_pattern('j')}) AS z FROM (SELECT vec_id, i // 8 AS t, i % 8 AS k, v FROM e), (SELECT unnest(range(5))::INT AS j) GROUP BY vec_id, t, j),
m AS (SELECT vec_id, t, arg_max(j, (z, -j)) AS class, max(z) AS top FROM z GROUP BY ALL)
SELECT vec_id, t, class, round(1 / sum(exp(z - top)), 6) AS prob FROM m JOIN z USING (vec_id, t) GROUP BY vec_id, t, class""")
def projection_bias_argmax(spark, sf):
    """Product, bias, first maximum and its softmax probability, without the softmax of the others."""
    w, b = pattern(8, 5), pattern(5)

    def run(x):
        top, _, prob = blocks.projection_argmax(x, w, b)
        return top, prob

    both = blocks.over(_t(spark, sf, "embeddings"), (8, 8), "t", run, value=["class", "prob"])
    return _rounded(both.withColumn("class", F.col("class").cast("int")), "prob")


_GROUPED = _pattern("((o * 2 + c % 2) * 3 + a) * 3 + b")


@query("conv_grouped", _CUBE + f" SELECT vec_id, o AS c, y AS h, z AS w, round(sum(v * ({_GROUPED})), 6) AS v FROM x, (SELECT unnest(range(6))::INT AS o), (SELECT unnest(range(4))::INT AS y), (SELECT unnest(range(4))::INT AS z), (SELECT unnest(range(3))::INT AS a), (SELECT unnest(range(3))::INT AS b) WHERE c // 2 = o // 3 AND h = y - 1 + a AND w = z - 1 + b GROUP BY ALL")
def conv_grouped(spark, sf):
    weights = pattern(6, 2, 3, 3)
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.conv(x, weights, pads=(1, 1, 1, 1), group=2))


@query("conv2x2_padded", _CUBE + f" SELECT vec_id, o AS c, y AS h, z AS w, round(sum(v * ({_pattern('((o * 4 + c) * 2 + a) * 2 + b')})) + 0.5 * o, 6) AS v FROM x, (SELECT unnest(range(2))::INT AS o), (SELECT unnest(range(4))::INT AS y), (SELECT unnest(range(4))::INT AS z), (SELECT unnest(range(2))::INT AS a), (SELECT unnest(range(2))::INT AS b) WHERE h = y + a AND w = z + b GROUP BY vec_id, o, y, z")
def conv2x2_padded(spark, sf):
    """Padding below and on the right only, and a bias."""
    weights, bias = pattern(2, 4, 2, 2), np.array([0.0, 0.5])
    return _blocks(spark, sf, _CUBE_SHAPE, "chw", lambda x: blocks.conv(x, weights, bias, pads=(0, 0, 1, 1)))


@query("conv7x7_wide", _conv_sql(_MAP, 1, 1, 7, 7, (8, 8), 1, (3, 3)))
def conv7x7_wide(spark, sf):
    weights = pattern(1, 1, 7, 7)
    return _blocks(spark, sf, _MAP_SHAPE, "chw", lambda x: blocks.conv(x, weights, pads=(3, 3, 3, 3)))


@query("conv7x1_wide", _conv_sql(_MAP, 1, 1, 7, 1, (8, 8), 1, (3, 0)))
def conv7x1_wide(spark, sf):
    weights = pattern(1, 1, 7, 1)
    return _blocks(spark, sf, _MAP_SHAPE, "chw", lambda x: blocks.conv(x, weights, pads=(3, 0, 3, 0)))


_FUSED = f"(sum(v * ({_pattern('(o * 3 + a) * 3 + b')})) - 0.01 * any_value(o)) * ((1 + 0.5 * any_value(o)) / sqrt(0.5 + 0.1 * any_value(o) + 1e-5)) + 0.25 * any_value(o)"


@query("conv_fused", _MAP + f", y AS (SELECT vec_id, o AS c, y AS h, z AS w, {_FUSED} AS s FROM x, (SELECT unnest(range(2))::INT AS o), (SELECT unnest(range(8))::INT AS y), (SELECT unnest(range(8))::INT AS z), (SELECT unnest(range(3))::INT AS a), (SELECT unnest(range(3))::INT AS b) WHERE h = y - 1 + a AND w = z - 1 + b GROUP BY vec_id, o, y, z), r AS (SELECT y.vec_id, y.c, y.h, y.w, y.s + x.v AS s FROM y JOIN x ON x.vec_id = y.vec_id AND x.h = y.h AND x.w = y.w) SELECT vec_id, c, h, w, round(greatest(0, least(1, s / 6 + 0.5)) * s, 6)::DOUBLE AS v FROM r")
def conv_fused(spark, sf):
    """A convolution with batch normalisation, the input as residual, and an activation, in one pass."""
    weights, c = pattern(2, 1, 3, 3), np.arange(2)
    norm = (1 + 0.5 * c, 0.25 * c, 0.01 * c, 0.5 + 0.1 * c)
    return _blocks(spark, sf, _MAP_SHAPE, "chw", lambda x: blocks.conv(x, weights, pads=(1, 1, 1, 1), epilogue=blocks.epilogue(norm, residual=x, activation="hard_swish")))


@query("max_pool_padded", _MAP + " SELECT vec_id, c, y AS h, z AS w, round(max(v), 6) AS v FROM x, (SELECT unnest(range(4))::INT AS y), (SELECT unnest(range(4))::INT AS z) WHERE h BETWEEN y * 2 - 1 AND y * 2 + 1 AND w BETWEEN z * 2 - 1 AND z * 2 + 1 GROUP BY ALL")
def max_pool_padded(spark, sf):
    return _blocks(spark, sf, _MAP_SHAPE, "chw", lambda x: blocks.max_pool(x, (3, 3), (2, 2), (1, 1, 1, 1)))


@query("max_pool_ceil", _MAP + " SELECT vec_id, c, y AS h, z AS w, round(max(v), 6) AS v FROM x, (SELECT unnest(range(3))::INT AS y), (SELECT unnest(range(3))::INT AS z) WHERE h BETWEEN y * 3 AND y * 3 + 1 AND w BETWEEN z * 3 AND z * 3 + 1 GROUP BY ALL")
def max_pool_ceil(spark, sf):
    """Places of a kernel of 2 at stride 3 in 8 cells: the last one is there only when counts are rounded up."""
    return _blocks(spark, sf, _MAP_SHAPE, "chw", lambda x: blocks.max_pool(x, (2, 2), (3, 3), ceil_mode=True))


@query("resize_nearest_fraction", _MAP + " SELECT vec_id, c, y AS h, z AS w, round(v, 6) AS v FROM x, (SELECT unnest(range(12))::INT AS y), (SELECT unnest(range(6))::INT AS z) WHERE h = floor(y / 1.5) AND w = floor(z / 0.75)")
def resize_nearest_fraction(spark, sf):
    return _blocks(spark, sf, _MAP_SHAPE, "chw", lambda x: blocks.resize_nearest(x, (1.5, 0.75)))


# --- boxes --------------------------------------------------------------------------------------------------

_LABELS = _PIXELS.replace("WITH e", "WITH RECURSIVE e") + ", r(vec_id, h, w, src) AS (SELECT vec_id, h, w, h * 8 + w FROM px UNION SELECT p.vec_id, p.h, p.w, r.src FROM r JOIN px p ON p.vec_id = r.vec_id AND abs(p.h - r.h) <= 1 AND abs(p.w - r.w) <= 1), l AS (SELECT vec_id, h, w, min(src)::BIGINT AS label FROM r GROUP BY ALL)"


@query("det_min_rect", _LABELS + """, e2 AS (SELECT p.vec_id, p.label, q.w - p.w AS dx, q.h - p.h AS dy, min((q.w - p.w) * (s.h - p.h) - (q.h - p.h) * (s.w - p.w)) AS least, max((q.w - p.w) * (s.h - p.h) - (q.h - p.h) * (s.w - p.w)) AS most
  FROM l p JOIN l q USING (vec_id, label) JOIN l s USING (vec_id, label) WHERE p.w <> q.w OR p.h <> q.h GROUP BY p.vec_id, p.label, p.w, p.h, q.w, q.h),
d AS (SELECT DISTINCT vec_id, label, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM e2 WHERE least >= 0 AND most > 0),
b AS (SELECT vec_id, label, ux, uy, (max(w * ux + h * uy) - min(w * ux + h * uy)) * (max(h * ux - w * uy) - min(h * ux - w * uy)) AS area FROM d JOIN l USING (vec_id, label) GROUP BY ALL)
SELECT vec_id, label, round(min(area), 4) AS area FROM b GROUP BY ALL""")
def det_min_rect(spark, sf):
    areas = rectangles.component_rectangles(_t(spark, sf, "embeddings"), (8, 8), 0.05)
    return areas.withColumn("area", F.round("area", 4))


_ROTATED = [(0.6, 0.8), (0.8, -0.6), (1.0, 0.0)]


@query("det_rotated_score", _MAP + ", b AS (SELECT * FROM (VALUES (0, 0.6::DOUBLE, 0.8::DOUBLE), (1, 0.8, -0.6), (2, 1.0, 0.0)) t(box_id, ux, uy)), m AS (SELECT vec_id, box_id, 3.25 * ux + (vec_id % 5 + 1.25) * uy AS u, (vec_id % 5 + 1.25) * ux - 3.25 * uy AS t, ux, uy FROM (SELECT DISTINCT vec_id FROM x), b) SELECT vec_id, box_id, round(avg(v), 6) AS score FROM x JOIN m USING (vec_id) WHERE w * ux + h * uy BETWEEN u - 2.6 AND u + 2.6 AND h * ux - w * uy BETWEEN t - 1.3 AND t + 1.3 GROUP BY ALL")
def det_rotated_score(spark, sf):
    t = _t(spark, sf, "embeddings")
    directions = F.array(*[F.struct(F.lit(k).alias("box_id"), F.lit(ux).alias("ux"), F.lit(uy).alias("uy")) for k, (ux, uy) in enumerate(_ROTATED)])
    y = (F.col("vec_id") % 5).cast("double") + 1.25
    along, across = 3.25 * F.col("ux") + y * F.col("uy"), y * F.col("ux") - 3.25 * F.col("uy")
    rects = t.select("vec_id", F.explode(directions).alias("d")).select("vec_id", "d.*").select(
        "vec_id", "box_id", "ux", "uy", (along - 2.6).alias("low_u"), (along + 2.6).alias("high_u"), (across - 1.3).alias("low_v"), (across + 1.3).alias("high_v"))
    return _rounded(rectangles.rotated_scores(t, (8, 8), rects), "score")


@query("det_filters", """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity / 5 AS w, (l_partkey % 12)::DOUBLE AS h, l_discount * 10 AS s FROM lineitem),
g AS (SELECT *, least(w, h) AS short, CASE WHEN w + h > 0 THEN w * h * 1.6 / (2 * (w + h)) ELSE 0 END AS grown FROM b)
SELECT l_orderkey, l_linenumber, round(grown, 6)::DOUBLE AS grown FROM g WHERE short >= 3 AND s >= 0.6 AND short + 2 * grown >= 5""")
def det_filters(spark, sf):
    w, h = F.col("l_quantity") / 5, (F.col("l_partkey") % 12).cast("double")
    t = _t(spark, sf, "lineitem").where(rectangles.keeps(w, h, F.col("l_discount") * 10))
    return _rounded(t.select("l_orderkey", "l_linenumber", rectangles.expansion(w, h, 1.6).alias("grown")), "grown")


@query("det_clockwise", """WITH p AS (SELECT l_orderkey, l_linenumber, list_sort([{'x': (l_partkey % 50)::DOUBLE, 'y': (l_suppkey % 40)::DOUBLE}, {'x': (l_partkey % 37)::DOUBLE, 'y': l_quantity::DOUBLE}, {'x': l_quantity + 20.0::DOUBLE, 'y': (l_partkey % 23)::DOUBLE}, {'x': (l_suppkey % 71)::DOUBLE, 'y': (l_orderkey % 61)::DOUBLE}]) AS s FROM lineitem),
q AS (SELECT l_orderkey, l_linenumber, CASE WHEN s[1].y < s[2].y THEN [s[1], s[2]] ELSE [s[2], s[1]] END AS l, CASE WHEN s[3].y < s[4].y THEN [s[3], s[4]] ELSE [s[4], s[3]] END AS r FROM p)
SELECT l_orderkey, l_linenumber, l[1].x AS x0, l[1].y AS y0, r[1].x AS x1, r[1].y AS y1, r[2].x AS x2, r[2].y AS y2, l[2].x AS x3, l[2].y AS y3 FROM q""")
def det_clockwise(spark, sf):
    part, supp, n, order = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_orderkey"))
    points = rectangles.ordered([(part % 50, supp % 40), (part % 37, n), (n + 20, part % 23), (supp % 71, order % 61)])
    t = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", points.alias("p"))
    return t.select("l_orderkey", "l_linenumber", *[F.col("p")[k][c].alias(f"{c}{k}") for k in range(4) for c in "xy"])


@query("det_restore", "SELECT l_orderkey, l_linenumber, greatest(0, least((l_quantity - 5) / 0.4, l_partkey % 100))::DOUBLE AS x, greatest(0, least((l_suppkey % 30) / 0.25, l_partkey % 60))::DOUBLE AS y FROM lineitem")
def det_restore(spark, sf):
    t = _t(spark, sf, "lineitem")
    x = rectangles.restored((F.col("l_quantity") - 5).cast("double"), F.lit(0.4), F.col("l_partkey") % 100 + 1.0)
    y = rectangles.restored((F.col("l_suppkey") % 30).cast("double"), F.lit(0.25), F.col("l_partkey") % 60 + 1.0)
    return t.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))


@query("det_boxes", None)
def det_boxes(spark, sf):
    """Boxes of the maps, from threshold to clamped corners; tests hold it against hand-made maps."""
    maps = _t(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(8).alias("height"), F.lit(8).alias("width"))
    return rectangles.find_boxes(maps, rectangles.BoxOptions(bitmap=0.0, score=0.01, unclip=1.5))


# --- inputs and crops ---------------------------------------------------------------------------------------

_IMAGE = "WITH im AS (SELECT vec_id, list_transform(embedding[1:60], lambda v: (floor(abs(v::DOUBLE) * 4000)::BIGINT % 256)::DOUBLE) AS p FROM embeddings)"


def _images(spark, sf):
    """Pictures of 4 by 5 pixels."""
    byte = lambda v: (F.floor(F.abs(v.cast("double")) * 4000) % 256).cast("int")
    values = F.transform(F.slice("embedding", 1, 60), byte)
    data = F.unhex(F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    return _t(spark, sf, "embeddings").select("vec_id", F.lit(4).alias("height"), F.lit(5).alias("width"), data.alias("data"))


def _bilinear(height: int, width: int, last: int) -> str:
    """value(vec_id, c, y, x) of pictures resized to height by width, x up to last."""
    at = lambda y, x: f"p[((greatest(0, least(3, {y}))) * 5 + greatest(0, least(4, {x}))) * 3 + c + 1]"
    lerp = lambda a, b, w: f"({a} + ({b} - {a}) * {w})"
    top, bottom = (lerp(at(y, "x0"), at(y, "x0 + 1"), "wx") for y in ("y0", "y0 + 1"))
    return (
        f"{_IMAGE}, g AS (SELECT vec_id, p, c, y, x, (y + 0.5::DOUBLE) * 4 / {height} - 0.5 AS sy, (x + 0.5::DOUBLE) * 5 / {width} - 0.5 AS sx FROM im, (SELECT unnest(range(3))::INT AS c), (SELECT unnest(range({height}))::INT AS y), (SELECT unnest(range({last}))::INT AS x)), "
        f"k AS (SELECT *, floor(sy)::INT AS y0, floor(sx)::INT AS x0, sy - floor(sy) AS wy, sx - floor(sx) AS wx FROM g), bl AS (SELECT vec_id, c, y, x, {lerp(top, bottom, 'wy')} AS v FROM k)"
    )


def _elements(tensors: DataFrame, height: int, width: int, digits: int = 3) -> DataFrame:
    flat = tensors.select("vec_id", F.posexplode("data").alias("i", "v"))
    i = F.col("i")
    return flat.select("vec_id", F.floor(i / (height * width)).cast("int").alias("c"), (F.floor(i / width) % height).cast("int").alias("y"), (i % width).cast("int").alias("x"), F.round(F.col("v").cast("double"), digits).alias("v"))


@query("det_preprocess", _bilinear(6, 7, 7) + " SELECT vec_id, c, y, x, round(((v / 255 - [0.485, 0.456, 0.406][c + 1]) / [0.229, 0.224, 0.225][c + 1])::FLOAT::DOUBLE, 3) AS v FROM bl")
def det_preprocess(spark, sf):
    return _elements(images.tensors(_images(spark, sf), lambda x: images.detector_input(x, 6, 7), "vec_id"), 6, 7)


@query("cls_preprocess", _bilinear(80, 100, 100) + " SELECT vec_id, c, round(avg(CASE WHEN x < 100 THEN v * 2 / 255 - 1 END), 3) AS picture, 60 * 80::BIGINT AS padded FROM bl GROUP BY ALL")
def cls_preprocess(spark, sf):
    """Of each channel the mean of the scaled picture (80 by 100), and how many cells are padding."""
    x = _elements(images.tensors(_images(spark, sf), images.classifier_input, "vec_id"), 80, 160, digits=12)
    return x.groupBy("vec_id", "c").agg(F.round(F.avg(F.when(F.col("x") < 100, F.col("v"))), 3).alias("picture"), F.count_if((F.col("x") >= 100) & (F.col("v") == -1.0)).alias("padded"))


@query("rec_preprocess", _bilinear(48, 60, 60) + " SELECT vec_id, c, y, x, round((v * 2 / 255 - 1)::FLOAT::DOUBLE, 3) AS v FROM bl WHERE y % 12 = 5 UNION ALL SELECT vec_id, c, y, x, round((128 * 2::DOUBLE / 255 - 1)::FLOAT::DOUBLE, 3) FROM im, (SELECT unnest(range(3))::INT AS c), (SELECT unnest([5, 17, 29, 41]) AS y), (SELECT unnest(range(60, 192))::INT AS x)")
def rec_preprocess(spark, sf):
    """Four rows of each input of 48 by 192, padding and all."""
    x = _elements(images.tensors(_images(spark, sf), lambda x: images.recogniser_input(x, 192), "vec_id"), 48, 192)
    return x.where(F.col("y") % 12 == 5)


_CORNERS = [(0.513, 0.271), (3.737, 0.491), (4.019, 2.773), (0.239, 3.007)]  # no pixel falls on a half


def _crop_sql() -> str:
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = _CORNERS
    m = images.projection(_CORNERS)
    width, height = images.crop_size(_CORNERS)
    e = [repr(float(v)) + "::DOUBLE" for v in m.ravel()]
    at = lambda y, x: f"p[((greatest(0, least(3, {y}))) * 5 + greatest(0, least(4, {x}))) * 3 + c + 1]"
    lerp = lambda a, b, w: f"({a} + ({b} - {a}) * {w})"
    top, bottom = (lerp(at(y, "x0"), at(y, "x0 + 1"), "(sx - x0)") for y in ("y0", "y0 + 1"))
    return (
        f"{_IMAGE}, g AS (SELECT vec_id, p, c, y, x, x::DOUBLE / {width} AS u, y::DOUBLE / {height} AS v FROM im, (SELECT unnest(range(3))::INT AS c), (SELECT unnest(range({height}))::INT AS y), (SELECT unnest(range({width}))::INT AS x)), "
        f"s AS (SELECT *, ({e[0]} * u + {e[1]} * v + {e[2]}) / ({e[6]} * u + {e[7]} * v + 1) AS sx, ({e[3]} * u + {e[4]} * v + {e[5]}) / ({e[6]} * u + {e[7]} * v + 1) AS sy FROM g), "
        f"k AS (SELECT *, floor(sx)::INT AS x0, floor(sy)::INT AS y0 FROM s) SELECT vec_id, c, y, x, floor(greatest(0, least(255, {lerp(top, bottom, '(sy - y0)')})) + 0.5)::INT AS v FROM k"
    )


@query("perspective_crop", _crop_sql())
def perspective_crop(spark, sf):
    """The same four corners in every picture."""
    pictures = _images(spark, sf)
    quad = F.array(*[F.lit(float(v)) for p in _CORNERS for v in p])
    cut = images.crops(pictures, pictures.select("vec_id", F.lit(0).alias("box_id"), quad.alias("quad")), "vec_id")
    values = cut.select("vec_id", "width", "height", F.posexplode(F.expr("transform(sequence(1, length(data)), k -> conv(hex(substring(data, k, 1)), 16, 10))")).alias("i", "v"))
    i, w = F.col("i"), F.col("width")
    return values.select("vec_id", (i % 3).cast("int").alias("c"), F.floor(i / 3 / w).cast("int").alias("y"), (F.floor(i / 3) % w).cast("int").alias("x"), F.col("v").cast("int").alias("v"))


@query("reading_columns", None)
def reading_columns(spark, sf):
    """Boxes of a page column by column, from the right; tests hold it against hand-made pages."""
    boxes = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("idx"), (F.col("l_partkey") % 100).cast("double").alias("x0"), (F.col("l_suppkey") % 100).cast("double").alias("y0"))
    return images.columns_in_order(boxes.withColumns({"x1": F.col("x0") + 30, "y1": F.col("y0") + 12}), right_to_left=True)


@query("largest_groups_first", "SELECT width, n AS lines, width * n AS work, (row_number() OVER (ORDER BY width * n DESC, first) - 1)::INT AS k FROM (SELECT p_size AS width, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1)")
def largest_groups_first(spark, sf):
    return images.largest_first(_t(spark, sf, "part").select(F.col("p_size").alias("width"), F.col("p_partkey").alias("idx")))


# --- evaluation of whole runs -------------------------------------------------------------------------------


def _box_sides(spark, sf):
    """Lines of truth and of predictions, and their files."""
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 20).cast("double")
    t = _t(spark, sf, "lineitem")
    b = t.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("n"), x.alias("x0"), y.alias("y0"), (x + 10 + F.col("l_quantity")).alias("x1"), (y + 20).alias("y1"), "l_partkey")

    def side(p: str, key: str, text: str, word: str, n: int, cond: str) -> DataFrame:
        return b.where(cond).select("file", F.col("n").alias(key), *[F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")], F.concat(F.lit(word), F.col("l_partkey") % n).alias(text))

    files = t.select(F.col("l_orderkey").alias("file")).distinct().withColumn("elapsed_ms", F.col("file") % 50 + 0.5)
    return side("g_", "gt", "expected", "abc", 7, "n <= 4"), side("p_", "pred", "actual", "abd", 5, "n > 3"), files


_MATCHES = ORACLES["iou_greedy_match"].rsplit("SELECT o.file, o.gt", 1)[0].rstrip() + """,
hits AS (SELECT o.file, o.gt, o.pred, o.iou, 'abc' || (a.l_partkey % 7) AS expected, 'abd' || (b.l_partkey % 5) AS actual FROM m JOIN o ON o.file = m.file AND o.k = m.k
  JOIN lineitem a ON a.l_orderkey = o.file AND a.l_linenumber = o.gt JOIN lineitem b ON b.l_orderkey = o.file AND b.l_linenumber = o.pred WHERE m.hit)"""


@query("matched_lines", _MATCHES + " SELECT file, gt, pred, round(iou, 6) AS iou, expected, actual, levenshtein(expected, actual)::INT AS distance, length(expected)::INT AS characters FROM hits")
def matched_lines(spark, sf):
    truth, found, _ = _box_sides(spark, sf)
    return _rounded(evaluation.matched_lines(truth, found, 0.2), "iou")


@query("evaluation_report", _MATCHES + """, f AS (SELECT l_orderkey AS file, l_orderkey % 50 + 0.5::DOUBLE AS ms, count(*) FILTER (WHERE l_linenumber <= 4) AS ng, count(*) FILTER (WHERE l_linenumber > 3) AS np FROM lineitem GROUP BY 1),
h AS (SELECT file, count(*) AS n, sum(iou) AS iou, count(*) FILTER (WHERE expected = actual) AS exact, sum(levenshtein(expected, actual)) AS d, sum(length(expected)) AS c FROM hits GROUP BY 1),
e AS (SELECT f.file, any_value(ms) AS one, avg(ms) AS ms, sum(ng) AS ng, sum(np) AS np, max(np) AS most, coalesce(sum(n), 0) AS n, coalesce(sum(iou), 0) AS iou, coalesce(sum(exact), 0) AS exact, coalesce(sum(d), 0) AS d, coalesce(sum(c), 0) AS c FROM f LEFT JOIN h USING (file) GROUP BY ROLLUP (f.file))
SELECT file, ng::BIGINT AS ground_truth_lines, np::BIGINT AS predicted_lines, n::BIGINT AS matched_lines, (ng - n)::BIGINT AS missing_lines, (np - n)::BIGINT AS extra_lines, exact::BIGINT AS exact_lines,
  round(CASE WHEN n > 0 THEN iou / n ELSE 0 END, 6)::DOUBLE AS mean_matched_iou, round(CASE WHEN np > 0 THEN n / np ELSE 0 END, 6)::DOUBLE AS "precision", round(CASE WHEN ng > 0 THEN n / ng ELSE 0 END, 6)::DOUBLE AS recall,
  d::BIGINT AS edit_distance, c::BIGINT AS reference_characters, round(CASE WHEN c > 0 THEN d / c ELSE 0 END, 6)::DOUBLE AS cer, round(ms, 6) AS elapsed_ms, most::BIGINT AS max_predicted_lines FROM e""")
def evaluation_report(spark, sf):
    out = evaluation.report(*_box_sides(spark, sf), 0.2)
    return _rounded(out, "mean_matched_iou", "precision", "recall", "cer", "elapsed_ms")


@query("required_match", "SELECT l_orderkey AS file, l_linenumber, o_orderstatus AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def required_match(spark, sf):
    found = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderstatus").alias("status"))
    return evaluation.required(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber"), found)


def _prediction(t: DataFrame, text: str, label: str, turned: str, shift: str) -> DataFrame:
    """(file, lines) of rows of lineitem."""
    box = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("l_quantity") + F.expr(shift) + k)
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(F.col(text).alias("text"), F.expr(label).cast("int").alias("cls"), F.expr(turned).alias("rotate"), box.alias("box"), F.expr("192 + l_partkey % 3 * 128").cast("int").alias("width")).alias("line"))
    lists = F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"])
    return t.groupBy(F.col("l_orderkey").alias("file")).agg(lists.alias("lines"), F.avg("l_quantity").alias("mean_ms"))


_A = "a AS (SELECT l_orderkey AS file, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag AS t, l_linenumber % 2 AS c, l_quantity > 25 AS r, l_quantity AS q, l_partkey % 3 AS s FROM lineitem WHERE l_partkey % 10 <> 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"
_B = "b AS (SELECT l_orderkey AS file, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linestatus AS t, l_suppkey % 2 AS c, l_quantity > 24 AS r, l_quantity + l_tax AS q, l_partkey % 3 AS s FROM lineitem WHERE l_partkey % 10 <> 1 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"


def _runs(spark, sf):
    """Predictions of two runs; each lacks some lines of the other."""
    t = _t(spark, sf, "lineitem")
    return _prediction(t.where("l_partkey % 10 <> 0"), "l_returnflag", "l_linenumber % 2", "l_quantity > 25", "0"), _prediction(t.where("l_partkey % 10 <> 1"), "l_linestatus", "l_suppkey % 2", "l_quantity > 24", "l_tax")


@query("prediction_difference", f"WITH {_A}, {_B}, z AS (SELECT a.t <> b.t AS t, a.c <> b.c AS c, a.r <> b.r AS r, abs(a.q - b.q) AS d FROM a JOIN b USING (file, k)), fa AS (SELECT DISTINCT file, n FROM a), fb AS (SELECT DISTINCT file, n FROM b), x AS (SELECT count(*) FILTER (WHERE fb.file IS NULL) AS missing, count(*) FILTER (WHERE fa.file IS NULL) AS extra, count(*) FILTER (WHERE fa.n <> fb.n) AS counts FROM fa FULL JOIN fb ON fa.file = fb.file) SELECT count(*) FILTER (WHERE t) AS text_mismatches, count(*) FILTER (WHERE c) AS cls_mismatches, count(*) FILTER (WHERE r) AS rotate_mismatches, count(*) FILTER (WHERE d > 0.055) AS box_mismatches, any_value(counts) AS line_count_mismatches, round(max(d), 6) AS max_box_delta, any_value(missing) AS missing_files, any_value(extra) AS extra_files, false AS agrees FROM z, x")
def prediction_difference(spark, sf):
    return _rounded(evaluation.difference(*_runs(spark, sf), 0.055), "max_box_delta")


@query("prediction_lines_diff", f"WITH {_A}, {_B} SELECT file, (k - 1)::INT AS line, a.t = b.t AS text_equal, a.c = b.c AS cls_equal, a.r = b.r AS rotate_equal, abs(a.q - b.q) <= 0.055 AS box_equal, round(abs(a.q - b.q), 6) AS box_delta, a.n = b.n AS line_counts_equal FROM a JOIN b USING (file, k)")
def prediction_lines_diff(spark, sf):
    return _rounded(evaluation.line_differences(*_runs(spark, sf), 0.055), "box_delta")


@query("paired_runs", f"WITH {_A}, {_B}, fa AS (SELECT file, avg(q) AS ms, count(*) AS n, list(s ORDER BY k) AS w FROM a GROUP BY 1), fb AS (SELECT l_orderkey AS file, avg(l_quantity) AS ms FROM lineitem WHERE l_partkey % 10 <> 1 GROUP BY 1), gb AS (SELECT file, count(*) AS n, list(s ORDER BY k) AS w FROM b GROUP BY 1), z AS (SELECT file, count(*) FILTER (WHERE a.t = b.t) AS t, bool_and(a.r = b.r) AS r, max(abs(a.q - b.q)) AS d FROM a JOIN b USING (file, k) GROUP BY 1) SELECT file, round(fa.ms / fb.ms, 6) AS ratio, fa.n::INT AS left_lines, gb.n::INT AS right_lines, CASE WHEN fa.n = gb.n THEN t END::INT AS exact_text_lines, fa.n = gb.n AND r AS rotation_parity, fa.w = gb.w AS ordered_width_parity, CASE WHEN fa.n = gb.n THEN round(d, 6) END AS max_box_delta FROM fa JOIN fb USING (file) JOIN gb USING (file) JOIN z USING (file)")
def paired_runs(spark, sf):
    return _rounded(evaluation.paired_runs(*_runs(spark, sf), ["file"]), "ratio", "max_box_delta")


@query("width_counts", f"WITH {_A} SELECT file, (192 + s * 128)::INT AS width, count(*) AS lines FROM a GROUP BY 1, 2")
def width_counts(spark, sf):
    return evaluation.width_counts(_runs(spark, sf)[0], ["file"])


_MEASURED = "s AS (SELECT l_suppkey AS shape, (l_linenumber % 3)::INT AS block, quantile_disc(l_extendedprice, 0.5) AS median, l_suppkey % 11 AS checksum, max(l_quantity) AS bytes FROM lineitem GROUP BY 1, 2)"


@query("block_winners", f"WITH {_MEASURED}, b AS (SELECT shape, count(*) AS n, max(median) FILTER (WHERE block = 0) AS base, arg_min(block, (median, block)) FILTER (WHERE bytes <= 48) AS best, min(median) FILTER (WHERE bytes <= 48) AS least FROM s GROUP BY 1) SELECT shape, coalesce(best, 0)::INT AS best, round(coalesce(least, base), 2) AS least, (base > 0 AND coalesce(least, base) <= 0.97 * base AND coalesce(best, 0) <> 0) AS wins FROM b WHERE n = 3")
def block_winners(spark, sf):
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)").alias("median")
    keys = [F.col("l_suppkey").alias("shape"), (F.col("l_linenumber") % 3).cast("int").alias("block")]
    rows = _t(spark, sf, "lineitem").groupBy(*keys).agg(median, (F.first("l_suppkey") % 11).alias("checksum"), F.max("l_quantity").alias("bytes"))
    return evaluation.block_winners(rows, ["shape"], 0, most_bytes=48).withColumn("least", F.round("least", 2))


@query("memory_status", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -1 ELSE p_size * 1024 END::BIGINT AS resident, p_partkey * 1024 AS peak FROM part")
def memory_status(spark, sf):
    entry = F.when(F.col("p_size") % 3 == 0, F.lit("VmSwap: 7 kB\n")).otherwise(F.concat(F.lit("VmRSS:\t "), F.col("p_size"), F.lit(" kB\n")))
    status = F.concat(F.lit("Name:\tx VmRSS: 1 kB\n"), entry, F.lit("VmHWM:"), F.col("p_partkey"), F.lit(" kB"))
    return _t(spark, sf, "part").select("p_partkey", evaluation.kilobytes(status, "VmRSS").alias("resident"), evaluation.kilobytes(status, "VmHWM").alias("peak"))


@query("memory_mebibytes", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 1000.0::DOUBLE / 1048576 END AS used, CASE WHEN p_size % 7 = 0 THEN NULL ELSE -p_size * 1000.0::DOUBLE / 1048576 END AS change FROM part")
def memory_mebibytes(spark, sf):
    size = F.col("p_size").cast("long")
    used, change = F.when(size % 5 == 0, -1).otherwise(size * 1000), F.when(size % 7 == 0, -1).otherwise(-size * 1000)
    return _t(spark, sf, "part").select("p_partkey", evaluation.mebibytes(used).alias("used"), evaluation.mebibytes(change, signed=True).alias("change"))


@query("graph_parity", _FLAT + ", d AS (SELECT vec_id, i // 8 AS r, i % 8 AS k, v, round(v, 2) AS w FROM e), t AS (SELECT vec_id, r, arg_max(k, (v, -k)) = arg_max(k, (w, -k)) AS same FROM d GROUP BY 1, 2), a AS (SELECT vec_id, bool_and(same) AS same FROM t GROUP BY 1), m AS (SELECT vec_id, max(abs(v - w)) AS most, avg(abs(v - w)) AS mean FROM d GROUP BY 1) SELECT vec_id AS name, round(most, 6) AS max_delta, round(mean, 6) AS mean_delta, same AS argmax_equal, most <= 0.0049 AND mean <= 0.0026 AND same AS passes FROM m JOIN a USING (vec_id)")
def graph_parity(spark, sf):
    values = F.col("embedding").cast("array<double>")
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), values.alias("actual"), F.transform(values, lambda v: F.round(v, 2)).alias("expected"))
    return _rounded(evaluation.graph_parity(rows, 0.0049, 0.0026, classes=8), "max_delta", "mean_delta")


@query("crop_parity", "SELECT p_partkey AS stem, p_name = p_type AS text_equal, abs(p_size / 50.0::DOUBLE - (p_size + p_partkey % 2) / 50.0::DOUBLE) <= 0.001 AS score_equal, p_size % 2 = p_partkey % 2 AND true AS cls_equal, (p_partkey % 2 <> 0 AND p_size / 50.0::DOUBLE > 0.9) = (p_size > 45) AS rotation_equal FROM part")
def crop_parity(spark, sf):
    share = F.col("p_size") / 50
    t = _t(spark, sf, "part").withColumn("stem", F.col("p_partkey"))
    found = t.select("stem", F.col("p_type").alias("text"), ((F.col("p_size") + F.col("p_partkey") % 2) / 50).alias("score"), (F.col("p_partkey") % 2).alias("label"), share.alias("label_score"))
    expected = t.select("stem", F.col("p_name").alias("text"), share.alias("score"), (F.col("p_size") % 2).alias("cls"), share.alias("cls_score"), (F.col("p_size") > 45).alias("rotated"))
    return evaluation.crop_parity(found, expected)


@query("manifest_faults", "WITH m AS (SELECT p_brand AS path, count(*) AS n, bool_and(p_size % 50 <> 1) AS sound FROM part GROUP BY 1), w AS (SELECT unnest(['Brand#11', 'Brand#12', 'Brand#99']) AS path), j AS (SELECT coalesce(m.path, w.path) AS path, n, sound, w.path AS want FROM m FULL JOIN w ON m.path = w.path) SELECT path, 'missing' AS what FROM j WHERE n IS NULL UNION ALL SELECT path, 'unexpected' FROM j WHERE want IS NULL UNION ALL SELECT path, 'twice' FROM j WHERE n > 1 UNION ALL SELECT path, 'no hash' FROM j WHERE NOT sound")
def manifest_faults(spark, sf):
    digest = F.when(F.col("p_size") % 50 == 1, "no hash at all").otherwise(F.sha2(F.col("p_name"), 256))
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("path"), digest.alias("sha256"))
    return evaluation.manifest_faults(rows, ["Brand#11", "Brand#12", "Brand#99"])


@query("model_format", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'lwm' ELSE 'onnx' END AS format FROM documents")
def model_format(spark, sf):
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("LWM0")).otherwise(F.lit("LWM")), F.coalesce("lang", F.lit("")))
    return _t(spark, sf, "documents").select("doc_id", files.model_format(content.cast("binary")).alias("format"))


# --- windows of time (on whole tables; the same functions run on streams) ------------------------------------


@query("event_profile", "SELECT epoch(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type AS op, count(*) AS calls, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY 1, 2")
def event_profile(spark, sf):
    out = streams.profile(streams.event_time(_t(spark, sf, "events")), "6 hours")
    return out.select(F.unix_timestamp("start").alias("start"), "op", "calls", F.round("total", 4).alias("total"), "peak")


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS calls, epoch_us(min(ts))::BIGINT AS start, epoch_us(max(ts))::BIGINT + 7200000000 AS \"end\" FROM s GROUP BY user_id, k")
def event_sessions(spark, sf):
    out = streams.sessions(streams.event_time(_t(spark, sf, "events")), "2 hours")
    return out.select("user_id", "calls", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))

"""Model files and graphs: containers, ONNX, folding and fusing, and what a second runtime gives for the same graphs."""

import struct

import numpy as np
import pytest

from foliant.functions.text import fnv1a
from foliant.operators import blocks
from foliant.plans import graph as G
from foliant.sources import models as M


def number(n):
    n, out = n & (2**64 - 1), b""
    while True:
        n, b = n >> 7, n & 127
        out += bytes([b | (128 if n else 0)])
        if not n:
            return out


def field(key, value):
    if isinstance(value, int):
        return number(key << 3) + number(value)
    if isinstance(value, float):
        return number(key << 3 | 5) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return number(key << 3 | 2) + number(len(raw)) + raw


def tensor(name, value):
    value = np.asarray(value)
    kind = {"f": (1, "<f4"), "i": (7, "<i8")}[value.dtype.kind]
    return b"".join(field(1, d) for d in value.shape) + field(2, kind[0]) + field(8, name) + field(9, value.astype(kind[1]).tobytes())


def attribute(name, value):
    if isinstance(value, float):
        return field(1, name) + field(2, value) + field(20, 1)
    if isinstance(value, int):
        return field(1, name) + field(3, value) + field(20, 2)
    if isinstance(value, str):
        return field(1, name) + field(4, value) + field(20, 3)
    if isinstance(value, np.ndarray):
        return field(1, name) + field(5, tensor("", value)) + field(20, 4)
    return field(1, name) + b"".join(field(8, v) for v in value) + field(20, 7)


def node(op, inputs, output, **attrs):
    return b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, op) + b"".join(field(5, attribute(k, v)) for k, v in attrs.items())


def value(name, shape):
    dims = b"".join(field(1, field(1, d) if d > 0 else field(2, "open")) for d in shape)
    return field(1, name) + field(2, field(1, field(1, 1) + field(2, dims)))


def onnx(nodes, constants, shape=(1, 3, -1, -1), out=(1, -1, -1, -1), opset=13, ir=7):
    g = b"".join(field(1, n) for n in nodes) + b"".join(field(5, tensor(k, v)) for k, v in constants.items()) + field(11, value("x", shape)) + field(12, value("y", out))
    return field(1, ir) + field(7, g) + field(8, field(2, opset))


rng = np.random.default_rng(7)
f32 = lambda *shape: rng.normal(size=shape).astype(np.float32)

CASES = {
    "conv_bn_gelu": (
        [
            node("Conv", ["x", "w", "b"], "c", kernel_shape=[3, 3], pads=[1, 1, 1, 1], strides=[2, 1]), node("BatchNormalization", ["c", "s", "o", "m", "v"], "n", epsilon=1e-3),
            node("Div", ["n", "d"], "g1"), node("Erf", ["g1"], "g2"), node("Add", ["g2", "one"], "g3"), node("Mul", ["n", "g3"], "g4"), node("Mul", ["g4", "half"], "y"),
        ],
        {"w": f32(4, 3, 3, 3), "b": f32(4), "s": f32(4), "o": f32(4), "m": f32(4), "v": np.abs(f32(4)) + 0.5, "d": np.float32([2**0.5]), "one": np.float32([1]), "half": np.float32([0.5])},
    ),
    "depthwise_same_hard": ([node("Conv", ["x", "w"], "c", kernel_shape=[3, 5], group=3, auto_pad="SAME_UPPER"), node("HardSigmoid", ["c"], "h", alpha=0.3, beta=0.4), node("Mul", ["c", "h"], "y")], {"w": f32(3, 1, 3, 5)}),
    "pools": ([node("MaxPool", ["x"], "p", kernel_shape=[2, 2], strides=[2, 2], ceil_mode=1), node("AveragePool", ["p"], "y", kernel_shape=[3, 3], strides=[2, 2], pads=[1, 1, 1, 1], count_include_pad=1)], {}),
    "transposed": ([node("ConvTranspose", ["x", "w", "b"], "t", kernel_shape=[2, 2], strides=[2, 2]), node("Sigmoid", ["t"], "y")], {"w": f32(3, 2, 2, 2), "b": f32(2)}),
    "resize_concat": ([node("Resize", ["x", "", "scale"], "r", mode="nearest", coordinate_transformation_mode="asymmetric", nearest_mode="floor"), node("Relu", ["r"], "p"), node("Concat", ["r", "p"], "y", axis=1)], {"scale": np.float32([1, 1, 2, 3])}),
    "shapes": (  # the sizes of the input decide those of the output
        [
            node("Shape", ["x"], "s"), node("Slice", ["s", "two", "three", "zero"], "h"), node("Constant", [], "lead", value=np.array([0, 3])), node("Constant", [], "rest", value=np.array([-1])),
            node("Concat", ["lead", "h", "rest"], "want", axis=0), node("Identity", ["x"], "i"), node("Reshape", ["i", "want"], "r"), node("Transpose", ["r"], "t"), node("Transpose", ["t"], "y", perm=[3, 2, 1, 0]),
        ],
        {"two": np.array([2]), "three": np.array([3]), "zero": np.array([0])},
    ),
    "sequence": (
        [
            node("ReduceMean", ["x"], "m", axes=[2], keepdims=1), node("Squeeze", ["m", "ax"], "q"), node("Transpose", ["q"], "t", perm=[0, 2, 1]), node("MatMul", ["t", "w"], "z"), node("Add", ["z", "b"], "a"),
            node("Softmax", ["a"], "s", axis=-1), node("Unsqueeze", ["s", "ax"], "y"),
        ],
        {"ax": np.array([2]), "w": f32(3, 6), "b": f32(6)},
    ),
    "arithmetic": ([node("Sub", ["x", "k"], "a"), node("Pow", ["a", "e"], "b"), node("Sqrt", ["b"], "c"), node("GlobalAveragePool", ["c"], "g"), node("Div", ["c", "g"], "d"), node("Slice", ["d", "st", "en", "ax", "by"], "y")],
                   {"k": f32(3, 1, 1), "e": np.float32([2]), "st": np.array([1, -6]), "en": np.array([2**62, -1]), "ax": np.array([1, -1]), "by": np.array([1, 2])}),
}


@pytest.mark.parametrize("name", CASES)
def test_graphs_agree_with_another_runtime(name):
    runtime = pytest.importorskip("onnxruntime")
    nodes, constants = CASES[name]
    model = onnx(nodes, constants)
    other = runtime.InferenceSession(model, providers=["CPUExecutionProvider"])
    own = G.Session(M.read(model))
    copy = G.Session(M.read(M.write_container(M.read(model), (8, 12))))
    for shape in ((1, 3, 8, 8), (1, 3, 7, 10)):
        x = f32(*shape)
        (want,) = other.run(None, {"x": x})
        got = own.run(x)
        assert got.shape == want.shape and np.abs(got - want).max() <= 2e-4
        if name != "shapes":  # sizes are folded before they are written
            assert np.allclose(copy.run(x), got, atol=1e-5)


def test_folding_and_fusing():
    plan = G.bind(M.read(onnx(*CASES["conv_bn_gelu"])), (1, 3, 8, 8))
    assert [n.op for n in plan.nodes] == ["Conv", "Gelu"] and len(plan.constants) == 2
    loose = G.bind(M.read(onnx(*CASES["conv_bn_gelu"])), (1, 3, 8, 8), fuse=False)
    x = f32(1, 3, 8, 8)
    assert len(loose.nodes) == 7 and np.allclose(plan.run(x), loose.run(x), atol=1e-5)
    shapes = G.bind(M.read(onnx(*CASES["shapes"])), (1, 3, 4, 5))
    assert [n.op for n in shapes.nodes] == ["Reshape", "Transpose", "Transpose"]
    # nothing is fused over a value that something else reads
    nodes, constants = CASES["conv_bn_gelu"]
    both = G.bind(M.read(onnx([*nodes[:2], node("Add", ["c", "n"], "y")], constants)), (1, 3, 8, 8))
    assert [n.op for n in both.nodes] == ["Conv", "BatchNormalization", "Add"]
    spans = {name: (birth, death) for name, birth, death, _ in loose.lifetimes()}
    assert spans["n"] == (1, 5) and spans["y"] == (6, 7)


BAD = {
    "unknown attribute": [node("Relu", ["x"], "y", slope=1.0)], "unknown operator": [node("Tanh", ["x"], "y")], "too many inputs": [node("Relu", ["x", "x"], "y")],
    "made twice": [node("Relu", ["x"], "y"), node("Relu", ["x"], "y")], "read before made": [node("Relu", ["z"], "y")], "old softmax": [node("Softmax", ["x"], "y", axis=1)],
    "both paddings": [node("MaxPool", ["x"], "y", kernel_shape=[2, 2], auto_pad="SAME_UPPER", pads=[0, 0, 0, 0])], "stride by name": [node("MaxPool", ["x"], "y", kernel_shape=[2, 2], auto_pad="SAME_UPPER", strides=[2, 2])],
    "axis twice": [node("ReduceMean", ["x"], "y", axes=[1, -3])], "no such permutation": [node("Transpose", ["x"], "y", perm=[0, 1, 2, 2])], "empty slice": [node("Slice", ["x"], "y", starts=[3], ends=[3])],
    "half pixel": [node("Resize", ["x", "", "k"], "y")], "constant output": [node("Constant", [], "y", value=np.float32([1]))], "sizes as numbers": [node("Shape", ["x"], "s"), node("Relu", ["s"], "y")],
}


@pytest.mark.parametrize("what", BAD)
def test_models_that_are_not_read(what):
    with pytest.raises((G.InvalidModel, G.UnsupportedOperator)):
        G.bind(M.read(onnx(BAD[what], {"k": np.float32([1, 1, 2, 2])}, opset=11)), (1, 3, 8, 8))


def smallest():
    """One tensor that is input and output, no nodes."""
    tensor_ = struct.pack("<II8iII4Q", 1, 1, 1, *[0] * 7, M.INPUT | M.OUTPUT, 0, 0, 0, M.NOWHERE, 0)
    at = M.HEADER + 16
    end = at + M.TENSOR
    head = struct.pack("<4sHHIIIIII16Q", b"LWM0", 0, 1, 160, 1, 1, 0, 1, 1, 160, 168, at, end, end, 0, end, 0, end, 0, end, 0, 0, 0, 0, 0)
    out = bytearray(head + struct.pack("<IIII", 0, 0, 0, 0) + tensor_)
    return out


def sealed(raw):
    raw = bytearray(raw)
    raw[128:136] = bytes(8)
    raw[128:136] = struct.pack("<Q", fnv1a(bytes(raw), (128, 136)))
    return bytes(raw)


def test_containers():
    good = sealed(smallest())
    g = M.read(good)
    assert (g.input, g.output, g.input_shape, g.nodes) == ("t0", "t0", (1,), [])
    with pytest.raises(M.ChecksumMismatch):
        M.read(good[:128] + bytes(8) + good[136:])
    for at, raw in ((4, b"\\x01"), (12, b"\\x02"), (40, b"\\x01"), (112, b"\\xff"), (136, b"\\x01"), (176, b"\\x09"), (180, b"\\x09"), (184, b"\\x00"), (216, b"\\x08"), (232, b"\\x08")):
        with pytest.raises((M.InvalidModel, M.ResourceLimit)):
            M.read(sealed(good[:at] + raw.decode("unicode_escape").encode("latin1") + good[at + 1 :]))
    with pytest.raises(M.ResourceLimit):
        M.read(good, M.Limits(tensors=0))
    with pytest.raises(M.ResourceLimit):
        M.read(good, M.Limits(file_bytes=10))
    for cut in range(0, len(good), 7):
        with pytest.raises((M.InvalidModel, M.ResourceLimit)):
            M.read_container(good[:cut])
    model = onnx(*CASES["pools"])
    for cut in range(1, len(model), 5):
        with pytest.raises((M.InvalidModel, M.UnsupportedOperator)):
            G.bind(M.read(model[:cut]), (1, 3, 8, 8))


def test_models_over_tables(spark, tmp_path):
    model = onnx(*CASES["conv_bn_gelu"])
    (tmp_path / "a.any").write_bytes(model)
    (tmp_path / "b.any").write_bytes(M.write_container(M.read(model), (8, 12)))
    constants, nodes = M.tables(spark, str(tmp_path))
    assert constants.count() == 18 and sorted({r.op for r in nodes.collect()}) == ["Add", "BatchNormalization", "Conv", "Div", "Erf", "Mul"]
    x = f32(3, 1, 3, 8, 8)
    rows = [(k, [1, 3, 8, 8], v.ravel().tolist()) for k, v in enumerate(x)] + [(9, [1], None)]
    got = {r.name: r for r in G.run_model(spark.createDataFrame(rows, "name int, shape array<int>, data array<float>"), model).collect()}
    own = G.Session(M.read(model))
    assert sorted(got) == [0, 1, 2]
    for k in got:
        assert np.allclose(np.array(got[k].data).reshape(got[k].shape), own.run(x[k : k + 1][0]), atol=1e-6)


def test_kernels_can_be_replaced():
    old = blocks.KERNELS["Relu"]
    try:
        blocks.register("Relu")(lambda x: np.abs(x))
        plan = G.bind(M.read(onnx([node("Relu", ["x"], "y")], {})), (1, 3, 2, 2))
        assert (plan.run(np.full((1, 3, 2, 2), -1.0)) == 1).all()
    finally:
        blocks.register("Relu")(old)

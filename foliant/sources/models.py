"""Model files: a small container of its own, and a subset of ONNX. All bytes are untrusted: sizes, ranges and numbers are
checked before they are used.

read() tells them apart by their first four bytes. tables() gives tensors and nodes of many files as rows.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.functions.text import fnv1a
from foliant.plans.graph import Graph, InvalidModel, Node, UnsupportedOperator, bind

# The container's layout, and its codes of operators and element types.
MAGIC, HEADER, TENSOR, NODE, NO_PLAN, NOWHERE = b"LWM0", 160, 80, 72, 1, 2**64 - 1
CONSTANT, INPUT, OUTPUT = 1, 2, 4
CHECKSUM_AT = (128, 136)
OPERATORS = (
    "Conv", "Add", "Mul", "Div", "Erf", "HardSigmoid", "BatchNormalization", "ReduceMean", "Relu", "AveragePool", "Squeeze", "Transpose", "Unsqueeze",
    "MatMul", "Softmax", "Reshape", "Concat", "ConvTranspose", "MaxPool", "Resize", "Sigmoid", "Sub", "Sqrt", "Pow", "Slice",
)
PARAMETER_BYTES = {
    "HardSigmoid": 16, "BatchNormalization": 24, "ReduceMean": 48, "AveragePool": 64, "MaxPool": 64, "Conv": 64, "ConvTranspose": 64,
    "Squeeze": 40, "Transpose": 40, "Unsqueeze": 40, "Softmax": 16, "Concat": 16, "Resize": 32, "Slice": 136,
}
TYPES = {1: "<f4", 2: "<i4", 3: "<i8", 4: "u1"}
#: Element types of ONNX, and the versions that are read.
ONNX_TYPES = {1: "<f4", 6: "<i4", 7: "<i8"}
ONNX_IR, ONNX_OPSET = range(3, 11), range(7, 15)


@dataclass(frozen=True)
class Limits:
    """Beyond these a file is an error. ONNX has tighter ones of its own for bytes and nodes."""

    file_bytes: int = 1 << 30
    tensors: int = 1_000_000
    nodes: int = 1_000_000
    rank: int = 8
    onnx_bytes: int = 256 << 20
    onnx_nodes: int = 4096
    onnx_values: int = 16384


class ResourceLimit(ValueError):
    pass


class ChecksumMismatch(InvalidModel):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidModel(what)


def _within(ok: bool, what: str) -> None:
    if not ok:
        raise ResourceLimit(what)


def read(data: bytes, limits: Limits = Limits()) -> Graph:
    """Of either format; the name of a file says nothing."""
    _within(len(data) <= limits.file_bytes, "file size")
    return read_container(data, limits) if data[:4] == MAGIC else read_onnx(data, limits)


def read_file(path: str, limits: Limits = Limits()) -> Graph:
    """From a file on this machine, mapped into memory while it is read."""
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        _within(size <= limits.file_bytes, "file size")
        _need(size > 0, "an empty file")
        return read(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)[:], limits)


def read_stream(stream, limits: Limits = Limits()) -> Graph:
    """From an open binary stream, which stays open; no more than the limit is read."""
    data = stream.read(limits.file_bytes + 1)
    return read(data, limits)


# --- the container ------------------------------------------------------------------------------------------


def checksum(data: bytes) -> int:
    """Of the whole file, the place of the checksum taken for zeros."""
    return fnv1a(data, CHECKSUM_AT)


@dataclass(frozen=True)
class _Tensor:
    name: str
    dims: tuple[int, ...]
    flags: int
    type: str
    at: int
    size: int


def _section(at: int, size: int, total: int, what: str) -> None:
    _need(at % 8 == 0 and 0 <= at <= total and 0 <= size <= total - at, f"{what}: not aligned, or outside the file")


def _tensors(data: bytes, at: int, count: int, weights: tuple[int, int], limits: Limits) -> list[_Tensor]:
    out = []
    for i in range(count):
        raw = data[at + i * TENSOR : at + (i + 1) * TENSOR]
        code, rank = struct.unpack_from("<II", raw)
        _need(code in TYPES and rank <= min(limits.rank, 8), "a tensor of unknown type, or of too many axes")
        dims, (flags, zero) = struct.unpack_from("<8i", raw, 8), struct.unpack_from("<II", raw, 40)
        start, size, plan, planned = struct.unpack_from("<4Q", raw, 48)
        own = dims[:rank]
        _need(not any(dims[rank:]) and not flags & ~7 and not zero and plan == NOWHERE and not planned, "reserved fields of a tensor")
        _need(all(d == -1 or d > 0 for d in own), "sizes of a tensor")
        if flags & CONSTANT:
            want = int(np.prod(own, dtype=object)) * np.dtype(TYPES[code]).itemsize
            _need(-1 not in own and size == want and start % 8 == 0 and weights[0] <= start and start + size <= sum(weights), "data of a constant")
        else:
            _need(not start and not size, "data of a tensor that is no constant")
        out.append(_Tensor(f"t{i}", own, flags, TYPES[code], start, size))
    return out


def _unpack(op: str, p: bytes, out: tuple[int, ...]) -> dict:
    """Attributes of a node's parameters; out: the declared shape of its output."""
    i = lambda at, n: list(struct.unpack_from(f"<{n}i", p, at))
    f = lambda at: struct.unpack_from("<f", p, at)[0]
    if op == "Reshape":
        return {"shape": list(out)}
    if not p:
        return {}
    count = struct.unpack_from("<H", p, 2)[0]
    _need(op not in ("ReduceMean", "Squeeze", "Transpose", "Unsqueeze", "Slice") or count <= 8, "axes of a node")
    if op in ("Conv", "ConvTranspose"):
        return {"group": i(4, 1)[0], "kernel_shape": i(8, 2), "strides": i(16, 2), "dilations": i(24, 2), "pads": i(32, 4)}
    if op in ("AveragePool", "MaxPool"):
        return {"kernel_shape": i(8, 2), "strides": i(16, 2), "pads": i(24, 4), "ceil_mode": i(40, 1)[0], "count_include_pad": i(44, 1)[0]}
    if op == "HardSigmoid":
        return {"alpha": f(4), "beta": f(8)}
    if op == "BatchNormalization":
        return {"epsilon": f(4), "momentum": f(8)}
    if op == "ReduceMean":
        return {"axes": i(12, count), "keepdims": i(4, 1)[0]}
    if op in ("Squeeze", "Unsqueeze"):
        return {"axes": i(4, count)}
    if op == "Transpose":
        return {"perm": i(4, count)}
    if op in ("Softmax", "Concat"):
        return {"axis": i(4, 1)[0]}
    if op == "Resize":
        return {"scales": [f(4 + 4 * k) for k in range(4)]}
    return {n: i(at, count) for n, at in (("starts", 4), ("ends", 36), ("axes", 68), ("steps", 100))}


def read_container(data: bytes, limits: Limits = Limits()) -> Graph:
    total = len(data)
    _within(total <= limits.file_bytes, "file size")
    _need(total >= HEADER and data[:4] == MAGIC, "no container")
    _need(struct.unpack_from("<HHI", data, 4) == (0, 1, HEADER), "version or header size")
    flags, tensors, nodes, inputs, outputs = struct.unpack_from("<5I", data, 12)
    input_at, output_at, tensor_at, node_at, param_at, param_size, string_at, string_size, weight_at, weight_size, size, workspace, given, *zero = struct.unpack_from("<16Q", data, 32)
    _need(flags == NO_PLAN and not workspace and not any(zero) and size == total, "flags, plan, reserved fields or file size")
    _within(tensors <= limits.tensors and nodes <= limits.nodes, "tensors or nodes")
    sections = [(input_at, 4 * inputs), (output_at, 4 * outputs), (tensor_at, TENSOR * tensors), (node_at, NODE * nodes), (param_at, param_size), (string_at, string_size), (weight_at, weight_size)]
    for (at, length), what in zip(sections, ("inputs", "outputs", "tensors", "nodes", "parameters", "strings", "weights"), strict=True):
        _section(at, length, total, what)
    ends = [HEADER, *(at + length for at, length in sections)]
    _need(all(end <= at for end, (at, _) in zip(ends, sections, strict=False)) and ends[-1] == total, "sections overlap, or are out of order")
    if not given or checksum(data) != given:
        raise ChecksumMismatch("checksum")
    known = _tensors(data, tensor_at, tensors, (weight_at, weight_size), limits)

    def indexes(at: int, count: int, flag: int) -> list[int]:
        own = list(struct.unpack_from(f"<{count}I", data, at))
        _need(all(k < tensors and known[k].flags & flag for k in own), "inputs or outputs of the graph")
        return own

    ins, outs = indexes(input_at, inputs, INPUT), indexes(output_at, outputs, OUTPUT)
    _need(len(ins) == 1 and len(outs) == 1, "one input and one output")
    constants = {t.name: np.frombuffer(data, t.type, t.size // np.dtype(t.type).itemsize, t.at).reshape(t.dims) for t in known if t.flags & CONSTANT}
    made = []
    for i in range(nodes):
        at = node_at + i * NODE
        code, n_in, n_out, zero = struct.unpack_from("<4H", data, at)
        if not 1 <= code <= len(OPERATORS):
            raise UnsupportedOperator(f"operator {code}")
        op, own = OPERATORS[code - 1], list(struct.unpack_from("<8I", data, at + 8))
        to = list(struct.unpack_from("<4I", data, at + 40))
        start, length, rest = struct.unpack_from("<QII", data, at + 56)
        _need(n_in <= 8 and n_out == 1 and not zero and not rest and not any(own[n_in:]) and not any(to[1:]) and max([*own[:n_in], to[0]]) < tensors, "inputs or outputs of a node")
        _need(length == PARAMETER_BYTES.get(op, 0) and ((start % 8 == 0 and param_at <= start and start + length <= param_at + param_size) if length else not start), "parameters of a node")
        p = data[start : start + length] if length else b""
        _need(not p or struct.unpack_from("<H", p)[0] == 1, "version of a node's parameters")
        attrs, extra = _unpack(op, p, known[to[0]].dims), []
        if op == "Reshape":  # as a control input, which is where the graph expects it
            extra, constants[f"n{i}/shape"] = [f"n{i}/shape"], np.array(attrs.pop("shape"), np.int64)
        if op == "Resize":
            extra, constants[f"n{i}/scales"] = ["", f"n{i}/scales"], np.array(attrs.pop("scales"), np.float32)
            attrs = {"mode": "nearest", "coordinate_transformation_mode": "asymmetric", "nearest_mode": "floor"}
        made.append(Node(op, (*(known[k].name for k in own[:n_in]), *extra), known[to[0]].name, attrs))
    return Graph(made, constants, known[ins[0]].name, known[ins[0]].dims, known[outs[0]].name, opset=13)


def _pack(op: str, a: dict) -> bytes:
    out = bytearray(PARAMETER_BYTES.get(op, 0))
    if not out:
        return b""
    put = lambda at, kind, *v: struct.pack_into("<" + kind * len(v), out, at, *v)
    put(0, "H", 1)
    if op in ("Conv", "ConvTranspose"):
        put(2, "H", 2), put(4, "i", a["group"]), put(8, "i", *a["kernel_shape"], *a["strides"], *a["dilations"], *a["pads"])
    elif op in ("AveragePool", "MaxPool"):
        put(4, "i", 2), put(8, "i", *a["kernel_shape"], *a["strides"], *a["pads"], int(a["ceil_mode"]), int(a.get("count_include_pad", 0)))
    elif op == "HardSigmoid":
        put(4, "f", a["alpha"], a["beta"])
    elif op == "BatchNormalization":
        put(4, "f", a["epsilon"], a.get("momentum", 0.9))
    elif op == "ReduceMean":
        put(2, "H", len(a["axes"])), put(4, "i", int(a["keepdims"]), 0, *a["axes"])
    elif op in ("Squeeze", "Unsqueeze", "Transpose"):
        axes = a["perm" if op == "Transpose" else "axes"]
        put(2, "H", len(axes)), put(4, "i", *axes)
    elif op in ("Softmax", "Concat"):
        put(4, "i", a["axis"])
    elif op == "Resize":
        put(2, "H", 4), put(4, "f", 1.0, 1.0, *a["scales"])
    else:
        put(2, "H", len(a["starts"]))
        for at, n in ((4, "starts"), (36, "ends"), (68, "axes"), (100, "steps")):
            put(at, "i", *(max(-(2**31), min(2**31 - 1, v)) for v in a[n]))
    return bytes(out)


def write_container(graph: Graph, sizes: tuple[int, int] = (320, 640)) -> bytes:
    """The container of a graph. Open sizes of its input are tried at two values: what differs is open, too."""
    plans = [bind(graph, tuple(s if n == -1 else n for n in graph.input_shape), fuse=False) for s in sizes]
    plan = plans[0]

    def dims(name: str) -> list[int]:
        a, b = (p.shapes[name] for p in plans)
        _need(len(a) == len(b), "a tensor of varying rank")
        return [x if x == y else -1 for x, y in zip(a, b, strict=True)]

    names = [plan.input] + [n for n in dict.fromkeys(i for node in plan.nodes for i in (*node.inputs, node.output)) if n != plan.input]
    ids = {n: k for k, n in enumerate(names)}
    pad = lambda n: -(-n // 8) * 8
    params, weights, records, tensors = bytearray(), bytearray(), bytearray(), bytearray()
    tensor_at = HEADER + 16
    node_at = tensor_at + TENSOR * len(names)
    param_at = node_at + NODE * len(plan.nodes)
    for node in plan.nodes:
        a = dict(node.attrs)
        rank = len(plan.shapes[node.inputs[0]])
        if "Conv" in node.op:
            a["kernel_shape"] = plan.constants[node.inputs[1]].shape[2:]
        for key, whole in (("axes", range(rank)), ("perm", range(rank)[::-1])):
            if key in a and a[key] is None:
                a[key] = [k for k in whole if node.op != "Squeeze" or plan.shapes[node.inputs[0]][k] == 1][: len(a.get("starts") or whole)]
        if node.op == "Slice" and a["steps"] is None:
            a["steps"] = [1] * len(a["starts"])
        p = _pack(node.op, a)
        own, at = [ids[n] for n in node.inputs], param_at + len(params) if p else 0
        records += struct.pack("<4H8I4IQII", OPERATORS.index(node.op) + 1, len(own), 1, 0, *own, *[0] * (8 - len(own)), ids[node.output], 0, 0, 0, at, len(p), 0)
        params += p + bytes(pad(len(p)) - len(p))
    weight_at = param_at + len(params)
    for n in names:
        c = plan.constants.get(n)
        d = list(c.shape) if c is not None else dims(n)
        raw = c.astype("<f4").tobytes() if c is not None else b""
        flags = CONSTANT * (c is not None) | INPUT * (n == plan.input) | OUTPUT * (n == plan.output)
        tensors += struct.pack("<II8iII4Q", 1, len(d), *d, *[0] * (8 - len(d)), flags, 0, weight_at + len(weights) if raw else 0, len(raw), NOWHERE, 0)
        weights += raw + bytes(pad(len(raw)) - len(raw))
    size = weight_at + len(weights)
    head = struct.pack("<4sHHIIIIII16Q", MAGIC, 0, 1, HEADER, NO_PLAN, len(names), len(plan.nodes), 1, 1, HEADER, HEADER + 8, tensor_at, node_at, param_at, len(params), weight_at, 0, weight_at, len(weights), size, 0, 0, 0, 0, 0)
    out = bytearray(head + struct.pack("<IIII", ids[plan.input], 0, ids[plan.output], 0) + tensors + records + params + weights)
    struct.pack_into("<Q", out, CHECKSUM_AT[0], checksum(bytes(out)))
    return bytes(out)


# --- ONNX ---------------------------------------------------------------------------------------------------


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; values of fixed width stay bytes."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        out = 0
        for shift in range(0, 70, 7):
            _need(at < end, "a message that ends within a number")
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out & (2**64 - 1)
        raise InvalidModel("a number of more than ten bytes")

    while at < end:
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        _need(kind in (1, 2, 5), "a field of unknown kind")
        size = number() if kind == 2 else 8 if kind == 1 else 4
        _need(size <= end - at, "a field that is longer than its message")
        yield tag >> 3, data[at : at + size]
        at += size


def _signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n


def _text(raw) -> str:
    try:
        return raw.decode("utf-8")
    except (UnicodeDecodeError, AttributeError) as e:
        raise InvalidModel("text that is not UTF-8") from e


def _many(values: list, kind: str) -> list:
    """Repeated numbers, packed or one by one."""
    out: list = []
    for v in values:
        if kind == "f":
            out += np.frombuffer(v, "<f4").tolist()
        elif isinstance(v, int):
            out.append(_signed(v))
        else:
            out += [_signed(n) for _, n in fields(b"".join(b"\x08" + p for p in _varints(v)))]
    return out


def _varints(raw: bytes) -> list[bytes]:
    out, start = [], 0
    for i, b in enumerate(raw):
        if b < 128:
            out.append(raw[start : i + 1])
            start = i + 1
    _need(start == len(raw), "a packed number that does not end")
    return out


def _collected(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for k, v in fields(data):
        out.setdefault(k, []).append(v)
    return out


def _onnx_tensor(data: bytes, limits: Limits) -> tuple[str, np.ndarray]:
    m = _collected(data)
    kind = m.get(2, [0])[-1]
    _need(kind in ONNX_TYPES, "a tensor of a type that is not read")
    dims = _many(m.get(1, []), "i")
    _within(len(dims) <= limits.rank, "axes of a tensor")
    _need(all(d >= 0 for d in dims) and 14 not in m and 13 not in m, "sizes of a tensor, or data elsewhere")
    if 9 in m:
        raw = m[9][-1]
        _need(len(raw) % np.dtype(ONNX_TYPES[kind]).itemsize == 0, "data of a tensor")
        values = np.frombuffer(raw, ONNX_TYPES[kind])
    else:
        values = np.array(_many(m.get({1: 4, 6: 5, 7: 7}[kind], []), "f" if kind == 1 else "i"), ONNX_TYPES[kind])
    _need(values.size == int(np.prod(dims, dtype=object)), "data of a tensor")
    return _text(m.get(8, [b""])[-1]), values.reshape(dims)


def _onnx_value(data: bytes) -> tuple[str, tuple[int, ...]]:
    m = _collected(data)
    kind = _collected(_collected(m.get(2, [b""])[-1]).get(1, [b""])[-1])
    _need(kind.get(1, [0])[-1] == 1, "an input or output that is not of 32-bit floats")
    sizes = []
    for d in _collected(kind.get(2, [b""])[-1]).get(1, []):
        own = _collected(d)
        sizes.append(_signed(own[1][-1]) if own.get(1) and own[1][-1] else -1)
    return _text(m.get(1, [b""])[-1]), tuple(sizes)


def _onnx_attribute(data: bytes, limits: Limits) -> tuple[str, object]:
    m = _collected(data)
    name, kind = _text(m.get(1, [b""])[-1]), m.get(20, [0])[-1]
    if kind == 1:
        return name, float(np.frombuffer(m[2][-1], "<f4")[0])
    if kind == 2:
        return name, _signed(m.get(3, [0])[-1])
    if kind == 3:
        return name, _text(m.get(4, [b""])[-1])
    if kind == 4:
        return name, _onnx_tensor(m[5][-1], limits)[1]
    if kind == 7:
        return name, _many(m.get(8, []), "i")
    raise InvalidModel(f"attribute {name} of a kind that is not read")


def read_onnx(data: bytes, limits: Limits = Limits()) -> Graph:
    _within(len(data) <= min(limits.file_bytes, limits.onnx_bytes), "file size")
    m = _collected(data)
    _need(m.get(1, [0])[-1] in ONNX_IR and 7 in m, "no ONNX model, or of a version that is not read")
    opsets = [_collected(o) for o in m.get(8, [])]
    versions = [_signed(o.get(2, [0])[-1]) for o in opsets if _text(o.get(1, [b""])[-1]) in ("", "ai.onnx")]
    _need(len(versions) == 1 and len(opsets) == 1 and versions[0] in ONNX_OPSET, "operators of a version that is not read")
    g = _collected(m[7][-1])
    _within(len(g.get(1, [])) <= min(limits.nodes, limits.onnx_nodes) and len(g.get(5, [])) <= min(limits.tensors, limits.onnx_values), "nodes or constants")
    constants: dict[str, np.ndarray] = {}
    for raw in g.get(5, []):
        name, value = _onnx_tensor(raw, limits)
        _need(bool(name) and name not in constants, "constants without a name of their own")
        constants[name] = value
    declared = dict(_onnx_value(raw) for raw in g.get(11, []) if _text(_collected(raw).get(1, [b""])[-1]) not in constants)
    outputs = [_onnx_value(raw) for raw in g.get(12, [])]
    _need(len(declared) == 1 and len(outputs) == 1, "one input and one output")
    (name, shape), nodes = next(iter(declared.items())), []
    for raw in g.get(1, []):
        n = _collected(raw)
        to = [_text(v) for v in n.get(2, [])]
        _need(len(to) == 1 and not n.get(7, [b""])[-1], "a node with several outputs, or of another domain")
        attrs: dict = {}
        for a in n.get(5, []):
            key, value = _onnx_attribute(a, limits)
            _need(key not in attrs, "an attribute that is given twice")
            attrs[key] = value
        nodes.append(Node(_text(n.get(4, [b""])[-1]), tuple(_text(v) for v in n.get(1, [])), to[0], attrs))
    return Graph(nodes, constants, name, shape, outputs[0][0], versions[0])


# --- as tables ----------------------------------------------------------------------------------------------


def tables(spark: SparkSession, path: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Of all model files under a path: constants (model, tensor, shape, data) and nodes (model, node, op, inputs, output, attrs).
    Files are read where Spark puts them; one that is no sound model is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def constants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                g = read(r["content"], limits)
                for name, v in sorted(g.constants.items()):
                    yield pa.RecordBatch.from_pydict({"model": [r["path"]], "tensor": [name], "shape": pa.array([list(v.shape)], pa.list_(pa.int32())), "data": pa.array([v.astype(float).ravel()], pa.list_(pa.float64()))})

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = read(r["content"], limits).nodes
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array([r["path"]] * len(own), pa.string()), "node": pa.array(range(len(own)), pa.int32()), "op": pa.array([n.op for n in own], pa.string()),
                    "inputs": pa.array([list(n.inputs) for n in own], pa.list_(pa.string())), "output": pa.array([n.output for n in own], pa.string()),
                    "attrs": pa.array([[(k, str(v)) for k, v in sorted(n.attrs.items())] for n in own], pa.map_(pa.string(), pa.string())),
                })

    return (
        files.mapInArrow(constants, "model string, tensor string, shape array<int>, data array<double>"),
        files.mapInArrow(nodes, "model string, node int, op string, inputs array<string>, output string, attrs map<string,string>"),
    )

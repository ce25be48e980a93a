"""Tensor operators on blocks: NumPy arrays of any leading size, one call for a whole batch of tensors.

The block encoding keeps a tensor in one row, as an array. Operators run on Arrow batches where the rows lie, so nothing is
shuffled. `over()` is the way from a table of arrays to a table of elements; the coordinate encoding of the same operators
is in tensor.py.

Kernels are looked up by name in KERNELS, which callers may extend or replace (`register`). Spatial operators take
(n, c, h, w). Sums run over the taps of a kernel, each over the cells that it meets: a tap outside the input is skipped, not
multiplied by zero, so that weights that are not finite do no harm at the edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The rational approximation of erf by Abramowitz and Stegun, 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

KERNELS: dict[str, Callable] = {}
#: Elements that over() puts out at once.
OUT_ELEMENTS = 1 << 20


def register(name: str):
    """Makes a function known as the kernel of that name; a later one replaces an earlier one."""

    def add(f: Callable) -> Callable:
        KERNELS[name] = f
        return f

    return add


# --- element-wise -------------------------------------------------------------------------------------------


def broadcast_shape(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """Right-aligned; sizes must agree or be one."""
    try:
        return tuple(np.broadcast_shapes(a, b))
    except ValueError as e:
        raise ValueError(f"shapes {a} and {b} do not broadcast") from e


def _binary(f):
    def run(a, b):
        broadcast_shape(np.shape(a), np.shape(b))
        with np.errstate(all="ignore"):
            return f(a, b)

    return run


add = register("Add")(_binary(np.add))
sub = register("Sub")(_binary(np.subtract))
mul = register("Mul")(_binary(np.multiply))
div = register("Div")(_binary(np.divide))
power = register("Pow")(_binary(np.power))


@register("Relu")
def relu(x):
    return np.maximum(x, 0)


@register("Sigmoid")
def sigmoid(x):
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


@register("Sqrt")
def sqrt(x):
    with np.errstate(invalid="ignore"):
        return np.sqrt(x)


@register("Erf")
def erf(x):
    """The approximation, not the exact function: results must agree with it."""
    t = 1 / (1 + ERF_P * np.abs(x))
    poly = np.zeros_like(t)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return np.where(x < 0, -1.0, 1.0) * (1 - poly * np.exp(-x * x))


@register("HardSigmoid")
def hard_sigmoid(x, alpha: float = 0.2, beta: float = 0.5):
    return np.clip(alpha * x + beta, 0, 1)


@register("HardSwish")
def hard_swish(x, alpha: float = 1 / 6, beta: float = 0.5):
    return hard_sigmoid(x, alpha, beta) * x


@register("Gelu")
def gelu(x, divisor: float = 2**0.5, plus: float = 1.0, factor: float = 0.5):
    return (erf(x / divisor) + plus) * x * factor


ACTIVATIONS = {"relu": relu, "sigmoid": sigmoid, "hard_sigmoid": hard_sigmoid, "hard_swish": hard_swish, "gelu": gelu}


@register("BatchNormalization")
def batch_norm(x, scale, bias, mean, var, epsilon: float = 1e-5):
    """Per channel, which is axis 1."""
    if np.ndim(x) < 2 or any(np.shape(p) != (x.shape[1],) for p in (scale, bias, mean, var)) or not epsilon > 0:
        raise ValueError("batch normalisation takes a value for each channel, and a positive epsilon")
    wide = lambda p: np.reshape(p, (-1,) + (1,) * (x.ndim - 2))
    return (x - wide(mean)) * (wide(scale) / np.sqrt(wide(var) + epsilon)) + wide(bias)


# --- reductions and products --------------------------------------------------------------------------------


def axes_of(axes, rank: int) -> tuple[int, ...]:
    """Axes from 0; negative ones count from the end. One that is given twice, or out of range, is an error."""
    out = tuple(a + rank if a < 0 else a for a in axes)
    if len(set(out)) < len(out) or any(not 0 <= a < rank for a in out):
        raise ValueError(f"axes {tuple(axes)} of rank {rank}")
    return out


@register("ReduceMean")
def reduce_mean(x, axes=None, keepdims: bool = True):
    return np.mean(x, axis=axes_of(range(x.ndim) if axes is None or not len(axes) else axes, x.ndim), keepdims=bool(keepdims))


@register("Softmax")
def softmax(x, axis: int = -1):
    (axis,) = axes_of([axis], x.ndim)
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


@register("MatMul")
def matmul(a, b):
    """Over the last two axes; the others broadcast."""
    if np.ndim(a) < 2 or np.ndim(b) < 2 or a.shape[-1] != b.shape[-2]:
        raise ValueError(f"no product of shapes {np.shape(a)} and {np.shape(b)}")
    broadcast_shape(a.shape[:-2], b.shape[:-2])
    return np.matmul(a, b)


def projection_argmax(x, weights, bias=None):
    """Class, logit and softmax probability of the first maximum of x @ weights + bias, without the softmax of the others."""
    z = matmul(x, weights)
    z = z if bias is None else z + bias
    top = z.max(-1)
    return z.argmax(-1), top, 1 / np.exp(z - top[..., None]).sum(-1)


# --- windows ------------------------------------------------------------------------------------------------


def window_count(size: int, kernel: int, stride: int, before: int, after: int, dilation: int = 1, ceil: bool = False) -> int:
    """Places of a kernel along an axis. With ceil a last place may stick out, but must begin within input or front padding."""
    room = size + before + after - (dilation * (kernel - 1) + 1)
    if min(kernel, stride, dilation) < 1 or min(before, after) < 0 or room < 0:
        raise ValueError(f"no place for a kernel of {kernel} in {size}")
    n = (-(-room // stride) if ceil else room // stride) + 1
    return n - 1 if ceil and (n - 1) * stride >= size + before else n


def transposed_size(size: int, kernel: int, stride: int, before: int, after: int, dilation: int = 1) -> int:
    n = (size - 1) * stride - before - after + dilation * (kernel - 1) + 1
    if n < 1:
        raise ValueError("a transposed convolution without output")
    return n


def same_upper(kernel: int, dilation: int = 1) -> tuple[int, int]:
    """Padding before and after that keeps the size at stride one; the odd cell comes after."""
    total = dilation * (kernel - 1)
    return total // 2, total - total // 2


def _reach(n_out: int, size: int, offset: int, stride: int) -> tuple[slice, slice]:
    """Where a tap at this offset (kernel place times dilation, less padding) meets the input: output and input cells."""
    first = max(0, -(offset // stride))
    last = min(n_out - 1, (size - 1 - offset) // stride)
    if last < first:
        return slice(0, 0), slice(0, 0)
    return slice(first, last + 1), slice(first * stride + offset, last * stride + offset + 1, stride)


def _taps(kernel, n_out, size, strides, pads, dilations) -> Iterator[tuple]:
    """(kernel row, kernel column, output rows, output columns, input rows, input columns) of every tap that meets the input."""
    for i in range(kernel[0]):
        oy, iy = _reach(n_out[0], size[0], i * dilations[0] - pads[0], strides[0])
        for j in range(kernel[1]):
            ox, ix = _reach(n_out[1], size[1], j * dilations[1] - pads[1], strides[1])
            if oy.stop > oy.start and ox.stop > ox.start:
                yield i, j, oy, ox, iy, ix


def prepared(w: np.ndarray, bias=None, strides=(1, 1), pads=(0, 0, 0, 0), dilations=(1, 1), epilogue: Callable | None = None, rows: int = 1 << 16) -> Callable:
    """A convolution in one group whose weights are packed once, as a matrix of taps by outputs. Each call gathers the taps of
    `rows` output cells at a time into one panel and takes one matrix product. Padding is zeros, so weights must be finite."""
    out, c, kh, kw = w.shape
    if not np.isfinite(w).all():
        raise ValueError("weights that are not finite")
    packed = np.ascontiguousarray(w.reshape(out, -1).T)

    def run(x):
        size = [window_count(s, k, st, a, b, d) for s, k, st, a, b, d in zip(x.shape[2:], (kh, kw), strides, pads[:2], pads[2:], dilations, strict=True)]
        wide = np.pad(x, ((0, 0), (0, 0), (pads[0], pads[2]), (pads[1], pads[3])))
        spans = [d * (k - 1) + 1 for d, k in zip(dilations, (kh, kw), strict=True)]
        view = np.lib.stride_tricks.sliding_window_view(wide, spans, (2, 3))[:, :, :: strides[0], :: strides[1], :: dilations[0], :: dilations[1]]
        view = view.transpose(0, 2, 3, 1, 4, 5)  # (n, h, w, c, kh, kw)
        y = np.empty((len(x), size[0], size[1], out), np.result_type(x, w))
        step = max(1, rows // max(1, size[0] * size[1]))
        for lo in range(0, len(x), step):
            panel = view[lo : lo + step].reshape(-1, c * kh * kw)
            y[lo : lo + step] = (panel @ packed).reshape(-1, size[0], size[1], out)
        y = y.transpose(0, 3, 1, 2)
        y = y if bias is None else y + np.reshape(bias, (-1, 1, 1))
        return y if epilogue is None else epilogue(y)

    return run


@register("Conv")
def conv(x, w, bias=None, strides=(1, 1), pads=(0, 0, 0, 0), dilations=(1, 1), group: int = 1, epilogue: Callable | None = None):
    """x (n, c, h, w), w (out, c / group, kh, kw), pads top, left, bottom, right. epilogue: what follows on the sums."""
    n, c, h, width = x.shape
    out, per, kh, kw = w.shape
    if per * group != c or out % group:
        raise ValueError(f"weights {w.shape} in {group} groups do not fit {c} channels")
    size = [window_count(s, k, st, a, b, d) for s, k, st, a, b, d in zip((h, width), (kh, kw), strides, pads[:2], pads[2:], dilations, strict=True)]
    y = np.zeros((n, group, out // group, *size), np.result_type(x, w))
    xs, ws = x.reshape(n, group, per, h, width), w.reshape(group, out // group, per, kh, kw)
    for i, j, oy, ox, iy, ix in _taps((kh, kw), size, (h, width), strides, pads, dilations):
        y[..., oy, ox] += np.einsum("ngihw,goi->ngohw", xs[..., iy, ix], ws[..., i, j], optimize=True)
    y = y.reshape(n, out, *size)
    y = y if bias is None else y + np.reshape(bias, (-1, 1, 1))
    return y if epilogue is None else epilogue(y)


def epilogue(norm: tuple | None = None, bias=None, residual=None, activation: str | None = None) -> Callable:
    """Batch normalisation (scale, bias, mean, var, epsilon), bias of a channel, residual, activation, in this order."""

    def run(y):
        y = y if norm is None else batch_norm(y, *norm)
        y = y if bias is None else y + np.reshape(bias, (-1, 1, 1))
        y = y if residual is None else y + residual
        return y if activation is None else ACTIVATIONS[activation](y)

    return run


@register("ConvTranspose")
def conv_transpose(x, w, bias=None, strides=(1, 1), pads=(0, 0, 0, 0), dilations=(1, 1), group: int = 1):
    """x (n, c, h, w), w (c, out / group, kh, kw): every cell is spread over its taps; what falls into the padding is lost."""
    n, c, h, width = x.shape
    if w.shape[0] != c or c % group:
        raise ValueError(f"weights {w.shape} in {group} groups do not fit {c} channels")
    per, kh, kw = w.shape[1:]
    size = [transposed_size(s, k, st, a, b, d) for s, k, st, a, b, d in zip((h, width), (kh, kw), strides, pads[:2], pads[2:], dilations, strict=True)]
    y = np.zeros((n, group, per, *size), np.result_type(x, w))
    xs, ws = x.reshape(n, group, c // group, h, width), w.reshape(group, c // group, per, kh, kw)
    # the taps of a convolution from the output back to the input
    for i, j, iy, ix, oy, ox in _taps((kh, kw), (h, width), size, strides, pads, dilations):
        y[..., oy, ox] += np.einsum("ngihw,gio->ngohw", xs[..., iy, ix], ws[..., i, j], optimize=True)
    y = y.reshape(n, group * per, *size)
    return y if bias is None else y + np.reshape(bias, (-1, 1, 1))


def _pooled(x, kernel, strides, pads, ceil):
    size = [window_count(s, k, st, a, b, 1, ceil) for s, k, st, a, b in zip(x.shape[2:], kernel, strides, pads[:2], pads[2:], strict=True)]
    return size, _taps(kernel, size, x.shape[2:], strides, pads, (1, 1))


@register("MaxPool")
def max_pool(x, kernel_shape, strides=(1, 1), pads=(0, 0, 0, 0), ceil_mode: bool = False):
    """Padded cells take no part."""
    size, taps = _pooled(x, kernel_shape, strides, pads, bool(ceil_mode))
    y = np.full((*x.shape[:2], *size), np.finfo(np.float32).min, np.result_type(x, np.float32))
    for _, _, oy, ox, iy, ix in taps:
        np.maximum(y[..., oy, ox], x[..., iy, ix], out=y[..., oy, ox])
    return y


@register("AveragePool")
def average_pool(x, kernel_shape, strides=(1, 1), pads=(0, 0, 0, 0), ceil_mode: bool = False, count_include_pad: bool = False):
    """The sum of the cells within the input over their number; or, if asked, over all cells of the kernel."""
    size, taps = _pooled(x, kernel_shape, strides, pads, bool(ceil_mode))
    y, met = np.zeros((*x.shape[:2], *size), np.result_type(x, np.float32)), np.zeros(size)
    for _, _, oy, ox, iy, ix in taps:
        y[..., oy, ox] += x[..., iy, ix]
        met[oy, ox] += 1
    met = np.full_like(met, np.prod(kernel_shape)) if count_include_pad else met
    return y / np.maximum(met, 1)


# --- layout -------------------------------------------------------------------------------------------------


@register("Transpose")
def transpose(x, perm=None):
    perm = tuple(reversed(range(x.ndim))) if perm is None else tuple(perm)
    if sorted(perm) != list(range(x.ndim)):
        raise ValueError(f"{perm} is no permutation of {x.ndim} axes")
    return np.transpose(x, perm)


def reshaped(shape: tuple[int, ...], wanted) -> tuple[int, ...]:
    """The new shape: 0 copies the size of the same axis, one -1 takes what is left."""
    out = [shape[i] if n == 0 and i < len(shape) else n for i, n in enumerate(wanted)]
    count = int(np.prod(shape))
    known = int(np.prod([n for n in out if n != -1]))
    if out.count(-1) > 1 or known < 1 or any(n < -1 or n == 0 for n in out) or count % known or (-1 not in out and known != count):
        raise ValueError(f"{tuple(wanted)} does not fit {shape}")
    return tuple(count // known if n == -1 else n for n in out)


@register("Reshape")
def reshape(x, shape):
    return x.reshape(reshaped(x.shape, shape))


@register("Squeeze")
def squeeze(x, axes=None):
    """The given axes, which must be of size one; all such axes if none is given."""
    axes = [i for i, n in enumerate(x.shape) if n == 1] if axes is None or not len(axes) else axes
    axes = axes_of(axes, x.ndim)
    if any(x.shape[a] != 1 for a in axes):
        raise ValueError(f"axes {axes} of {x.shape} are not all of size one")
    return np.squeeze(x, axes)


@register("Unsqueeze")
def unsqueeze(x, axes):
    """Axes are those of the output."""
    return np.expand_dims(x, axes_of(axes, x.ndim + len(axes)))


@register("Concat")
def concat(*parts, axis: int = 0):
    (axis,) = axes_of([axis], parts[0].ndim)
    if any(p.ndim != parts[0].ndim or any(a != b for k, (a, b) in enumerate(zip(p.shape, parts[0].shape, strict=True)) if k != axis) for p in parts):
        raise ValueError("parts differ beside the axis along which they are put together")
    return np.concatenate(parts, axis)


def bounds(start: int, end: int, step: int, size: int) -> tuple[int, int]:
    """Clamped start and end; negative ones count from the end."""
    lo, hi = (max(0, min(size, b + size if b < 0 else b)) for b in (start, end))
    if step < 1 or hi <= lo:
        raise ValueError("empty slice, or a step below one")
    return lo, hi


@register("Slice")
def slice_(x, starts, ends, axes=None, steps=None):
    axes = axes_of(range(len(starts)) if axes is None else axes, x.ndim)
    cut = [slice(None)] * x.ndim
    for axis, start, end, step in zip(axes, starts, ends, steps or [1] * len(starts), strict=True):
        cut[axis] = slice(*bounds(start, end, step, x.shape[axis]), step)
    return x[tuple(cut)]


@register("Resize")
def resize_nearest(x, scales):
    """The last two axes; a cell takes the source cell below its position divided by the scale."""
    if not all(s > 0 for s in scales) or any(int(np.floor(n * s)) < 1 for n, s in zip(x.shape[-2:], scales, strict=True)):
        raise ValueError(f"scales {tuple(scales)} for {x.shape}")
    rows, cols = (np.clip(np.floor(np.arange(int(np.floor(n * s))) / s).astype(int), 0, n - 1) for n, s in zip(x.shape[-2:], scales, strict=True))
    return x[..., rows[:, None], cols[None, :]]


def rotate180(x):
    """Both of the last two axes turned round."""
    return x[..., ::-1, ::-1]


# --- from a table of arrays to a table of elements ----------------------------------------------------------


def over(vectors: DataFrame, shape: tuple[int, ...], names: str | list[str], f: Callable, value: str | list[str] = "v", key: str = "vec_id", data: str = "embedding", only: Callable | None = None) -> DataFrame:
    """(key, an int for each of names, value): the elements of f of each row's tensor of that shape. f takes and gives a
    batch of tensors along axis 0; a tuple of them where value is a list of names. only: a mask of the elements to keep. Rows without a tensor give nothing; one of
    another size is an error. Nothing is shuffled."""
    kind = vectors.schema[key].dataType.simpleString()
    count, names, several = int(np.prod(shape)), list(names), not isinstance(value, str)
    values = list(value) if several else [value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(data).is_valid())
            sizes = batch.column(data).value_lengths().to_numpy(zero_copy_only=False)
            if (sizes != count).any():
                raise ValueError(f"a tensor of {sizes[sizes != count][0]} values; {shape} has {count}")
            x = batch.column(data).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)
            step = max(1, OUT_ELEMENTS // max(count, 1))
            for lo in range(0, len(x), step):
                y = f(x[lo : lo + step])
                y = [np.asarray(own) for own in (y if several else [y])]
                at = np.nonzero(np.ones(y[0].shape, bool) if only is None else only(y[0]))
                own = batch.column(key).slice(lo, step).take(pa.array(at[0]))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(a.astype(np.int32)) for a in at[1:]), *(pa.array(v[at].astype(float)) for v in y)], [key, *names, *values])

    return vectors.select(key, data).mapInArrow(run, f"{key} {kind}, " + "".join(f"{n} int, " for n in names) + ", ".join(f"{v} double" for v in values))

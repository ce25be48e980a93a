"""NumPy kernels over UTF-8 bytes that the operators share: word splitting, rolling hashes, packing."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64

#: Bytes that end a word. SPACE: [\x20\x09-\x0D]. ALNUM: the rest of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, which
#: are digits, lower-case letters and all that is not ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
ALNUM = np.ones(256, bool)
ALNUM[0x30:0x3A] = False
ALNUM[0x61:0x7B] = False
ALNUM[0x80:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text that a kernel takes at once; its arrays need some 60 times as much. A longer text is a group of its
#: own, whose words are hashed in blocks of BLOCK bytes: it needs some 8 bytes a byte.
GROUP_BYTES = 1 << 18
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@functools.lru_cache(16)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def trim() -> None:
    """Gives freed memory back to the system: Spark keeps Python workers alive between stages, several on an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f):
    """For generators over batches that Spark runs in Python workers: no freed memory is held afterwards."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


_grown: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least. The longest so far is kept for each base."""
    if base not in _grown or len(_grown[base][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, _U)
            filled = 1
            while filled < size:
                p[filled : 2 * filled] = p[:filled] * _U(pow(b, filled, 1 << 64))
                filled *= 2
            out.append(p)
        _grown[base] = (out[0], out[1])
    return _grown[base]


def groups(texts: list, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts with about `limit` bytes, one text at least: what the kernels take at once."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class Words:
    """Words of a run of texts: byte spans in buf, and per text the range first[i]:first[i+1] of its words."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def doc_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.prefix_hashes([None])[0]

    def prefix_hashes(self, cuts: list[int | None]) -> list[np.ndarray]:
        """For each of cuts a 64-bit hash of the first bytes of each word, so many at most; of all for None."""
        out = [np.zeros(len(self.start), _U) for _ in cuts]
        for lo, hi in self._blocks():
            a, whole = self.start[lo:hi], self.end[lo:hi]
            long = whole - a > BLOCK
            base = a[0]
            n = int(np.where(long, a + max((c for c in cuts if c), default=0), whole).max() - base)
            n = min(n, len(self.buf) - int(base))
            p, q = powers(0x9E3779B97F4A7C15 | 5, n + 1)
            h = np.zeros(n + 1, _U)
            np.cumsum(_byte_values(0)[self.buf[base : base + n]] * p[:n], out=h[1:])
            for values, cut in zip(out, cuts, strict=True):
                b = np.where(long, a, whole) if cut is None else np.minimum(whole, a + cut)
                own = (h[b - base] - h[a - base]) * q[a - base]
                values[lo:hi] = mix(own + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))
                if cut is None:
                    for i in np.flatnonzero(long).tolist():
                        values[lo + i] = xxhash.xxh3_64_intdigest(self.buf[a[i] : whole[i]])
        return out

    def _blocks(self) -> Iterator[tuple[int, int]]:
        """Runs of words that begin within BLOCK bytes."""
        if len(self.start):
            cut = np.flatnonzero(np.diff(self.start // BLOCK)) + 1
            yield from zip([0, *cut.tolist()], [*cut.tolist(), len(self.start)], strict=True)


def split(texts: list[bytes | None], ends_word: np.ndarray, lower: bool = False) -> Words:
    """Words of all texts; a null text has none."""
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        buf = LOWER[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:] = ends_word[buf]
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
    start, end = turn[::2], turn[1::2]
    return Words(buf, start, end, np.searchsorted(start, offset))


def windows(values: np.ndarray, first: np.ndarray, width: int, base: int = 0xC2B2AE3D27D4EB4F | 5) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every run of `width` values that lies in one text, and the index each starts at.

    The rolling sum is taken modulo 2**64 with an odd base, whose powers have inverses, so that one
    cumulative sum gives every window.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    lengths = np.diff(first)
    whole = lengths >= width
    # starts first[i] .. first[i+1]-width are inside text i
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, first[:-1][whole], 1)
    np.add.at(step, (first[1:] - width + 1)[whole], -1)
    at = np.flatnonzero(np.cumsum(step[: n + 1]) > 0)
    out = np.zeros(len(at), _U)
    for lo in range(0, n, BLOCK):
        a, b = np.searchsorted(at, (lo, lo + BLOCK))
        own = values[lo : lo + BLOCK + width - 1]
        p, q = powers(base, len(own) + 1)
        h = np.zeros(len(own) + 1, _U)
        np.cumsum(own * p[: len(own)], out=h[1:])
        i = at[a:b] - lo
        out[a:b] = (h[i + width] - h[i]) * q[i]
    return mix(out), at


def covered(n: int, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """A mask of the n positions that a run of `width` from any of `at` covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:n]) > 0


def parity_bits(values: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """Odd sketches: for each run first[i]:first[i+1] of hashes a bitmap of 64 * words bits, in which bit b tells
    whether an odd number of values falls on b. The bits in which two sketches differ are at most as many as
    the values in just one of the runs."""
    n, size = len(first) - 1, 64 * words
    at = (values % np.uint64(size)).astype(np.int64) + np.repeat(np.arange(n), np.diff(first)) * size
    odd = (np.bincount(at, minlength=n * size) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, size), axis=1, bitorder="little").view("<u8").reshape(n, words)


def candidates(y: dict, x: dict, k: int | None, fits, block: int = 1 << 20):
    """For each row of y at most k rows of x, those with the nearest sketches first, among pairs for which
    fits(rows of y as a column, x) holds. Yields index pairs and, for each row of y, whether it had more."""
    step = max(1, block // max(1, len(x["sketch"])))
    for lo in range(0, len(y["sketch"]), step):
        own = {n: v[lo : lo + step] for n, v in y.items()}
        apart = np.zeros((len(own["sketch"]), len(x["sketch"])), np.int32)
        for w in range(own["sketch"].shape[1]):
            apart += np.bitwise_count(own["sketch"][:, w, None] ^ x["sketch"][None, :, w])
        ok = fits({n: v[:, None] for n, v in own.items() if n != "sketch"}, x, apart)
        many = ok.sum(1) > k if k is not None else np.zeros(len(ok), bool)
        if many.any():
            rank = np.where(ok[many], apart[many], 1 << 20)
            best = np.argpartition(rank, k - 1, axis=1)[:, :k]
            few = np.zeros_like(rank, bool)
            np.put_along_axis(few, best, True, 1)
            ok[many] &= few
        rows, cols = np.nonzero(ok)
        yield rows + lo, cols, many[rows]

"""Text and checksum functions that Spark lacks, in Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of the 64-bit FNV hash.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
#: Bytes from which a blob is hashed by itself: many short ones are hashed together, side by side.
LONG_BLOB = 4096


def fnv1a(data: bytes, blank: tuple[int, int] | None = None) -> int:
    """blank: a range of bytes that counts as zero."""
    if blank:
        data = data[: blank[0]] + bytes(min(len(data), blank[1]) - min(len(data), blank[0])) + data[blank[1] :]
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_columns(blobs: list[bytes | None]) -> list[int | None]:
    """The same for many: byte by byte over all of them at once, longest first."""
    out: list[int | None] = [fnv1a(b) if b is not None and len(b) > LONG_BLOB else None for b in blobs]
    order = sorted((i for i, b in enumerate(blobs) if b is not None and len(b) <= LONG_BLOB), key=lambda i: -len(blobs[i]))
    if order:
        sizes = np.array([len(blobs[i]) for i in order])
        padded = np.zeros((len(order), int(sizes[0])), np.uint64)
        for k, i in enumerate(order):
            padded[k, : sizes[k]] = np.frombuffer(blobs[i], np.uint8)
        h = np.full(len(order), FNV_OFFSET, np.uint64)
        for at in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -at, "left"))  # those that have this byte
            h[:n] = (h[:n] ^ padded[:n, at]) * np.uint64(FNV_PRIME)
        for k, i in enumerate(order):
            out[i] = int(h[k])
    return out


def bit_checksum(values: Column) -> Column:
    """The 64-bit FNV-1a of the bits of 32-bit floats, each taken as one number, as 16 hexadecimal digits."""

    @F.pandas_udf("string")
    def hashed(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            h = FNV_OFFSET
            x = np.asarray(() if v is None else v, "<f4")
            for bits in np.where(np.isnan(x), np.uint32(0x7FC00000), x.view("<u4")).tolist():  # one pattern for all that are no number
                h = (h ^ bits) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
            out.append(None if v is None else f"{h:016x}")
        return pd.Series(out, dtype=object)

    return hashed(values)


def nfc(text: Column) -> Column:
    """Line ends as \\n, then canonical composition; null stays null."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return composed(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def checksum(data: Column) -> Column:
    """The 64-bit FNV-1a of bytes, as 16 hexadecimal digits."""

    @F.pandas_udf("string")
    def hashed(s: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else f"{h:016x}" for h in fnv1a_columns(s.tolist())], dtype=object)

    return hashed(data.cast("binary"))


def floats(data: Column) -> Column:
    """Little-endian 32-bit floats of raw bytes; a rest of fewer than four bytes is an error."""

    @F.pandas_udf("array<float>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return read(data)

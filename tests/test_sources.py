"""Formats around the engine, on small files."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.sources import files


def test_predictions_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", ["x", None]), ("b.jpg", [])], "file string, lines array<string>")
    files.write_predictions(rows, str(tmp_path / "p"))
    got = files.predictions(spark, str(tmp_path / "p"), "file string, lines array<string>")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("second", ['{"file": "a"}', "no json", "{}"])
def test_bad_predictions_are_errors(spark, tmp_path, second):
    (tmp_path / "p.jsonl").write_text('{"file": "a"}\n\n' + second + "\n")
    with pytest.raises(Exception):  # noqa: B017
        files.predictions(spark, str(tmp_path / "p.jsonl"), "file string").collect()


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes("﻿a\r\n\r\n字\n".encode())
    got = [tuple(r) for r in files.dictionary(spark, str(tmp_path / "d.txt")).orderBy("class").collect()]
    assert got == [(0, ""), (1, "a"), (2, ""), (3, "字"), (4, " ")]
    (tmp_path / "e.txt").write_text(" \n\n")
    with pytest.raises(Exception):  # noqa: B017
        files.dictionary(spark, str(tmp_path / "e.txt")).collect()


def test_last_json(spark):
    logs = spark.createDataFrame([("l", 0, '{"ms": 1}'), ("l", 1, "noise"), ("l", 2, ' {"ms": 2}'), ("l", 3, "{broken")], "path string, n int, value string")
    assert [tuple(r) for r in files.last_json(logs, "ms int").collect()] == [("l", 2)]


def test_manifest(spark):
    have = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"3"))], "path string, content binary")
    want = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest().upper()), ("b", "0" * 64), ("d", "0" * 64)], "path string, sha256 string")
    assert sorted(map(tuple, files.is_listed(have, want).collect())) == [("b", "changed"), ("c", "extra"), ("d", "missing")]


def test_text_and_bytes(spark):
    df = spark.createDataFrame([(bytearray(struct.pack("<2f", 1.5, -2)), "é\r\n"), (None, None)], "b binary, t string")
    got = df.select(text.floats(F.col("b")).alias("f"), text.nfc(F.col("t")).alias("t"), text.checksum(F.col("t")).alias("c")).collect()
    assert got[0].f == [1.5, -2] and got[0].t == "é\n" and got[1].f is None and got[1].t is None and got[1].c is None
    assert text.fnv1a(b"") == text.FNV_OFFSET and text.fnv1a(b"a") == 0xAF63DC4C8601EC8C

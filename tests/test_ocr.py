"""Pictures to text with small made-up models, and detection, inputs, crops and orders on hand-made values."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import ocr
from foliant.operators import detection, evaluation, images, rectangles
from foliant.sources import files
from tests.test_models import node, onnx


def png(pixels: np.ndarray) -> bytes:
    """Red, green, blue rows as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = pixels.shape[:2]
    rows = b"".join(b"\0" + r.tobytes() for r in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def made_up():
    """A detector that sees what is bright, a classifier that calls bright lines upright, and a recogniser whose class is
    how bright each of a line's columns is, in four steps."""
    det = onnx([node("Conv", ["x", "w"], "c", kernel_shape=[1, 1]), node("Sigmoid", ["c"], "y")], {"w": np.full((1, 3, 1, 1), 2.0, np.float32)})
    cls = onnx(
        [node("GlobalAveragePool", ["x"], "g"), node("Reshape", ["g", "flat"], "r"), node("MatMul", ["r", "w"], "m"), node("Add", ["m", "b"], "z"), node("Softmax", ["z"], "y", axis=-1)],
        {"flat": np.array([1, 3]), "w": np.array([[5, -5]] * 3, np.float32), "b": np.array([14, -14], np.float32)}, out=(1, 2),
    )
    rec = onnx(
        [
            node("AveragePool", ["x"], "p", kernel_shape=[48, 48], strides=[48, 48]), node("Squeeze", ["p"], "q", axes=[2]), node("Transpose", ["q"], "t", perm=[0, 2, 1]),
            node("MatMul", ["t", "w"], "z"), node("Softmax", ["z"], "y", axis=2),
        ],
        {"w": np.array([[-9, 0, 0, 9]] * 3, np.float32)}, shape=(1, 3, 48, -1), out=(1, -1, 4), opset=11,
    )
    return det, rec, cls


def page(*spots):
    out = np.zeros((96, 256, 3), np.uint8)
    for x0, y0, x1, y1 in spots:
        out[y0:y1, x0:x1] = 255
    return out


def test_pictures_to_text(spark, tmp_path):
    det, rec, cls = made_up()
    for name, raw in (("d", det), ("r", rec), ("c", cls)):
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "labels").write_bytes("﻿a\r\nb\r\n".encode())
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "two.png").write_bytes(png(page((160, 20, 224, 44), (16, 24, 112, 48))))
    (folder / "none.png").write_bytes(png(page()))
    (folder / "broken.png").write_bytes(b"no picture")
    (folder / "other.txt").write_bytes(b"text")
    assert [r.name for r in files.picture_files(spark, str(folder)).collect()] == ["broken.png", "none.png", "two.png"]
    assert [r.name for r in files.picture_files(spark, str(folder), 1, 1).collect()] == ["none.png"]
    engine = ocr.Ocr.load(spark, str(tmp_path / "d"), str(tmp_path / "r"), str(tmp_path / "labels"), str(tmp_path / "c"))
    assert engine.classes == ["", "a", "b", " "]
    pictures = files.pictures(spark, str(folder))
    assert {r.image: (r.height, r.width) for r in pictures.collect()} == {"two.png": (96, 256), "none.png": (96, 256)}
    lines = engine.recognise(pictures).orderBy("k").collect()
    assert [(r.image, r.k, r.cls, r.rotated, r.text) for r in lines] == [("two.png", 0, 0, False, " "), ("two.png", 1, 0, False, " ")]
    assert lines[0].box[0] < 16 < lines[0].box[2] < 140 < lines[1].box[0] and all(0 < r.score <= 1 and r.det > 0.6 for r in lines)
    plain = ocr.Ocr(spark, det, rec, engine.classes, options=ocr.Options(order="vertical_rtl")).recognise(pictures)
    assert [(r.box_id, r.cls, r.rotated) for r in plain.orderBy("k").collect()] == [(lines[1].box_id, None, False), (lines[0].box_id, None, False)]
    assert [(r.image, r.text) for r in engine.pages(engine.recognise(pictures)).collect()] == [("two.png", " \n ")]
    records = ocr.prediction_records(plain)
    files.write_predictions(records, str(tmp_path / "out"), digits=9)
    shape = "file string, lines array<struct<text:string,rec:double,det:double,cls:int,cls_score:double,rotate:boolean,box:array<double>>>"
    back = files.predictions(spark, str(tmp_path / "out"), shape).collect()
    assert len(back) == 1 and [x.cls for x in back[0].lines] == [-1, -1]
    assert ocr.resorted(plain, ["box_id"]).where("k <> box_id").isEmpty()
    with pytest.raises(Exception):  # noqa: B017
        ocr.Ocr(spark, det, rec, ["", " "]).recognise(pictures).collect()


def test_decoding():
    p = np.zeros((6, 4))
    for t, (c, v) in enumerate([(0, 0.9), (1, 0.9), (1, 0.8), (0, 0.7), (2, 0.8), (3, 0.7)]):
        p[t, c] = v
    ids, score = ocr.decode(p)
    assert ids == [1, 2, 3] and abs(score - 0.8) < 1e-9
    assert ocr.decode(np.eye(3)[[0, 0]]) == ([], 0.0)
    with pytest.raises(ValueError):
        ocr.decode(np.full((1, 2), np.nan))
    assert [ocr.width_bucket(w, 48) for w in (100, 300, 700)] == [192, 320, 960] and ocr.width_bucket(700, 48, 320) == 320


def area(h, w, x0, x1, y0, y1):
    out = np.zeros((h, w))
    out[y0 : y1 + 1, x0 : x1 + 1] = 0.9
    return out


def test_boxes_of_maps():
    # fixed values: a map's expected corners
    (corners, score), = rectangles.boxes_of(area(10, 10, 1, 8, 1, 8), rectangles.BoxOptions(0.5, 0.7, 0.0), (1.5, 1.5))
    assert corners.ravel().astype(int).tolist() == [0, 0, 5, 0, 5, 5, 0, 5] and abs(score - 0.9) < 1e-9
    (corners, _), = rectangles.boxes_of(area(12, 12, 2, 9, 2, 9), rectangles.BoxOptions(unclip=2.0))
    assert corners.ravel().tolist() == [0, 0, 11, 0, 11, 11, 0, 11]
    assert rectangles.boxes_of(area(20, 20, 2, 12, 4, 6)) == [] and rectangles.boxes_of(area(20, 20, 2, 12, 4, 7)) != []  # sides of 2 and of 3
    two = area(10, 16, 1, 5, 1, 7) + area(10, 16, 7, 11, 1, 7)
    assert len(rectangles.boxes_of(two)) == 2 and len(rectangles.boxes_of(two, rectangles.BoxOptions(dilate=True))) == 1
    with pytest.raises(rectangles.ResourceLimit):
        rectangles.boxes_of(two, rectangles.BoxOptions(candidates=1))
    assert rectangles.boxes_of(area(20, 20, 2, 12, 4, 12), rectangles.BoxOptions(score=0.91)) == []
    assert rectangles.boxes_of(area(20, 20, 2, 12, 4, 12) * 0.3 / 0.9, rectangles.BoxOptions(score=0.0)) == []  # 0.3 is not above 0.3


def test_rotated_rectangles():
    turn = np.deg2rad(30)
    u = np.array([np.cos(turn), np.sin(turn)])
    y, x = np.mgrid[0:60, 0:60]
    along, across = (x - 30) * u[0] + (y - 30) * u[1], (y - 30) * u[0] - (x - 30) * u[1]
    probabilities = ((np.abs(along) <= 20) & (np.abs(across) <= 6)).astype(float)
    (corners, score), = rectangles.boxes_of(probabilities, rectangles.BoxOptions(unclip=0.0))
    sides = sorted(np.hypot(*(corners[k] - corners[k - 1])) for k in range(4))
    assert 38 < sides[3] < 41 and 10 < sides[0] < 13 and score > 0.9
    square = rectangles.smallest(rectangles.hull([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)]))
    assert sorted(map(tuple, np.round(square.corners(1), 6).tolist())) == [(-1, -1), (-1, 5), (5, -1), (5, 5)]
    assert rectangles.smallest(rectangles.hull([(0, 0), (1, 1), (2, 2)])) is None


def test_labels_of_large_components():
    r = np.random.default_rng(3)
    mask = r.random((3, 40, 50)) < 0.45
    mask[2] = np.indices((40, 50)).sum(0) % 2 == 0
    got = detection.labels(mask)
    for k in range(3):
        seen = {}
        for y, x in zip(*np.nonzero(mask[k]), strict=True):
            if (y, x) not in seen:
                queue, seen[y, x] = [(y, x)], y * 50 + x
                while queue:
                    b, a = queue.pop()
                    for d in ((b + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if 0 <= d[0] < 40 and 0 <= d[1] < 50 and mask[k][d] and d not in seen:
                            seen[d] = y * 50 + x
                            queue.append(d)
        assert all(got[k][p] == v for p, v in seen.items()) and (got[k][~mask[k]] == -1).all()


def test_candidates_beyond_the_limit_are_an_error(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page int, box string")
    assert rectangles.within(rows, "page", 2).count() == 3
    with pytest.raises(Exception, match="more than 1"):
        rectangles.within(rows, "page", 1).collect()


def test_inputs_and_crops():
    r = np.random.default_rng(0)
    image = r.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert np.allclose(images.resized(image, 5, 7), image)
    assert images.recogniser_input(image, 192).shape == (3, 48, 192) and np.allclose(images.recogniser_input(image, 192)[:, :, 68:], images.REC_PADDING)
    assert (images.classifier_input(image)[:, :, 112:] == -1).all() and images.classifier_input(np.zeros((2, 40, 3), np.uint8)).shape == (3, 80, 160)
    assert images.detector_size(500, 500, 960) == (512, 512) and images.detector_size(2000, 10, 960) == (960, 32)
    assert (images.crop(image, [0, 0, 7, 0, 7, 5, 0, 5]) == image).all()
    tall = images.crop(image, [1, 0, 3, 0, 3, 5, 1, 5])  # 2 by 5: turned, its left side on top
    assert tall.shape == (2, 5, 3) and (tall == np.rot90(image[:, 1:3], -1)).all()
    for quad in ([0, 0, 0.5, 0, 0.5, 5, 0, 5], [0, 0, np.nan, 0, 5, 5, 0, 5]):
        with pytest.raises(ValueError):
            images.crop(image, quad)


def test_orders_of_boxes(spark):
    # fixed values: positions in reading order
    columns = [(0, 20, 8, 28), (30, 10, 38, 18), (0, 40, 8, 48), (30, 30, 38, 38)]
    assert images.in_columns(columns) == [0, 2, 1, 3] and images.in_columns(columns, right_to_left=True) == [1, 3, 0, 2]
    assert images.in_rows([0, 2, 30], [20, 1, 0]) == [1, 0, 2]
    wide = [(0, 0, 10, 5), (4, 10, 14, 15), (9, 20, 19, 25)]  # each overlaps the one before it by 0.6 and 0.36 of the spans
    assert images.in_columns(wide) == [0, 1, 2]
    got = images.columns_in_order(spark.createDataFrame([("p", k, *map(float, b)) for k, b in enumerate(columns)], "page string, idx int, x0 double, y0 double, x1 double, y1 double"), True)
    assert [r.idx for r in got.orderBy("k").collect()] == [1, 3, 0, 2]


def test_differences_between_runs(spark):
    box = [float(k) for k in range(8)]
    shape = f"file string, lines array<{evaluation.LINE}>"
    line = ("abc", None, None, box)
    a = spark.createDataFrame([("a", [line, line]), ("b", [line]), ("c", [line]), ("e", [])], shape)
    b = spark.createDataFrame([("a", [("abd", -1, False, [2.0, *box[1:]]), line]), ("b", [line, line]), ("d", [line]), ("e", [])], shape)
    r = evaluation.difference(a, b, 1.0).head()
    assert (r.text_mismatches, r.cls_mismatches, r.rotate_mismatches, r.box_mismatches, r.line_count_mismatches, r.max_box_delta, r.missing_files, r.extra_files, r.agrees) == (1, 0, 0, 1, 1, 2.0, 1, 1, False)
    assert evaluation.difference(a, a).head().agrees
    bad = spark.createDataFrame([("a", [("abc", None, None, box[:7])])], shape)
    with pytest.raises(Exception, match="eight finite"):
        evaluation.line_differences(bad, bad).collect()


def test_required_and_gates(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 2)], "file string, n int")
    found = spark.createDataFrame([("a", 0.5)], "file string, ms double")
    assert evaluation.required(truth.where("n = 1"), found).collect()[0].ms == 0.5
    with pytest.raises(Exception, match="missing: b"):
        evaluation.required(truth, found).collect()
    metrics = spark.createDataFrame([("a", 5.0), ("b", None), ("c", float("nan")), ("d", 1.0)], "metric string, v double")
    gates = spark.createDataFrame([("a", "<=", 5.0), ("a", "<", 5.0), ("b", ">=", 0.0), ("c", "<", 9.0), ("d", ">", 0.0)], "metric string, rule string, lim double")
    assert sorted((r.metric, r.rule) for r in evaluation.violations(metrics, gates).collect()) == [("a", "<"), ("b", ">="), ("c", "<")]
    big = spark.range(1).select(evaluation.rounded_mean(F.lit(2**60 + 1), F.lit(2)).alias("m"), evaluation.rounded_mean(F.lit(5), F.lit(0)).alias("none"))
    assert tuple(big.head()) == (2**59 + 1, None)


def test_block_winners(spark):
    shape = "shape string, block int, median double, checksum int, bytes double"
    rows = spark.createDataFrame([("s", 4, 1.0, 7, 10.0), ("s", 8, 0.5, 7, 99.0), ("s", 12, 1.5, 7, 0.0), ("t", 4, 1.0, 1, 0.0)], shape)
    assert [tuple(r) for r in evaluation.block_winners(rows, ["shape"], 12).collect()] == [("s", 4, 1.0, True)]
    with pytest.raises(Exception, match="checksums"):
        evaluation.block_winners(rows.withColumn("checksum", F.col("block")), ["shape"], 12).collect()


def test_files_around_the_engine(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"images": [\n{"file": "a.jpg", "lines": [{"bbox": [0, 1, 2, 3], "text": "x"}, {"bbox": [4, 5, 6, 7], "text": "y"}]}, {"file": "b.jpg", "lines": []}]}')
    assert [tuple(r) for r in files.ground_truth(spark, str(tmp_path / "m.json")).orderBy("gt").collect()] == [("a.jpg", 0, [0, 1, 2, 3], "x"), ("a.jpg", 1, [4, 5, 6, 7], "y")]
    (tmp_path / "s.tsv").write_text("line0\t192\t5a2X\t0.5\t1\t0.95\ttrue\n")
    assert tuple(files.stage_inputs(spark, str(tmp_path / "s.tsv")).head()) == ("line0", 192, "字", 0.5, 1, 0.95, True)
    rows = spark.createDataFrame([("sub/a.f32", [1.5, -2.0]), ("b.f32", [])], "name string, values array<float>")
    files.write_raw_floats(rows, str(tmp_path / "f"))
    assert [r.values for r in files.raw_floats(spark, str(tmp_path / "f" / "sub")).collect()] == [[1.5, -2.0]]
    assert (tmp_path / "f" / "b.f32").read_bytes() == b""
    report = spark.createDataFrame([("b", 1.5, None), ("a|c", 2.0, 3)], "name string, ms double, n int")
    assert files.markdown(report, "Title").head().value.split("\n")[2:] == ["| name | ms | n |", "| --- | --- | --- |", "| a\\|c | 2.000 | 3 |", "| b | 1.500 | n/a |"]
    files.write_report(report, str(tmp_path / "r"), "Title")
    assert spark.read.json(str(tmp_path / "r" / "json")).count() == 2
    (tmp_path / "p.jsonl").write_text('{"file": "a", "lines": 3}\n')
    with pytest.raises(Exception, match="no list"):
        files.predictions(spark, str(tmp_path / "p.jsonl"), "file string").collect()


def test_command_lines(spark, tmp_path, capsys):
    from foliant.__main__ import main

    (tmp_path / "t.json").write_text('{"images": [{"file": "a", "lines": [{"bbox": [0, 0, 10, 10], "text": "abc"}, {"bbox": [50, 50, 60, 60], "text": "x"}]}]}')
    line = '{"text": "%s", "rec": 0.5, "det": 0.9, "cls": -1, "cls_score": 0.0, "rotate": false, "box": [0, 0, 10, 0, 10, 10, 0, 10]}'
    for name, text in (("p", "abd"), ("q", "abc")):
        (tmp_path / f"{name}.jsonl").write_text('{"file": "a", "elapsed_ms": 4.0, "lines": [' + line % text + "]}\n")
    assert main(["evaluate", str(tmp_path / "t.json"), str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "o")]) == 0
    out = capsys.readouterr().out
    assert '"matched_lines": 1' in out and '"missing_lines": 1' in out and '"recall": 0.5' in out and '"edit_distance": 1' in out and '"elapsed_ms": 4.0' in out
    assert main(["diff", str(tmp_path / "p.jsonl"), str(tmp_path / "q.jsonl")]) == 1 and '"text_mismatches": 1' in capsys.readouterr().out
    assert main(["diff", str(tmp_path / "p.jsonl"), str(tmp_path / "p.jsonl")]) == 0
    (tmp_path / "m").write_bytes(made_up()[0])
    assert main(["container", str(tmp_path / "m"), str(tmp_path / "m2")]) == 0
    capsys.readouterr()
    for name in ("m", "m2"):
        assert main(["model", str(tmp_path / name), "--shape", "1", "3", "32", "64"]) == 0
        assert "Conv" in (shown := capsys.readouterr().out) and '"nodes": 2' in shown and '"live_bytes": 16384' in shown

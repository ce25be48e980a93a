"""Reading order of many pages at once, against one box after another."""

import itertools
import random

import pytest

from foliant.operators import images

SHAPE = "page string, idx int, x0 double, y0 double, x1 double, y1 double"


def plain_columns(boxes, right_to_left):
    """Places of boxes (x0, y0, x1, y1)."""
    columns, own = [], {}
    for k in sorted(range(len(boxes)), key=lambda k: (boxes[k][0] + boxes[k][2], k)):
        x0, _, x1, _ = boxes[k]
        best, most = len(columns), 0.0
        for i, (left, right, width) in enumerate(columns):
            share = max(0.0, min(x1, right) - max(x0, left)) / max(x1 - x0, width, 1e-9)
            if share >= images.COLUMN_OVERLAP and share > most:
                best, most = i, share
        left, right, width = columns[best] if most else (x0, x1, 0.0)
        columns[best:best + 1] = [(min(left, x0), max(right, x1), max(width, x1 - x0))]
        own[k] = best
    return sorted(own, key=lambda k: (-own[k] if right_to_left else own[k], boxes[k][1], boxes[k][1] + boxes[k][3], k))


@pytest.fixture(scope="module")
def pages():
    """Pages of 1 to 30 boxes and one of 700, some of the same idx, one page without a name."""
    r = random.Random(3)
    out = {}
    for p in range(400):
        page = []
        for _ in range(700 if p == 200 else r.randint(1, r.choice([2, 8, 30]))):
            x, y = r.randrange(0, 100), r.randrange(0, 100)
            page.append((r.randrange(0, 40), float(x), float(y), float(x + r.randrange(0, 50)), float(y + r.randrange(1, 20))))
        out[f"p{p}" if p else None] = sorted(page)
    return out


@pytest.fixture
def boxes(spark, pages, monkeypatch):
    """The pages' boxes in no order; chunks end within pages."""
    monkeypatch.setattr(images, "PAGE_ROWS", 100, raising=False)
    rows = [(p, *b) for p, page in pages.items() for b in page]
    random.Random(4).shuffle(rows)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield spark.createDataFrame(rows, SHAPE).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def places(df):
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()  # no call for each page
    return sorted(df.collect(), key=lambda r: (r.page or "", r.k))


def plain_rows(boxes):
    """Places of boxes (x0, y0, x1, y1), each put in from the end."""
    out = []
    for i, (x, y, _, _) in enumerate(boxes):
        at = len(out)
        while at:
            left, top = boxes[out[at - 1]][:2]
            if x >= left if abs(y - top) < images.ROW_TOLERANCE else y >= top:
                break
            at -= 1
        out.insert(at, i)
    return out


def test_rows_of_many_pages(boxes, pages):
    by_top = {p: sorted(page, key=lambda b: (b[0], b[2], b[1])) for p, page in pages.items()}
    want = [(p, page[i][0], k) for p, page in sorted(by_top.items(), key=lambda x: x[0] or "") for k, i in enumerate(plain_rows([b[1:] for b in page]))]
    assert places(images.lines_in_order(boxes)) == want


def test_rows_of_boxes_of_one_idx_do_not_depend_on_their_order(spark):
    rows = [("p", 0, 17.0, 11.0), ("p", 0, 17.0, 17.0), ("p", 1, 16.0, 21.0)]  # the last is near the second only
    got = {tuple(places(images.lines_in_order(spark.createDataFrame(p, "page string, idx int, x0 double, y0 double").selectExpr("*", "x0 + 5 AS x1", "y0 + 5 AS y1").coalesce(1)))) for p in itertools.permutations(rows)}
    assert len(got) == 1


def test_rows_of_a_page_without_numbers():
    assert images.in_rows([0, float("nan"), 5], [3, 1, 1]) == plain_rows([(3, 0, 0, 0), (1, float("nan"), 0, 0), (1, 5, 0, 0)])
    assert images.in_rows([], []) == []


@pytest.mark.parametrize("right_to_left", [False, True])
def test_columns_of_many_pages(boxes, pages, right_to_left):
    want = [(p, page[i][0], k) for p, page in sorted(pages.items(), key=lambda x: x[0] or "") for k, i in enumerate(plain_columns([b[1:] for b in page], right_to_left))]
    assert places(images.columns_in_order(boxes, right_to_left)) == want


def test_columns_of_no_pages(spark):
    assert images.columns_in_order(spark.createDataFrame([], SHAPE)).collect() == []

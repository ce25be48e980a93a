"""Hilbert order over strings with a common beginning, and urls with very many copies."""

from collections import Counter

import pytest

from foliant.llm import hilbert, url_filter


@pytest.mark.parametrize("distinct", [100_000, 10])
def test_strings_are_quantised_by_rank_whatever_they_begin_with(spark, distinct, monkeypatch):
    monkeypatch.setattr(hilbert, "DISTINCT_ROWS", distinct)
    rows = [(i, "t", f"https://common.beginning/of/all/{i:05d}") for i in range(2000)] + [(9000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = hilbert.shard(docs, shards=20, dims=("source",)).collect()
    place = {r.doc_id: (r.shard, r.slot) for r in got}
    shards = [place[i][0] for i in range(2000)]
    assert place[9000][0] == 0 and max(shards) == 19
    by_shard = [[i for i in range(2000) if shards[i] == k] for k in range(20)]
    assert all(max(own) - min(own) < 130 for own in by_shard)  # a shard's strings are neighbours


def test_extra_columns_and_very_long_values(spark):
    rows = [(1, "x" * 3_000_000, "en", "s" * 100_000, 7, 1), (2, None, None, None, 8, 2), (2, None, None, None, 8, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, curve int, _d0 int")
    got = hilbert.shard(docs, shards=3).collect()
    assert Counter((r.shard, r.slot) for r in got) == {(0, 0): 1, (1, 0): 1, (2, 0): 1}
    assert sorted(r.size for r in got) == [16, 16, 3_000_016]


def test_copies_of_a_url_are_written_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "COPIES", 10)
    long = "http://a.com/fr/" + "x" * 200_000
    rows = [(1, "http://a.com/de/x", "r", 1)] * 47 + [(2, long, "r", 1), (None, None, "r", 1), (None, None, "r", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, n int")
    got = Counter((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, ranges=4).collect())
    assert got == {(1, "com/de/", "block"): 47, (2, "com/fr/", "allow"): 1, (None, None, "allow"): 2}


def test_ties_of_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = (("allow", "b", "/c"), ("block", "a.b", "/"))  # three and four characters
    assert url_filter.judge(pages, rules).head().rule == "a.b/"
    rules = (("allow", "b", "/c"), ("block", "a.b", ""))
    assert url_filter.judge(pages, rules).head().rule == "a.b"

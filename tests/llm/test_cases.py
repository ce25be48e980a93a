"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with the operators' own names, for every
operator and every stage of the pipeline."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import decontaminate, hilbert, line_dedup, near_dedup, nearest, pieces, queries, substring_dedup, surrogates, toxicity, url_filter

SF = "/root/testdata/sf0.001"
#: Names that operators use inside or add.
NAMES = (
    "_id _row _gone _n_lines _shared _hit _items _several _key _mentions _gaps _found _known _text _d0 _p _before _lo p_low_quality n_entities ids n_ids round_trip decoded "
    "node doc row line lines page docs band class words features size curve law shard slot key mask items k n best verdict rule host path url bucket cell blob part block counts "
    "sketch shingles parity component component_id kept n_shingles least text_crc32 grown_shard at hits hashes n_words n_removed kept_sha256 contaminated toxic quality x_doc more equal"
).split()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    some = [f"w{r.randrange(5000)}" for _ in range(60)]
    long = " ".join(f"w{r.randrange(400_000)}" + ("\n" if r.random() < 0.1 else "") for _ in range(700_000)) + " Mr Longley bob@mail.org"  # 5 MB
    texts = [(1, " ".join(some)), (1, " ".join(some)), (1, "another text of the same id"), (None, "no id " * 30), (None, "no id " * 30), (None, None), (2, None), (3, ""), (4, " \t\n"), (5, long), (6, " ".join(some[:58]) + " x y"), (7, "x" * 300_000), (8, "汉字" * 40_000), (-5, "é́\0 \U0001f600")]
    return texts


@pytest.fixture(scope="module")
def docs(spark, rows):
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    return plain.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(3).cast("long").alias("n_chars"), *[F.lit(f"own {n}").alias(n) for n in NAMES]).cache()


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "no id no id no id no id no id"), (2, None), (None, "another text"), (3, ""), (1, "same")], "item_id long, text string")


WHOLE = {
    "op1": lambda s, d: toxicity.accepted(d, labels(s)), "op2": lambda s, d: decontaminate.clean(d, bench(s)), "op2 in slices": lambda s, d: decontaminate.clean(d, bench(s), slice_bytes=8),
    "op2 documents": lambda s, d: decontaminate.clean(d, bench(s), remove="documents"), "op5": lambda s, d: line_dedup.deduplicated(d), "op10": lambda s, d: near_dedup.deduplicated(d),
    "op6": lambda s, d: surrogates.replaced(d, "k"), "op8": lambda s, d: pieces.with_ids(d), "op1 scored": lambda s, d: toxicity.scored(d, toxicity.fit(d, toxicity.chained_labels(labels(s)), toxicity.NAMES)),
}
NEW = {"op6": {"n_entities"}, "op8": {"ids", "n_ids", "round_trip"}, "op1 scored": {"p_low_quality", "p_toxic"}}


@pytest.mark.parametrize("name", WHOLE)
def test_rows_and_other_columns_stay(spark, docs, rows, name):
    out = WHOLE[name](spark, docs)
    new = NEW.get(name, set())
    assert [c for c in out.columns if c not in new] == [c for c in docs.columns if c not in new] and new <= set(out.columns)
    own = [n for n in NAMES if n not in new]
    bad = out.where(~F.concat_ws("|", *own).eqNullSafe(F.lit("|".join(f"own {n}" for n in own))))
    assert bad.isEmpty()
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    every = Counter(i for i, _ in rows)
    assert not got - every
    if name in ("op2", "op2 in slices", "op5", "op6", "op8", "op1 scored"):
        assert got == every
    if name == "op6":
        long = out.where("doc_id = 5").head()
        assert long.n_entities == 2 and "Longley" not in long.text and "bob@" not in long.text
    if name == "op8":
        assert out.where("NOT round_trip AND text IS NOT NULL").isEmpty() and out.where("text IS NULL AND ids IS NOT NULL").isEmpty()
    if name == "op2":
        assert {r.text for r in out.where("doc_id = 1").collect()} == {rows[0][1], " of the  id"}


DIGESTS = {
    "op3": lambda d: substring_dedup.remove_repeats(d), "op5 report": lambda d: line_dedup.report(d), "op7": lambda d: hilbert.shard(d, shards=3), "op10 labelled": lambda d: near_dedup.labelled(d),
}


@pytest.mark.parametrize("name", DIGESTS)
def test_every_row_has_its_digest(docs, rows, name):
    got = DIGESTS[name](docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    if name == "op3":  # of two equal rows one loses its words, whichever
        assert Counter((r.n_words, r.n_removed) for r in got if r.doc_id == 1) == {(60, 0): 1, (60, 60): 1, (6, 0): 1}
        assert Counter((r.n_words, r.n_removed) for r in got if r.doc_id is None) == {(60, 58): 1, (60, 60): 1, (0, 0): 1}
    if name == "op10 labelled":
        own = {(r.doc_id, r.component_id, r.kept) for r in got}
        assert (6, 1, False) in own and (1, 1, True) in own and (None, None, True) in own


def test_nulls_ties_and_repeats_of_the_others(spark):
    pages = spark.createDataFrame([(None, None, "h"), (1, "http://a.com/fr/", None), (1, "http://a.com/fr/", None)], "page_id long, url string, html string").select("*", *[F.lit("own").alias(n) for n in NAMES if n != "url"])
    assert Counter((r.page_id, r.rule) for r in url_filter.judge(pages).collect()) == {(None, None): 1, (1, "com/fr/"): 2}
    v = [1.0, 2.0]
    vectors = spark.createDataFrame([(0, v, None), (0, v, 1), (20, v, 1), (21, v, 1), (None, v, 1), (40, None, 1)], "vec_id long, embedding array<float>, label int").select("*", *[F.lit("own").alias(n) for n in NAMES])
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 5.0), (0, 2, 21, 5.0), (20, 1, 0, 5.0), (20, 2, 0, 5.0), (20, 3, 21, 5.0)]
    wide = spark.createDataFrame([(i, [float((i * k) % 7 - 3) for k in range(3000)]) for i in range(41)], "vec_id long, embedding array<float>")
    assert nearest.nearest(wide, F.col("vec_id") % 20 == 0).count() == 60


def test_stages_on_an_empty_table_and_on_odd_rows(spark, tmp_path, docs, rows):
    sf = str(tmp_path)
    labels(spark).write.parquet(f"{sf}/labels.parquet")
    bench(spark).write.parquet(f"{sf}/benchmark.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (plain.limit(0), plain):
        now = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = now
            now = stage(spark, now, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == plain.columns, name
                now.write.mode("overwrite").parquet(f"{sf}/{name}-{start is plain}")
                now = spark.read.schema(before.schema).parquet(f"{sf}/{name}-{start is plain}")
            assert now.count() <= before.count(), name
    assert now.where("NOT round_trip AND text IS NOT NULL").isEmpty()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_read_whole_tables(spark, name):
    table, column = {"op4_url_filters": ("pages", "page_id"), "op9_nearest_neighbours": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    out = queries.QUERIES[name](spark, SF)
    want = spark.read.parquet(f"{SF}/{table}.parquet")
    if name.startswith("op9"):
        assert out.count() == 20 * want.where("vec_id % 20 = 0").count()
    else:
        assert out.select(column).exceptAll(want.select(column)).isEmpty() and out.count() == want.count()

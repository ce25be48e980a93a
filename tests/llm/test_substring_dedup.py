"""Parts and pages of any size give the same answer, also where rows share a doc_id; bounds follow bytes."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import substring_dedup

SHAPE = "doc_id long, text string"


def brute(rows):
    """Sorted digests of (doc_id, text) rows that come in this order."""
    seen, out = set(), []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 19):
            if (g := tuple(w[k : k + 20])) in seen:
                gone.update(range(k, k + 20))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("pages", "page_bytes", "buckets"), [(None, 2 << 20, None), (9, 700, 16), (1, 300, 64), (40, 100, 8)])
def test_any_cut_gives_the_same(spark, pages, page_bytes, buckets):
    r = random.Random(pages or 0)
    base = [[f"w{r.randrange(50)}" for _ in range(90)] for _ in range(5)]
    rows = [(None if k % 13 == 0 else 7 if k % 5 == 0 else k * 1_000_003 % 97, " ".join((own := r.choice(base))[r.randrange(30) :] + r.choice(base)[: r.randrange(60)])) for k in range(80)]
    rows += rows[:6] + [(3, None), (3, ""), (-(2**62), " ".join(base[0])), (2**62, " ".join(base[0]))]
    docs = spark.createDataFrame(rows, SHAPE).repartition(6)
    # rows of one doc_id come in the order of a hash of their text
    order = {(x.doc_id, x.text): x.h for x in docs.withColumn("h", F.xxhash64("text")).collect()}
    want = brute(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, order[x])))
    got = substring_dedup.remove_repeats(docs, pages=pages, page_bytes=page_bytes, buckets=buckets)
    assert Counter(tuple(x) for x in got.collect()) == want


def test_bounds_follow_bytes(spark):
    rows = [(k, "x" * (984 if k < 10 else 84)) for k in range(110)] + [(None, "n" * 984)] * 5
    docs = spark.createDataFrame(rows, SHAPE).repartition(7)
    cuts = substring_dedup.boundaries(docs, 5000)
    narrow = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.xxhash64("text").alias("h"), (F.length("text") + 16).alias("n")).toPandas()
    sizes = defaultdict(int)
    for part, n in zip(substring_dedup.part_of(narrow.i.to_numpy(), narrow.h.to_numpy(), cuts).tolist(), narrow.n.tolist(), strict=True):
        sizes[part] += n
    assert len(sizes) == 5 and all(n == 5000 for n in sizes.values())
    one = spark.createDataFrame([(7, f"text {k} " + "y" * 500) for k in range(100)], SHAPE)
    cuts = substring_dedup.boundaries(one, 5000)  # many rows of one doc_id are split, too
    assert len(cuts[0]) >= 10

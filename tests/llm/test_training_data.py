"""The training-data operators against brute force, and on nulls, empty and repeated rows, and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import decontaminate, hilbert, line_dedup, near_dedup, nearest, pieces, queries, substring_dedup, surrogates, toxicity, url_filter

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, ids string, lines string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", "y") for i, t in texts], SHAPE)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(4)]
    out = [(0, None), (1, ""), (2, "  \n\t "), (3, "one two"), (4, "one two"), (5, "ONE two")]
    for k in range(40):
        w = r.choice(base).split()
        for _ in range(r.choice((0, 1, 2, 3, 8))):
            w[r.randrange(len(w))] = r.choice(words)
        for p in range(0, len(w), 12):
            w[p] += "\n" if r.random() < 0.7 else ""
        out.append((10 + k, " ".join(w).replace("\n ", "\n")))
    out += [out[10], (None, "alone without a number"), (90, "é" * 5000 + " end " * 3000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).cache()


def test_substring_dedup(spark, texts):
    unique = list(dict.fromkeys(texts))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(table(spark, unique), with_text=True, pages=5, buckets=16).collect()}
    seen, gone = set(), defaultdict(set)
    order = sorted(unique, key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in order:
        w = SPACE.findall(t or "")
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[i].update(range(k, k + 20))
            seen.add(g)
    for i, t in order:
        w = SPACE.findall(t or "")
        kept = " ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone[i]), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_near_dedup(docs, texts):
    got = near_dedup.labelled(docs).collect()
    assert len(got) == len(texts)
    sets = {}
    for i, t in texts:
        w = SPACE.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), r.doc_id is None or root(r.doc_id) == r.doc_id)
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got)


def test_line_dedup(docs, texts):
    lines, inverted, want = [], defaultdict(list), set()
    for i, t in sorted(dict.fromkeys(texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            s = frozenset(SPACE.findall(lower(line)))
            if s:
                common = Counter(j for w in s for j in inverted[w])
                if any(5 * c >= 4 * (len(s) + len(lines[j]) - c) for j, c in common.items()):
                    want.add((i, n))
                for w in s:
                    inverted[w].append(len(lines))
                lines.append(s)
    got = {(None if r.doc_id == -(2**63) else r.doc_id, r.line) for r in line_dedup.removals(docs).collect()}
    assert got == want and want
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert {r.doc_id for r in out.where("text IS NULL").collect()} == {0}


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "W1 w2"), (2, None), (3, "..."), (4, "a b c d e f g h i j k"), (None, "alone")], "item_id long, text string")
    train = table(spark, [(0, "x w1, W2! y"), (1, "b C d e f g h i j K"), (2, "a b c d e f g h i"), (3, None), (4, "alone here"), (5, "x w1, W2! y")])
    for slice_bytes in (1 << 20, 8):  # one slice, and several passes
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(train, items, slice_bytes=slice_bytes).collect()}
        assert got == {0: (4, 2, 1, True), 1: (10, 10, 1, True), 2: (9, 0, 0, False), 3: (0, 0, 0, False), 4: (2, 1, 0, True), 5: (4, 2, 1, True)}
    cut = {r.doc_id: r.text for r in decontaminate.clean(train, items).collect()}
    assert cut[0] == "x ! y" and cut[1] == "" and cut[3] is None and cut[2] == "a b c d e f g h i"
    assert {r.doc_id for r in decontaminate.clean(train, items, remove="documents").collect()} == {2, 3}
    assert decontaminate.report(docs, items.limit(0)).where("contaminated").isEmpty()


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/1", "http://a.example.org/en/12#x", "http://org", "http://org?x/", "x://b.com/fr/", "x://b.com/de/é", "x://com.de/de/", "x://notexample.org/es/", "x://b.com/de/é"]
    rows = [(k if k else None, u) for k, u in enumerate(urls)] + [(3, urls[3])]
    got = sorted((tuple(r) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), ranges=5).collect()), key=repr)
    want = []
    for k, u in rows:
        rest = u.partition("://")[2] if u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((k, host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else "allow"))
    assert got == sorted(want, key=repr)
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=(), default="block").collect()} == {"block"}


def test_surrogates(spark):
    text = "Mail zoé.34@mail7.example.com or ZOÉ.34@mail7.example.com, +1 (017) 555-7713 at 97.51.17.173: 9807915762804490. Frau Anna Müller met Mr. Müller"
    got = {r.doc_id: r for r in surrogates.replaced(table(spark, [(0, text), (1, None), (2, ""), (3, "clean text 4.0"), (4, text), (4, text)]), "k").collect()}
    out = got[0].text
    for part in ("zoé", "ZOÉ", "7713", "51.17.173", "9807915762804490", "Anna", "Müller"):
        assert part not in out, (part, out)
    assert len(out.split()) == len(text.split()) and got[0].n_entities == 7 and out == got[4].text
    mails = re.findall(r"\S+@\S+\.com", out)
    assert mails[0] == mails[1].lower() and mails[1].split("@")[0].isupper()
    names = re.search(r"Frau (\S+) (\S+) met Mr\. (\S+)$", out)
    assert names[1] in surrogates.GIVEN["f", "latin"] and names[2] == names[3]
    assert got[1].text is None and got[2].text == "" and got[3].text == "clean text 4.0"
    many = spark.createDataFrame([("phone", f"1{k:05d}") for k in range(0, 3000)], "kind string, canon string")
    drawn = surrogates.surrogates(many, "k")
    assert drawn.count() == 3000 and drawn.select("surrogate").distinct().count() == 3000
    assert drawn.join(many.select(F.col("canon").alias("surrogate")), "surrogate").isEmpty()


def test_toxicity_learns_what_was_held_out(spark):
    r = random.Random(3)
    words = [f"v{k}" for k in range(400)]
    bad = ["grumble", "snarl", "zorkling", "zorkest"]
    rows = [(i, [r.choice(words) for _ in range(60)] + ([r.choice(bad) for _ in range(3)] if i % 5 == 0 else [])) for i in range(600)]
    docs = table(spark, [(i, " ".join(w)) for i, w in rows] + [(1000, None), (1001, "")])
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _ in rows if i < 400] + [(5000, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    left = toxicity.accepted(docs, labels)
    assert left.columns == docs.columns
    kept = {x.doc_id for x in left.collect()}
    held = range(400, 600)
    assert all(i not in kept for i in held if i % 5 == 0) and all(i in kept for i in held if i % 5) and {1000, 1001} <= kept
    assert toxicity.accepted(docs, labels.limit(0)).count() == docs.count()


def test_hilbert(spark, docs, texts):
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = hilbert.hilbert_index(cells, 3)
    path = cells[np.argsort(index)]
    assert sorted(index) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    got = hilbert.shard(docs, shards=7).collect()
    assert len(got) == len(texts)
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    raw = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == raw
    assert max(x.shard for x in hilbert.shard(docs.limit(3), shards=40).collect()) == 2


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[7], v[8] = v[6], v[6]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [None] * 16), (980, [1.0] * 3)]
    got = defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, pass_queries=6).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = v.astype(float)
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        s = nearest.exact(np.repeat(d[q : q + 1], 300, 0), d)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [i for i, _ in found] == want and [x for _, x in found] == [s[i] for i in want]


def test_pieces_agree_with_the_library(spark, docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r for r in pieces.with_ids(docs).collect()}
    assert "lines" in pieces.with_ids(docs).columns
    for i, t in texts:
        assert got[i].ids == (None if t is None else library.encode(t)) and got[i].round_trip
    back = pieces.decoded(pieces.with_ids(docs)).where("text IS NOT NULL AND NOT text <=> decoded")
    assert back.isEmpty()


def test_empty_tables(spark):
    none, labels = table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        toxicity.accepted(none, labels), decontaminate.report(none, bench), substring_dedup.remove_repeats(none), line_dedup.deduplicated(none), surrogates.replaced(none, "k"),
        hilbert.shard(none), pieces.with_ids(none), near_dedup.labelled(none), url_filter.judge(spark.createDataFrame([], "page_id long, url string")),
        nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0),
    ):
        assert out.isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()

    def rows(df):
        return sorted(map(repr, ([None if x is None or x != x else round(x, 9) if isinstance(x, float) else x for x in r] for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))))

    assert rows(got) == rows(want)

"""Line dedup: an exact set-similarity join of lines, of which later matches are removed.

A line is the set of its white-space separated words, A-Z lower-cased. A line goes if an earlier line (smaller
doc_id, or further up) has a Jaccard similarity of 0.8 or more with it; lines are judged on the input. Words are
compared by 59 bits of hash: two words of a pair of lines would have to collide for a wrong answer.

1. All words are counted in a count-min sketch, whose size grows with the input up to 2**MAX_BITS slots; tasks' sketches
   are added up in a tree. Words are ordered by rarity: the logarithm of the sketched count, then the hash. Any
   order that all lines share gives exact results.
2. Prefix filter: similar lines share a word among their rarest |x| - ceil(0.8 |x|) + 1. Words that the sketch
   proves to occur once are left out. For each prefix word a line sends its place, the line's size, key and odd
   sketch, packed by chunks of text, to the word's bucket; equal lines of a chunk are sent once.
   Hot words: one document of SAMPLE is looked at for how many lines have a word in their prefix. A word that CELL or
   more of all lines may have is dealt over a triangular grid of cells: each line falls into one part by its key, each
   pair of parts meets in a cell of its own. The sample balances only; every pair meets whatever it says.
3. In a cell, of equal lines the later ones go. Pairs that share a word are compared in order of size, and pass
   the length filter, the positional filter and the sketch: as many words at least are in just one of two lines
   as bits differ. Each line keeps the NEAREST earlier lines for each of its prefix words, of which it sends on
   NEAR_ENOUGH where the nearest differs in at most half the bits that it may; without so near a one it sends all.
4. Candidates are verified on their full sets: first the nearest of each line, then the others. Lines that had
   more candidates and found no match are asked again, with no limit, so nothing is lost to it: SEEK_LINES of them
   at most are broadcast and sought in one pass, more go through the buckets once more.

Cases: lines without words stay, as do null and empty texts. Repeated documents: the same doc_id and text twice
are one document, and keep the same lines. Rows that share a doc_id, or have none, but differ in text are told apart
by a hash of it, in whose order they come. A null doc_id comes first. Very long texts are read line by line; a line
is held whole (some 60 bytes a word). Extra columns pass through deduplicated(), whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import kernels as K
from foliant.llm.common import few, file_count, forget, free, in_few_files, input_bytes, saved, table

#: Similarity as a fraction: 4 / 5.
NUM, DEN = 4, 5
#: Slots of the sketch: one for SLOT_BYTES of input, between 2**MIN_BITS and 2**MAX_BITS; sent in blocks of BLOCK_SLOTS.
SLOT_BYTES, MIN_BITS, MAX_BITS = 64, 20, 25
BLOCK_SLOTS = 1 << 16
#: Sketches that a task adds up at once, and the input bytes of a task's.
FAN_IN, TASK_BYTES = 256, 16 << 20
SAMPLE, CELL = 16, 8192
CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
NEAREST = 32
NEAR_ENOUGH = 8
#: Candidates of a line that has no near one, and pairs that are held or compared at once.
WIDE, PAIRS = 256, 1 << 19
SEEK_LINES = 2000


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(65 - int(slots).bit_length())).astype(np.int64)


def _tokens(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Words in order of rarity: level, then hash."""
    return (levels[_slot(h, len(levels))].astype(np.uint64) << np.uint64(59)) | (h >> np.uint64(5))


def _packed(counts: np.ndarray) -> bytes:
    """32-bit counts, compressed, first bytes of all first. Larger ones are as many as that holds."""
    return zstandard.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(blob) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.uint64)


def _count(slots: int, slots_of):
    """Counts what slots_of gives for groups of texts; rows of (block, part, counts)."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in K.groups(texts):
                np.add.at(total, slots_of(texts[lo:hi]), np.uint32(1))
        part = TaskContext.get().partitionId()
        for k, block in enumerate(total.reshape(-1, BLOCK_SLOTS)):
            if block.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([_packed(block)], pa.binary())})

    return run


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK_SLOTS, np.uint64)
    for batch in batches:
        for blob in batch.column("counts"):
            total += _unpack(blob.as_buffer())
    blob = _packed(np.minimum(total, 2**32 - 1))
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([blob], pa.binary())})


def _sketched(texts: DataFrame, slots: int, slots_of, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, counts) over all texts. Sketches of tasks are added up FAN_IN at a time."""
    shape = "block int, part int, counts binary"
    rows, tasks = texts.mapInArrow(_count(slots, slots_of), shape), max(1, size // TASK_BYTES)
    while True:
        tasks = -(-tasks // FAN_IN)
        part = F.floor(F.col("part") / FAN_IN).cast("int") if tasks > 1 else F.lit(0)
        rows = rows.withColumn("part", part).groupBy("block", "part").applyInArrow(_add, shape)
        if tasks == 1:
            break
    for r in rows.toLocalIterator():  # as many rows as blocks
        yield r.block, _unpack(bytes(r.counts))


def _all_slots(slots: int):
    return lambda texts: _slot(K.split(texts, K.SPACE, lower=True).hashes(), slots)


def rarity(texts: DataFrame, size: int) -> np.ndarray:
    """For each slot of the sketch the level of its count; 0: one word occurs at most. 2**MAX_BITS bytes at most."""
    slots = 1 << min(MAX_BITS, max(MIN_BITS, (size // SLOT_BYTES).bit_length()))
    out = np.zeros(slots, np.uint8)
    for block, total in _sketched(texts, slots, _all_slots(slots), size):
        level = np.zeros(len(total), np.uint8)
        many = total > 1  # one occurrence, or none: 0
        level[many] = np.minimum(1 + np.floor(np.log2(total[many])), 31)
        out[block * BLOCK_SLOTS : (block + 1) * BLOCK_SLOTS] = level
    return out


def _hot_slot(token: np.ndarray, slots: int) -> np.ndarray:
    return (K.mix(token) & np.uint64(slots - 1)).astype(np.int64)


def _prefix_slots(levels):
    def run(texts: list) -> np.ndarray:
        x = _Lines(texts, levels.value)
        return _hot_slot(x.token[x.prefix()[0]], len(levels.value))

    return run


def hot(texts: DataFrame, levels, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of prefix words that are hot, ascending, and the parts over which the lines of each are dealt."""
    sample, slots = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text"), len(levels.value)
    total = np.zeros(slots, np.uint32)
    for block, counts in _sketched(sample, slots, _prefix_slots(levels), size // SAMPLE):
        total[block * BLOCK_SLOTS : (block + 1) * BLOCK_SLOTS] = np.minimum(counts, 2**32 - 1)
    usual = int(total.mean())  # what words that share a slot add up to
    own = np.flatnonzero(total >= usual + CELL // SAMPLE)
    return own, np.minimum(2 + (total[own].astype(np.int64) - usual) * SAMPLE // CELL, 65535)


def _by_line(line: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The order by line, then token: one sort of both in a single number, if that tells all tokens of a line apart."""
    bits = int(line[-1]).bit_length() if len(line) else 0
    key = (line.astype(np.uint64) << np.uint64(64 - bits)) | (token >> np.uint64(bits)) if bits else token
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if bits and (token[order][1:][same] != token[order][:-1][same]).any():
        return np.lexsort((token, line))
    return order


class _Lines:
    """The lines of a run of texts, with their words in order of rarity, each once."""

    def __init__(self, texts: list[bytes | None], levels: np.ndarray):
        words = K.split(texts, K.SPACE, lower=True)
        starts = np.zeros(len(texts), np.int64)
        np.cumsum([len(t or b"") + 1 for t in texts[:-1]], out=starts[1:])
        bounds = np.union1d(starts, np.flatnonzero(words.buf == 10) + 1)
        bounds = bounds[bounds < max(len(words.buf), 1)] if len(texts) else bounds
        line = np.searchsorted(bounds, words.start, "right") - 1
        token = _tokens(words.hashes(), levels)
        order = _by_line(line, token)
        line, token = line[order], token[order]
        fresh = np.ones(len(line), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
        self.token = token[fresh]
        # only lines with words
        self.line, self.first, self.size = np.unique(line[fresh], return_index=True, return_counts=True)
        self.first = np.r_[self.first, len(self.token)].astype(np.int64)
        doc_line = np.searchsorted(bounds, starts)
        self.doc = np.searchsorted(doc_line, self.line, "right") - 1
        self.number = (self.line - doc_line[self.doc]) if len(texts) else self.line

    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        """The places in token of all prefix words that may occur in another line, and the line of each."""
        want = prefix_length(self.size)
        at = np.repeat(self.first[:-1], want) + np.arange(want.sum()) - np.repeat(np.cumsum(want) - want, want)
        owner = np.repeat(np.arange(len(want)), want)
        useful = (self.token[at] >> np.uint64(59)) > 0  # others occur once
        return at[useful], owner[useful]


def prefix_length(size: np.ndarray) -> np.ndarray:
    return size - -(-NUM * size // DEN) + 1


def sketch_words(size: np.ndarray) -> np.ndarray:
    """Words of 64 bits in the odd sketch of a line of so many words: a power of two, a bit for each word at least."""
    return 1 << np.ceil(np.log2(np.maximum(size / 64, 1))).astype(np.int64)


#: What is sent of a prefix word, and how many bytes of each: words and keys of equal lines are told apart by 40 bits
#: within a bucket, where a pair that is no pair is found out on the full sets. Lines are equal if word, size, key and
#: sketch are.
_COLUMNS = {"token": 5, "key": 5, "doc": 8, "row": 8, "line": 4, "size": 4, "place": 4, "flags": 1}
LEAD, ASKS, SIDE = 1, 2, 4


def _bytes_of(columns: dict[str, np.ndarray]) -> np.ndarray:
    """A row of bytes for each value, all columns side by side."""
    return np.concatenate([np.ascontiguousarray(columns[c].astype("<i8" if w == 8 else "<u8")).view(np.uint8).reshape(-1, 8)[:, :w] for c, w in _COLUMNS.items()], axis=1)


def _unpacked(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns and sketches of all blobs."""
    width, planes, sketches, sizes = sum(_COLUMNS.values()), [], [], []
    for blob in blobs:
        raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
        n = int(raw[:4].view("<u4")[0])
        planes.append(raw[4 : 4 + n * width].reshape(width, n))
        sketches.append(raw[4 + n * width :])
        sizes.append(n)
    both, out, at = np.concatenate(planes, axis=1), {}, 0
    for c, w in _COLUMNS.items():
        wide = np.zeros((both.shape[1], 8), np.uint8)
        wide[:, :w] = both[at : at + w].T
        out[c], at = wide.view("<u8" if c in ("token", "key") else "<i8").ravel(), at + w
    total, begin = np.cumsum(out["doc"]), np.cumsum(sizes) - sizes  # doc ids are differences within their blob
    out["doc"] = total - np.repeat(np.r_[0, total][begin], sizes)
    return out, np.frombuffer(np.concatenate(sketches).tobytes(), "<u8")


class _Chunk:
    """What a chunk of text sends: columns by prefix word, and the lines' sketches."""

    def __init__(self):
        self.lines: list[dict] = []
        self.size = 0

    def add(self, texts: list[bytes | None], ids: np.ndarray, rows: np.ndarray, asks: list | None, levels: np.ndarray) -> None:
        x = _Lines(texts, levels)
        self.size += sum(len(t or b"") for t in texts)
        if not len(x.line):
            return
        starts = x.first[:-1]
        asked = np.zeros(len(x.line), bool)
        if asks is not None:
            wanted = [set(a or ()) for a in asks]
            asked = np.array([n in wanted[d] for d, n in zip(x.doc.tolist(), x.number.tolist(), strict=True)], bool)
        at, owner = x.prefix()
        words = sketch_words(x.size)
        sketches = np.zeros(int(words.sum()), np.uint64)
        begin = np.cumsum(words) - words
        mixed = K.mix(x.token)
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            pick = np.repeat(starts[own], x.size[own]) + np.arange(x.size[own].sum()) - np.repeat(np.cumsum(x.size[own]) - x.size[own], x.size[own])
            sketches[(begin[own][:, None] + np.arange(w)).ravel()] = K.parity_bits(mixed[pick], np.r_[0, np.cumsum(x.size[own])], w).ravel()
        self.lines.append({
            "doc": ids[x.doc], "row": rows[x.doc], "line": x.number, "size": x.size, "key": np.add.reduceat(K.mix(~x.token), starts),
            "asks": asked, "words": words, "sketches": sketches, "owner": owner, "token": x.token[at], "place": (at - starts[owner]).astype(np.int32),
        })

    def send(self, buckets: int, slots: int, hot_words: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch | None:
        parts, self.lines, self.size = self.lines, [], 0
        if not parts:
            return None
        base = np.cumsum([0] + [len(p["doc"]) for p in parts])
        line = {c: np.concatenate([p[c] for p in parts]) for c in ("doc", "row", "line", "size", "key", "asks", "words", "sketches")}
        owner = np.concatenate([p["owner"] + b for p, b in zip(parts, base, strict=False)])
        token, place = (np.concatenate([p[c] for p in parts]) for c in ("token", "place"))
        del parts
        # of equal lines the first stands for the chunk; the others are told apart from it, but compared no further
        order = np.lexsort((line["line"], line["row"], line["doc"], line["size"], line["key"]))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (line["key"][order[1:]] == line["key"][order[:-1]]) & (line["size"][order[1:]] == line["size"][order[:-1]])
        lead = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
        # a later equal line goes in any case: it is sent to one bucket, to be reported
        keep = ~again[owner] | lead
        owner, token, place, lead = owner[keep], token[keep], place[keep], lead[keep]
        flags = (lead * LEAD + line["asks"][owner] * ASKS).astype(np.uint8)
        mixed = K.mix(token)
        bucket, cell = (mixed & np.uint64(buckets - 1)).astype(np.int64), np.zeros(len(token), np.int64)
        known, dealt = hot_words
        if len(known) and len(token):
            at = np.minimum(np.searchsorted(known, _hot_slot(token, slots)), len(known) - 1)
            over = np.where(known[at] == _hot_slot(token, slots), dealt[at], 1)
            hot = np.flatnonzero(over > 1)
            n = over[hot]
            own = (line["key"][owner[hot]] >> np.uint64(20)).astype(np.int64) % n
            copies, other = np.repeat(hot, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mine = np.repeat(own, n)
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            rest = np.flatnonzero(over <= 1)
            pick = np.r_[rest, copies]
            cell = np.r_[cell[rest], 1 + (low << 16) + high]
            side = np.r_[np.zeros(len(rest), bool), (mine == high) & (low < high)]
            owner, token, place, bucket, mixed, flags = owner[pick], token[pick], place[pick], bucket[pick], mixed[pick], flags[pick] | (side * SIDE).astype(np.uint8)
        order = np.lexsort((cell, bucket)) if len(known) else np.argsort(bucket, kind="stable")
        owner, bucket, cell = owner[order], bucket[order], cell[order]
        turn = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]) if len(order) else np.zeros(0, np.int64)
        doc = line["doc"][owner]
        before = np.r_[0, doc[:-1]]
        before[turn] = 0
        columns = {"token": mixed[order] >> np.uint64(24), "key": line["key"][owner], "doc": doc - before, "row": line["row"][owner], "line": line["line"][owner], "size": line["size"][owner], "place": place[order], "flags": flags[order]}
        raw = _bytes_of(columns)
        begin, words = np.cumsum(line["words"]) - line["words"], line["words"][owner]
        sketches, upto = line["sketches"].astype("<u8"), np.r_[0, np.cumsum(words)]
        pick = np.repeat(begin[owner] - upto[:-1], words) + np.arange(upto[-1])
        sketches = sketches[pick]
        blobs = [zstandard.compress(np.uint32(b - a).tobytes() + np.ascontiguousarray(raw[a:b].T).tobytes() + sketches[upto[a] : upto[b]].tobytes(), 1) for a, b in zip(turn.tolist(), [*turn[1:].tolist(), len(order)], strict=False)]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[turn], pa.int32()), "cell": pa.array(cell[turn], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _send(levels, hot_words, buckets: int):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, slots = _Chunk(), len(levels.value)
        for batch in batches:
            texts, ids, rows = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            asks = batch.column("lines").to_pylist() if "lines" in batch.schema.names else None
            for lo, hi in K.groups(texts):
                chunk.add(texts[lo:hi], ids[lo:hi], rows[lo:hi], asks and asks[lo:hi], levels.value)
                if chunk.size >= CHUNK_BYTES and (out := chunk.send(buckets, slots, hot_words.value)):
                    yield out
        if out := chunk.send(buckets, slots, hot_words.value):
            yield out

    return run


def _ranks(doc: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The place of each line in the order of all; equal for the same line."""
    if not len(doc):
        return doc
    if not row.any() and 0 <= doc.min() and doc.max() < 1 << 40 and line.max() < 1 << 23:
        return np.unique(doc << 23 | line, return_inverse=True)[1]
    order = np.lexsort((line, row, doc))
    fresh = np.logical_or.reduce([v[order][1:] != v[order][:-1] for v in (doc, row, line)])
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(np.r_[0, fresh])
    return out


def _match(k: int | None):
    """Compares the lines of a cell. k None: for lines that ask, all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.trim()
        c, sketch = _unpacked([blob for batch in batches for blob in batch.column("blob").to_pylist()])
        words = sketch_words(c["size"])
        c["own"], c["words"] = np.cumsum(words) - words, words
        # equal lines
        c["head"] = sketch[c["own"]]
        c["rank"] = _ranks(c["doc"], c["row"], c["line"])
        mark = K.mix(K.mix(c["token"] ^ (c["key"] << np.uint64(24))) ^ c["head"] ^ c["size"].astype(np.uint64))
        order = np.lexsort((c["rank"], mark))
        same = np.zeros(len(order), bool)
        same[1:] = np.logical_and.reduce([c[n][order[1:]] == c[n][order[:-1]] for n in ("token", "key", "head", "size")])
        run_first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        other = c["rank"][order] != c["rank"][run_first]  # not the same row twice
        gone = order[same & other & ((c["flags"][order] & LEAD) > 0)] if k is not None else order[:0]
        hits = c["doc"][gone], c["row"][gone], c["line"][gone]
        keep = order[~same]
        keep = keep[np.argsort((c["token"][keep] << np.uint64(24)) | np.minimum(c["size"][keep], (1 << 24) - 1).astype(np.uint64))]
        c = {n: v[keep] for n, v in c.items()}
        n, rank = len(keep), c["rank"]
        # sketches of half the width, to compare lines that need different widths
        wide = np.flatnonzero(c["words"] > 1)
        half_words = c["words"][wide] // 2
        pick = np.repeat(c["own"][wide], half_words) + np.arange(half_words.sum()) - np.repeat(np.cumsum(half_words) - half_words, half_words)
        half = sketch[pick] ^ sketch[pick + np.repeat(half_words, half_words)]
        c["half"] = np.zeros(n, np.int64)
        c["half"][wide] = len(sketch) + np.cumsum(half_words) - half_words
        sketch = np.concatenate([sketch, half])
        asks = (c["flags"] & ASKS) > 0
        width = k or 1
        near, who, more = np.full((n, width), 1 << 30, np.int32), np.full((n, width), -1, np.int32), np.zeros(n, bool)
        side = (c["flags"] & SIDE) > 0
        across = bool(side.any())  # a cell of two parts: only pairs of one line from each
        held: list[tuple] = []

        def emit(y, x, apart) -> pa.RecordBatch:
            """One row for each pair of lines; a pair may be seen for several words, of which any may have had more."""
            _, once, pair = np.unique(rank[y] * max(n, 1) + rank[x], return_index=True, return_inverse=True)
            flag = np.zeros(len(once), bool)
            np.logical_or.at(flag, pair, more[y])
            y, x, apart = y[once], x[once], apart[once]
            return pa.RecordBatch.from_pydict({
                "doc_id": c["doc"][y], "row": c["row"][y], "line": c["line"][y].astype(np.int32), "x_doc": c["doc"][x], "x_row": c["row"][x], "x_line": c["line"][x].astype(np.int32),
                "apart": apart.astype(np.int32), "more": flag, "equal": np.zeros(len(y), bool),
            })

        def offer(y, x, apart):
            if k is None:
                held.append((y[asks[y]], x[asks[y]], apart[asks[y]]))
                return
            more[y[who[y, -1] >= 0]] = True
            better = apart < near[y, -1]
            y, x, apart = y[better], x[better], apart[better]
            near[y, -1], who[y, -1] = apart, x
            order = np.argsort(near[y], axis=1, kind="stable")
            near[y], who[y] = np.take_along_axis(near[y], order, 1), np.take_along_axis(who[y], order, 1)

        def all_held():
            out = [np.concatenate([np.zeros(0, np.int64), *(h[m] for h in held)]) for m in range(3)]
            held.clear()
            return out

        def passing(i, j):
            """Of the pairs those that pass the positional filter and the sketch, with the bits in which they differ."""
            total = c["size"][i] + c["size"][j]
            room = np.minimum(c["size"][i] - c["place"][i], c["size"][j] - c["place"][j])  # as if this were their first common word
            # shorter lines would have to be equal, and no two here are
            ok = ((NUM + DEN) * room >= NUM * total) & (total >= NUM + DEN)
            if across:
                ok &= side[i] != side[j]
            a, b, total = i[ok], j[ok], total[ok]
            least = np.minimum(c["words"][a], c["words"][b])
            at_a = np.where(c["words"][a] == least, c["own"][a], c["half"][a])
            at_b = np.where(c["words"][b] == least, c["own"][b], c["half"][b])
            apart = np.bitwise_count(sketch[at_a] ^ sketch[at_b]).astype(np.int32)
            for t in range(1, int(least.max()) if len(least) else 0):
                has = np.flatnonzero(least > t)
                apart[has] += np.bitwise_count(sketch[at_a[has] + t] ^ sketch[at_b[has] + t])
            ok = ((NUM + DEN) * apart <= (DEN - NUM) * total) & (rank[a] != rank[b])
            return a[ok], b[ok], apart[ok]

        i, step = np.arange(n), 0
        while len(i):
            step += 1
            i = i[i + step < n]
            j = i + step
            # rows of a word come by size: once the partner is too long, so are all that follow
            fits = (c["token"][i] == c["token"][j]) & (DEN * c["size"][i] >= NUM * c["size"][j])
            i, j = i[fits], j[fits]
            a, b, apart = passing(i, j)
            later = rank[a] > rank[b]
            offer(a[later], b[later], apart[later])
            offer(b[~later], a[~later], apart[~later])
            if sum(len(h[0]) for h in held) > PAIRS:
                yield emit(*all_held())
        if k is None:
            yield emit(*all_held())
            return
        none = np.zeros(len(gone), np.int64)
        yield pa.RecordBatch.from_pydict({
            "doc_id": hits[0], "row": hits[1], "line": hits[2].astype(np.int32), "x_doc": none, "x_row": none, "x_line": none.astype(np.int32),
            "apart": none.astype(np.int32), "more": none > 0, "equal": none == 0,
        })
        # where the nearest is well within the limit it is all but sure to match: a few will do
        sure = 2 * (NUM + DEN) * near[:, 0] <= (DEN - NUM) * 2 * c["size"]
        if k > NEAR_ENOUGH:
            cut = sure & (who[:, NEAR_ENOUGH] >= 0)
            more[cut] = True
            who[cut, NEAR_ENOUGH:] = -1
        # lines with more candidates than that, none of them so near: WIDE of them
        unsure = more & ~sure
        who[unsure] = -1
        y, slot = np.nonzero(who >= 0)
        x, apart = who[y, slot], near[y, slot]
        del near, who
        yield emit(y, x, apart)
        rows = np.flatnonzero(unsure)
        lo, hi = np.searchsorted(c["token"], c["token"][rows], "left"), np.searchsorted(c["token"], c["token"][rows], "right")
        for i, j in _runs(hi - lo, PAIRS):
            y = np.repeat(rows[i:j], (hi - lo)[i:j])
            x = np.arange(len(y)) + np.repeat(lo[i:j] - (np.cumsum((hi - lo)[i:j]) - (hi - lo)[i:j]), (hi - lo)[i:j])
            short, long = np.minimum(c["size"][x], c["size"][y]), np.maximum(c["size"][x], c["size"][y])
            fits = (rank[x] < rank[y]) & (DEN * short >= NUM * long)
            y, x, apart = passing(y[fits], x[fits])
            order = np.lexsort((apart, y))
            y, x, apart = y[order], x[order], apart[order]
            place = np.arange(len(y)) - np.searchsorted(y, y)
            more[rows[i:j]] = False
            more[y[place >= WIDE]] = True
            yield emit(y[place < WIDE], x[place < WIDE], apart[place < WIDE])

    return run


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items with about that much in all, one item at least."""
    part = np.cumsum(sizes) // most
    cut = (np.flatnonzero(np.diff(part)) + 1).tolist()
    if len(sizes):
        yield from zip([0, *cut], [*cut, len(sizes)], strict=True)


def _line_sets(levels):
    """The word sets of the lines listed; only these are read."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = levels.value
        for batch in batches:
            where, lines = [], []
            for text, i, row, numbers in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "row", "lines")), strict=True):
                each = text.split(b"\n")
                where += [(i, row, n) for n in numbers]
                lines += [each[n] for n in numbers]
            for lo, hi in K.groups(lines):
                x = _Lines(lines[lo:hi], known)
                own = [where[lo + k] for k in x.doc.tolist()]
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array([w[k] for w in own], t) for k, (c, t) in enumerate({"doc_id": pa.int64(), "row": pa.int64(), "line": pa.int32()}.items())},
                    "words": pa.array([x.token[a:b].tobytes() for a, b in zip(x.first, x.first[1:])], pa.binary()),
                })

    return run


@K.tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("wy"), batch.column("wx"), strict=True):
            y, x = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield batch.select(["doc_id", "row", "line"]).filter(pa.array(keep, pa.bool_()))


ID, ROW = "_id", "_row"


def keyed(docs: DataFrame, names: tuple[str, str] = (ID, ROW)) -> DataFrame:
    """docs with an id, and a row: a hash of the text where doc_id is null or other texts have it too, else 0."""
    text_hash, own = F.xxhash64("text"), docs.withColumn(names[0], F.coalesce("doc_id", F.lit(-(2**63))))
    hashes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text_hash).alias("lo"), F.max(text_hash).alias("hi"))
    shared = saved(hashes.where("lo <> hi").select(F.col("doc_id").alias(names[0])), "line-ids", file_count(input_bytes(docs)))
    if not few(shared):  # the hash does no harm to rows that need none
        return own.withColumn(names[1], text_hash)
    mark = free(own, "_shared")[0]
    told = F.when(F.col("doc_id").isNull() | F.col(mark), text_hash).otherwise(F.lit(0))
    return own.join(F.broadcast(shared.withColumn(mark, F.lit(True))), names[0], "left").withColumn(names[1], told).drop(mark)


def removals(docs: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """(doc_id, row, line): the lines to remove, numbered from 0 in their documents; row as in keyed()."""
    return _removals(keyed(docs.select("doc_id", "text")), input_bytes(docs), nearest)


def _removals(named: DataFrame, size: int, nearest: int = NEAREST) -> DataFrame:
    """removals() of what keyed() gave for tables of that size."""
    spark, made = named.sparkSession, []
    source = named.select(F.col(ID).alias("doc_id"), F.col(ROW).alias("row"), F.col("text").cast("binary").alias("text"))
    levels = spark.sparkContext.broadcast(rarity(source.select("text"), size))
    hot_words = spark.sparkContext.broadcast(hot(source, levels, size))
    buckets = 1 << max(5, (4 * size // BUCKET_BYTES).bit_length())
    doc, line, other = ["doc_id", "row"], ["doc_id", "row", "line"], ["x_doc", "x_row", "x_line"]

    files = file_count(size)

    def keep(df: DataFrame, what: str) -> DataFrame:
        made.append(saved(df, what, files))
        return made[-1]

    def compared(texts: DataFrame, k: int | None) -> DataFrame:
        sent = texts.mapInArrow(_send(levels, hot_words, buckets), "bucket int, cell long, blob binary")
        shape = "doc_id long, row long, line int, x_doc long, x_row long, x_line int, apart int, more boolean, equal boolean"
        return keep(sent.groupBy("bucket", "cell").applyInArrow(_match(k), shape).repartition(files), "line-pairs")

    def listed(lines: DataFrame, name: str) -> DataFrame:
        """source with the numbers of the lines of each document."""
        by_doc = keep(lines.groupBy(doc).agg(F.collect_list("line").alias("lines")), name)
        return source.join(F.broadcast(by_doc) if few(by_doc, lists="lines") else by_doc, doc, "left")

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(line).unionByName(pairs.select(F.col("x_doc").alias("doc_id"), F.col("x_row").alias("row"), F.col("x_line").alias("line"))).distinct()
        return keep(listed(wanted, "line-wanted").where("lines IS NOT NULL").mapInArrow(_line_sets(levels), "doc_id long, row long, line int, words binary").dropDuplicates(line), "line-sets")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left = pairs.join(sets.withColumnRenamed("words", "wy"), line)
        both = left.join(sets.select(F.col("doc_id").alias("x_doc"), F.col("row").alias("x_row"), F.col("line").alias("x_line"), F.col("words").alias("wx")), other)
        return keep(both.select(*line, "wy", "wx").mapInArrow(_verify, "doc_id long, row long, line int").distinct(), "line-hits")

    found = compared(source, nearest)
    equal = found.where("equal").select(line)
    # a line that equals an earlier one goes anyhow
    open_pairs = found.where("not equal").join(equal, line, "left_anti")
    pairs = keep(open_pairs.groupBy(*line, *other).agg(F.min("apart").alias("apart"), F.max("more").alias("more")), "line-candidates")
    sets = sets_of(pairs)
    best = pairs.groupBy(line).agg(F.min(F.struct("apart", *other)).alias("b")).select(*line, "b.x_doc", "b.x_row", "b.x_line")
    hits = verified(best, sets)
    rest = keep(pairs.join(hits, line, "left_anti"), "line-rest")
    gone = equal.unionByName(hits)
    if not rest.isEmpty():
        hits = verified(rest.select(*line, *other).distinct(), sets)
        gone = gone.unionByName(hits)
        asking = keep(rest.where("more").select(line).distinct().join(hits, line, "left_anti"), "line-asking")
        if few(asking, SEEK_LINES):
            rows = sets.join(F.broadcast(asking), line, "left_semi").collect()  # SEEK_LINES at most: sets has a line once
            if rows:
                lines = [((r.doc_id, r.row, r.line), np.frombuffer(bytes(r.words), np.uint64)) for r in rows]
                owners: dict[int, list[int]] = {}
                for i, (_, words) in enumerate(lines):
                    for t in words[: int(prefix_length(np.int64(len(words))))].tolist():
                        owners.setdefault(t, []).append(i)
                known = sorted(owners)
                asks = spark.sparkContext.broadcast((np.array(known, np.uint64), [owners[t] for t in known], lines))
                gone = gone.unionByName(source.mapInArrow(_seek(levels, asks), "doc_id long, row long, line int"))
        else:
            again = compared(listed(asking, "line-asking"), None)
            gone = gone.unionByName(verified(again.select(*line, *other).distinct(), sets_of(again)))
    out = saved(gone.distinct(), "line-removals", files)
    for table_ in made:
        forget(table_)
    return out


def _seek(levels, asks):
    """Of few lines that ask, those that an earlier line of the batches matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own, lines = asks.value
        hashes = known & np.uint64((1 << 59) - 1)
        maybe = np.zeros(1 << 16, bool)  # by some bits of the hash: most words are ruled out
        maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        hashes = np.sort(hashes)
        found: set[int] = set()
        for batch in batches:
            texts, ids, rows = (batch.column(c).to_pylist() for c in ("text", "doc_id", "row"))
            for lo, hi in K.groups(texts):
                words = K.split(texts[lo:hi], K.SPACE, lower=True)
                h = words.hashes() >> np.uint64(5)
                hit = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
                hit = hit[hashes[np.minimum(np.searchsorted(hashes, h[hit]), len(hashes) - 1)] == h[hit]]
                if not len(hit):
                    continue
                # the lines of these words
                doc = words.doc_of()[hit]
                starts = np.r_[0, np.cumsum([len(t or b"") + 1 for t in texts[lo:hi]])]
                breaks = np.flatnonzero(words.buf == 10)
                begins = np.union1d(starts, breaks + 1)
                line = np.unique(np.searchsorted(begins, words.start[hit], "right") - 1)
                doc = np.searchsorted(starts, begins[line], "right") - 1
                number = np.searchsorted(breaks, begins[line]) - np.searchsorted(breaks, starts[doc])
                ends = np.r_[begins[1:], len(words.buf)][line] - 1
                x = _Lines([words.buf[a:b].tobytes() for a, b in zip(begins[line].tolist(), ends.tolist(), strict=True)], levels.value)
                at = np.minimum(np.searchsorted(known, x.token), len(known) - 1)
                pos = np.flatnonzero(known[at] == x.token)
                for i, k in set(zip((np.searchsorted(x.first, pos, "right") - 1).tolist(), at[pos].tolist(), strict=True)):
                    d, size = int(doc[x.doc[i]]), int(x.size[i])
                    place = (ids[lo + d], rows[lo + d], int(number[x.doc[i]]))
                    mine = x.token[x.first[i] : x.first[i + 1]]
                    for y in own[k]:
                        own_place, theirs = lines[y]
                        if place < own_place and y not in found and DEN * min(size, len(theirs)) >= NUM * max(size, len(theirs)):
                            both = len(np.intersect1d(mine, theirs, assume_unique=True))
                            if DEN * both >= NUM * (size + len(theirs) - both):
                                found.add(y)
        places = [lines[y][0] for y in found]
        yield pa.RecordBatch.from_pydict({c: pa.array([p[i] for p in places], t) for i, (c, t) in enumerate({"doc_id": pa.int64(), "row": pa.int64(), "line": pa.int32()}.items())})

    return K.tidy(run)


def _cut(gone: str, keep: list[str] | None):
    """Removes the lines listed in the column gone from text. keep: the columns that stay; None for a digest instead."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = batch.column("text").cast(pa.binary()), batch.column(gone)
            if keep is None:
                rows = []
                for text, own in zip(texts, numbers, strict=True):
                    raw, own = text.as_py(), own.as_py() or ()
                    rows.append((0 if raw is None else raw.count(b"\n") + 1, len(own), hashlib.sha256(_without(raw, own) or b"").hexdigest()))
                counts, removed, digests = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_lines": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})
            else:
                kept = pa.array([_without(t.as_py(), n.as_py()) for t, n in zip(texts, numbers, strict=True)], pa.binary()).view(pa.string())
                yield batch.set_column(batch.schema.get_field_index("text"), "text", kept).select(keep)

    return run


def _without(text: bytes | None, numbers: list[int] | None) -> bytes | None:
    if not numbers or text is None:
        return text
    drop = set(numbers)
    return b"\n".join(x for n, x in enumerate(text.split(b"\n")) if n not in drop)


def _joined(docs: DataFrame, digest: bool) -> DataFrame:
    """docs cut, or the digest of each."""
    own, row, gone = free(docs, ID, ROW, "_gone")
    named = keyed(docs, (own, row))
    removed = _removals(named.select(F.col(own).alias(ID), F.col(row).alias(ROW), "text"), input_bytes(docs))
    by_doc = saved(removed.groupBy(F.col("doc_id").alias(own), F.col("row").alias(row)).agg(F.collect_list("line").alias(gone)), "line-removed", file_count(input_bytes(docs)))
    out = named.join(F.broadcast(by_doc) if few(by_doc, lists=gone) else by_doc, [own, row], "left")
    if digest:
        return out.select("doc_id", "text", gone).mapInArrow(_cut(gone, None), "doc_id long, n_lines long, n_removed long, kept_sha256 string")
    return out.select(*docs.columns, gone).mapInArrow(_cut(gone, docs.columns), docs.schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the lines removed from text; all rows and columns stay."""
    return _joined(docs, False)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left) for every row of docs."""
    return _joined(docs.select("doc_id", "text"), True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return in_few_files(report(docs), docs)

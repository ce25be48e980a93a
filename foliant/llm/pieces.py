"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Compiled from the model file, once, on the driver:

* the normaliser: rewriting arcs of the model's character map (longest match first), blanks that it collapses, and
  a blank in front;
* the pieces: a trie over their bytes, as a double array; each final state gives a piece. A character that no
  piece covers takes a fallback arc, which stands for one piece a byte;
* the weights. Unigram models: minus the score of the piece. BPE models: a pair of neighbours weighs 0 if merging
  their joined text leaves them apart, and infinity if not; under these weights one path has a finite weight, and it
  is the one that merging finds.

Encoding composes a text with the transducer, which gives the arcs of a lattice of positions, and relaxes them in
the tropical semiring (min, +): a position keeps the least weight with which it is reached, and the arc to it.
Plain scores as weights would be wrong for BPE, whose scores are ranks of merges: their shortest path is another
segmentation than the model's. Hence the weights of pairs, which a walk down the merges of both pieces gives.

No path crosses a blank inside a piece in models whose pieces have blanks in front only: there a text falls into
segments, of which each is composed once a group of texts. A lattice falls apart again where no piece spans a
position, so that levels of relaxation are few; parts longer than LONG characters (no blank and pieces everywhere)
are relaxed one by one, in time proportional to their length.

Cases: a null text gives null ids, an empty one none. Very long texts are taken in parts of about GROUP_BYTES, cut
where no piece spans. Ties go to the longer piece, as in the model. A literal U+2581 in a text decodes as a blank,
which is the model's own loss, and makes round_trip false. Repeated rows are encoded each. Extra columns stay, but
for those with the names of the new ones, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import kernels as K
from foliant.llm.common import extended, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Bytes of text that are composed at once.
GROUP_BYTES = 1 << 20
LONG = 2048
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Fixed values of the model format: what an unknown character costs beyond the worst piece, and how it is written.
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ ".encode()
START, UNSEEN, OTHER = -1, -3, -2
_AFTER_WORD = re.compile(rb"(?<=[^ ]) ")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + n]
            at += n


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + length[i] - 1 of all i, one after another."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)


class Normaliser:
    """Rewriting arcs of a character map, then blanks: collapsed if the model does so, and one in front."""

    def __init__(self, spec: dict):
        blob = spec.get(2, b"")
        self.units, self.strings = np.zeros(0, np.uint32), b""
        if blob:
            size = int(np.frombuffer(blob, "<u4", 1)[0])
            self.units, self.strings = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]
        elif spec.get(1, b"identity") not in (b"identity", b""):
            raise ValueError(f"a normaliser without its map: {spec[1]!r}")
        self.prefix, self.collapse = bool(spec.get(3, 1)), bool(spec.get(4, 1))

    def _longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and output of the longest rewriting arc at a position: a walk in the map's double array."""
        units, best = self.units, None
        node = self._child(int(units[0]))
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != raw[k]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                value = int(units[node]) & 0x7FFFFFFF
                best = k + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return best

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def __call__(self, raw: bytes) -> bytes:
        if len(self.units):
            text = raw.decode("utf-8", "replace")
            moved = {c for c in set(text) if self._longest(c.encode(), 0)}
            heads = {c for c in set(text) if c in moved or not c.isascii()}
            if heads:
                out, at = [], 0
                while at < len(raw):
                    width = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                    hit = self._longest(raw, at)
                    out.append(hit[1] if hit else raw[at : at + width])
                    at += hit[0] if hit else width
                raw = b"".join(out)
        raw = raw.replace(BLANK.encode(), b" ")
        return re.sub(rb" +", b" ", raw).strip(b" ") if self.collapse else raw


class Transducer:
    """A compiled model: arrays only. Within it, blanks stand for U+2581."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for key, value in _fields(model):
            if key == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, NORMAL)))
            elif key == 2:
                trainer = dict(_fields(value))
            elif key == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or trainer.get(24, 0) or any(k in (USER, UNUSED) for _, _, k in pieces):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces and with blanks in front are supported")
        self.normaliser = Normaliser(normaliser)
        self.prefix = self.normaliser.prefix
        ids = {p.replace(BLANK, " "): i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        by_byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.bytes = np.array([by_byte.get(b, -1) for b in range(256)], np.int32) if len(by_byte) == 256 else None
        out = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_TEXT if k == UNKNOWN else p.replace(BLANK, " ").encode() for p, _, k in pieces]
        self.out_size = np.array([len(o) for o in out], np.int32)
        self.out_start = np.r_[0, np.cumsum(self.out_size)[:-1]].astype(np.int64)
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.split_at_blanks = all(" " not in p.lstrip(" ") for p in ids)
        self.score = np.array([s for _, s, _ in pieces])
        self.cost = -self.score
        self.unknown_cost = UNKNOWN_PENALTY - min((self.score[i] for i in ids.values()), default=0.0)
        self.longest = max((len(p.encode()) for p in ids), default=1)
        if self.kind == BPE:
            ids = self._merges(ids)
        self._trie(ids)

    # --- compiling ---

    def _merges(self, ids: dict[str, int]) -> dict[str, int]:
        """Ranks, halves and pairs of the pieces that merging makes; returns those pieces."""
        rank = {p: -self.score[i] for p, i in ids.items()}
        n = len(self.score)
        self.rank, self.left, self.right = np.full(n, -1.0), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        made = {}
        for p, i in ids.items():
            parts = list(p)
            while len(parts) > 2:
                ranked = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
                if not ranked:
                    break
                _, k = min(ranked)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and parts[0] in ids and parts[1] in ids:
                self.rank[i], self.left[i], self.right[i] = rank[p], ids[parts[0]], ids[parts[1]]
            elif len(p) > 1:
                continue
            made[p] = i
        pairs = {(ids[p[:k]] << 32) | ids[p[k:]]: rank[p] for p in ids for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        keys = np.array(sorted(pairs), np.uint64)
        slots = 1 << max(4, int(2 * len(keys)).bit_length())
        home = (K.mix(keys) & np.uint64(slots - 1)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        self.pair_first = np.searchsorted(home[order], np.arange(slots + 1)).astype(np.int32)  # keys by slot
        self.pair_keys = np.r_[keys[order], np.uint64(2**64 - 1)]
        self.pair_rank = np.r_[np.array([pairs[int(k)] for k in keys[order]], float), np.inf]
        return made

    def _trie(self, ids: dict[str, int]) -> None:
        """The pieces as a double array: the child of a node for a byte is at base[node] ^ byte, if that slot is the node's."""
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for p, i in ids.items():
            node = 0
            for b in p.encode():
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][b]
            value[node] = i
        size, rng = 1 << max(9, (4 * len(children)).bit_length()), random.Random(0)
        used, self.base = bytearray(size), np.zeros(len(children), np.int64)
        slot = np.full(size, -1, np.int64)
        for node in sorted(range(len(children)), key=lambda k: -len(children[k])):
            kids = children[node]
            if kids:
                base = self._free_base(used, kids, rng, size)
                self.base[node] = base
                for b, child in kids.items():
                    used[base ^ b] = 1
                    slot[base ^ b] = node << 32 | child
        self.slot, self.value = slot, np.array(value, np.int32)

    @staticmethod
    def _free_base(used: bytearray, kids: dict, rng: random.Random, size: int) -> int:
        while True:
            base = rng.randrange(size)
            if not any(used[base ^ b] for b in kids):
                return base

    # --- weights ---

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; infinity where there is none."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        home = (K.mix(key) & np.uint64(len(self.pair_first) - 2)).astype(np.int64)
        at, end = self.pair_first[home], self.pair_first[home + 1]
        out = np.full(len(a), np.inf)
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.pair_keys[at[todo]] == key[todo]
            out[todo[hit]] = self.pair_rank[at[todo[hit]]]
            at[todo] += 1
            todo = todo[~hit & (at[todo] < end[todo])]
        return out

    def weigh(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The weight of piece b after piece a: 0 or infinity. Merges are undone, the latest first; at each step the two
        parts at the border stood side by side until one of them was merged away."""
        out = np.zeros(len(a))
        own = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[own], b[own]
        until_a, until_b = np.full(len(own), np.inf), np.full(len(own), np.inf)
        while len(own):
            rank = self._pair_rank(a, b)
            # equal ranks: the merge further left goes first
            joined = (rank < until_a) & (rank <= until_b)
            out[own[joined]] = np.inf
            go = ~joined & ((self.left[a] >= 0) | (self.left[b] >= 0))
            own, a, b, until_a, until_b = own[go], a[go], b[go], until_a[go], until_b[go]
            first = self.rank[a] > self.rank[b]
            until_a, until_b = np.where(first, self.rank[a], until_a), np.where(first, until_b, self.rank[b])
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    # --- composition and shortest paths ---

    def compose(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lattice of buf, which ends in a zero byte: the starts of characters, and arcs (from, to, piece), positions
        counted in characters. The piece OTHER stands for a character that no piece covers. Zero bytes separate texts;
        one in a text is such a character as well."""
        chars = np.flatnonzero((buf & 0xC0) != 0x80)
        number = np.cumsum((buf & 0xC0) != 0x80) - 1
        node, begin, at = np.zeros(len(chars), np.int64), chars, chars
        begins, ends, found = [], [], []
        while len(at):
            hit = self.slot[self.base[node] ^ buf[at]]
            ok = np.flatnonzero(hit >> 32 == node)
            node, begin, at = hit[ok] & 0xFFFFFFFF, begin[ok], at[ok] + 1
            piece = self.value[node]
            has = piece >= 0
            begins.append(begin[has])
            ends.append(at[has])
            found.append(piece[has])
        begin, end, piece = np.concatenate(begins), np.concatenate(ends), np.concatenate(found)
        begin, end = number[begin], np.where(end < len(buf), number[np.minimum(end, len(buf) - 1)], len(chars))
        bare = np.ones(len(chars), bool)
        bare[begin[end == begin + 1]] = False
        bare = np.flatnonzero(bare)
        return chars, np.r_[begin, bare], np.r_[end, bare + 1], np.r_[piece, np.full(len(bare), OTHER, np.int32)]

    @staticmethod
    def _spanned(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The positions that some arc has within it."""
        step = np.bincount(begin + 1, minlength=n + 2)[: n + 2] - np.bincount(end, minlength=n + 2)[: n + 2]
        return np.cumsum(step)[:n] > 0

    def shortest(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces on the shortest path of each part of buf between zero bytes at its end, and the byte each starts at."""
        chars, begin, end, piece = self.compose(buf)
        n = len(chars)
        cell = ~self._spanned(n, begin, end)  # where a part of the lattice begins
        first = np.maximum.accumulate(np.where(cell, np.arange(n), 0))
        last, back, dist = np.full(n + 1, UNSEEN, np.int32), np.zeros(n + 1, np.int64), np.full(n + 1, np.inf)
        level = end - first[begin]
        single = (level == 1) & (np.r_[cell, True][end])  # parts of one character: nothing to choose
        last[end[single]], back[end[single]] = piece[single], begin[single]
        rest = np.flatnonzero(~single)
        size = np.diff(np.r_[np.flatnonzero(cell), n])
        long = np.repeat(size, size) > LONG
        if long.any():
            own = rest[long[begin[rest]]]
            self._one_by_one(begin[own], end[own], piece[own], first, last, back)
            rest = rest[~long[begin[rest]]]
        width = (end - begin)[rest]
        most = int(width.max()) if len(rest) else 1
        key = level[rest] * (most + 1) - width  # by level, longer arcs first: arcs of one key lead to different positions
        key = key.astype(np.uint16 if len(key) and key.max() < 1 << 16 else np.int64)
        by = np.argsort(key, kind="stable")
        order, key = rest[by], key[by]
        begin, end, piece = begin[order], end[order], piece[order]
        turn = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(0, np.int64)
        at_cell = first[begin] == begin
        for lo, hi in zip(turn[:-1].tolist(), turn[1:].tolist(), strict=True):
            e = end[lo:hi]
            own = np.arange(lo, hi)
            if self.kind == BPE:  # one arc to a position has a finite weight
                own = own[last[e] == UNSEEN]
                e = end[own]
                before = np.where(at_cell[own], START, last[begin[own]])
                ok = self.weigh(before, piece[own]) == 0
                own, e = own[ok], e[ok]
            else:
                own_cost = np.where(piece[own] == OTHER, self.unknown_cost, self.cost[piece[own]])
                cost = np.where(at_cell[own], 0.0, dist[begin[own]]) + own_cost
                ok = cost < dist[e]
                own, e = own[ok], e[ok]
                dist[e] = cost[ok]
            last[e], back[e] = piece[own], begin[own]
        on = np.zeros(n + 1, bool)
        now = np.flatnonzero(np.r_[cell, True])[1:]  # ends of parts
        while len(now):
            on[now] = True
            now = back[now]
            now = now[~cell[now]]
        ends = np.flatnonzero(on)
        if (last[ends] == UNSEEN).any():
            raise ValueError("no path")
        return last[ends], chars[back[ends]]

    def _one_by_one(self, begin, end, piece, first, last, back) -> None:
        """Relaxes the arcs of long parts in order of their ends, longer arcs first."""
        order = np.lexsort((begin, end))
        known: dict[tuple[int, int], bool] = {}
        dist: dict[int, float] = {}
        for s, e, p, start in zip(begin[order].tolist(), end[order].tolist(), piece[order].tolist(), first[begin[order]].tolist(), strict=True):
            if self.kind == BPE:
                if last[e] != UNSEEN:
                    continue
                before = START if s == start else int(last[s])
                if (ok := known.get((before, p))) is None:
                    ok = known[before, p] = not self.weigh(np.array([before]), np.array([p]))[0]
                if not ok:
                    continue
            else:
                cost = (0.0 if s == start else dist[s]) + (self.unknown_cost if p == OTHER else self.cost[p])
                if cost >= dist.get(e, np.inf):
                    continue
                dist[e] = cost
            last[e], back[e] = p, s

    def _tokens(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that start at starts in buf, each followed by a zero byte, and how many each has."""
        piece, at = self.shortest(buf)
        stop = np.r_[starts[1:], len(buf)] - 1
        text = np.searchsorted(starts, at, "right") - 1
        inside = at < stop[text]  # not the zero byte after it
        piece, at, text = piece[inside], at[inside], text[inside]
        other = piece == OTHER
        if other.any():
            if self.bytes is None:  # a run of unknown characters is one unknown piece
                keep = ~(other & np.r_[False, other[:-1] & (text[1:] == text[:-1])])
                piece, text = np.where(other, self.unknown, piece)[keep], text[keep]
            else:
                size = np.ones(len(piece), np.int64)
                ends = np.r_[at[1:], 0]
                same = np.r_[text[1:] == text[:-1], False]
                size[other] = np.where(same, ends, stop[text])[other] - at[other]
                where = np.repeat(other, size)
                flat = np.repeat(piece, size)
                flat[where] = self.bytes[buf[_ragged(at[other], size[other])]]
                piece, text = flat, np.repeat(text, size)
        return piece.astype(np.int32), np.bincount(text, minlength=len(starts))

    def _group(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts that have their blank in front, and how many each has."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        buf = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        if not self.split_at_blanks:
            return self._tokens(buf, starts)
        cut = np.zeros(len(buf) + 1, bool)  # segments: blanks, and what follows up to the next ones
        blank = buf == 0x20
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[starts] = True
        cut[starts + sizes] = True  # the zero byte after a text is a segment of its own
        begin = np.flatnonzero(cut[:-1])
        length = np.diff(np.r_[begin, len(buf)])
        text = np.searchsorted(starts, begin, "right") - 1
        real = begin < (starts + sizes)[text]
        begin, length, text = begin[real], length[real], text[real]
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        hashes = K.Words(buf, begin, begin + length, np.array([0, len(begin)])).hashes()
        _, once, which = np.unique(hashes, return_index=True, return_inverse=True)
        own = length[once]
        packed = np.zeros(int((own + 1).sum()), np.uint8)
        at = np.cumsum(own + 1) - own - 1
        packed[_ragged(at, own)] = buf[_ragged(begin[once], own)]
        ids, counts = self._tokens(packed, at)
        offset = np.cumsum(counts) - counts
        return ids[_ragged(offset[which], counts[which])], np.bincount(text, counts[which], len(texts)).astype(np.int64)

    def _parts(self, text: bytes) -> Iterator[bytes]:
        """A normalised text in parts of about GROUP_BYTES, cut where no piece spans."""
        lo = 0
        while len(text) - lo > GROUP_BYTES:
            at = None
            if self.split_at_blanks and (hit := _AFTER_WORD.search(text, lo + GROUP_BYTES // 2, lo + GROUP_BYTES)):
                at = hit.start()
            size = GROUP_BYTES
            while at is None and lo + size < len(text):
                buf = np.frombuffer(text[lo : lo + size] + b"\0", np.uint8)
                chars, begin, end, _ = self.compose(buf)
                free = np.flatnonzero(~self._spanned(len(chars), begin, end))
                near = chars[free]
                near = near[(near > 0) & (near < size - self.longest - 4)]
                at, size = (lo + int(near[-1]) if len(near) else None), 2 * size
            if at is None:
                break
            yield text[lo:at]
            lo = at
        yield text[lo:]

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        parts, owner, ids, counts = [], [], [], np.zeros(len(texts), np.int64)
        size = 0

        def flush() -> None:
            nonlocal parts, owner, size
            if parts:
                own, n = self._group(parts)
                ids.append(own)
                np.add.at(counts, np.array(owner), n)
            parts, owner, size = [], [], 0

        for i, raw in enumerate(texts):
            normal = self.normaliser(raw) if raw else b""
            if not normal:
                continue
            normal = (b" " if self.prefix else b"") + normal
            for part in self._parts(normal) if len(normal) > GROUP_BYTES else (normal,):
                if size + len(part) > GROUP_BYTES:
                    flush()
                parts.append(part)
                owner.append(i)
                size += len(part) + 1
        flush()
        return np.concatenate([np.zeros(0, np.int32), *ids]), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts, one after another, and where each ends: the transducer inverted."""
        sizes = self.out_size[ids]
        raw = self.out[_ragged(self.out_start[ids], sizes)]
        ends = np.cumsum(np.r_[0, sizes])[np.cumsum(counts)]
        begins = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        if self.prefix and len(raw):
            some = begins < ends
            drop = begins[some][raw[begins[some]] == 0x20]
            keep = np.ones(len(raw), bool)
            keep[drop] = False
            ends = ends - np.searchsorted(drop, ends)
            raw = raw[keep]
        return raw.tobytes(), ends


def _encode(fst, keep: list[str], decode: bool):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in K.groups(texts, GROUP_BYTES):
                own = texts[lo:hi]
                flat, counts = fst.value.encode(own)
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), mask=np.array([x is None for x in own] + [False]))
                out = batch.slice(lo, hi - lo).select(keep)
                out = out.append_column("ids", pa.ListArray.from_arrays(offsets, pa.array(flat)))
                out = out.append_column("n_ids", pa.array(counts, pa.int64()))
                if decode:
                    raw, ends = fst.value.decode(flat, counts)
                    begins = [0, *ends[:-1].tolist()]
                    same = [(t or b"") == raw[a:b] for t, a, b in zip(own, begins, ends.tolist(), strict=False)]
                    out = out.append_column("round_trip", pa.array(same, pa.bool_()))
                yield out

    return run


def compiled(spark: SparkSession, model_path: str = MODEL):
    """The model, compiled on the driver and broadcast: its size is the vocabulary's (about 10 MB for 32,000 pieces)."""
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(Transducer(f.read()))


NEW = ("ids", "n_ids", "round_trip")


def with_ids(docs: DataFrame, model_path: str = MODEL, decode: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs with ids (array<int>), n_ids and, if asked, round_trip: whether decoding the ids gives the text again."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in NEW]
    shape = extended(docs.select(*keep).schema, "ids array<int>, n_ids long" + ", round_trip boolean" * decode)
    own = docs.select(*keep, *(["text"] if "text" not in keep else []))
    return own.mapInArrow(_encode(compiled(docs.sparkSession, model_path), keep, decode), shape)


def _decode(fst, keep: list[str]):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            counts = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
            raw, ends = fst.value.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
            yield batch.select(keep).append_column("decoded", pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False)))

    return run


def decoded(rows: DataFrame, model_path: str = MODEL) -> DataFrame:
    """rows with decoded: the text of their ids; null for null ids."""
    keep = [c for c in rows.columns if c.lower() != "decoded"]
    return rows.mapInArrow(_decode(compiled(rows.sparkSession, model_path), keep), extended(rows.select(*keep).schema, "decoded string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])

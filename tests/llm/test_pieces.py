"""The transducer against the sentencepiece library: BPE and unigram models, normalisers, texts of any shape."""

import random
import struct

import numpy as np
import pytest
import sentencepiece

from foliant.llm import pieces

ALPHABETS = ["abc ", "  \n\t\0x", "éèçñß你好世界 ▁", "\U0001f600́ a", "aeinrst .,!0123", "a", "th e", " ﬁＡⅣ①é ½"]
MODEL = open(pieces.MODEL, "rb").read()


def run(fst, texts):
    """Ids and decoded texts."""
    flat, counts = fst.encode([None if t is None else t.encode() for t in texts])
    at = np.r_[0, np.cumsum(counts)]
    raw, ends = fst.decode(flat, counts)
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])], [raw[a:b].decode() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def samples(n=150):
    r = random.Random(2)
    return ["".join(r.choice(a) for _ in range(r.randint(0, 50))) for a in ALPHABETS for _ in range(n)]


def test_bpe_agrees_with_the_library():
    library, fst, texts = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Transducer(MODEL), samples()
    ids, back = run(fst, texts)
    assert ids == library.encode(texts)
    assert all(b == t.replace("▁", " ") for b, t in zip(back, texts))


@pytest.mark.parametrize("part", ["你好世界一二三", "abcdefghij0123456789+/XYZ", "a", "word and blank ", " "])
def test_long_texts_are_cut_where_no_piece_spans(part, monkeypatch):
    monkeypatch.setattr(pieces, "GROUP_BYTES", 5000)
    library, fst, r = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Transducer(MODEL), random.Random(1)
    text = "".join(r.choice(part) for _ in range(40_000))
    assert run(fst, [text, None, "", text[:3]])[0] == [library.encode(text), [], [], library.encode(text[:3])]


def number(n):
    out = b""
    while True:
        n, b = n >> 7, n & 127
        out += bytes([b | (128 if n else 0)])
        if not n:
            return out


def field(key, value):
    if isinstance(value, int):
        return number(key << 3) + number(value)
    if isinstance(value, float):
        return number(key << 3 | 5) + struct.pack("<f", value)
    return number(key << 3 | 2) + number(len(value)) + value


def unigram(rule: str, collapse: int, by_byte: bool) -> tuple[bytes, dict]:
    """A model of the same pieces with other scores."""
    r, out, scores = random.Random(1), b"", {}
    own = [dict(pieces._fields(v)) for k, v in pieces._fields(MODEL) if k == 1]
    own = [p for p in own if by_byte or p.get(3, 1) != pieces.BYTE]
    for i, p in enumerate(own):
        scores[i] = -r.uniform(3, 14) if p.get(3, 1) == pieces.NORMAL else 0.0
        out += field(1, field(1, p[1]) + field(2, scores[i]) + field(3, p.get(3, 1)))
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    chars = dict(pieces._fields(next(v for k, v in pieces._fields(made) if k == 3))).get(2, b"")
    return out + field(2, field(3, 1) + field(35, int(by_byte))) + field(3, field(1, rule.encode()) + field(2, chars) + field(3, 1) + field(4, collapse) + field(5, 1)), scores


@pytest.mark.parametrize(("rule", "collapse", "by_byte"), [("identity", 0, True), ("nmt_nfkc", 1, True), ("nmt_nfkc", 0, False)])
def test_unigram_paths_are_as_short_as_the_librarys(rule, collapse, by_byte):
    model, scores = unigram(rule, collapse, by_byte)
    library, fst, texts = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model), samples(60)
    ids, back = run(fst, texts)
    want = library.encode(texts)
    assert sum(a != b for a, b in zip(ids, want)) < len(texts) / 5  # of equally short paths rounding picks the library's
    for own, other, text in zip(ids, want, back):
        assert abs(sum(scores[i] for i in own) - sum(scores[i] for i in other)) < 1e-3 and text == library.decode(other)


def test_models_that_are_not_supported():
    with pytest.raises(ValueError, match="supported"):
        pieces.Transducer(MODEL + field(1, field(1, b"<mark>") + field(3, pieces.USER)))

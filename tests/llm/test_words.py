"""Words, shingles and hashes of text batches against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from keyfold.llm import words as W
from keyfold.llm.runs import order_of

TEXTS = ["", None, "A b", "  lead and\ttrail\n\n", "éÀ ñ x ÉTÉ", "x" * 5000, "a\x0bb\x0cc\rd", "　  z", "one", "!!! ??", "word\x1cjoined"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", lower(t))


def test_words_are_the_pattern_s():
    for lo, hi, w in W.words_of(pa.array(TEXTS, pa.string())):
        got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.off[i] : w.off[i + 1]], w.ends[w.off[i] : w.off[i + 1]])] for i in range(hi - lo)]
        assert got == [split(t) for t in TEXTS[lo:hi]]


def test_pieces_cover_all_rows(monkeypatch):
    monkeypatch.setattr(W, "ROWS", 3)
    seen = [(lo, hi) for lo, hi, *_ in W.pieces(pa.array(TEXTS), 10)]
    assert seen[0][0] == 0 and seen[-1][1] == len(TEXTS)
    assert all(a[1] == b[0] for a, b in zip(seen, seen[1:], strict=False))
    assert list(W.pieces(pa.array([], pa.string()))) == []
    monkeypatch.undo()
    sliced = pa.array(TEXTS).slice(2, 4)
    (_, _, w), = W.words_of(sliced)
    assert list(w.counts) == [len(split(t)) for t in TEXTS[2:6]]


def test_hashes_follow_content():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcé") for _ in range(r.randrange(1, 9))) for _ in range(500)]
    texts = [" ".join(r.choices(vocabulary, k=50)) for _ in range(40)]
    by_word: dict = {}
    for _, _, w in W.words_of(pa.array(texts)):
        spans = W.Spans(w.data)
        assert np.array_equal(spans.hash(w.starts, w.ends), w.hashes)
        for a, b, h in zip(w.starts, w.ends, w.hashes):
            by_word.setdefault(bytes(w.data[a:b]), set()).add(int(h))
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)


def test_word_hashes_follow_content_at_any_length():
    r = random.Random(2)
    one = ["x" * n for n in range(1, 100)] + ["x" * n + "\0" for n in range(100)] + ["".join(r.choice("ab\0é") for _ in range(r.randrange(1, 80))) for _ in range(500)]
    by_word: dict = {}
    for shift in range(9):
        (_, _, w), = W.words_of(pa.array([" " * shift, *r.sample(one, len(one)), " ".join(one)]))
        for a, b, h in zip(w.starts, w.ends, W.word_hash(w.data, w.starts, w.ends), strict=True):
            by_word.setdefault(bytes(w.data[a:b]), set()).add(int(h))
    assert by_word.keys() == {x.encode() for x in one} and all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    assert not len(W.word_hash(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_order_of_is_the_stable_order():
    rng = np.random.default_rng(8)
    wide = rng.integers(0, 1 << 64, 3000, np.uint64)
    close = wide[:9].repeat(300) + rng.integers(0, 50, 2700, np.uint64)  # differ in their last bits only
    for x in (wide, close, wide[:0], wide[:1], wide[:50].repeat(40), rng.integers(0, 99, 2000, np.uint64), np.array([1 << 63, 0, (1 << 64) - 1, 0], np.uint64)):
        assert np.array_equal(order_of(x), np.argsort(x, kind="stable"))


def test_shingles_are_sets():
    texts = ["a b c d a b c d", "a b", "a", "", None, "a b c"]
    (_, _, w), = W.words_of(pa.array(texts, pa.string()))
    x, off = W.shingles(w.hashes, w.off, 3)
    assert list(np.diff(off)) == [4, 1, 1, 0, 0, 1]
    assert x[off[5]] in x[: off[1]] and x[off[1]] != x[off[2]]
    assert all(np.all(np.diff(x[a:b].astype(np.int64)) > 0) for a, b in zip(off, off[1:]))


def test_punctuation_classes_and_folding():
    (_, _, w), = W.words_of(pa.array(["Ab,c!! É9|", "ÑO ñO"]), W.WORD_PUNCT)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)][:6] == ["ab", ",", "c", "!!", "É9", "|"]
    (_, _, w), = W.words_of(pa.array(["ÑO!", "ño", "×"]), W.ALNUM)
    h = w.folded().hashes
    assert h[0] == h[1] != h[2]

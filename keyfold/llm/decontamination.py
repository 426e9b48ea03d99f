"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, in lower case, whatever stands between them.
Fixed masks pick some word positions of a window and ignore the rest, so a window with substituted words at ignored places keeps its hash.
Hashes of all windows of the test items meet those of all windows of the training texts; around each hit, text and item are aligned on its diagonal
and the longest stretch is found in which at least four of five words agree. A stretch of ``LEAST`` words at least (or of the whole item, if that is
shorter) is a leak. The masks leave no such stretch without a hit: a stretch of 24 words or more has a shorter one in it, those of 12 to 23 hold one of 12 words with 2
substitutions, 15 with 3 or 20 with 4 at most, and each way to place those leaves a mask whole. The test items are a stated query set: they come in blocks of bounded size, each
broadcast and held against all training texts in one narrow pass, so neither a text repeated in a third of the rows nor a
passage that all share makes a shuffle or a large group.

Items under ``LEAST`` words have masks for their length, which do the same for the whole item (from ``SHORT`` words on; shorter ones match nothing). Null and empty texts
match nothing; repeated rows match alike; ids may repeat; of stretches of equal length the first is reported. Texts of any length are taken whole. An empty table on either side
gives no leaks. ``leaks`` reads the key and text columns only, and ``without_leaks`` wraps the row, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keyfold.llm.store import as_rows, from_rows
from keyfold.llm.words import ALNUM, mix, seeded, words_of

#: 1: the position counts. Every choice of 2 of 12, 3 of 15 and 4 of 20 words leaves one of the masks whole at some place.
MASKS = ("11110111", "1100101111", "11011001011", "1111111", "110100101011", "11100010111", "111010100011")
#: For items of so many words: every choice of a fifth of them, rounded down, leaves one of the masks whole.
SHORT_MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    6: ("11111", "111101", "111011", "110111", "101111"),
    7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111"),
    11: ("1110111", "111001011", "1011111", "111111"),
}
SAME, OF = 4, 5  # so many of so many words agree, at least
LEAST = 12
SHORT = min(SHORT_MASKS)
BLOCK_WORDS = 1 << 19  # words of test items at once
CHUNK = 1 << 20  # hits at once
_FILTER_BITS = 22
_MULT = seeded(64, 4242)


def seeds(h: np.ndarray, off: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first words) of all windows of each text under a mask."""
    room = np.maximum(np.diff(off) - len(mask) + 1, 0)
    at = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room) + np.repeat(off[:-1], room)
    value = np.full(len(at), hash_of_mask(mask), np.uint64)
    for j, used in enumerate(mask):
        if used == "1":
            value += h[at + j] * _MULT[j]
    return mix(value), at


def hash_of_mask(mask: str) -> int:
    return int(mask, 2) * 2 + 1


class Items:
    """A block of test items with their seeds in hash order and a small bit table before them."""

    def __init__(self, ids: list, h: np.ndarray, off: np.ndarray):
        self.ids, self.h, self.off = ids, h, off
        size = np.diff(off)
        self.masks = {m: size >= LEAST for m in MASKS}
        for n in np.unique(size[(size >= SHORT) & (size < LEAST)]):
            for m in SHORT_MASKS[int(n)]:
                self.masks[m] = self.masks.get(m, False) | (size == n)
        self.seeds = {}
        for m, use in self.masks.items():
            value, at = seeds(h, off, m)
            item = np.searchsorted(off, at, "right") - 1
            value, at, item = value[use[item]], at[use[item]], item[use[item]]
            order = np.argsort(value, kind="stable")
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[value >> np.uint64(64 - _FILTER_BITS)] = True
            self.seeds[m] = value[order], at[order], item[order], table

    def hits(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Distinct (row, item, diagonal) of all hits; the diagonal is the word of the row at which the item begins.

        Windows are held against the item's by ``CHUNK`` hits at a time and only distinct diagonals are kept, of which a text and an item have no more than
        words, so a text that repeats one word needs no more room than any other.
        """
        span = len(h) + len(self.h) + 1
        found = np.zeros(0, np.int64)
        for m, (value, at, item, table) in self.seeds.items():
            own, first = seeds(h, off, m)
            near = np.flatnonzero(table[own >> np.uint64(64 - _FILTER_BITS)])
            own, first = own[near], first[near]
            lo, hi = np.searchsorted(value, own), np.searchsorted(value, own, "right")
            some = np.flatnonzero(hi > lo)
            first, lo, n = first[some], lo[some], (hi - lo)[some]
            many = np.cumsum(n)
            done, begin = 0, 0
            while begin < len(n):
                end = max(begin + 1, int(np.searchsorted(many, done + CHUNK, "right")))
                size = n[begin:end]
                to = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[begin:end], size)
                start = np.repeat(first[begin:end], size)
                row, it = np.searchsorted(off, start, "right") - 1, item[to]
                code = (row * len(self.ids) + it) * span + (start - off[row] - (at[to] - self.off[it])) + len(self.h)
                found = np.unique(np.concatenate([found, np.unique(code)]))
                done, begin = int(many[end - 1]), end
        pair, diagonal = found // span, found % span - len(self.h)
        return np.stack([pair // max(1, len(self.ids)), pair % max(1, len(self.ids)), diagonal], 1)

    def leak(self, doc: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int, int] | None:
        """(first word in the text, in the item, words, agreeing words) of the longest stretch on a diagonal, if it is long enough."""
        own = self.h[self.off[item] : self.off[item + 1]]
        a, b = max(0, -diagonal), min(len(own), len(doc) - diagonal)
        least = min(LEAST, len(own))
        if b - a < least:
            return None
        same = own[a:b] == doc[a + diagonal : b + diagonal]
        gain = np.concatenate([[0], np.cumsum(np.where(same, OF - SAME, -SAME))])
        above = np.maximum.accumulate(gain[::-1])  # the greatest gain from the end down to each place
        ends = len(gain) - 1 - np.searchsorted(above, gain)  # the last place with no less gain than each
        begin = int(np.argmax(ends - np.arange(len(gain))))
        end = int(ends[begin])
        if end - begin < least:
            return None
        while end - begin > least and not same[end - 1]:
            end -= 1
        while end - begin > least and not same[begin]:
            begin += 1
        return a + begin + diagonal, a + begin, end - begin, int(same[begin:end].sum())


def blocks(items: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The test items in blocks of at most BLOCK_WORDS words (an item at least)."""
    ids, hashes, sizes, total = [], [], [], 0

    def made() -> Items:
        return Items(list(ids), np.concatenate(hashes), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    for r in items.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        for _, _, w in words_of(pa.array([r[text]], pa.large_string()), ALNUM):
            if total and total + len(w.starts) > BLOCK_WORDS:
                yield made()
                ids.clear(), hashes.clear(), sizes.clear()
                total = 0
            ids.append(r[key]), hashes.append(w.folded().hashes), sizes.append(len(w.starts))
            total += len(w.starts)
    if total:
        yield made()


def find(sent: Broadcast, column: pa.Array) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
    """(row, item id, stretch) of each leak in a batch of texts: the longest agreement for each row and item."""
    items: Items = sent.value
    for lo, _, w in words_of(column, ALNUM):
        h = w.folded().hashes
        best: dict = {}
        for row, item, diagonal in items.hits(h, w.off).tolist():
            if best.get((row, item), (0, 0, 0, 0))[3] == items.off[item + 1] - items.off[item]:  # all of the item is in the text
                continue
            leak = items.leak(h[w.off[row] : w.off[row + 1]], item, diagonal)
            if leak and leak[3] > best.get((row, item), (0, 0, 0, 0))[3]:
                best[row, item] = leak
        for (row, item), leak in sorted(best.items()):
            yield lo + int(row), items.ids[item], leak


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, n_same of each leak: a row for each document and item."""
    spark = docs.sparkSession
    out = None
    for block in blocks(items, item_key, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0)
                rows = [(ids[r].as_py(), i, *leak) for r, i, leak in find(sent, b.column(1))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_same"])

        part = docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_same long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_same long")
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a leak: one narrow pass a block of items."""
    for block in blocks(items, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        rows = as_rows(docs)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = np.zeros(b.num_rows, np.int64)
                for row, _, _ in find(sent, b.column(0).field(text)):
                    n[row] += 1
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["row", "leaks"])

        docs = from_rows(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("leaks", LongType())])).where("leaks = 0"))
    return docs

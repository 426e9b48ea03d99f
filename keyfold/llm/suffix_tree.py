"""Language-model scoring by a probabilistic suffix tree over words.

Symbols are words (lower-cased A-Z) and an end after each text. The root predicts by add-half counts over all training tokens. A context of one to ``DEPTH`` words
is a node if it passes a divergence test: its next-symbol distribution must explain its own occurrences better than that of its
longest kept suffix by more than ``GAIN`` nats in all. A node lists the symbols it has seen often enough, discounted; the
rest of its mass goes to all other symbols in the proportions of its longest kept suffix, so each distribution sums to 1.
A text is scored at each position in the longest node that is a suffix of what came before.

Every sequence that occurs ``SEEN`` times is listed, however small its share of the corpus. The tree is a table that grows with the corpus, made level by level: tasks add up
sequences whose first and last words are listed without the other end and that a count by leading bits doesn't rule out (bit tables of fixed size tell most that are not, and only save work), sums over all tasks decide,
a join with the level before gives what shorter contexts predict, and one combining aggregate by context makes the tests. Neither the order of the rows nor their layout changes a tree.

A score is a sum over positions and context lengths: for a node what it leaves to other symbols, for a symbol it lists the difference to that. So a text's score is the sum of what its
contexts and sequences have in one table of values. The ``HEAD`` values of the most frequent are broadcast, the others meet the texts that use them by range of keys, a third of the texts at a time. Root counts are exact for every
word: the most frequent ``TABLE`` words are broadcast, the others are joined.

Texts of any length are taken whole. Only the columns named are read, so others may have any name. Null and empty texts are one end. Ids may repeat (rows are told apart by their place in the run); an empty table gives an empty one; without training
rows, N and V are 0 and the root is uniform over the one unknown word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.runs import from_planes, order_of, pack_ascending, planes, unpack_ascending
from keyfold.llm.store import discard, written
from keyfold.llm.words import Words, mix, seeded, word_hash, words_of

DEPTH = 3
LEAST = 0.0  # share of all training tokens that a listed sequence has at least
SEEN = 3.0  # and how often it occurs at least
GAIN = 12.0
DISCOUNT = 0.5
TABLE = 1 << 19
HEAD = 1 << 20
FLUSH = 4 << 20  # a task adds up half as many tokens before it hands their counts on, and asks for a fourth as many values at once
SLICES = 3  # of the texts, which ask for far values one after the other
END = np.uint64(0x5EED_0F_7E27)
_BITS = 28  # a bit table has 2**28 bits
_BASE = seeded(1, 4711)[0]
_SALT = seeded(2 * DEPTH + 2, 815)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end after each text, where each text begins)."""
    off = w.off + np.arange(len(w.off))
    out = np.full(int(off[-1]), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[off[1:] - 1] = False
    out[inside] = word_hash(w.data, w.starts, w.ends)
    return out, off


class Tree(NamedTuple):
    words: np.ndarray  # hashes of the listed words that are broadcast, ascending
    count: np.ndarray  # their training counts
    total: int
    distinct: int
    kept: np.ndarray  # how many nodes there are of each context length
    keys: np.ndarray  # of the broadcast values, ascending
    values: np.ndarray
    bits: np.ndarray  # bit table of the keys of all values
    far: DataFrame  # key, value: all other values


def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in ascending keys, -1: absent."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def sequences(h: np.ndarray, depth: int) -> list[np.ndarray]:
    """For lengths 1 to depth + 1: hashes of the sequences that end at each token (in the first few places without meaning)."""
    out = [h]
    for _ in range(depth):
        longer = h.copy()
        longer[1:] += out[-1][:-1] * _BASE
        out.append(longer)
    return out


def contexts(h: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """For context lengths 1 to depth: the places of tokens that have such a context, which has no end but as its first symbol."""
    at = np.arange(len(h))
    last_end = np.maximum.accumulate(np.where(h == END, at, 0))
    for n in range(1, depth + 1):
        yield np.flatnonzero(at[1:] - last_end[:-1] >= n) + 1


def node_key(ctx: np.ndarray, n: int) -> np.ndarray:
    return mix(ctx + _SALT[2 * n])


def entry_key(seq: np.ndarray, n: int) -> np.ndarray:
    return mix(seq + _SALT[2 * n + 1])


def bits_of(keys: np.ndarray) -> pa.RecordBatch:
    """w, b: the words of a bit table that have bits of some hashes."""
    at = np.unique(keys >> np.uint64(64 - _BITS))
    word = at >> np.uint64(6)
    first = np.flatnonzero(np.diff(word, prepend=np.uint64(1 << 63)))
    bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
    return pa.record_batch([pa.array(word[first].astype(np.int32)), pa.array(bits.view(np.int64))], ["w", "b"])


def table_of(rows: DataFrame) -> np.ndarray:
    """The bit table of words w, b; none twice. It goes by way of a table, whose job deletes its shuffle files when it ends."""
    rows = written(rows, "bits")
    found = rows.toArrow()
    discard(rows)
    table = np.zeros(1 << (_BITS - 6), np.uint64)
    table[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return table


def bit_table(keys: DataFrame) -> np.ndarray:
    """The bits of some hashes (the only column), of fixed size however many they are."""
    return bits_by_range(keys, lambda b: [np.asarray(b.column(0)).view(np.uint64)], _BITS, 1)


def maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set."""
    at = keys >> np.uint64(64 - _BITS)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """w (hash), n: training tokens."""

    def merge(group: pa.Table) -> pa.Table:
        x, n = merged(group)
        return pa.table([pa.array(x.view(np.int64)), pa.array(n)], ["w", "n"])

    runs = runs_by_range(docs.select(text), lambda b: (tokens(w)[0] for _, _, w in words_of(b.column(0))), 64)
    return runs.groupBy("r").applyInArrow(merge, "w long, n long")


def most_frequent(counts: DataFrame, limit: int, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the highest counts n, as many whole counts as fit into the limit, and all others; ``key`` decides if not even the highest ones do."""
    sizes = counts.groupBy(F.when(F.col("n") < 4096, F.col("n")).otherwise(F.lit(4096)).alias("n")).count().collect()
    room, least = limit, 4097
    for n, c in sorted(map(tuple, sizes), reverse=True):
        if c > room:
            break
        room, least = room - c, n
    if least <= 4096:
        return counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
    top = counts.orderBy(F.desc("n"), key).limit(limit)
    return top, counts.join(top.select(key), key, "left_anti")


def table_words(counts: DataFrame, limit: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """The words of the highest counts, by hash."""
    found = most_frequent(counts, limit, "w")[0].toArrow()
    w, n = found["w"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(w)
    return w[order], n[order]


def ranges(spark: SparkSession) -> int:
    """How many leading bits of a hash part the runs that tasks hand on: a range or two for each shuffle partition."""
    return max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def by_range(x: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranges, where each begins, with the end) of ascending integers."""
    own = x >> np.uint64(shift)
    cuts = np.append(np.flatnonzero(np.diff(own, prepend=np.uint64(1 << 63))), len(x))
    return own[cuts[:-1]].astype(np.int32), cuts


def repeated(docs: DataFrame, text: str, places: Callable, length: int, least: float) -> np.ndarray:
    """The bits of all sequences that ``places`` finds ``least`` times. They count by their leading bits, 2**32 values for each range: the few that share a value only seem more frequent than they are."""
    return bits_by_range(docs.select(text), lambda b: (seqs[length][at] for seqs, at in places(b)), min(64, 32 + ranges(docs.sparkSession)), least)


def runs_by_range(rows: DataFrame, hashes: Callable, bits: int) -> DataFrame:
    """r, x: the ``bits`` leading bits of hashes as sorted runs by range, with how often each task has them; ``hashes`` gives arrays of hashes for each batch of rows. So a value moves as a few bytes and not as a row."""
    high = ranges(rows.sparkSession)
    cut, shift = np.uint64(64 - bits), bits - high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            r, cuts = by_range(x, shift)
            return pa.record_batch([pa.array(r), pa.array([pack_ascending(x[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["r", "x"])

        for b in batches:
            for x in hashes(b):
                kept.append(x >> cut)
                size += len(x)
                if size > FLUSH // 2:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return rows.mapInArrow(run, "r int, x binary")


def merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of all runs of a range."""
    runs = [unpack_ascending(raw) for raw in group.column("x").to_pylist()]
    x = np.concatenate([r[0] for r in runs])
    order = order_of(x)
    x, n = x[order], np.concatenate([r[1] for r in runs])[order]
    first = np.flatnonzero(np.diff(x, prepend=~x[:1]) != 0)
    return x[first], np.add.reduceat(n, first)


def bits_by_range(rows: DataFrame, hashes: Callable, bits: int, least: float) -> np.ndarray:
    """The bits of all values of ``bits`` leading bits that the hashes have ``least`` times; ``hashes`` gives arrays of them for each batch of rows. One task merges a range; values seen too seldom, which most sequences are, go no further."""
    cut = np.uint64(64 - bits)

    def merge(group: pa.Table) -> pa.Table:
        x, n = merged(group)
        return pa.Table.from_batches([bits_of(x[n >= least] << cut)])

    found = runs_by_range(rows, hashes, bits).groupBy("r").applyInArrow(merge, "w int, b long")
    return table_of(found)  # a range has whole words of the table


def next_level(docs: DataFrame, text: str, before: DataFrame, length: int, least: float) -> DataFrame:
    """ctx, suf, n: contexts of a length with a next symbol, told by the sequence without its first word (listed in ``before``), that occur ``least`` times."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(bit_table(before.select("key")))

    def places(b: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(sequences, where those of the level end that may be listed)."""
        for _, _, w in words_of(b.column(0)):
            h = np.concatenate([[END], tokens(w)[0]])
            seqs = sequences(h, length)
            known = maybe(sent.value, seqs[length - 1])
            *_, at = contexts(h, length)
            yield seqs, at[known[at] & known[at - 1]]

    often = context.broadcast(repeated(docs, text, places, length, least))
    high = ranges(docs.sparkSession)
    names = ["r", "x", "ctx", "suf"][: 3 if length == 1 else 4]  # of two words the first tells the second

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def flush() -> pa.RecordBatch:
            key, *ends = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order = order_of(key)
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
            x, n = key[first], np.diff(np.append(first, len(key)))
            r, cuts = by_range(x, 64 - high)
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            cols = [pa.array([pack_ascending(x[a:b], n[a:b]) for a, b in spans], pa.binary())]
            for end in (x[order[first]] for x in ends):
                cols.append(pa.array([end[a:b].tobytes() for a, b in spans], pa.binary()))
            return pa.record_batch([pa.array(r), *cols], names)

        for b in batches:
            for seqs, at in places(b):
                at = at[maybe(often.value, seqs[length][at])]
                kept.append((seqs[length][at], seqs[length - 1][at - 1], seqs[length - 1][at])[: len(names) - 1])
                n += len(at)
                if n > FLUSH // 2:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        runs = [unpack_ascending(raw) for raw in group.column("x").to_pylist()]
        key = np.concatenate([r[0] for r in runs])
        order = order_of(key)
        key, n = key[order], np.concatenate([r[1] for r in runs])[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        n = np.add.reduceat(n, first)
        first, n = first[n >= least], n[n >= least]
        ctx, *suf = (np.frombuffer(b"".join(group.column(name).to_pylist()), np.uint64)[order[first]] for name in names[2:])
        suf = suf[0] if suf else key[first] - ctx * _BASE
        return pa.table([pa.array(ctx.view(np.int64)), pa.array(suf.view(np.int64)), pa.array(n)], ["ctx", "suf", "n"])

    runs = docs.select(text).mapInArrow(run, ", ".join(f"{c} {'int' if c == 'r' else 'binary'}" for c in names))
    listed = written(runs.groupBy("r").applyInArrow(merge, "ctx long, suf long, n long"), "listed")  # so the shuffle files of the counts are gone when those of the join come
    sent.destroy()
    often.destroy()
    out = written(listed.join(before.select(F.col("key").alias("suf"), "sym", "root", "v"), "suf"), "level")
    discard(listed)
    return out


def grow(level: DataFrame, before: DataFrame, gain: float) -> DataFrame:
    """ctx, seen, rest: the contexts of a level that pass the divergence test. Sums combine before the shuffle."""
    base = F.col("root") + F.col("v")
    by = level.groupBy("ctx").agg(F.sum("n").alias("mass"), F.count("*").alias("symbols"), F.sum(F.col("n") * (F.log(F.col("n") - DISCOUNT) - base)).alias("better"), F.sum(F.exp(base)).alias("under"))
    by = by.join(before.select(F.col("key").alias("ctx"), F.col("n").alias("count")), "ctx").withColumn("seen", F.greatest("count", "mass"))
    listed = (F.col("mass") - DISCOUNT * F.col("symbols")) / F.col("seen")
    by = by.withColumn("rest", F.log(F.greatest(1 - listed, F.lit(1e-9))) - F.log(F.greatest(1 - F.col("under"), F.lit(1e-9))))
    better = F.col("better") - F.col("mass") * F.log("seen") + (F.col("seen") - F.col("mass")) * F.col("rest")
    return by.where(better > gain).select("ctx", "seen", "rest")


def with_keys(level: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """The level with its sequences' hashes (key), the values v of its symbols, relative to the root, and where the context is a node the key and value that they have in the table of values."""
    v = F.log(F.col("n") - DISCOUNT) - F.log("seen") - F.col("root")
    own = level.join(nodes, "ctx", "left").select("ctx", "sym", "root", "n", F.coalesce(v, "v").alias("v"), (v - F.col("v") - F.col("rest")).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ctx, sym = (np.asarray(b.column(i)).view(np.uint64) for i in (0, 1))
            key = ctx * _BASE + sym
            cols = [pa.array(key.view(np.int64)), pa.array(entry_key(key, length).view(np.int64)), *b.columns[1:]]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "entry", "sym", "root", "n", "v", "value"])

    return written(own.mapInArrow(run, "key long, entry long, sym long, root double, n long, v double, value double"), "sequences")


def node_values(nodes: DataFrame, length: int) -> DataFrame:
    """key, value, n of the nodes in the table of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = node_key(np.asarray(b.column(0)).view(np.uint64), length)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(2), b.column(1)], names=["key", "value", "n"])

    return nodes.mapInArrow(run, "key long, value double, n long")


def fit(docs: DataFrame, text: str = "text", least: float = LEAST, depth: int = DEPTH, limit: int = TABLE, gain: float = GAIN, head: int = HEAD) -> tuple[Tree, tuple[np.ndarray, np.ndarray], DataFrame]:
    """The tree, the table of the most frequent words (hashes, counts), and all words' counts as a written table."""
    counts = written(word_counts(docs, text), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    words, count = table_words(counts, limit)
    least = max(SEEN, least * total)
    size = F.lit(float(np.log(total + 0.5 * (distinct + 1))))
    before = counts.where(F.col("n") >= F.lit(least)).select(F.col("w").alias("key"), F.col("w").alias("sym"), (F.log(F.col("n") + 0.5) - size).alias("root"), F.lit(0.0).alias("v"), "n")
    values, used, kept = [], [], []
    for length in range(1, depth + 1):
        level = next_level(docs, text, before, length, least)
        nodes = written(grow(level, before, gain), "nodes")
        before = with_keys(level, nodes, length)
        discard(level)
        kept.append(nodes.count())
        values += [node_values(nodes, length), before.where("value IS NOT NULL").select(F.col("entry").alias("key"), "value", "n")]
        used += [nodes, before]
    table = values[0]
    for more in values[1:]:
        table = table.unionByName(more)
    table = written(table, "values")
    discard(*used)
    top, far = most_frequent(table, head, "key")
    near = top.select("key", "value").toArrow()
    keys, v = near["key"].to_numpy().view(np.uint64), near["value"].to_numpy()
    order = np.argsort(keys)
    bits = bit_table(table.select("key"))
    far = far.select("key", "value")
    far.written_to = table.written_to
    often = count >= least
    return Tree(words[often], count[often], total, distinct, np.array(kept), keys[order], v[order], bits, far), (words, count), counts


def find_mixed(starts: np.ndarray, keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``find`` for evenly spread hashes: from where their leading bits begin, a step or two."""
    own = x >> np.uint64(65 - len(starts).bit_length())
    at, end = starts[own], starts[own + np.uint64(1)]
    out, open_ = np.full(len(x), -1), np.flatnonzero(at < end)
    at = at[open_]
    while len(open_):
        same = keys[at] == x[open_]
        out[open_[same]] = at[same]
        more = ~same & (at + 1 < end[open_])
        open_, at = open_[more], at[more] + 1
    return out


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where each value of the leading bits begins in ascending hashes, with one more entry at the end; about as many values as hashes."""
    bits = max(1, len(keys).bit_length())
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def looked_up(keys: np.ndarray, values: np.ndarray, bits: np.ndarray, starts: np.ndarray, h: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums of the broadcast values at each token, places, keys) with the keys that may have other values."""
    out, places, others = np.zeros(len(h)), [], []

    def look(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        there = maybe(bits, key)
        at, key = at[there], key[there]
        found = find_mixed(starts, keys, key)
        hit = found >= 0
        out[at[hit]] += values[found[hit]]
        places.append(at[~hit])
        others.append(key[~hit])
        return at

    seqs = sequences(h, depth)
    for n, at in enumerate(contexts(h, depth), 1):
        nodes = look(at, node_key(seqs[n - 1][at - 1], n))
        look(nodes, entry_key(seqs[n][nodes], n))
    return out, np.concatenate(places), np.concatenate(others)


def gains(tree: Tree, h: np.ndarray) -> np.ndarray:
    """ln P(token | longest node) - ln P(token | root), as far as broadcast values tell it, at each token but the first, which is the end of the text before."""
    return looked_up(tree.keys, tree.values, tree.bits, starts_of(tree.keys), h, len(tree.kept))[0][1:]


def far_runs(far: DataFrame) -> DataFrame:
    """r, key, value: the rows of ``far`` (key, value) as sorted runs by range."""
    high = ranges(far.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            key, value = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order = order_of(key)
            key, value = key[order], value[order]
            r, cuts = by_range(key, 64 - high)
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            cols = [pa.array(r), pa.array([pack_ascending(key[a:b], np.ones(b - a, np.int64)) for a, b in spans], pa.binary()), pa.array([value[a:b].tobytes() for a, b in spans], pa.binary())]
            return pa.record_batch(cols, ["r", "key", "value"])

        for b in batches:
            kept.append((np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1))))
            size += b.num_rows
            if size > FLUSH // 4:
                yield flush()
                size = 0
        if size:
            yield flush()

    return far.select("key", "value").mapInArrow(run, "r int, key binary, value binary")


def far_sums(parts: DataFrame, far: DataFrame) -> DataFrame:
    """uid, added: the sum of the values in ``far`` (key, value) that each row of ``parts`` asks for."""
    return sums_of_runs(parts, far_runs(far))


def sums_of_runs(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """``far_sums`` of the runs of all far values. Tasks hand on sorted runs of keys by range, each key once with the rows that ask for it.

    A range's answer to a run is one row as well, and all answers to a task's run meet by its number (flush), so no row moves for each text and range.
    """
    high = ranges(parts.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, own = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal own
            own += 1
            uid, key = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order = order_of(key)
            uid, key = uid[order], key[order]
            first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
            x, n, edge = key[first], np.diff(np.append(first, len(key))), np.append(first, len(key))
            r, cuts = by_range(x, 64 - high)
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            cols = [pa.array(r), pa.array(np.full(len(r), own)), pa.array([pack_ascending(x[a:b], n[a:b]) for a, b in spans], pa.binary()), pa.array([planes(uid[edge[a] : edge[b]]) for a, b in spans], pa.binary())]
            return pa.record_batch(cols, ["r", "flush", "x", "who"])

        for b in batches:
            lists = b.column(1)
            key = np.asarray(lists.flatten()).view(np.uint64)
            kept.append((np.repeat(np.asarray(b.column(0)), np.asarray(lists.value_lengths())), key))
            size += len(key)
            if size > FLUSH // 4:
                yield flush()
                size = 0
        if size:
            yield flush()

    def answer(asked: pa.Table, found: pa.Table) -> pa.Table:
        key = np.concatenate([np.zeros(0, np.uint64), *(unpack_ascending(x)[0] for x in found.column("key").to_pylist())])
        value = np.concatenate([np.zeros(0), *(np.frombuffer(x) for x in found.column("value").to_pylist())])
        order = order_of(key)
        key, value = key[order], np.append(value[order], 0.0)  # place -1: no value
        who, sums = [], []
        for raw, ids in zip(asked.column("x"), asked.column("who"), strict=True):
            x, n = unpack_ascending(raw.as_py())
            uid, back = np.unique(from_planes(ids.as_py()), return_inverse=True)
            who.append(planes(uid))
            sums.append(np.bincount(back, np.repeat(value[find(key, x)], n), len(uid)).tobytes())
        return pa.table([asked.column("flush"), pa.array(who, pa.binary()), pa.array(sums, pa.binary())], ["flush", "who", "sums"])

    def total(answers: pa.Table) -> pa.Table:
        uid = np.concatenate([from_planes(x) for x in answers.column("who").to_pylist()])
        uid, back = np.unique(uid, return_inverse=True)
        added = np.bincount(back, np.concatenate([np.frombuffer(x) for x in answers.column("sums").to_pylist()]), len(uid))
        return pa.table([pa.array(uid), pa.array(added)], ["uid", "added"])

    asked = parts.where(F.size("far") > 0).select("uid", "far").mapInArrow(ask, "r int, flush long, x binary, who binary")
    found = asked.groupBy("r").cogroup(runs.groupBy("r")).applyInArrow(answer, "flush long, who binary, sums binary")
    found = found.groupBy("flush").applyInArrow(total, "uid long, added double")
    return written(found.groupBy("uid").agg(F.sum("added").alias("added")), "added")


def score(docs: DataFrame, tree: Tree, table: tuple[np.ndarray, np.ndarray], counts: DataFrame, keys: list[Column], text: str = "text", once: bool = False) -> DataFrame:
    """The key columns, n_tokens, n_known, train_tokens, base_score, score of every row. ``once``: the tree scores nothing else, so its table of far values may go."""
    sent = docs.sparkSession.sparkContext.broadcast((tree.keys, tree.values, tree.bits, starts_of(tree.keys), len(tree.kept), *table, starts_of(table[0])))
    rows = docs.select(F.struct(*keys).alias("key"), F.col(text).alias("t"))
    runs = written(far_runs(tree.far), "runs")
    if once:
        discard(tree.far)
    slices = 1 if runs.isEmpty() else SLICES
    schema = f"key {rows.schema['key'].dataType.simpleString()}, uid long, n_tokens long, n_known long, part double, gain double, rare array<bigint>, times array<bigint>, far array<bigint>"

    def run(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        (keys, values, bits, starts, depth, words, count, words_from), uid = sent.value, number << 56 | TaskContext.get().partitionId() << 36
        log_count = np.log10(count + 0.5)
        for b in batches:
            for lo, hi, w in words_of(b.column(1)):
                h, off = tokens(w)
                n, row = np.diff(off), np.repeat(np.arange(hi - lo), np.diff(off))
                at = find_mixed(words_from, words, h)
                known = at >= 0
                part = np.bincount(row[known], log_count[at[known]], hi - lo).astype(float)
                near, at_far, key_far = looked_up(keys, values, bits, starts, np.concatenate([[END], h]), depth)
                gain = np.bincount(row, near[1:], hi - lo)
                by = order_of(at_far.astype(np.uint64))
                far_off = np.searchsorted(row[at_far[by] - 1], np.arange(hi - lo + 1)).astype(np.int32)
                far_keys = pa.ListArray.from_arrays(pa.array(far_off), pa.array(key_far[by].view(np.int64)))
                far = np.flatnonzero(~known)
                order = far[np.lexsort((h[far], row[far]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(order)))
                edges = np.searchsorted(row[order][first], np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))) for x in (np.ascontiguousarray(h[order][first]), times)]
                cols = [b.column(0).slice(lo, hi - lo), pa.array(uid + np.arange(hi - lo)), pa.array(n), pa.array(np.bincount(row[known], minlength=hi - lo)), pa.array(part), pa.array(gain), *lists, far_keys]
                uid += hi - lo
                yield pa.RecordBatch.from_arrays(cols, names=["key", "uid", "n_tokens", "n_known", "part", "gain", "rare", "times", "far"])

    done = []
    for number in range(slices):  # what texts ask for takes more room than the texts: there is only a slice of it at a time
        some = rows.where(F.pmod(F.xxhash64("t"), F.lit(slices)) == number) if slices > 1 else rows
        asking = written(some.mapInArrow(partial(run, number=number), schema), "asking")
        done.append((written(asking.drop("far"), "parts"), sums_of_runs(asking, runs)))
        discard(asking)
    sent.destroy()
    discard(runs)
    parts, added = (reduce(DataFrame.unionAll, x) for x in zip(*done, strict=True))
    rare = parts.where(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("w"), F.col("x.times").alias("times"))
    seen = rare.join(counts, "w", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    size = F.lit(float(np.log10(tree.total + 0.5 * (tree.distinct + 1))))
    base = F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * size
    out = parts.drop("rare", "times").join(seen, "uid", "left").join(added, "uid", "left")
    gain = (F.col("gain") + F.coalesce("added", F.lit(0.0))) / float(np.log(10))
    return out.select("key.*", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + gain).alias("score"))


def score_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the rows that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    tree, table, counts = fit(docs.where(~held))
    return score(docs, tree, table, counts, [F.col("doc_id"), held.alias("held_out")], once=True)

"""N-gram Jaccard join by token-combination prefixes, and the classes of texts that its links connect.

A text is the set of its distinct k-word shingles; two link when 100 * intersection >= percent * union. Rows with equal sets form one node from the start.
Shingles are ordered globally, rare ones first. Two linked sets share their first common shingle within the prefix of either. If it
is rare, both are indexed by it alone. If it is frequent, all common shingles are: then either set has at most a known number
of frequent shingles that the other lacks, which part the common ones into at most so many runs and one more. Prefixes are extended until they hold so many common
shingles that one run has as many as a combination needs, so sets whose rare shingles are few enough are indexed by combinations of neighbouring frequent shingles:
of two from a frequent shingle on, of three from one that more than ``CROWDED`` texts have (where ``percent`` allows prefixes so long: from 88).
A set gets no more keys than it has shingles, and a key of a frequent class needs all its shingles, which only copies share.

Most candidates only share a passage. A parity bitmap of each set, of one to two bits a shingle, shows that exactly: two sets differ in at least as many shingles as
their bitmaps do in bits. Only pairs that this bound lets through move their sets.

Frequency classes come from counts over all texts: shingles in more than ``RARE`` texts are frequent (the most frequent ``TABLE``, if there are more, which changes
costs only). Candidates are verified by exact intersection, in two rounds: every member of a bucket against the bucket's ``HEADS`` heads (the least members by as many hashes);
then, in buckets that still hold several components, what is outside the largest one against all of other components. Of buckets that hold the same sets one is enough, and a pair comes through only at the least key
that both share among the ``LOW`` least ones they have left, so texts with a passage in common meet once. So every link between components is found, but no group of copies expands into its pairs.

Null and empty texts have no set and are a class of their own row. Texts with fewer than k words have one shingle; texts of any length are taken whole. Rows that repeat a set
(with equal ids or not) are one node; rows with equal ids and different sets are nodes of their own. Rows without an id link to nothing and have no class. An empty table gives
an empty result. Only the key and text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyfold.llm.components import components
from keyfold.llm.runs import pack_ascending, unpack_ascending
from keyfold.llm.store import as_rows, discard, from_rows, written
from keyfold.llm.words import mix, seeded, shingles, words_of

RARE = 12
CROWDED = 256  # texts from which a shingle is indexed in threes
HEADS = 3  # members of a bucket that all others are held against
LOW = 24  # least keys of a set, of those in buckets that are still apart, by which a pair's first meeting is told
TABLE = 1 << 21
_BITS = 48
SHORT = 8  # longs of the bitmap that candidate joins compare
_Q = [f"q{i}" for i in range(SHORT)]
_MULT = seeded(3, 31337)
_TOP = np.uint64(1 << 63)


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingles, offsets); ascending within a text."""
    for lo, hi, w in words_of(column):
        yield lo, hi, *shingles(w.hashes, w.off, k, _BITS)


# ---- frequency classes


def frequent(docs: DataFrame, k: int, text: str, above: int = RARE, limit: int = TABLE) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, shingles, rank by number of texts, numbers) of the shingles in more than ``above`` texts, ascending; counted over all texts.

    Shingles count by their leading bits, 2**30 values for each shuffle partition: few share a value, and those only seem more frequent than they are.
    Tasks hand on sorted runs by range of shingles, each range is merged by one task, and there are as many ranges as keep them small.
    """
    partitions = (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    bits = min(_BITS, 30 + partitions)
    cut, shift = np.uint64(_BITS - bits), np.uint64(bits - 3 - partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            own = x >> shift
            cuts = np.append(np.flatnonzero(np.diff(own, prepend=np.uint64(1 << 63))), len(x))
            blobs = [pack_ascending(x[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.record_batch([pa.array(own[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["r", "x"])

        for b in batches:
            for _, _, x, _ in sets_of(b.column(0), k):
                kept.append(x >> cut)
                size += len(x)
                if size > 1 << 20:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        runs = [unpack_ascending(raw) for raw in group.column("x").to_pylist()]
        x, back = np.unique(np.concatenate([r[0] for r in runs]), return_inverse=True)
        n = np.bincount(back, np.concatenate([r[1] for r in runs])).astype(np.int64)
        use = n > above
        return pa.table([pa.array(x[use].astype(np.int64)), pa.array(n[use])], ["x", "n"])

    found = written(docs.select(text).mapInArrow(run, "r int, x binary").groupBy("r").applyInArrow(merge, "x long, n long"), "frequent")
    sizes = found.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect()
    room, least = limit, (1 << 16) + 1
    for n, c in sorted(map(tuple, sizes), reverse=True):
        if c > room:
            break
        room, least = room - c, n
    if least > 1 << 16:
        rows = found.orderBy(F.desc("n"), "x").limit(limit).toArrow()
    else:
        rows = found.where(F.col("n") >= least).toArrow()
    x, n = rows["x"].to_numpy().astype(np.uint64), rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(x)
    x, n = x[order], n[order]
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((x, n))] = np.arange(len(x))
    discard(found)
    return bits, x, rank, n


# ---- keys


def slack(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of size n a linked set may lack."""
    return n - -(-n * percent // 100)


def longest(percent: int) -> int:
    """How many shingles a combination may have: linked sets have so many in common that one run of neighbours is as long."""
    return 3 if percent >= 88 else 2


class Classes:
    """The frequent shingles with a bit table before them."""

    def __init__(self, bits: int, x: np.ndarray, rank: np.ndarray, n: np.ndarray, crowded: int = CROWDED):
        self.cut, self.x, self.rank = np.uint64(_BITS - bits), x, rank
        self.crowded = int((n <= crowded).sum())  # the rank of the first crowded one
        self.near = np.zeros(1 << 22, bool)
        self.near[x >> np.uint64(bits - 22)] = True

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """Ranks of frequent shingles, -1: rare."""
        out = np.full(len(tokens), -1)
        if len(self.x):
            at = np.flatnonzero(self.near[tokens >> np.uint64(_BITS - 22)])
            value = tokens[at] >> self.cut
            place = np.minimum(np.searchsorted(self.x, value), len(self.x) - 1)
            hit = self.x[place] == value
            out[at[hit]] = self.rank[place[hit]]
        return out


def index_keys(tokens: np.ndarray, off: np.ndarray, classes: Classes, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row of each, frequent shingles of each row). Single rare shingles have the highest bit set (negative as longs), combinations have not."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    rank = classes.ranks(tokens)
    rare = np.flatnonzero(rank < 0)
    rares = np.bincount(row[rare], minlength=len(n))
    lacks = slack(n, percent)
    place = np.arange(len(rare)) - np.repeat(np.cumsum(rares) - rares, rares)
    use = rare[place <= lacks[row[rare]]]
    keys, rows = [mix(tokens[use]) | _TOP], [row[use]]
    left = lacks - rares  # frequent shingles that a linked set may lack, where no rare one is shared
    open_ = (rank >= 0) & (left >= 0)[row]
    if open_.any():
        own, rank, token = row[open_], rank[open_], tokens[open_]
        by = np.lexsort((token, rank, own))
        own, rank, order = own[by], rank[by], token[by]
        many = np.bincount(own, minlength=len(n))
        place = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        size = np.where((rank >= classes.crowded) & (longest(percent) > 2), 3, 2)
        most = np.full(len(n), 2)
        most[own[size == 3]] = 3
        runs = left + n * (100 - percent) // percent + 1
        length = (most - 1) * runs + 1 + left
        end = np.minimum(np.arange(len(own)) + size - 1, len(own) - 1)
        first = np.flatnonzero((np.arange(len(own)) + size <= len(own)) & (own == own[end]) & (place[end] < length[own]))
        value = order[first] * _MULT[0] + order[first + 1] * _MULT[1]
        three = size[first] == 3
        value[three] += order[first[three] + 2] * _MULT[2]
        keys.append(mix(value) & ~_TOP)
        rows.append(own[first])
    return np.concatenate(keys), np.concatenate(rows), n - rares


def signatures(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens + np.uint64(0x5851F42D4C957F2D)))])
    return mix((sums[off[1:]] - sums[off[:-1]]) ^ np.diff(off).astype(np.uint64)).view(np.int64)


def parity_bits(tokens: np.ndarray, off: np.ndarray) -> list[bytes]:
    """For each set, bit i is the parity of its shingles that are i modulo the bitmap's size, the power of two from its size up (64 at least)."""
    n = np.diff(off)
    size = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.cumsum(size) - size
    at = np.repeat(begin, n) + (tokens & (np.repeat(size, n) - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(size.sum())) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((begin // 8).tolist(), ((begin + size) // 8).tolist(), strict=True)]


def short_bits(tokens: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """The parities of each set's shingles modulo 64 * SHORT, as SHORT long columns."""
    n = np.diff(off)
    at = np.repeat(np.arange(len(n)) * 64 * SHORT, n) + (tokens & np.uint64(64 * SHORT - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(n) * 64 * SHORT) & 1).astype(np.uint8)
    longs = np.packbits(odd, bitorder="little").view(np.int64).reshape(len(n), SHORT)
    return [pa.array(np.ascontiguousarray(longs[:, i])) for i in range(SHORT)]


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ; the larger one is folded to the size of the smaller."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    size = len(a)
    while size > len(b):
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def profiles(docs: DataFrame, k: int, percent: int, classes: Classes, key: str, text: str) -> DataFrame:
    """doc_id, mark (hash of the text), uid, n (shingles), m (frequent ones), sig (of the set), bits, q0, q1, ..., keys (ascending) of every row; one narrow pass, written."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            for lo, hi, x, off in sets_of(b.column(2), k):
                n, sig = np.diff(off), signatures(x, off)
                keys, row, m = index_keys(x, off, sent.value, percent)
                keys = keys.view(np.int64)
                order = np.lexsort((keys, row))
                keys, edge = keys[order], np.searchsorted(row[order], np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(keys))
                cols = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(uid + np.arange(hi - lo)), pa.array(n), pa.array(sig, mask=n == 0), pa.array(parity_bits(x, off), pa.binary()), pa.array(m)]
                uid += hi - lo
                yield pa.RecordBatch.from_arrays([*cols, *short_bits(x, off), lists], names=["doc_id", "mark", "uid", "n", "sig", "bits", "m", *_Q, "keys"])

    schema = f"doc_id long, mark long, uid long, n long, sig long, bits binary, m long, {', '.join(f'{q} long' for q in _Q)}, keys array<bigint>"
    out = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text).mapInArrow(run, schema), "profiles")
    sent.destroy()
    return out


# ---- candidates and links


_TABLE_BITS = 24


def place_of(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - _TABLE_BITS)


def bit_table(nodes: DataFrame) -> np.ndarray:
    """2**24 bits with those of the ids in ``nodes`` (doc_id) set: of fixed size, however many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = place_of(np.asarray(b.column(0)))
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["w", "b"])

    rows = nodes.select("doc_id").mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (_TABLE_BITS - 6), np.uint64)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def tokens_of(docs: DataFrame, nodes: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """sig, tokens of the texts named in ``nodes`` (sig, doc_id), written. A bit table of fixed size picks their texts in place, so no texts move, only sets; a join
    then drops the few that it lets through besides, and an aggregate the repeats."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            b = b.filter(pa.array(np.asarray(ids.is_valid()) & sent.value[place_of(np.asarray(ids.fill_null(0)))]))
            for lo, hi, x, off in sets_of(b.column(1), k):
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(signatures(x, off)), lists], names=["doc_id", "sig", "tokens"])

    some = docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, sig long, tokens array<bigint>")
    out = written(some.join(nodes, ["doc_id", "sig"], "left_semi").groupBy("sig").agg(F.first("tokens").alias("tokens")), "tokens")
    sent.destroy()
    return out


def fits(n: Column, m: Column, percent: int) -> Column:
    """Sizes at which two sets can link."""
    return (F.lit(100) * F.least(n, m)) >= (F.lit(percent) * F.greatest(n, m))


def can_link(shared: Column, total: Column, percent: int) -> Column:
    """Whether so many common shingles do, of both sizes' total."""
    return F.lit(100) * shared >= F.lit(percent) * (total - shared)


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps (sig, n, bits) don't rule out a link."""
    left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y")), "b").where(fits(F.col("n_a"), F.col("n_b"), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.fromiter((bits_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)), np.int64, batch.num_rows)
            total = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            shared = (total - apart) // 2
            yield batch.select([0, 1]).filter(pa.array(100 * shared >= percent * (total - shared)))

    return both.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``pairs`` whose sets link."""
    left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(F.lit(100) * shared >= F.lit(percent) * (F.size("x") + F.size("y") - shared)).select("a", "b")


class Linked(NamedTuple):
    rows: DataFrame  # doc_id, mark, n, sig of every row
    classes: DataFrame  # sig, doc_id (the least with this set), component


def linked(docs: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text", above: int = RARE, limit: int = TABLE, crowded: int = CROWDED) -> Linked:
    """The classes of equal and linked sets."""
    if not 80 <= percent <= 100:
        raise ValueError("the prefixes are long enough for 80 to 100 percent")
    rows = profiles(docs, k, percent, Classes(*frequent(docs, k, text, above, limit), crowded), key, text)
    nodes = rows.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull()).groupBy("sig", "n").agg(F.min(F.struct("doc_id", "uid")).alias("x"))
    nodes = written(nodes.select("sig", "n", "x.*"), "nodes")
    of_nodes = rows.join(nodes.select("uid"), "uid", "left_semi")  # a row for each set
    sets = written(of_nodes.select("sig", "n", "bits", "m", *_Q), "sets")
    buckets = written(shared_keys(of_nodes.select(F.col("sig").alias("node"), F.explode("keys").alias("key"))), "buckets")

    met = buckets.select("node", F.explode(F.array_distinct("heads")).alias("head")).where("node <> head")
    pairs = written(near(met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), sets, percent), "pairs")
    tokens = tokens_of(docs, ends(pairs, nodes), k, key, text)
    links = written(verified(pairs, tokens, percent), "links")
    discard(tokens)
    found = components(links)
    classes = nodes.select("sig", "doc_id").join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    classes = written(classes, "classes")

    apart = still_apart(buckets, classes, sets)
    more = written(near(meeting(apart, percent), sets, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    tokens = tokens_of(docs, ends(more, nodes), k, key, text)
    links = written(verified(more, tokens, percent), "links")
    discard(tokens)
    if not links.isEmpty():  # links between components
        for end in ("a", "b"):
            links = links.join(classes.select(F.col("sig").alias(end), F.col("component").alias(f"_{end}")), end)
        merged = components(links.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("_to"))
        classes = written(classes.join(merged, "component", "left").select("sig", "doc_id", F.coalesce("_to", "component").alias("component")), "classes")
    discard(apart, pairs, more)
    discard(sets, buckets, nodes)
    return Linked(rows.select("doc_id", "mark", "n", "sig"), classes)


def shared_keys(posted: DataFrame) -> DataFrame:
    """key, node, heads of the keys that two sets or more have. Keys of rare shingles have few sets, so a window may hold one; others get their heads by a combining aggregate."""
    heads = F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(HEADS)))
    group = Window.partitionBy("key")
    own = F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))).over(group) for i in range(HEADS)))
    rare = posted.where("key < 0").withColumn("size", F.count("*").over(group)).withColumn("heads", own).where("size > 1")
    often = posted.where("key >= 0")
    crowd = often.groupBy("key").agg(F.count("*").alias("size"), heads.alias("heads")).where("size > 1")
    return rare.select("key", "node", "heads").unionByName(often.join(crowd, "key").select("key", "node", "heads"))


def still_apart(buckets: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The buckets that hold several components: key, node, component, main (the bucket's largest component), with what rules pairs out; written.

    Buckets of the same sets hold the same pairs, so only that of the least key stays. ``low`` has the least keys of what stays for each node.
    """
    known = buckets.select("key", "node").join(classes.select(F.col("sig").alias("node"), "component"), "node")
    marks = {f"h{i}": F.bit_xor(F.xxhash64("node", F.lit(i))) for i in range(2)}
    parts = known.groupBy("key", "component").agg(F.count("*").alias("size"), *(m.alias(h) for h, m in marks.items()))
    parts = parts.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("size"), *(F.bit_xor(h).alias(h) for h in marks))
    one = parts.where("parts > 1").groupBy("size", *marks).agg(F.min(F.struct("key", "main")).alias("x")).select("x.*")
    several = written(known.join(one, "key"), "several")
    low = several.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LOW).alias("low"))
    apart = written(several.join(low, "node").join(sets.select(F.col("sig").alias("node"), "n", "m", *_Q), "node"), "apart")
    discard(several)
    return apart


def meeting(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of different components that meet in a bucket and that sizes and short bitmaps don't rule out."""
    a, b = apart.where("component <> main").alias("a"), apart.alias("b")
    total = F.col("a.n") + F.col("b.n")
    differ = sum((F.bit_count(F.col(f"a.{q}").bitwiseXOR(F.col(f"b.{q}"))) for q in _Q[1:]), F.bit_count(F.col("a.q0").bitwiseXOR(F.col("b.q0"))))
    once = (F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    both = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & once
    # a linked pair that shares no rare key shares no rare shingle
    often = (F.col("a.key") < 0) | can_link(F.least("a.m", "b.m"), total, percent)
    first = F.coalesce(F.array_min(F.array_intersect("a.low", "b.low")), F.col("a.key")) >= F.col("a.key")
    found = a.join(b, both & fits(F.col("a.n"), F.col("b.n"), percent) & often & can_link(F.floor((total - differ) / 2), total, percent) & first)
    return found.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """sig, doc_id of all nodes in some pairs."""
    both = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    return nodes.select("sig", "doc_id").join(both, "sig", "left_semi")


def link_components(docs: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text", above: int = RARE, limit: int = TABLE, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    rows, classes = linked(docs, k, percent, key, text, above, limit, crowded)
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(least, "component").select("sig", "component_id")
    alone = F.col("sig").isNull() | F.col("doc_id").isNull()
    out = rows.where(~alone).join(named, "sig").unionByName(rows.where(alone).withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id (and then text hash). Rows without a doc_id or without words stay, repeats of them too.

    Rows are told by doc_id and text, so an id that comes with several texts loses only those that have copies.
    """
    rows, classes = linked(docs, k, percent)
    rows = rows.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id", "mark", "sig").agg(F.count("*").alias("times"))
    rows = rows.join(classes.select("sig", "component"), "sig")
    kept = rows.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("kept"))
    rows = written(rows.join(kept, "component").select(F.struct("doc_id", "mark").alias("own"), "kept", "times").where("own <> kept OR times > 1"), "copies")
    gone = rows.where("own <> kept").select("own.*").withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    again = rows.where("own = kept").select("own.*").withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    marked = as_rows(docs)
    marked = marked.select("row", F.col("row.doc_id").cast("long").alias("_id"), F.xxhash64("row.text").alias("_mark"))
    left = marked.join(gone, ["_id", "_mark"], "left_anti")
    if not again.isEmpty():  # repeats of a row that is to stay: one of them does
        left = left.join(again, ["_id", "_mark"], "left_anti").unionByName(marked.join(again, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]))
    return from_rows(left.select("row"))

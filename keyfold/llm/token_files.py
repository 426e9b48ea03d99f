"""Token ids in patched frame-of-reference files.

``write_tokens`` encodes whole texts, ends each with an end id and writes ids in ascending key order; ``read_tokens`` reads the
files back. A file is cut into blocks of 128 ids. A block stores its least id, the differences to it packed at the width that
holds 90 % of them, and the rest in exception lists (place in the block, high bits). Block starts are indexed, so any range of
ids is read without the blocks before it.

File: ``KFP1``, then sections (ids, blocks and documents counted in the footer): least id (u32 a block), width (u8), exceptions of
the blocks (u16), packed words, exception places (u8), exception high bits (u32), start of each block's packed bytes and of its exceptions (u64 each),
keys (i64), key is known (u8), ids of each document (u32); footer: eleven u64 section starts, three u64 counts, ``KFP1``.

Keys go to files by range, so files in order hold ascending keys; a partition rolls to a new file every few million ids. Files are named by task attempt and
listed in a manifest of the attempts that counted, so lost executors leave only files that nothing lists. Null texts are
empty (an end id only); null keys come first; repeated keys are documents of their own, ordered by text hash; texts are encoded whole, however long; an empty table makes no file. Only key and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyfold.llm.store import new_path, written
from keyfold.llm.words import mix, pieces, span_hash

BLOCK = 128
FILE_IDS = 8 << 20
MAGIC = b"KFP1"
_TYPES = [np.uint32, np.uint8, np.uint16, np.uint32, np.uint8, np.uint32, np.uint64, np.uint64, np.int64, np.uint8, np.uint32]


# ---- blocks


def encode_blocks(ids: np.ndarray) -> list[np.ndarray]:
    """Sections least, width, exceptions, packed, places, high bits, packed starts, exception starts of some ids."""
    n = len(ids)
    nb = -(-n // BLOCK)
    full = np.zeros(nb * BLOCK, np.uint64)
    full[:n] = ids
    if n < len(full):
        full[n:] = ids[-1]
    full = full.reshape(nb, BLOCK)
    least = full.min(1) if nb else np.zeros(0, np.uint64)
    delta = full - least[:, None]
    high = np.sort(delta, 1)[:, int(0.9 * BLOCK)] if nb else least
    width = np.ceil(np.log2(high.astype(np.float64) + 1)).astype(np.int64)  # ids are below 2**32: exact
    over = delta >> width.astype(np.uint64)[:, None]
    row, place = np.nonzero(over)
    low = delta & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    words = width * (BLOCK // 32)
    start = np.concatenate([[0], np.cumsum(words)])
    packed = np.zeros(start[-1], np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for lo in range(0, len(rows), 8192):
            at = rows[lo : lo + 8192]
            out = np.zeros((w * BLOCK // 32 + 1, len(at)), np.uint64)
            values = np.ascontiguousarray(low[at].T)
            for j in range(BLOCK):
                word, bit = divmod(j * int(w), 32)
                v = values[j] << np.uint64(bit)
                out[word] |= v & np.uint64(0xFFFFFFFF)
                if bit + w > 32:
                    out[word + 1] |= v >> np.uint64(32)
            packed[start[at][:, None] + np.arange(w * BLOCK // 32)] = out[:-1].T.astype(np.uint32)
    many = np.bincount(row, minlength=nb)
    return [least.astype(np.uint32), width.astype(np.uint8), many.astype(np.uint16), packed, place.astype(np.uint8), over[row, place].astype(np.uint32), (start[:-1] * 4).astype(np.uint64), (np.cumsum(many) - many).astype(np.uint64)]


def decode_blocks(s: list[np.ndarray], first: int, last: int) -> np.ndarray:
    """Ids of the blocks first to last - 1."""
    least, width, many = s[0][first:last].astype(np.uint64), s[1][first:last].astype(np.int64), s[2][first:last].astype(np.int64)
    start = s[6][first:last].astype(np.int64) // 4
    out = np.zeros((last - first, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        mask = np.uint64((1 << int(w)) - 1)
        for lo in range(0, len(rows), 8192):
            at = rows[lo : lo + 8192]
            words = np.zeros((w * BLOCK // 32 + 1, len(at)), np.uint64)
            words[:-1] = s[3][start[at][:, None] + np.arange(w * BLOCK // 32)].T
            values = np.empty((BLOCK, len(at)), np.uint64)
            for j in range(BLOCK):
                word, bit = divmod(j * int(w), 32)
                v = words[word] >> np.uint64(bit)
                if bit + w > 32:
                    v = v | (words[word + 1] << np.uint64(32 - bit))
                values[j] = v & mask
            out[at] = values.T
    total = int(many.sum())
    if total:
        at = int(s[7][first])
        row = np.repeat(np.arange(last - first), many)
        out[row, s[4][at : at + total]] |= s[5][at : at + total].astype(np.uint64) << width[row].astype(np.uint64)
    return (out + least[:, None]).ravel()


def file_bytes(ids: np.ndarray, keys: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> bytes:
    sections = [*encode_blocks(ids), keys.astype(np.int64), known.astype(np.uint8), sizes.astype(np.uint32)]
    parts, at, starts = [MAGIC], 4, []
    for x, kind in zip(sections, _TYPES, strict=True):
        starts.append(at)
        parts.append(np.ascontiguousarray(x, kind).tobytes())
        at += len(parts[-1])
    parts.append(np.array([*starts, len(ids), -(-len(ids) // BLOCK), len(keys)], np.uint64).tobytes() + MAGIC)
    return b"".join(parts)


class TokenFile:
    """A file's bytes; sections are views."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or raw[-4:] != MAGIC:
            raise ValueError("not a token file")
        foot = np.frombuffer(raw[-4 - 14 * 8 : -4], np.uint64).astype(np.int64)
        self.n_ids, self.n_blocks, self.n_docs = map(int, foot[11:])
        ends = [*foot[1:11], len(raw) - 4 - 14 * 8]
        self.sections = [np.frombuffer(raw[a:b], kind) for a, b, kind in zip(foot[:11], ends, _TYPES, strict=True)]
        self.keys, self.known, self.sizes = self.sections[8:]

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids a to b - 1; only their blocks are unpacked."""
        b = self.n_ids if b is None else min(b, self.n_ids)
        if a >= b:
            return np.zeros(0, np.uint32)
        first = a // BLOCK
        return decode_blocks(self.sections, first, -(-b // BLOCK))[a - first * BLOCK : b - first * BLOCK].astype(np.uint32)


# ---- encoding

_CACHE_IDS = 8 << 20
PIECE = 8 << 20  # bytes of text encoded at once
_caches: dict = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: Bytes that begin or end a character that is surely no white space: printable ASCII, and letters led by C3 to DF.
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_PLAIN = ~_SPACE & (np.arange(256) < 0x80)


class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece of text once.

    Byte-level pre-tokenisation never joins a character with a space after it. So texts are cut before each single
    space between two characters that are no white space; the pieces encode alone as they do in the text. Ids of pieces seen are kept by a hash of 64 bits, up to
    a bounded number of ids, and then from anew; the hash stands for the piece, so of n different pieces two get each other's ids with probability n * n / 2 ** 65.
    Strings of special tokens in a text are those tokens, as the library has it, unless ``special_as_text``; they have no space, so no cut parts them.
    """

    def __init__(self, path: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.width = np.zeros(self.tok.get_vocab_size() + 1, np.int64)  # bytes of each id's token: a byte a character
        for token, i in self.tok.get_vocab().items():
            self.width[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def cuts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(raw)
        heads = off[:-1][np.diff(off) > 0]
        if n < 3:
            return heads
        lead = _LEAD[raw]
        before = _PLAIN[raw]
        before[1:] |= lead[:-1] & (raw[1:] >= 0x80)
        after = _PLAIN[raw] | lead
        cut = np.zeros(n, bool)
        cut[1:-1] = (raw[1:-1] == 0x20) & before[:-2] & after[2:]
        cut[off[1:-1][off[1:-1] < n]] = False  # a text's first byte has nothing before it
        ends = off[1:] - 1
        cut[ends[ends >= 0]] = False  # nor its last one after it
        cut[heads] = True
        return np.flatnonzero(cut)

    def pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, joins: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece). The first ``joins`` begin and end at cuts, so they encode as one text, whose ids are dealt out by their bytes."""
        size = ends - starts
        edge = np.cumsum(size[:joins])
        joined = raw[np.arange(int(edge[-1]) if joins else 0) + np.repeat(starts[:joins] - (edge - size[:joins]), size[:joins])].tobytes()
        stops = edge[np.unique(np.searchsorted(edge, np.arange(1 << 15, (edge[-1] if joins else 0) + (1 << 15), 1 << 15)).clip(max=joins - 1))] if joins else []
        parts, at = [], 0
        for stop in map(int, stops):
            parts.append(joined[at:stop].decode())
            at = stop
        found = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        upto = np.cumsum(self.width[ids])
        last = np.searchsorted(upto, edge)
        if joins and not (last[-1] < len(upto) and np.array_equal(upto[last], edge)):
            joins, ids, last = 0, ids[:0], last[:0]  # its tokens don't spell bytes
        data = raw.tobytes()
        alone = [data[a:b].decode() for a, b in zip(starts[joins:].tolist(), ends[joins:].tolist(), strict=True)]
        more = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(alone, add_special_tokens=False)]
        counts = np.concatenate([np.diff(last, prepend=-1), np.fromiter(map(len, more), np.int64, len(more))]).astype(np.int64)
        return np.concatenate([ids, *more]), counts

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) without end ids."""
        starts = self.cuts(raw, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        ends = np.append(starts[1:], len(raw))
        h, first, back = np.unique(span_hash(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.pool) > _CACHE_IDS:
            self.clear()
        at = np.searchsorted(self.keys, h)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == h if len(self.keys) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        if len(new):
            inner = np.ones(len(starts) + 1, bool)
            inner[np.searchsorted(starts, off)] = False
            joins = inner[first[new]] & inner[first[new] + 1]
            new = np.concatenate([new[joins], new[~joins]])
            ids, size = self.pieces(raw, starts[first[new]], ends[first[new]], int(joins.sum()))
            start = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, ids])
            order = np.argsort(h[new])
            put = np.searchsorted(self.keys, h[new][order])
            self.keys, self.start, self.size = np.insert(self.keys, put, h[new][order]), np.insert(self.start, put, start[order]), np.insert(self.size, put, size[order])
            at = np.searchsorted(self.keys, h)
        start, size = self.start[at][back], self.size[at][back]
        edge = np.cumsum(size)
        out = self.pool[np.arange(edge[-1]) + np.repeat(start - (edge - size), size)]
        upto = np.concatenate([[0], edge])
        per = upto[np.searchsorted(starts, off)]
        return out, np.diff(per)


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder for each file and worker process."""
    key = (path, special_as_text)
    if key not in _caches:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _caches[key] = Encoder(path, special_as_text)
    return _caches[key]


def with_ends(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.cumsum(sizes + 1)
    out = np.full(int(edge[-1]) if len(edge) else 0, end_id, np.uint32)
    inside = np.ones(len(out), bool)
    inside[edge - 1] = False
    out[inside] = ids
    return out, sizes + 1


# ---- files


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, special_as_text: bool = False, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and returns their manifest: part, seq, path, n_docs, n_ids (a written table of a row a file)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumns({"h": F.xxhash64("t"), "u": F.monotonically_increasing_id()})  # rows that share a key, or have none, go to files by their texts
    rows = rows.repartitionByRange(n, "k", "h", "u").sortWithinPartitions("k", "h", "u").select("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer, special_as_text), TaskContext.get()
        kept: list[tuple] = []
        seq = 0
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)

        def flush() -> pa.RecordBatch:
            nonlocal seq
            ids, keys, known, sizes = (np.concatenate(x) for x in zip(*kept, strict=True))
            name = f"part-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.kfp"
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(file_bytes(ids, keys, known, sizes))
            row = [[task.partitionId()], [seq], [f"{path}/{name}"], [len(keys)], [len(ids)]]
            kept.clear()
            seq += 1
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "path", "n_docs", "n_ids"])

        for b in batches:
            known = np.asarray(b.column(0).is_valid())
            keys = np.asarray(b.column(0).fill_null(0), np.int64)
            for lo, hi, raw, off in pieces(b.column(1), PIECE):
                ids, sizes = with_ends(*enc.encode(raw, off), end_id)
                kept.append((ids, keys[lo:hi], known[lo:hi], sizes))
                if sum(len(x[0]) for x in kept) >= file_ids:
                    yield flush()
        if kept:
            yield flush()

    return written(rows.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = _open(path)
                with store.open_input_file(name) as f:
                    file = TokenFile(f.read())
                sizes = file.sizes.astype(np.int64)
                edge = np.cumsum(sizes)
                crc = np.empty(len(sizes), np.int64)
                data = memoryview(file.ids().astype("<u4").tobytes())
                for i, (a, e) in enumerate(zip((4 * (edge - sizes)).tolist(), (4 * edge).tolist(), strict=True)):
                    crc[i] = zlib.crc32(data[a:e])
                yield pa.record_batch([pa.array(file.keys, mask=file.known == 0), pa.array(base + edge - sizes), pa.array(sizes), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    return read_tokens(write_tokens(docs, new_path(docs.sparkSession, "tokens"), tokenizer, end_id))

"""Exact top-k by distributed histogram selection.

Everything is scored, several times if need be, and no ranking is kept: each round counts, for every query, how many scores fall in
each bin of the interval that must hold its k-th highest score, adds the histograms over all tasks, and narrows
the interval to one bin. Integer scores make it end when an interval holds a single value: the exact k-th score. Then one pass
keeps what reaches it; ties at the k-th score are decided by the smaller id, of which each task needs only its k smallest per query.

Queries come in blocks of bounded size, each broadcast and scored against all rows with one matrix product per batch. Vectors that are
null, or hold null or non-finite components, take no part; vectors meet only vectors of their own length. Where no
sum can leave the range in which doubles are exact, products are made in doubles, else in 64-bit integers, and where those don't do either (components from about 2**22 on), in whole
numbers of any size; scores beyond a long are cut to its range in the result, ranks are not affected. (256 * x must be finite.)
An empty table gives an empty result; a query with fewer than k others gets them all. Repeated ids are rows of their own,
but rows with the query's own id are never its results. Only the two columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyfold.llm.store import written

BLOCK = 2048  # queries at once
BINS = 1024
SCALE = 256.0
_EXACT = 1 << 53
_WIDE = 1 << 61


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat values) of a list column without nulls."""
    return np.diff(np.asarray(column.offsets)), np.asarray(column.flatten())


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, vectors = b.column(0), b.column(1)
        values = vectors.flatten()
        sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
        flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan), np.float64)
        off = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat * SCALE))])
        ok = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid()) & (bad[off[1:]] == bad[off[:-1]]) & (sizes > 0)
        for dim in np.unique(sizes[ok]):
            at = np.flatnonzero(ok & (sizes == dim))
            q = np.floor(flat[off[at][:, None] + np.arange(dim)] * SCALE)
            most = np.abs(q).max(1)
            norm = np.where(most < 1e100, np.sqrt((np.minimum(np.abs(q), 1e100) ** 2).sum(1)), np.inf)
            yield pa.record_batch([ids.take(pa.array(at)).cast(pa.int64()), pa.array(np.full(len(at), dim, np.int32)), pa.array(norm), pa.array(most), pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), int(dim)).cast(pa.list_(pa.float64()))], ["vec_id", "dim", "norm", "most", "q"])


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dim, norm, most (greatest component), q: each component as floor(256 * x), which a double holds exactly, without the rows that take no part."""
    return vectors.select(key, vector).mapInArrow(_quantise, "vec_id long, dim int, norm double, most double, q array<double>")


_NINES = str.maketrans("0123456789", "9876543210")
_whole = np.frompyfunc(int, 1, 1)


def as_kind(x: np.ndarray, bound: int) -> np.ndarray:
    """Whole numbers held as doubles, in the type in which sums up to ``bound`` are exact."""
    return x if bound < _EXACT else x.astype(np.int64) if bound < _WIDE else _whole(x)


def scores(block: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of two matrices of one kind."""
    s = block @ rows.T
    return s.astype(np.int64) if s.dtype == np.float64 else s


def to_long(s: np.ndarray) -> pa.Array:
    return pa.array(np.clip(s, -(1 << 63), (1 << 63) - 1).astype(np.int64))


def order_text(s: np.ndarray) -> pa.Array:
    """Text in the order of whole numbers of any size, null for numbers that a long holds: sign, number of digits, digits (their complements below 0)."""
    if s.dtype != object:
        return pa.nulls(len(s), pa.string())

    def one(x: int) -> str:
        digits = str(abs(x))
        return f"1{len(digits):05d}{digits}" if x >= 0 else f"0{99999 - len(digits):05d}{digits.translate(_NINES)}"

    return pa.array(map(one, s), pa.string())


def _rows(batches: Iterator[pa.RecordBatch], dim: int, bound: int, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, most):
            part = b.slice(lo, most)
            yield np.asarray(part.column(0)), as_kind(np.asarray(part.column(1).flatten()).reshape(-1, dim), bound)


def _select(spark: SparkSession, rows: DataFrame, ids: np.ndarray, q: np.ndarray, bound: int, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score, exact: its order where it isn't a long) that can be among a query's k highest: all above the k-th score, at it each task's k smallest ids."""
    dim, kind = q.shape[1], np.int64 if bound < _WIDE else object
    q = as_kind(q, bound)
    lo, width = np.full(len(ids), -bound, kind), np.full(len(ids), 2 * bound + 1, kind)  # the k-th score is in [lo, lo + width)
    need = np.full(len(ids), k)  # the how-manieth from the top, of those below lo + width
    done = np.zeros(len(ids), bool)
    sent = spark.sparkContext.broadcast((ids, q))
    while not done.all():
        step = np.maximum(1, (width + BINS - 1) // BINS)
        state = spark.sparkContext.broadcast((lo, width, step, done))

        def count(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            (ids, q), (lo, width, step, done) = sent.value, state.value
            live = np.flatnonzero(~done)
            total = np.zeros((len(live), BINS), np.int64)
            flat = np.arange(len(live))[:, None] * BINS
            for own, x in _rows(batches, dim, bound):
                s = scores(q[live], x)
                bin_ = (s - lo[live, None]) // step[live, None]
                use = (bin_ >= 0) & (s < (lo + width)[live, None]) & (own[None, :] != ids[live, None])
                total += np.bincount((bin_ + flat)[use].astype(np.int64), minlength=total.size).reshape(total.shape)
            r, b = np.nonzero(total)
            yield pa.record_batch([pa.array(live[r].astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[r, b])], ["r", "b", "n"])

        # one bounded histogram for each query of the block, whatever the number of rows
        found = rows.mapInArrow(count, "r int, b int, n long").groupBy("r", "b").agg(F.sum("n").alias("n")).toArrow()
        hist = np.zeros((len(ids), BINS), np.int64)
        hist[found["r"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
        for r in np.flatnonzero(~done):
            top = np.cumsum(hist[r][::-1])
            if top[-1] < need[r]:  # fewer rows than k: all are results
                lo[r], done[r] = -bound, True
                continue
            j = int(np.searchsorted(top, need[r]))
            need[r] -= top[j] - hist[r][::-1][j]
            lo[r], width[r] = lo[r] + (BINS - 1 - j) * step[r], step[r]
            done[r] = width[r] == 1
        state.destroy()
    kth = spark.sparkContext.broadcast(lo)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, q), least = sent.value, kth.value
        tied: dict[int, np.ndarray] = {}
        cols = ["query_id", "vec_id", "score", "exact"]
        for own, x in _rows(batches, dim, bound):
            s = scores(q, x)
            other = own[None, :] != ids[:, None]
            r, c = np.nonzero((s > least[:, None]) & other)
            yield pa.record_batch([pa.array(ids[r]), pa.array(own[c]), to_long(s[r, c]), order_text(s[r, c])], cols)
            r, c = np.nonzero((s == least[:, None]) & other)
            for i in np.unique(r):
                mine = np.concatenate([tied.get(i, np.zeros(0, np.int64)), own[c[r == i]]])
                tied[i] = np.sort(mine)[:k]
        for i, mine in tied.items():
            yield pa.record_batch([pa.array(np.full(len(mine), ids[i])), pa.array(mine), to_long(np.full(len(mine), least[i])), order_text(np.full(len(mine), least[i], least.dtype))], cols)

    return rows.mapInArrow(keep, "query_id long, vec_id long, score long, exact string")


def top_k(vectors: DataFrame, is_query: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the highest integer inner product, ties to the smaller id.

    ``is_query`` is a SQL condition on ``vec_id``. Queries are read in blocks through an iterator; each block is scored against all rows.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, key, vector), "quantised")
    found = None
    for dim, norm, most in sorted((int(r["dim"]), float(r["norm"]), float(r["most"])) for r in rows.groupBy("dim").agg(F.max("norm").alias("norm"), F.max("most").alias("most")).collect()):
        bound = int(norm * norm * 1.0001) + 1 if norm < 1e100 else dim * int(most) ** 2
        same = rows.where(F.col("dim") == dim).select("vec_id", "q")
        ids, q = [], []

        def flush() -> None:
            nonlocal found
            part = written(_select(spark, same, np.array(ids, np.int64), np.array(q, np.float64), bound, k), "top")  # each block's results, so that no plan holds them all
            found = part if found is None else found.unionByName(part)
            ids.clear(), q.clear()

        for r in same.where(is_query).toLocalIterator():
            ids.append(r["vec_id"])
            q.append(r["q"])
            if len(ids) == block:
                flush()
        if ids:
            flush()
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

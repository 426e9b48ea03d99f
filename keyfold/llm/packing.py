"""Optimal length buckets and token-budget batches.

The histogram of text lengths over the whole corpus is counted in one aggregate; a dynamic program over it chooses the bucket
boundaries with the least padding in all; inside each bucket, texts are numbered and every ``budget // boundary`` of them form a batch.

Lengths are told apart exactly, so the driver sees a row for each different length (fewer than the longest text has words, whatever the number of texts), and boundaries
are lengths that occur. A text longer than the budget is a batch of its own: texts are neither cut nor dropped, and long ones are counted whole. Empty and null texts have length 0 and get
the first bucket. Ties: of equally good boundaries the lower ones; texts of a bucket are numbered in any one order. Rows that repeat an id (or have none) are texts of their own and are
spread like others. An empty table gives an empty table. Only the key and text columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.ranks import gapless
from keyfold.llm.store import written

BUCKETS = 16
BUDGET = 32_768


def word_count(text: Column) -> Column:
    """Words (runs without 0x20 and 0x09-0x0D) of each text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` upper boundaries with least sum of (boundary - length); each is one of the lengths.

    best[j]: least padding of the first j lengths with so many buckets. The padding of a bucket of lengths i + 1 .. j obeys the quadrangle inequality, so the best last cut of j never falls
    as j grows: each bucket's row is filled by halving, all middles of a depth at once. O(buckets * m log m) for m lengths.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(lengths)
    if not m:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.concatenate([[0], lengths * rows[1:] - total[1:]])  # one bucket
    back = []
    for k in range(2, min(buckets, m) + 1):
        best, frm = _next_row(best, lengths, rows, total, k)
        back.append(frm)
    out, j = [], m
    for frm in reversed(back):
        out.append(int(lengths[j - 1]))
        j = int(frm[j])
    return [*out, int(lengths[j - 1])][::-1]


def _next_row(best: np.ndarray, lengths: np.ndarray, rows: np.ndarray, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(least padding of the first j lengths in k buckets, where the last of them begins) for all j from k on."""
    m = len(lengths)
    new, frm = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    jl, jr, il, ir = (np.array([x]) for x in (k, m, k - 1, m - 1))
    while len(jl):
        mid = (jl + jr) // 2
        most = np.minimum(ir, mid - 1)
        size = most - il + 1
        begin = np.cumsum(size) - size
        i = np.arange(int(size.sum())) - np.repeat(begin - il, size)
        j = np.repeat(mid, size)
        cost = best[i] + lengths[j - 1] * (rows[j] - rows[i]) - (total[j] - total[i])
        least = np.minimum.reduceat(cost, begin)
        hit = np.flatnonzero(cost == np.repeat(least, size))
        at = i[hit[np.searchsorted(hit, begin)]]
        new[mid], frm[mid] = least, at
        jl, jr, il, ir = (np.concatenate(x) for x in ((jl, mid + 1), (mid - 1, jr), (il, at), (at, ir)))
        left = jl <= jr
        jl, jr, il, ir = jl[left], jr[left], il[left], ir[left]
    return new, frm


def fit_buckets(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Boundaries for a column ``n_tokens``: the histogram has a row for each different length."""
    hist = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).toArrow()
    return boundaries(hist["n_tokens"].to_numpy(), hist["c"].to_numpy(), buckets)


def batches(lengths: DataFrame, key: str, bounds: list[int], budget: int = BUDGET) -> DataFrame:
    """``lengths`` (key, n_tokens, _uid: unique and stored) with bucket, padded_to, batch (within its bucket) and place (within its batch)."""
    n = F.col("n_tokens")
    bucket, padded = F.lit(0), F.lit(bounds[0] if bounds else 0)
    for i, b in enumerate(bounds[1:], 1):
        over = n > F.lit(bounds[i - 1])
        bucket, padded = F.when(over, F.lit(i)).otherwise(bucket), F.when(over, F.lit(b)).otherwise(padded)
    out = lengths.withColumns({"bucket": bucket.cast("int"), "padded_to": padded.cast("long")})
    out = gapless(out, ["bucket"], [key, "n_tokens", "_uid"], "_slot")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("padded_to"))))
    return out.withColumns({"batch": F.floor(F.col("_slot") / size).cast("long"), "place": F.pmod(F.col("_slot"), size).cast("int")}).drop("_slot", "_uid")


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, bucket, padded_to, batch, place of every document. Lengths are counted once and written; later passes read two numbers a row."""
    lengths = written(docs.select(F.col(key), word_count(F.col(text)).alias("n_tokens"), F.monotonically_increasing_id().alias("_uid")), "lengths")
    return batches(lengths, key, fit_buckets(lengths, buckets), budget)

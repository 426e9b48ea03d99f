"""Importance resampling: two hashed n-gram models, one of target and one of raw text, and Gumbel top-k over their ratio.

Tokens are runs of letters and digits, and runs of other signs; unigrams and bigrams are hashed into a fixed number of buckets. The raw model counts the
n-grams of all documents; the target model those of a bounded sample of rows labelled as good (``SAMPLE`` ids with the least hashes).
A text's log weight is the sum of its n-grams' log target probability less their log raw probability, in nats. A text of more than ``LENGTH`` n-grams counts as if it had ``LENGTH``
of them with its own mean ratio, so that length alone decides nothing; ``temperature`` divides all weights. Each text gets a Gumbel
number from a hash of the seed, its id and its text, so a retried task draws the same; the k texts with the highest sums are a sample without
replacement in proportion to the weights (so k = 1 draws from their softmax). k is given, or ``share`` of all rows; by default the share is that of good rows among the labelled ones.

Texts without tokens (null, empty) have log weight 0; so have all texts without labelled rows or good ones, and then all stay. Texts of any length are taken whole; a text
without an id is weighed like others. Ties at the k-th sum all stay (repeated rows). An empty table gives an empty one. Columns are kept under ``row``, so they may have any name.
Counting and scoring are narrow passes; what meets on the driver is one number a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from keyfold.llm.selection import kth_highest
from keyfold.llm.store import as_rows, discard, from_rows, written
from keyfold.llm.words import WORD_PUNCT, Words, mix, words_of

BITS = 16
SAMPLE = 20_000
LENGTH = 128
SEED = 7
FIXED = 1 << 20  # sums are compared as integers of this many parts of one


def ngrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row of each) of all unigrams and bigrams."""
    h, row = w.hashes, w.rows()
    pair = np.flatnonzero(row[1:] == row[:-1])
    both = mix(h[pair] * np.uint64(3) + h[pair + 1] * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate([h, both]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([row, row[pair]])


def counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """N-grams of each bucket over all rows. Each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for _, _, w in words_of(b.column(0), WORD_PUNCT):
                total += np.bincount(ngrams(w)[0], minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "n"])

    found = docs.select(text).mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS)
    out[found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = 5.0) -> np.ndarray:
    """Per bucket, log of the target's share over the raw share; both are drawn towards the raw share by ``prior`` counts, so what is rare in both says little. All 0 without target text."""
    if not target.sum() or not raw.sum():
        return np.zeros_like(raw)
    return np.log(target + prior) - np.log(target.sum() * raw / raw.sum() + prior)


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", length: int = LENGTH, temperature: float = 1.0) -> DataFrame:
    """``row``, ``log_weight``."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = as_rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, w in words_of(b.column(0).field(text), WORD_PUNCT):
                bucket, row = ngrams(w)
                n = np.bincount(row, minlength=hi - lo)
                out[lo:hi] = np.bincount(row, sent.value[bucket], hi - lo) * np.minimum(1, length / np.maximum(n, 1)) / temperature
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["row", "log_weight"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("log_weight", DoubleType())]))


def labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, text, _good of the bounded sample of labelled rows."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good"))
    picked = marks.orderBy(F.xxhash64(F.col("doc_id"), F.lit(23)), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def gumbel(seed: Column, *key: str) -> Column:
    """A standard Gumbel number from a hash of seed and key."""
    u = (F.shiftrightunsigned(F.xxhash64(seed, *key), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.ln(-F.ln(u))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, seed: int = SEED, limit: int = SAMPLE, temperature: float = 1.0) -> DataFrame:
    """The sampled rows: ``row``, ``log_weight``, ``sum`` (weight and Gumbel number, in parts of FIXED)."""
    some = labelled(docs, labels, limit)
    ratio = log_ratio(counts(some.where("_good = 1")), counts(docs))
    noisy = weigh(docs, ratio, temperature=temperature)
    noisy = noisy.withColumn("sum", F.floor((F.col("log_weight") + gumbel(F.lit(seed), "row.doc_id", "row.text")) * F.lit(FIXED)).cast(LongType()))
    keys = written(noisy.select("sum"), "sums")
    if k is None:
        if share is None:
            share = some.agg(F.avg("_good")).first()[0] or 1.0
        k = math.ceil(share * keys.count())
    least = kth_highest(keys, "sum", k)
    discard(keys)
    return noisy.where(F.lit(False) if least is None else F.col("sum") >= F.lit(least))


def without_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the resampling rejects."""
    return from_rows(resample(docs, labels))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, sum of each sampled document; a rejected document has no row."""
    return resample(docs, labels).select("row.doc_id", "log_weight", (F.col("sum") / F.lit(float(FIXED))).alias("perturbed"))

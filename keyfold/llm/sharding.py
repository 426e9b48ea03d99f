"""Rendezvous hashing of stable record keys over weighted shards.

Every shard bids for every key with ``-weight / ln(u)``, where u in (0, 1) comes from a hash of key and shard name;
the highest bid gets the record, ties go to the lower shard. A bid depends on nothing but its key and its shard, so one more shard
takes records only into itself (about its share of the weight), and one shard less gives back only its own.

Null keys are hashed as an empty string with a mark of their own; null texts have no bytes; equal keys meet in one shard, and rows that repeat a key (or have none) each have a slot.
Long texts count whole; an empty table gives an empty one.
``assign`` keeps all columns under ``row``, so no name clashes; ``shard_report`` reads doc_id and text only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.ranks import gapless
from keyfold.llm.store import as_rows, written

SEED = 1701
SHARDS = 24


def bid(key: Column, shard: int, weight: float, seed: int = SEED) -> Column:
    """The shard's bid for each key."""
    h = F.xxhash64(F.lit(seed), F.lit(shard), F.coalesce(key.cast("string"), F.lit("\x00null")))
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.ln(u)


def shard_of(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard (0, 1, ...) with the highest bid. Shards of weight 0 get nothing."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    bids = [F.struct(bid(key, i, w, seed).alias("b"), F.lit(-i).alias("s")) for i, w in live]
    best = bids[0] if len(bids) == 1 else F.greatest(*bids)
    return (-best["s"]).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], seed: int = SEED) -> DataFrame:
    """``row`` (all columns of ``df``) and ``shard``; one narrow pass, no shuffle."""
    return as_rows(df).withColumn("shard", shard_of(F.col(f"row.`{key}`"), weights, seed))


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str, seed: int = SEED) -> None:
    """Parquet files in folders shard=0, shard=1, ...; a shard's rows are dealt over many tasks, so none holds a whole shard."""
    assign(df, key, weights, seed).write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document: equal weights, ``shards`` shards."""
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    one = written(docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, [1.0] * shards, seed).alias("shard"),
        shard_of(key, [1.0] * (shards + 1), seed).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_uid"),  # stored with the row: what has no id, or another's, gets a place of its own
    ), "shards")
    return gapless(one, ["shard"], ["doc_id", "text_crc32", "_uid"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

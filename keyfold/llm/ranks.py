"""Gapless numbers within groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def chunk_count(df: DataFrame) -> int:
    """Chunks to deal rows into: as many as shuffles have partitions, which a cluster sets by its data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def gapless(df: DataFrame, groups: list[str], order: list[str], name: str, chunks: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within each group, by (chunk of the order key's hash, order).

    Rows of a group are dealt into chunks by a hash of the order columns, numbered within their chunk, and moved up by the
    sizes of the chunks before. No task sorts a whole group, however large it is, if ``order`` tells its rows apart: callers add a stored unique number where ids may repeat or lack.
    """
    chunks = chunks or chunk_count(df)
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    keys = [*groups, "_chunk"]
    sizes = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = dealt.withColumn("_within", within)
    same: Column = F.lit(True)
    sizes = sizes.select(*(F.col(c).alias(f"_k_{c}") for c in keys), "_before")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = ranked.join(sizes, same)
    return joined.withColumn(name, (F.col("_before") + F.col("_within") - 1).cast("long")).drop("_chunk", "_before", "_within", *(f"_k_{c}" for c in keys))

"""Sets, many keys at once: rows (key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def distinct(log: DataFrame) -> DataFrame:
    return log.select("key", "value").distinct()


def insert_fold(log: DataFrame, maxcount: int) -> DataFrame:
    """Each insert (key, seq, value) with its status. A full set answers OVERFLOWED before it looks for the value, so even to a value that it holds."""
    first = log.groupBy("key", "value").agg(F.min("seq").alias("_f"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("_f"))
    first = first.withColumn("_r", rank)
    full = first.where(F.col("_r") == maxcount).select("key", F.col("_f").alias("_full"))
    known = log.join(first, ["key", "value"]).join(full, "key", "left")
    status = F.when(F.col("seq") > F.col("_full"), "OVERFLOWED").when(F.col("seq") == F.col("_f"), "STORED").otherwise("EXISTS")
    return known.withColumn("status", status).drop("_f", "_r", "_full")


def exist(elements: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (key, value) with ``found``."""
    there = elements.select("key", "value").distinct().withColumn("found", F.lit(True))
    return asked.join(there, ["key", "value"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get(elements: DataFrame, count: int = 0, seed: int | None = None) -> DataFrame:
    """All members of each set, or a uniform sample of ``count`` without replacement: by the MD5 of seed, key and member (the same in any engine), or random without a seed."""
    if not count:
        return elements.select("key", "value")
    draw = F.rand() if seed is None else F.md5(F.concat_ws("|", F.lit(str(seed)), "key", F.col("value").cast("string")).cast("binary"))
    order = Window.partitionBy("key").orderBy("_d", "value")
    return elements.select("key", "value").withColumn("_d", draw).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count).drop("_d", "_r")


def delete(elements: DataFrame, gone: DataFrame) -> DataFrame:
    return elements.join(gone.select("key", "value"), ["key", "value"], "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """An extension: members that both have under the same key."""
    return a.select("key", "value").intersect(b.select("key", "value"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """An extension: members of the first that the second lacks."""
    return a.select("key", "value").subtract(b.select("key", "value"))

"""Scans over keys and prefixes, dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions.keys import NO_PREFIX, matches, prefix_of
from keyfold.model import LETTERS
from keyfold.operators.kv import valid

BUCKETS = 1 << 16


def letter(kind):
    return F.coalesce(*(F.when(kind == t, F.lit(x)) for t, x in LETTERS.items()))


def scan_keys(items: DataFrame, now: int, glob: str = "*", kind: str = "A") -> DataFrame:
    """key, type letter, exptime of live items that match; ``kind``: A for all or one of K L S M B."""
    found = items.where(valid(F.col("exptime"), None, now)).where(matches(F.col("key"), glob))
    found = found.select("key", letter(F.col("type")).alias("type"), "exptime")
    return found if kind == "A" else found.where(F.col("type") == kind)


def scan_page(items: DataFrame, now: int, cursor: tuple[int, str] | None, count: int = 20, glob: str = "*", kind: str = "A") -> tuple[DataFrame, tuple[int, str] | None]:
    """One page of a scan in bucket order, and the cursor of the next one (None: done). Stateless: items that stay are met once, whatever comes or goes between pages."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    found = scan_keys(items, now, glob, kind).withColumn("bucket", bucket)
    if cursor:
        found = found.where((F.col("bucket") > cursor[0]) | ((F.col("bucket") == cursor[0]) & (F.col("key") > F.lit(cursor[1]))))
    page = found.orderBy("bucket", "key").limit(count)
    rows = page.collect()  # a page: bounded by count
    after = (rows[-1]["bucket"], rows[-1]["key"]) if len(rows) == count else None
    out = items.sparkSession.createDataFrame([(r["key"], r["type"], r["exptime"]) for r in rows], "key string, type string, exptime long")
    return out, after


def scan_prefixes(items: DataFrame, now: int, glob: str = "*", delimiter: str = ":") -> DataFrame:
    """prefix, items, bytes of live items by prefix, ``<null>`` among them."""
    live = items.where(valid(F.col("exptime"), None, now)).withColumn("prefix", prefix_of(F.col("key"), delimiter))
    return live.where(matches(F.col("prefix"), glob)).groupBy("prefix").agg(F.count(F.lit(1)).alias("items"), F.sum("nbytes").alias("bytes"))


def cachedump(items: DataFrame, count: int, forward: bool = True, sticky: bool = False) -> DataFrame:
    """key, atime: the most (or least) recently used items, sticky ones or the others."""
    order = F.desc("atime") if forward else F.asc("atime")
    kind = F.col("exptime") == -1 if sticky else F.col("exptime") != -1
    return items.where(kind).orderBy(order, "key").limit(min(count, 200)).select("key", "atime")


def dump_lines(items: DataFrame, now: int, prefix: str | None = None, delimiter: str = ":") -> DataFrame:
    """Lines of a key dump: type letter, key, seconds left (0: never, -1: sticky)."""
    live = items.where(valid(F.col("exptime"), None, now))
    if prefix is not None:
        own = F.col("key").startswith(prefix + delimiter) if prefix != NO_PREFIX else prefix_of(F.col("key"), delimiter) == NO_PREFIX
        live = live.where(own)
    left = F.when(F.col("exptime") <= 0, F.col("exptime")).otherwise(F.col("exptime") - F.lit(now))
    return live.select(F.concat_ws(" ", letter(F.col("type")), "key", left.cast("string")).alias("value"))

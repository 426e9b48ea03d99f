"""Invalidation by time and prefix, compaction, capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyfold.functions.keys import prefix_of
from keyfold.operators.kv import valid


def live(items: DataFrame, now: int, flushed: int | None = None) -> DataFrame:
    """Items alive at ``now``; ``flushed``: the mark of a flush of everything."""
    return items.where(valid(F.col("exptime"), F.col("atime"), now, flushed))


def flush_mark(now: int, delay: int = 0) -> int:
    """The mark that a flush sets: what was stored by the second before it goes."""
    return now + delay - 1


def flush_prefixes(items: DataFrame, marks: DataFrame, now: int, delimiter: str = ":") -> DataFrame:
    """Items left after flushes by prefix (prefix, oldest_live); a prefix is met by its own name before the delimiter."""
    tagged = items.withColumn("_p", prefix_of(F.col("key"), delimiter))
    last = marks.groupBy(F.col("prefix").alias("_p")).agg(F.max("oldest_live").alias("_m"))
    joined = tagged.join(last, "_p", "left")
    return joined.where(valid(F.col("exptime"), F.col("atime"), now, F.col("_m"))).drop("_p", "_m")


def missing_prefixes(items: DataFrame, marks: DataFrame, delimiter: str = ":") -> DataFrame:
    """Prefixes of a flush that no item has (PREFIX_ENOENT)."""
    there = items.select(prefix_of(F.col("key"), delimiter).alias("prefix")).distinct()
    return marks.join(there, "prefix", "left_anti")


def scrub(items: DataFrame, now: int, flushed: int | None = None, mine=None) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row visited and cleaned): dead items go, with ``mine`` (a condition) those of other nodes too."""
    alive = valid(F.col("exptime"), F.col("atime"), now, flushed)
    keep = alive if mine is None else alive & mine
    report = items.agg(F.count(F.lit(1)).alias("visited"), F.count_if(~keep).alias("cleaned"))
    return items.where(keep), report


def _before(rows: DataFrame, order: str, descending: bool = False, buckets: int = 1024) -> DataFrame:
    """``rows`` with ``_above``: the bytes of all rows before each in the order of a numeric column (ties by key), its own left out.

    Sizes are summed by ranges of the column first, and the running sum is then taken within ranges only, so no task orders all rows.
    """
    buckets = max(buckets, 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    span = rows.agg(F.struct(F.min(order).alias("lo"), F.max(order).alias("hi"))).scalar()
    dealt = rows.withColumn("_b", F.floor((F.col(order) - span["lo"]) * F.lit(float(buckets)) / (span["hi"] - span["lo"] + F.lit(1))).cast("int"))
    sort = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    earlier = Window.orderBy(sort("_b")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    sums = dealt.groupBy("_b").agg(F.sum("nbytes").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = Window.partitionBy("_b").orderBy(sort(order), "key").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(sums), "_b").withColumn("_above", F.coalesce(F.sum("nbytes").over(own), F.lit(0)) + F.col("_from")).drop("_b", "_from")


def evict(items: DataFrame, capacity: int, now: int, buckets: int = 1024) -> DataFrame:
    """Items that fit into ``capacity`` bytes when dead ones go first and then the least recently used; sticky ones are not evicted."""
    alive = items.where(valid(F.col("exptime"), None, now))
    sticky = F.col("exptime") == -1
    held = alive.where(sticky).agg(F.coalesce(F.sum("nbytes"), F.lit(0))).scalar()
    kept = _before(alive.where(~sticky), "atime", descending=True, buckets=buckets)
    kept = kept.where(F.col("_above") + F.col("nbytes") + held <= F.lit(capacity)).select(items.columns)
    return kept.unionByName(alive.where(sticky))


def sticky_within(items: DataFrame, limit: int) -> DataFrame:
    """Sticky items (with seq) that were let in: those stored while the bytes before them were under the limit."""
    return _before(items.where(F.col("exptime") == -1), "seq").where(F.col("_above") < F.lit(limit)).select(items.columns)


def accessed(items: DataFrame, reads: DataFrame, granularity: int = 60) -> DataFrame:
    """``items`` with access times after reads (key, ts): a time moves only when it is 60 s old at least, so the last read may not show."""

    last = reads.groupBy("key").agg(F.sort_array(F.collect_set("ts")).alias("_t"))
    moved = F.aggregate(F.coalesce("_t", F.array().cast("array<bigint>")), F.col("atime"), lambda a, t: F.when(t - a >= granularity, t).otherwise(a))
    return items.join(last, "key", "left").withColumn("atime", moved).drop("_t")

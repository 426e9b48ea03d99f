"""Single values: reads of key lists, and closed forms of command logs (key, seq, value, ...) with one kind of command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.functions.keys import NUMBER, UINT64, unsigned


def valid(exptime: Column, atime: Column | None, now: int, flushed: Column | int | None = None) -> Column:
    """Whether items are alive at ``now``: expiry 0 is never, -1 sticky; those last stored at or before the mark of a flush are gone."""
    alive = (exptime <= 0) | (exptime > F.lit(now))
    if flushed is None:
        return alive
    mark = F.lit(flushed) if isinstance(flushed, int) else flushed
    return alive & ~F.coalesce((atime <= mark) & (mark <= F.lit(now)), F.lit(False))


def _readable(items: DataFrame, now: int | None) -> DataFrame:
    """Single values, and with ``now`` the live ones."""
    if "type" in items.columns:
        items = items.where(F.col("type") == "kv")
    return items if now is None else items.where(valid(F.col("exptime"), None, now))


def get(items: DataFrame, keys: DataFrame, now: int | None = None) -> DataFrame:
    """Single values of the asked keys, with ``now`` those alive; misses and collections are left out. With a cas column it is ``gets``."""
    return _readable(items, now).join(keys.select("key").distinct(), "key", "left_semi")


def get_status(items: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """key, status of each asked key: OK, BADTYPE (a collection), NOT_FOUND (absent or expired)."""
    live = items.where(valid(F.col("exptime"), None, now)).select("key", "type")
    known = keys.select("key").distinct().join(live, "key", "left")
    return known.select("key", F.when(F.col("type").isNull(), "NOT_FOUND").when(F.col("type") == "kv", "OK").otherwise("BADTYPE").alias("status"))


def mget(items: DataFrame, keys: DataFrame, now: int | None = None) -> DataFrame:
    """A row for each position of a key list (pos, key) that finds a (live) single value; a repeated key has a row for each of its positions."""
    return keys.join(_readable(items, now), "key")


def set_fold(log: DataFrame) -> DataFrame:
    """Last writer wins."""
    rest = [c for c in log.columns if c != "key"]
    return log.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("_x")).select("key", "_x.*")


def add_fold(items: DataFrame, log: DataFrame) -> DataFrame:
    """What adds store: the first command of each key that isn't there."""
    rest = [c for c in log.columns if c != "key"]
    first = log.groupBy("key").agg(F.min_by(F.struct(*rest), "seq").alias("_x")).select("key", "_x.*")
    return first.join(items.select("key"), "key", "left_anti")


def replace_fold(items: DataFrame, log: DataFrame) -> DataFrame:
    """What replaces store: the last command of each key that is there."""
    return set_fold(log).join(items.select("key"), "key", "left_semi")


def cas(items: DataFrame, log: DataFrame) -> DataFrame:
    """The status of one compare-and-swap a key (key, cas): STORED, EXISTS, NOT_FOUND."""
    known = log.join(items.select("key", F.col("cas").alias("_c")), "key", "left")
    return known.withColumn("status", F.when(F.col("_c").isNull(), "NOT_FOUND").when(F.col("cas") == F.col("_c"), "STORED").otherwise("EXISTS")).drop("_c")


def append_fold(items: DataFrame, log: DataFrame, prepend: bool = False, width: int = 1024) -> DataFrame:
    """key, value after all appends (prepends) of a log, in its order, to values that are there.

    Parts are joined by ranges of ``width`` seqs first, so that a key with a large part of the log is spread over tasks; only the joined ranges meet in the row that holds the value anyway.
    """

    def joined_up(rows: DataFrame, keys: list, order: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct(order, "value")), asc=not prepend)
        return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))

    ranges = joined_up(log.withColumn("_b", F.floor(F.col("seq") / F.lit(width))), ["key", "_b"], "seq")
    added = joined_up(ranges, ["key"], "_b").withColumnRenamed("value", "_a")
    joined = items.join(added, "key")
    return joined.withColumn("value", F.concat("_a", "value") if prepend else F.concat("value", "_a")).drop("_a")


def incr_fold(items: DataFrame, log: DataFrame) -> DataFrame:
    """Keys of a log of increments (key, delta): the item's columns, value (decimal) and status. A sum modulo 2**64, so the order is of no account.

    OK; EINVAL for values (null then) or deltas that are no unsigned 64-bit numbers; NOT_FOUND for keys that aren't there. With columns seq and initial, an absent key is made by the first
    command that has an initial value, and the later ones add to it.
    """
    return _counted(items, log, lambda value, total: (value + total) % F.lit(str(UINT64)).cast(NUMBER))


def decr_fold(items: DataFrame, log: DataFrame) -> DataFrame:
    """The same after decrements: with 0 as the floor, they add up too."""
    return _counted(items, log, lambda value, total: F.greatest(value - total, F.lit(0).cast(NUMBER)))


def _counted(items: DataFrame, log: DataFrame, combine) -> DataFrame:
    log = log.withColumn("_n", unsigned(F.col("delta")))
    sums = [F.sum("_n").alias("_d"), F.count_if(F.col("_n").isNull()).alias("_bad")]
    total = log.groupBy("key").agg(*sums)
    known = total.join(items.withColumn("_v", unsigned(F.col("value"))).withColumn("_there", F.lit(True)), "key", "left")
    if "initial" in log.columns:
        first = log.groupBy("key").agg(F.min_by(F.struct("seq", "initial"), F.when(F.col("initial").isNotNull(), F.col("seq"))).alias("_i")).where("_i IS NOT NULL")
        later = log.join(first, "key").where(F.col("seq") > F.col("_i.seq")).groupBy("key").agg(F.sum("_n").alias("_l"))
        known = known.join(first, "key", "left").join(later, "key", "left")
        known = known.withColumn("_made", F.col("_there").isNull() & F.col("_i").isNotNull())
        known = known.withColumn("_v", F.when(F.col("_made"), unsigned(F.col("_i.initial"))).otherwise(F.col("_v"))).withColumn("_d", F.when(F.col("_made"), F.coalesce("_l", F.lit(0).cast(NUMBER))).otherwise(F.col("_d")))
        there = F.coalesce(F.col("_there"), F.col("_made"))
    else:
        there = F.coalesce(F.col("_there"), F.lit(False))
    status = F.when(~there, "NOT_FOUND").when(F.col("_v").isNull() | (F.col("_bad") > 0), "EINVAL").otherwise("OK")
    out = known.withColumn("status", status).withColumn("value", F.when(status == "OK", combine(F.col("_v"), F.col("_d")).cast(NUMBER)))
    return out.select(*items.columns, "status")


def count_fold(log: DataFrame) -> DataFrame:
    """key, value after increments and decrements (key, seq, op, delta) in order, from 0: each decrement stops at 0.

    With the running balance S over a key's commands (decrements negative), the value is S less the least S met so far, where that is below 0. A window does it, without a
    loop over commands; wrapping at 2**64 is left to the fold.
    """
    from pyspark.sql import Window

    upto = Window.partitionBy("key").orderBy("seq")
    signed = F.when(F.col("op") == "incr", F.col("delta")).otherwise(-F.col("delta"))
    s = log.withColumn("_s", F.sum(signed).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("key").agg((F.max_by("_s", "seq") - F.least(F.min("_s"), F.lit(0))).alias("value"))


def delete(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items without those deleted, whatever their type. With a column cas in ``keys``, one other than 0 must be the item's."""
    if "cas" not in keys.columns:
        return items.join(keys.select("key").distinct(), "key", "left_anti")
    asked = keys.select("key", F.coalesce("cas", F.lit(0)).alias("_c")).distinct()
    return items.join(asked, (items["key"] == asked["key"]) & ((asked["_c"] == 0) | (asked["_c"] == items["cas"])), "left_anti")


def touch(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items with the expiry of the last touch of each key; others keep theirs. Joined to the keys asked it is also the write of ``gat``."""
    last = log.groupBy("key").agg(F.max_by("exptime", "seq").alias("_e"))
    return items.join(last, "key", "left").withColumn("exptime", F.coalesce("_e", "exptime")).drop("_e")


def get_and_touch(items: DataFrame, keys: DataFrame, exptime: int) -> DataFrame:
    """Single values of the asked keys with their new expiry; collections give none."""
    return get(items.where(F.col("type") == "kv") if "type" in items.columns else items, keys).withColumn("exptime", F.lit(exptime).cast("long"))

"""Lists, many keys at once: rows (key, seq, value), ordered by seq; indexes from 0, negative ones from the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def indexed(elements: DataFrame) -> DataFrame:
    """Adds ``idx`` and ``ccnt``."""
    w = Window.partitionBy("key")
    return elements.withColumns({"idx": F.row_number().over(w.orderBy("seq")) - 1, "ccnt": F.count(F.lit(1)).over(w)})


def _bounds(i: int, j: int) -> tuple[Column, Column, Column]:
    """First and last index of a range within each list, and whether both ends are out on one side."""
    n = F.col("ccnt")
    a, b = (F.lit(x) if x >= 0 else n + F.lit(x) for x in (i, j))
    out = ((a >= n) & (b >= n)) | ((a < 0) & (b < 0))
    return F.greatest(F.least(a, n - 1), F.lit(0)), F.greatest(F.least(b, n - 1), F.lit(0)), out


def get(elements: DataFrame, i: int, j: int | None = None) -> DataFrame:
    """Elements of a range, cut to the list; backwards if it begins after its end. ``rank`` from 1 in the order read.

    Indexes from the front need row numbers only, which Spark cuts off before the shuffle; those from the end need each list's length.
    """
    j = i if j is None else j
    if min(i, j) >= 0:
        own = Window.partitionBy("key")
        found = elements.withColumn("_r", F.row_number().over(own.orderBy("seq"))).where((F.col("_r") <= max(i, j) + 1) & (F.col("_r") > min(i, j)))
        found = found.withColumn("idx", F.col("_r") - 1).drop("_r")
        rank = F.col("idx") - i + 1 if i <= j else F.max("idx").over(own) - F.col("idx") + 1  # of the few that are left
        return found.withColumn("rank", rank.cast("long"))
    a, b, out = _bounds(i, j)
    found = indexed(elements).withColumns({"_a": a, "_b": b}).where(~out & F.col("idx").between(F.least("_a", "_b"), F.greatest("_a", "_b")))
    rank = F.abs(F.col("idx") - F.col("_a")) + 1
    return found.withColumn("rank", rank.cast("long")).drop("_a", "_b", "ccnt")


def delete(elements: DataFrame, i: int, j: int | None = None) -> DataFrame:
    """What is left without the elements of a range."""
    a, b, out = _bounds(i, i if j is None else j)
    kept = indexed(elements).withColumns({"_a": a, "_b": b}).where(out | ~F.col("idx").between(F.least("_a", "_b"), F.greatest("_a", "_b")))
    return kept.drop("_a", "_b", "idx", "ccnt")


def bounded(pushes: DataFrame, maxcount: int, at_head: bool = False, ovflaction: str = "tail_trim") -> DataFrame:
    """A list after pushes (key, seq, value) all at one end: a push at an end evicts at the other, so the last ``maxcount`` stay; with error, the first."""
    order = F.asc("seq") if ovflaction == "error" else F.desc("seq")
    kept = pushes.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(order))).where(F.col("_r") <= maxcount).drop("_r")
    return kept.withColumn("seq", -F.col("seq")) if at_head else kept


def insert_status(idx: int, ccnt: Column, maxcount: Column) -> Column:
    """Whether an index can take an insert: -1 appends, below it counts from the end."""
    if idx >= 0:
        ok = (F.lit(idx) <= ccnt) & (F.lit(idx) <= maxcount - 1)
    else:
        ok = (F.lit(-idx) <= ccnt + 1) & (F.lit(-idx) <= maxcount)
    return F.when(ok, "STORED").otherwise("OUT_OF_RANGE")


def insert(elements: DataFrame, inserts: DataFrame, maxcount: int, ovflaction: str = "tail_trim") -> tuple[DataFrame, DataFrame]:
    """(the lists (key, idx, value) after it, key and status) of one insert a key (key, idx, value) at any index.

    OUT_OF_RANGE where the index can't take an insert; OVERFLOWED in a full list with error; else STORED. A full list first drops an element: that of the other end if the insert
    is at an end (0 or -1), else that of the end that its action names, by which the index moves along.
    """
    sizes = elements.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    asked = inserts.select("key", F.col("idx").alias("_i"), F.col("value").alias("_v")).join(sizes, "key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    i, n = F.col("_i"), F.col("_n")
    ok = F.when(i >= 0, (i <= n) & (i <= maxcount - 1)).otherwise((-i <= n + 1) & (-i <= maxcount))
    full = n >= maxcount
    asked = asked.withColumn("status", F.when(~ok, "OUT_OF_RANGE").when(full & F.lit(ovflaction == "error"), "OVERFLOWED").otherwise("STORED"))
    head = F.when(i == -1, True).when(i == 0, False).otherwise(ovflaction == "head_trim")  # which end drops one
    moved = F.when(full & head & (i > 0), i - 1).when(full & ~head & (i < -1), i + 1).otherwise(i)
    left = F.when(full, n - 1).otherwise(n)
    at = F.when(moved < 0, F.greatest(moved + left + 1, F.lit(0))).otherwise(moved)
    stored = asked.where("status = 'STORED'").select("key", "_v", at.alias("_at"), (full & head).alias("_h"), (full & ~head).alias("_t"), "_n")
    old = elements.withColumn("_x", F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1).join(stored.drop("_v"), "key", "left")
    gone = F.coalesce(F.col("_h") & (F.col("_x") == 0) | F.col("_t") & (F.col("_x") == F.col("_n") - 1), F.lit(False))
    x = F.col("_x") - F.coalesce(F.col("_h"), F.lit(False)).cast("int")
    old = old.where(~gone).select("key", F.when(F.col("_at").isNotNull() & (x >= F.col("_at")), x + 1).otherwise(x).cast("long").alias("idx"), "value")
    new = stored.select("key", F.col("_at").cast("long").alias("idx"), F.col("_v").alias("value"))
    return old.unionByName(new), asked.select("key", "status")

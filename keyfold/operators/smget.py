"""Sort-merge reads over many trees: the first rows of all their ranges in one global order, and which keys could not take part or be read to their end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


@dataclass
class SortMerge:
    rows: DataFrame  # rank (from 1), key, bkey, value
    missed: DataFrame  # pos, key, cause: NOT_FOUND, UNREADABLE, OUT_OF_RANGE
    trimmed: DataFrame  # key, bkey: the last one before the trim, in the order of the read

    def status(self) -> str:
        """DUPLICATED if two neighbouring rows share a bkey, else END. Runs a job."""
        same = self.rows.groupBy("bkey").count().where("count > 1")
        return "END" if same.isEmpty() else "DUPLICATED"


def check(items: DataFrame, keys: DataFrame, kind: str | None = None) -> None:
    """One key of another type fails the whole call; with ``kind`` (and a column bkeytype) so does a tree with element keys of the other kind. Runs a job."""
    asked = items.join(keys.select("key").distinct(), "key", "left_semi")
    if not asked.where(F.col("type") != "btree").isEmpty():
        raise ValueError("TYPE_MISMATCH")
    if kind and not asked.where(F.col("bkeytype") != F.lit(kind)).isEmpty():
        raise ValueError("BKEY_MISMATCH")


def smget(items: DataFrame, elements: DataFrame, keys: DataFrame, a: object, b: object, offset: int, count: int, unique: bool = False, efilter: Column | None = None) -> SortMerge:
    """``keys``: pos, key; ``items``: key, type, readable, ovflaction, trimmed (and least and most where trees are trimmed).

    Rows are ordered by bkey, ties by key, both downwards if a > b; ``unique`` keeps the first row of each bkey, before the offset. The first rows of each
    partition are merged (no global sort), and rows beyond them are never shuffled.
    """
    up = a <= b
    lo, hi = (a, b) if up else (b, a)
    elements = elements.join(keys.select("key").distinct(), "key", "left_semi")
    met = (F.col("bkey") >= F.lit(a)) & (F.col("bkey") < F.lit(b)) if up else (F.col("bkey") <= F.lit(a)) & (F.col("bkey") > F.lit(b))
    edge = elements.groupBy("key").agg(F.min("bkey").alias("least"), F.max("bkey").alias("most"), F.count_if(met).alias("between"))
    known = keys.join(items.select("key", "readable", "ovflaction", "trimmed"), "key", "left").join(edge, "key", "left")
    smallest = F.coalesce(F.col("trimmed") & (F.col("ovflaction") == "smallest_trim"), F.lit(False))
    largest = F.coalesce(F.col("trimmed") & (F.col("ovflaction") == "largest_trim"), F.lit(False))
    beyond = (smallest & (F.lit(a) < F.col("least"))) | (largest & (F.lit(a) > F.col("most")))
    cause = F.when(F.col("readable").isNull(), "NOT_FOUND").when(~F.col("readable"), "UNREADABLE").when(F.coalesce(beyond, F.lit(False)), "OUT_OF_RANGE")
    known = known.withColumn("cause", cause)
    missed = known.where(F.col("cause").isNotNull()).select("pos", "key", "cause")
    taking = known.where(F.col("cause").isNull() & F.col("least").isNotNull())
    found = elements.join(taking.select("key").distinct(), "key", "left_semi").where(F.col("bkey").between(F.lit(lo), F.lit(hi)))
    if efilter is not None:
        found = found.where(efilter)
    by_key = F.asc("key") if up else F.desc("key")
    order = [F.asc("bkey") if up else F.desc("bkey"), by_key]
    if unique:
        first = F.min_by if up else F.max_by
        rest = [c for c in found.columns if c != "bkey"]
        found = found.groupBy("bkey").agg(first(F.struct(*rest), "key").alias("_x")).select("bkey", "_x.*")
    top = found.orderBy(*order).limit(offset + count)
    rows = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset)

    # trees read down to a trimmed edge: reported unless the rows are full and end before it
    side, end = (largest, F.col("most")) if up else (smallest, F.col("least"))
    off = (F.lit(b) > end) if up else (F.lit(b) < end)
    off = off | ((F.lit(b) == end) & (F.col("between") == 0))
    side = side & F.lit(a != b)  # a single key is met or not
    ran = taking.where(side).where(off).select("key", end.alias("bkey")).distinct()
    last = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), (F.max("bkey") if up else F.min("bkey")).alias("last")).alias("x")).scalar()
    before = F.col("bkey") < last["last"] if up else F.col("bkey") > last["last"]
    trimmed = ran.where((last["n"] < count) | before).select("key", "bkey")
    return SortMerge(rows, missed, trimmed)


def old_smget(found: SortMerge) -> tuple[DataFrame, bool]:
    """The older form of a result: positions of the missed keys, and one flag for all trims. Runs a job."""
    return found.missed.select("pos"), not found.trimmed.isEmpty()

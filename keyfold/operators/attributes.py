"""Attributes of items: reading, setting, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyfold.model import DEFAULT_COUNT, MAX_COUNT

ACTIONS = {
    "list": ("error", "head_trim", "tail_trim"),
    "set": ("error",),
    "map": ("error",),
    "btree": ("error", "smallest_trim", "largest_trim", "smallest_silent_trim", "largest_silent_trim"),
}
DEFAULT_ACTION = {"list": "tail_trim", "set": "error", "map": "error", "btree": "smallest_trim"}
KV_NAMES = ("type", "flags", "expiretime", "exptime")  # what single values have; other names are of collections


def getattr_status(items: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """key, status of a request for attributes: NOT_FOUND; EBADATTR, where a single value is asked for what only collections have; else OK."""
    known = keys.select("key").distinct().join(items.select("key", "type"), "key", "left")
    bad = (F.col("type") == "kv") & F.lit(any(n not in KV_NAMES for n in names))
    return known.select("key", F.when(F.col("type").isNull(), "NOT_FOUND").when(bad, "EBADATTR").otherwise("OK").alias("status"))


def create(items: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items after it, key and status) of empty collections to be made (key, and other columns of ``items``): EXISTS where the key is there, whatever its type, else CREATED. The first of
    equal keys (by seq, if there is one) makes it."""
    order = F.col("seq") if "seq" in asked.columns else F.lit(0)
    ranked = asked.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(order))).join(items.select("key", F.lit(True).alias("_there")), "key", "left")
    made = F.col("_there").isNull() & (F.col("_r") == 1)
    statuses = ranked.select("key", *(["seq"] if "seq" in asked.columns else []), F.when(made, "CREATED").otherwise("EXISTS").alias("status"))
    new = ranked.where(made).select(*(F.col(c) if c in asked.columns else F.lit(None).cast(items.schema[c].dataType).alias(c) for c in items.columns))
    return items.unionByName(new), statuses


def getattr_rows(items: DataFrame, elements: DataFrame, names: list[str]) -> DataFrame:
    """key, pos, name, value (text) of attributes in the order asked, of the items whose type has them all. ``elements``: key and, for trees, bkey."""
    if any(n not in KV_NAMES for n in names):
        items = items.where(F.col("type") != "kv")
    sizes = [F.count(F.lit(1)).alias("count")]
    if "bkey" in elements.columns:
        sizes += [F.min("bkey").cast("string").alias("minbkey"), F.max("bkey").cast("string").alias("maxbkey")]
    joined = items.join(elements.groupBy("key").agg(*sizes), "key", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    pairs = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names)))
    return joined.select("key", F.explode(pairs).alias("x")).select("key", "x.*")


def setattr_status(changes: DataFrame, items: DataFrame, sizes: DataFrame) -> DataFrame:
    """``changes`` (key and any of exptime, maxcount, ovflaction, readable, maxbkeyrange; null: as it is) with ``status``; all of a change or nothing applies.

    Not found; attributes that the type lacks (ATTR_ERROR not found); a bound under the present count, an action that the type lacks,
    readable set to off, stickiness turned on or off, or a range bound under the present span (ATTR_ERROR bad value).
    """
    own = items.select("key", "type", F.col("exptime").alias("_exp"))
    known = changes.join(own, "key", "left").join(sizes, "key", "left")
    c = {n: F.col(n) if n in changes.columns else F.lit(None) for n in ("exptime", "maxcount", "ovflaction", "readable", "maxbkeyrange")}
    lacks = (F.col("type") == "kv") & (c["maxcount"].isNotNull() | c["ovflaction"].isNotNull() | c["readable"].isNotNull()) | (F.col("type") != "btree") & c["maxbkeyrange"].isNotNull()
    ok_action = F.lit(False)
    for kind, actions in ACTIONS.items():
        ok_action = ok_action | ((F.col("type") == kind) & c["ovflaction"].isin(*actions))
    count = F.coalesce("count", F.lit(0)) if "count" in sizes.columns else F.lit(0)
    span = (F.col("maxbkey") - F.col("minbkey")) if "maxbkey" in sizes.columns else F.lit(None).cast("long")
    bad = (
        (c["exptime"].isNotNull() & ((c["exptime"] == -1) != (F.col("_exp") == -1)))
        | (c["maxcount"].isNotNull() & (effective_maxcount(c["maxcount"]) < count))
        | (c["ovflaction"].isNotNull() & ~ok_action)
        | (c["readable"].isNotNull() & ~F.coalesce(c["readable"].cast("boolean"), F.lit(True)))
        | (c["maxbkeyrange"].isNotNull() & (c["maxbkeyrange"] != 0) & F.coalesce(span > c["maxbkeyrange"], F.lit(False)))
    )
    status = F.when(F.col("type").isNull(), "NOT_FOUND").when(F.coalesce(lacks, F.lit(False)), "ATTR_ERROR not found").when(F.coalesce(bad, F.lit(False)), "ATTR_ERROR bad value").otherwise("OK")
    return known.withColumn("status", status).select(*changes.columns, "status")


def setattr_apply(items: DataFrame, checked: DataFrame) -> DataFrame:
    """``items`` after the changes with status OK. A new overflow action clears the trimmed mark."""
    names = [c for c in checked.columns if c not in ("key", "status")]
    new = checked.where("status = 'OK'").select("key", *(F.col(n).alias(f"_{n}") for n in names))
    out = items.join(new, "key", "left")
    if "ovflaction" in names and "trimmed" in items.columns:
        changed = F.coalesce(F.col("_ovflaction") != F.col("ovflaction"), F.lit(False))
        out = out.withColumn("trimmed", F.col("trimmed") & ~changed)
    for n in names:
        new_value = effective_maxcount(F.col(f"_{n}")) if n == "maxcount" else F.col(f"_{n}")
        out = out.withColumn(n, F.when(F.col(f"_{n}").isNotNull(), new_value).otherwise(F.col(n) if n in items.columns else F.lit(None)))
    return out.drop(*(f"_{n}" for n in names))


def effective_maxcount(maxcount):
    """0: the default; below 0: whatever the server allows; above that: cut to it."""
    return F.when(maxcount == 0, F.lit(DEFAULT_COUNT)).when((maxcount < 0) | (maxcount > MAX_COUNT), F.lit(MAX_COUNT)).otherwise(maxcount)

"""A consistent-hash ring: 160 points a node, from MD5; a key belongs to the node of the first point at or after its hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

POINTS = 40  # digests a node, of four points each
MOST = 1 << 16  # points of a ring that is broadcast
_WIDTH = 1 << 20  # hashes of a range


def _point(digest: Column, i: int) -> Column:
    """Four bytes of a hex digest, least significant first."""
    at = 8 * i
    return F.conv(F.concat(*(F.substring(digest, at + 1 + 2 * j, 2) for j in (3, 2, 1, 0))), 16, 10).cast("long")


def key_hash(key: Column) -> Column:
    return _point(F.md5(key.cast("binary")), 0)


def build(nodes: DataFrame) -> DataFrame:
    """hpoint, node from a column ``node``: 160 points each."""
    digests = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("i"))
    digests = digests.select("node", F.md5(F.concat_ws("-", "node", F.col("i").cast("string")).cast("binary")).alias("d"))
    return digests.select("node", F.explode(F.array(*(_point(F.col("d"), i) for i in range(4)))).alias("hpoint"))


def lookup(keys: DataFrame, ring: DataFrame, most: int = MOST) -> DataFrame:
    """``keys`` with hash, hpoint and node. Equal points go to the lesser node; past the last point comes the first.

    A ring of at most ``most`` points, which a count that stops there checks, is broadcast: as intervals between points, by ranges of the hash space, so that a key meets one or two of
    them and keys aren't shuffled. A larger one is joined as of each hash, by ranges as well.
    """
    if ring.limit(most + 1).count() > most:
        return _lookup_by_ranges(keys, ring)
    points = ring.groupBy("hpoint").agg(F.min("node").alias("node"))
    order = Window.orderBy("hpoint")  # at most ``most`` rows
    points = points.withColumn("above", F.coalesce(F.lag("hpoint").over(order), F.lit(-1)))
    wrap = points.agg(F.min_by(F.struct("hpoint", "node"), "hpoint").alias("p"), F.max("hpoint").alias("above")).where("p IS NOT NULL")
    upto = F.lit((1 << 32) - 1)
    spans = points.select("hpoint", "node", "above", F.col("hpoint").alias("upto")).unionByName(wrap.select("p.hpoint", "p.node", "above", upto.alias("upto")))
    spans = spans.where("above < upto").withColumn("range", F.explode(F.sequence(F.floor((F.col("above") + 1) / _WIDTH), F.floor(F.col("upto") / _WIDTH))))
    hashed = keys.withColumn("hash", key_hash(F.col("key")))
    met = (F.floor(F.col("hash") / _WIDTH) == F.col("range")) & (F.col("hash") > F.col("above")) & (F.col("hash") <= F.col("upto"))
    return hashed.join(F.broadcast(spans), met).drop("above", "upto", "range")


def _lookup_by_ranges(keys: DataFrame, ring: DataFrame, buckets: int = 256) -> DataFrame:
    """A forward as-of join: points and keys are dealt into ranges of the hash space, each range also gets the first point after it, and within a range
    the next point is a running minimum from above. Neither side is collected or broadcast.
    """
    width = (1 << 32) // buckets
    points = ring.groupBy("hpoint").agg(F.min("node").alias("node")).withColumn("range", F.floor(F.col("hpoint") / width).cast("int"))
    first = points.groupBy("range").agg(F.min(F.struct("hpoint", "node")).alias("p"))
    ahead = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)  # at most ``buckets`` rows
    every = keys.sparkSession.range(buckets).select(F.col("id").cast("int").alias("range"))
    after = every.join(first, "range", "left").withColumn("next", F.first("p", ignorenulls=True).over(ahead))
    lowest = F.first("p", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = after.select("range", F.coalesce("next", lowest).alias("beyond"))
    left = keys.withColumn("hash", key_hash(F.col("key"))).withColumn("range", F.floor(F.col("hash") / width).cast("int"))
    left = left.select(F.struct(*keys.columns, "hash").alias("row"), "range", F.col("hash").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<hpoint:bigint,node:string>").alias("p"))
    right = points.select(F.lit(None).cast(left.schema["row"].dataType).alias("row"), "range", F.col("hpoint").alias("at"), F.lit(0).alias("kind"), F.struct("hpoint", "node").alias("p"))
    order = Window.partitionBy("range").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("own", F.last("p", ignorenulls=True).over(order)).where("kind = 1")
    both = both.join(after, "range").withColumn("hit", F.coalesce("own", "beyond"))
    return both.select("row.*", F.col("hit.hpoint").alias("hpoint"), F.col("hit.node").alias("node"))

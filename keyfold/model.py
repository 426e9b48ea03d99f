"""Collections over relational tables: every read operator takes these frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of the command language; operators check them only when asked to.
MAX_COUNT, DEFAULT_COUNT, MAX_ELEMENT_BYTES = 50_000, 4_000, 16_384
MGET_KEYS, MGET_COUNT, SMGET_KEYS, SMGET_ROWS, SET_SAMPLE, PIPELINE = 200, 50, 10_000, 2_000, 1_000, 500

TYPES = ("kv", "list", "set", "map", "btree")
LETTERS = {"kv": "K", "list": "L", "set": "S", "map": "M", "btree": "B"}
ITEMS = "key string, type string, flags long, exptime long, atime long, cas long, nbytes long, readable boolean, maxcount long, ovflaction string, trimmed boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered trees: a key for each customer, orders by number; the flag is the priority's digit."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("cust:"), "o_custkey").alias("key"),
        F.col("o_orderkey").alias("bkey"),
        F.unhex(F.concat(F.lit("0"), F.substring("o_orderpriority", 1, 1))).alias("eflag"),
        F.col("o_totalprice").alias("value"),
    )


def event_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered trees: a key for each user, events by number."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("bkey"), "event_type", "value")


def line_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists: a key for each order, its lines in order."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("order:"), "l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.col("l_extendedprice").alias("value"))


def segment_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets: a key for each market segment, nations as members, with repeats."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("seg:"), "c_mktsegment").alias("key"), F.col("c_nationkey").cast("long").alias("value"), F.col("c_custkey").alias("seq"))


def nation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps: a key for each region, nations as fields."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("nation:"), "n_regionkey").alias("key"), F.col("n_name").alias("field"), F.col("n_nationkey").cast("long").alias("value"))


def part_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single values: a key for each part."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part:"), "p_partkey").alias("key"), F.col("p_name").alias("value"), F.col("p_size").cast("long").alias("flags"), F.col("p_partkey").alias("cas"))


def event_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command log: key (user and event kind), seq, ts, op, number."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("op"), "value")

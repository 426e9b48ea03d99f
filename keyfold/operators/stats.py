"""Usage statistics: by prefix, by command, hot keys, long queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyfold.functions.keys import prefix_of
from keyfold.model import TYPES

MAX_PREFIXES = 50
LONG = 4000
SAMPLES = 20


def by_prefix(items: DataFrame, delimiter: str = ":") -> DataFrame:
    """prefix; items and bytes, in all and of each type."""
    tagged = items.withColumn("prefix", prefix_of(F.col("key"), delimiter))
    one = [F.count(F.lit(1)).alias("itm")] + [F.count_if(F.col("type") == t).alias(f"{t[0]}itm") for t in TYPES]
    size = [F.sum("nbytes").alias("tsz")] + [F.coalesce(F.sum(F.when(F.col("type") == t, F.col("nbytes"))), F.lit(0)).alias(f"{t[0]}tsz") for t in TYPES]
    return tagged.groupBy("prefix").agg(*one, *size)


def prefix_limit(stats: DataFrame, most: int = MAX_PREFIXES) -> DataFrame:
    """The statistics, or an error where there are too many prefixes to list. Runs a job that reads at most one more than that."""
    if stats.limit(most + 1).count() > most:
        raise ValueError("too many prefixes")
    return stats


def by_command(log: DataFrame, commands: list[str], delimiter: str = ":") -> DataFrame:
    """prefix; calls and hits of each command of a log (key, op, hit)."""
    tagged = log.withColumn("prefix", prefix_of(F.col("key"), delimiter))
    cols = []
    for c in commands:
        own = F.col("op") == c
        cols += [F.count_if(own).alias(c), F.count_if(own & F.col("hit")).alias(f"{c}_hits")]
    return tagged.groupBy("prefix").agg(*cols)


def rolled_up(items: DataFrame, levels: list[str]) -> DataFrame:
    """Counts and bytes for each level of a prefix hierarchy and for all above it."""
    return items.rollup(*levels).agg(F.count(F.lit(1)).alias("items"), F.sum("nbytes").alias("bytes"))


def top_keys(log: DataFrame, most: int, commands: list[str]) -> DataFrame:
    """Counts by command and times of first and last use of the ``most`` recently used keys of a log (key, seq, ts, op)."""
    used = log.groupBy("key").agg(*(F.count_if(F.col("op") == c).alias(c) for c in commands), F.count(F.lit(1)).alias("total"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return used.orderBy(F.desc("last_seq"), "key").limit(most)


def query_cost(op: Column, frm: Column, elements: Column) -> Column:
    """Elements that a command touches: list reads also walk to the index that they begin at. For reads of trees ``elements`` is what ``btree.visits`` counts."""
    walk = F.when(frm >= 0, frm + 1).otherwise(-frm)
    return F.when(op == "lop_insert", walk).when(op.isin("lop_get", "lop_delete"), elements + walk).otherwise(elements)


def long_queries(log: DataFrame, threshold: int = LONG, samples: int = SAMPLES) -> DataFrame:
    """op, seq, argument, cost: the first ``samples`` different arguments of each command among queries (op, seq, argument, cost) over the threshold."""
    heavy = log.where(F.col("cost") >= threshold)
    first = heavy.groupBy("op", "argument").agg(F.min_by(F.struct("seq", "cost"), "seq").alias("_x")).select("op", "argument", "_x.*")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("op").orderBy("seq"))).where(F.col("_r") <= samples).drop("_r")


def long_query_totals(log: DataFrame, threshold: int = LONG) -> DataFrame:
    """op, ntotal: every query over the threshold counts, kept as a sample or not."""
    return log.where(F.col("cost") >= threshold).groupBy("op").agg(F.count(F.lit(1)).alias("ntotal"))


def sizes(items: DataFrame, step: int = 32) -> DataFrame:
    """bytes (rounded up to the step), items."""
    return items.groupBy((F.ceil(F.col("nbytes") / step) * step).cast("long").alias("bytes")).agg(F.count(F.lit(1)).alias("items"))


def since(log: DataFrame, reset_seq: int) -> DataFrame:
    """The log from a reset of the counters on."""
    return log.where(F.col("seq") > reset_seq)

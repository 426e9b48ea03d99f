"""Sources and sinks: command text, logs, snapshots, key dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators.scan import dump_lines

STORES = ("set", "add", "replace", "append", "prepend")
COLLECTIONS = ("lop", "sop", "mop", "bop")


def parse(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns to ``keep``, op, key, arguments, noreply of command lines (column ``value``); lines of no known command are CLIENT_ERROR rows with a null op.

    Single-value commands are ``op key ...``; collection commands ``kind op key ...``, whose op gets the form ``bop insert``. Commands on lists of keys
    (``mget``, ``bop mget``, ``bop smget``) have them in the line that follows, so their key is null and the list's length and number are arguments.
    """
    parts = F.split(F.trim("value"), r"[ \t]+")
    first = F.get(parts, F.lit(0))
    two = first.isin(*COLLECTIONS)
    op = F.when(two, F.concat_ws(" ", first, F.get(parts, F.lit(1)))).when(first.isin(*STORES, "cas", "get", "gets", "mget", "mgets", "delete", "incr", "decr", "touch", "gat", "gats", "getattr", "setattr", "flush_all", "flush_prefix", "scan"), first)
    key = F.when(two, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    rest = F.when(two, F.slice(parts, 4, 1_000_000)).otherwise(F.slice(parts, 3, 1_000_000))
    listed = op.isin("mget", "mgets", "bop mget", "bop smget")
    rest = F.when(listed, F.concat(F.array(key), rest)).otherwise(rest)
    key = F.when(~listed, key)
    quiet = F.element_at(parts, -1).isin("noreply", "pipe")
    args = F.filter(rest, lambda x: ~x.isin("noreply", "pipe"))
    return lines.select(*(keep or []), op.alias("op"), F.when(op.isNotNull(), key).alias("key"), F.when(op.isNotNull(), args).alias("arguments"), quiet.alias("noreply"), F.when(op.isNull(), "CLIENT_ERROR").alias("error"))


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def key_list(text: str) -> list[str]:
    """Keys of a list, by spaces or, in the old form, commas."""
    return [k for k in text.replace(",", " ").split(" ") if k]


def write_log(commands: DataFrame, path: str) -> None:
    """Appends ``time client command`` lines."""
    commands.select(F.concat_ws(" ", F.date_format("ts", "HH:mm:ss.SSSSSS"), "client", "command")).write.mode("append").text(path)


def write_snapshot(items: DataFrame, elements: DataFrame, path: str) -> None:
    """Items, and elements sorted by key and element key, so that range reads skip row groups."""
    items.write.mode("overwrite").parquet(f"{path}/items")
    elements.repartitionByRange("key", "bkey").sortWithinPartitions("key", "bkey").write.mode("overwrite").parquet(f"{path}/elements")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/elements")


def recover(snapshot: DataFrame, log: DataFrame, taken_at: int) -> DataFrame:
    """Single values (key, seq, value, ...) of a snapshot with the log's later sets and deletes (op, null value) redone."""
    later = log.where(F.col("seq") > taken_at)
    rest = [c for c in snapshot.columns if c != "key"]
    both = snapshot.withColumn("op", F.lit("set")).unionByName(later.select("key", *rest, "op"))
    last = both.groupBy("key").agg(F.max_by(F.struct(*rest, "op"), "seq").alias("_x")).select("key", "_x.*")
    return last.where("op = 'set'").drop("op")


def recover_elements(snapshot: DataFrame, log: DataFrame, taken_at: int) -> DataFrame:
    """Elements of collections (key, element, value, seq: a tree's bkey, a map's field, a set's member) of a snapshot with the log's later commands redone.

    ``log``: key, element, value, seq, op: ``put`` (any insert, upsert or update that was stored), ``delete`` (one element), ``drop`` (the whole key; element null). The last command of an
    element holds unless its key was dropped after it.
    """
    later = log.where(F.col("seq") > taken_at)
    both = snapshot.select("key", "element", "value", "seq", F.lit("put").alias("op")).unionByName(later.where("op <> 'drop'").select("key", "element", "value", "seq", "op"))
    last = both.groupBy("key", "element").agg(F.max_by(F.struct("value", "seq", "op"), "seq").alias("_x")).select("key", "element", "_x.*")
    drops = later.where("op = 'drop'").groupBy("key").agg(F.max("seq").alias("_d"))
    kept = last.join(drops, "key", "left").where((F.col("op") == "put") & (F.col("_d").isNull() | (F.col("seq") > F.col("_d"))))
    return kept.select("key", "element", "value", "seq")


def write_dump(items: DataFrame, path: str, now: int, prefix: str | None = None) -> None:
    dump_lines(items, now, prefix).write.mode("overwrite").text(path)

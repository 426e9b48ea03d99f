"""Maps, many keys at once: rows (key, field, value), unique by (key, field)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _fold(log: DataFrame, pick) -> DataFrame:
    rest = [c for c in log.columns if c not in ("key", "field")]
    return log.groupBy("key", "field").agg(pick(F.struct(*rest), "seq").alias("_x")).select("key", "field", "_x.*")


def insert_fold(log: DataFrame, maxcount: int | None = None) -> DataFrame:
    """First writer wins; of more than ``maxcount`` fields the first to come stay. A field that is there answers EXISTS, full or not."""
    kept = _fold(log, F.min_by)
    if maxcount is None:
        return kept
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where(F.col("_r") <= maxcount).drop("_r")


def upsert_fold(log: DataFrame) -> DataFrame:
    return _fold(log, F.max_by)


def update(elements: DataFrame, updates: DataFrame) -> DataFrame:
    """New values for fields that are there; of several updates of a field (with seq) the last one holds."""
    new = updates.groupBy("key", "field").agg(F.max_by(F.struct("value"), "seq" if "seq" in updates.columns else "value").alias("_v"))
    return elements.join(new, ["key", "field"], "left").withColumn("value", F.when(F.col("_v").isNotNull(), F.col("_v.value")).otherwise(F.col("value"))).drop("_v")


def get(elements: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Asked fields with ``pos``, their place in the request (missing ones are left out), or all."""
    if not fields:
        return elements
    pos = F.array_position(F.array(*(F.lit(f) for f in fields)), F.col("field")) - 1
    return elements.where(F.col("field").isin(fields)).withColumn("pos", pos)


def delete(elements: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return elements.where(~F.col("field").isin(fields)) if fields else elements.where(F.lit(False))

"""Command batches: statuses of a pipeline, and user-defined commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyfold.model import PIPELINE

FATAL = "^(CLIENT_ERROR|SERVER_ERROR|ERROR)"
_registry: dict[str, Callable[..., DataFrame]] = {}


def responses(results: DataFrame, most: int = PIPELINE) -> DataFrame:
    """The answers of each batch (batch, seq, status) in order, up to the first fatal one or the longest batch allowed; ``noreply`` ones run but don't answer."""
    order = Window.partitionBy("batch").orderBy("seq")
    ranked = results.withColumns({"_r": F.row_number().over(order), "_bad": F.sum(F.col("status").rlike(FATAL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    return ranked.where((F.coalesce("_bad", F.lit(0)) == 0) & (F.col("_r") <= most)).drop("_r", "_bad")


def batch_end(results: DataFrame, most: int = PIPELINE) -> DataFrame:
    """batch, n, closing: END, or why the batch was cut (PIPE_ERROR bad error, PIPE_ERROR command overflow)."""
    n = results.groupBy("batch").agg(F.count(F.lit(1)).alias("sent"), F.min(F.when(F.col("status").rlike(FATAL), F.col("seq"))).alias("fatal"))
    got = responses(results, most).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    closing = F.when(F.col("n") < F.col("sent"), F.when(F.col("fatal").isNotNull() & (F.col("n") < most), "PIPE_ERROR bad error").otherwise("PIPE_ERROR command overflow")).otherwise("END")
    return n.join(got, "batch").select("batch", "n", closing.alias("closing"))


def register(name: str, run: Callable[..., DataFrame]) -> None:
    """Adds a user-defined command: a function of frames and parameters that returns a frame."""
    if name in _registry:
        raise ValueError(f"{name} is registered already")
    _registry[name] = run


def call(name: str, *args: object, **options: object) -> DataFrame:
    """Runs a registered command; unknown ones raise KeyError."""
    return _registry[name](*args, **options)

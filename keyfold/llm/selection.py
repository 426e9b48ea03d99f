"""The k-th highest of integer keys, by histograms refined over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def kth_highest(keys: DataFrame, column: str, k: int) -> int | None:
    """The exact k-th highest non-null value of an integer column (the lowest, if there are fewer; None without rows).

    Each round counts the rows of at most BINS bins of the interval that holds the value, and keeps one bin; the driver sees a bounded number of counts.
    """
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    need = min(k, n)
    while lo < hi:
        step = -(-(hi - lo + 1) // BINS)
        bins = keys.where(F.col(column).between(lo, hi)).groupBy(F.floor((F.col(column) - F.lit(lo)) / F.lit(step)).cast("int").alias("b")).count()
        for b, c in sorted(map(tuple, bins.collect()), reverse=True):
            if c >= need:
                lo, hi = lo + b * step, min(hi, lo + (b + 1) * step - 1)
                break
            need -= c
    return lo

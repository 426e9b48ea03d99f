"""Connected components of a graph given as edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.store import discard, written


def _edge(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (a, b: longs). Self-loops and repeats do no harm.

    Each round points every node's larger neighbours (then its smaller ones) to the smallest node it knows: stars
    merge until none changes. A round is two aggregates over the edges, spread by node; the minimum combines before the shuffle. Each half of a round is written and names
    its edges once for each use, since the driver holds every plan, with figures for each of its steps.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.select(F.inline(F.array(_edge("a", "b"), _edge("b", "a"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.inline(F.array(_edge("b", "m"), _edge("a", "m")))).where("a <> b").distinct()
        now, old = written(small, "edges"), now
        discard(old, large)
        state = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    top = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct().join(top.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return top.unionByName(roots)

"""Seeded random logs: closed forms and the fold against a plain sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from keyfold.operators import btree, fold


def logs(seed, n=400, keys=6, span=60):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys)}", i, r.randrange(span)) for i in range(n)]


@pytest.mark.parametrize("action", ["smallest_trim", "largest_trim", "smallest_silent_trim", "largest_silent_trim", "error"])
def test_closed_form_is_the_fold(spark, action):
    log = spark.createDataFrame(logs(action), "key string, seq long, bkey long").withColumn("value", F.col("seq").cast("string"))
    closed = btree.bounded(btree.first_writes(log), 8, action)
    commands = log.select("key", "seq", F.lit("insert").alias("op"), "bkey", "value", F.lit(None).cast("string").alias("attr"))
    folded = fold.final_state(commands, 8, action)
    assert sorted(map(tuple, closed.select("key", "bkey", "value").collect())) == sorted(map(tuple, folded.select("key", "bkey", "value").collect()))
    flags = {r.key: r.trimmed for r in btree.trimmed_flag(btree.first_writes(log), 8, action).collect()}
    assert all(flags[r.key] == r.trimmed for r in folded.select("key", "trimmed").distinct().collect())


@pytest.mark.parametrize("action", ["smallest_trim", "largest_trim"])
def test_range_bound(spark, action):
    log = spark.createDataFrame(logs(action + "r"), "key string, seq long, bkey long").withColumn("value", F.col("seq").cast("string"))
    closed = btree.bounded(btree.first_writes(log), 8, action, 20)
    commands = log.select("key", "seq", F.lit("insert").alias("op"), "bkey", "value", F.lit(None).cast("string").alias("attr"))
    folded = fold.final_state(commands, 8, action, 20)
    assert sorted(map(tuple, closed.select("key", "bkey").collect())) == sorted(map(tuple, folded.select("key", "bkey").collect()))


def test_reads_against_a_list(spark):
    r = random.Random(5)
    trees = {f"k{i}": sorted(r.sample(range(200), r.randrange(1, 40))) for i in range(8)}
    e = spark.createDataFrame([(k, b) for k, bs in trees.items() for b in bs], "key string, bkey long").cache()
    for _ in range(6):
        a, b, offset, count = r.randrange(200), r.randrange(200), r.randrange(4), r.randrange(6)
        got: dict = {}
        for x in btree.get(e, a, b, offset, count).orderBy("key", "rank").collect():
            got.setdefault(x.key, []).append(x.bkey)
        want = {}
        for k, bs in trees.items():
            m = [x for x in bs if min(a, b) <= x <= max(a, b)]
            m = (m if a <= b else m[::-1])[offset:]
            m = m[:count] if count else m
            if m:
                want[k] = m
        assert got == want
        left = btree.delete(e, a, b, None, count).groupBy("key").count().collect()
        gone = sum(map(len, trees.values())) - sum(x["count"] for x in left)
        full = [len([x for x in bs if min(a, b) <= x <= max(a, b)]) for bs in trees.values()]
        assert gone == sum(min(n, count) if count else n for n in full)

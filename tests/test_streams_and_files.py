"""Streaming store, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from keyfold.operators import fold
from keyfold.sources import commands
from keyfold.streaming import store

LOG = [("k1", 1, "insert", 10, "a", None), ("k1", 2, "insert", 20, "b", None), ("k2", 3, "insert", 5, "1", None), ("k1", 4, "insert", 10, "c", None), ("k1", 5, "insert", 30, "d", None), ("k2", 6, "incr", 5, "4", None), ("k1", 7, "insert", 1, "e", None)]


def run(spark, frame, tmp_path, name):
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_store_answers_as_the_fold(spark, tmp_path):
    log = spark.createDataFrame(LOG, fold.COMMANDS)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = run(spark, store.run_commands(stream, maxcount=2), tmp_path, "store_out")
    want = fold.statuses(log, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.seq: r.status for r in want.collect()} == {1: "STORED", 2: "STORED", 3: "STORED", 4: "ELEMENT_EXISTS", 5: "STORED", 6: "5", 7: "OUT_OF_RANGE"}


def test_counters(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,0,id * 60) AS ts, IF(id % 2 = 0, 'get', 'set') AS op FROM range(600)")
    rows.coalesce(1).write.parquet(str(tmp_path / "ts"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ts"))
    got = run(spark, store.counters(stream), tmp_path, "counters_out")
    full = rows.groupBy(F.window("ts", "1 hour").alias("w"), "op").count().select("w.start", "op", "count")
    assert got.count() > 0 and got.subtract(full).isEmpty()


def test_parse(spark):
    lines = ["set k1 0 0 5 noreply", "bop insert t:1 10 0x01 5 create", "get a b c", "nonsense", "incr n 5", "bop smget 11 2 0..100 10 unique"]
    got = commands.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.op for r in got] == ["set", "bop insert", "get", None, "incr", "bop smget"]
    assert got[0].noreply and got[0].arguments == ["0", "0", "5"] and got[1].key == "t:1" and got[3].error == "CLIENT_ERROR"
    assert commands.key_list("a,b c") == ["a", "b", "c"]


def test_snapshot_and_recovery(spark, tmp_path):
    items = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, seq long, value string")
    elements = spark.createDataFrame([("t", 2), ("t", 1)], "key string, bkey long")
    commands.write_snapshot(items, elements, str(tmp_path / "snap"))
    i, e = commands.read_snapshot(spark, str(tmp_path / "snap"))
    assert i.count() == 2 and e.count() == 2
    log = spark.createDataFrame([("a", 3, None, "delete"), ("c", 4, "z", "set"), ("b", 1, "old", "set")], "key string, seq long, value string, op string")
    assert sorted((r.key, r.value) for r in commands.recover(i, log, 2).collect()) == [("b", "y"), ("c", "z")]
    live = spark.createDataFrame([("p:a", "kv", 0), ("q", "list", 150), ("gone", "kv", 50)], "key string, type string, exptime long")
    commands.write_dump(live, str(tmp_path / "dump"), 100)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "dump")).collect()) == ["K p:a 0", "L q 50"]
    commands.write_log(spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, '1.2.3.4' AS client, 'get a' AS command"), str(tmp_path / "log"))
    assert commands.read_commands(spark, str(tmp_path / "log")).first().error == "CLIENT_ERROR"


def test_range_reads_reach_the_scan(spark, tmp_path):
    from keyfold.operators import btree

    elements = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 10).alias("key"), F.col("id").alias("bkey"), F.lit("v").alias("value"))
    elements.write.parquet(str(tmp_path / "e"))
    got = btree.count(elements.select("key").distinct(), spark.read.parquet(str(tmp_path / "e")), 10, 20)
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(bkey,10)" in plan and "LessThanOrEqual(bkey,20)" in plan
    assert "ReadSchema: struct<key:string,bkey:bigint>" in plan
    top = btree.get(spark.read.parquet(str(tmp_path / "e")), 10, 500, 0, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in top


@pytest.mark.parametrize("gone", ["llm"])
def test_works_without_the_other_subpackage(tmp_path, gone):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "keyfold", tmp_path / "keyfold", ignore=shutil.ignore_patterns(gone, "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})

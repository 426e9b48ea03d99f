"""Golden cases: small fixtures with the exact answers, order included."""


import pytest
from pyspark.sql import functions as F

from keyfold.functions import bytes as fb
from keyfold.functions import keys as fk
from keyfold.functions import ring
from keyfold.operators import attributes, btree, fold, kv, lists, maps, pipeline, retention, scan, sets, smget, stats
from keyfold.sources import commands


@pytest.fixture(scope="module")
def two_trees(spark):
    rows = [("bkey1", b, f"datum{b // 10}") for b in (10, 30, 40, 50, 60, 70, 90)] + [("bkey2", b, f"datum{b // 10}") for b in (20, 40, 50, 60, 70, 80, 100)]
    e = spark.createDataFrame(rows, "key string, bkey long, value string").cache()
    items = spark.createDataFrame([(k, "btree", True, "smallest_trim", False) for k in ("bkey1", "bkey2")], "key string, type string, readable boolean, ovflaction string, trimmed boolean")
    return items, e


def keys_of(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "pos int, key string")


def pairs(rows):
    return [f"{r.key[-1]}:{r.bkey}" for r in rows.orderBy("rank").collect()]


@pytest.mark.parametrize(
    "a, b, offset, count, unique, want, closing",
    [
        (0, 100, 0, 10, False, "1:10 2:20 1:30 1:40 2:40 1:50 2:50 1:60 2:60 1:70", "DUPLICATED"),
        (0, 100, 0, 10, True, "1:10 2:20 1:30 1:40 1:50 1:60 1:70 2:80 1:90 2:100", "END"),
        (100, 0, 0, 10, False, "2:100 1:90 2:80 2:70 1:70 2:60 1:60 2:50 1:50 2:40", "DUPLICATED"),
        (100, 0, 0, 10, True, "2:100 1:90 2:80 2:70 2:60 2:50 2:40 1:30 2:20 1:10", "END"),
        (0, 100, 2, 6, True, "1:30 1:40 1:50 1:60 1:70 2:80", "END"),
        (90, 30, 3, 9, False, "1:70 2:60 1:60 2:50 1:50 2:40 1:40 1:30", "DUPLICATED"),
    ],
)
def test_smget(spark, two_trees, a, b, offset, count, unique, want, closing):
    found = smget.smget(*two_trees, keys_of(spark, "bkey1", "bkey2"), a, b, offset, count, unique)
    assert pairs(found.rows) == want.split()
    assert found.status() == closing
    assert found.missed.isEmpty() and found.trimmed.isEmpty()


def test_smget_missed_in_list_order(spark, two_trees):
    found = smget.smget(*two_trees, keys_of(spark, "bkey2", "bkey3", "bkey1", "bkey4", "bkey3"), 40, 100, 0, 6)
    assert pairs(found.rows) == "1:40 2:40 1:50 2:50 1:60 2:60".split()
    assert [(r.key, r.cause) for r in found.missed.orderBy("pos").collect()] == [("bkey3", "NOT_FOUND"), ("bkey4", "NOT_FOUND"), ("bkey3", "NOT_FOUND")]
    assert smget.old_smget(found)[1] is False


@pytest.fixture(scope="module")
def trimmed_trees(spark):
    log = [("bkey1", i, b) for i, b in enumerate((10, 20, 30, 40, 50, 70, 90))] + [("bkey2", i, b) for i, b in enumerate((20, 40, 60, 80, 100))]
    writes = btree.first_writes(spark.createDataFrame(log, "key string, seq long, bkey long").withColumn("value", F.col("bkey").cast("string")))
    e = btree.bounded(writes, 5, "smallest_trim").cache()
    flags = btree.trimmed_flag(writes, 5, "smallest_trim")
    items = flags.select("key", F.lit("btree").alias("type"), F.lit(True).alias("readable"), F.lit("smallest_trim").alias("ovflaction"), "trimmed").cache()
    return items, e


def test_trimmed_state(trimmed_trees):
    items, e = trimmed_trees
    assert {r.key: r.trimmed for r in items.collect()} == {"bkey1": True, "bkey2": False}
    assert sorted(r.bkey for r in e.where("key = 'bkey1'").collect()) == [30, 40, 50, 70, 90]


@pytest.mark.parametrize("a, b, status", [(0, 100, "TRIMMED"), (100, 0, "TRIMMED"), (30, 100, "END"), (100, 30, "END"), (0, 20, "OUT_OF_RANGE"), (91, 99, "NOT_FOUND_ELEMENT")])
def test_trim_status(spark, trimmed_trees, a, b, status):
    req = spark.createDataFrame([(1, "bkey1", a, b, 0, 0)], "req int, key string, a long, b long, offset long, count long")
    assert btree.read_status(req, *trimmed_trees).first().status == status


@pytest.mark.parametrize("a, b, n, status", [(12, 10, 1, "TRIMMED"), (13, 10, 2, "END")])
def test_first_element_is_not_compared_with_the_end(spark, a, b, n, status):
    e = spark.createDataFrame([("k", x) for x in (10, 13, 14)], "key string, bkey long")
    items = spark.createDataFrame([("k", "btree", True, "smallest_trim", True)], "key string, type string, readable boolean, ovflaction string, trimmed boolean")
    req = spark.createDataFrame([(1, "k", a, b, 0, 0)], "req int, key string, a long, b long, offset long, count long")
    r = btree.read_status(req, items, e).first()
    assert (r.n, r.status) == (n, status)


def test_smget_over_trimmed(spark, trimmed_trees):
    keys = keys_of(spark, "bkey1", "bkey2")
    up = smget.smget(*trimmed_trees, keys, 0, 100, 0, 5)
    assert pairs(up.rows) == "2:20 2:40 2:60 2:80 2:100".split()
    assert [(r.key, r.cause) for r in up.missed.collect()] == [("bkey1", "OUT_OF_RANGE")]
    down = smget.smget(*trimmed_trees, keys, 100, 0, 0, 10)
    assert pairs(down.rows) == "2:100 1:90 2:80 1:70 2:60 1:50 2:40 1:40 1:30 2:20".split()
    assert [(r.key, r.bkey) for r in down.trimmed.collect()] == [("bkey1", 30)]


def test_overflow_sequence():
    t = fold.Tree(maxcount=5)
    assert [t.run("insert", b, "x") for b in (10, 30, 50, 70, 90, 80, 10, 60)] == ["STORED"] * 6 + ["OUT_OF_RANGE", "STORED"]
    assert (t.keys, t.trimmed) == ([50, 60, 70, 80, 90], True)
    assert t.run("setattr", None, None, "overflowaction=largest_trim") == "OK" and not t.trimmed
    assert [t.run("insert", b, "x") for b in (30, 40, 90)] == ["STORED", "STORED", "OUT_OF_RANGE"]
    assert (t.keys, t.trimmed) == ([30, 40, 50, 60, 70], True)
    t.run("setattr", None, None, "overflowaction=error")
    assert [t.run("insert", b, "x") for b in (20, 80)] == ["OVERFLOWED"] * 2


def test_counters_of_a_tree():
    t = fold.Tree()
    assert t.run("incr", 1, "5") == "NOT_FOUND_ELEMENT"
    assert [t.run("incr", 1, "5", "7"), t.run("incr", 1, "5"), t.run("decr", 1, "20")] == ["7", "12", "0"]
    t.run("upsert", 2, "18446744073709551615")
    assert t.run("incr", 2, "2") == "1"
    assert t.run("upsert", 2, "word") == "REPLACED" and t.run("decr", 2, "1").startswith("CLIENT_ERROR")
    assert [t.run("update", 9, "x"), t.run("delete", 9, None), t.run("delete", 2, None), t.run("what", 1, "")] == ["NOT_FOUND_ELEMENT", "NOT_FOUND_ELEMENT", "DELETED", "CLIENT_ERROR"]


def test_binary_keys(spark):
    names = "00 0000 000000 01 0001 000001 02 0002 000002 0101".split()
    e = spark.createDataFrame([("k", "0x" + n) for n in names], "key string, hex string").select("key", fb.from_hex(F.col("hex")).alias("bkey"))
    h = bytes.fromhex

    def n(a, b):
        lo, hi = min(h(a), h(b)), max(h(a), h(b))
        return e.where(F.col("bkey").between(F.lit(bytearray(lo)), F.lit(bytearray(hi)))).count()

    assert [n("01", "02"), n("0001", "0002"), n("00", "0002"), n("02", "0000")] == [3, 2, 7, 9]
    assert e.select(fb.to_hex(F.max("bkey"))).first()[0] == "0x02"
    assert spark.range(1).select(fb.from_hex(F.lit("0x123")), fb.from_hex(F.lit("12"))).first() == (None, None)


def test_flag_filters(spark):
    e = spark.createDataFrame([(i, bytearray(bytes.fromhex(f"{i:062d}"))) for i in range(100)], "bkey long, eflag binary")
    values = [bytes.fromhex(f"{i:062d}") for i in range(1, 101)]
    full = b"\xff" * 31
    assert e.where(fb.eflag_filter(F.col("eflag"), "EQ", values, 0, "AND", full)).count() == 99
    assert e.where(fb.eflag_filter(F.col("eflag"), "NE", values, 0, "AND", full)).count() == 1
    short = spark.createDataFrame([(1, None), (2, bytearray(b"\x0f"))], "bkey long, eflag binary")
    assert [r.bkey for r in short.where(fb.eflag_filter(F.col("eflag"), "NE", [b"\x00\x01"])).orderBy("bkey").collect()] == [1, 2]
    assert short.where(fb.eflag_filter(F.col("eflag"), "EQ", [b"\x00\x01"])).isEmpty()
    new = short.select(fb.eflag_update(F.col("eflag"), b"\xf1", "OR").alias("x")).collect()
    assert [r.x and bytes(r.x) for r in new] == [None, b"\xff"]
    with pytest.raises(ValueError):
        fb.eflag_filter(F.col("eflag"), "LT", [b"\x01", b"\x02"])


def test_range_bound_on_binary_keys(spark):
    order = "11 2222222222 333333333333333333 444444 55555555555555 6622 6666 7777 777777777777 88888888 9999999999999999".split()
    limit = bytes.fromhex("5555555555")
    high = bytes.fromhex(order[-1])
    kept = [x for x in order if fb.padded_difference(high, bytes.fromhex(x), 5) <= int.from_bytes(limit, "big")]
    assert kept == order[4:]
    e = spark.createDataFrame([(bytearray(high), bytearray(bytes.fromhex(x))) for x in order], "h binary, l binary")
    assert e.where(fb.within_range(limit)("h", "l")).count() == len(kept)


@pytest.mark.parametrize("i, j, want", [(0, -1, "01234"), (2, 8, "234"), (-1, -2, "43"), (-3, 3, "23"), (0, -2, "0123"), (6, -3, "432"), (6, 8, ""), (-10, -8, "")])
def test_list_ranges(spark, i, j, want):
    e = spark.createDataFrame([("lkey", n, f"datum{n}") for n in range(5)], "key string, seq long, value string")
    got = lists.get(e, i, j).orderBy("rank").collect()
    assert "".join(r.value[-1] for r in got) == want
    assert lists.delete(e, i, j).count() == 5 - len(want)


def test_list_bounds(spark):
    p = spark.createDataFrame([("k", n, n) for n in range(6)], "key string, seq long, value long")
    assert sorted(r.value for r in lists.bounded(p, 3).collect()) == [3, 4, 5]
    assert [r.value for r in lists.bounded(p, 3, at_head=True).orderBy("seq").collect()] == [5, 4, 3]
    at = spark.createDataFrame([(3, 5)], "n int, m int")
    status = [at.select(lists.insert_status(i, F.col("n"), F.col("m"))).first()[0] for i in (0, 3, 4, -1, -4, -5)]
    assert status == ["STORED", "STORED", "OUT_OF_RANGE", "STORED", "STORED", "OUT_OF_RANGE"]


def test_map_order(spark):
    e = spark.createDataFrame([("mkey", f"f{n}", f"datum{n}") for n in range(7, 0, -1)], "key string, field string, value string")
    got = maps.get(e, [f"f{n}" for n in range(1, 8)]).orderBy("pos").collect()
    assert [r.value for r in got] == [f"datum{n}" for n in range(1, 8)]
    assert maps.get(e, ["no"]).isEmpty() and maps.get(e).count() == 7 and maps.delete(e).isEmpty()


def test_full_set_overflows_even_for_its_members(spark):
    log = spark.createDataFrame([("s", i, v) for i, v in enumerate("abacbca")], "key string, seq long, value string")
    got = [r.status for r in sets.insert_fold(log, 2).orderBy("seq").collect()]
    assert got == ["STORED", "STORED"] + ["OVERFLOWED"] * 5
    assert [r.status for r in sets.insert_fold(log, 9).orderBy("seq").collect()] == ["STORED", "STORED", "EXISTS", "STORED", "EXISTS", "EXISTS", "EXISTS"]


def test_scan(spark):
    rows = [(r"aa\*aaa", "kv"), (r"bb\*aab", "kv"), (r"c?\*aaba", "kv"), (r"d?\*abba", "kv"), (r"a?\*aaaaa", "btree"), (r"a?\*aaaa", "set")]
    items = spark.createDataFrame([(k, t, 0) for k, t in rows], "key string, type string, exptime long")
    assert scan.scan_keys(items, 1).count() == 6
    assert sorted(r.key for r in scan.scan_keys(items, 1, r"?\?\\\**a", "K").collect()) == [r"c?\*aaba", r"d?\*abba"]
    seen, cursor = [], None
    while True:
        page, cursor = scan.scan_page(items, 1, cursor, 2)
        seen += [r.key for r in page.collect()]
        if cursor is None:
            break
    assert sorted(seen) == sorted(k for k, _ in rows)
    for bad in ("a" * 65, "*****", "a\\"):
        with pytest.raises(ValueError):
            fk.glob_pattern(bad)


def test_prefix_scan(spark):
    names = ["aaaaaab", "bbbaaab", "cccaabba", "ddddabba", "aaaaaaaab", "aaaaaaab"]
    items = spark.createDataFrame([(f"{p}:k", "kv", 0, 10) for p in names] + [("bare", "kv", 0, 10), (":lead", "kv", 0, 10)], "key string, type string, exptime long, nbytes long")
    assert sorted(r.prefix for r in scan.scan_prefixes(items, 1, "*a").collect()) == ["cccaabba", "ddddabba"]
    assert scan.scan_prefixes(items, 1).where("prefix = '<null>'").first()["items"] == 2
    assert spark.range(1).select(fk.valid_prefix(F.lit("a-b")), fk.valid_prefix(F.lit("-a")), fk.valid_prefix(F.lit("a b"))).first() == (True, False, False)


def test_numbers(spark):
    big = 9223372036854775807
    start = spark.createDataFrame([("n", str(big))], "key string, value string")
    log = lambda *d: spark.createDataFrame([("n", x) for x in d], "key string, delta long")
    assert int(kv.incr_fold(start, log(1, 1)).first().value) == big + 2
    assert int(kv.decr_fold(start, log(5)).first().value) == big - 5
    one = spark.createDataFrame([("n", i, op, d) for i, (op, d) in enumerate([("incr", 1), ("incr", 1), ("incr", 8), ("decr", 1), ("decr", 9), ("decr", 5), ("incr", 3)])], "key string, seq long, op string, delta long")
    assert kv.count_fold(one).first().value == 3
    got = spark.createDataFrame([("12",), (" +7 x",), ("a1",), ("18446744073709551616",), ("",)], "t string").select(fk.unsigned(F.col("t")).cast("string").alias("v")).collect()
    assert [r.v for r in got] == ["12", "7", None, None, None]
    top = F.lit("18446744073709551615").cast("decimal(38,0)")
    assert spark.range(1).select(fk.incremented(top, F.lit(2)).cast("long"), fk.decremented(F.lit(3).cast("decimal(38,0)"), F.lit(5)).cast("long")).first() == (1, 0)


def test_times(spark):
    e = spark.createDataFrame([(x,) for x in (-1, 0, 10, 2592000, 2592001, 1_800_000_000, -5)], "e long")
    now = F.lit(1_700_000_000).cast("long")
    got = [r[0] for r in e.select(fk.absolute_expiry(F.col("e"), now)).collect()]
    assert got == [-1, 0, 1_700_000_010, 1_702_592_000, 1_700_000_000, 1_800_000_000, 1_700_000_000]
    items = spark.createDataFrame([("a", 100), ("b", 100)], "key string, atime long")
    reads = spark.createDataFrame([("a", 130), ("a", 160), ("a", 200), ("b", 159)], "key string, ts long")
    assert {r.key: r.atime for r in retention.accessed(items, reads).collect()} == {"a": 160, "b": 100}


def test_prefix_statistics(spark):
    rows = [("a", "kv"), ("b", "kv"), ("c", "btree"), ("d", "map")]
    items = spark.createDataFrame([(k, t, 8) for k, t in rows], "key string, type string, nbytes long")
    r = stats.by_prefix(items).first()
    assert (r.prefix, r.itm, r.kitm, r.litm, r.sitm, r.mitm, r.bitm) == ("<null>", 4, 2, 0, 0, 1, 1)
    with pytest.raises(ValueError):
        stats.prefix_limit(stats.by_prefix(items), 0)


def test_query_costs(spark):
    rows = [("lop_insert", 3, 0), ("lop_insert", -2, 0), ("lop_get", 4, 10), ("lop_get", -4, 10), ("bop_get", 0, 7)]
    got = spark.createDataFrame(rows, "op string, f long, n long").select(stats.query_cost(F.col("op"), F.col("f"), F.col("n"))).collect()
    assert [r[0] for r in got] == [4, 2, 15, 14, 7]


def test_sticky_and_scrub(spark):
    items = spark.createDataFrame([("a", 1, -1, 50, 5), ("b", 2, -1, 50, 5), ("c", 3, -1, 50, 5), ("d", 4, 7, 50, 5)], "key string, seq long, exptime long, nbytes long, atime long")
    assert [r.key for r in retention.sticky_within(items, 100).orderBy("seq").collect()] == ["a", "b"]
    kept, report = retention.scrub(items, 10, mine=F.col("key") != "a")
    assert sorted(r.key for r in kept.collect()) == ["b", "c"] and tuple(report.first()) == (4, 2)


def test_attributes(spark):
    items = spark.createDataFrame([("k", "kv", 0), ("t", "btree", 0), ("s", "set", -1)], "key string, type string, exptime long").withColumn("trimmed", F.lit(True)).withColumn("ovflaction", F.lit("smallest_trim"))
    sizes = spark.createDataFrame([("t", 5, 10, 90)], "key string, count long, minbkey long, maxbkey long")
    rows = [("k", 5, None, None), ("t", 4, None, None), ("t", None, "largest_trim", None), ("t", None, None, 79), ("t", None, None, 80), ("s", None, None, 1), ("x", None, None, None), ("s", None, "head_trim", None)]
    changes = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, maxcount long, ovflaction string, maxbkeyrange long, n int")
    got = [r.status for r in attributes.setattr_status(changes, items, sizes).orderBy("n").collect()]
    assert got == ["ATTR_ERROR not found", "ATTR_ERROR bad value", "OK", "ATTR_ERROR bad value", "OK", "ATTR_ERROR not found", "NOT_FOUND", "ATTR_ERROR bad value"]
    one = attributes.setattr_status(changes.where("n = 2").select("key", "ovflaction"), items, sizes)
    after = {r.key: (r.ovflaction, r.trimmed) for r in attributes.setattr_apply(items, one).collect()}
    assert after["t"] == ("largest_trim", False) and after["k"] == ("smallest_trim", True)


def test_ring(spark):
    nodes = spark.createDataFrame([("a:1",), ("b:2",), ("c:3",)], "node string")
    points = ring.build(nodes)
    assert points.count() == 480
    import hashlib

    keys = [f"key{i}" for i in range(50)]
    table = sorted({r.hpoint: r.node for r in sorted(points.collect(), key=lambda r: r.node, reverse=True)}.items())
    want = {}
    for k in keys:
        h = int.from_bytes(hashlib.md5(k.encode()).digest()[:4], "little")
        want[k] = next((n for p, n in table if p >= h), table[0][1])
    got = ring.lookup(spark.createDataFrame([(k,) for k in keys], "key string"), points)
    assert {r.key: r.node for r in got.collect()} == want


def test_batches(spark):
    r = spark.createDataFrame([(1, 1, "STORED"), (1, 2, "CLIENT_ERROR x"), (1, 3, "STORED"), (2, 1, "STORED"), (2, 2, "STORED"), (2, 3, "STORED"), (3, 1, "STORED")], "batch int, seq int, status string")
    assert {x.batch: (x.n, x.closing) for x in pipeline.batch_end(r, 2).collect()} == {1: (2, "PIPE_ERROR command overflow"), 2: (2, "PIPE_ERROR command overflow"), 3: (1, "END")}
    assert {x.batch: x.closing for x in pipeline.batch_end(r, 9).collect()} == {1: "PIPE_ERROR bad error", 2: "END", 3: "END"}
    pipeline.register("echo", lambda df: df)
    assert pipeline.call("echo", r) is r
    with pytest.raises(KeyError):
        pipeline.call("unknown")
    with pytest.raises(ValueError):
        pipeline.register("echo", lambda df: df)


def test_flush_marks():
    assert retention.flush_mark(100) == 99 and retention.flush_mark(100, 10) == 109


# ---- repeats, statuses, plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_position_of_repeated_requests(spark):
    e = spark.createDataFrame([("k", x) for x in (1, 2, 3, 4)], "key string, bkey long")
    asked = spark.createDataFrame([("k", 3), ("k", 3), ("k", 9), ("absent", 1)], "key string, bkey long")
    assert [(r.key, r.bkey, r.position) for r in btree.position(e, asked).collect()] == [("k", 3, 2)]
    near = btree.position_with_get(e, asked, 1).orderBy("position").collect()
    assert [(r.asked, r.bkey, r.position, r["index"]) for r in near] == [(3, 2, 1, 1), (3, 3, 2, 1), (3, 4, 3, 1)]


def test_repeated_updates_leave_one_row(spark):
    e = spark.createDataFrame([("k", x, "old") for x in (1, 2, 3, 4)], "key string, bkey long, value string")
    u = spark.createDataFrame([("k", 2, "a", 1), ("k", 2, "b", 2), ("k", 9, "c", 3)], "key string, bkey long, value string, seq long")
    assert {(r.bkey, r.value) for r in btree.bulk_update(e, u).collect()} == {(1, "old"), (2, "b"), (3, "old"), (4, "old")}
    assert btree.bulk_update(e, u).count() == 4
    m, mu = e.withColumn("field", F.col("bkey").cast("string")).drop("bkey"), u.withColumn("field", F.col("bkey").cast("string")).drop("bkey")
    assert sorted((r.field, r.value) for r in maps.update(m, mu).collect()) == [("1", "old"), ("2", "b"), ("3", "old"), ("4", "old")]


def test_increments_of_words_and_absent_keys(spark):
    items = spark.createDataFrame([("n", "10"), ("w", "ten"), ("big", "18446744073709551615")], "key string, value string")
    log = spark.createDataFrame([("n", 1, "8", None), ("w", 2, "1", None), ("big", 3, "1", None), ("bogus", 4, "5", None), ("new", 5, "5", None), ("new", 6, "5", "7"), ("new", 7, "2", "9"), ("n", 8, "1", "99")], "key string, seq long, delta string, initial string")
    got = {r.key: (None if r.value is None else int(r.value), r.status) for r in kv.incr_fold(items, log).collect()}
    assert got == {"n": (19, "OK"), "w": (None, "EINVAL"), "big": (0, "OK"), "bogus": (None, "NOT_FOUND"), "new": (9, "OK")}
    down = {r.key: (None if r.value is None else int(r.value), r.status) for r in kv.decr_fold(items, log.drop("initial")).collect()}
    assert down["n"] == (1, "OK") and down["bogus"] == (None, "NOT_FOUND") and down["w"] == (None, "EINVAL")


def test_getrim(spark):
    tree = spark.createDataFrame([("k", x, f"k-data-{x}") for x in range(1, 11)], "key string, bkey long, value string")

    def one(bkey, action="smallest_trim", n=10):
        return tuple(btree.insert_each(tree, spark.createDataFrame([("k", bkey)], "key string, bkey long"), n, action).first())[2:]

    assert one(11) == ("STORED", 1, "k-data-1") and one(0, "largest_trim") == ("STORED", 10, "k-data-10")
    assert one(0) == ("OUT_OF_RANGE", None, None) and one(5) == ("ELEMENT_EXISTS", None, None)
    assert one(11, "error") == ("OVERFLOWED", None, None) and one(11, n=11) == ("STORED", None, None) and one(11, "smallest_silent_trim") == ("STORED", None, None)


@pytest.mark.parametrize("idx, action, want", [(0, "tail_trim", "xabc"), (-1, "tail_trim", "bcdx"), (2, "tail_trim", "abxc"), (2, "head_trim", "bxcd"), (-2, "head_trim", "bcxd"), (-2, "tail_trim", "abcx"), (5, "tail_trim", "OUT_OF_RANGE"), (1, "error", "OVERFLOWED")])
def test_list_insert(spark, idx, action, want):
    e = spark.createDataFrame([("k", i, v) for i, v in enumerate("abcd")] + [("other", 0, "o")], "key string, seq long, value string")
    rows, status = lists.insert(e, spark.createDataFrame([("k", idx, "x")], "key string, idx long, value string"), 4, action)
    got = "".join(r.value for r in rows.where("key = 'k'").orderBy("idx").collect())
    assert (got, status.first().status) == ((want, "STORED") if len(want) == 4 else ("abcd", want))
    assert [r.value for r in rows.where("key = 'other'").collect()] == ["o"]


def test_key_lists_are_no_keys(spark):
    lines = spark.createDataFrame([("mget 11 2",), ("bop smget 11 2 0..100 10",), ("bop get k 0..9",), ("mgets 3 1 noreply",)], "value string")
    got = [(r.op, r.key, r.arguments, r.noreply) for r in commands.parse(lines).collect()]
    assert got == [("mget", None, ["11", "2"], False), ("bop smget", None, ["11", "2", "0..100", "10"], False), ("bop get", "k", ["0..9"], False), ("mgets", None, ["3", "1"], True)]


def test_statuses_of_key_lists(spark):
    items = spark.createDataFrame([("t", "btree", True, "smallest_trim", True, "number"), ("l", "list", True, "tail_trim", False, None), ("u", "btree", False, "smallest_trim", False, "number"), ("e", "btree", True, "smallest_trim", False, None), ("h", "btree", True, "smallest_trim", False, "binary")], "key string, type string, readable boolean, ovflaction string, trimmed boolean, bkeytype string")
    e = spark.createDataFrame([("t", x, "v") for x in (30, 40, 50)] + [("h", 1, "v")], "key string, bkey long, value string")
    keys = spark.createDataFrame([(i, k) for i, k in enumerate(["t", "l", "u", "e", "none", "t"])], "pos long, key string")
    got = sorted((r.pos, r.status, r.bkey) for r in btree.mget(items, e, keys, 10, 40, 0, 5).collect())
    assert got == [(0, "TRIMMED", 30), (0, "TRIMMED", 40), (1, "TYPE_MISMATCH", None), (2, "UNREADABLE", None), (3, "NOT_FOUND_ELEMENT", None), (4, "NOT_FOUND", None), (5, "TRIMMED", 30), (5, "TRIMMED", 40)]
    assert [r.status for r in btree.mget(items, e, keys.where("pos = 0"), 10, 20, 0, 5).collect()] == ["OUT_OF_RANGE"]
    asked = spark.createDataFrame([(1, "h", 0, 9, 0, 0), (2, "t", 30, 99, 0, 0)], "req long, key string, a long, b long, offset long, count long")
    assert {r.req: r.status for r in btree.read_status(asked, items, e, kind="number").collect()} == {1: "BKEY_MISMATCH", 2: "END"}
    with pytest.raises(ValueError, match="BKEY_MISMATCH"):
        smget.check(items.where("type = 'btree'"), spark.createDataFrame([("h",)], "key string"), "number")


def test_attributes_of_single_values_and_creation(spark):
    items = spark.createDataFrame([("v", "kv"), ("b", "btree")], "key string, type string")
    asked = spark.createDataFrame([("v",), ("b",), ("x",)], "key string")
    assert {r.key: r.status for r in attributes.getattr_status(items, asked, ["type", "maxcount"]).collect()} == {"v": "EBADATTR", "b": "OK", "x": "NOT_FOUND"}
    assert {r.key: r.status for r in attributes.getattr_status(items, asked, ["type"]).collect()} == {"v": "OK", "b": "OK", "x": "NOT_FOUND"}
    after, statuses = attributes.create(items, spark.createDataFrame([("v", "set", 1), ("n", "set", 3), ("n", "list", 2)], "key string, type string, seq long"))
    assert {(r.key, r.seq, r.status) for r in statuses.collect()} == {("v", 1, "EXISTS"), ("n", 2, "CREATED"), ("n", 3, "EXISTS")}
    assert {(r.key, r.type) for r in after.collect()} == {("v", "kv"), ("b", "btree"), ("n", "list")}


def test_range_bounds_of_long_binary_keys(spark):
    import random

    r = random.Random(3)
    for size in (1, 6, 7, 8, 15, 31):
        pairs = [(bytes(r.randrange(256) for _ in range(r.randrange(1, 32))), bytes(r.randrange(256) for _ in range(r.randrange(1, 32)))) for _ in range(60)]
        pairs += [(a, a[: r.randrange(1, len(a) + 1)]) for a, _ in pairs[:20]]
        limit = bytes(r.randrange(256) for _ in range(size))
        df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "h binary, l binary")
        got = [x[0] for x in df.select(fb.within_range(limit)("h", "l")).collect()]
        assert got == [fb.padded_difference(a, b, size) <= int.from_bytes(limit, "big") for a, b in pairs]


def test_plans(spark):
    e = spark.range(100).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.col("id").alias("seq"), F.col("id").alias("bkey"), F.lit("v").alias("value"))
    assert "WindowGroupLimit" in plan_of(lists.get(e, 1, 3))
    nodes = spark.createDataFrame([("a:1",), ("b:1",)], "node string")
    assert "hashpartitioning(hash" not in plan_of(ring.lookup(e.select("key"), ring.build(nodes))) and "BroadcastHashJoin" in plan_of(ring.lookup(e.select("key"), ring.build(nodes)))
    far, near = ring._lookup_by_ranges(e.select("key").distinct(), ring.build(nodes)), ring.lookup(e.select("key").distinct(), ring.build(nodes))
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, near.select(far.columns).collect()))
    asked = e.select("key", F.col("bkey"))
    assert "CartesianProduct" not in plan_of(btree.position(e, asked)) and "NestedLoop" not in plan_of(btree.position_with_get(e, asked, 2))


def test_mget_sorts_no_tree_for_its_statuses(spark):
    """One range for all keys: counts combine, only the rows themselves are ranked."""
    items = spark.createDataFrame([("a", "btree", True, "smallest_trim", True)], "key string, type string, readable boolean, ovflaction string, trimmed boolean")
    e = spark.createDataFrame([("a", i, i * 2) for i in range(10, 20)], "key string, bkey long, value long")
    keys = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos long, key string")
    out = btree.mget(items, e, keys, 12, 5, 0, 0)
    assert sorted((r.pos, r.status, r.bkey) for r in out.collect() if r.bkey) == [(p, "TRIMMED", b) for p in (0, 2) for b in (10, 11, 12)]
    assert [r.status for r in out.where("pos = 1").collect()] == ["NOT_FOUND"]
    assert btree.mget(items, e, keys, 12, 10, 0, 0).where("pos = 0").first().status == "OK" and btree.mget(items, e, keys, 10, 15, 0, 2).where("pos = 0").first().status == "OK"
    assert btree.mget(items, e, keys, 3, 5, 0, 0).where("pos = 0").first().status == "OUT_OF_RANGE" and btree.mget(items, e, keys, 15, 10, 0, 0, F.col("value") > 24).where("pos = 0").first().status == "OK"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "sum(" not in plan

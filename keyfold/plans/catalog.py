"""Registered queries over the driver's tables, and the same in SQL.

Trees are customers' orders (keys ``cust:N``, bkey the order number) and users' events, lists are orders' lines, sets are segments' nations, maps are regions' nations,
single values are parts, and events make up command logs. Results have whole numbers, doubles as read, and text.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold import model
from keyfold.functions import bytes as fb
from keyfold.functions import keys as fk
from keyfold.functions import ring
from keyfold.operators import attributes, btree, kv, lists, maps, pipeline, retention, scan, sets, smget, stats
from keyfold.sources import commands

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_700_000_000
T, C = model.table, F.col


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- frames and their SQL

_BT = "bt AS (SELECT 'cust:' || o_custkey AS key, o_orderkey AS bkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS eflag, o_totalprice AS value, o_custkey FROM orders)"
_EV = "ev AS (SELECT 'user:' || user_id AS key, event_id AS bkey, event_type, value FROM events)"


def _trees(s: SparkSession, d: str) -> DataFrame:
    return model.order_elements(s, d)


def _tree_items(s: SparkSession, d: str) -> DataFrame:
    """Customers as tree items: every 17th unreadable, every 3rd trimmed, by turns at the low and the high edge."""
    c = T(s, d, "customer")
    k = C("c_custkey")
    return c.select(
        F.concat(F.lit("cust:"), k).alias("key"), F.lit("btree").alias("type"), (k % 17 != 0).alias("readable"), (k % 3 == 0).alias("trimmed"),
        F.when(k % 2 == 0, "smallest_trim").otherwise("largest_trim").alias("ovflaction"),
    )


_IT = "it AS (SELECT 'cust:' || c_custkey AS key, c_custkey % 17 <> 0 AS readable, c_custkey % 3 = 0 AS trimmed, CASE WHEN c_custkey % 2 = 0 THEN 'smallest_trim' ELSE 'largest_trim' END AS ovflaction FROM customer)"


def _part_items(s: SparkSession, d: str) -> DataFrame:
    """Parts as items of all types, with expiry and access times."""
    p = T(s, d, "part")
    k = C("p_partkey")
    kind = F.element_at(F.array(*(F.lit(t) for t in model.TYPES)), (k % 5 + 1).cast("int"))
    return p.select(
        F.when(k % 7 == 0, F.concat(F.lit("loose"), k)).otherwise(F.concat("p_brand", F.lit(":part"), k)).alias("key"), kind.alias("type"),
        F.when(k % 4 == 0, F.lit(0)).when(k % 4 == 1, F.lit(-1)).otherwise(F.lit(NOW - 500) + k).cast("long").alias("exptime"),
        (F.lit(NOW) - k * 3).cast("long").alias("atime"), (F.length("p_name") + 40).cast("long").alias("nbytes"),
    )


_PI = f"""pi AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'loose' || p_partkey ELSE p_brand || ':part' || p_partkey END AS key,
  ['kv', 'list', 'set', 'map', 'btree'][p_partkey % 5 + 1] AS type,
  CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE {NOW - 500} + p_partkey END AS exptime, {NOW} - p_partkey * 3 AS atime, length(p_name) + 40 AS nbytes,
  CASE WHEN p_partkey % 7 = 0 THEN '<null>' ELSE p_brand END AS prefix FROM part)"""
_LIVE = f"(exptime <= 0 OR exptime > {NOW})"


def _half(column: str):
    """Each whole number twice."""
    return F.floor(C(column) / 2)


def _asked(s: SparkSession, d: str) -> DataFrame:
    """A list of keys as long as the table of customers: each twice, a third of them unknown."""
    return T(s, d, "customer").select(C("c_custkey").alias("pos"), F.concat(F.lit("cust:"), _half("c_custkey") * 3).alias("key"))


_AS = "asked AS (SELECT c_custkey AS pos, 'cust:' || ((c_custkey // 2) * 3) AS key FROM customer)"

# ---- single values


@query(f"""WITH {_PI}, asked AS (SELECT key FROM pi UNION SELECT 'absent' || p_partkey FROM part)
  SELECT asked.key, CASE WHEN pi.key IS NULL THEN 'NOT_FOUND' WHEN type = 'kv' THEN 'OK' ELSE 'BADTYPE' END AS status FROM asked LEFT JOIN pi ON pi.key = asked.key AND {_LIVE}""")
def kv_get_status(s, d):
    items = _part_items(s, d)
    return kv.get_status(items, items.select("key").unionByName(T(s, d, "part").select(F.concat(F.lit("absent"), "p_partkey").alias("key"))), NOW)


@query(f"WITH {_PI} SELECT key, exptime, nbytes FROM pi WHERE type = 'kv' AND {_LIVE}")
def kv_get(s, d):
    items = _part_items(s, d)
    return kv.get(items, items.select("key"), NOW).select("key", "exptime", "nbytes")


@query("SELECT s_suppkey AS pos, 'part:' || p_partkey AS key, p_name AS value, p_partkey AS cas FROM supplier JOIN part ON p_partkey = (s_suppkey // 2) * 7")
def kv_mget(s, d):
    keys = T(s, d, "supplier").select(C("s_suppkey").alias("pos"), F.concat(F.lit("part:"), _half("s_suppkey") * 7).alias("key"))
    return kv.mget(model.part_values(s, d), keys).select("pos", "key", "value", "cas")


@query("SELECT 'user:' || user_id AS key, max_by(event_type, event_id) AS value, max(event_id) AS cas FROM events GROUP BY user_id")
def kv_set_fold(s, d):
    return kv.set_fold(model.event_commands(s, d).select("key", "seq", C("op").alias("value"))).select("key", "value", C("seq").alias("cas"))


def _some_users(s, d):
    return T(s, d, "events").where("user_id % 2 = 0").select(F.concat(F.lit("user:"), "user_id").alias("key")).distinct()


@query("SELECT 'user:' || user_id AS key, min_by(event_type, event_id) AS value FROM events WHERE user_id % 2 <> 0 GROUP BY user_id")
def kv_add_fold(s, d):
    return kv.add_fold(_some_users(s, d), model.event_commands(s, d).select("key", "seq", C("op").alias("value"))).select("key", "value")


@query("SELECT 'user:' || user_id AS key, max_by(event_type, event_id) AS value FROM events WHERE user_id % 2 = 0 GROUP BY user_id")
def kv_replace_fold(s, d):
    return kv.replace_fold(_some_users(s, d), model.event_commands(s, d).select("key", "seq", C("op").alias("value"))).select("key", "value")


@query("""SELECT 'part:' || (s_suppkey * 31) AS key, s_suppkey AS cas,
  CASE WHEN p_partkey IS NULL THEN 'NOT_FOUND' WHEN p_partkey % 60 = s_suppkey % 60 THEN 'STORED' ELSE 'EXISTS' END AS status
  FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 31""")
def kv_cas_fold(s, d):
    log = T(s, d, "supplier").select(F.concat(F.lit("part:"), C("s_suppkey") * 31).alias("key"), C("s_suppkey").alias("n"), (C("s_suppkey") % 60).alias("cas"))
    return kv.cas(model.part_values(s, d).withColumn("cas", C("cas") % 60), log).select("key", C("n").alias("cas"), "status")


@query("SELECT 'user:' || user_id AS key, 'log' || string_agg('|' || event_type, '' ORDER BY event_id) AS value FROM events GROUP BY user_id")
def kv_append_fold(s, d):
    log = model.event_commands(s, d).select("key", "seq", F.concat(F.lit("|"), "op").alias("value"))
    return kv.append_fold(log.select("key").distinct().withColumn("value", F.lit("log")), log).select("key", "value")


@query("SELECT 'user:' || user_id AS key, string_agg(event_type || '|', '' ORDER BY event_id DESC) || 'log' AS value FROM events GROUP BY user_id")
def kv_prepend_fold(s, d):
    log = model.event_commands(s, d).select("key", "seq", F.concat("op", F.lit("|")).alias("value"))
    return kv.append_fold(log.select("key").distinct().withColumn("value", F.lit("log")), log, prepend=True).select("key", "value")


@query("""SELECT 'user:' || user_id AS key, CAST((CAST(18446744073709551000 AS HUGEINT) + sum(event_id)) % CAST(18446744073709551616 AS HUGEINT) AS VARCHAR) AS value FROM events GROUP BY user_id""")
def kv_incr_fold(s, d):
    log = model.event_commands(s, d).select("key", C("seq").alias("delta"))
    start = log.select("key").distinct().withColumn("value", F.lit("18446744073709551000"))
    return kv.incr_fold(start, log).select("key", C("value").cast("string").alias("value"))


@query("SELECT 'user:' || user_id AS key, CAST(greatest(300000 - sum(event_id), 0) AS VARCHAR) AS value FROM events GROUP BY user_id")
def kv_decr_fold(s, d):
    log = model.event_commands(s, d).select("key", C("seq").alias("delta"))
    start = log.select("key").distinct().withColumn("value", F.lit("300000"))
    return kv.decr_fold(start, log).select("key", C("value").cast("string").alias("value"))


@query("""WITH x AS (SELECT 'user:' || user_id AS key, event_id, sum(CASE WHEN event_type = 'purchase' THEN -7 ELSE event_id % 5 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)
  SELECT key, CAST(max_by(s, event_id) - least(min(s), 0) AS BIGINT) AS value FROM x GROUP BY key""")
def kv_counter_fold(s, d):
    log = model.event_commands(s, d).select("key", "seq", F.when(C("op") == "purchase", "decr").otherwise("incr").alias("op"), F.when(C("op") == "purchase", F.lit(7)).otherwise(C("seq") % 5).alias("delta"))
    return kv.count_fold(log)


@query("""WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS initial FROM events), f AS (SELECT user_id, min(event_id) AS made FROM x WHERE initial IS NOT NULL GROUP BY 1),
  g AS (SELECT x.user_id, any_value(made) AS made, sum(event_id) AS all_, coalesce(sum(event_id) FILTER (event_id > made), 0) AS later FROM x LEFT JOIN f USING (user_id) GROUP BY 1)
  SELECT 'user:' || user_id AS key, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN CAST(7 + all_ AS VARCHAR) WHEN made IS NULL THEN NULL ELSE CAST(made + later AS VARCHAR) END AS value,
    CASE WHEN user_id % 5 = 0 THEN 'EINVAL' WHEN user_id % 5 = 1 OR made IS NOT NULL THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM g""")
def kv_incr_initial(s, d):
    """Some keys hold a number, some a word, others are made by the first command that has an initial value."""
    u = C("user_id")
    log = T(s, d, "events").select(F.concat(F.lit("user:"), u).alias("key"), C("event_id").alias("seq"), C("event_id").alias("delta"), F.when(C("event_id") % 3 == 0, C("event_id")).alias("initial"))
    start = T(s, d, "events").where("user_id % 5 < 2").select(F.concat(F.lit("user:"), u).alias("key"), F.when(u % 5 == 0, "word").otherwise("7").alias("value")).distinct()
    return kv.incr_fold(start, log).select("key", C("value").cast("string").alias("value"), "status")


@query("SELECT 'part:' || p_partkey AS key, p_name AS value FROM part WHERE p_partkey NOT IN (SELECT s_suppkey * 7 FROM supplier)")
def kv_delete_fold(s, d):
    gone = T(s, d, "supplier").select(F.concat(F.lit("part:"), C("s_suppkey") * 7).alias("key"))
    return kv.delete(model.part_values(s, d), gone).select("key", "value")


@query("SELECT 'part:' || p_partkey AS key, p_name AS value FROM part WHERE p_partkey NOT IN (SELECT s_suppkey * 7 FROM supplier WHERE s_suppkey % 3 <> 1)")
def kv_delete_cas(s, d):
    """Deletes with the right cas, without one, and with a wrong one."""
    k = C("s_suppkey")
    gone = T(s, d, "supplier").select(F.concat(F.lit("part:"), k * 7).alias("key"), F.when(k % 3 == 0, k * 7).when(k % 3 == 1, F.lit(-1)).otherwise(F.lit(0)).alias("cas"))
    return kv.delete(model.part_values(s, d), gone).select("key", "value")


@query("""SELECT 'part:' || p_partkey AS key, coalesce(max_by(s_nationkey, s_suppkey), 0) AS exptime FROM part LEFT JOIN supplier ON p_partkey = (s_suppkey // 3) * 5 GROUP BY p_partkey""")
def kv_touch(s, d):
    log = T(s, d, "supplier").select(F.concat(F.lit("part:"), F.floor(C("s_suppkey") / 3) * 5).alias("key"), C("s_suppkey").alias("seq"), C("s_nationkey").cast("long").alias("exptime"))
    return kv.touch(model.part_values(s, d).withColumn("exptime", F.lit(0).cast("long")), log).select("key", "exptime")


@query(f"WITH {_PI} SELECT key, CAST(99 AS BIGINT) AS exptime, nbytes FROM pi WHERE type = 'kv' AND nbytes % 2 = 0")
def kv_gat(s, d):
    items = _part_items(s, d)
    return kv.get_and_touch(items, items.where("nbytes % 2 = 0").select("key"), 99).select("key", "exptime", "nbytes")


# ---- lists

_LI = "li AS (SELECT 'order:' || l_orderkey AS key, l_extendedprice AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


@query(f"WITH {_LI} SELECT key, idx, value, idx AS rank FROM li WHERE idx BETWEEN 1 AND 3")
def lop_get_forward(s, d):
    return lists.get(model.line_elements(s, d), 1, 3).select("key", C("idx").cast("long").alias("idx"), "value", "rank")


@query(f"WITH {_LI} SELECT key, idx, value, least(3, n - 1) - idx + 1 AS rank FROM li WHERE idx BETWEEN 1 AND 3 AND n > 1")
def lop_get_backward(s, d):
    return lists.get(model.line_elements(s, d), 3, 1).select("key", C("idx").cast("long").alias("idx"), "value", "rank")


@query(f"WITH {_LI} SELECT key, idx, value, idx - greatest(n - 2, 0) + 1 AS rank FROM li WHERE idx >= n - 2")
def lop_get_negative(s, d):
    return lists.get(model.line_elements(s, d), -2, -1).select("key", C("idx").cast("long").alias("idx"), "value", "rank")


@query(f"WITH {_LI} SELECT key, value, n FROM li WHERE NOT (idx BETWEEN 0 AND 1)")
def lop_delete(s, d):
    e = lists.indexed(model.line_elements(s, d)).select("key", "seq", "value", C("ccnt").alias("n"))
    return lists.delete(e, 0, 1).select("key", "value", C("n").cast("long").alias("n"))


@query(f"WITH {_LI} SELECT key, value FROM li WHERE idx >= n - 3")
def lop_head_trim(s, d):
    return lists.bounded(model.line_elements(s, d), 3).select("key", "value")


@query("""WITH x AS (SELECT 'user:' || user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT key, -event_id AS seq FROM x WHERE r <= 5""")
def lop_tail_trim(s, d):
    return lists.bounded(model.event_commands(s, d).select("key", "seq", "value"), 5, at_head=True).select("key", "seq")


@query(f"WITH {_LI} SELECT key, value FROM li WHERE idx < 2")
def lop_overflow_error(s, d):
    return lists.bounded(model.line_elements(s, d), 2, ovflaction="error").select("key", "value")


@query(f"""WITH {_LI}, a AS (SELECT o_orderkey AS o, o_orderkey % 11 - 5 AS i FROM orders), c AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1),
  q AS (SELECT a.o, i, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (o)), ok AS (SELECT *, n >= 4 AS f, CASE WHEN i = -1 THEN true WHEN i = 0 THEN false ELSE true END AS h FROM q WHERE CASE WHEN i >= 0 THEN i <= n AND i <= 3 ELSE -i <= n + 1 AND -i <= 4 END),
  at_ AS (SELECT o, n, f, h, CASE WHEN i < 0 THEN greatest(CASE WHEN f AND NOT h AND i < -1 THEN i + 1 ELSE i END + (CASE WHEN f THEN n - 1 ELSE n END) + 1, 0) WHEN f AND h AND i > 0 THEN i - 1 ELSE i END AS p FROM ok),
  e AS (SELECT li.key, li.value, at_.p, li.idx - CASE WHEN f AND h THEN 1 ELSE 0 END AS x FROM li LEFT JOIN at_ ON li.key = 'order:' || at_.o WHERE at_.o IS NULL OR NOT f OR (h AND li.idx > 0) OR (NOT h AND li.idx < at_.n - 1))
  SELECT key, CASE WHEN p IS NOT NULL AND x >= p THEN x + 1 ELSE x END AS idx, value FROM e UNION ALL SELECT 'order:' || o, p, -1.0 FROM at_""")
def lop_insert(s, d):
    """One insert a list, at indexes from -5 to 5, into lists of four at most that drop their heads."""
    k = C("o_orderkey")
    new = T(s, d, "orders").select(F.concat(F.lit("order:"), k).alias("key"), (k % 11 - 5).alias("idx"), F.lit(-1.0).alias("value"))
    return lists.insert(model.line_elements(s, d), new, 4, "head_trim")[0]


@query("""WITH c AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT o_orderkey AS o, o_orderkey % 11 - 5 AS i, coalesce(n, 0) AS n FROM orders LEFT JOIN c ON o = o_orderkey)
  SELECT 'order:' || o AS key, CASE WHEN NOT CASE WHEN i >= 0 THEN i <= n AND i <= 3 ELSE -i <= n + 1 AND -i <= 4 END THEN 'OUT_OF_RANGE' WHEN n >= 4 THEN 'OVERFLOWED' ELSE 'STORED' END AS status FROM q""")
def lop_insert_statuses(s, d):
    k = C("o_orderkey")
    new = T(s, d, "orders").select(F.concat(F.lit("order:"), k).alias("key"), (k % 11 - 5).alias("idx"), F.lit(-1.0).alias("value"))
    return lists.insert(model.line_elements(s, d), new, 4, "error")[1]


# ---- sets


@query("SELECT DISTINCT 'seg:' || c_mktsegment AS key, CAST(c_nationkey AS BIGINT) AS value FROM customer")
def sop_get_all(s, d):
    return sets.distinct(model.segment_members(s, d))


@query("""SELECT 'seg:' || m AS key, CAST(n_nationkey AS BIGINT) AS value, EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = m AND c_nationkey = n_nationkey AND c_custkey % 20 = 0) AS found
  FROM nation, (SELECT DISTINCT c_mktsegment AS m FROM customer)""")
def sop_exist(s, d):
    all_ = model.segment_members(s, d)
    asked = all_.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(24)).cast("array<bigint>")).alias("value"))
    return sets.exist(all_.where("seq % 20 = 0"), asked)


@query("""WITH f AS (SELECT c_mktsegment AS k, c_nationkey AS v, min(c_custkey) AS f FROM customer GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f) AS r FROM f),
  x AS (SELECT c_custkey AS seq, c_mktsegment AS k, c_nationkey AS v, r.f, (SELECT g.f FROM r g WHERE g.k = c_mktsegment AND g.r = 10) AS full_at FROM customer JOIN r ON r.k = c_mktsegment AND r.v = c_nationkey)
  SELECT 'seg:' || k AS key, seq, CASE WHEN seq > full_at THEN 'OVERFLOWED' WHEN seq = f THEN 'STORED' ELSE 'EXISTS' END AS status FROM x""")
def sop_insert_fold(s, d):
    return sets.insert_fold(model.segment_members(s, d), 10).select("key", "seq", "status")


@query("""WITH m AS (SELECT DISTINCT 'seg:' || c_mktsegment AS key, CAST(c_nationkey AS BIGINT) AS value FROM customer)
  SELECT key, value FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('1|' || key || '|' || value), value) <= 5""")
def sop_sample(s, d):
    return sets.get(sets.distinct(model.segment_members(s, d)), 5, seed=1)


@query("SELECT DISTINCT 'seg:' || c_mktsegment AS key, CAST(c_nationkey AS BIGINT) AS value FROM customer WHERE c_nationkey % 2 = 1")
def sop_delete(s, d):
    m = sets.distinct(model.segment_members(s, d))
    return sets.delete(m, m.where("value % 2 = 0"))


@query("SELECT 'seg:' || c_mktsegment AS key, CAST(c_nationkey AS BIGINT) AS value FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT 'seg:' || c_mktsegment, CAST(c_nationkey AS BIGINT) FROM customer WHERE c_custkey % 7 = 0")
def ext_set_intersect(s, d):
    m = model.segment_members(s, d)
    return sets.intersect(m.where("seq % 2 = 0"), m.where("seq % 7 = 0"))


@query("SELECT 'seg:' || c_mktsegment AS key, CAST(c_nationkey AS BIGINT) AS value FROM customer EXCEPT SELECT 'seg:' || c_mktsegment, CAST(c_nationkey AS BIGINT) FROM customer WHERE c_custkey % 9 = 0")
def ext_set_difference(s, d):
    m = model.segment_members(s, d)
    return sets.difference(m, m.where("seq % 9 = 0"))


# ---- maps


@query("SELECT 'nation:' || n_regionkey AS key, n_name AS field, CAST(n_nationkey AS BIGINT) AS value, CASE n_name WHEN 'NATION_9' THEN 0 ELSE 1 END AS pos FROM nation WHERE n_name IN ('NATION_9', 'NATION_0')")
def mop_get_fields(s, d):
    return maps.get(model.nation_fields(s, d), ["NATION_9", "NATION_0", "absent"]).withColumn("pos", C("pos").cast("int"))


_ME = "SELECT 'user:' || user_id AS key, event_type AS field"


@query(f"{_ME}, max(event_id) AS seq, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def mop_upsert_fold(s, d):
    return maps.upsert_fold(model.event_commands(s, d).select("key", C("op").alias("field"), "seq", "value")).select("key", "field", "seq", "value")


@query(f"WITH f AS ({_ME}, min(event_id) AS seq, min_by(value, event_id) AS value FROM events GROUP BY 1, 2) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) <= 3")
def mop_insert_fold(s, d):
    return maps.insert_fold(model.event_commands(s, d).select("key", C("op").alias("field"), "seq", "value"), 3).select("key", "field", "seq", "value")


@query("SELECT 'nation:' || n_regionkey AS key, n_name AS field, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 100 ELSE n_nationkey END AS BIGINT) AS value FROM nation")
def mop_update(s, d):
    """Two updates of each field: the later one holds."""
    m = model.nation_fields(s, d)
    even = m.where("value % 2 = 0")
    return maps.update(m, even.withColumns({"seq": F.lit(2), "value": C("value") * 100}).unionByName(even.withColumns({"seq": F.lit(1), "value": C("value") * 999})))


@query("SELECT 'nation:' || n_regionkey AS key, n_name AS field, CAST(n_nationkey AS BIGINT) AS value FROM nation WHERE n_name <> 'NATION_0'")
def mop_delete(s, d):
    return maps.delete(model.nation_fields(s, d), ["NATION_0", "absent"])


# ---- trees: reads

A, B = 1_000, 1 << 60  # as wide as the table


@query(f"WITH {_BT}, r AS (SELECT key, bkey, value, row_number() OVER (PARTITION BY key ORDER BY bkey) AS rank FROM bt WHERE bkey BETWEEN {A} AND {B}) SELECT key, bkey, value, rank - 1 AS rank FROM r WHERE rank > 1 AND rank <= 4")
def bop_get(s, d):
    return btree.get(_trees(s, d), A, B, 1, 3).select("key", "bkey", "value", C("rank").cast("long").alias("rank"))


@query(f"WITH {_BT}, r AS (SELECT key, bkey, value, row_number() OVER (PARTITION BY key ORDER BY bkey DESC) AS rank FROM bt WHERE bkey BETWEEN {A} AND {B}) SELECT * FROM r WHERE rank <= 3")
def bop_get_desc(s, d):
    return btree.get(_trees(s, d), B, A, 0, 3).select("key", "bkey", "value", C("rank").cast("long").alias("rank"))


@query(f"WITH {_BT}, r AS (SELECT key, bkey, value, row_number() OVER (PARTITION BY key ORDER BY bkey) AS rank FROM bt WHERE bkey BETWEEN {A} AND {B} AND eflag & 3 = 1) SELECT * FROM r WHERE rank <= 2")
def bop_get_efilter(s, d):
    return btree.get(_trees(s, d), A, B, 0, 2, fb.eflag_filter(C("eflag"), "EQ", [b"\x01"], 0, "AND", b"\x03")).select("key", "bkey", "value", C("rank").cast("long").alias("rank"))


@query(f"WITH {_BT} SELECT key, bkey, value FROM bt WHERE eflag NOT IN (1, 3)")
def bop_get_efilter_not_in(s, d):
    e = _trees(s, d)
    return e.where(fb.eflag_filter(C("eflag"), "NE", [b"\x01", b"\x03"])).select("key", "bkey", "value")


@query(f"WITH {_BT} SELECT 'cust:' || c_custkey AS key, count(bkey) AS n FROM customer LEFT JOIN bt ON bt.o_custkey = c_custkey AND bkey BETWEEN {A} AND {B} GROUP BY c_custkey")
def bop_count(s, d):
    return btree.count(_tree_items(s, d), _trees(s, d), A, B)


@query(f"WITH {_BT}, r AS (SELECT key, bkey, bkey BETWEEN {A} AND {B} AND eflag >= 2 AS m FROM bt), q AS (SELECT *, row_number() OVER (PARTITION BY key, m ORDER BY bkey DESC) AS r FROM r) SELECT key, bkey FROM q WHERE NOT (m AND r <= 2)")
def bop_delete(s, d):
    return btree.delete(_trees(s, d), B, A, fb.eflag_filter(C("eflag"), "GE", [b"\x02"]), 2).select("key", "bkey")


@query(f"WITH {_BT} SELECT key, bkey, upper(printf('%02x', xor(eflag, 5))) AS eflag FROM bt")
def bop_update_eflag(s, d):
    return _trees(s, d).select("key", "bkey", F.hex(fb.eflag_update(C("eflag"), b"\x05", "XOR", 0)).alias("eflag"))


@query("""WITH x AS (SELECT 'user:' || user_id AS key, event_id % 20 AS bkey, sum(event_id) AS d, min(event_id) AS first, user_id % 2 = 0 AS there FROM events GROUP BY 1, 2, 5)
  SELECT key, bkey, CAST(CASE WHEN there THEN d + 10 ELSE d - first + 10 END AS VARCHAR) AS value FROM x""")
def bop_incr_fold(s, d):
    """Elements counted up under a composed key; where they are absent, the first command makes them with its initial value."""
    e = T(s, d, "events")
    key = F.concat_ws("#", F.concat(F.lit("user:"), "user_id"), C("event_id") % 20)
    log = e.select(key.alias("key"), C("event_id").alias("seq"), C("event_id").alias("delta"), F.lit("10").alias("initial"))
    out = kv.incr_fold(e.where("user_id % 2 = 0").select(key.alias("key")).distinct().withColumn("value", F.lit("10")), log)
    return out.select(F.split_part("key", F.lit("#"), F.lit(1)).alias("key"), F.split_part("key", F.lit("#"), F.lit(2)).cast("long").alias("bkey"), C("value").cast("string").alias("value"))


@query(f"WITH {_BT} SELECT key, bkey, row_number() OVER (PARTITION BY key ORDER BY bkey) - 1 AS position FROM bt")
def bop_position(s, d):
    """The place of every element; each is asked twice."""
    e = _trees(s, d)
    asked = e.select("key", "bkey")
    return btree.position(e, asked.unionByName(asked))


@query(f"WITH {_BT} SELECT key, bkey, row_number() OVER (PARTITION BY key ORDER BY bkey DESC) - 1 AS position FROM bt")
def bop_position_desc(s, d):
    e = _trees(s, d)
    return btree.position(e, e.select("key", "bkey"), descending=True)


@query(f"WITH {_BT}, r AS (SELECT key, bkey, row_number() OVER (PARTITION BY key ORDER BY bkey) - 1 AS position FROM bt) SELECT key, bkey, position FROM r WHERE position BETWEEN 2 AND 5")
def bop_gbp(s, d):
    return btree.get_by_position(_trees(s, d), 5, 2).select("key", "bkey", C("position").cast("long").alias("position"))


@query(f"""WITH {_BT}, r AS (SELECT key, bkey, row_number() OVER (PARTITION BY key ORDER BY bkey) - 1 AS position FROM bt)
  SELECT x.key, a.bkey AS asked, x.bkey, x.position, least(a.position, 2) AS index FROM r x JOIN r a ON a.key = x.key AND abs(a.position - x.position) <= 2""")
def bop_pwg(s, d):
    e = _trees(s, d)
    out = btree.position_with_get(e, e, 2)
    return out.select("key", "asked", "bkey", C("position").cast("long").alias("position"), C("index").cast("long").alias("index"))


_KINDS = "CASE WHEN c_custkey % 19 = 0 THEN 'list' ELSE 'btree' END"


@query(f"""WITH {_BT}, it AS (SELECT 'cust:' || c_custkey AS key, {_KINDS} AS type, c_custkey % 17 <> 0 AS readable, c_custkey % 3 = 0 AS trimmed, CASE WHEN c_custkey % 2 = 0 THEN 'smallest_trim' ELSE 'largest_trim' END AS ovflaction FROM customer), {_AS},
  r AS (SELECT key, bkey, value, row_number() OVER (PARTITION BY key ORDER BY bkey) AS rank, count(*) OVER (PARTITION BY key) AS m FROM bt WHERE bkey BETWEEN {A} AND {B}),
  g AS (SELECT key, min(bkey) AS least, max(bkey) AS most FROM bt GROUP BY key),
  t AS (SELECT a.pos, a.key, type, readable, rank, bkey, least, CASE WHEN NOT trimmed THEN false WHEN ovflaction = 'smallest_trim' THEN {A} < least ELSE {A} > most OR {B} > most AND coalesce(m, 0) < 3 END AS over_
    FROM asked a LEFT JOIN it USING (key) LEFT JOIN g USING (key) LEFT JOIN r ON r.key = a.key AND r.rank <= 3),
  u AS (SELECT *, CASE WHEN type IS NULL THEN 'NOT_FOUND' WHEN type <> 'btree' THEN 'TYPE_MISMATCH' WHEN NOT readable THEN 'UNREADABLE' WHEN least IS NULL THEN 'NOT_FOUND_ELEMENT'
    WHEN rank IS NULL THEN CASE WHEN over_ THEN 'OUT_OF_RANGE' ELSE 'NOT_FOUND_ELEMENT' END WHEN over_ THEN 'TRIMMED' ELSE 'OK' END AS status FROM t)
  SELECT pos, key, status, CASE WHEN status IN ('OK', 'TRIMMED') THEN rank END AS rank, CASE WHEN status IN ('OK', 'TRIMMED') THEN bkey END AS bkey FROM u WHERE status IN ('OK', 'TRIMMED') OR rank IS NULL OR rank = 1""")
def bop_mget(s, d):
    items = _tree_items(s, d).withColumn("type", F.when(F.substring("key", 6, 20).cast("long") % 19 == 0, "list").otherwise("btree"))
    out = btree.mget(items, _trees(s, d), _asked(s, d), A, B, 0, 3)
    return out.select("pos", "key", "status", C("rank").cast("long").alias("rank"), "bkey")


_BIG = 9_223_372_036_854_775_808


@query(f"""WITH e AS (SELECT 'cust:' || o_custkey AS key, CAST({_BIG} AS HUGEINT) + o_orderkey AS bkey FROM orders UNION ALL SELECT 'cust:' || o_custkey, CAST(o_orderkey AS HUGEINT) FROM orders)
  SELECT key, CAST(bkey AS VARCHAR) AS bkey, row_number() OVER (PARTITION BY key ORDER BY bkey DESC) AS rank FROM e WHERE bkey BETWEEN 500 AND CAST({_BIG + 7000} AS HUGEINT) QUALIFY rank <= 8""")
def bop_get_uint64(s, d):
    """Element keys on both sides of 2**63."""
    o = T(s, d, "orders")
    key, n = F.concat(F.lit("cust:"), "o_custkey").alias("key"), C("o_orderkey").cast("decimal(20,0)")
    e = o.select(key, (F.lit(Decimal(_BIG)) + n).cast("decimal(20,0)").alias("bkey")).unionByName(o.select(key, n.alias("bkey")))
    return btree.get(e, Decimal(_BIG + 7000), Decimal(500), 0, 8).select("key", C("bkey").cast("string").alias("bkey"), C("rank").cast("long").alias("rank"))


@query(f"""WITH e AS (SELECT 'cust:' || o_custkey AS key, o_orderkey, o_orderkey * 7919 % 1000003 AS h FROM orders), k AS (SELECT *, max(h) OVER (PARTITION BY key) AS top FROM e)
  SELECT key, upper(printf('%06x', h)) AS bkey FROM k WHERE h >= top - 349525 QUALIFY row_number() OVER (PARTITION BY key ORDER BY h DESC) <= 4""")
def bop_maxbkeyrange_hex(s, d):
    """Binary element keys under a binary range bound."""
    o = T(s, d, "orders")
    e = o.select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), fb.from_hex(F.concat(F.lit("0x"), F.lpad(F.hex(C("o_orderkey") * 7919 % 1000003), 6, "0"))).alias("bkey"), C("o_orderkey").alias("seq"))
    return btree.bounded(e, 4, "smallest_trim", bytes.fromhex("055555")).select("key", F.hex("bkey").alias("bkey"))


@query(f"""WITH {_BT}, n AS (SELECT 'cust:' || c_custkey AS key, c_custkey * 7 AS bkey FROM customer), g AS (SELECT key, count(*) AS n, min(bkey) AS lo, min_by(value, bkey) AS v FROM bt GROUP BY key),
  x AS (SELECT n.key, n.bkey, CASE WHEN bt.key IS NOT NULL THEN 'ELEMENT_EXISTS' WHEN g.n >= 9 AND n.bkey < lo THEN 'OUT_OF_RANGE' ELSE 'STORED' END AS status, g.n, lo, v FROM n LEFT JOIN g USING (key) LEFT JOIN bt ON bt.key = n.key AND bt.bkey = n.bkey)
  SELECT key, bkey, status, CASE WHEN status = 'STORED' AND n >= 9 THEN lo END AS trimmed_bkey, CASE WHEN status = 'STORED' AND n >= 9 THEN v END AS trimmed_value FROM x""")
def bop_insert_getrim(s, d):
    """One insert a tree, and what it evicts."""
    new = T(s, d, "customer").select(F.concat(F.lit("cust:"), "c_custkey").alias("key"), (C("c_custkey") * 7).alias("bkey"))
    return btree.insert_each(_trees(s, d), new, 9, "smallest_trim")


@query(f"""WITH {_BT}, r AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY bkey) AS n, sum(CASE WHEN eflag = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY bkey) AS p FROM bt WHERE bkey BETWEEN {A} AND {B}),
  c AS (SELECT key, CAST(coalesce(min(n) FILTER (p >= 2), max(n)) AS BIGINT) AS cost FROM r GROUP BY key)
  SELECT 'bop_get' AS op, key AS argument, CAST(substr(key, 6) AS BIGINT) AS seq, cost FROM c WHERE cost >= 6 QUALIFY row_number() OVER (ORDER BY CAST(substr(key, 6) AS BIGINT)) <= 20""")
def lqdetect_bop(s, d):
    """Costs of filtered reads by what they visit."""
    cost = btree.visits(_trees(s, d), A, B, 0, 2, fb.eflag_filter(C("eflag"), "EQ", [b"\x01"]))
    log = cost.select(F.lit("bop_get").alias("op"), C("key").alias("argument"), F.substring("key", 6, 20).cast("long").alias("seq"), C("cost").cast("long").alias("cost"))
    return stats.long_queries(log, 6).select("op", "argument", "seq", "cost")


def _smget(s, d, a, b, offset, count, unique):
    return smget.smget(_tree_items(s, d), _trees(s, d), _asked(s, d), a, b, offset, count, unique)


_SM = f"""{_BT}, {_IT}, {_AS}, ed AS (SELECT key, min(bkey) AS least, max(bkey) AS most FROM bt GROUP BY key),
  st AS (SELECT a.pos, a.key, it.*, least, most FROM asked a LEFT JOIN (SELECT key AS k, readable, trimmed, ovflaction FROM it) it ON it.k = a.key LEFT JOIN ed ON ed.key = a.key)"""


def _cause(a: int) -> str:
    return f"CASE WHEN readable IS NULL THEN 'NOT_FOUND' WHEN NOT readable THEN 'UNREADABLE' WHEN trimmed AND (ovflaction = 'smallest_trim' AND {a} < least OR ovflaction = 'largest_trim' AND {a} > most) THEN 'OUT_OF_RANGE' END"


@query(f"WITH {_SM}, q AS (SELECT DISTINCT key FROM st WHERE ({_cause(4000)}) IS NULL) SELECT key, bkey, value, row_number() OVER (ORDER BY bkey, key) - 5 AS rank FROM bt WHERE key IN (SELECT key FROM q) AND bkey BETWEEN 4000 AND {B} ORDER BY bkey, key LIMIT 60 OFFSET 5")
def bop_smget_dup(s, d):
    return _smget(s, d, 4000, B, 5, 60, False).rows.select("key", "bkey", "value", C("rank").cast("long").alias("rank"))


@query("""WITH q AS (SELECT DISTINCT 'user:' || s_suppkey AS key FROM supplier), e AS (SELECT 'user:' || user_id AS key, event_id % 500 AS bkey, max(value) AS value FROM events GROUP BY 1, 2),
  u AS (SELECT bkey, max(key) AS key, max_by(value, key) AS value FROM e WHERE key IN (SELECT key FROM q) AND bkey BETWEEN 20 AND 400 GROUP BY bkey)
  SELECT key, bkey, value, row_number() OVER (ORDER BY bkey DESC) AS rank FROM u ORDER BY bkey DESC LIMIT 50""")
def bop_smget_unique(s, d):
    e = model.event_commands(s, d).groupBy("key", (C("seq") % 500).alias("bkey")).agg(F.max("value").alias("value"))
    items = e.select("key").distinct().withColumns({"type": F.lit("btree"), "readable": F.lit(True), "ovflaction": F.lit("smallest_trim"), "trimmed": F.lit(False)})
    keys = T(s, d, "supplier").select(C("s_suppkey").alias("pos"), F.concat(F.lit("user:"), C("s_suppkey")).alias("key"))
    return smget.smget(items, e, keys, 400, 20, 0, 50, True).rows.select("key", "bkey", "value", C("rank").cast("long").alias("rank"))


@query(f"WITH {_SM} SELECT pos, key, {_cause(4000)} AS cause FROM st WHERE ({_cause(4000)}) IS NOT NULL")
def bop_smget_missed(s, d):
    return _smget(s, d, 4000, B, 5, 60, False).missed


@query(f"""WITH {_SM}, q AS (SELECT DISTINCT key, trimmed, ovflaction, least FROM st WHERE ({_cause(B)}) IS NULL AND least IS NOT NULL),
  n AS (SELECT q.key, count(bt.bkey) AS between_ FROM q LEFT JOIN bt ON bt.key = q.key AND bt.bkey <= {B} AND bt.bkey > 500 GROUP BY q.key)
  SELECT q.key, least AS bkey FROM q JOIN n USING (key) WHERE trimmed AND ovflaction = 'smallest_trim' AND (500 < least OR 500 = least AND between_ = 0)""")
def bop_smget_trimmed(s, d):
    return _smget(s, d, B, 500, 0, 1 << 30, False).trimmed


# ---- trees: bounded states and statuses


def _log(s, d):
    return model.event_commands(s, d).select("key", "seq", (C("seq") * 7919 % 1000).alias("bkey"), "value")


_LG = "lg AS (SELECT 'user:' || user_id AS key, event_id AS seq, event_id * 7919 % 1000 AS bkey, value FROM events), fw AS (SELECT key, bkey, min(seq) AS seq, min_by(value, seq) AS value FROM lg GROUP BY 1, 2)"


@query(f"WITH {_LG} SELECT key, bkey, seq, value FROM fw QUALIFY row_number() OVER (PARTITION BY key ORDER BY bkey DESC) <= 10")
def bop_smallest_trim(s, d):
    return btree.bounded(btree.first_writes(_log(s, d)), 10, "smallest_trim").select("key", "bkey", "seq", "value")


@query(f"WITH {_LG}, lw AS (SELECT key, bkey, max(seq) AS seq, max_by(value, seq) AS value FROM lg GROUP BY 1, 2) SELECT key, bkey, seq, value FROM lw QUALIFY row_number() OVER (PARTITION BY key ORDER BY bkey) <= 10")
def bop_largest_trim_upsert(s, d):
    return btree.bounded(btree.last_writes(_log(s, d)), 10, "largest_silent_trim").select("key", "bkey", "seq", "value")


@query(f"WITH {_LG} SELECT key, bkey, seq, value FROM fw QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) <= 10")
def bop_overflow_error(s, d):
    return btree.bounded(btree.first_writes(_log(s, d)), 10, "error").select("key", "bkey", "seq", "value")


@query(f"WITH {_LG}, k AS (SELECT * FROM fw QUALIFY bkey >= max(bkey) OVER (PARTITION BY key) - 300) SELECT key, bkey, seq, value FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY bkey DESC) <= 12")
def bop_maxbkeyrange(s, d):
    return btree.bounded(btree.first_writes(_log(s, d)), 12, "smallest_trim", 300).select("key", "bkey", "seq", "value")


@query(f"WITH {_LG} SELECT key, least(count(*), 10) AS ccnt, count(*) > 10 AS trimmed FROM fw GROUP BY key")
def bop_trimmed_flag(s, d):
    out = btree.trimmed_flag(btree.first_writes(_log(s, d)), 10, "smallest_trim")
    return out.select("key", C("ccnt").cast("long").alias("ccnt"), "trimmed")


@query(f"""WITH {_LG}, w AS (SELECT key, bkey, seq, coalesce(max(first_seen) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stored_before, first_seen
    FROM (SELECT lg.*, CASE WHEN lg.seq = fw.seq THEN row_number() OVER (PARTITION BY lg.key, lg.seq = fw.seq ORDER BY lg.seq) END AS first_seen FROM lg JOIN fw USING (key, bkey))),
  kept AS (SELECT key, bkey FROM fw QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) <= 10)
  SELECT w.key, w.seq, CASE WHEN kept.bkey IS NOT NULL AND first_seen IS NOT NULL THEN 'STORED' WHEN kept.bkey IS NOT NULL THEN 'ELEMENT_EXISTS' ELSE 'OVERFLOWED' END AS status
  FROM w LEFT JOIN kept ON kept.key = w.key AND kept.bkey = w.bkey""")
def bop_insert_statuses(s, d):
    return btree.insert_statuses(_log(s, d), 10)


@query(f"""WITH {_BT}, {_IT}, rq AS (SELECT c_custkey AS req, 'cust:' || ((c_custkey // 2) * 3) AS key, c_custkey * 9 AS a, c_custkey * (c_custkey % 13) AS b, c_custkey % 2 AS offset_, c_custkey % 4 AS count_ FROM customer),
  ed AS (SELECT key, count(*) AS ccnt, min(bkey) AS least, max(bkey) AS most FROM bt GROUP BY key),
  m AS (SELECT req, count(*) FILTER (bkey BETWEEN least(a, b) AND greatest(a, b)) AS matches, count(*) FILTER (CASE WHEN a <= b THEN bkey >= a AND bkey < b ELSE bkey > b AND bkey <= a END) AS between_ FROM rq JOIN bt USING (key) GROUP BY req),
  s AS (SELECT rq.*, readable, trimmed, ovflaction, ccnt, least, most, coalesce(matches, 0) AS matches, coalesce(between_, 0) AS between_, count_ > 0 AND coalesce(matches, 0) - offset_ >= count_ AS stopped
    FROM rq LEFT JOIN it ON it.key = rq.key LEFT JOIN ed ON ed.key = rq.key LEFT JOIN m USING (req)),
  o AS (SELECT *, CASE WHEN readable IS NULL THEN 'NOT_FOUND' WHEN NOT readable THEN 'UNREADABLE' WHEN coalesce(ccnt, 0) = 0 OR offset_ >= ccnt THEN 'NOT_FOUND_ELEMENT' ELSE 'OK' END AS st,
    trimmed AND CASE WHEN ovflaction = 'smallest_trim' THEN a < least OR (a > b AND (b < least OR b = least AND between_ = 0) AND NOT stopped)
      ELSE a > most OR (a < b AND (b > most OR b = most AND between_ = 0) AND NOT stopped) END AS over_ FROM s),
  n AS (SELECT *, CASE WHEN st <> 'OK' THEN 0 WHEN count_ > 0 THEN least(count_, greatest(matches - offset_, 0)) ELSE greatest(matches - offset_, 0) END AS n FROM o)
  SELECT req, key, n, CASE WHEN st <> 'OK' THEN st WHEN n > 0 AND over_ THEN 'TRIMMED' WHEN n > 0 THEN 'END' WHEN over_ THEN 'OUT_OF_RANGE' ELSE 'NOT_FOUND_ELEMENT' END AS status FROM n""")
def bop_get_trim_status(s, d):
    k = C("c_custkey")
    req = T(s, d, "customer").select(k.alias("req"), F.concat(F.lit("cust:"), _half("c_custkey") * 3).alias("key"), (k * 9).alias("a"), (k * (k % 13)).alias("b"), (k % 2).alias("offset"), (k % 4).alias("count"))
    return btree.read_status(req, _tree_items(s, d), _trees(s, d)).select("req", "key", "n", "status")


@query(f"WITH {_BT}, n AS (SELECT o_custkey * 10000000 + bkey AS id, key, bkey, value FROM bt) SELECT key, bkey, CASE WHEN bkey % 4 = 0 THEN value * 2 ELSE value END AS value FROM n")
def bop_update(s, d):
    e = _trees(s, d).select("key", "bkey", "value")
    some = e.where("bkey % 4 = 0")
    return btree.bulk_update(e, some.withColumns({"value": C("value") * 2, "seq": F.lit(2)}).unionByName(some.withColumns({"value": C("value") * 5, "seq": F.lit(1)})))


# ---- attributes, scans, invalidation


@query(f"""WITH {_BT}, g AS (SELECT key, count(*) AS c, min(bkey) AS lo, max(bkey) AS hi FROM bt GROUP BY key), j AS (SELECT it.key, CAST(coalesce(c, 0) AS VARCHAR) AS c, CAST(lo AS VARCHAR) AS lo, CAST(hi AS VARCHAR) AS hi, ovflaction FROM it LEFT JOIN g USING (key)), {_IT}
  SELECT key, 0 AS pos, 'ovflaction' AS name, ovflaction AS value FROM j UNION ALL SELECT key, 1, 'count', c FROM j UNION ALL SELECT key, 2, 'minbkey', lo FROM j UNION ALL SELECT key, 3, 'maxbkey', hi FROM j""".replace(f", {_IT}\n", "\n").replace(f"WITH {_BT}", f"WITH {_BT}, {_IT}"))
def getattr_btree(s, d):
    return attributes.getattr_rows(_tree_items(s, d), _trees(s, d).select("key", "bkey"), ["ovflaction", "count", "minbkey", "maxbkey"])


@query(f"WITH {_PI} SELECT key, CASE WHEN type = 'kv' THEN 'EBADATTR' ELSE 'OK' END AS status FROM pi UNION ALL SELECT 'absent' || p_partkey, 'NOT_FOUND' FROM part")
def getattr_status(s, d):
    items = _part_items(s, d)
    asked = items.select("key").unionByName(T(s, d, "part").select(F.concat(F.lit("absent"), "p_partkey").alias("key")))
    return attributes.getattr_status(items, asked, ["type", "count", "maxcount"])


@query(f"WITH {_PI} SELECT key, CAST(1 AS BIGINT) AS seq, 'EXISTS' AS status FROM pi UNION ALL SELECT 'new' || p_partkey, unnest([1, 2]), unnest(['CREATED', 'EXISTS']) FROM part")
def create_statuses(s, d):
    """Collections to be made under keys that are there, and twice under keys that aren't."""
    items = _part_items(s, d)
    new = T(s, d, "part").select(F.concat(F.lit("new"), "p_partkey").alias("key"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("seq"))
    asked = items.select("key", F.lit(1).cast("long").alias("seq")).unionByName(new).withColumn("type", F.lit("btree"))
    return attributes.create(items, asked)[1]


@query("""WITH x AS (SELECT 'cust:' || c_custkey AS key, c_custkey AS k FROM customer) SELECT key, CASE WHEN k % 5 = 1 THEN 'error' WHEN k % 2 = 0 THEN 'smallest_trim' ELSE 'largest_trim' END AS ovflaction,
  k % 3 = 0 AND k % 5 <> 1 AS trimmed, CASE WHEN k % 7 = 0 AND k % 5 <> 0 THEN 60000 ELSE 0 END AS x FROM x""".replace("CASE WHEN k % 7 = 0 AND k % 5 <> 0 THEN 60000 ELSE 0 END AS x", "CASE WHEN k % 7 = 0 AND k % 5 <> 0 THEN 50000 END AS maxcount"))
def setattr_applied(s, d):
    """Changes that hold: a new action clears the trimmed mark, a bound over the greatest is cut to it; changes with a bad part do nothing."""
    k = F.substring("key", 6, 20).cast("long")
    items = _tree_items(s, d).withColumns({"exptime": F.lit(0).cast("long"), "maxcount": F.lit(None).cast("long")})
    changes = items.select("key", F.when(k % 7 == 0, F.lit(60_000)).cast("long").alias("maxcount"), F.when(k % 5 == 0, "head_trim").when(k % 5 == 1, "error").alias("ovflaction"))
    checked = attributes.setattr_status(changes, items, btree.edges(_trees(s, d)))
    return attributes.setattr_apply(items, checked).select("key", "ovflaction", "trimmed", "maxcount")


@query("""WITH g AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1), x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 6 END AS maxcount, CASE WHEN c_custkey % 5 = 0 THEN 'head_trim' WHEN c_custkey % 5 = 1 THEN 'error' END AS act, c FROM customer LEFT JOIN g ON o_custkey = c_custkey)
  SELECT 'cust:' || c_custkey AS key, CASE WHEN maxcount < coalesce(c, 0) OR act = 'head_trim' THEN 'ATTR_ERROR bad value' ELSE 'OK' END AS status FROM x""")
def setattr_checked(s, d):
    k = F.substring("key", 6, 20).cast("long")
    items = _tree_items(s, d).withColumn("exptime", F.lit(0).cast("long"))
    changes = items.select("key", F.when(k % 3 == 0, F.lit(6)).cast("long").alias("maxcount"), F.when(k % 5 == 0, "head_trim").when(k % 5 == 1, "error").alias("ovflaction"))
    return attributes.setattr_status(changes, items, btree.edges(_trees(s, d))).select("key", "status")


@query(f"WITH {_PI} SELECT key, CASE type WHEN 'kv' THEN 'K' WHEN 'list' THEN 'L' WHEN 'set' THEN 'S' WHEN 'map' THEN 'M' ELSE 'B' END AS type FROM pi WHERE {_LIVE} AND key LIKE 'Brand#1_:part%3%' AND type = 'kv'")
def scan_key_glob(s, d):
    return scan.scan_keys(_part_items(s, d), NOW, "Brand#1?:part*3*", "K").select("key", "type")


@query(f"WITH {_PI} SELECT prefix, count(*) AS items, CAST(sum(nbytes) AS BIGINT) AS bytes FROM pi WHERE {_LIVE} AND prefix LIKE '%1%' GROUP BY prefix")
def scan_prefix(s, d):
    return scan.scan_prefixes(_part_items(s, d), NOW, "*1*")


@query(f"WITH {_PI} SELECT (CASE type WHEN 'kv' THEN 'K' WHEN 'list' THEN 'L' WHEN 'set' THEN 'S' WHEN 'map' THEN 'M' ELSE 'B' END) || ' ' || key || ' ' || (CASE WHEN exptime <= 0 THEN exptime ELSE exptime - {NOW} END) AS value FROM pi WHERE {_LIVE}")
def key_dump(s, d):
    return scan.dump_lines(_part_items(s, d), NOW)


@query(f"WITH {_PI} SELECT key, atime FROM pi WHERE exptime <> -1 ORDER BY atime DESC, key LIMIT 200")
def cachedump(s, d):
    return scan.cachedump(_part_items(s, d), 200)


@query(f"WITH {_PI} SELECT key FROM pi WHERE {_LIVE} AND NOT atime <= {NOW - 1000}")
def flush_all(s, d):
    return retention.live(_part_items(s, d), NOW, NOW - 1000).select("key")


@query(f"WITH {_PI} SELECT key FROM pi WHERE {_LIVE} AND NOT (prefix IN ('Brand#11', 'Brand#12', '<null>') AND atime <= {NOW - 1})")
def flush_prefix(s, d):
    marks = s.createDataFrame([(p, retention.flush_mark(NOW)) for p in ("Brand#11", "Brand#12", "<null>", "absent")], "prefix string, oldest_live long")
    return retention.flush_prefixes(_part_items(s, d), marks, NOW).select("key")


@query(f"WITH {_PI} SELECT count(*) AS visited, count(*) FILTER (NOT {_LIVE}) AS cleaned FROM pi")
def scrub(s, d):
    return retention.scrub(_part_items(s, d), NOW)[1]


@query(f"""WITH {_PI}, l AS (SELECT * FROM pi WHERE {_LIVE}), h AS (SELECT sum(nbytes) AS held FROM l WHERE exptime = -1), t AS (SELECT sum(nbytes) AS all_ FROM l),
  r AS (SELECT key, sum(nbytes) OVER (ORDER BY atime DESC, key) AS s FROM l WHERE exptime <> -1)
  SELECT key FROM r, h WHERE s + held <= 60000 UNION ALL SELECT key FROM l WHERE exptime = -1""")
def lru_capacity(s, d):
    return retention.evict(_part_items(s, d), 60_000, NOW).select("key")


# ---- statistics


@query(f"""WITH {_PI} SELECT prefix, count(*) AS itm, {", ".join(f"count(*) FILTER (type = '{t}') AS {t[0]}itm" for t in model.TYPES)}, CAST(sum(nbytes) AS BIGINT) AS tsz,
  {", ".join(f"CAST(coalesce(sum(nbytes) FILTER (type = '{t}'), 0) AS BIGINT) AS {t[0]}tsz" for t in model.TYPES)} FROM pi GROUP BY prefix""")
def stats_prefixes(s, d):
    return stats.by_prefix(_part_items(s, d))


_OPS = ["click", "error", "purchase", "signup", "view"]


@query(f"""SELECT CASE WHEN user_id % 10 = 0 THEN '<null>' ELSE 'g' || user_id % 10 END AS prefix, {", ".join(f'count(*) FILTER (event_type = {o!r}) AS "{o}", count(*) FILTER (event_type = {o!r} AND value > 50) AS {o}_hits' for o in _OPS)} FROM events GROUP BY 1""")
def stats_detail(s, d):
    e = T(s, d, "events")
    u = C("user_id")
    log = e.select(F.when(u % 10 == 0, F.concat(F.lit("u"), u)).otherwise(F.concat(F.lit("g"), u % 10, F.lit(":u"), u)).alias("key"), C("event_type").alias("op"), (C("value") > 50).alias("hit"))
    return stats.by_command(log, _OPS)


@query(f"""SELECT 'user:' || user_id AS key, {", ".join(f'count(*) FILTER (event_type = {o!r}) AS "{o}"' for o in _OPS)}, count(*) AS total, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY user_id ORDER BY last_seq DESC, key LIMIT 100""")
def topkeys(s, d):
    return stats.top_keys(model.event_commands(s, d), 100, _OPS)


@query("""WITH q AS (SELECT event_type AS op, event_id AS seq, 'arg' || event_id % 200 AS argument, CAST(floor(value * 100) AS BIGINT) AS cost FROM events), f AS (SELECT op, argument, min(seq) AS seq, min_by(cost, seq) AS cost FROM q WHERE cost >= 4000 GROUP BY 1, 2)
  SELECT op, argument, seq, cost FROM f QUALIFY row_number() OVER (PARTITION BY op ORDER BY seq) <= 20""")
def lqdetect(s, d):
    log = model.event_commands(s, d).select("op", "seq", F.concat(F.lit("arg"), C("seq") % 200).alias("argument"), F.floor(C("value") * 100).cast("long").alias("cost"))
    return stats.long_queries(log)


@query(f"WITH {_PI} SELECT CAST(ceil(nbytes / 32.0) * 32 AS BIGINT) AS bytes, count(*) AS items FROM pi GROUP BY 1")
def stats_sizes(s, d):
    return stats.sizes(_part_items(s, d))


@query(f"WITH {_PI} SELECT prefix, type, count(*) AS items, CAST(sum(nbytes) AS BIGINT) AS bytes FROM pi GROUP BY ROLLUP (prefix, type)")
def ext_prefix_rollup(s, d):
    return stats.rolled_up(_part_items(s, d).withColumn("prefix", fk.prefix_of(C("key"))), ["prefix", "type"])


# ---- ring, batches, extensions

_MD = "list_reduce([CAST('0x' || substr(md5({x}), {i} + 7, 2) AS BIGINT), CAST('0x' || substr(md5({x}), {i} + 5, 2) AS BIGINT), CAST('0x' || substr(md5({x}), {i} + 3, 2) AS BIGINT), CAST('0x' || substr(md5({x}), {i} + 1, 2) AS BIGINT)], lambda a, b: a * 256 + b)"


@query(f"""WITH nodes AS (SELECT 'node' || s_suppkey || ':11211' AS node FROM supplier WHERE s_suppkey <= 5), pts AS (SELECT node, unnest([{", ".join(_MD.format(x="node || '-' || i", i=8 * j) for j in range(4))}]) AS h FROM nodes, range(40) t(i)),
  p AS (SELECT h, min(node) AS node FROM pts GROUP BY h), k AS (SELECT 'part:' || p_partkey AS key, {_MD.format(x="'part:' || p_partkey", i=0)} AS hash FROM part)
  SELECT key, hash, coalesce(q.h, (SELECT min(h) FROM p)) AS hpoint, coalesce(q.node, (SELECT min_by(node, h) FROM p)) AS node FROM k ASOF LEFT JOIN p q ON k.hash <= q.h""")
def ketama_lookup(s, d):
    nodes = T(s, d, "supplier").where("s_suppkey <= 5").select(F.concat(F.lit("node"), "s_suppkey", F.lit(":11211")).alias("node"))
    return ring.lookup(model.part_values(s, d).select("key"), ring.build(nodes))


@query("""WITH r AS (SELECT user_id AS batch, event_id AS seq, CASE WHEN event_type = 'error' THEN 'CLIENT_ERROR bad' ELSE 'STORED' END AS status FROM events), f AS (SELECT batch, min(seq) FILTER (status LIKE 'CLIENT%') AS fatal FROM r GROUP BY batch),
  k AS (SELECT r.*, row_number() OVER (PARTITION BY batch ORDER BY seq) AS n FROM r) SELECT k.batch, k.seq, k.status FROM k JOIN f USING (batch) WHERE (fatal IS NULL OR seq <= fatal) AND n <= 8""")
def pipelined(s, d):
    r = T(s, d, "events").select(C("user_id").alias("batch"), C("event_id").alias("seq"), F.when(C("event_type") == "error", "CLIENT_ERROR bad").otherwise("STORED").alias("status"))
    return pipeline.responses(r, 8)


@query(f"WITH {_BT} SELECT n_nationkey AS req, bt.key, bt.bkey FROM nation JOIN bt ON bt.o_custkey % 25 = n_nationkey AND bkey BETWEEN n_nationkey * 100 AND n_nationkey * 100 + 3000")
def ext_range_table(s, d):
    """A table of ranges instead of one: each request has its own keys and bounds."""
    e = _trees(s, d).withColumn("g", F.substring("key", 6, 20).cast("long") % 25)
    r = T(s, d, "nation").select("n_nationkey", C("n_nationkey").cast("long").alias("g"))
    lo = C("n_nationkey") * 100
    return e.join(r, "g").where(C("bkey").between(lo, lo + 3000)).select(C("n_nationkey").alias("req"), "key", "bkey")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type AS op, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_counters(s, d):
    w = T(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), C("event_type").alias("op")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.unix_timestamp("w.start").alias("start"), "op", "n")


# ---- what is left of times, codecs, batches, logs


@query(f"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN {NOW} WHEN 3 THEN {NOW} + p_partkey ELSE greatest(2592000 + p_partkey * 1000000, {NOW}) END AS expires FROM part""")
def exptime_normalised(s, d):
    k = C("p_partkey")
    given = F.when(k % 6 == 0, 0).when(k % 6 == 1, -1).when(k % 6 == 2, -2 - k).when(k % 6 == 3, k).otherwise(F.lit(2_592_000) + k * 1_000_000)
    return T(s, d, "part").select(k.alias("id"), fk.absolute_expiry(given, F.lit(NOW)).cast("long").alias("expires"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE '0x' || upper(printf('%08x', o_orderkey)) END AS value FROM orders""")
def hex_codec(s, d):
    """Text to bytes and back; an odd number of digits is no byte string."""
    k = C("o_orderkey")
    text = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(k), 8, "0")), F.when(k % 4 == 3, "0").otherwise(""))
    return T(s, d, "orders").select(k.alias("id"), fb.to_hex(fb.from_hex(text)).alias("value"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '18446744073709551615' END AS value FROM orders""")
def numeric_parse(s, d):
    k = C("o_orderkey")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "18446744073709551615").when(k % 4 == 2, "18446744073709551616").otherwise(F.concat(k, F.lit("x")))
    return T(s, d, "orders").select(k.alias("id"), fk.unsigned(text).cast("string").alias("value"))


@query("""WITH r AS (SELECT user_id AS batch, event_id AS seq, event_type = 'error' AS bad FROM events), f AS (SELECT batch, count(*) AS sent, min(seq) FILTER (bad) AS fatal FROM r GROUP BY batch),
  k AS (SELECT r.*, row_number() OVER (PARTITION BY batch ORDER BY seq) AS n FROM r), g AS (SELECT k.batch, count(*) AS n FROM k JOIN f USING (batch) WHERE (fatal IS NULL OR seq <= fatal) AND k.n <= 8 GROUP BY k.batch)
  SELECT batch, g.n, CASE WHEN g.n = sent THEN 'END' WHEN fatal IS NOT NULL AND g.n < 8 THEN 'PIPE_ERROR bad error' ELSE 'PIPE_ERROR command overflow' END AS closing FROM f JOIN g USING (batch)""")
def batch_end(s, d):
    r = T(s, d, "events").select(C("user_id").alias("batch"), C("event_id").alias("seq"), F.when(C("event_type") == "error", "CLIENT_ERROR bad").otherwise("STORED").alias("status"))
    return pipeline.batch_end(r, 8)


@query("""SELECT event_type AS op, count(*) AS n FROM events WHERE event_id > 500 GROUP BY 1""")
def stats_reset(s, d):
    """Counters since a reset."""
    return stats.since(model.event_commands(s, d), 500).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type AS op, count(*) AS ntotal FROM events WHERE floor(value * 100) >= 4000 GROUP BY 1""")
def lqdetect_totals(s, d):
    return stats.long_query_totals(model.event_commands(s, d).select("op", F.floor(C("value") * 100).alias("cost")))


@query(f"WITH {_PI}, x AS (SELECT key, coalesce(sum(nbytes) OVER (ORDER BY atime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pi WHERE exptime = -1) SELECT key FROM x WHERE before < 9000")
def sticky_within(s, d):
    return retention.sticky_within(_part_items(s, d).withColumn("seq", C("atime")), 9000).select("key")


@query(f"""WITH {_PI}, nodes AS (SELECT 'node' || s_suppkey || ':11211' AS node FROM supplier WHERE s_suppkey <= 5), pts AS (SELECT node, unnest([{", ".join(_MD.format(x="node || '-' || i", i=8 * j) for j in range(4))}]) AS h FROM nodes, range(40) t(i)),
  p AS (SELECT h, min(node) AS node FROM pts GROUP BY h), k AS (SELECT key, exptime, {_MD.format(x="key", i=0)} AS hash FROM pi), o AS (SELECT key, exptime, coalesce(q.node, (SELECT min_by(node, h) FROM p)) AS node FROM k ASOF LEFT JOIN p q ON k.hash <= q.h)
  SELECT key FROM o WHERE {_LIVE} AND node = 'node1:11211'""")
def scrub_stale(s, d):
    """What stays on one node of a ring: live items whose keys are its own."""
    nodes = T(s, d, "supplier").where("s_suppkey <= 5").select(F.concat(F.lit("node"), "s_suppkey", F.lit(":11211")).alias("node"))
    return retention.scrub(ring.lookup(_part_items(s, d), ring.build(nodes)), NOW, mine=C("node") == "node1:11211")[0].select("key")


@query(f"""WITH {_SM} SELECT DISTINCT pos FROM st WHERE ({_cause(4000)}) IS NOT NULL""")
def old_smget(s, d):
    return _smget(s, d, 4000, B, 5, 60, False).missed.select("pos").distinct()


@query("""WITH x AS (SELECT event_id AS id, 'user:' || user_id AS key, event_id % 5 AS k, event_id % 2 = 1 AS quiet FROM events)
  SELECT id, CASE k WHEN 0 THEN 'set' WHEN 1 THEN 'bop insert' WHEN 2 THEN 'mget' WHEN 3 THEN 'bop smget' END AS op, CASE WHEN k < 2 THEN key END AS key,
    CASE k WHEN 0 THEN '0 0 ' || id WHEN 1 THEN id || ' 6' WHEN 2 THEN '11 2' WHEN 3 THEN '11 2 0..100 10' END AS arguments, quiet AS noreply, CASE WHEN k = 4 THEN 'CLIENT_ERROR' END AS error FROM x""")
def command_parse(s, d):
    """Command lines made from events, parsed."""
    k, i = C("event_id") % 5, C("event_id").cast("string")
    key = F.concat(F.lit("user:"), "user_id")
    line = F.when(k == 0, F.concat_ws(" ", F.lit("set"), key, F.lit("0 0"), i)).when(k == 1, F.concat_ws(" ", F.lit("bop insert"), key, i, F.lit("6"))).when(k == 2, "mget 11 2").when(k == 3, "bop smget 11 2 0..100 10").otherwise("nonsense here")
    lines = T(s, d, "events").select(C("event_id").alias("id"), F.concat(line, F.when(C("event_id") % 2 == 1, " noreply").otherwise("")).alias("value"))
    return commands.parse(lines, ["id"]).withColumn("arguments", F.array_join("arguments", " "))


@query("""WITH s AS (SELECT 'user:' || user_id AS key, 'e' || event_id % 50 AS element, max_by(event_type, event_id) AS value, max(event_id) AS seq FROM events WHERE event_id <= 1000 GROUP BY 1, 2),
  l AS (SELECT 'user:' || user_id AS key, 'e' || event_id % 50 AS element, event_type AS value, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'drop' WHEN event_id % 7 = 0 THEN 'delete' ELSE 'put' END AS op FROM events WHERE event_id > 1000),
  b AS (SELECT *, 'put' AS op FROM s UNION ALL SELECT * FROM l WHERE op <> 'drop'), d AS (SELECT key, max(seq) AS dropped FROM l WHERE op = 'drop' GROUP BY 1),
  w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY key, element ORDER BY seq DESC) = 1) SELECT w.key, element, value, seq FROM w LEFT JOIN d USING (key) WHERE op = 'put' AND (dropped IS NULL OR seq > dropped)""")
def snapshot_recovery(s, d):
    """A snapshot of collections with the log's later commands redone."""
    n = C("event_id")
    e = T(s, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("key"), F.concat(F.lit("e"), n % 50).alias("element"), C("event_type").alias("value"), n.alias("seq"), F.when(n % 97 == 0, "drop").when(n % 7 == 0, "delete").otherwise("put").alias("op"))
    before = e.where("seq <= 1000").groupBy("key", "element").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return commands.recover_elements(before, e, 1000)

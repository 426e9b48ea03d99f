"""Ordered element trees, many keys at once.

Elements are rows (key, bkey, eflag, value), unique by (key, bkey). A range a..b is inclusive and read downwards if a > b. Range predicates stand
below the windows, so they reach the scan; per-key limits are row numbers, which Spark cuts off before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyfold.functions.bytes import within_range


def in_range(a: object, b: object, bkey: Column | None = None) -> Column:
    bkey = F.col("bkey") if bkey is None else bkey
    lo, hi = (a, b) if a <= b else (b, a)
    return bkey.between(F.lit(lo), F.lit(hi))


def _order(a: object, b: object) -> Column:
    return F.asc("bkey") if a <= b else F.desc("bkey")


def get(elements: DataFrame, a: object, b: object, offset: int = 0, count: int = 0, efilter: Column | None = None) -> DataFrame:
    """Per key: elements of the range that pass the filter, without the first ``offset``, at most ``count`` (0: all); ``rank`` from 1 in range order."""
    found = elements.where(in_range(a, b))
    if efilter is not None:
        found = found.where(efilter)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(_order(a, b))))
    if count:
        found = found.where(F.col("rank") <= offset + count)
    return found.where(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset) if offset else found


def count(keys: DataFrame, elements: DataFrame, a: object, b: object, efilter: Column | None = None) -> DataFrame:
    """key, n for every row of ``keys``: 0 without elements. Counting combines before the shuffle."""
    found = elements.where(in_range(a, b))
    if efilter is not None:
        found = found.where(efilter)
    n = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.select("key").join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def delete(elements: DataFrame, a: object, b: object, efilter: Column | None = None, count: int = 0) -> DataFrame:
    """What is left after deleting, per key, the first ``count`` matches (0: all) in range order."""
    match = in_range(a, b) if efilter is None else in_range(a, b) & efilter
    match = F.coalesce(match, F.lit(False))
    if not count:
        return elements.where(~match)
    order = Window.partitionBy("key").orderBy(F.desc("_m"), _order(a, b))
    ranked = elements.withColumn("_m", match).withColumn("_r", F.row_number().over(order))
    return ranked.where(~(F.col("_m") & (F.col("_r") <= count))).drop("_m", "_r")


def ranked(elements: DataFrame, descending: bool = False, name: str = "position") -> DataFrame:
    order = F.desc("bkey") if descending else F.asc("bkey")
    return elements.withColumn(name, F.row_number().over(Window.partitionBy("key").orderBy(order)) - 1)


def position(elements: DataFrame, asked: DataFrame, descending: bool = False) -> DataFrame:
    """The rank from 0 of each asked (key, bkey), however often it is asked; missing ones have none. Trees without a question are left out before the ranks."""
    asked = asked.select("key", "bkey").distinct()
    some = elements.select("key", "bkey").join(asked.select("key").distinct(), "key", "left_semi")
    return ranked(some, descending).join(asked, ["key", "bkey"], "left_semi").select("key", "bkey", F.col("position").cast("long").alias("position"))


def get_by_position(elements: DataFrame, p: int, q: int, descending: bool = False) -> DataFrame:
    """Per key: elements of ranks p..q (from 0, cut at the end; read backwards if p > q), with ``position`` and ``rank`` from 1 in the order read."""
    lo, hi = min(p, q), max(p, q)
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("bkey") if descending else F.asc("bkey")))
    found = elements.withColumn("_r", first).where((F.col("_r") <= hi + 1) & (F.col("_r") > lo)).withColumn("position", F.col("_r") - 1).drop("_r")
    order = F.asc("position") if p <= q else F.desc("position")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(order)))


def position_with_get(elements: DataFrame, asked: DataFrame, n: int, descending: bool = False) -> DataFrame:
    """For each asked (key, bkey) that is there: the elements at most ``n`` ranks away, with ``position`` and ``index`` (the asked one's place among them).

    Each asked element names the 2 n + 1 ranks around it, which are looked up; elements of a key don't meet each other otherwise.
    """
    ranks = ranked(elements, descending)
    at = ranks.join(asked.select("key", "bkey").distinct(), ["key", "bkey"], "left_semi").select("key", F.col("bkey").alias("asked"), F.col("position").alias("at"))
    near = at.withColumn("position", F.explode(F.sequence(F.greatest(F.col("at") - F.lit(n), F.lit(0)), F.col("at") + F.lit(n))))
    return ranks.join(near, ["key", "position"]).withColumn("index", F.least("at", F.lit(n))).drop("at")


def mget(items: DataFrame, elements: DataFrame, keys: DataFrame, a: object, b: object, offset: int, count: int, efilter: Column | None = None) -> DataFrame:
    """pos, key, status, and the rows of each key that has some: the same range read over a list of keys (pos, key) that may repeat one.

    Statuses are those of ``read_status`` for each key, with OK for a full read. ``items``: key, type, readable, ovflaction, trimmed.
    """
    asked = keys.select("key").distinct()
    some = elements.join(asked, "key", "left_semi")
    requests = asked.select(F.col("key").alias("req"), "key", F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(offset).alias("offset"), F.lit(count).alias("count"))
    lo, hi = (a, b) if a <= b else (b, a)
    between = in_range(a, b) & (F.col("bkey") != F.lit(hi if a <= b else lo))
    matches = in_range(a, b) if efilter is None else in_range(a, b) & efilter
    # one range for all keys: a combining aggregate counts what read_status needs, and no tree is sorted for it
    known = some.groupBy("key").agg(*_sizes(), F.count_if(matches).alias("matches"), F.count_if(between).alias("between"))
    status = _ruled(eligibility(requests, items, known, also=("ovflaction", "trimmed"))).select("key", F.when(F.col("status") == "END", "OK").otherwise(F.col("status")).alias("status"))
    rows = get(some, a, b, offset, count, efilter)
    joined = keys.join(status, "key").join(rows, "key", "left")
    has = F.col("status").isin("OK", "TRIMMED")
    return joined.where(has | F.col("rank").isNull() | (F.col("rank") == 1)).withColumns({c: F.when(has, F.col(c)) for c in ("rank", "bkey", "value")})


# ---- reads with a status for each request


def _sizes() -> list[Column]:
    return [F.count(F.lit(1)).alias("ccnt"), F.min("bkey").alias("least"), F.max("bkey").alias("most")]


def eligibility(requests: DataFrame, items: DataFrame, sizes: DataFrame, counting: bool = False, kind: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` with ``status``, the first failing test: NOT_FOUND, TYPE_MISMATCH, UNREADABLE, NOT_FOUND_ELEMENT (empty, or offset at its end), BKEY_MISMATCH, else OK.

    ``items``: key, type, readable, and bkeytype (``number``, ``binary`` or null for a tree that never had one) where ``kind`` says which of them is asked for; ``sizes``: key, ccnt.
    Counting doesn't mind an empty tree. More columns of ``sizes``, and those of ``items`` named in ``also``, stay.
    """
    known = requests.join(items.select("key", "type", "readable", (F.col("bkeytype") if kind else F.lit(None).cast("string")).alias("bkeytype"), *also), "key", "left").join(sizes, "key", "left")
    ccnt = F.coalesce("ccnt", F.lit(0))
    empty = F.lit(False) if counting else (ccnt == 0) | (F.coalesce("offset", F.lit(0)) >= ccnt) & (ccnt >= 0)
    other = F.coalesce(F.col("bkeytype") != F.lit(kind), F.lit(False))
    status = F.when(F.col("type").isNull(), "NOT_FOUND").when(F.col("type") != "btree", "TYPE_MISMATCH").when(~F.col("readable"), "UNREADABLE").when(empty, "NOT_FOUND_ELEMENT").when(other, "BKEY_MISMATCH").otherwise("OK")
    return known.withColumn("status", status).drop("type", "readable", "ccnt", "bkeytype")


def _counts(requests: DataFrame, elements: DataFrame, efilter: Column | None) -> DataFrame:
    """req, matches, between of each range: running counts of its tree at the range's two ends, before and behind the elements equal to them. Requests never meet
    elements one by one."""
    own = elements.join(requests.select("key").distinct(), "key", "left_semi")
    rows = own.select("key", "bkey", F.lit(1).alias("ord"), F.lit(1).alias("one"), (F.lit(1) if efilter is None else F.coalesce(efilter, F.lit(False)).cast("int")).alias("passed"), F.lit(None).cast(requests.schema["req"].dataType).alias("req"), F.lit(None).cast("string").alias("what"))
    up = F.col("a") <= F.col("b")
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    # elements between the edge and the start, the start included
    ends = [(lo, 0, "lo"), (hi, 2, "hi"), (F.when(up, lo).otherwise(hi), F.when(up, 0).otherwise(2), "start"), (F.when(up, hi).otherwise(lo), F.when(up, 0).otherwise(2), "end")]
    ends = F.array(*(F.struct(at.cast(elements.schema["bkey"].dataType).alias("bkey"), (F.lit(o) if isinstance(o, int) else o).alias("ord"), F.lit(w).alias("what")) for at, o, w in ends))
    marks = requests.select("key", "req", F.explode(ends).alias("x")).select("key", "x.bkey", "x.ord", F.lit(0).alias("one"), F.lit(0).alias("passed"), "req", "x.what")
    upto = Window.partitionBy("key").orderBy("bkey", "ord").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(marks).select("req", "what", F.sum("one").over(upto).alias("n"), F.sum("passed").over(upto).alias("p")).where("req IS NOT NULL")
    at = {w: F.max(F.when(F.col("what") == w, F.col("p" if w in ("lo", "hi") else "n"))) for w in ("lo", "hi", "start", "end")}
    return met.groupBy("req").agg((at["hi"] - at["lo"]).alias("matches"), F.abs(at["end"] - at["start"]).alias("between"))


def read_status(requests: DataFrame, items: DataFrame, elements: DataFrame, efilter: Column | None = None, kind: str | None = None) -> DataFrame:
    """req, key, a, b, offset, count, n (rows returned), status of each range read, with the trim rule.

    A tree that has dropped elements at an edge can't vouch for what lies beyond it. A read that runs over that edge is TRIMMED if it returns rows, else OUT_OF_RANGE. It does
    not run over the edge if its limit stops it before, or its end is the edge; but the first element met is never compared with the
    end, so if that is the edge itself and the start is no element, the read still runs over it.
    """
    state = eligibility(requests, items, elements.groupBy("key").agg(*_sizes()), kind=kind, also=("ovflaction", "trimmed"))
    n = _counts(state.where("status = 'OK'"), elements, efilter)
    return _ruled(state.join(n, "req", "left"))


def _ruled(s: DataFrame) -> DataFrame:
    """The result of ``read_status`` from eligible requests with least, most, ovflaction, trimmed, matches and between."""
    matches, between = F.coalesce("matches", F.lit(0)), F.coalesce("between", F.lit(0))
    stopped = (F.col("count") > 0) & (matches - F.col("offset") >= F.col("count"))
    a, b, least, most = (F.col(c) for c in ("a", "b", "least", "most"))
    up, single = a < b, a == b
    low = F.when(single | up, a < least).otherwise((a < least) | (((b < least) | ((b == least) & (between == 0))) & ~stopped))
    high = F.when(single | (a > b), a > most).otherwise((a > most) | (((b > most) | ((b == most) & (between == 0))) & ~stopped))
    over = F.coalesce(F.col("trimmed") & F.when(F.col("ovflaction") == "smallest_trim", low).when(F.col("ovflaction") == "largest_trim", high).otherwise(F.lit(False)), F.lit(False))
    rows = F.greatest(matches - F.col("offset"), F.lit(0))
    rows = F.when(F.col("count") > 0, F.least(rows, F.col("count"))).otherwise(rows)
    rows = F.when(F.col("status") == "OK", rows).otherwise(F.lit(0)).cast("long")
    status = F.when(F.col("status") != "OK", F.col("status")).when((rows > 0) & over, "TRIMMED").when(rows > 0, "END").when(over, "OUT_OF_RANGE").otherwise("NOT_FOUND_ELEMENT")
    return s.select("req", "key", "a", "b", "offset", "count", rows.alias("n"), status.alias("status"))


# ---- bounded trees, in closed form: logs of inserts (or of upserts) only, under attributes set before


def first_writes(log: DataFrame) -> DataFrame:
    """The first command of each (key, bkey) in a log (key, seq, bkey, ...): what inserts leave in an unbounded tree."""
    rest = [c for c in log.columns if c not in ("key", "bkey")]
    return log.groupBy("key", "bkey").agg(F.min_by(F.struct(*rest), "seq").alias("_x")).select("key", "bkey", "_x.*")


def last_writes(log: DataFrame) -> DataFrame:
    """The last command of each (key, bkey): what upserts leave."""
    rest = [c for c in log.columns if c not in ("key", "bkey")]
    return log.groupBy("key", "bkey").agg(F.max_by(F.struct(*rest), "seq").alias("_x")).select("key", "bkey", "_x.*")


def bounded(writes: DataFrame, maxcount: int, ovflaction: str, maxrange: int | bytes | None = None) -> DataFrame:
    """The survivors of a tree that holds ``maxcount`` elements and spans ``maxrange`` at most. ``writes``: a row for each (key, bkey), with seq.

    smallest trims keep the highest keys, largest trims the lowest, error the first to come. The range bound (bytes for binary keys) counts from the edge that is kept;
    with ``error`` it depends on the order of commands, and so needs the fold.
    """
    action = ovflaction.replace("_silent", "")
    every = Window.partitionBy("key")
    if action == "error":
        if maxrange is not None:
            raise ValueError("a range bound with error needs the fold")
        order = F.asc("seq")
    else:
        top = action == "smallest_trim"
        order = F.desc("bkey") if top else F.asc("bkey")
        if maxrange is not None:
            edge = F.max("bkey").over(every) if top else F.min("bkey").over(every)
            if isinstance(maxrange, bytes):
                kept = within_range(maxrange)("_e", "bkey") if top else within_range(maxrange)("bkey", "_e")
            else:
                kept = F.col("bkey") >= F.col("_e") - F.lit(maxrange) if top else F.col("bkey") <= F.col("_e") + F.lit(maxrange)
            writes = writes.withColumn("_e", edge).where(kept).drop("_e")
    return writes.withColumn("_r", F.row_number().over(every.orderBy(order))).where(F.col("_r") <= maxcount).drop("_r")


def trimmed_flag(writes: DataFrame, maxcount: int, ovflaction: str) -> DataFrame:
    """key, ccnt, trimmed without a range bound: trims mark the tree once it has seen more keys than it holds, unless silent."""
    n = writes.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    marks = F.lit(ovflaction in ("smallest_trim", "largest_trim"))
    return n.select("key", F.least("_n", F.lit(maxcount)).alias("ccnt"), (marks & (F.col("_n") > maxcount)).alias("trimmed"))


def edges(elements: DataFrame) -> DataFrame:
    """key, count, minbkey, maxbkey."""
    return elements.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("bkey").alias("minbkey"), F.max("bkey").alias("maxbkey"))


def insert_statuses(log: DataFrame, maxcount: int) -> DataFrame:
    """key, seq, status of a log of inserts (key, seq, bkey) into trees that answer errors when full: existence is decided before the bound."""
    first = log.groupBy("key", "bkey").agg(F.min("seq").alias("_f"))
    first = first.withColumn("_kept", F.row_number().over(Window.partitionBy("key").orderBy("_f")) <= maxcount)
    status = F.when(~F.col("_kept"), "OVERFLOWED").when(F.col("seq") == F.col("_f"), "STORED").otherwise("ELEMENT_EXISTS")
    return log.join(first, ["key", "bkey"]).select("key", "seq", status.alias("status"))


def insert_each(elements: DataFrame, inserts: DataFrame, maxcount: int, ovflaction: str) -> DataFrame:
    """key, bkey, status, trimmed_bkey, trimmed_value of one insert a key (key, bkey) into its tree (at most ``maxcount`` elements): the getrim form, which returns what a full tree evicts.

    STORED; ELEMENT_EXISTS, before the bound; OVERFLOWED (error); OUT_OF_RANGE (the new element would be the one to go). Edges come from one combining aggregate.
    """
    small, large = ovflaction.startswith("smallest"), ovflaction.startswith("largest")
    gone = F.min_by if small else F.max_by
    edge = elements.join(inserts.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("bkey").alias("_lo"), F.max("bkey").alias("_hi"), gone(F.struct("bkey", "value"), "bkey").alias("_x"))
    there = elements.select("key", "bkey", F.lit(True).alias("_there"))
    known = inserts.select("key", "bkey").join(edge, "key", "left").join(there, ["key", "bkey"], "left")
    full = F.coalesce(F.col("_n") >= maxcount, F.lit(False))
    out = full & (F.lit(small) & (F.col("bkey") < F.col("_lo")) | F.lit(large) & (F.col("bkey") > F.col("_hi")))
    status = F.when(F.col("_there"), "ELEMENT_EXISTS").when(full & F.lit(not (small or large)), "OVERFLOWED").when(out, "OUT_OF_RANGE").otherwise("STORED")
    evicts = full & (status == "STORED") & F.lit("silent" not in ovflaction)
    return known.select("key", "bkey", status.alias("status"), F.when(evicts, F.col("_x.bkey")).alias("trimmed_bkey"), F.when(evicts, F.col("_x.value")).alias("trimmed_value"))


def visits(elements: DataFrame, a: object, b: object, offset: int = 0, count: int = 0, efilter: Column | None = None) -> DataFrame:
    """key, cost: how many elements a range read visits in each tree: those that its filter refuses too, up to the last one that it returns."""
    order = Window.partitionBy("key").orderBy(_order(a, b)).rowsBetween(Window.unboundedPreceding, 0)
    passed = F.lit(1) if efilter is None else F.coalesce(efilter, F.lit(False)).cast("int")
    seen = elements.where(in_range(a, b)).select("key", F.sum(F.lit(1)).over(order).alias("_n"), F.sum(passed).over(order).alias("_p"))
    stop = F.min(F.when(F.col("_p") >= offset + count, F.col("_n"))) if count else F.lit(None).cast("long")
    return seen.groupBy("key").agg(F.coalesce(stop, F.max("_n")).alias("cost"))


def bulk_update(elements: DataFrame, updates: DataFrame) -> DataFrame:
    """``elements`` with the values of ``updates`` (key, bkey, value, and seq where an element has several: the last one holds) where they exist; updates of missing elements do nothing."""
    new = updates.groupBy("key", "bkey").agg(F.max_by(F.struct("value"), "seq" if "seq" in updates.columns else "value").alias("_v"))
    return elements.join(new, ["key", "bkey"], "left").withColumn("value", F.when(F.col("_v").isNotNull(), F.col("_v.value")).otherwise(F.col("value"))).drop("_v")


def missing_updates(elements: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that meet no element (NOT_FOUND_ELEMENT)."""
    return updates.join(elements.select("key", "bkey"), ["key", "bkey"], "left_anti")

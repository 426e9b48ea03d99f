"""A keyed store as a stream: command rows in, statuses out, trees kept as state by key, with expiry."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyfold.operators.fold import STATUSES, Tree

_STATE = "tree string"


def _dumped(t: Tree) -> str:
    return json.dumps([t.maxcount, t.action, t.maxrange, t.trimmed, t.keys, list(map(t.values.get, t.keys))])


def _loaded(text: str) -> Tree:
    maxcount, action, maxrange, trimmed, keys, values = json.loads(text)
    return Tree(maxcount, action, maxrange, trimmed, keys, dict(zip(keys, values, strict=True)))


def run_commands(commands: DataFrame, maxcount: int = 4000, action: str = "smallest_trim", ttl_ms: int | None = None) -> DataFrame:
    """key, seq, status of a stream of commands (``fold.COMMANDS``). With ``ttl_ms`` a key that nothing touches for so long is dropped.

    State is checkpointed by the query; a bounded tree a key, so it grows with the number of live keys only.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches).sort_values("seq", kind="stable")
        tree = _loaded(state.get[0]) if state.exists else Tree(maxcount, action)
        found = []
        for r in rows.itertuples():
            text = [None if x is None or x != x else x for x in (r.bkey, r.value, r.attr)]
            found.append(tree.run(r.op, None if text[0] is None else int(text[0]), text[1], text[2]))
        state.update((_dumped(tree),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "status": found})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return commands.groupBy("key").applyInPandasWithState(run, STATUSES, _STATE, "append", timeout)


def counters(log: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls by command and window of event time of a streaming log (ts, op); late rows beyond the watermark are dropped, as an insert below a retained edge is."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "op").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "op", "n")


def unique_members(members: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming sets: the first occurrence of each (key, value) within the watermark of ``ts``."""
    return members.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key", "value"])

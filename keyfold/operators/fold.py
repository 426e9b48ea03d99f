"""General folds: ordered commands of any kinds on keyed trees, for what has no closed form.

Closed forms in ``btree`` and ``kv`` are the fast path. Here each key's commands are taken in order by one small state machine, in a grouped
map; the same machine runs in the streaming store. A key's state is bounded by its maxcount.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from keyfold.model import DEFAULT_COUNT, MAX_COUNT

COMMANDS = "key string, seq long, op string, bkey long, value string, attr string"
STATUSES = "key string, seq long, status string"
STATE = "key string, bkey long, value string, trimmed boolean"


@dataclass
class Tree:
    """One tree under its attributes; ``run`` answers a command."""

    maxcount: int = 4000
    action: str = "smallest_trim"
    maxrange: int | None = None
    trimmed: bool = False
    keys: list[int] = field(default_factory=list)
    values: dict[int, str | None] = field(default_factory=dict)

    def run(self, op: str, bkey: int | None, value: str | None, attr: str | None = None) -> str:
        there = bkey in self.values if bkey is not None else False
        if op == "insert":
            return "ELEMENT_EXISTS" if there else self._store(bkey, value)
        if op == "upsert":
            if there:
                self.values[bkey] = value
                return "REPLACED"
            return self._store(bkey, value)
        if op == "update":
            if there:
                self.values[bkey] = value
            return "UPDATED" if there else "NOT_FOUND_ELEMENT"
        if op == "delete":
            if there:
                self._drop(bkey)
            return "DELETED" if there else "NOT_FOUND_ELEMENT"
        if op in ("incr", "decr"):
            return self._count(op, bkey, value, attr, there)
        if op == "setattr":
            return self._set(attr)
        return "CLIENT_ERROR"

    def _drop(self, bkey: int) -> None:
        self.keys.pop(bisect.bisect_left(self.keys, bkey))
        del self.values[bkey]

    def _store(self, bkey: int, value: str | None) -> str:
        if self.keys:
            lo, hi = self.keys[0], self.keys[-1]
            small, large = self.action.startswith("smallest"), self.action.startswith("largest")
            if self.maxrange is not None and max(hi, bkey) - min(lo, bkey) > self.maxrange:
                if not (bkey > hi and small or bkey < lo and large):
                    return "OUT_OF_RANGE"
                for k in [k for k in self.keys if abs(bkey - k) > self.maxrange]:
                    self._drop(k)
                self.trimmed = False
            elif len(self.keys) >= self.maxcount:
                if self.action == "error":
                    return "OVERFLOWED"
                silent = "silent" in self.action
                if small and bkey < lo or large and bkey > hi:
                    self.trimmed = self.trimmed or not silent
                    return "OUT_OF_RANGE"
                self._drop(lo if small else hi)
                self.trimmed = self.trimmed or not silent
        bisect.insort(self.keys, bkey)
        self.values[bkey] = value
        return "STORED"

    def _count(self, op: str, bkey: int, delta: str | None, initial: str | None, there: bool) -> str:
        if not there:
            if initial is None:
                return "NOT_FOUND_ELEMENT"
            stored = self._store(bkey, initial)
            return initial if stored == "STORED" else stored
        old = self.values[bkey]
        if not _digits(old) or int(old) >= 1 << 64 or not _digits(delta):
            return "CLIENT_ERROR cannot increment or decrement non-numeric value"
        new = (int(old) + int(delta)) % (1 << 64) if op == "incr" else max(int(old) - int(delta), 0)
        self.values[bkey] = str(new)
        return str(new)

    def _set(self, attr: str | None) -> str:
        name, _, value = (attr or "").partition("=")
        if name == "overflowaction":
            if value != self.action:
                self.action, self.trimmed = value, False
            return "OK"
        if name == "maxcount" and _digits(value.removeprefix("-")):
            most = DEFAULT_COUNT if int(value) == 0 else min(int(value), MAX_COUNT) if int(value) > 0 else MAX_COUNT
            if most < len(self.keys):
                return "ATTR_ERROR bad value"
            self.maxcount = most
            return "OK"
        if name == "maxbkeyrange" and _digits(value) and (not self.keys or self.keys[-1] - self.keys[0] <= int(value)):
            self.maxrange = int(value) or None
            return "OK"
        return "ATTR_ERROR bad value"


def _digits(x: str | None) -> bool:
    return bool(x) and x.isascii() and x.isdigit()


def _text(x: object) -> str | None:
    return None if x is None or x is pd.NA or x != x else str(x)


def _run(commands: pd.DataFrame, tree: Tree) -> list[str]:
    rows = commands.sort_values("seq", kind="stable")
    return [tree.run(op, None if b is None or b != b else int(b), _text(v), _text(a)) for op, b, v, a in zip(rows["op"], rows["bkey"], rows["value"], rows["attr"], strict=True)]


def statuses(commands: DataFrame, maxcount: int = 4000, action: str = "smallest_trim", maxrange: int | None = None) -> DataFrame:
    """key, seq, status of every command."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = _run(rows, Tree(maxcount, action, maxrange))
        rows = rows.sort_values("seq", kind="stable")
        return pd.DataFrame({"key": rows["key"], "seq": rows["seq"], "status": found})

    return commands.groupBy("key").applyInPandas(run, STATUSES)


def final_state(commands: DataFrame, maxcount: int = 4000, action: str = "smallest_trim", maxrange: int | None = None) -> DataFrame:
    """key, bkey, value, trimmed after all commands."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(maxcount, action, maxrange)
        _run(rows, tree)
        return pd.DataFrame({"key": [rows["key"].iloc[0]] * len(tree.keys), "bkey": tree.keys, "value": [tree.values[k] for k in tree.keys], "trimmed": [tree.trimmed] * len(tree.keys)})

    return commands.groupBy("key").applyInPandas(run, STATE)

"""Functions of keys: prefixes, validity, expiry times, glob patterns, unsigned numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_PREFIX = "<null>"
STICKY, NEVER = -1, 0
MONTH = 60 * 60 * 24 * 30
MAX_PREFIX = 250
UINT64 = 1 << 64
NUMBER = "decimal(38,0)"


def prefix_of(key: Column, delimiter: str = ":") -> Column:
    """What stands before the first delimiter; a delimiter at the very beginning is no delimiter. ``<null>``: none."""
    d = re.escape(delimiter)
    found = F.regexp_extract(key, f"(?s)^(.[^{d}]*){d}", 1)
    return F.when(key.isNull(), None).when(found == "", F.lit(NO_PREFIX)).otherwise(found)


def valid_prefix(prefix: Column) -> Column:
    """Letters, digits and ``_ - + .``, not led by ``-``, at most 250 of them."""
    return prefix.rlike(r"^[A-Za-z0-9_+.][A-Za-z0-9_+.-]*$") & (F.length(prefix) <= MAX_PREFIX)


def absolute_expiry(exptime: Column, now: Column) -> Column:
    """Epoch second of expiry: -1 stays (sticky), 0 stays (never), up to 30 days is from now on, more is a date; a date gone by expires at once."""
    return F.when(exptime.isNull() | exptime.isin(STICKY, NEVER), exptime).when(exptime < 0, now).when(exptime <= MONTH, now + exptime).otherwise(F.greatest(exptime, now))


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for ``* ? \\``. A backslash takes the next character as it is; at most 64 characters and four stars."""
    if len(glob) > 64 or re.search(r"(?<!\\)(\\\\)*\\$", glob):
        raise ValueError("bad pattern")
    out, i, stars = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\":
            i += 1
            out += re.escape(glob[i])
        elif c == "*":
            stars += 1
            out += ".*"
        else:
            out += "." if c == "?" else re.escape(c)
        i += 1
    if stars > 4:
        raise ValueError("too many stars")
    return f"(?s)^{out}$"


def matches(key: Column, glob: str) -> Column:
    return key.rlike(glob_pattern(glob))


def unsigned(text: Column) -> Column:
    """An ASCII unsigned 64-bit number as decimal(38,0); null for anything else."""
    value = F.regexp_extract(text.cast("string"), r"^\s*\+?(\d{1,20})(\s|$)", 1)
    number = F.when(value != "", value).try_cast(NUMBER)
    return F.when(number < F.lit(str(UINT64)).cast(NUMBER), number)


def incremented(value: Column, delta: Column) -> Column:
    """Sum modulo 2**64 of decimals."""
    return ((value + delta) % F.lit(str(UINT64)).cast(NUMBER)).cast(NUMBER)


def decremented(value: Column, delta: Column) -> Column:
    """Difference, 0 at least."""
    return F.greatest(value - delta, F.lit(0).cast(NUMBER)).cast(NUMBER)

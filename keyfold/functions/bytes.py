"""Byte-string functions: hex codec, bitwise operators, element-flag filters and updates, differences of binary keys.

Element flags and binary element keys are ``BinaryType``. Spark compares binaries byte by byte as unsigned, and a longer one is greater
than its own prefix, which is the order that binary keys have.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 31
OPERATORS = ("AND", "OR", "XOR")
COMPARISONS = ("EQ", "NE", "LT", "LE", "GT", "GE")


def from_hex(text: Column) -> Column:
    """Bytes of ``0x`` and an even number of hex digits in either case, 1 to 31 bytes; null for anything else."""
    return F.when(text.rlike(r"^0x([0-9A-Fa-f]{2}){1,31}$"), F.unhex(F.substring(text, 3, 2 * MAX_BYTES)))


def to_hex(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(value))


def _byte(value: Column, i: Column | int) -> Column:
    return F.conv(F.hex(F.substring(value, i + 1 if isinstance(i, int) else i + F.lit(1), 1)), 16, 10).cast("int")


def bitwise(value: Column, operator: str, operand: bytes) -> Column:
    """``value`` combined with ``operand`` byte by byte; as long as the operand, at most 31 bytes."""
    if operator not in OPERATORS:
        raise ValueError(operator)
    out = []
    for i, b in enumerate(operand):
        x, y = _byte(value, i), F.lit(b)
        z = x.bitwiseAND(y) if operator == "AND" else x.bitwiseOR(y) if operator == "OR" else x.bitwiseXOR(y)
        out.append(F.lpad(F.hex(z.cast("long")), 2, "0"))
    return F.unhex(F.concat(*out))


def compare(value: Column, comparison: str, *values: bytes) -> Column:
    """EQ and NE take up to 100 values (in, not in), the others one."""
    if comparison not in COMPARISONS or not values or len(values) > (100 if comparison in ("EQ", "NE") else 1):
        raise ValueError(comparison)
    if comparison == "EQ":
        return value.isin([bytearray(v) for v in values])
    if comparison == "NE":
        return ~value.isin([bytearray(v) for v in values])
    other = F.lit(bytearray(values[0]))
    return {"LT": value < other, "LE": value <= other, "GT": value > other, "GE": value >= other}[comparison]


def eflag_filter(eflag: Column, comparison: str, values: Sequence[bytes], offset: int = 0, operator: str | None = None, operand: bytes | None = None) -> Column:
    """Whether the bytes of ``eflag`` from ``offset``, as many as a value has, pass. Flags too short for that pass NE only; an absent flag has no bytes."""
    size = len(values[0])
    if any(len(v) != size for v in values) or operator and len(operand or b"") != size:
        raise ValueError("values and operand must be equally long")
    part = F.substring(eflag, offset + 1, size)
    if operator:
        part = bitwise(part, operator, operand)
    short = F.coalesce(F.octet_length(eflag), F.lit(0)) < offset + size
    return F.when(short, F.lit(comparison == "NE")).otherwise(compare(part, comparison, *values))


def eflag_update(eflag: Column, operand: bytes, operator: str | None = None, offset: int = 0) -> Column:
    """The new flag: the operand itself, or the old flag with its bytes from ``offset`` combined. Null where those bytes don't all exist (a bad update)."""
    if operator is None:
        return F.lit(bytearray(operand))
    size = len(operand)
    inside = F.coalesce(F.octet_length(eflag), F.lit(0)) >= offset + size
    before, after = F.substring(eflag, 1, offset), F.substring(eflag, offset + size + 1, MAX_BYTES)
    return F.when(inside, F.concat(before, bitwise(F.substring(eflag, offset + 1, size), operator, operand), after))


def eflag_update_status(eflag: Column, operand: bytes, operator: str | None = None, offset: int = 0) -> Column:
    """OK, or EBADEFLAG where the bytes to combine don't all exist."""
    return F.when(eflag_update(eflag, operand, operator, offset).isNull(), "EBADEFLAG").otherwise("OK")


def padded_difference(high: bytes, low: bytes, size: int) -> int:
    """high - low as big-endian numbers of ``size`` bytes, padded with zero bytes to the right or cut."""
    return int.from_bytes(high[:size].ljust(size, b"\0"), "big") - int.from_bytes(low[:size].ljust(size, b"\0"), "big")


_LIMB = 7  # bytes that a long holds without its sign


def _limbs(value: Column, size: int) -> list[Column]:
    """Longs of _LIMB bytes each, most significant first, of a key's first ``size`` bytes, padded with zero bytes to the right."""
    width = 2 * _LIMB * -(-size // _LIMB)
    digits = F.lpad(F.rpad(F.hex(F.substring(value, 1, size)), 2 * size, "0"), width, "0")
    return [F.conv(F.substring(digits, 1 + at, 2 * _LIMB), 16, 10).cast("long") for at in range(0, width, 2 * _LIMB)]


def within_range(limit: bytes) -> Callable[[Column | str, Column | str], Column]:
    """A function (high, low) -> whether high - low is at most ``limit``, on binary keys: a subtraction in longs with borrows, then a comparison of the digits."""
    size = len(limit)

    def test(high: Column | str, low: Column | str) -> Column:
        x, y = (_limbs(F.col(c) if isinstance(c, str) else c, size) for c in (high, low))
        most = limit.rjust(len(x) * _LIMB, b"\0")
        borrow, digits = F.lit(0), []
        for a, b in zip(reversed(x), reversed(y), strict=True):
            d = a - b - borrow
            borrow = F.when(d < 0, 1).otherwise(0)
            digits.append(F.when(d < 0, d + F.lit(1 << 8 * _LIMB)).otherwise(d))
        wanted = [F.lit(int.from_bytes(most[i : i + _LIMB], "big")).cast("long") for i in range(0, len(most), _LIMB)]
        smaller = F.struct(*(d.alias(f"d{i}") for i, d in enumerate(reversed(digits)))) <= F.struct(*(w.alias(f"d{i}") for i, w in enumerate(wanted)))
        return (borrow == 1) | smaller

    return test

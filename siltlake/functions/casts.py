"""The cast matrix between atomic types, as Columns.

The results do not hang on the session's ANSI setting: whole numbers wrap where
the target is too small, decimals that overflow become null, and text that cannot
be read fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import atomic_name

BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
FLOATS = ("float", "double")
NUMBERS = (*BITS, *FLOATS)
TIMES = ("timestamp", "timestamp_ntz")
#: Words for true and false in text (fixed values).
TRUE, FALSE = ("t", "true", "y", "yes", "1"), ("f", "false", "n", "no", "0")


def supported() -> set[tuple[str, str]]:
    """(source, target) pairs of type names that can be cast."""
    pairs = {("boolean", t) for t in (*NUMBERS, "decimal", "string")}
    pairs |= {(a, b) for a in NUMBERS for b in NUMBERS}
    pairs |= {(a, "boolean") for a in BITS}
    pairs |= {("string", t) for t in ("boolean", *NUMBERS, "decimal", "binary", "date", *TIMES)}
    pairs |= {(a, "string") for a in (*NUMBERS, "decimal", "binary", "date", *TIMES)}
    pairs |= {(a, b) for a in NUMBERS for b in ("decimal",)} | {("decimal", b) for b in (*NUMBERS, "decimal")}
    pairs |= {("date", t) for t in TIMES} | {(t, "date") for t in TIMES} | {(a, b) for a in TIMES for b in TIMES}
    return pairs | {(a, t) for a in ("int", "bigint") for t in TIMES} | {(t, a) for a in ("int", "bigint") for t in TIMES}


def _wrap(whole: Column, bits: int) -> Column:
    """A whole number (decimal without scale) taken modulo 2**bits, as signed."""
    size, half = F.lit(str(1 << bits)).cast("decimal(38,0)"), F.lit(str(1 << (bits - 1))).cast("decimal(38,0)")
    w = whole.cast("decimal(38,0)")
    return F.pmod(w + half, size) - half


def _to_int(c: Column, source: str, target: str) -> Column:
    bits = BITS[target]
    if source in BITS:
        return c.cast(target) if BITS[source] <= bits else _wrap(c, bits).cast(target)
    if source == "decimal":
        toward_zero = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
        return _wrap(toward_zero, bits).cast(target)
    # floats truncate; past the range of the wide whole number they saturate, NaN is 0
    wide = 64 if bits == 64 else 32
    d = c.cast("double")
    low, high = -(2 ** (wide - 1)), 2 ** (wide - 1) - 1
    inside = F.when(F.isnan(d), 0).when(d >= float(2 ** (wide - 1)), high).when(d <= float(low), low)
    whole = inside.otherwise(F.when((d < float(2 ** (wide - 1))) & (d > float(low)), d).otherwise(0.0).cast("bigint"))
    whole = whole.cast("bigint")
    return F.when(c.isNotNull(), whole if bits == 64 else _wrap(whole, bits).cast(target))


def _sized(c: Column, source: T.DataType, target: T.DecimalType) -> Column:
    name = atomic_name(source)
    if name in FLOATS:
        odd = F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
        checked = F.when(odd, F.raise_error(F.lit("cannot cast NaN or Infinity to a decimal"))).otherwise(c)
        return checked.try_cast(target)
    return c.try_cast(target)


def _read(c: Column, target: T.DataType) -> Column:
    """Text to another type; fails on what cannot be read."""
    made = F.trim(c).try_cast(target)
    bad = F.raise_error(F.concat(F.lit(f"cannot cast text to {target.simpleString()}: "), c))
    return F.when(c.isNotNull() & made.isNull(), bad).otherwise(made)


def cast(c: Column, source: T.DataType, target: T.DataType, precision: int | None = None) -> Column:
    """``c`` of type ``source`` as ``target``. ``precision`` (0, 3, 6) truncates a timestamp."""
    if source == target and precision is None:
        return c
    a, b = atomic_name(source), atomic_name(target)
    if a != b and (a, b) not in supported():
        raise ValueError(f"no cast from {source.simpleString()} to {target.simpleString()}")
    if b in BITS and a in (*NUMBERS, "decimal"):
        return _to_int(c, a, b)
    if b == "decimal" and a not in ("string", "boolean"):
        return _sized(c, source, target)
    if a == "string" and b == "boolean":
        low = F.lower(F.trim(c))
        bad = F.raise_error(F.concat(F.lit("cannot cast text to boolean: "), c))
        return F.when(c.isNull(), None).when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).otherwise(bad)
    if a == "string" and b == "binary":
        return F.encode(c, "UTF-8")
    if a == "binary" and b == "string":
        return F.decode(c, "UTF-8")
    if a == "string" and b == "decimal":
        checked = F.when(c.isNotNull() & F.trim(c).try_cast("double").isNull(), F.raise_error(F.concat(F.lit("cannot cast text to decimal: "), c))).otherwise(F.trim(c))
        return checked.try_cast(target)
    if a == "string":
        return _read(c, target)
    if b in TIMES and a in ("int", "bigint"):
        at = F.timestamp_seconds(c.cast("bigint"))
        return at if b == "timestamp" else at.cast("timestamp_ntz")
    if a in TIMES and b in ("int", "bigint"):
        return _to_int(F.unix_seconds(c.cast("timestamp")), "bigint", b)
    if b in TIMES and a in TIMES:
        made = c.cast(target)
        unit = {0: "SECOND", 3: "MILLISECOND"}.get(precision)
        return made if unit is None else F.date_trunc(unit, made).cast(target)
    return c.cast(target)

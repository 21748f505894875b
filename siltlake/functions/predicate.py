"""Predicates over table columns: built, checked, split, turned into Columns,
and tested against file statistics.

Literals must have the column's own type; null literals are refused (use
``is_null``). A null field satisfies none but ``is_null``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import functools
import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import is_nested


@dataclass(frozen=True)
class Leaf:
    op: str
    field: str
    literals: tuple = ()


@dataclass(frozen=True)
class Compound:
    op: str
    children: tuple[Predicate, ...]


Predicate = Leaf | Compound

COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge,
    "starts_with": lambda c, v: c.startswith(v), "ends_with": lambda c, v: c.endswith(v), "contains": lambda c, v: c.contains(v),
}
_PYTHON = {
    T.BooleanType: bool, T.ByteType: int, T.ShortType: int, T.IntegerType: int, T.LongType: int, T.FloatType: float, T.DoubleType: float,
    T.StringType: str, T.BinaryType: (bytes, bytearray), T.DecimalType: decimal.Decimal, T.DateType: dt.date, T.TimestampType: dt.datetime, T.TimestampNTZType: dt.datetime,
}


def _leaf(op: str) -> Callable[..., Leaf]:
    return lambda field, *values: Leaf(op, field, tuple(values))


equal, not_equal, less_than, less_or_equal = _leaf("eq"), _leaf("ne"), _leaf("lt"), _leaf("le")
greater_than, greater_or_equal, is_null, is_not_null = _leaf("gt"), _leaf("ge"), _leaf("is_null"), _leaf("is_not_null")
starts_with, ends_with, contains = _leaf("starts_with"), _leaf("ends_with"), _leaf("contains")


def is_in(field: str, values: Iterable) -> Leaf:
    return Leaf("in", field, tuple(values))


def not_in(field: str, values: Iterable) -> Leaf:
    return Leaf("not_in", field, tuple(values))


def between(field: str, low: Any, high: Any) -> Compound:
    return and_(greater_or_equal(field, low), less_or_equal(field, high))


def _compound(op: str, children: tuple[Predicate, ...]) -> Compound:
    if not children:
        raise ValueError(f"{op} needs at least one predicate")
    flat = [g for c in children for g in (c.children if isinstance(c, Compound) and c.op == op else (c,))]
    return Compound(op, tuple(flat))


def and_(*children: Predicate) -> Compound:
    return _compound("and", children)


def or_(*children: Predicate) -> Compound:
    return _compound("or", children)


def fields(p: Predicate | None) -> set[str]:
    if p is None:
        return set()
    return {p.field} if isinstance(p, Leaf) else set().union(*map(fields, p.children))


def validate(p: Predicate, schema: T.StructType) -> None:
    """Fails unless every column exists, can be tested, and literals fit its type."""
    if isinstance(p, Compound):
        for c in p.children:
            validate(c, schema)
        return
    known = {f.name: f.dataType for f in schema.fields}
    if p.field not in known:
        raise ValueError(f"predicate on an unknown column: {p.field}")
    kind = known[p.field]
    if p.op in ("is_null", "is_not_null"):
        if p.literals:
            raise ValueError(f"{p.op} takes no literal")
        return
    if is_nested(kind):
        raise ValueError(f"predicate on a nested column: {p.field}")
    if not p.literals or (p.op not in ("in", "not_in") and len(p.literals) != 1):
        raise ValueError(f"{p.op} on {p.field} has a wrong number of literals")
    for v in p.literals:
        if v is None:
            raise ValueError(f"null literal for {p.field}; use is_null")
        want = _PYTHON[type(kind)]
        if not isinstance(v, want) or (isinstance(v, bool) and want is int) or (isinstance(v, dt.datetime) and want is dt.date):
            raise ValueError(f"literal {v!r} does not fit {p.field} {kind.simpleString()}")


def literal(v: Any, kind: T.DataType) -> Column:
    """A checked literal as a column of its kind; local times know no zone."""
    return F.lit(v.isoformat(sep=" ") if isinstance(kind, T.TimestampNTZType) else v).cast(kind)


def to_column(p: Predicate, schema: T.StructType, of: Callable[[str], Column] = lambda n: F.col(f"`{n}`")) -> Column:
    """The exact row filter."""
    if isinstance(p, Compound):
        parts = [to_column(c, schema, of) for c in p.children]
        return functools.reduce(operator.and_ if p.op == "and" else operator.or_, parts)
    c, kind = of(p.field), schema[p.field].dataType
    lit = [literal(v, kind) for v in p.literals]
    if p.op == "is_null":
        return c.isNull()
    if p.op == "is_not_null":
        return c.isNotNull()
    if p.op == "in":
        return c.isin(*lit)
    if p.op == "not_in":
        return ~c.isin(*lit)
    return COMPARE[p.op](c, lit[0])


def conjuncts(p: Predicate | None) -> list[Predicate]:
    if p is None:
        return []
    return [x for c in p.children for x in conjuncts(c)] if isinstance(p, Compound) and p.op == "and" else [p]


def pick(p: Predicate | None, keep: Callable[[set[str]], bool]) -> Predicate | None:
    """The conjunction of those conjuncts whose columns satisfy ``keep``."""
    got = [c for c in conjuncts(p) if keep(fields(c))]
    return None if not got else got[0] if len(got) == 1 else Compound("and", tuple(got))


def parse_literal(text: str | None, kind: T.DataType, default_name: str) -> Any:
    """A partition value given as text."""
    if text is None or text == default_name or text == "":
        return None
    if isinstance(kind, T.BooleanType):
        return text.strip().lower() in ("true", "t", "1", "yes", "y")
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(text)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return dt.datetime.fromisoformat(text)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(text)
    want = _PYTHON[type(kind)]
    return text if want is str else want(text) if not isinstance(want, tuple) else text.encode()


def partition_filter(specs: list[dict[str, str | None]], schema: T.StructType, default_name: str) -> Predicate | None:
    """OR over partition maps of ANDs of equalities; an empty map admits all."""
    if not specs or any(not s for s in specs):
        return None
    one = lambda k, v: is_null(k) if v is None else equal(k, v)
    parts = [and_(*[one(k, parse_literal(v, schema[k].dataType, default_name)) for k, v in s.items()]) for s in specs]
    return or_(*parts)


def may_match(p: Predicate, stats: dict[str, tuple[Any, Any, int | None]], rows: int) -> bool:
    """Whether a file may hold a match: stats has (min, max, nulls) by column,
    None where unknown. A column without stats may hold anything."""
    if isinstance(p, Compound):
        return (all if p.op == "and" else any)(may_match(c, stats, rows) for c in p.children)
    if p.field not in stats:
        return True
    low, high, nulls = stats[p.field]
    if p.op == "is_null":
        return nulls is None or nulls > 0
    if p.op == "is_not_null":
        return nulls is None or nulls < rows
    if nulls is not None and nulls == rows:
        return False
    if low is None or high is None:
        return True
    v = p.literals[0]
    try:
        if p.op == "in":
            return any(low <= x <= high for x in p.literals)
        if p.op == "not_in":
            return not (low == high and low in p.literals)
        if p.op == "starts_with":
            return low[: len(v)] <= v <= high[: len(v)]
        return {"eq": low <= v <= high, "ne": not low == high == v, "lt": low < v, "le": low <= v, "gt": high > v, "ge": high >= v}.get(p.op, True)
    except TypeError:
        return True


def bound_text(c: Column, kind: T.DataType) -> Column:
    """A bound as text that reads alike in every session: instants as microseconds."""
    return (F.unix_micros(c) if isinstance(kind, T.TimestampType) else c).cast("string")


def bound_of(text: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(text.try_cast("long")) if isinstance(kind, T.TimestampType) else text.try_cast(kind)


def parse_bound(text: str | None, kind: T.DataType) -> Any:
    """A bound on the driver; instants are microseconds."""
    if isinstance(kind, T.TimestampType):
        return None if text is None else int(text)
    return text if text is None or isinstance(kind, T.StringType) else parse_literal(text, kind, "")


def _micros(v: Any) -> Any:
    return round(v.replace(microsecond=0).timestamp()) * 1_000_000 + v.microsecond


def in_bounds(p: Predicate, schema: T.StructType) -> Predicate:
    """The predicate with instants as ``parse_bound`` gives them."""
    if isinstance(p, Compound):
        return Compound(p.op, tuple(in_bounds(c, schema) for c in p.children))
    return Leaf(p.op, p.field, tuple(map(_micros, p.literals))) if isinstance(schema[p.field].dataType, T.TimestampType) else p


def may_match_column(p: Predicate, schema: T.StructType, stats: Callable[[str], tuple[Column, Column, Column] | None]) -> Column:
    """``may_match`` over manifest rows: ``stats`` gives a column's least and
    greatest value and number of nulls in a file of ``row_count`` rows, or None
    where nothing is known. True where a match cannot be ruled out."""
    if isinstance(p, Compound):
        parts = [may_match_column(c, schema, stats) for c in p.children]
        return functools.reduce(operator.and_ if p.op == "and" else operator.or_, parts)
    if (known := stats(p.field)) is None:
        return F.lit(True)
    kind, (low, high, nulls), rows = schema[p.field].dataType, known, F.col("row_count")
    if p.op == "is_null":
        return F.coalesce(nulls > 0, F.lit(True))
    some = F.coalesce(nulls < rows, F.lit(True))
    if p.op == "is_not_null" or is_nested(kind) or isinstance(kind, T.BinaryType):
        return some
    v = [literal(x, kind) for x in p.literals]
    inside = lambda x: (low <= x) & (high >= x)
    tests = {
        "eq": lambda: inside(v[0]), "in": lambda: functools.reduce(operator.or_, map(inside, v)), "ne": lambda: ~((low == v[0]) & (high == v[0])),
        "lt": lambda: low < v[0], "le": lambda: low <= v[0], "gt": lambda: high > v[0], "ge": lambda: high >= v[0],
        "starts_with": lambda: (F.substring(low, F.lit(1), F.length(v[0])) <= v[0]) & (F.substring(high, F.lit(1), F.length(v[0])) >= v[0]),
    }
    return some & F.coalesce(tests[p.op](), F.lit(True)) if p.op in tests else some

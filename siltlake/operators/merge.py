"""Merge-on-read by primary key, as DataFrame plans.

A changelog holds the key and value columns, ``_SEQUENCE_NUMBER`` (long) and
``_VALUE_KIND`` (byte: 0 +I, 1 -U, 2 +U, 3 -D). Records of a key are ordered by
the user's sequence fields (null first, in either direction), then by sequence
number. A key with one record keeps it as it is, kind included.

Two plans give the same rows. Where the outcome of a key does not hang on the
steps between its records it is one ``groupBy`` with partial aggregation before
the shuffle. Partial updates with retracts, aggregates within sequence groups and
retracts of ``last`` values in descending order are an ordered fold of the key's
records, in an expression.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import BITS, _wrap

SEQ, KIND, ROW_ID = "_SEQUENCE_NUMBER", "_VALUE_KIND", "_ROW_ID"
INSERT, UPDATE_BEFORE, UPDATE_AFTER, DELETE = 0, 1, 2, 3
ENGINES = ("deduplicate", "first-row", "aggregation", "partial-update")
AGGREGATORS = ("sum", "min", "max", "bool_and", "bool_or", "last_value", "last_non_null_value", "first_value", "first_non_null_value", "primary-key")
#: Aggregators that can take a record back.
RETRACTABLE = ("sum", "last_value", "last_non_null_value", "primary-key")


@dataclass
class MergeSpec:
    keys: list[str]
    engine: str = "deduplicate"
    sequence: list[str] = field(default_factory=list)
    descending: bool = False
    ignore_delete: bool = False
    aggregators: dict[str, str] = field(default_factory=dict)
    default_aggregator: str | None = None
    ignore_retract: set[str] = field(default_factory=set)
    groups: dict[tuple[str, ...], list[str]] = field(default_factory=dict)
    remove_on_delete: bool = False
    remove_on_group: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        if self.engine not in ENGINES:
            raise ValueError(f"unknown merge engine {self.engine!r}")
        for name in (*self.aggregators.values(), *([self.default_aggregator] if self.default_aggregator else [])):
            if name not in AGGREGATORS:
                raise ValueError(f"unknown aggregator {name!r}")
        if self.engine == "partial-update":
            self._check_partial_update()

    def _check_partial_update(self) -> None:
        if self.remove_on_delete and self.ignore_delete:
            raise ValueError("remove-record-on-delete and ignore-delete exclude each other")
        if self.remove_on_delete and self.groups:
            raise ValueError("remove-record-on-delete does not go with sequence groups")
        grouped: list[str] = [f for g, fs in self.groups.items() for f in (*g, *fs)]
        if len(grouped) != len(set(grouped)):
            raise ValueError("a field is in two sequence groups")
        loose = [f for f, a in self.aggregators.items() if f not in grouped and a != "last_non_null_value" and f not in self.keys]
        if loose:
            raise ValueError(f"an aggregator needs a sequence group: {loose}")
        if not self.remove_on_group <= {f for g in self.groups for f in g}:
            raise ValueError("remove-record-on-sequence-group names a field that orders no group")

    def aggregator(self, name: str) -> str:
        """The aggregation engine's choice for a field."""
        if name in self.sequence:
            return "last_value"
        if name in self.keys:
            return "primary-key"
        return self.aggregators.get(name) or self.default_aggregator or "last_non_null_value"

    def group_of(self, name: str) -> tuple[str, ...] | None:
        return next((g for g, fs in self.groups.items() if name in g or name in fs), None)


def _retract(kind: Column) -> Column:
    return kind.isin(UPDATE_BEFORE, DELETE)


def _order(spec: MergeSpec) -> Column:
    """Ascending order of records: nulls are smallest in a struct. One number where
    that is enough, so that maxima over it are kept by hash."""
    return F.struct(*[F.col(f"`{s}`") for s in spec.sequence], F.col(SEQ)) if spec.sequence else F.col(SEQ)


def _compare(a: Column, b: Column, spec: MergeSpec) -> Column:
    """Order of two records for ``array_sort``, null first in either direction."""
    out: Column | None = None
    for name in reversed([*spec.sequence, SEQ]):
        x, y, flip = a[name], b[name], spec.descending and name != SEQ
        less, more = (x > y, x < y) if flip else (x < y, x > y)
        step = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(less, -1).when(more, 1)
        out = step.otherwise(F.lit(0) if out is None else out)
    return out


def _values(df: DataFrame, spec: MergeSpec) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in (*spec.keys, SEQ, KIND)]


def merge(df: DataFrame, spec: MergeSpec, drop_deletes: bool = True) -> DataFrame:
    """Latest state of each key: keys, values, ``_SEQUENCE_NUMBER`` and
    ``_VALUE_KIND`` of the outcome, deletions left out unless asked for."""
    if spec.ignore_delete:
        # a key whose only record is a retract keeps it, and is dropped below
        df = df.filter(~_retract(F.col(KIND)))
    columns = df.columns
    if spec.engine in ("deduplicate", "first-row"):
        out = _pick(df, spec)
    elif _needs_fold(df, spec):
        out = _fold(df, spec)
    else:
        out = _aggregate(df, spec, drop_deletes)
    out = out.select(*[F.col(f"`{c}`") for c in columns])
    return out.filter(~_retract(F.col(KIND))) if drop_deletes else out


def _pick(df: DataFrame, spec: MergeSpec) -> DataFrame:
    """The last (deduplicate) or first (first-row) whole record of each key: a row
    number of one, of which Spark keeps only the best in each task before a shuffle."""
    first, key = spec.engine == "first-row", Window.partitionBy(*[F.col(f"`{k}`") for k in spec.keys])
    if first:
        order = [F.col(SEQ).asc()]
        if not spec.ignore_delete:
            df = df.withColumn("__n", F.count("*").over(key)).withColumn("__retract", F.max(_retract(F.col(KIND))).over(key))
    else:
        # null is smallest in either direction
        order = [F.col(f"`{s}`").asc_nulls_last() if spec.descending else F.col(f"`{s}`").desc_nulls_last() for s in spec.sequence]
        order.append(F.col(SEQ).desc())
    got = df.withColumn("__place", F.row_number().over(key.orderBy(*order))).filter("__place = 1").drop("__place")
    if "__n" in got.columns:
        bad = F.raise_error(F.lit("first-row cannot take a retract; set ignore-delete")).cast("byte")
        got = got.withColumn(KIND, F.when((F.col("__n") > 1) & F.col("__retract"), bad).otherwise(F.col(KIND))).drop("__n", "__retract")
    return got


def _needs_fold(df: DataFrame, spec: MergeSpec) -> bool:
    if spec.engine == "aggregation":
        return spec.descending and bool(spec.sequence)
    if spec.descending and spec.sequence:
        return True
    aggregated = any(f in spec.aggregators for fs in spec.groups.values() for f in fs) or (spec.groups and spec.default_aggregator)
    retracts = not spec.ignore_delete and (spec.groups or spec.remove_on_delete or spec.remove_on_group)
    return bool(aggregated or retracts)


def wrap_to(total: Column, kind: T.DataType) -> Column:
    """A sum brought back to its input's type; whole numbers wrap."""
    name = kind.simpleString()
    return _wrap(total, BITS[name]).cast(kind) if name in BITS else total.try_cast(kind)


def _sum(x: Column, retract: Column, live: Column, kind: T.DataType) -> Column:
    """Sum of values, less those taken back. Whole numbers wrap as their type does:
    halves are summed apart and put together by their bits, as a long has no room
    for the sum and a decimal is slow."""
    signed = lambda v: F.when(live, F.when(retract, -v).otherwise(v))
    name = kind.simpleString()
    if name not in BITS:
        return F.sum(signed(x)).try_cast(kind)
    if name == "bigint":
        low_half = F.lit(0xFFFFFFFF).cast("long")
        high, low = F.sum(signed(F.shiftright(x, 32))), F.sum(signed(x.bitwiseAND(low_half)))
        return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(low_half))
    spare = 64 - BITS[name]
    return F.shiftright(F.shiftleft(F.sum(signed(x.cast("long"))), spare), spare).cast(kind)


def _simple(name: str, x: Column, kind: T.DataType, order: Column, retract: Column, skip: bool) -> Column:
    """One aggregator as an aggregate expression; ``skip`` ignores retracts."""
    live = ~retract if skip else F.lit(True)
    if name == "sum":
        return _sum(x, retract, live, kind)
    if name in ("min", "max", "bool_and", "bool_or"):
        agg = {"min": F.min, "max": F.max, "bool_and": F.bool_and, "bool_or": F.bool_or}[name]
        return agg(F.when(live, x))
    shown = F.when(~retract, x)
    if name in ("last_value", "primary-key"):
        return F.max_by(shown, F.when(live, order))
    if name == "last_non_null_value":
        return F.max_by(shown, F.when(live & x.isNotNull(), order))
    return F.min_by(x, F.when(live if name == "first_value" else live & x.isNotNull(), order))


def _aggregate(df: DataFrame, spec: MergeSpec, drop_deletes: bool) -> DataFrame:
    """Aggregation, and partial updates whose order can be had from a maximum.

    A key with one record keeps it as it is. Most aggregators give just that; the
    record's own value is carried only where they do not: for a lone retract that is
    asked for, and in sequence groups, whose fields may all be null."""
    retract, order = _retract(F.col(KIND)), _order(spec)
    values, aggs, strict, apart = _values(df, spec), [], [], set()
    for f in values:
        x = F.col(f"`{f.name}`")
        if spec.engine == "aggregation":
            name, skip = spec.aggregator(f.name), f.name in spec.ignore_retract
            aggs.append(_simple(name, x, f.dataType, order, retract, skip))
            if name not in RETRACTABLE and not skip:
                strict.append(f.name)
            if not drop_deletes:
                apart.add(f.name)
        elif group := spec.group_of(f.name):
            seqs = [F.col(f"`{g}`") for g in group]
            known = functools.reduce(lambda a, b: a | b, [s.isNotNull() for s in seqs])
            aggs.append(F.max_by(x, F.when(known, F.struct(*seqs, order.alias("__o")))))
            apart.add(f.name)
        else:
            aggs.append(F.max_by(x, F.when(x.isNotNull(), order)))
    if spec.engine == "partial-update" and not spec.ignore_delete:
        strict = ["*"]
    own = [F.first(F.col(f"`{f.name}`")).alias(f"__own{i}") for i, f in enumerate(values) if f.name in apart]
    got = df.groupBy(*spec.keys).agg(
        *[a.alias(f"__v{i}") for i, a in enumerate(aggs)], *own, F.count("*").alias("__n"), F.max(retract).alias("__retract"),
        F.max(SEQ).alias("__seq"), F.first(KIND).alias("__kind"),
    )
    if strict:
        bad = F.raise_error(F.lit(f"a retract reached {'partial-update' if strict == ['*'] else strict} which cannot take it back"))
        got = got.withColumn("__n", F.when((F.col("__n") > 1) & F.col("__retract"), bad).otherwise(F.col("__n")))
    single = F.col("__n") == 1
    return got.select(
        *[F.col(f"`{k}`") for k in spec.keys],
        *[(F.when(single, F.col(f"__own{i}")).otherwise(F.col(f"__v{i}")) if f.name in apart else F.col(f"__v{i}")).alias(f.name) for i, f in enumerate(values)],
        F.col("__seq").alias(SEQ),
        F.when(single, F.col("__kind")).otherwise(F.lit(INSERT)).cast("byte").alias(KIND),
    )


def _agg(name: str, acc: Column, x: Column, kind: T.DataType) -> Column:
    """One step of an aggregator: the accumulator takes in a value."""
    if name == "sum":
        wide = lambda c: c.cast("decimal(38,0)") if kind.simpleString() in BITS else c
        return F.when(acc.isNull(), x).when(x.isNull(), acc).otherwise(wrap_to(wide(acc) + wide(x), kind))
    if name in ("min", "max"):
        return (F.least if name == "min" else F.greatest)(acc, x)
    if name in ("bool_and", "bool_or"):
        both = acc & x if name == "bool_and" else acc | x
        return F.when(acc.isNull(), x).when(x.isNull(), acc).otherwise(both)
    if name in ("last_value", "primary-key"):
        return x
    if name == "first_non_null_value":
        return F.coalesce(acc, x)
    return F.coalesce(x, acc)


def _take_back(name: str, acc: Column, x: Column, kind: T.DataType) -> Column:
    if name == "sum":
        wide = lambda c: c.cast("decimal(38,0)") if kind.simpleString() in BITS else c
        zero = F.lit(0).cast("decimal(38,0)") if kind.simpleString() in BITS else F.lit(0).cast(kind)
        return F.when(x.isNull(), acc).otherwise(wrap_to(F.coalesce(wide(acc), zero) - wide(x), kind))
    if name == "last_value":
        return F.lit(None).cast(kind)
    if name == "last_non_null_value":
        return F.when(x.isNotNull(), F.lit(None).cast(kind)).otherwise(acc)
    if name == "primary-key":
        return x
    return F.raise_error(F.lit(f"{name} cannot take a retract back")).cast(kind)


def _fold(df: DataFrame, spec: MergeSpec) -> DataFrame:
    """All records of a key in order, folded in one expression."""
    values = _values(df, spec)
    record = F.struct(*[F.col(f"`{f.name}`") for f in values], F.col(SEQ), F.col(KIND))
    ordered = F.array_sort(F.collect_list(record), lambda a, b: _compare(a, b, spec))
    got = df.groupBy(*spec.keys).agg(ordered.alias("__all"))
    start = F.struct(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in values], F.lit(False).alias("__gone"), *[F.lit(False).alias(f"__seen{i}") for i, _ in enumerate(values)]
    )
    step = _aggregation_step(spec, values) if spec.engine == "aggregation" else _partial_step(spec, values)
    state = F.aggregate("__all", start, step)
    one = F.get("__all", F.lit(0))
    single = F.size("__all") == 1
    return got.withColumn("__s", F.when(~single, state)).select(
        *[F.col(f"`{k}`") for k in spec.keys],
        *[F.when(single, one[f.name]).otherwise(F.col("__s")[f.name]).alias(f.name) for f in values],
        F.array_max(F.transform("__all", lambda r: r[SEQ])).alias(SEQ),
        F.when(single, one[KIND]).otherwise(F.when(F.col("__s")["__gone"], DELETE).otherwise(INSERT)).cast("byte").alias(KIND),
    )


def _made(values: list[T.StructField], new: dict[str, Column], gone: Column, seen: list[Column]) -> Column:
    return F.struct(*[new[f.name].cast(f.dataType).alias(f.name) for f in values], gone.alias("__gone"), *[s.alias(f"__seen{i}") for i, s in enumerate(seen)])


def _aggregation_step(spec: MergeSpec, values: list[T.StructField]) -> Callable[[Column, Column], Column]:
    def step(s: Column, r: Column) -> Column:
        retract, new, seen = _retract(r[KIND]), {}, []
        for i, f in enumerate(values):
            name, acc, x, was = spec.aggregator(f.name), s[f.name], r[f.name], s[f"__seen{i}"]
            added = F.when(was, acc).otherwise(x) if name == "first_value" else _agg(name, acc, x, f.dataType)
            back = acc if f.name in spec.ignore_retract else _take_back(name, acc, x, f.dataType)
            new[f.name] = F.when(retract, back).otherwise(added)
            seen.append(was | ~retract)
        return _made(values, new, F.lit(False), seen)

    return step


def _partial_step(spec: MergeSpec, values: list[T.StructField]) -> Callable[[Column, Column], Column]:
    kinds = {f.name: f.dataType for f in values}

    def newer(s: Column, r: Column, group: tuple[str, ...]) -> Column:
        """The record's sequence is at or after the state's: field by field, null first."""
        out: Column = F.lit(True)
        for g in reversed(group):
            x, y = r[g], s[g]
            out = F.when(x.isNull() & y.isNotNull(), False).when(y.isNull() & x.isNotNull(), True).when(x > y, True).when(x < y, False).otherwise(out)
        return out

    def step(s: Column, r: Column) -> Column:
        retract, seen = _retract(r[KIND]), [s[f"__seen{i}"] for i, _ in enumerate(values)]
        added: dict[str, Column] = {}
        back: dict[str, Column] = {}
        clear: Column = F.lit(False)
        for i, f in enumerate(values):
            n, acc, x, group = f.name, s[f.name], r[f.name], spec.group_of(f.name)
            if group is None:
                added[n], back[n] = F.coalesce(x, acc), acc
                continue
            known = functools.reduce(lambda a, b: a | b, [r[g].isNotNull() for g in group])
            later = newer(s, r, group)
            name = None if n in group else spec.aggregators.get(n) or spec.default_aggregator
            if n in group:
                added[n] = F.when(known & later, x).otherwise(acc)
                back[n] = added[n]
                if n in spec.remove_on_group:
                    clear = clear | (known & later & (r[KIND] == DELETE))
            elif name is None:
                added[n] = F.when(known & later, x).otherwise(acc)
                back[n] = F.when(known & later, F.lit(None).cast(f.dataType)).otherwise(acc)
            else:
                was = s[f"__seen{i}"]
                ahead = F.when(was, acc).otherwise(x) if name == "first_value" else _agg(name, acc, x, f.dataType)
                behind = x if name == "first_value" else F.when(was, acc).otherwise(x) if name == "last_value" else _agg(name, x, acc, f.dataType)
                added[n] = F.when(known & later, ahead).when(known, behind).otherwise(acc)
                undone = acc if n in spec.ignore_retract else _take_back(name, acc, x, f.dataType)
                back[n] = F.when(known, undone).otherwise(acc)
                seen[i] = was | (known & ~retract)
        gone = F.lit(False)
        if spec.groups:
            new = {n: F.when(retract, F.when(clear, F.lit(None).cast(kinds[n])).otherwise(back[n])).otherwise(added[n]) for n in added}
            gone = F.when(retract, s["__gone"] | clear).otherwise(False)
        elif spec.remove_on_delete:
            wipe = r[KIND] == DELETE
            new = {n: F.when(wipe, F.lit(None).cast(kinds[n])).when(retract, s[n]).otherwise(added[n]) for n in added}
            gone = F.when(wipe, True).when(retract, s["__gone"]).otherwise(False)
        else:
            bad = F.raise_error(F.lit("partial-update cannot take a retract; set ignore-delete or sequence groups"))
            new = {n: F.when(retract, bad.cast(kinds[n])).otherwise(added[n]) for n in added}
        return _made(values, new, gone, seen)

    return step

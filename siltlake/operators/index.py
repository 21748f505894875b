"""Indexes: of data files (bitmap, bit slices, bloom) and of row ids (inverted, and
inverted lists of vectors), and vector top-k.

An index is a Parquet table in the shared store, built and looked up by DataFrame
plans. It knows its column by field id and type: renamed columns keep their index,
others' are not used. What it finds names the files to scan, and the row filter stays
exact. Files and rows that no index covers are read whole, never lost.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicate as P
from ..sources.table import BROADCAST_FILES, Changes, LakeTable, Plan, _widens
from .merge import ROW_ID

#: Rows of a page: positions in it fit Spark's bitmaps.
PAGE = 1 << 15
#: Wanted share of false hits of a bloom filter (option ``file-index.bloom-filter.fpp``).
FALSE_HITS = 0.1
#: Leaf operators that an index answers by itself.
EXACT = {"bitmap": ("eq", "ne", "in", "not_in", "is_null", "is_not_null"), "bsi": ("eq", "ne", "in", "not_in", "lt", "le", "gt", "ge", "is_null", "is_not_null")}
KINDS = ("bitmap", "bsi", "bloom-filter")


def _usable(table: LakeTable, entry: dict, column: str) -> bool:
    f = table.schema.fields[column]
    was = T._parse_datatype_json_string(entry["type"]) if "type" in entry else None
    return entry.get("field_id") == f.metadata["field_id"] and (was == f.dataType or _widens(was, f.dataType))


def _entry(table: LakeTable, kind: str, column: str, name: str, **more) -> dict:
    f = table.schema.fields[column]
    return {"kind": kind, "field_id": f.metadata["field_id"], "type": f.dataType.json(), "path": name, **more}


def _covered(table: LakeTable, entry: dict) -> set[str]:
    """Keys of the files that an index has seen."""
    return {r["key"] for r in table.spark.read.parquet(f"{table.root}/{entry['path']}/files").select("key").collect()}


def _ordinal(c: Column, kind: T.DataType) -> Column:
    """Whole numbers, dates and timestamps as longs in the same order."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return _ntz_micros(c)
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return c.cast("long")
    raise ValueError(f"a range index takes whole numbers, dates and timestamps, not {kind.simpleString()}")


def _ntz_micros(c: Column) -> Column:
    """A local time as microseconds of itself, in any session zone."""
    days = F.unix_date(c.cast("date")).cast("long")
    second = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
    return days * 86_400_000_000 + second + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def ordinal_of(v, kind: T.DataType) -> int:
    """A literal's place in the order of ``_ordinal``."""
    if isinstance(kind, T.DateType):
        return (v - dt.date(1970, 1, 1)).days
    if isinstance(kind, T.TimestampType):
        return P._micros(v)
    if isinstance(kind, T.TimestampNTZType):
        return (v - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    return int(v)


def build_file_index(table: LakeTable, kind: str, column: str, **commit):
    """Index the live files of an append table on a column: ``bitmap``, ``bsi``
    (bit slices) or ``bloom-filter``."""
    if kind not in KINDS:
        raise ValueError(f"unknown index {kind!r}")
    plan, dtype = table.plan(), table.schema.fields[column].dataType
    name = f"index/{kind}-{uuid.uuid4().hex}"
    rows = table.positions(plan.files, [column]).withColumnRenamed(column, "value")
    page, place = F.floor(F.col("position") / PAGE).alias("page"), F.col("position") % PAGE
    more = {}
    if kind == "bitmap":
        # pages bound what one value of one file gathers
        made = rows.groupBy("key", "value", page).agg(F.collect_list(place.cast("int")).alias("positions"))
        made = made.repartitionByRange("value").sortWithinPartitions("value")
    elif kind == "bsi":
        x = _ordinal(F.col("value"), dtype)
        r = rows.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
        low, high = r["low"] or 0, r["high"] or 0
        if high - low >= 1 << 62:
            raise ValueError("values are too far apart for bit slices")
        bits, more = (high - low).bit_length(), {"low": low}
        part = lambda b: F.bitmap_construct_agg(F.when(F.shiftright(x - F.lit(low), b).bitwiseAND(F.lit(1)) == 1, place))
        made = rows.groupBy("key", page).agg(
            F.count("*").alias("rows"), F.bitmap_construct_agg(F.when(x.isNotNull(), place)).alias("present"), F.array(*map(part, range(bits))).cast("array<binary>").alias("slices")
        )
    else:
        rate = float(table.options.text("file-index.bloom-filter.fpp") or FALSE_HITS)
        per_item, probes = -math.log(rate) / math.log(2) ** 2, max(1, round(-math.log2(rate)))
        sizes = table.spark.createDataFrame([(f["key"], max(64, math.ceil(per_item * f["row_count"]))) for f in plan.files], "key string, size long")
        sizes, more = (F.broadcast(sizes) if len(plan.files) <= BROADCAST_FILES else sizes), {"probes": probes}
        bits = F.explode(F.array(*[_probe(F.col("value"), dtype, i, F.col("size")) for i in range(probes)])).alias("bit")
        set_ = rows.filter(F.col("value").isNotNull()).join(sizes, "key").select("key", "size", bits)
        made = set_.groupBy("key", "size", F.floor(F.col("bit") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % PAGE).alias("bits"))
    made.write.parquet(f"{table.root}/{name}/entries")
    table.spark.createDataFrame([(f["key"],) for f in plan.files], "key string").coalesce(1).write.parquet(f"{table.root}/{name}/files")
    return table.commit(Changes(indexes=[_entry(table, kind, column, name, **more)], schema_id=table.schema.id), **commit)


def _probe(value: Column, kind: T.DataType, i: int, size: Column) -> Column:
    """The i-th bit of a value; whole numbers of any width have the same."""
    same = value.cast("long") if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType) else value
    return F.pmod(F.xxhash64(same, F.lit(i)), size)


def _bloom_hits(table: LakeTable, entry: dict, leaf: P.Leaf) -> set[str]:
    """Keys of files that may hold the value: all of its bits are set."""
    kind = table.schema.fields[leaf.field].dataType
    df = table.spark.read.parquet(f"{table.root}/{entry['path']}/entries")
    found = []
    for i in range(entry["probes"]):
        bit = _probe(P.literal(leaf.literals[0], kind), kind, i, F.col("size"))
        at = (bit % PAGE).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        on = F.get(F.array(*[byte.bitwiseAND(F.lit(1 << k)) for k in range(8)]), at % 8) > 0
        found.append(((F.floor(bit / PAGE) == F.col("page")) & on).cast("int"))
    hits = df.select("key", functools.reduce(lambda a, b: a + b, found).alias("n")).filter("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"] for r in hits.filter(F.col("n") == entry["probes"]).select("key").collect()}


def slice_hits(op: str, values: list[int], low: int, rows: int, present: np.ndarray, slices: list[np.ndarray]) -> np.ndarray:
    """Mask of a page's rows by its bit slices: bits are compared from the highest
    down, all rows at a time."""
    if op in ("is_null", "is_not_null"):
        return ~present[:rows] if op == "is_null" else present[:rows]

    def compare(v: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows below the value, and equal to it."""
        x, n = v - low, len(slices)
        if x < 0 or x >> n:
            return (present.copy() if x >> n and x > 0 else np.zeros_like(present)), np.zeros_like(present)
        below, same = np.zeros_like(present), present.copy()
        for b in reversed(range(n)):
            if x >> b & 1:
                below |= same & ~slices[b]
                same &= slices[b]
            else:
                same &= ~slices[b]
        return below, same

    if op in ("in", "not_in"):
        hit = functools.reduce(np.logical_or, (compare(v)[1] for v in values))
        return (hit if op == "in" else present & ~hit)[:rows]
    below, same = compare(values[0])
    out = {"eq": same, "ne": present & ~same, "lt": below, "le": below | same, "gt": present & ~(below | same), "ge": present & ~below}[op]
    return out[:rows]


def _lookup(table: LakeTable, entry: dict, leaf: P.Leaf) -> DataFrame:
    """(key, position) that satisfy a leaf."""
    df, kind = table.spark.read.parquet(f"{table.root}/{entry['path']}/entries"), table.schema.fields[leaf.field].dataType
    if entry["kind"] == "bitmap":
        hit = df.filter(P.to_column(leaf, table.schema.fields, lambda _: F.col("value").cast(kind)))
        return hit.select("key", F.explode("positions").alias("p"), "page").select("key", (F.col("page") * PAGE + F.col("p")).alias("position"))
    values, low = [ordinal_of(v, kind) for v in leaf.literals], entry["low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").view(bool)
        for b in batches:
            for r in b.to_pylist():
                at = np.flatnonzero(slice_hits(leaf.op, values, low, r["rows"], bits(r["present"]), [bits(s) for s in r["slices"]]))
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(at), pa.string()), pa.array(r["page"] * PAGE + at, pa.int64())], names=["key", "position"])

    return df.select("key", "page", "rows", "present", "slices").mapInArrow(run, "key string, position long")


def select_positions(table: LakeTable, predicate: P.Predicate) -> tuple[DataFrame, set[str]] | None:
    """(key, position) of a superset of the matching rows, and the keys of the files
    for which this holds; None where the indexes do not restrict. OR needs both sides
    known, AND takes what is known."""
    last = table.snapshots.latest()
    entries = [e for e in (last.indexes if last else []) if e["kind"] in EXACT]
    meet = lambda a, b: (a[0].join(b[0], ["key", "position"], "left_semi"), a[1] & b[1])

    def walk(p: P.Predicate) -> tuple[DataFrame, set[str]] | None:
        if isinstance(p, P.Leaf):
            own = [e for e in entries if _usable(table, e, p.field) and p.op in EXACT[e["kind"]]]
            found = [(_lookup(table, e, p), _covered(table, e)) for e in own]
            # of two indexes of a column one is enough, unless they have seen different files
            found = [f for k, f in enumerate(found) if not any(f[1] <= g[1] for g in found[:k])]
            return functools.reduce(lambda a, b: (a[0].union(b[0]).distinct(), a[1] | b[1]), found) if found else None
        parts = [walk(c) for c in p.children]
        if p.op == "or":
            return None if any(x is None for x in parts) else functools.reduce(lambda a, b: (a[0].union(b[0]).distinct(), a[1] & b[1]), parts)
        known = [x for x in parts if x is not None]
        return functools.reduce(meet, known) if known else None

    return walk(predicate)


def files_that_may_match(table: LakeTable, predicate: P.Predicate, files: list) -> list:
    """Files that no index rules out: bloom filters for equalities joined by AND,
    then files in which the exact indexes find rows."""
    last, kept = table.snapshots.latest(), {f["key"] for f in files}
    for leaf in P.conjuncts(predicate):
        for e in last.indexes if last and isinstance(leaf, P.Leaf) and leaf.op == "eq" else []:
            if e["kind"] == "bloom-filter" and _usable(table, e, leaf.field):
                kept -= _covered(table, e) - _bloom_hits(table, e, leaf)
    chosen = select_positions(table, predicate) if kept else None
    if chosen is not None and (seen := chosen[1] & kept):
        kept -= seen - {r["key"] for r in chosen[0].select("key").distinct().collect()}
    return [f for f in files if f["key"] in kept]


def read_indexed(table: LakeTable, predicate: P.Predicate, columns: list[str] | None = None) -> DataFrame:
    """Rows that match: only files are scanned that the indexes do not rule out."""
    if table.has_keys or table.options.flag("data-evolution.enabled"):
        return table.read(columns, predicate)
    P.validate(predicate, table.schema.fields)
    plan = table.plan(predicate)
    plan.files = files_that_may_match(table, predicate, plan.files)
    return table.rows_of(plan).filter(P.to_column(predicate, table.schema.fields)).select(*(columns or table.schema.fields.names))


# ---- indexes over row ids


def _id_range(table: LakeTable, row_range: tuple[int, int] | None) -> tuple[int, int]:
    return row_range or (0, (table.snapshots.latest().next_row_id or 0) - 1)


def build_global_index(table: LakeTable, column: str, row_range: tuple[int, int] | None = None, **commit):
    """An inverted index, value to row id, over one range of row ids."""
    low, high = _id_range(table, row_range)
    rows = table.read([ROW_ID, column], row_ranges=[(low, high)])
    name = f"index/global-{uuid.uuid4().hex}"
    rows.select(F.col(column).alias("value"), ROW_ID).repartitionByRange("value").sortWithinPartitions("value").write.parquet(f"{table.root}/{name}")
    entry = _entry(table, "global", column, name) | {"from": low, "to": high}
    return table.commit(Changes(indexes=[entry], schema_id=table.schema.id), **commit)


def global_lookup(table: LakeTable, predicate: P.Predicate) -> tuple[DataFrame, list[tuple[int, int]]] | None:
    """Row ids that match in the indexed ranges, and the ranges that no index
    covers; None if the predicate cannot be told from indexes."""
    last = table.snapshots.latest()

    def walk(p: P.Predicate) -> tuple[DataFrame, list[tuple[int, int]]] | None:
        if isinstance(p, P.Leaf):
            shards = [e for e in last.indexes if e["kind"] == "global" and _usable(table, e, p.field)]
            if not shards:
                return None
            value, fields = lambda _: F.col("value").cast(fields[p.field].dataType), table.schema.fields
            hits = [table.spark.read.parquet(f"{table.root}/{e['path']}").filter(P.to_column(p, fields, value)).select(ROW_ID) for e in shards]
            return functools.reduce(DataFrame.union, hits).distinct(), [(e["from"], e["to"]) for e in shards]
        parts = [walk(c) for c in p.children]
        if p.op == "or" and any(x is None for x in parts):
            return None
        known = [x for x in parts if x is not None]
        if not known:
            return None
        join = (lambda a, b: a.union(b).distinct()) if p.op == "or" else (lambda a, b: a.join(b, ROW_ID, "left_semi"))
        covered = functools.reduce(_meet, [r for _, r in known])
        inside = [x.filter(functools.reduce(lambda a, b: a | b, [F.col(ROW_ID).between(lo, hi) for lo, hi in covered] or [F.lit(False)])) for x, _ in known]
        return functools.reduce(join, inside), covered

    found = walk(predicate)
    return None if found is None else (found[0], _gaps(found[1], (last.next_row_id or 0) - 1))


def _meet(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return sorted((max(x, u), min(y, v)) for x, y in a for u, v in b if max(x, u) <= min(y, v))


def _gaps(covered: list[tuple[int, int]], last: int) -> list[tuple[int, int]]:
    out, at = [], 0
    for lo, hi in sorted(covered):
        if lo > at:
            out.append((at, lo - 1))
        at = max(at, hi + 1)
    return [*out, (at, last)] if at <= last else out


def plan_global(table: LakeTable, predicate: P.Predicate) -> Plan:
    """The plan of a filtered scan, less the files in which no index finds a row."""
    plan, got = table.plan(predicate), global_lookup(table, predicate)
    if got is None or not plan.files:
        return plan
    ids, gaps = got
    spans = {f["first_row_id"]: f["first_row_id"] + f["row_count"] - 1 for f in plan.files}
    known = table.spark.createDataFrame(list(spans.items()), "__from long, __to long")
    known = F.broadcast(known) if len(spans) <= BROADCAST_FILES else known
    hit = {r["__from"] for r in ids.join(known, F.col(ROW_ID).between(F.col("__from"), F.col("__to"))).select("__from").distinct().collect()}
    hit |= {a for a, b in spans.items() if any(a <= hi and b >= lo for lo, hi in gaps)}
    plan.files = [f for f in plan.files if f["first_row_id"] in hit]
    return plan


def read_global(table: LakeTable, predicate: P.Predicate, columns: list[str] | None = None) -> DataFrame:
    """Matching rows: only files are scanned in which global indexes find rows, and
    those of ranges without an index."""
    P.validate(predicate, table.schema.fields)
    names = columns or table.schema.fields.names
    df = table.rows_of(plan_global(table, predicate), predicate, {*names, *P.fields(predicate)})
    return df.filter(P.to_column(predicate, table.schema.fields)).select(*names)


# ---- vectors

METRICS = ("l2", "inner_product", "cosine")
#: Rows that centres are fitted on, at most, and inverted lists.
SAMPLE, LISTS, STEPS = 8192, 1024, 10
PROBES = 8


def vector_topk(rows: DataFrame, vector: str, query: list[float], k: int, metric: str = "l2", prefilter: Column | None = None, id_col: str = ROW_ID) -> DataFrame:
    """The k rows nearest to a query vector, exactly, with ``_INDEX_SCORE``, in
    order of their ids. Candidates are kept per task before they meet."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(v, q, lambda x, y: x * y))
    norm = lambda a: F.sqrt(total(F.transform(a, lambda x: x * x)))
    score = {"l2": total(F.zip_with(v, q, lambda x, y: (x - y) * (x - y))), "inner_product": dot, "cosine": dot / (norm(v) * norm(q))}[metric]
    df = rows if prefilter is None else rows.filter(prefilter)
    df = df.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query))).withColumn("_INDEX_SCORE", score.cast("float")).withColumn("__d", score)
    best = F.col("__d").asc() if metric == "l2" else F.col("__d").desc()
    return df.orderBy(best, F.col(id_col)).limit(k).drop("__d").orderBy(id_col)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)


def _home(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def fit_centres(x: np.ndarray, lists: int, steps: int = STEPS) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; empty lists stay where they are."""
    centres = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(steps):
        home = _home(x, centres)
        count = np.bincount(home, minlength=lists)
        sums = np.stack([np.bincount(home, x[:, d], lists) for d in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def build_vector_index(table: LakeTable, column: str, lists: int | None = None, metric: str = "l2", row_range: tuple[int, int] | None = None, **commit):
    """Inverted lists over a range of row ids: centres are fitted on a bounded sample,
    every row goes to the list of its nearest one. Vectors of another width than the
    first sampled, and nulls, are in no list and never found."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    low, high = _id_range(table, row_range)
    rows = table.read([ROW_ID, column], row_ranges=[(low, high)]).select(ROW_ID, F.col(column).cast("array<double>").alias("v")).filter("v is not null")
    share = min(1.0, 2 * SAMPLE / max(1, high - low + 1))
    some = [r["v"] for r in (rows if share == 1 else rows.sample(share, 7)).limit(SAMPLE).collect()]
    if not some:
        raise ValueError("there are no vectors to index")
    width, turn = len(some[0]), _unit if metric == "cosine" else (lambda x: x)
    x = turn(np.array([v for v in some if len(v) == width], np.float64))
    n = lists or min(LISTS, max(1, math.isqrt(high - low + 1)))
    centres = fit_centres(x, min(n, len(x)))
    shared = table.spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = turn(b.column("v").flatten().to_numpy().reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_home(v, shared.value), pa.int32())], names=[*b.schema.names, "list"])

    name = f"index/ivf-{uuid.uuid4().hex}"
    placed = rows.filter(F.size("v") == width).mapInArrow(place, f"{ROW_ID} long, v array<double>, list int")
    placed.repartitionByRange("list", ROW_ID).write.partitionBy("list").parquet(f"{table.root}/{name}/rows")
    centre_rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    table.spark.createDataFrame(centre_rows, "list int, v array<double>").coalesce(1).write.parquet(f"{table.root}/{name}/centres")
    entry = _entry(table, "ivf", column, name, metric=metric) | {"from": low, "to": high}
    return table.commit(Changes(indexes=[entry], schema_id=table.schema.id), **commit)


def vector_search(table: LakeTable, column: str, query: list[float], k: int, metric: str = "l2", probes: int = PROBES, row_ids: DataFrame | None = None) -> DataFrame:
    """``_ROW_ID`` and ``_INDEX_SCORE`` of about the k nearest rows, in order of ids:
    the ``probes`` nearest lists of every index of the column, and exactly the rows
    that no index covers. ``row_ids`` restricts the search beforehand. With as many
    probes as lists the result is exact."""
    last, spark = table.snapshots.latest(), table.spark
    entries = [e for e in last.indexes if e["kind"] == "ivf" and e["metric"] == metric and _usable(table, e, column)]
    parts, q = [], np.array(query, np.float64)
    for e in entries:
        got = spark.read.parquet(f"{table.root}/{e['path']}/centres").orderBy("list").collect()
        centres = np.array([r["v"] for r in got])
        goal = _unit(q[None, :])[0] if metric == "cosine" else q
        far = -(centres @ goal) if metric == "inner_product" else ((centres - goal) ** 2).sum(axis=1)
        near = [got[i]["list"] for i in np.argsort(far, kind="stable")[:probes]]
        parts.append(spark.read.parquet(f"{table.root}/{e['path']}/rows").filter(F.col("list").isin(near)).select(ROW_ID, "v"))
    gaps = _gaps([(e["from"], e["to"]) for e in entries], (last.next_row_id or 0) - 1)
    if gaps or not parts:
        parts.append(table.read([ROW_ID, column], row_ranges=gaps or None).select(ROW_ID, F.col(column).cast("array<double>").alias("v")))
    rows = functools.reduce(DataFrame.union, parts)
    if entries and (last.deletions or last.total_rows != last.next_row_id):
        # rows went after they were indexed
        rows = rows.join(table.read([ROW_ID]), ROW_ID, "left_semi")
    if row_ids is not None:
        rows = rows.join(row_ids.select(ROW_ID), ROW_ID, "left_semi")
    return vector_topk(rows, "v", query, k, metric).select(ROW_ID, "_INDEX_SCORE")

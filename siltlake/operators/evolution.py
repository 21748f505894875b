"""Data evolution: columns of the same rows written in separate files.

Files that cover the same range of row ids are read together; each column comes
from the file with the highest sequence that has it, by presence, not by value.
Columns won by the same file form a family; families meet in an equi join on
``_ROW_ID``. With one family there is no join.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import predicate as P
from ..sources import manifest as M
from ..sources.table import BROADCAST_FILES, Changes, LakeTable, Plan
from .merge import KIND, ROW_ID, SEQ

#: Row ids in a block, for joins by range.
ID_BLOCK = 1 << 20


def by_range(files: list[Row]) -> dict[int, list[Row]]:
    """The files of each range of row ids, newest first."""
    ranges: dict[int, list[Row]] = {}
    for f in files:
        ranges.setdefault(f["first_row_id"], []).append(f)
    for first, fs in ranges.items():
        if len({f["row_count"] for f in fs}) != 1:
            raise ValueError(f"files from row {first} on differ in their number of rows")
        fs.sort(key=lambda f: (f["max_sequence"], f["key"]), reverse=True)
    return ranges


def winners(table: LakeTable, files: list[Row], names: list[str]) -> dict[tuple[tuple[str, ...], ...], list[list[Row]]]:
    """How the ranges are put together: for each set of families of columns, the
    files of each family. A file that wins none of ``names`` is left out; a range
    without any has its oldest file, for its rows."""
    out: dict[tuple[tuple[str, ...], ...], list[list[Row]]] = {}
    for fs in by_range(files).values():
        won: dict[str, list[str]] = {}
        for n in names:
            best = next((f for f in fs if _has(table, f, n)), None)
            if best is not None:
                won.setdefault(best["key"], []).append(n)
        sides = sorted((tuple(won[f["key"]]), k) for k, f in enumerate(fs) if f["key"] in won) or [((), len(fs) - 1)]
        held = out.setdefault(tuple(cols for cols, _ in sides), [[] for _ in sides])
        for to, (_, k) in zip(held, sides, strict=True):
            to.append(fs[k])
    return out


def ranges_that_may_match(table: LakeTable, files: list[Row], predicate: P.Predicate) -> list[Row]:
    """Files of the ranges whose columns, each in the file that wins it, may match."""
    fields, wanted, kept = table.schema.fields, P.in_bounds(predicate, table.schema.fields), []
    for fs in by_range(files).values():
        stats = {}
        for n in P.fields(predicate):
            best = next((f for f in fs if _has(table, f, n)), None)
            if best is None:
                stats[n] = (None, None, fs[0]["row_count"])
                continue
            i = fields[n].metadata["field_id"]
            was = next(x for x in table.schema_of(best["schema_id"]).fields.fields if x.metadata["field_id"] == i)
            if was.dataType == fields[n].dataType and was.name in (best["nulls"] or {}):
                stats[n] = (*(P.parse_bound((best[s] or {}).get(was.name), was.dataType) for s in ("low", "high")), best["nulls"][was.name])
        if P.may_match(wanted, stats, fs[0]["row_count"]):
            kept += fs
    return kept


def _has(table: LakeTable, f: Row, name: str) -> bool:
    field = table.schema.fields[name].metadata["field_id"]
    was = next((x.name for x in table.schema_of(f["schema_id"]).fields.fields if x.metadata["field_id"] == field), None)
    return was is not None and (not f["write_cols"] or was in f["write_cols"])


def merge_columns(table: LakeTable, plan: Plan, needed: set[str] | None = None) -> DataFrame:
    """The table's rows with every column that is ``needed`` (all, if not said) from
    its newest file; no other file is read. Ranges that are put together alike are
    read together, and their families meet in inner joins, below which Spark pushes
    filters; one family needs no join."""
    fields = table.schema.fields
    names = fields.names if needed is None or SEQ in needed else [n for n in fields.names if n in needed]
    parts = []
    for sides, files in winners(table, plan.files, names).items():
        out = table.scan_files(files[0])
        have = {c: F.col(f"`{c}`") for c in sides[0]}
        seqs = [F.col(SEQ)]
        for i, (cols, fs) in enumerate(zip(sides[1:], files[1:], strict=True)):
            side = table.scan_files(fs).select(F.col(ROW_ID).alias(f"__id{i}"), F.col(SEQ).alias(f"__seq{i}"), *[F.col(f"`{c}`").alias(f"__{i}_{c}") for c in cols])
            out = out.join(side, F.col(ROW_ID) == F.col(f"__id{i}"))
            have |= {c: F.col(f"`__{i}_{c}`") for c in cols}
            seqs.append(F.col(f"__seq{i}"))
        seq = F.greatest(*seqs) if len(seqs) > 1 else seqs[0]
        cols = [have.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in fields.fields]
        parts.append(out.select(*cols, seq.alias(SEQ), KIND, ROW_ID))
    return functools.reduce(DataFrame.unionByName, parts) if parts else table.scan_files([])


def write_columns(table: LakeTable, rows: DataFrame, columns: list[str], **commit):
    """Write new values of some columns for rows that ``_ROW_ID`` names. Every
    row of each range that is touched must be there."""
    plan = table.plan()
    ranges = {f["first_row_id"]: f["row_count"] for f in plan.files}
    spans = table.spark.createDataFrame([(a, a + n - 1) for a, n in ranges.items()], "__from long, __to long")
    inside = F.col(ROW_ID).between(F.col("__from"), F.col("__to"))
    if len(ranges) <= BROADCAST_FILES:
        placed = rows.join(F.broadcast(spans), inside)
    else:
        # spans and rows meet by blocks of ids
        cut = lambda c: F.floor(F.col(c) / ID_BLOCK)
        spans = spans.withColumn("__block", F.explode(F.sequence(cut("__from"), cut("__to"))))
        placed = rows.withColumn("__block", cut(ROW_ID)).join(spans, "__block").filter(inside).drop("__block")
    folder_of, added = {}, []
    counts = {r["__from"]: r["n"] for r in placed.groupBy("__from").agg(F.count("*").alias("n")).collect()}
    for first, n in counts.items():
        if n != ranges[first]:
            raise ValueError(f"{n} rows given for the range from {first} on, which has {ranges[first]}")
    kept = [F.col(f"`{c}`").cast(table.schema.fields[c].dataType).alias(c) for c in columns]
    ordered = placed.select(*kept, ROW_ID, "__from").repartition("__from").sortWithinPartitions("__from", ROW_ID)
    folder = f"{table._data_root()}/{uuid.uuid4().hex}"
    ordered.drop(ROW_ID).withColumn("rows.from", F.col("__from")).drop("__from").write.partitionBy("rows.from").parquet(folder)
    for e in table._describe(folder, "parquet", columns, 0):
        first = int(e["key"].split("rows.from=")[1].split("/")[0])
        if first in folder_of:
            raise RuntimeError(f"the range from row {first} on was written in more than one file")
        folder_of[first] = e["key"]
        added.append(e | {"first_row_id": first})
    return table.commit(Changes(added=added, schema_id=table.schema.id, base=plan.snapshot), **commit)


def row_ranges(ids: DataFrame, column: str = ROW_ID) -> DataFrame:
    """Gaps and islands: the closed ranges that a set of ids consists of. Runs are
    found in spans of fixed width; only those that touch a span's edge, two a span
    at most, meet in one task to be joined."""
    spans = ids.select(F.col(column).alias("x")).distinct().withColumn("span", F.floor(F.col("x") / ID_BLOCK))
    inner = Window.partitionBy("span").orderBy("x")
    runs = spans.withColumn("run", F.col("x") - F.row_number().over(inner)).groupBy("span", "run").agg(F.min("x").alias("from"), F.max("x").alias("to"))
    edge = (F.col("from") % ID_BLOCK == 0) | ((F.col("to") + 1) % ID_BLOCK == 0)
    every = Window.orderBy("from")
    fresh = F.coalesce((F.lag("to").over(every) + 1 < F.col("from")).cast("int"), F.lit(1))
    numbered = runs.filter(edge).withColumn("new", fresh).withColumn("group", F.sum("new").over(every.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("group").agg(F.min("from").alias("from"), F.max("to").alias("to")).select("from", "to")
    return runs.filter(~edge).select("from", "to").union(joined)


def ids_of(ranges: DataFrame) -> DataFrame:
    """The ids of closed ranges."""
    return ranges.select(F.explode(F.sequence("from", "to")).alias(ROW_ID))


def set_algebra(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """and, or, and_not of two sets of row ids."""
    x, y = a.select(ROW_ID).distinct(), b.select(ROW_ID).distinct()
    return {"and": lambda: x.join(y, ROW_ID, "left_semi"), "or": lambda: x.union(y).distinct(), "and_not": lambda: x.join(y, ROW_ID, "left_anti")}[op]()


def live_files(table: LakeTable) -> DataFrame:
    s = table.snapshots.latest()
    return M.live(M.read(table.spark, table.root, s.base + s.delta if s else []))


__all__ = ["ids_of", "live_files", "merge_columns", "row_ranges", "set_algebra", "winners", "write_columns"]

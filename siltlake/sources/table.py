"""Snapshot-versioned lake tables: plan, read, write, commit, maintain.

The driver plans from metadata; what a read returns is one lazy DataFrame over
pruned files, so projection, row-group filters and joins stay with Catalyst.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicate as P
from ..functions.casts import cast
from ..functions.types import is_nested
from ..operators.merge import DELETE, KIND, ROW_ID, SEQ, MergeSpec, merge
from . import manifest as M
from .fs import Files, Item
from .schema import Schemas, TableSchema
from .snapshot import ANALYZE, APPEND, COMPACT, OVERWRITE, Snapshot, Snapshots

#: File formats by identifier: the names of Spark's data sources for them. Others are
#: registered with ``register_format``.
formats: dict[str, str] = {"parquet": "parquet", "orc": "orc", "avro": "avro"}
POSTPONE, UNAWARE = -2, -1
#: Files up to this many are told apart by a broadcast table of their row ids.
BROADCAST_FILES = 200_000
#: Kinds of indexes over row ids.
ROW_INDEXES = ("global", "ivf")
#: Deletion tables of a snapshot before they are made one.
DELETIONS = 16
#: Compressed bytes of a bucket up to which one task merges it without a shuffle.
BUCKET_BYTES = 2 << 30


class CommitConflict(RuntimeError):
    """Someone else removed files that this commit builds on."""


class SequenceConflict(CommitConflict):
    """Someone else's records took sequence numbers that these were given."""


@dataclass
class Changes:
    """What a write prepared and a commit makes visible. ``base`` is the snapshot
    that the rows were read from, for conflict checks; ``marked`` the files whose
    rows ``deletions`` marks."""

    added: list[dict[str, Any]] = field(default_factory=list)
    deleted: list[Row] = field(default_factory=list)
    deletions: dict | None = None
    marked: list[str] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    schema_id: int = 0
    statistics: dict | None = None
    base: Snapshot | None = None
    #: sequence numbers follow those of ``base``
    numbered: bool = False

    def to_json(self) -> str:
        """For a commit by another process; files to delete are named by key."""
        return json.dumps({**asdict(dataclasses.replace(self, deleted=[], base=None)), "deleted": [f["key"] for f in self.deleted], "base": self.base and self.base.id})

    @classmethod
    def from_json(cls, text: str, table: LakeTable) -> Changes:
        x = json.loads(text)
        gone, base = set(x.pop("deleted")), x.pop("base")
        base = None if base is None else table.snapshots.read(base)
        live = [f for f in table.plan(version=base.id).files if f["key"] in gone] if gone and base else []
        return cls(**x, deleted=live, base=base)


@dataclass
class Plan:
    """The files of a scan, after pruning, and how they are to be read."""

    snapshot: Snapshot | None
    files: list[Row]
    delta: bool = False
    #: row ids to keep, as closed ranges
    row_ranges: list[tuple[int, int]] | None = None

    @property
    def rows(self) -> int:
        return sum(f["row_count"] for f in self.files)


class LakeTable:
    def __init__(self, spark: SparkSession, path: str, branch: str = "main", options: dict | None = None, schema_json: str | None = None):
        self.spark, self.fs = spark, Files(spark)
        branch = branch if branch not in ("", "main") else (options or {}).get("branch") or "main"
        self.path, self.branch = path.rstrip("/"), branch
        self.root = self.path if branch in ("", "main") else f"{self.path}/branch/branch-{branch}"
        self.schemas, self.snapshots = Schemas(self.fs, self.root), Snapshots(self.fs, self.root)
        latest = self.schemas.latest()
        if latest is None:
            raise ValueError(f"no table at {path}" + (f", branch {branch}" if branch != "main" else ""))
        # a given schema is read with instead of the latest
        self.schema, self.extra = TableSchema.from_json(schema_json) if schema_json else latest, options or {}
        self._old: dict[int, TableSchema] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, fields: T.StructType, partition_keys=(), primary_keys=(), options=None, comment: str = "") -> LakeTable:
        made = TableSchema.create(fields, partition_keys, primary_keys, options, comment)
        Schemas(Files(spark), path.rstrip("/")).commit(made)
        return cls(spark, path)

    @property
    def options(self):
        return self.schema.opts(self.extra)

    @property
    def has_keys(self) -> bool:
        return bool(self.schema.primary_keys)

    def schema_of(self, version: int) -> TableSchema:
        """A schema by its number; schema files never change."""
        if version not in self._old:
            self._old[version] = self.schemas.read(version)
        return self._old[version]

    @property
    def marks_old_rows(self) -> bool:
        """A table with keys whose compaction marks rows that newer ones replace:
        what is past level 0 is read without a merge."""
        return self.has_keys and self.options.flag("deletion-vectors.enabled")

    def alter(self, change: Callable[[TableSchema], TableSchema]) -> LakeTable:
        """Write the next schema version, e.g. ``alter(lambda s: s.add_column(...))``."""
        made = change(self.schema)
        self.schemas.commit(made)
        self.schema = made
        return self

    # ---- planning

    def starting_snapshot(self, version: int | None = None, timestamp_ms: int | None = None) -> Snapshot | None:
        version = version if version is not None else int(self.options.text("scan.snapshot-id") or 0) or None
        if version is not None:
            return self.snapshots.read(version)
        if timestamp_ms is not None:
            return self.snapshots.at_or_before(timestamp_ms)
        return self.snapshots.latest()

    def _partition_column(self, name: str) -> Column:
        kind, text = self.schema.fields[name].dataType, F.col("partition")[name]
        return (F.concat(text, F.lit("Z")) if isinstance(kind, T.TimestampType) else text).cast(kind)

    def plan(
        self, predicate: P.Predicate | None = None, partitions: list[dict] | None = None, buckets: Iterable[int] | None = None, version: int | None = None,
        timestamp_ms: int | None = None, delta: bool = False, row_ranges: list[tuple[int, int]] | None = None, limit: int | None = None,
        every_level: bool = False,
    ) -> Plan:
        """Choose the snapshot and the files that may hold what is asked for."""
        s = self.starting_snapshot(version, timestamp_ms)
        if s is None:
            return Plan(None, [], delta)
        schema, default = self.schema.fields, self.options.text("partition.default-name")
        where = [P.to_column(P.partition_filter(partitions, schema, default), schema, self._partition_column)] if partitions and all(partitions) else []
        own = P.pick(predicate, lambda names: names <= set(self.schema.partition_keys))
        if own is not None:
            where.append(P.to_column(own, schema, self._partition_column))
        if buckets is not None:
            where.append(F.col("bucket").isin(*buckets))
        if not delta and self.options.number("bucket") == POSTPONE:
            where.append(F.col("bucket") != POSTPONE)
        for lo, hi in [(min(a for a, _ in row_ranges), max(b for _, b in row_ranges))] if row_ranges else []:
            where.append((F.col("first_row_id") + F.col("row_count") > lo) & (F.col("first_row_id") <= hi))
        if self.marks_old_rows and not delta and not every_level:
            # rows of level 0 are seen when compaction has marked those that they replace
            where.append(F.col("level") > 0)
        prunable = self._prunable(predicate) if not delta else None
        if prunable is not None:
            where.append(self._may_match(prunable))
        entries = M.read(self.spark, self.root, s.delta if delta else s.base + s.delta)
        cond = functools.reduce(lambda a, b: a & b, where) if where else None
        found = entries.filter(F.col("kind") == M.ADD) if delta else M.live(entries)
        found = found if cond is None else found.filter(cond)
        # of the statistics, the driver gets what it tests itself
        spread = predicate is not None and not delta and self.options.flag("data-evolution.enabled")
        used = sorted(self._names_ever({*self.schema.trimmed_keys[:1], *(P.fields(predicate) if spread else ())}))
        less = {c: F.map_filter(c, lambda k, _: k.isin(*used)) if used else F.lit(None).cast(M.SCHEMA[c].dataType) for c in ("low", "high", "nulls")}
        files = found.withColumns(less).orderBy("min_sequence", "key").collect()
        if row_ranges:
            inside = lambda f: any(f["first_row_id"] + f["row_count"] > a and f["first_row_id"] <= b for a, b in row_ranges)
            files = [f for f in files if f["first_row_id"] is not None and inside(f)]
        if spread:
            from ..operators.evolution import ranges_that_may_match

            files = ranges_that_may_match(self, files, predicate)
        if limit is not None and predicate is None and not self.has_keys and not s.deletions and not delta and not row_ranges:
            files = self._enough(files, limit)
        return Plan(s, files, delta, row_ranges)

    def _prunable(self, predicate: P.Predicate | None) -> P.Predicate | None:
        """What of a predicate may drop single files: below a merge its keys only;
        columns of the same rows in several files are looked at by range."""
        if predicate is None or self.options.flag("data-evolution.enabled"):
            return None
        merged = self.has_keys and not self.marks_old_rows
        return P.pick(predicate, lambda names: names <= set(self.schema.primary_keys)) if merged else predicate

    def _names_ever(self, names: Iterable[str]) -> set[str]:
        """The names that columns have had, by field id."""
        ids = {self.schema.fields[n].metadata["field_id"] for n in names}
        return {f.name for v in self.schemas.ids() for f in self.schema_of(v).fields.fields if f.metadata["field_id"] in ids} if ids else set()

    def _may_match(self, predicate: P.Predicate) -> Column:
        """Whether a file may hold a match, from the statistics in its manifest
        entry, which are under the names and types of the schema it was written with."""
        now = self.schema.fields

        def of(version: int) -> Column:
            old = {f.metadata["field_id"]: f for f in self.schema_of(version).fields.fields}

            def stats(name: str) -> tuple[Column, Column, Column] | None:
                f = now[name]
                was = old.get(f.metadata["field_id"])
                if was is None:
                    # a column that the file has not is null in every row
                    none = F.lit(None).cast(f.dataType)
                    return none, none, F.col("row_count")
                # wider whole numbers keep their order; other casts may not
                if was.dataType != f.dataType and not _widens(was.dataType, f.dataType):
                    return None
                low, high = (P.bound_of(F.col(side)[was.name], was.dataType).cast(f.dataType) for side in ("low", "high"))
                return low, high, F.col("nulls")[was.name]

            return (F.col("schema_id") == version) & P.may_match_column(predicate, now, stats)

        return functools.reduce(lambda a, b: a | b, map(of, sorted({*self.schemas.ids(), self.schema.id})))

    @staticmethod
    def _enough(files: list[Row], limit: int) -> list[Row]:
        """The first files that hold ``limit`` rows."""
        held, out = 0, []
        for f in files:
            if held >= limit:
                break
            out.append(f)
            held += f["row_count"]
        return out

    # ---- reading

    def read(
        self, columns: list[str] | None = None, predicate: P.Predicate | None = None, limit: int | None = None, row_ids: DataFrame | None = None,
        with_kind: bool = False, **scan: Any,
    ) -> DataFrame:
        """Rows of a snapshot: merged by key, deletions applied, columns as the
        schema of now has them. Filters are exact. ``columns`` may name
        ``_ROW_ID`` and ``_SEQUENCE_NUMBER`` where row tracking is on."""
        names = columns or self.schema.fields.names
        meta = [n for n in names if n in (ROW_ID, SEQ, KIND)]
        if meta and not self.options.flag("row-tracking.enabled") and set(meta) & {ROW_ID, SEQ} and not self.has_keys:
            raise ValueError("row ids and sequence numbers need row tracking")
        if predicate is not None:
            P.validate(predicate, self.schema.fields)
        plan = self.plan(predicate, limit=limit if row_ids is None else None, **scan)
        needed = {*names, *P.fields(predicate), *([ROW_ID] if row_ids is not None else [])}
        df = self.rows_of(plan, predicate, needed)
        if row_ids is not None:
            df = df.join(row_ids.select(F.col(ROW_ID)), ROW_ID, "left_semi")
        if predicate is not None:
            df = df.filter(P.to_column(predicate, self.schema.fields))
        out = df.select(*([F.col(KIND)] if with_kind and KIND not in names else []), *[F.col(f"`{n}`") for n in names])
        return out if limit is None else out.limit(limit)

    def changes(self, version: int, columns: list[str] | None = None) -> DataFrame:
        """Rows that one snapshot added, unmerged, with ``_VALUE_KIND`` first."""
        df = self.rows_of(self.plan(version=version, delta=True))
        return df.select(KIND, *[F.col(f"`{n}`") for n in columns or self.schema.fields.names])

    def rows_of(self, plan: Plan, predicate: P.Predicate | None = None, needed: set[str] | None = None) -> DataFrame:
        """Rows of a plan's files, merged. ``predicate`` may be used below the merge
        where that is safe; ``needed`` names the columns that will be looked at."""
        if self.options.flag("data-evolution.enabled"):
            from ..operators.evolution import merge_columns

            df = merge_columns(self, plan, needed)
        else:
            df = self._merged(plan, predicate)
        if plan.row_ranges:
            df = df.filter(functools.reduce(lambda a, b: a | b, [F.col(ROW_ID).between(lo, hi) for lo, hi in plan.row_ranges]))
        return df

    def _merged(self, plan: Plan, predicate: P.Predicate | None) -> DataFrame:
        deletions = plan.snapshot.deletions if plan.snapshot and not plan.delta else []
        if not self.has_keys or plan.delta or self.marks_old_rows:
            df = self.scan_files(plan.files, deletions)
            return df if not self.has_keys or plan.delta else df.filter(~F.col(KIND).isin(1, DELETE))
        raw, mixed = self._sections(plan.files)
        keys = P.pick(predicate, lambda names: names <= set(self.schema.primary_keys))
        spec = self.options.merge_spec(self.schema.primary_keys)
        parts = []
        if raw:
            parts.append(self.scan_files(raw, deletions))
        if mixed or not raw:
            below = self.scan_files(mixed, deletions, by_bucket=True)
            if keys is not None:
                # a key's records all pass or all fail: safe below the merge
                below = below.filter(P.to_column(keys, self.schema.fields))
            parts.append(merge(below, spec).select(*[F.col(f"`{n}`") for n in self._all_names()]))
        return functools.reduce(DataFrame.unionByName, parts)

    def _all_names(self) -> list[str]:
        return [*self.schema.fields.names, SEQ, KIND, *([ROW_ID] if self.options.flag("row-tracking.enabled") else [])]

    def _sections(self, files: list[Row]) -> tuple[list[Row], list[Row]]:
        """Files whose keys no other write to the bucket can hold, and the rest.
        Intervals are over the first key column that is no partition key."""
        lead = self.schema.trimmed_keys[0]
        kind = self.schema.fields[lead].dataType
        groups: dict[tuple, list[Row]] = {}
        for f in files:
            groups.setdefault((tuple(sorted((f["partition"] or {}).items())), f["bucket"]), []).append(f)
        raw, mixed = [], []
        for fs in groups.values():
            known = [(f, *(P.parse_bound((f[s] or {}).get(lead), kind) for s in ("low", "high"))) for f in fs]
            if any(lo is None or hi is None for _, lo, hi in known) and len(fs) > 1:
                mixed += fs
                continue
            section: list[Row] = []
            top = None
            for f, lo, hi in sorted(known, key=lambda x: (x[1] is not None, x[1] if x[1] is not None else 0)):
                if section and (top is None or lo <= top):
                    section.append(f)
                    top = hi if top is None else max(top, hi)
                    continue
                self._close(section, raw, mixed)
                section, top = [f], hi
            self._close(section, raw, mixed)
        return raw, mixed

    @staticmethod
    def _close(section: list[Row], raw: list[Row], mixed: list[Row]) -> None:
        # files of one write whose keys are unique hold no key twice between them
        alone = all(f["unique_keys"] and f["delete_count"] == 0 for f in section) and len({f["snapshot_id"] for f in section}) <= 1
        (raw if alone else mixed).extend(section)

    def scan_files(self, files: list[Row], deletions: list[dict] = (), by_bucket: bool = False) -> DataFrame:
        """Rows of data files as the schema of now has them, with sequence
        numbers, kinds and, under row tracking, row ids; without merging.
        ``by_bucket`` reads each bucket in one task, where its size allows that."""
        # only files that have deleted rows are joined with these
        touched = self.files_with_deletions(deletions) if deletions else set()
        groups: dict[tuple, list[Row]] = {}
        for f in files:
            groups.setdefault((f["schema_id"], f["format"], tuple(f["write_cols"] or ()), f["key"] in touched), []).append(f)
        buckets = self._buckets(files) if by_bucket else 0
        parts = [self._scan_group(sid, fmt, list(cols), fs, deletions if hit else [], buckets) for (sid, fmt, cols, hit), fs in sorted(groups.items(), key=lambda g: str(g[0]))]
        if not parts:
            kinds = {SEQ: "long", KIND: "byte", ROW_ID: "long"}
            fields = [*self.schema.fields.fields, *[T.StructField(n, T._parse_datatype_string(kinds[n])) for n in self._all_names() if n in kinds]]
            return self.spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
        return functools.reduce(DataFrame.unionByName, parts)

    def _buckets(self, files: list[Row]) -> int:
        """The number of buckets if every file is one's and their sizes suit tasks, else 0."""
        n, sizes = self.options.number("bucket"), {}
        for f in files:
            if f["total_buckets"] != n or not re.search(r"_\d{5,}\.[^/]*$", f["path"]):
                return 0
            sizes[f["bucket"]] = sizes.get(f["bucket"], 0) + f["size"]
        return n if n > 0 and max(sizes.values(), default=0) <= BUCKET_BYTES else 0

    def _scan_group(self, schema_id: int, fmt: str, write_cols: list[str], files: list[Row], deletions: list[dict], buckets: int = 0) -> DataFrame:
        old = self.schema_of(schema_id)
        stored = [f for f in old.fields.fields if not write_cols or f.name in write_cols]
        # physical names are the schema's of that time; files without a record kind hold inserts only
        physical = T.StructType([*[T.StructField(f.name, f.dataType) for f in stored], T.StructField(SEQ, T.LongType()), T.StructField(KIND, T.ByteType())])
        df = self.spark.read.format(formats[fmt]).schema(physical).load([f["path"] for f in files])
        if buckets:
            df = bucketed(df, old.bucket_keys(), buckets)
        tracked = self.options.flag("row-tracking.enabled")
        if tracked or deletions:
            if fmt != "parquet":
                raise ValueError(f"row positions need parquet files, not {fmt}")
            df = df.withColumn("__key", key_of(F.col("_metadata.file_path"))).withColumn("__pos", F.col("_metadata.row_index"))
        if tracked:
            ids = self.spark.createDataFrame([(f["key"], f["first_row_id"], f["max_sequence"]) for f in files], "__key string, __first long, __last long")
            df = df.join(F.broadcast(ids) if len(files) <= BROADCAST_FILES else ids, "__key")
        if deletions:
            gone = self.deleted_rows(deletions).select(F.col("key").alias("__key"), F.col("position").alias("__pos"))
            df = df.join(gone, ["__key", "__pos"], "left_anti")
        by_id = {f.metadata["field_id"]: f for f in stored}
        out = []
        for f in self.schema.fields.fields:
            was = by_id.get(f.metadata["field_id"])
            out.append((F.lit(None).cast(f.dataType) if was is None else self._evolved(was, f)).alias(f.name))
        seq = F.coalesce(F.col(SEQ), F.col("__last")) if tracked else F.col(SEQ)
        out += [seq.alias(SEQ), F.coalesce(F.col(KIND), F.lit(0).cast("byte")).alias(KIND)]
        if tracked:
            out.append((F.col("__first") + F.col("__pos")).alias(ROW_ID))
        return df.select(*out)

    def deleted_rows(self, deletions: list[dict]) -> DataFrame:
        """(key, position) of rows that deletion vectors mark."""
        return self.spark.read.schema("key string, position long").parquet(*[f"{self.root}/{d['path']}/rows" for d in deletions])

    def deletion_counts(self, deletions: list[dict]) -> DataFrame:
        """(key, count) of the files that have deleted rows."""
        return self.spark.read.schema("key string, count long").parquet(*[f"{self.root}/{d['path']}/files" for d in deletions])

    def files_with_deletions(self, deletions: list[dict]) -> set[str]:
        return {r["key"] for r in self.deletion_counts(deletions).select("key").distinct().collect()}

    def write_deletions(self, rows: DataFrame) -> tuple[dict | None, list[str]]:
        """A deletion table of (key, position) rows, and the files it marks."""
        name = f"index/deletions-{uuid.uuid4().hex}"
        rows.select("key", "position").write.parquet(f"{self.root}/{name}/rows")
        made = self.spark.read.schema("key string, position long").parquet(f"{self.root}/{name}/rows")
        made.groupBy("key").count().coalesce(1).write.parquet(f"{self.root}/{name}/files")
        by_file = self.deletion_counts([{"path": name}]).collect()
        return {"path": name, "rows": sum(r["count"] for r in by_file), "files": len(by_file)} if by_file else None, [r["key"] for r in by_file]

    @staticmethod
    def _evolved(was: T.StructField, now: T.StructField) -> Column:
        c = F.col(f"`{was.name}`")
        if was.dataType == now.dataType or is_nested(now.dataType):
            return c
        return cast(c, was.dataType, now.dataType)

    # ---- writing

    def bucket_column(self, keys: list[str] | None = None) -> Column:
        n = self.options.number("bucket")
        if n == POSTPONE:
            return F.lit(POSTPONE)
        if n <= 0:
            return F.lit(0)
        return F.pmod(F.hash(*[F.col(f"`{k}`") for k in keys or self.schema.bucket_keys()]), F.lit(n))

    def prepare(self, df: DataFrame, columns: list[str] | None = None, level: int = 0, external: str | None = None, unique: bool = False) -> Changes:
        """Write the rows of ``df`` to data files; nothing is visible yet.

        ``df`` may carry ``_VALUE_KIND`` and ``_SEQUENCE_NUMBER``. ``columns``
        writes a part of the columns, for data evolution. ``unique`` vouches that
        no key is in ``df`` twice: files alone in their key range then need no
        merge. It is not worked out here, which would shuffle every key.
        """
        schema = self.schema
        names = columns or schema.fields.names
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        if columns and not self.options.flag("data-evolution.enabled"):
            raise ValueError("writing some columns needs data evolution")
        typed = [F.col(f"`{n}`").cast(schema.fields[n].dataType).alias(n) for n in names]
        carried = [F.col(c) for c in (SEQ, KIND) if c in df.columns]
        df = df.select(*typed, *carried)
        last = self.snapshots.latest()
        numbered = self.has_keys and SEQ not in df.columns
        if self.has_keys:
            df = df.withColumn(SEQ, F.monotonically_increasing_id()) if numbered else df
            df = df.withColumn(KIND, (F.col(KIND) if KIND in df.columns else F.lit(0)).cast("byte"))
        default = self.options.text("partition.default-name")
        folder = f"{(external or self._data_root()).rstrip('/')}/{uuid.uuid4().hex}"
        where = []
        for k in schema.partition_keys if not columns else []:
            text = partition_text(F.col(f"`{k}`"), schema.fields[k].dataType)
            df = df.withColumn(f"pt.{k}", F.when(text.isNull() | (F.trim(text) == ""), default).otherwise(text))
            where.append(f"pt.{k}")
        bucketed = self.options.number("bucket") > 0 or self.options.number("bucket") == POSTPONE
        if bucketed:
            df = df.withColumn("bucket.id", self.bucket_column())
            where.append("bucket.id")
            # a large or hot bucket is split over tasks by a salt of its keys; small shares are put together again by AQE
            salts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // max(1, self.options.number("bucket")))
            keys = [F.col(f"`{k}`") for k in schema.bucket_keys()] or [F.lit(0)]
            df = df.repartition(*[F.col(f"`{w}`") for w in where], F.pmod(F.xxhash64(*keys), F.lit(salts)))
        elif self.has_keys:
            df = df.repartition(*[F.col(f"`{k}`") for k in schema.primary_keys])
        if self.has_keys:
            df = df.sortWithinPartitions(*[F.col(f"`{c}`") for c in (*where, *schema.primary_keys)], SEQ)
        if numbered:
            # a key's records are in one task, in order: places in the task are numbers enough, and no task's rows use up others'
            place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
            df = df.withColumn(SEQ, F.lit(last.next_sequence if last else 0).cast("long") + place)
        fmt = self.options.text("file.format")
        if fmt not in formats:
            raise ValueError(f"unknown file format {fmt!r}")
        writer = df.write.format(formats[fmt]).option("compression", self.options.text("file.compression"))
        writer = writer.option("maxRecordsPerFile", max(1, self.options.size("target-file-size") // self._row_bytes(last, names)))
        (writer.partitionBy(*where) if where else writer).save(folder)
        added = self._describe(folder, fmt, names if columns else None, level, unique)
        return Changes(added=added, schema_id=schema.id, base=last, numbered=numbered)

    def _row_bytes(self, last: Snapshot | None, names: list[str]) -> int:
        """Bytes that a row takes: as files show, else by the types of its columns."""
        if last and last.total_rows > 0 and last.total_bytes > 0 and len(names) == len(self.schema.fields.names):
            return max(1, last.total_bytes // last.total_rows)
        return sum(_ROW_BYTES.get(type(f.dataType), 8) for f in self.schema.fields.fields if f.name in names)

    def _data_root(self) -> str:
        outside = self.options.names("data-file.external-paths")
        if outside:
            # round robin over the roots, by commit
            return f"{outside[(self.snapshots.latest_id() or 0) % len(outside)].rstrip('/')}/{self.path.rsplit('/', 1)[-1]}/data"
        return f"{self.path}/data"

    def _describe(self, folder: str, fmt: str, write_cols: list[str] | None, level: int, unique: bool = False) -> list[dict[str, Any]]:
        """Entries for the files in a folder, with counts and bounds from one
        aggregation by file (partial sums at the scan)."""
        files = [i for i in self.fs.walk(folder) if not i.name.startswith(("_", "."))]
        if not files:
            return []
        if self.has_keys and self.options.number("bucket") > 0:
            files = self._name_buckets(files)
        sizes = {key_text(i.path): i.size for i in files}
        stored = [f for f in self.schema.fields.fields if write_cols is None or f.name in write_cols]
        physical = T.StructType([*[T.StructField(f.name, f.dataType) for f in stored], T.StructField(SEQ, T.LongType()), T.StructField(KIND, T.ByteType())])
        df = self.spark.read.format(formats[fmt]).schema(physical).load([i.path for i in files])
        lead = set(self.schema.primary_keys) | set(self.schema.partition_keys)
        mode = {f.name: "full" if f.name in lead else self.options.given.get(f"fields.{f.name}.stats-mode") or self.options.text("metadata.stats-mode") for f in stored}
        kept = [f for f in stored if not is_nested(f.dataType) and not isinstance(f.dataType, T.BinaryType) and mode[f.name] != "none"]
        aggs = [F.count("*").alias("n"), F.min(SEQ).alias("s0"), F.max(SEQ).alias("s1"), F.count_if(F.col(KIND).isin(1, 3)).alias("dels")]
        for i, f in enumerate(kept):
            c = F.col(f"`{f.name}`")
            # NaN has no place in an order of bounds: such a file gets none
            nan = F.bool_or(F.isnan(c)) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.lit(False)
            aggs += [F.count_if(c.isNull()).alias(f"z{i}")]
            if mode[f.name] != "counts":
                aggs += [P.bound_text(F.when(~F.coalesce(nan, F.lit(False)), agg(c)), f.dataType).alias(f"{side}{i}") for side, agg in (("l", F.min), ("h", F.max))]
        rows = df.groupBy(F.col("_metadata.file_path").alias("at")).agg(*aggs).collect()
        out = []
        for r in rows:
            key = key_text(unquote(r["at"])) if key_text(r["at"]) not in sizes else key_text(r["at"])
            bound = lambda s, r=r: {f.name: r[f"{s}{i}"] for i, f in enumerate(kept) if f"{s}{i}" in r and r[f"{s}{i}"] is not None and len(r[f"{s}{i}"]) <= M.LONGEST_BOUND}
            m = re.search(r"bucket\.id=(-?\d+)", key)
            out.append({
                "kind": M.ADD, "key": key_text(r["at"]), "path": unquote(r["at"]), "format": fmt, "partition": self._partition_of(r["at"]), "bucket": int(m[1]) if m else 0,
                "total_buckets": self.options.number("bucket"), "level": level, "schema_id": self.schema.id, "row_count": r["n"], "size": sizes.get(key, 0),
                "min_sequence": r["s0"], "max_sequence": r["s1"], "write_cols": write_cols, "delete_count": r["dels"], "unique_keys": unique,
                "low": bound("l"), "high": bound("h"), "nulls": {f.name: r[f"z{i}"] for i, f in enumerate(kept)},
                "blob": any(f.metadata.get("blob") for f in stored),
            })
        return sorted(out, key=lambda e: e["key"])

    def _name_buckets(self, files: list[Item]) -> list[Item]:
        """Give files the bucket in their name, as Spark's bucketed scan wants it."""

        def renamed(i: Item) -> Item:
            stem, dot, rest = i.name.partition(".")
            m = re.search(r"bucket\.id=(\d+)/[^/]*$", i.path)
            path = f"{i.path[: -len(i.name)]}{stem}_{int(m[1]):05d}{dot}{rest}"
            if not self.fs.rename(i.path, path):
                raise OSError(f"cannot rename {i.path}")
            return dataclasses.replace(i, path=path, name=path.rsplit("/", 1)[1])

        with ThreadPoolExecutor(16) as pool:
            return list(pool.map(renamed, files))

    def _partition_of(self, at: str) -> dict[str, str | None]:
        default, out = self.options.text("partition.default-name"), {}
        for k in self.schema.partition_keys:
            m = re.search(rf"/pt\.{re.escape(k)}=([^/]*)/", unquote(at))
            value = unquote(m[1]) if m else None
            out[k] = None if value in (None, default, "__HIVE_DEFAULT_PARTITION__") else value
        return out

    def write(
        self, df: DataFrame, identifier: int | None = None, user: str = "", columns: list[str] | None = None, unique: bool = False, **commit: Any
    ) -> Snapshot | None:
        """Write and commit (``columns``, ``unique``: see ``prepare``). With an ``identifier`` the write of a (user,
        identifier) that is already there does nothing."""
        for left in reversed(range(self.options.number("commit.max-retries") + 1)):
            if identifier is not None and self._done(user, identifier):
                return None
            try:
                return self.commit(self.prepare(df, columns, unique=unique), identifier=identifier, user=user, **commit)
            except SequenceConflict:
                # other records took the numbers: these come after them
                if not left:
                    raise

    def _done(self, user: str, identifier: int) -> bool:
        last = self.snapshots.last_of_user(user)
        return last is not None and identifier <= last

    def commit(
        self, changes: Changes, kind: str = APPEND, identifier: int | None = None, user: str = "", watermark: int | None = None, ignore_empty: bool = True,
        properties: dict | None = None, replace: Callable[[Snapshot | None], list[Row]] | None = None,
    ) -> Snapshot | None:
        """Publish a snapshot; on a race, check for conflicts and try again.
        ``replace`` names the files to delete from the snapshot built upon."""
        if ignore_empty and not (changes.added or changes.deleted or changes.deletions or changes.indexes or changes.statistics or replace):
            return None
        if identifier is not None and self._done(user, identifier):
            return None
        for attempt in range(1, self.options.number("commit.max-retries") + 2):
            last = self.snapshots.latest()
            gone = changes.deleted if replace is None else replace(last)
            made = self._next_snapshot(last, changes, gone, kind, identifier, user, watermark, properties)
            made.properties |= {"commit.attempts": str(attempt), "commit.added-files": str(len(changes.added)), "commit.deleted-files": str(len(gone))}
            if self.snapshots.publish(made):
                return made
            for m in made.delta:
                self.fs.delete(f"{self.root}/{m}")
        raise CommitConflict("too many commits at once; gave up")

    def _check(self, last: Snapshot | None, changes: Changes, gone: list[Row]) -> None:
        """Fail where the snapshot built upon has not what a commit relies on: files
        to delete or to mark rows of, ranges of rows whose columns it writes, rows
        that it rewrites unmarked, and sequence numbers."""
        base = changes.base
        if changes.numbered and changes.added and last and last.next_sequence > (base.next_sequence if base else 0):
            raise SequenceConflict("other records were committed since these were numbered")
        wanted = {*(g["key"] for g in gone), *changes.marked}
        spans = {(e["first_row_id"], e["row_count"]) for e in changes.added if e.get("first_row_id") is not None}
        if not (wanted or spans):
            return
        live = M.live(M.read(self.spark, self.root, last.base + last.delta if last else []))
        if wanted:
            keys = self.spark.createDataFrame([(k,) for k in wanted], "key string")
            if lost := keys.join(live, "key", "left_anti").limit(3).collect():
                raise CommitConflict(f"files are no longer there: {[r['key'] for r in lost]}")
        if spans:
            ranges = self.spark.createDataFrame(list(spans), "first_row_id long, row_count long")
            if lost := ranges.join(live, ["first_row_id", "row_count"], "left_anti").limit(3).collect():
                raise CommitConflict(f"rows are no longer there: {[tuple(r) for r in lost]}")
            written = sorted({c for e in changes.added for c in e.get("write_cols") or ()})
            newer = live.filter((F.col("snapshot_id") > (base.id if base else 0)) & F.arrays_overlap("write_cols", F.array(*map(F.lit, written))))
            if base is not None and (lost := ranges.join(newer, ["first_row_id", "row_count"], "left_semi").limit(3).collect()):
                raise CommitConflict(f"columns of these rows were written since: {[tuple(r) for r in lost]}")
        if base is not None and last is not None and last.id != base.id and gone:
            known = {d["path"] for d in base.deletions}
            since = [d for d in last.deletions if d["path"] not in known]
            if since and (hit := self.files_with_deletions(since) & {g["key"] for g in gone}):
                raise CommitConflict(f"rows of files to replace were deleted since: {sorted(hit)[:3]}")

    def _live_deletions(self, last: Snapshot | None, made: dict | None, gone: list[Row]) -> list[dict]:
        """Deletion tables of the next snapshot: without those of files that go, and
        made one when they are many."""
        kept = last.deletions if last else []
        if kept and gone:
            keys = self.spark.createDataFrame([(g["key"],) for g in gone], "key string")
            rest = self.deletion_counts(kept).join(keys, "key", "left_anti")
            if rest.isEmpty():
                kept = []
            elif not self.deletion_counts(kept).join(keys, "key", "left_semi").isEmpty():
                kept = [d for d in [self.write_deletions(self.deleted_rows(kept).join(keys, "key", "left_anti"))[0]] if d]
        kept = [*kept, *([made] if made else [])]
        if len(kept) > DELETIONS:
            kept = [d for d in [self.write_deletions(self.deleted_rows(kept).distinct())[0]] if d]
        return kept

    def _next_snapshot(self, last, changes: Changes, gone: list[Row], kind, identifier, user, watermark, properties) -> Snapshot:
        self._check(last, changes, gone)
        number, next_row = (last.id + 1 if last else 1), (last.next_row_id if last else None)
        tracked = self.options.flag("row-tracking.enabled")
        next_row = (next_row or 0) if tracked else None
        added = []
        for e in changes.added:
            e = dict(e, snapshot_id=number)
            if tracked:
                # rows of columns written later keep the ids they were read with
                if e.get("first_row_id") is None:
                    e["first_row_id"], next_row = next_row, next_row + e["row_count"]
                if e.get("min_sequence") is None:
                    e["min_sequence"] = e["max_sequence"] = number
            added.append(e)
        entries = [*(M.as_entry(g, kind=M.DELETE, snapshot_id=number) for g in gone), *added]
        base = (last.base + last.delta) if last else []
        if len(base) >= self.options.number("manifest.merge-min-count"):
            base = [self.compact_manifests(base)]
        delta = [M.write(self.spark, self.root, entries)] if entries else []
        grown = sum(e["row_count"] for e in added) - sum(g["row_count"] for g in gone)
        marks = [w for w in (watermark, last.watermark if last else None) if w is not None]
        top = max([last.next_sequence if last else 0, *(e["max_sequence"] + 1 for e in added if e.get("max_sequence") is not None)])
        return Snapshot(
            id=number, schema_id=self.schema.id, base=base, delta=delta, kind=kind, user=user, identifier=identifier,
            millis=int(time.time() * 1000), total_rows=(last.total_rows if last else 0) + grown, delta_rows=grown,
            total_bytes=(last.total_bytes if last else 0) + sum(e["size"] for e in added) - sum(g["size"] for g in gone),
            deletions=self._live_deletions(last, changes.deletions, gone),
            indexes=[*(i for i in (last.indexes if last else []) if not self._outdated(i, added)), *changes.indexes],
            users={**(last.users if last else {}), **({user: identifier} if identifier is not None else {})},
            watermark=max(marks) if marks else None, next_row_id=next_row, next_sequence=top, properties=dict(properties or {}),
            # statistics hold until rows change
            statistics=changes.statistics or (last.statistics if last and not entries and not changes.deletions else None),
        )

    def _outdated(self, index: dict, added: list[dict[str, Any]]) -> bool:
        """Whether an index is over row ids whose column these files write anew."""
        if index["kind"] not in ROW_INDEXES:
            return False
        hit = lambda e: e["first_row_id"] <= index["to"] and e["first_row_id"] + e["row_count"] > index["from"]
        named = {f.name for f in self.schema.fields.fields if f.metadata["field_id"] == index["field_id"]}
        return any(named & set(e.get("write_cols") or ()) and hit(e) for e in added)

    def compact_manifests(self, names: list[str]) -> str:
        """One manifest with what the named ones leave alive."""
        name = f"manifest/manifest-{uuid.uuid4().hex}"
        M.live(M.read(self.spark, self.root, names)).select(*[f.name for f in M.SCHEMA.fields]).coalesce(1).write.parquet(f"{self.root}/{name}")
        return name

    # ---- changes to what is there

    def overwrite(self, df: DataFrame | None, partitions: list[dict] | None = None, **commit: Any) -> Snapshot | None:
        """Replace the matching partitions (all, if none are named) by ``df``."""
        changes = self.prepare(df) if df is not None else Changes(schema_id=self.schema.id)
        if partitions and df is not None:
            self._check_inside(changes, partitions)
        new = {e["key"] for e in changes.added}
        matching = lambda last: [f for f in (self.plan(partitions=partitions, version=last.id).files if last else []) if f["key"] not in new]
        return self.commit(changes, kind=OVERWRITE, replace=matching, **commit)

    def _check_inside(self, changes: Changes, partitions: list[dict]) -> None:
        text = lambda v: None if v is None else str(v)
        for e in changes.added:
            if not any(all(text(e["partition"].get(k)) == text(v) for k, v in p.items()) for p in partitions):
                raise ValueError(f"rows lie outside the partitions to overwrite: {e['partition']}")

    def drop_partitions(self, partitions: list[dict], **commit: Any) -> Snapshot | None:
        if not partitions:
            raise ValueError("no partitions to drop")
        return self.overwrite(None, partitions, **commit)

    def _again(self, attempt: Callable[[], Snapshot | None]) -> Snapshot | None:
        """Work out and commit a change anew as long as others get in its way."""
        for left in reversed(range(self.options.number("commit.max-retries") + 1)):
            try:
                return attempt()
            except CommitConflict:
                if not left:
                    raise

    def delete_where(self, predicate: P.Predicate, **commit: Any) -> Snapshot | None:
        """Mark matching rows of an append table in deletion vectors."""
        if self.has_keys:
            raise ValueError("delete from a table with keys by writing records of kind -D")
        if self.options.flag("data-evolution.enabled"):
            raise ValueError("deletion vectors do not go with data evolution")
        P.validate(predicate, self.schema.fields)

        def attempt() -> Snapshot | None:
            if (changes := self.prepare_delete(predicate)) is None:
                return None
            return self.commit(changes, **commit)

        return self._again(attempt)

    def prepare_delete(self, predicate: P.Predicate) -> Changes | None:
        plan = self.plan(predicate)
        if not plan.files:
            return None
        where = F.coalesce(P.to_column(predicate, self.schema.fields), F.lit(False))
        rows = self.positions(plan.files, sorted(P.fields(predicate))).filter(where)
        if plan.snapshot.deletions:
            rows = rows.join(self.deleted_rows(plan.snapshot.deletions), ["key", "position"], "left_anti")
        mark, marked = self.write_deletions(rows)
        return Changes(deletions=mark, marked=marked, schema_id=self.schema.id, base=plan.snapshot) if mark else None

    def positions(self, files: list[Row], columns: list[str]) -> DataFrame:
        """key and position of every row of Parquet files, with columns as the
        schema of now has them (by field id, cast), and sequence and kind if named."""
        parts = []
        for sid in sorted({f["schema_id"] for f in files}):
            old = self.schema_of(sid).fields.fields
            by_id = {f.metadata["field_id"]: f for f in old}
            fields = [T.StructField(f.name, f.dataType) for f in old] + [T.StructField(SEQ, T.LongType()), T.StructField(KIND, T.ByteType())]
            df = self.spark.read.schema(T.StructType(fields)).parquet(*[f["path"] for f in files if f["schema_id"] == sid])
            at = [key_of(F.col("_metadata.file_path")).alias("key"), F.col("_metadata.row_index").alias("position")]
            now = [f for f in self.schema.fields.fields if f.name in columns]
            cols = [(self._evolved(by_id[i], f) if (i := f.metadata["field_id"]) in by_id else F.lit(None).cast(f.dataType)).alias(f.name) for f in now]
            parts.append(df.select(*at, *cols, *[F.col(c) for c in (SEQ, KIND) if c in columns]))
        return functools.reduce(DataFrame.unionByName, parts)

    def compact(self, partitions: list[dict] | None = None, **commit: Any) -> Snapshot | None:
        """Rewrite files of the matching partitions. With keys: merged, at the top
        level, so what follows reads them without merging; under deletion vectors
        only level 0 is rewritten, and the rows that it replaces are marked. Without
        keys: files short of the target size, or with deleted rows, are packed."""
        if self.options.flag("row-tracking.enabled"):
            raise ValueError("compaction would renumber rows under row tracking")

        def attempt() -> Snapshot | None:
            if (changes := self.prepare_compact(partitions)) is None:
                return None
            return self.commit(changes, kind=COMPACT, **commit)

        return self._again(attempt)

    def prepare_compact(self, partitions: list[dict] | None = None) -> Changes | None:
        if self.marks_old_rows:
            return self._compact_level_0(partitions)
        plan = self.plan(partitions=partitions)
        if not self.has_keys:
            touched = self.files_with_deletions(plan.snapshot.deletions) if plan.snapshot and plan.snapshot.deletions else set()
            small = self.options.size("target-file-size") * 7 // 10
            plan.files = [f for f in plan.files if f["size"] < small or f["key"] in touched]
            if len(plan.files) < 2 and not any(f["key"] in touched for f in plan.files):
                return None
        if not plan.files:
            return None
        df = self.rows_of(plan)
        if not self.has_keys:
            df = df.select(*self.schema.fields.names)
            if self.options.number("bucket") == UNAWARE:
                df = df.coalesce(-(-sum(f["size"] for f in plan.files) // self.options.size("target-file-size")))
        changes = self.prepare(df, level=5, unique=self.has_keys)
        return dataclasses.replace(changes, deleted=plan.files, base=plan.snapshot)

    def _compact_level_0(self, partitions: list[dict] | None) -> Changes | None:
        """Level 0 merged with the older rows of its keys, which are marked."""
        s = self.snapshots.latest()
        plan = self.plan(partitions=partitions, every_level=True)
        new, old = ([f for f in plan.files if (f["level"] == 0) == first] for first in (True, False))
        if not new:
            return None
        keys, spec = self.schema.primary_keys, self.options.merge_spec(self.schema.primary_keys)
        rows, mark, marked = self.scan_files(new), None, []
        if old:
            below = self.positions(old, [*self.schema.fields.names, SEQ, KIND])
            if s.deletions:
                below = below.join(self.deleted_rows(s.deletions), ["key", "position"], "left_anti")
            below = below.join(rows.select(*keys).distinct(), keys, "left_semi")
            mark, marked = self.write_deletions(below)
            if mark:
                rows = rows.unionByName(below.drop("key", "position").select(*rows.columns))
        changes = self.prepare(merge(rows, spec).select(*[F.col(f"`{n}`") for n in self._all_names()]), level=5, unique=True)
        return dataclasses.replace(changes, deleted=new, deletions=mark, marked=marked, base=s)

    def analyze(self, columns: list[str] | None = None, **commit: Any) -> Snapshot | None:
        """Commit statistics of the rows of now: their number and, by column,
        distinct values (approximate), nulls, least and greatest (as text)."""
        names = columns or [f.name for f in self.schema.fields.fields if not is_nested(f.dataType)]
        df = self.read(names)
        aggs = [F.count("*").alias("n")]
        for i, n in enumerate(names):
            c = F.col(f"`{n}`")
            aggs += [F.approx_count_distinct(c).alias(f"d{i}"), F.count_if(c.isNull()).alias(f"z{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
        r = df.agg(*aggs).first()
        found = {n: {"distinct": r[f"d{i}"], "nulls": r[f"z{i}"], "min": r[f"l{i}"], "max": r[f"h{i}"]} for i, n in enumerate(names)}
        return self.commit(Changes(schema_id=self.schema.id, statistics={"rows": r["n"], "columns": found}), kind=ANALYZE, **commit)

    # ---- listing

    def partitions(self, **scan: Any) -> DataFrame:
        """Partitions with their numbers of rows, files and bytes."""
        s = self.starting_snapshot(scan.get("version"))
        live = M.live(M.read(self.spark, self.root, s.base + s.delta if s else []))
        keys = [F.col("partition")[k].cast(self.schema.fields[k].dataType).alias(k) for k in self.schema.partition_keys]
        return live.groupBy(*keys).agg(F.sum("row_count").alias("record_count"), F.count("*").alias("file_count"), F.sum("size").alias("file_size"))

    def create_branch(self, name: str, options: dict | None = None) -> LakeTable:
        """A branch of its own, with this table's schema and no rows."""
        root = f"{self.path}/branch/branch-{name}"
        first = TableSchema.from_json(self.schema.to_json())
        first.options = self.schema.options | (options or {})
        Schemas(self.fs, root).commit(first)
        return LakeTable(self.spark, self.path, name)

    def read_with_fallback(self, **how: Any) -> DataFrame:
        """Rows of this table, and those of the fallback branch in partitions
        that this table has not."""
        name = self.options.text("scan.fallback-branch")
        if not name:
            return self.read(**how)
        other, keys = LakeTable(self.spark, self.path, name), self.schema.partition_keys
        have = self.partitions().select(*[F.col(k).alias(f"__{k}") for k in keys])
        rest = other.read(**how)
        same = functools.reduce(lambda a, b: a & b, [rest[k].eqNullSafe(have[f"__{k}"]) for k in keys])
        return self.read(**how).unionByName(rest.join(have, same, "left_anti"))


def key_text(path: str) -> str:
    """A file's path below its data folder, which names it in metadata."""
    return re.sub(r"^.*/data/", "", path)


def key_of(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/data/", "")


def register_format(name: str, source: str) -> None:
    """Make a Spark data source a file format of tables. Row positions, and what
    needs them, stay with Parquet."""
    formats[name] = source


def partition_text(c: Column, kind: T.DataType) -> Column:
    """A partition value as text; instants in UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampType):
        seconds = (F.unix_micros(c).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
        c = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return c.cast("string")


#: Bytes of a value before any file shows how many it takes.
_ROW_BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.StringType: 20, T.BinaryType: 100, T.ArrayType: 100}
_WIDTHS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}


def _widens(a: T.DataType, b: T.DataType) -> bool:
    return type(a) in _WIDTHS and type(b) in _WIDTHS and _WIDTHS[type(a)] <= _WIDTHS[type(b)]


def bucketed(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A scan whose files have their bucket in the name, told to Spark: it reads a
    bucket in one task and knows that keys do not cross buckets, so that a merge by
    key needs no shuffle. Spark's hash of the keys is the one that rows were dealt by."""
    spark = df.sparkSession
    jvm, scan = spark._jvm, df._jdf.queryExecution().analyzed()
    relation = scan.relation()
    names = jvm.PythonUtils.toSeq(keys)
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(n, names, jvm.PythonUtils.toSeq([]))
    told = relation.copy(
        relation.location(), relation.partitionSchema(), relation.dataSchema(), jvm.scala.Option.apply(spec), relation.fileFormat(), relation.options(), relation.sparkSession()
    )
    plan = scan.copy(told, scan.output(), scan.catalogTable(), scan.isStreaming(), scan.stream())
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)

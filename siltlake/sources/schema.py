"""Table schemas: numbered versions with stable field ids, and their rules."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..functions.types import field_of, is_nested, show_field, with_ids
from .fs import Files
from .options import Options

#: Column names that tables keep for themselves (fixed values).
RESERVED = ("_SEQUENCE_NUMBER", "_VALUE_KIND", "_ROW_ID", "_INDEX_SCORE")


@dataclass
class TableSchema:
    id: int
    fields: T.StructType
    highest: int
    partition_keys: list[str] = field(default_factory=list)
    primary_keys: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    comment: str = ""
    millis: int = 0

    @classmethod
    def create(cls, fields: T.StructType, partition_keys=(), primary_keys=(), options=None, comment="") -> TableSchema:
        keys = set(primary_keys)
        strict = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in keys, f.metadata) for f in fields.fields])
        numbered, free = with_ids(strict)
        made = cls(0, numbered, free - 1, list(partition_keys), list(primary_keys), Options(options).given, comment, int(time.time() * 1000))
        made.validate()
        return made

    @property
    def trimmed_keys(self) -> list[str]:
        return [k for k in self.primary_keys if k not in self.partition_keys]

    def opts(self, extra: dict | None = None) -> Options:
        return Options(self.options, extra)

    def bucket_keys(self) -> list[str]:
        return self.opts().names("bucket-key") or self.trimmed_keys

    def validate(self) -> None:
        o, names = self.opts(), self.fields.names
        kinds = {f.name: f.dataType for f in self.fields.fields}

        def need(ok: bool, why: str) -> None:
            if not ok:
                raise ValueError(why)

        need(len(set(names)) == len(names), "duplicate columns")
        for label, keys in (("primary", self.primary_keys), ("partition", self.partition_keys), ("bucket", o.names("bucket-key"))):
            need(len(set(keys)) == len(keys), f"duplicate {label} keys")
            for k in keys:
                need(k in kinds, f"{label} key {k} is no column")
                need(not is_nested(kinds[k]), f"{label} key {k} is nested")
        for n in names:
            need(n not in RESERVED and not n.startswith("_KEY_"), f"column name {n} is reserved")
        engine, producer, bucket = o.text("merge-engine"), o.text("changelog-producer"), o.number("bucket")
        need(producer == "none" or bool(self.primary_keys), "a changelog producer needs a primary key")
        low, high = o.number("snapshot.num-retained.min"), o.number("snapshot.num-retained.max")
        need(1 <= low <= high, "snapshot.num-retained: 1 <= min <= max is needed")
        need(engine != "first-row" or producer in ("none", "lookup"), "first-row goes with no changelog producer but lookup")
        need(bucket > 0 or bucket in (-1, -2), "bucket must be positive, -1 or -2")
        if self.primary_keys:
            inside = set(self.partition_keys) <= set(self.primary_keys)
            need(inside or bucket == -1, "a primary key across partitions needs bucket -1")
            need(set(o.names("bucket-key")) <= set(self.primary_keys), "bucket keys must be primary keys")
        else:
            need(bucket != -1 or not o.names("bucket-key"), "a bucket key needs a fixed number of buckets")
            need(bucket <= 0 or bool(o.names("bucket-key")), "a bucketed append table needs a bucket key")
        if o.flag("deletion-vectors.enabled"):
            need(producer in ("none", "input", "lookup"), "deletion vectors do not go with this changelog producer")
            need(engine != "first-row", "deletion vectors do not go with first-row")
        need(not o.flag("data-evolution.enabled") or o.flag("row-tracking.enabled"), "data evolution needs row tracking")
        need(not o.flag("row-tracking.enabled") or not self.primary_keys, "row tracking is for tables without a primary key")
        spec = o.merge_spec(self.primary_keys)
        for s in (*spec.sequence, *(f for g, fs in spec.groups.items() for f in (*g, *fs)), *spec.aggregators):
            need(s in kinds, f"option names an unknown column {s}")
        for s in spec.sequence:
            need(s not in self.primary_keys, f"sequence field {s} is a primary key")
        need(not (spec.sequence and engine == "first-row"), "first-row takes no sequence field")

    def to_json(self) -> str:
        return json.dumps(
            {
                "version": 3, "id": self.id, "fields": [show_field(f) for f in self.fields.fields], "highestFieldId": self.highest,
                "partitionKeys": self.partition_keys, "primaryKeys": self.primary_keys, "options": self.options, "comment": self.comment, "timeMillis": self.millis,
            },
            indent=1,
        )

    @classmethod
    def from_json(cls, text: str) -> TableSchema:
        x = json.loads(text)
        fields = T.StructType([field_of(f) for f in x["fields"]])
        return cls(x["id"], fields, x["highestFieldId"], x["partitionKeys"], x["primaryKeys"], x["options"], x.get("comment") or "", x["timeMillis"])

    # changes give a new version; columns keep their ids
    def _next(self, fields: list[T.StructField], highest: int | None = None, options: dict | None = None, rename: dict[str, str] | None = None) -> TableSchema:
        turn = lambda names: [(rename or {}).get(n, n) for n in names]
        made = TableSchema(
            self.id + 1, T.StructType(fields), self.highest if highest is None else highest, turn(self.partition_keys), turn(self.primary_keys),
            self.options if options is None else options, self.comment, int(time.time() * 1000),
        )
        made.validate()
        return made

    def add_column(self, name: str, kind: T.DataType, comment: str = "") -> TableSchema:
        (new,), free = with_ids(T.StructType([T.StructField(name, kind, True, {"comment": comment} if comment else {})]), self.highest + 1)
        return self._next([*self.fields.fields, new], free - 1)

    def drop_column(self, name: str) -> TableSchema:
        if name in (*self.partition_keys, *self.primary_keys):
            raise ValueError(f"cannot drop the key column {name}")
        return self._next([f for f in self.fields.fields if f.name != name])

    def rename_column(self, name: str, new: str) -> TableSchema:
        if name in self.partition_keys:
            raise ValueError(f"cannot rename the partition column {name}")
        return self._next([T.StructField(new, f.dataType, f.nullable, f.metadata) if f.name == name else f for f in self.fields.fields], rename={name: new})

    def change_type(self, name: str, kind: T.DataType) -> TableSchema:
        if name in self.partition_keys:
            raise ValueError(f"cannot change the partition column {name}")
        return self._next([T.StructField(f.name, kind, f.nullable, f.metadata) if f.name == name else f for f in self.fields.fields])

    def reorder(self, names: list[str]) -> TableSchema:
        if sorted(names) != sorted(self.fields.names):
            raise ValueError("reorder must name every column once")
        return self._next([self.fields[n] for n in names])

    def set_options(self, **options: str) -> TableSchema:
        return self._next(self.fields.fields, options={**self.options, **Options({k.replace("__", "."): v for k, v in options.items()}).given})


class Schemas:
    """The schema files of a table (or branch)."""

    def __init__(self, files: Files, root: str):
        self.files, self.dir = files, f"{root}/schema"

    def ids(self) -> list[int]:
        return sorted(int(i.name.split("-")[1]) for i in self.files.list(self.dir) if i.name.startswith("schema-"))

    def read(self, version: int) -> TableSchema:
        return TableSchema.from_json(self.files.read(f"{self.dir}/schema-{version}"))

    def latest(self) -> TableSchema | None:
        ids = self.ids()
        return self.read(ids[-1]) if ids else None

    def commit(self, schema: TableSchema) -> None:
        self.files.mkdirs(self.dir)
        if not self.files.publish(f"{self.dir}/schema-{schema.id}", schema.to_json()):
            raise RuntimeError(f"schema {schema.id} was written by someone else")

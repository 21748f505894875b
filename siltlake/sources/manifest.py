"""Manifests: Parquet tables of added and deleted data files.

Planning is a DataFrame over them: partition, bucket and level filters are pushed
to the manifest scan, deletions are an anti join, and only the files that are left
reach the driver, where their statistics are tested.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADD, DELETE = 0, 1
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in {
            "kind": T.ByteType(), "key": T.StringType(), "path": T.StringType(), "format": T.StringType(), "partition": _TEXT_MAP, "bucket": T.IntegerType(),
            "total_buckets": T.IntegerType(), "level": T.IntegerType(), "schema_id": T.IntegerType(), "row_count": T.LongType(), "size": T.LongType(),
            "min_sequence": T.LongType(), "max_sequence": T.LongType(), "first_row_id": T.LongType(), "write_cols": T.ArrayType(T.StringType()),
            "delete_count": T.LongType(), "unique_keys": T.BooleanType(), "low": _TEXT_MAP, "high": _TEXT_MAP, "nulls": T.MapType(T.StringType(), T.LongType()),
            "snapshot_id": T.LongType(), "blob": T.BooleanType(),
        }.items()
    ]
)
#: Values longer than this get no bounds in the statistics.
LONGEST_BOUND = 64


def write(spark: SparkSession, root: str, entries: Iterable[dict[str, Any]]) -> str:
    name = f"manifest/manifest-{uuid.uuid4().hex}"
    rows = [tuple(e.get(f.name) for f in SCHEMA.fields) for e in entries]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/{name}")
    return name


def read(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{root}/{n}" for n in names])


def live(entries: DataFrame, where: Column | None = None) -> DataFrame:
    """Added files that no entry deletes."""
    if where is not None:
        entries = entries.filter(where)
    gone = entries.filter(F.col("kind") == DELETE).select("key")
    return entries.filter(F.col("kind") == ADD).join(gone, "key", "left_anti")


def as_entry(row: Row, **change: Any) -> dict[str, Any]:
    return row.asDict() | change

"""Blobs: binary values held inline, or as descriptors of a part of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCRIPTOR = "struct<uri:string,offset:bigint,length:bigint>"
#: Distinct files that one fetch may name.
MAX_URIS = 100_000


def descriptor(uri: Column, offset: Column | int = 0, length: Column | int = -1) -> Column:
    """A reference to bytes of a file; a length of -1 runs to its end."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(uri.alias("uri"), lit(offset).cast("bigint").alias("offset"), lit(length).cast("bigint").alias("length"))


def fetch(df: DataFrame, column: str, to: str) -> DataFrame:
    """Add column ``to`` with the bytes that the descriptors name."""
    uris = [r[0] for r in df.select(f"{column}.uri").filter(F.col("uri").isNotNull()).distinct().limit(MAX_URIS + 1).collect()]
    if len(uris) > MAX_URIS:
        raise ValueError(f"more than {MAX_URIS} files")
    if not uris:
        return df.withColumn(to, F.lit(None).cast("binary"))
    norm = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = df.sparkSession.read.format("binaryFile").load(uris).select(norm(F.col("path")).alias("__at"), F.col("content").alias("__bytes"))
    d = F.col(column)
    size = F.when(d["length"] < 0, F.octet_length("__bytes")).otherwise(d["length"]).cast("int")
    cut = F.substring(F.col("__bytes"), (d["offset"] + 1).cast("int"), size)
    return df.join(files, norm(d["uri"]) == F.col("__at"), "left").withColumn(to, cut).drop("__at", "__bytes")

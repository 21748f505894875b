"""Sharding by jump consistent hashing.

Native. A stable key and the shard count decide the shard; there is no ring
table, and appending a shard moves rows only into it. The 64-bit generator runs
on decimals modulo 2**64, since long arithmetic fails on overflow in ANSI mode.

Defined results: a null id is the key "" ; a null text has no bytes and the
checksum of the empty string; equal keys share a shard; repeated rows get slots
of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, staged

#: Multiplier of the generator in the published algorithm (fixed value).
MULTIPLIER = 2862933555777941757
SHARDS = 24
#: Each shard is numbered in so many parts side by side.
SUB_BUCKETS = 256
#: Part offsets up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_PARTS = 200_000


def key_hash(key: Column) -> Column:
    """60 bits of md5 of the key's text, so that any key type is well mixed."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """Shard of a hashed key (decimal) among ``shards``. Each step jumps ahead by
    at least one shard, so ``shards`` steps always end the walk."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    two64, two33 = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("8589934592").cast("decimal(38,0)")
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), key.cast("decimal(20,0)").alias("k"))

    def step(s: Column, _: Column) -> Column:
        grown = (s["k"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(1)
        k = (grown.cast("decimal(38,0)") % two64).cast("decimal(20,0)")
        top = ((k - k % two33) / two33).cast("double") + F.lit(1.0)
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / top)).cast("long")
        on = s["j"] < shards
        return F.struct(
            F.when(on, s["j"]).otherwise(s["b"]).alias("b"), F.when(on, j).otherwise(s["j"]).alias("j"), F.when(on, k).otherwise(s["k"]).alias("k")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, sub_buckets: int = SUB_BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot (gapless in a shard).

    Numbering is two-level: rows are numbered inside (shard, part), parts get
    offsets from their counts, so no shard is gathered in one task. A part follows
    from the id and the text, so rows that share an id are spread too.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = key_hash(id_text(F.col(id_col)))
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
            F.md5(id_text(F.col(id_col))).alias("digest"), key.alias("key"),
        ).select(
            "doc_id", "size", "text_crc32", jump(F.col("key"), shards).alias("shard"), jump(F.col("key"), shards + 1).alias("grown_shard"),
            F.pmod(F.conv(F.substring("digest", 25, 8), 16, 10).cast("long") + F.col("text_crc32"), F.lit(sub_buckets)).cast("int").alias("part"),
        ),
        "shards",
    )
    parts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("shard", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    if shards * sub_buckets <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("__n", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("offset") + F.col("__n")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 256 << 20) -> None:
    """Write whole rows under ``path`` in one folder per shard (``shard=N``), in files
    of about ``file_bytes`` of text: their number follows from the texts' bytes."""
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("n")).first()["n"] or 0
    placed = docs.withColumn("shard", jump(key_hash(id_text(F.col(id_col))), shards))
    spread = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(max(1, -(-size // (shards * file_bytes)))))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)

"""Binary token files: ids of whole texts, range-coded in frames, in id order.

Writing: texts are encoded once into a staged table; its ids are counted over
the whole corpus into one shared frequency table (bounded by the vocabulary);
rows are range-partitioned and sorted by document id, and each task codes its
run of documents into frames. A frame holds whole documents, so it is bounded by
FRAME ids or one document. Reading: frames decode independently, and their
places follow from the frames' own counts.

Files under a path: ``table`` (symbol, freq, scale) and ``frames`` (part, frame,
doc_ids, doc_tokens, n_tokens, payload), in Spark's Parquet container, so any
shared store will do.

Defined results: a null text is empty and has the end id alone; repeated ids are
neighbours, in order of their ids' bytes; a null id comes first; an empty table
gives empty files and an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .bpe import small_batches
from .common import release, staged, tidy_shuffles
from .pretokens import encoder

END_ID = 0
FRAME = 1 << 21
#: Largest table that is sent to every executor, in symbols.
MAX_SYMBOLS = 1 << 22


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the ids of each whole text with the end id, as
    compressed little-endian unsigned 32-bit numbers."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, codec = encoder(vocabulary), pa.Codec("zstd", compression_level=1)
        for b in small_batches(batches, "text"):
            ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in enc.encode(b.column("text").to_pylist())]
            packed = [codec.compress(_planes(x), asbytes=True) for x in ids]
            sizes = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def _planes(ids: np.ndarray) -> bytes:
    """Bytes of the ids by significance: compresses better than as they lie."""
    return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(packed: bytes, n: int, codec: pa.Codec) -> np.ndarray:
    raw = codec.decompress(packed, 4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").reshape(-1)


def frequency_table(tokens: DataFrame) -> rans.FrequencyTable:
    """Counts of all ids of the corpus, summed per task, then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, total = pa.Codec("zstd"), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def added() -> np.ndarray:
            # many documents at once, as each count is as long as the vocabulary
            got = np.bincount(np.concatenate(held))
            held.clear()
            short, long = sorted((got, total), key=len)
            long[: len(short)] += short
            return long

        size = 0
        for b in batches:
            for packed, n in zip(b.column("ids").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                held.append(_unpacked(packed, n, codec))
                size += n
                if size >= FRAME:
                    total, size = added(), 0
        if held:
            total = added()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["symbol", "n"])

    counts = tokens.mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    rows = counts.limit(MAX_SYMBOLS + 1).toArrow()
    if rows.num_rows > MAX_SYMBOLS:
        raise ValueError(f"more than {MAX_SYMBOLS} symbols")
    return rans.FrequencyTable.from_counts(rows.column("symbol").to_numpy(), rows.column("n").to_numpy())


def write_tokens(docs: DataFrame, path: str, vocabulary: str, **how) -> None:
    """Write the token files of ``docs`` under ``path``."""
    spark = docs.sparkSession
    tokens = staged(tokenize(docs, vocabulary, **how), "token-ids", compression="uncompressed")
    table = frequency_table(tokens)
    shape = pa.table({"symbol": table.symbols, "freq": table.freq, "scale": np.full(len(table.symbols), table.scale, np.int64)})
    spark.createDataFrame(shape).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((table.symbols, table.freq, table.scale))
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    arrow_id = pa.array([], type=tokens.select("doc_id").limit(0).toArrow().schema.field("doc_id").type).type

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codec, part = rans.FrequencyTable(*shared.value), pa.Codec("zstd"), TaskContext.get().partitionId()
        names, ids, held, frame = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            payload = rans.encode(np.concatenate(ids), own)
            arrays = [
                pa.array([part], pa.int32()),
                pa.array([frame], pa.int32()),
                pa.array([names], pa.list_(arrow_id)),
                pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                pa.array([held], pa.int64()),
                pa.array([payload], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "frame", "doc_ids", "doc_tokens", "n_tokens", "payload"])

        for b in batches:
            for name, n, packed in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")), strict=True):
                names.append(name)
                ids.append(_unpacked(packed, n, codec))
                held += n
                if held >= FRAME:
                    yield flush()
                    names, ids, held, frame = [], [], 0, frame + 1
        if names:
            yield flush()

    placed = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    frames = placed.mapInArrow(code, f"part int, frame int, doc_ids array<{id_type}>, doc_tokens array<long>, n_tokens long, payload binary")
    with tidy_shuffles(spark):
        frames.write.option("compression", "uncompressed").parquet(f"{path}/frames")
    release(tokens)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 and, if asked for, ids as little-endian bytes."""
    rows = spark.read.parquet(f"{path}/table").orderBy("symbol").limit(MAX_SYMBOLS).toArrow()
    scale = rows.column("scale")[0].as_py() if rows.num_rows else 20
    shared = spark.sparkContext.broadcast((rows.column("symbol").to_numpy(), rows.column("freq").to_numpy(), scale))
    frames = spark.read.parquet(f"{path}/frames")
    id_type = frames.schema["doc_ids"].dataType.elementType.simpleString()

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rans.FrequencyTable(*shared.value)
        for b in batches:
            for k in range(b.num_rows):
                ids = rans.decode(b.column("payload")[k].as_py(), own).astype("<u4", copy=False)
                names, sizes = b.column("doc_ids")[k].values, np.array(b.column("doc_tokens")[k].as_py(), np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("the frame's documents do not add up to its ids")
                texts = [ids[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                fill = lambda c: pa.array(np.full(len(sizes), b.column(c)[k].as_py()), pa.int32())
                arrays = [
                    fill("part"), fill("frame"), names, pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                ]
                out = ["part", "frame", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays, out = [*arrays, pa.array(texts, pa.binary())], [*out, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=out)

    docs = frames.select("part", "frame", "doc_ids", "doc_tokens", "payload").mapInArrow(
        restore, f"part int, frame int, doc_id {id_type}, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    )
    # a frame begins after the earlier parts, and the earlier frames of its own
    sizes = frames.select("part", "frame", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    inner = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("frame"))), F.lit(0))
    starts = sizes.withColumn("inner", inner).join(parts, "part").select("part", "frame", (F.col("part_start") + F.col("inner")).alias("frame_start"))
    return docs.join(starts, ["part", "frame"]).select(
        "doc_id", (F.col("frame_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )

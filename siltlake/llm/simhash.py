"""SimHash near-duplicates with a pigeonring filter.

Fingerprints of whole texts; equal ones are joined first, so exact copies cost
one row. Fingerprints link at ``distance`` or fewer differing bits. With the bits
dealt over m segments in a ring, a pair within distance t has a start from which
every chain of l segments differs in at most l * t / m bits (the strong form of
the pigeonring principle). For t = 2 and m = 5 the budgets are 0, 0, 1, 1, 2: two
consecutive segments agree, which is the index key (five keys of 25 or 26 bits
for each fingerprint), and the chain is checked as it grows, before the full
Hamming distance.

Buckets with more than BUCKET fingerprints are keyed anew by the chain of four
segments with one bit of the third and fourth left out: their pairs differ there
in at most one bit, so no link is lost, and what is left free bounds such a
bucket to 2**14 fingerprints. Inside a bucket links are found in blocks and only
a spanning forest leaves it. Components come from star contraction.

Defined results: null and empty texts have fingerprint 0, linked like any other;
repeated rows share a component; the component of documents without any id is
null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import keep_least, release, staged, text_digest
from .components import components

BITS, SHINGLE, SEED, DISTANCE, SEGMENTS = 64, 3, 42, 2, 5
#: Most fingerprints in a bucket before its key is made longer.
BUCKET = 4096
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the text's words, A-Z lower-cased."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    grams = zip(*(words[k:] for k in range(size)), strict=False)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in map(b" ".join, grams)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id, the columns ``more`` and fp (the fingerprint's bits as a signed long)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *more, F.col(text_col).cast("string").alias("text"))
    fields = rows.columns[:-1]
    kinds = "".join(f"{f} {rows.schema[f].dataType.simpleString()}, " for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 16_000_000):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(shingle_hashes(t or b"")) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(b.column, fields), pa.array(found, pa.int64())], names=[*fields, "fp"])

    return rows.mapInArrow(run, f"{kinds}fp long")


def segments(m: int = SEGMENTS, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each segment."""
    edges = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(parts: list[tuple[int, int]]) -> int:
    return sum(((1 << n) - 1) << a for a, n in parts)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_masks(distance: int, m: int) -> list[list[tuple[int, int]]]:
    """For each start: (mask, budget) of the chains of 1 to m segments."""
    ring = segments(m)
    return [[(_mask([ring[(i + k) % m] for k in range(n)]), n * distance // m) for n in range(1, m + 1)] for i in range(m)]


def _exact(distance: int, m: int) -> int:
    """Segments that a chain's budgets need to agree."""
    return max(n for n in range(1, m + 1) if n * distance // m == 0)


def bucket_rows(fps: DataFrame, distance: int = DISTANCE, m: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """start, part, key, fp: candidates share the first three. ``part`` is -1
    where the key is that of the exact chain, else the bit that is left out."""
    if distance >= m:
        raise ValueError("more segments than the distance are needed")
    masks = chain_masks(distance, m)
    exact = _exact(distance, m)
    keys = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(c[exact - 1][0]))).alias("key")) for i, c in enumerate(masks)])
    rows = staged(fps.select("fp", F.explode(keys).alias("k")).select("k.start", "k.key", "fp"), "simhash-keys")
    hot = staged(rows.groupBy("start", "key").count().filter(F.col("count") > bucket).select("start", "key"), "simhash-hot")
    plain = F.lit(-1).alias("part")
    if hot.isEmpty():
        return _staged_in(rows.select("start", plain, "key", "fp"), rows, hot)
    # the chain up to the last with a budget of one or none, one of its later bits left out
    longest = max(n for n in range(1, m + 1) if n * distance // m <= 1)
    ring, out = segments(m), []
    for i, c in enumerate(masks):
        later = [a + x for k in range(exact, longest) for a, n in [ring[(i + k) % m]] for x in range(n)]
        whole = c[longest - 1][0]
        longer = [F.struct(F.lit(x).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(whole & ~(1 << x)))).alias("key")) for x in later]
        out.append(F.when(F.col("start") == i, F.array(*longer)))
    cold = rows.join(hot, ["start", "key"], "left_anti").select("start", plain, "key", "fp")
    warm = rows.join(hot, ["start", "key"], "left_semi").select("start", F.explode(F.coalesce(*out)).alias("k"), "fp")
    return _staged_in(cold.union(warm.select("start", "k.part", "k.key", "fp")), rows, hot)


def _staged_in(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df`` with the staged tables that it reads, to be released after it."""
    df.staged_tables = tables
    return df


def links(x: np.ndarray, chain: list[tuple[int, int]], distance: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of a bucket's fingerprints that pass the chain's budgets and
    then the full distance, block by block."""
    for lo in range(0, len(x), block):
        for hi in range(lo, len(x), block):
            diff = x[lo : lo + block, None] ^ x[None, hi : hi + block]
            i, j = np.nonzero(np.triu(np.ones(diff.shape, bool), 1)) if lo == hi else np.nonzero(np.ones(diff.shape, bool))
            d = diff[i, j]
            for mask, budget in chain[1:]:
                on = np.bitwise_count(d & np.uint64(mask)) <= budget
                i, j, d = i[on], j[on], d[on]
            on = np.bitwise_count(d) <= distance
            yield lo + i[on], hi + j[on]


def forest(x: np.ndarray, chain: list[tuple[int, int]], distance: int) -> list[tuple[int, int]]:
    """A spanning forest of a bucket's links, as (node, smallest of its tree)."""
    x = np.unique(x)
    if len(x) < 2:
        return []
    parent = list(range(len(x)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links(x, chain, distance):
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(p), root(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
    roots = [root(i) for i in range(len(x))]
    return [(int(x[i]), int(x[r])) for i, r in enumerate(roots) if r != i]


def link_edges(buckets: DataFrame, distance: int = DISTANCE, m: int = SEGMENTS) -> DataFrame:
    """Edges a, b of spanning forests of the buckets."""
    masks = chain_masks(distance, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def close() -> list[tuple[int, int]]:
            return forest(np.concatenate(held).view(np.uint64), masks[name[0]], distance) if held and sum(map(len, held)) > 1 else []

        for b in batches:
            if not b.num_rows:
                continue
            start, part, key, fp = (b.column(c).to_numpy() for c in ("start", "part", "key", "fp"))
            edge = np.flatnonzero((start[1:] != start[:-1]) | (part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate([[0], edge, [len(fp)]])
            found: list[tuple[int, int]] = []
            # groups of one row, inside the batch, link nothing
            for g in range(len(bounds) - 1):
                lo, hi = int(bounds[g]), int(bounds[g + 1])
                if 0 < g < len(bounds) - 2 and hi - lo == 1:
                    continue
                new = (int(start[lo]), int(part[lo]), int(key[lo]))
                if new != name:
                    found += close()
                    name, held = new, []
                held.append(fp[lo:hi])
            yield _edges(found)
        yield _edges(close())

    def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    placed = buckets.repartition("start", "part", "key").sortWithinPartitions("start", "part", "key")
    return placed.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id, the columns ``more``, fp, component (the smallest fp reachable over
    links) and component_id (the smallest id reachable) of every row."""
    rows = staged(fingerprints(docs, id_col, text_col, *more), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    buckets = bucket_rows(fps.select("fp"), distance)
    found = components(link_edges(buckets, distance))
    release(*buckets.staged_tables)
    named = fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("component"), "least")
    named = staged(named, "named")
    label = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = staged(named.select("fp", "component").join(label, "component").select("fp", "component", "component_id"), "labels")
    release(fps, named)
    return rows.join(label, "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id
    reachable over links."""
    got = groups(docs, distance, id_col, text_col)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id, no id last."""
    got = groups(docs, distance, id_col, text_col, text_digest(text_col).alias("digest"))
    return keep_least(docs, got.select("doc_id", "digest", "component"), id_col, text_col)

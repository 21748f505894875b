"""SimHash near-dedup at a similarity: texts whose sets of five-word shingles have
a Jaccard similarity of 0.8 or more, found exactly.

First comes the method of op6 on five words: 64-bit SimHashes of the sets, the
pigeonring index over them at two bits, and star contraction of what whole sets
confirm. A 64-bit SimHash cannot find the rest: such pairs differ in up to two dozen
bits, where no index key is left. So sets keep a longer fingerprint besides, a parity
sketch: bit i tells whether an odd number of the set's shingles hash to i. Sets
that differ in d shingles differ in at most d bits, and similar sets of x and y
shingles differ in at most (x + y) / 9 shingles, so the filter loses no link. As
with the SimHash, segments of the sketch form a ring, and a pair within t bits has
a start from which every chain of l of m segments differs in at most l * t / m
bits: chains are checked as they grow, before the full Hamming distance, and whole
sets are compared after it, in whole numbers.

Candidates share a key. Shingles are ordered by their number in a bounded sample
of documents, rare ones first; the order decides the cost, never the result. Of n
shingles the first n - ceil(0.8 n) + 1 are a set's keys: two sets that are similar
enough share one. Equal sets are joined first, so copies cost one row. Each key's
sets are compared with the one whose keys are shared most, unless the SimHashes have
linked the two, and what that links is contracted; then the sets under a key that are
not of one component yet.

Defined results: null and empty texts, and those of white space, are copies of
each other; shorter texts have one shingle; shingles and sets are told apart by
XXH64; rows that agree in id and text are copies; rows without an id keep one row
of each group that has no other; an empty table gives an empty table; other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import keep_least, release, staged, text_digest
from .components import components
from .simhash import SEED, bucket_rows, fingerprint, link_edges, shingle_hashes

#: Words of a shingle, and the similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Documents that the order of shingles is taken from, and shingles ranked by it.
SAMPLE, RANKED = 4000, 50_000
#: Bits of the filter that picks the documents to compare.
FILTER_BITS = 24
#: Least bits of a sketch, and segments of it.
SKETCH_LEAST, SEGMENTS = 64, 8
#: Sets of a key that are compared with each other in one place; more go by blocks.
BLOCK = 1024


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def set_number(shingles: np.ndarray) -> int:
    """A set's number, as a signed long."""
    return _signed(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _texts(rows: DataFrame, schema: str, make: Callable[[], Callable[[bytes], tuple | None]]) -> DataFrame:
    """A row of ``schema`` for each text, after its row's other columns."""
    fields = [f for f in rows.columns if f != "text"]
    head = "".join(f"{f} {rows.schema[f].dataType.simpleString()}, " for f in fields)
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*[(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in small_batches(batches, "text", 8_000_000):
            found = [of(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
            on = [k for k, f in enumerate(found) if f is not None]
            cols = [b.column(f).take(pa.array(on, pa.int64())) for f in fields]
            cols += [pa.array([found[k][c] for k in on], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(cols, names=[*fields, *names])

    return rows.mapInArrow(run, head + schema)


def common_shingles(rows: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of the sample have, in order, and how many."""
    n = rows.count()
    some = rows.select("text") if n <= SAMPLE else rows.select("text").sample(SAMPLE / n, 7)
    sets = _texts(some, "s array<long>", lambda: lambda t: (shingle_set(t, size).view(np.int64),))
    many = sets.select(F.explode("s").alias("s")).groupBy("s").count().filter("count > 1")
    got = many.orderBy(F.desc("count"), "s").limit(RANKED).toArrow()
    s, c = got.column("s").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(s)
    return s[order], c[order]


def keys_of(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles, rare ones first."""
    n, (up, down) = len(shingles), SIMILAR
    if not n:
        return shingles
    count = np.zeros(n, np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        count = np.where(common[0][at] == shingles, common[1][at], 0)
    return shingles[np.lexsort((shingles, count))[: n + (-up * n // down) + 1]]


def parity_sketch(shingles: np.ndarray) -> bytes:
    """One bit and a bit for each shingle: whether those that fall on it are odd."""
    bits = SKETCH_LEAST
    while bits < len(shingles):
        bits *= 2
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch as it would be with ``size`` bytes: the parity of bits that agree
    in their place."""
    bits = np.unpackbits(sketch).reshape(-1, 8 * size)
    return np.packbits(np.bitwise_xor.reduce(bits, axis=0))


def may_be_similar(x: np.ndarray, x_n: int, ys: np.ndarray, ys_n: np.ndarray, m: int = SEGMENTS) -> np.ndarray:
    """Pigeonring filter of one set against others, whose sketches are rows as wide
    as its own: chains of segments within their budgets, then the whole distance.
    False only where the sets are not similar enough."""
    up, down = SIMILAR
    t = (x_n + ys_n) * (down - up) // (up + down)
    parts = np.bitwise_count(ys ^ x).reshape(len(ys), m, -1).sum(axis=2, dtype=np.int64)
    upto = np.concatenate([np.zeros((len(ys), 1), np.int64), np.cumsum(np.concatenate([parts, parts], axis=1), axis=1)], axis=1)
    on = (x_n * down >= ys_n * up) & (ys_n * down >= x_n * up)
    starts = np.repeat(on[:, None], m, axis=1)
    for n in range(1, m + 1):
        starts &= m * (upto[:, n : n + m] - upto[:, :m]) <= n * t[:, None]
    return starts.any(axis=1)


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of sets that link all whose SimHashes are reachable at op6's distance:
    sets of one fingerprint with the first of them, and forests of its buckets."""
    heads = staged(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprint-heads")
    buckets = bucket_rows(heads.select("fp"))
    one = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    edges = link_edges(buckets).distinct().join(one("a"), "a").join(one("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    same = nodes.select("fp", "node").join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    pairs = staged(edges.union(same), "simhash-pairs")
    release(heads, *buckets.staged_tables)
    return pairs


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b whose sizes and sketches allow that they are similar enough."""
    one = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))

    def fits(x: bytes, x_n: int, y: bytes, y_n: int) -> bool:
        size = min(len(x), len(y))
        x, y = (folded(np.frombuffer(v, np.uint8), size) for v in (x, y))
        return bool(may_be_similar(x, x_n, y[None, :], np.array([y_n]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("a_sketch", "a_n", "b_sketch", "b_n")]
            on = pa.array([fits(*row) for row in zip(*cols, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(on)

    return pairs.join(one("a"), "a").join(one("b"), "b").mapInArrow(run, "a long, b long")


def _cell_pairs(node: np.ndarray, root: np.ndarray, block: np.ndarray, n: np.ndarray, sketch: list[bytes], apart: bool) -> list[tuple[int, int]]:
    """Pairs of a cell's sets that may be similar and are not of one component;
    ``apart``: of different blocks only."""
    order = np.argsort(n, kind="stable")
    node, root, block, n, sketch = node[order], root[order], block[order], n[order], [sketch[k] for k in order]
    folds: dict[int, np.ndarray] = {}
    out = []
    for k in range(len(node)):
        width, end = len(sketch[k]), int(np.searchsorted(n, n[k] * SIMILAR[1] // SIMILAR[0], side="right"))
        if end <= k + 1:
            continue
        if width not in folds:
            folds[width] = np.stack([folded(np.frombuffer(v, np.uint8), width) if len(v) >= width else np.zeros(width, np.uint8) for v in sketch])
        on = (root[k + 1 : end] != root[k]) & ((block[k + 1 : end] != block[k]) if apart else True)
        at = k + 1 + np.flatnonzero(on)
        at = at[may_be_similar(folds[width][k], int(n[k]), folds[width][at], n[at])] if len(at) else at
        out += [(min(node[k], x), max(node[k], x)) for x in node[at].tolist()]
    return out


def _within_keys(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a, b of sets under a key that may be similar and are not of one
    component. A key with many sets is cut into blocks, and each pair of blocks is
    a cell of its own: no key is one task, and only plausible pairs leave a cell."""
    # keys of the same sets, as a passage that these share has many, are looked at once
    same = ("n", "x", "y")
    sizes = mixed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    sizes = sizes.groupBy(*same).agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = mixed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.select("key", "node", "root", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", "node", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).join(nodes.select("node", "n", "sketch"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            one = lambda c: t.column(c).to_numpy()
            found = _cell_pairs(*map(one, ("node", "root", "block", "n")), t.column("sketch").to_pylist(), name[1] != name[2]) if t.num_rows > 1 else []
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            names = np.stack([b.column(c).to_numpy() for c in ("key", "lo", "hi")])
            edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for at, end in zip(edges, edges[1:], strict=False):
                new = tuple(names[:, at].tolist())
                if new != name:
                    if held:
                        yield close()
                    name, held = new, []
                held.append(b.slice(at, end - at))
        if held:
            yield close()

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def _sets(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node and s, the shingles, of the sets whose texts have the digests in
    ``wanted``, and of a few others: a filter of bounded size picks the texts."""
    bit = F.conv(F.substring("digest", 1, FILTER_BITS // 4), 16, 10).cast("long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))
    got = wanted.select(F.shiftright(bit, 5).alias("w"), one.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[got.column("w").to_numpy()] = got.column("v").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def chosen() -> Callable[[bytes], tuple | None]:
        bits, seen = shared.value, set()

        def of(text: bytes) -> tuple | None:
            at = int(hashlib.md5(text).hexdigest()[: FILTER_BITS // 4], 16)
            if not int(bits[at >> 5]) >> (at & 31) & 1:
                return None
            s = shingle_set(text, size)
            if (node := set_number(s)) in seen:
                return None
            seen.add(node)
            return node, s.view(np.int64)

        return of

    return _texts(docs.select("text"), "node long, s array<long>", chosen)


def _compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Of plausible pairs a, b those whose sets are similar enough, as edges."""
    up, down = SIMILAR
    near = staged(pairs, "plausible-pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = staged(wanted.join(nodes, "node").select("node", "digest"), "texts-to-compare")
    sets = _sets(texts.select("digest"), docs, size).join(texts.select("node"), "node").dropDuplicates(["node"])
    sets = staged(sets, "sets-to-compare")
    one = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    enough = (up + down) * both >= up * (F.size("s_a") + F.size("s_b"))
    links = staged(near.join(one("b"), "b").join(one("a"), "a").filter(enough).select("a", "b"), "set-links")
    release(near, texts, sets)
    return links


def similar_sets(docs: DataFrame, keys: DataFrame, nodes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """node and root of each set that has a similar one. ``docs`` has text; ``keys``
    has key, node and n, for each text; ``nodes`` has node, n, sketch and the digest
    of a text, once for each set, and its SimHash fp."""
    near = simhash_pairs(nodes)
    linked = staged(components(_compared(_plausible(near, nodes), nodes, docs, size)), "simhash-components")
    release(near)
    # counts are taken before the shuffle, and joined: no key's rows need meet in one task
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).filter("low <> high")
    under = keys.join(shared.select("key", "size"), "key").distinct().join(linked, "node", "left")
    under = staged(under.withColumn("root", F.coalesce("root", "node")), "shared-keys")
    # a set whose keys are shared most stands in the middle of its copies
    rank = under.groupBy("node").agg((F.count("*") / F.first("n")).alias("share"), F.sum("size").alias("total"))
    middle = F.max(F.struct("share", "total", "node", "root"))
    hub = under.select("key", "node", "root").join(rank, "node").groupBy("key").agg(middle["node"].alias("a"), middle["root"].alias("a_root"))
    first = under.select("key", "node", "root").join(hub, "key").filter(F.col("a_root") != F.col("root"))
    first = staged(first.select("a", F.col("node").alias("b")).distinct(), "hub-pairs")

    more = _compared(_plausible(first, nodes), nodes, docs, size)
    found = staged(components(more.union(linked.select("node", "root"))), "hub-components")
    release(linked)
    named = under.drop("root").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    mixed = staged(named.join(mixed, "key"), "mixed-keys")
    release(under)
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = staged(_within_keys(mixed, nodes).join(done, ["a", "b"], "left_anti"), "other-pairs")
    more = None if rest.isEmpty() else _compared(rest, nodes, docs, size)
    release(mixed, first, rest)
    if more is None or more.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, digest (of the text) and component of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, size))

    def keyed() -> Callable[[bytes], tuple]:
        ranks = common.value

        def of(text: bytes) -> tuple:
            s = shingle_set(text, size)
            return set_number(s), len(s), _signed(fingerprint(s)), parity_sketch(s), keys_of(s, ranks).view(np.int64)

        return of

    found = staged(_texts(rows, "node long, n int, fp long, sketch binary, keys array<long>", keyed), "shingle-keys")
    nodes = staged(found.groupBy("node").agg(F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("sketch").alias("sketch"), F.min("digest").alias("digest")), "sets")
    roots = staged(similar_sets(rows, found.select(F.explode("keys").alias("key"), "node", "n"), nodes, size), "roots")
    release(nodes)
    return found.join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return keep_least(docs, groups(docs, id_col, text_col), id_col, text_col)

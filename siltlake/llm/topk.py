"""Exact top-k search by inner product with dual cover trees.

A bounded sample of rows, larger where there are more rows, gives the two top levels
of a cover tree: its points are taken farthest first, so the first C of them are nested
centres as far apart as their covering radius, and the rest stand below the nearest of
these. Every row goes to its nearest centre, and there to the nearest point: a cell.
Cells are packed or split into blocks of bounded size, for queries and for candidates.
Each query gets a sure lower bound of its kth score from the sample. A query block
meets a candidate block unless for all their cells the bound over centres,

    <q, x>  <=  <cq, cx> + |cx| rq + |cq| rx + rq rx,

is below the worst of these kth scores of the query cell. The pairs of blocks are a
table; a task takes a candidate block, whose tree it builds once, and some of the query
blocks that meet it. Inside both sides are trees of nested centres with covering radii,
and node pairs are pruned the same way against each query node's worst kth score so
far. All comparisons keep ties, so the result is exact.

Defined results: a query leaves out its own row only, so another row of its id is a
candidate, and each of several query rows of an id has ranks of its own; vectors that
are null or hold null or non-finite components take no part, nor do rows with a null
id; components of 2**28 / scale or more are refused, as scores would not fit a long;
missing components of a shorter vector count as 0; equal scores go to the smaller id;
with fewer than k candidates all are returned; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged

K, SCALE = 5, 256
#: Least and most centres of the first level, and points of both levels for each.
CENTRES, MOST_CENTRES, POINTS = 32, 4096, 4
#: Least rows of the sample, and most bytes of it.
SAMPLE, SAMPLE_BYTES = 2048, 64 << 20
#: Smallest and largest block of rows on a side, and blocks aimed at.
SMALLEST, LARGEST, AIM = 2048, 65536, 32
#: Query blocks that one task holds against a candidate block.
TOGETHER = 8
#: Components are smaller than this after scaling.
WIDEST = 1 << 28
LEAF, QUERY_LEAF, FAN = 128, 32, 8
#: Pairs of blocks that are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 100_000


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id and v, the floors of the scaled components;
    only sound vectors."""
    x = F.col(vec_col)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    sound = rows.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, bad))
    far = F.raise_error(F.lit("a component is too large for whole scores")).cast("long")

    def floored(c: Column) -> Column:
        y = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(y) >= float(WIDEST), far).otherwise(F.floor(y).cast("long"))

    return sound.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.transform(x, floored).alias("v"))


def _stack(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    offsets, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    width = max(width or 0, int(size.max(initial=0)))
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offsets[:-1], size)] = flat
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where these suffice."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Numbers of up to ``count`` distinct points, each the farthest from those before."""
    picked = [0]
    gap = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < count and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return np.array(picked)


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list[Node]


def cover_tree(x: np.ndarray, leaf: int, fan: int = FAN) -> Node:
    """Each node's centre is one of its points and covers all of them within its
    radius; children are picked farthest first and keep the parent's centre."""

    def node(rows: np.ndarray, centre: np.ndarray) -> Node:
        gap = np.sqrt(((x[rows] - centre) ** 2).sum(axis=1))
        made = Node(centre, float(np.sqrt((centre**2).sum())), float(gap.max(initial=0)), rows, [])
        if len(rows) > leaf and made.radius > 0:
            here = x[rows]
            at = np.concatenate([[int(gap.argmin())], rows[:0]]).astype(int)
            order = np.concatenate([at, np.delete(np.arange(len(rows)), at)])
            picked = order[farthest_first(here[order], fan)]
            gaps = ((here**2).sum(axis=1)[:, None] - 2 * here @ here[picked].T) + (here[picked] ** 2).sum(axis=1)
            home = gaps.argmin(axis=1)
            made.children = [node(rows[home == k], here[p]) for k, p in enumerate(picked) if (home == k).any()]
            if len(made.children) < 2:
                made.children = []
        return made

    return node(np.arange(len(x)), x[0])


class Candidates:
    """A block's candidates and their tree. Of equal vectors the k + 1 rows with the
    smallest ids are all that a query, whose own row may be one, can get."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, k: int = K):
        order = np.lexsort((rows, ids, *x.T))
        x = x[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]) if len(x) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        place = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
        on = place <= k
        self.ids, self.rows, self.x = ids[order][on], rows[order][on], x[on]
        self.tree = cover_tree(self.x.astype(np.float64), LEAF) if len(self.x) else None


class DualSearch:
    """Top k of each query among the candidates of one block."""

    def __init__(self, q_ids, q_rows, q, q_floor, candidates: Candidates, k: int = K):
        self.k, self.q_ids, self.q_rows, self.q, self.of = k, q_ids, q_rows, q, candidates
        self.best = np.full((len(q_ids), k), np.iinfo(np.int64).min, np.int64)
        self.best_ids = np.full((len(q_ids), k), np.iinfo(np.int64).max, np.int64)
        self.floor = np.asarray(q_floor, np.float64)
        self.pairs = self.pruned = 0

    def _worst(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.best[rows, -1].astype(np.float64), self.floor[rows]).min())

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query row, query id, candidate id, score), at most k per query."""
        if len(self.q) and self.of.tree is not None:
            stack = [(np.inf, cover_tree(self.q.astype(np.float64), QUERY_LEAF), self.of.tree)]
            while stack:
                bound, q, x = stack.pop()
                self.pairs += 1
                if bound < self._worst(q.rows):
                    self.pruned += 1
                elif not q.children and not x.children:
                    self._compare(q.rows, x.rows)
                else:
                    split_q = bool(q.children) and (not x.children or q.radius >= x.radius)
                    next_ = [(q, c) for c in x.children] if not split_q else [(c, x) for c in q.children]
                    # the most promising pair is taken from the stack first
                    stack += sorted(((bound_of(a, b), a, b) for a, b in next_), key=lambda t: t[0])
        got = self.best_ids < np.iinfo(np.int64).max
        n = got.sum(axis=1)
        return np.repeat(self.q_rows, n), np.repeat(self.q_ids, n), self.best_ids[got], self.best[got]

    def _compare(self, qr: np.ndarray, xr: np.ndarray) -> None:
        scores, ids = _dot(self.q[qr], self.of.x[xr]), self.of.ids[xr]
        scores[self.q_rows[qr][:, None] == self.of.rows[xr][None, :]] = np.iinfo(np.int64).min
        live = np.flatnonzero((scores >= np.maximum(self.best[qr, -1].astype(np.float64), self.floor[qr])[:, None]).any(axis=1))
        if not len(live):
            return
        qr, scores = qr[live], scores[live]
        both = np.concatenate([self.best[qr], scores], axis=1)
        names = np.concatenate([self.best_ids[qr], np.broadcast_to(ids, scores.shape)], axis=1)
        names[both == np.iinfo(np.int64).min] = np.iinfo(np.int64).max
        order = np.lexsort((names, -both.astype(np.float64) if abs(both[both > np.iinfo(np.int64).min]).max(initial=0) < 2**52 else -(both + 1)), axis=1)[:, : self.k]
        self.best[qr], self.best_ids[qr] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def bound_of(q: Node, x: Node) -> float:
    """No inner product between the nodes' points is above this."""
    b = float(q.centre @ x.centre) + x.norm * q.radius + q.norm * x.radius + q.radius * x.radius
    return b + 1e-9 * abs(b) + 1e-6


def _blocks(counts: dict[int, int], aim: int) -> tuple[dict[int, tuple[int, int]], list[list[int]]]:
    """For each cell its first block and number of blocks; and each block's cells.
    Small cells share a block with their neighbours, large ones are split."""
    size = int(np.clip(sum(counts.values()) // aim, SMALLEST, LARGEST))
    place, blocks, room = {}, [], 0
    for c in sorted(counts):
        if (n := counts[c]) > size:
            parts = -(-n // size)
            place[c] = (len(blocks), parts)
            blocks += [[c] for _ in range(parts)]
            room = 0
        else:
            if n > room or not blocks:
                blocks.append([])
                room = size
            place[c] = (len(blocks) - 1, 1)
            blocks[-1].append(c)
            room -= n
    return place, blocks


@dataclass
class Top:
    """The top of the tree: first-level centres, and points that are the cells' centres,
    in order of the centre that they stand below."""

    centres: np.ndarray
    points: np.ndarray
    below: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, centres: int) -> Top:
        order = farthest_first(x, centres * POINTS)
        first, points = x[order[:centres]], x[order]
        home = _nearest(points, first)
        by_home = np.argsort(home, kind="stable")
        return cls(first, points[by_home], home[by_home])

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell, and its distance from the cell's centre."""
        home = _nearest(v, self.centres)
        cell, gap = np.zeros(len(v), np.int64), np.zeros(len(v))
        for c in np.unique(home):
            rows, under = np.flatnonzero(home == c), np.flatnonzero(self.below == c)
            cell[rows] = under[_nearest(v[rows], self.points[under])]
            gap[rows] = np.sqrt(((v[rows] - self.points[cell[rows]]) ** 2).sum(axis=1))
        return cell, gap


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * v @ centres.T).argmin(axis=1)


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of every query's k best rows
    other than itself. ``is_query`` is a condition on ``vec_id``."""
    spark = rows.sparkSession
    base = staged(whole_vectors(rows, id_col, vec_col, scale), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    facts = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not facts["n"]:
        return empty
    width = max(1, facts["width"])
    count = int(np.clip(math.isqrt(facts["n"]) // 4, CENTRES, MOST_CENTRES))
    most = max(2, min(max(SAMPLE, 4 * count), SAMPLE_BYTES // (8 * width)))
    taken = base.orderBy(F.xxhash64("row"), "row").limit(most).toArrow().combine_chunks()
    s_rows, s = taken.column("row").to_numpy(), _stack(taken.column("v").combine_chunks(), width)
    top = Top.of(s.astype(np.float64), count)
    shared = spark.sparkContext.broadcast((s_rows, s, top))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_rows, s, top = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = _stack(b.column("v"), width)
            ids, q = b.column("row").to_numpy(), b.column("q").to_numpy(zero_copy_only=False)
            cell, gap = top.cells(v.astype(np.float64))
            floor = np.full(len(ids), -np.inf)
            if q.any() and len(s_rows) > k:
                for lo in range(0, int(q.sum()), 1024):
                    at = np.flatnonzero(q)[lo : lo + 1024]
                    scores = _dot(v[at], s)
                    scores[ids[at][:, None] == s_rows[None, :]] = np.iinfo(np.int64).min
                    floor[at] = np.partition(scores, len(s_rows) - k, axis=1)[:, len(s_rows) - k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "vec_id", "v", "q")), pa.array(cell, pa.int32()), pa.array(gap), pa.array(floor)],
                names=["row", "vec_id", "v", "q", "cell", "gap", "floor"],
            )

    placed = base.select("row", "vec_id", "v", is_query.alias("q")).mapInArrow(place, "row long, vec_id long, v array<long>, q boolean, cell int, gap double, floor double")
    placed = staged(placed, "placed-vectors")
    release(base)
    own = F.when(F.col("q"), F.col("gap"))
    # as many rows as there are cells, however many vectors
    stats = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.count_if("q").alias("nq"), F.max("gap").alias("r"), F.max(own).alias("rq"), F.min(F.when(F.col("q"), F.col("floor"))).alias("floor")
    )
    stats = {r["cell"]: r for r in stats.collect()}
    x_place, x_blocks = _blocks({c: r["n"] for c, r in stats.items()}, AIM)
    q_place, q_blocks = _blocks({c: r["nq"] for c, r in stats.items() if r["nq"]}, 4)
    if not q_blocks:
        return empty
    cells = sorted(stats)
    number = {c: i for i, c in enumerate(cells)}
    radius = np.array([stats[c]["r"] for c in cells])
    blocks_of = [(j, number[c]) for j, b in enumerate(x_blocks) for c in b]
    meets = spark.sparkContext.broadcast((top.points, np.array(cells), radius, np.array([j for j, _ in blocks_of]), np.array([i for _, i in blocks_of])))
    wanted = [(j, c, float(stats[c]["rq"]), float(stats[c]["floor"])) for j, b in enumerate(q_blocks) for c in b]

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidate blocks that a query cell meets: it is held against all cells at once."""
        every, cells, r, block, cell = meets.value
        points = every[cells]
        norm = np.sqrt((points**2).sum(axis=1))
        for b in batches:
            out = []
            for qb, c, rq, floor in zip(*(b.column(n).to_pylist() for n in ("qb", "cell", "rq", "floor")), strict=True):
                here = every[c]
                bound = points @ here + norm * rq + float(np.sqrt((here**2).sum())) * r + rq * r
                on = bound + 1e-9 * np.abs(bound) + 1e-6 >= floor
                out += [(qb, x) for x in np.unique(block[on[cell]]).tolist()]
            pairs = np.array(out, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["qb", "xb"])

    pairs = spark.createDataFrame(wanted, "qb int, cell int, rq double, floor double").mapInArrow(meeting, "qb int, xb int").distinct()
    # query blocks of a candidate block are dealt over tasks, a few in each
    nth = F.row_number().over(Window.partitionBy("xb").orderBy("qb")) - 1
    pairs = staged(pairs.select("qb", "xb", F.floor(nth / TOGETHER).cast("int").alias("part")), "block-pairs")
    number_of_pairs = pairs.count()
    small = (lambda df: F.broadcast(df)) if number_of_pairs <= BROADCAST_PAIRS else (lambda df: df)

    def block_of(place: dict[int, tuple[int, int]]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(c, *p) for c, p in place.items()], "cell int, first int, parts int"))

    dealt = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")
    queries = placed.filter("q").join(block_of(q_place), "cell").withColumn("qb", dealt).join(small(pairs), "qb")
    queries = queries.select(F.col("xb").alias("q_xb"), F.col("part").alias("q_part"), "qb", F.col("row").alias("q_row"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), "floor")
    parts = small(pairs.select("xb", "part").distinct())
    candidates = placed.join(block_of(x_place), "cell").withColumn("xb", dealt).join(parts, "xb").select("xb", "part", "row", "vec_id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            x = _stack(right.column("v").combine_chunks(), width)
            block = Candidates(right.column("vec_id").to_numpy(), right.column("row").to_numpy(), x, k)
            qb = left.column("qb").to_numpy()
            for one in np.unique(qb):
                t = left.filter(pa.array(qb == one))
                q = _stack(t.column("q_v").combine_chunks(), width)
                found.append(DualSearch(t.column("q_id").to_numpy(), t.column("q_row").to_numpy(), q, t.column("floor").to_numpy(), block, k).run())
        row, query, vec, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"row": row, "query_id": query, "vec_id": vec, "score": score})

    hits = queries.groupBy("q_xb", "q_part").cogroup(candidates.groupBy("xb", "part")).applyInArrow(search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

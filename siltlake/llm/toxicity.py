"""Toxicity: a linear classifier with counterfactual regularisation.

Features are the words and word beginnings that a text holds. A logistic model is
fitted on a bounded sample of labelled rows; sentences of it that name a group
are paired with the same sentence naming another, and changes of the score
between the two are penalised, so that a neutral mention of a group does not
count against a text. Scores come from whole texts.

Defined results: a null or empty text gets the score of no features; a very long
one is read whole, and a feature counts once however often it stands there; rows
whose id has no label are scored too; null labels, and ids that have both, are not
learned from; of several texts under one id the least is; ties in the choice of
features go to the smaller key; without examples of both labels every score is 0;
repeated rows get the same score; an empty table gives an empty table; columns
besides those named are not read, and may have any names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import small_batches
from .codepoints import CodePoints, blocks
from .common import id_text, staged

#: Groups of terms that may stand for each other (fixed values).
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("gay", "straight"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("immigrants", "natives"), ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)
#: Labelled rows of each label that the model is fitted on, at most.
SAMPLE = 3000
#: Word beginnings that count as features, in letters.
PREFIXES = (4, 5, 6)
#: Features of the model, at most, and rows of the sample that each must be in.
FEATURES, SUPPORT = 4096, 4
#: Different swaps that the penalty is taken over, at most: the most frequent.
SWAPS = 20_000
FOLDS = 5


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text modulo ``folds``."""
    return F.crc32(id_text(key).cast("binary")) % folds


@dataclass
class Model:
    """Weights of feature keys (sorted) and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    known: bool = True
    _table: np.ndarray | None = field(default=None, repr=False)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the model, or -1."""
        if not len(self.keys):
            return np.full(keys.shape, -1, np.int64)
        if self._table is None:
            self._table = np.zeros(1 << 20, bool)
            self._table[self.keys >> np.uint64(44)] = True
        out = np.full(keys.shape, -1, np.int64)
        maybe = np.nonzero(self._table[keys >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == keys[maybe], at, -1)
        return out

    def score(self, texts: list[str | None], cps: CodePoints) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        z = np.full(len(texts), self.bias)
        if not self.known:
            return np.zeros(len(texts))
        for rows, text, begin in blocks(texts):
            place, keys = cps.words(text, PREFIXES)
            at = self.hits(keys)
            row, _ = np.nonzero(at >= 0)
            owner = np.searchsorted(begin, place[row], side="right") - 1
            pairs = np.unique(owner * len(self.keys) + at[at >= 0]) if len(row) else np.zeros(0, np.int64)
            z[rows] += np.bincount(pairs // max(1, len(self.keys)), self.weights[pairs % max(1, len(self.keys))], len(rows))[: len(rows)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def swap_terms(text: str, groups=IDENTITY_TERMS) -> str | None:
    """The text with each identity term turned into the next of its group; null
    if it has none."""
    turn = {t: g[(k + 1) % len(g)] for g in groups for k, t in enumerate(g)}
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, turn)) + r")\b", re.IGNORECASE)
    new, n = pattern.subn(lambda m: turn[m[0].lower()], text)
    return new if n else None


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s]


def sample_features(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, groups=IDENTITY_TERMS, features: int = FEATURES, support: int = SUPPORT,
    swaps: int = SWAPS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """What a model is fitted on, bounded whatever the sampled texts hold.

    ``doc`` rows: label and keys of each sampled text, of the ``features`` keys that
    tell the labels apart best and of those that swaps change. ``swap`` rows: keys
    that swapping the terms of a sentence takes away and adds (``other``), and in how
    many sentences (``n``), the most frequent ``swaps``. Keys are counted in Spark.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0))
    # an id with both labels teaches nothing
    known = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    order = (F.md5(id_text(F.col("id"))), F.col("id"))
    chosen = functools.reduce(DataFrame.union, [known.filter(F.col("toxic") == y).orderBy(*order).limit(sample) for y in (0, 1)]).select("id", "toxic")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cps = CodePoints()
        keys_of = lambda t: (k := np.unique(cps.words(t, PREFIXES)[1]))[k != 0].view(np.int64)
        for b in small_batches(batches, "text"):
            out: list[tuple] = []
            for y, t in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                out.append(("doc", y, keys_of(t), []))
                for s in sentences(t):
                    if (turned := swap_terms(s, groups)) is not None:
                        was, now = keys_of(s), keys_of(turned)
                        out.append(("swap", y, np.setdiff1d(was, now), np.setdiff1d(now, was)))
            kind, label, keys, other = zip(*out, strict=True)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, other)]
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(label, pa.int32()), *lists], names=["kind", "label", "keys", "other"])

    found = staged(rows.mapInArrow(run, "kind string, label int, keys array<long>, other array<long>"), "sample-features")
    whole, turned = found.filter("kind = 'doc'"), found.filter("kind = 'swap'")
    have = {r["label"]: r["count"] for r in whole.groupBy("label").count().collect()}
    n1, n0 = have.get(1, 0), have.get(0, 0)
    pos, neg, rate = F.col("pos"), F.col("neg"), lambda c, n: F.log((c + 0.5) / (n + 1.0))
    gain = F.abs(pos / max(1, n1) - neg / max(1, n0)) * F.abs(rate(pos, n1) - rate(neg, n0))
    counts = whole.select("label", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("label").alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    best = counts.filter(pos + neg >= min(support, max(1, n1))).withColumn("gain", gain).filter("gain > 0").orderBy(F.desc("gain"), "key").limit(features).select("key")
    turned = turned.groupBy("keys", "other").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keys", "other").limit(swaps)
    turned = staged(turned, "sample-swaps")
    named = turned.select(F.explode(F.concat("keys", "other")).alias("key"))
    model = np.sort(best.union(named).distinct().toArrow().column("key").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [np.intersect1d(k.values.to_numpy(), shared.value, assume_unique=True) for k in b.column("keys")]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(kept, pa.list_(pa.int64()))], names=["label", "keys"])

    empty = F.array().cast("array<long>")
    rows = whole.select("label", "keys").mapInArrow(known_keys, "label int, keys array<long>")
    rows = rows.select(F.lit("doc").alias("kind"), "label", "keys", empty.alias("other"), F.lit(1).cast("long").alias("n"))
    return rows.union(turned.select(F.lit("swap"), F.lit(None).cast("int"), "keys", "other", "n"))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _matrix(rows: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the rows' keys."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.searchsorted(keys, flat)


def fit(table: pa.Table, counterfactual: float = 1.0, ridge: float = 1e-3, steps: int = 400) -> Model:
    """Logistic regression by Adam over ``sample_features``; ``counterfactual``
    weighs the mean squared change of the score when terms are swapped."""
    import pyarrow.compute as pc

    docs, swaps = (table.filter(pc.equal(table.column("kind"), k)) for k in ("doc", "swap"))
    y, x = docs.column("label").to_numpy().astype(np.float64), _lists(docs.column("keys"))
    # in an order of their own, as rows come in any
    order = sorted(range(len(x)), key=lambda i: (y[i], x[i].astype(">u8").tobytes()))
    x, y = [np.sort(x[i]) for i in order], y[order]
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, known=False)
    before, after, times = _lists(swaps.column("keys")), _lists(swaps.column("other")), swaps.column("n").to_numpy().astype(np.float64)
    order = sorted(range(len(before)), key=lambda i: (before[i].tobytes(), after[i].tobytes()))
    before, after, times = [before[i] for i in order], [after[i] for i in order], times[order]
    keys = np.unique(np.concatenate([*x, *before, *after]))
    r, c = _matrix(x, keys)
    (br, bc), (ar, ac) = _matrix(before, keys), _matrix(after, keys)
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, bias, m, v = np.zeros(len(keys)), 0.0, np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(r, w[c], len(x))
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(c, d[r], len(keys)) + ridge * w
        if before:
            change = np.bincount(br, w[bc], len(before)) - np.bincount(ar, w[ac], len(before))
            change *= 2 * counterfactual * times / times.sum()
            g += np.bincount(bc, change[br], len(keys)) - np.bincount(ac, change[ar], len(keys))
        g = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(keys, w, float(bias))


def train(docs: DataFrame, labels: DataFrame, counterfactual: float = 1.0, **how) -> Model:
    return fit(sample_features(docs, labels, **how).toArrow(), counterfactual)


def toxicity(docs: DataFrame, model: Model, folds: int = FOLDS, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` columns, held_out, score and predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], fold(F.col(f"`{id_col}`"), folds).alias("__fold"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kinds = {"held_out": T.BooleanType(), "score": T.DoubleType(), "predicted": T.IntegerType()}
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in keep], *[T.StructField(n, k) for n, k in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cps = CodePoints()
        for b in small_batches(batches, "__text"):
            score = shared.value.score(b.column("__text").to_pylist(), cps)
            out = [pa.array(b.column("__fold").to_numpy() == 0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], names=[*keep, "held_out", "score", "predicted"])

    return rows.mapInArrow(run, schema)


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that a model trained on them and ``labels`` accepts."""
    # whole rows in one column, as any name may be among theirs
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return toxicity(rows, train(docs, labels, id_col=id_col, text_col=text_col, **how), keep=("__row",)).filter("predicted = 0").select("__row.*")

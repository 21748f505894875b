"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds a bit for each language, so
one look at an n-gram's slots returns every language that contains it. Each
language's hits are counted over the whole text, corrected for the chance that
its filter answers yes at random, and the largest share decides.

Filters are filled from a bounded sample of labelled rows per language, with
n-grams that enough of them hold. More than 64 languages take further slices.

Defined results: `und` with score 0 if the text is null or has no letter, or if
nothing was learned; a text too short for an n-gram gets the most frequent
language with score 0; ties go to the language that is more frequent, then first
by name; repeated rows agree; of rows under one id the least (language, text) is
learned from; very long texts are read whole; more than MAX_LANGUAGES languages are
refused; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import small_batches
from .codepoints import CodePoints, blocks
from .common import hash_unit, id_text, staged
from .toxicity import fold

#: Length of the n-grams, slots of the filter (a power of two), slots per n-gram.
GRAM, SLOTS, PROBES = 4, 1 << 20, 2
#: Labelled rows of each language that the filters are filled from, at most.
SAMPLE = 500
#: An n-gram must be in this share of its language's sampled rows.
LEAST_SHARE = 0.01
FOLDS, HELD_OUT = 3, 1
#: Languages, at most: a filter of 64 takes 8 MB of the broadcast.
MAX_LANGUAGES = 1024
UNKNOWN = "und"


@dataclass
class Filters:
    """Languages, most frequent first, and slices of 64 of them each."""

    languages: list[str]
    slices: list[np.ndarray]
    chance: np.ndarray

    @staticmethod
    def slots(keys: np.ndarray) -> list[np.ndarray]:
        low = np.uint64(SLOTS - 1)
        return [(keys >> np.uint64(20 * p)) & low for p in range(PROBES)]

    @classmethod
    def of(cls, languages: list[str], grams: dict[str, np.ndarray]) -> Filters:
        width = -(-len(languages) // 64)
        slices = [np.zeros(SLOTS, np.uint64) for _ in range(width)]
        chance = np.zeros(len(languages))
        for k, lang in enumerate(languages):
            bit, cells = np.uint64(1 << k % 64), slices[k // 64]
            for s in cls.slots(grams.get(lang, np.zeros(0, np.uint64))):
                cells[s] |= bit
            chance[k] = float(((cells & bit) != 0).mean()) ** PROBES
        return cls(languages, slices, chance)

    def masks(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each slice, the languages that contain each n-gram."""
        at = self.slots(keys)
        out = []
        for cells in self.slices:
            m = cells[at[0]]
            for s in at[1:]:
                m = m & cells[s]
            out.append(m)
        return out

    def predict(self, texts: list[str | None], cps: CodePoints) -> tuple[list[str], np.ndarray]:
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, score
        for rows, text, begin in blocks(texts):
            place, keys = cps.grams(text, GRAM)
            _, letter = cps.arrays(text)
            upto = np.concatenate([[0], np.cumsum(letter)])
            edges = np.append(begin, len(text))
            lettered = (upto[edges[1:]] - upto[edges[:-1]]) > 0
            # an n-gram belongs to the text that holds its second code point
            owner = np.searchsorted(begin, place + 1, side="right") - 1
            total = np.bincount(owner, minlength=len(rows))[: len(rows)].astype(float)
            hits = np.zeros((len(self.languages), len(rows)))
            for k0, mask in enumerate(self.masks(keys)):
                for k in range(64 * k0, min(64 * k0 + 64, len(self.languages))):
                    on = (mask & np.uint64(1 << k % 64)) != 0
                    hits[k] = np.bincount(owner[on], minlength=len(rows))[: len(rows)]
            c = self.chance[:, None]
            share = np.clip((hits - total * c) / np.maximum(total * (1 - c), 1e-9), 0, 1)
            best = share.argmax(axis=0)
            for j, i in enumerate(rows):
                if texts[i] is not None and lettered[j]:
                    names[i], score[i] = self.languages[best[j]], share[best[j], j]
        return names, score


def sample_grams(
    docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """(lang, n) over all labelled rows outside the held-out fold, and (lang,
    gram, n): in how many rows of a bounded sample of each language."""
    known = docs.filter(F.col(lang_col).isNotNull() & (fold(F.col(id_col), folds) != held_out)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    counts = staged(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if counts.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: their filters would not fit a broadcast")
    # the first by hash of each language; a share of it that holds them, so no task gets a whole language
    share = F.lit(4.0 * sample + 400) / F.col("n")
    few = known.join(F.broadcast(counts), "lang").filter(hash_unit(id_text(F.col("id")), "language-sample") < share)
    order = Window.partitionBy("lang").orderBy(hash_unit(id_text(F.col("id")), "language-sample"), "id")
    chosen = few.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample).select("id").distinct()
    texts = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.struct(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).alias("row"))
    # of several rows under an id the least is learned from, in every run
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("row").alias("row")).select("row.lang", "row.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cps = CodePoints()
        for b in small_batches(batches, "text"):
            keys = [np.unique(cps.grams(f" {t or ''} ", GRAM)[1]) for t in b.column("text").to_pylist()]
            lang = np.repeat(np.array(b.column("lang").to_pylist(), object), [len(k) for k in keys])
            flat = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(flat, pa.int64())], names=["lang", "gram"])

    return counts, rows.mapInArrow(run, "lang string, gram long").groupBy("lang", "gram").agg(F.count("*").alias("n"))


def train(docs: DataFrame, least_share: float = LEAST_SHARE, sample: int = SAMPLE, **how) -> Filters:
    counts, grams = sample_grams(docs, sample, **how)
    known = sorted(((r["n"], r["lang"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))
    least = {lang: max(1, int(least_share * min(n, sample))) for n, lang in known}
    found = grams.filter(F.col("n") >= max(1, min(least.values(), default=1))).toArrow()
    lang = np.array(found.column("lang").to_pylist(), object)
    n, gram = found.column("n").to_numpy(), found.column("gram").to_numpy().view(np.uint64)
    return Filters.of([x for _, x in known], {x: gram[(lang == x) & (n >= least[x])] for _, x in known})


def identify(docs: DataFrame, filters: Filters, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.col(id_col).alias("doc_id"), fold(F.col(id_col), folds).alias("fold"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cps = CodePoints()
        for b in small_batches(batches, "text"):
            names, score = shared.value.predict(b.column("text").to_pylist(), cps)
            out = [b.column("doc_id"), pa.array(b.column("fold").to_numpy() == held_out), pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

"""Quality rules: a threshold table compiled into one Spark projection.

Native: every feature and verdict is a built-in expression over the row, so the
operator is a single map over the scan with no shuffle. Repeats inside a text
are found by sorting its windows within the row, O(n log n) for any length.

Defined results: a null or empty text has no words, all counts 0 and fails the
base; repeated rows are judged alike; an empty table gives an empty table; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is was for that it with as on be by at from are this or "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans sur au par il "
    "el los se del las por con no para su al lo y"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject where ``scale * top`` is on the wrong side of ``limit * base``:
    ``at_most`` rejects above, ``at_least`` below. Whole numbers only, so that
    verdicts do not hang on rounding."""

    name: str
    top: str
    base: str
    limit: int
    scale: int = 100
    kind: str = "at_most"

    def failed(self, cols: dict[str, Column]) -> Column:
        left, right = F.lit(self.scale) * cols[self.top], F.lit(self.limit) * cols[self.base]
        return left > right if self.kind == "at_most" else left < right


#: Production thresholds. The base (length and repetition) stands apart.
RULES = (
    Rule("short_words", "word_chars", "n_words", 200, kind="at_least"),
    Rule("long_words", "word_chars", "n_words", 1500),
    Rule("symbols", "n_symbols", "n_words", 10),
    Rule("stop_words", "n_stop_words", "n_words", 3, kind="at_least"),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 60),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 90),
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines", "n_stop_words", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _covered(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text.

    Windows are sorted as (hash, three words, place): equal windows become
    neighbours, and the words decide where hashes agree by chance.
    """

    def repeated(s: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])
        flagged = F.transform(
            s,
            lambda x, i: F.when(
                ((i > 0) & same(x, F.get(s, i - 1))) | ((i + 1 < F.size(s)) & same(x, F.get(s, i + 1))), x["i"]
            ),
        )
        places = F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))
        # windows that overlap share words: each adds the part past the previous one
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))),
                F.lit(0),
                lambda acc, x: acc + x,
            ),
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
            F.get(words, i).alias("a"),
            F.get(words, i + 1).alias("b"),
            F.get(words, i + 2).alias("c"),
            i.alias("i"),
        ),
    )
    return F.when(F.size(words) >= 4, let(F.sort_array(windows), repeated)).otherwise(0)


def features(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Struct of whole-text counts (long) that the rules divide."""
    t = F.coalesce(text, F.lit(""))
    strip = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))

    def counted(w: Column) -> Column:
        return let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                strip("#*$%&|<>").cast("long").alias("n_symbols"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(ls, lambda x: x.rlike(r"(\.\.\.|…)[ \t-\r]*\z"))).cast("long").alias("n_ellipsis_lines"),
                F.size(F.filter(ls, lambda x: x.rlike(r"\A[ \t-\r]*[•▪●*-][ \t]"))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(w, lambda x: x.isin(*stop_words))).cast("long").alias("n_stop_words"),
                _covered(w).cast("long").alias("n_repeat_words"),
            ),
        )

    return let(words_of(t), counted)


def judged(text: Column, rules: Sequence[Rule] = RULES, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    """The features and the verdict on them in one struct: one expression, so a
    filter on a part of it does not work the text out once for each feature."""

    def verdict(f: Column) -> Column:
        cols = {n: f[n] for n in FEATURES}
        base = (cols["n_words"] < min_words) | (100 * cols["n_repeat_words"] > max_repeat_percent * cols["n_words"])
        failed = F.filter(F.array(*[F.when(r.failed(cols), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        return F.struct(
            *[c.alias(n) for n, c in cols.items()], base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept")
        )

    return let(features(text), verdict)


def quality(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), **how) -> DataFrame:
    """``keep`` columns, every feature, ``base_failed``, ``failed_rules`` (names
    of the rules that reject, empty if none) and ``kept``."""
    got = docs.select(*[F.col(c) for c in keep], judged(F.col(text_col), **how).alias("__f"))
    return got.select(*[F.col(c) for c in keep], *[F.col(f"__f.{n}").alias(n) for n in (*FEATURES, "base_failed", "failed_rules", "kept")])


def keep_good(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    return docs.filter(judged(F.col(f"`{text_col}`"), **how)["kept"])

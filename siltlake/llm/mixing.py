"""Mixing sources to target weights.

Native. Tokens are summed per source (partial sums before the shuffle, so a
source with a third of all rows is no hot group), repetition rates follow from
the targets, and each document is emitted floor(rate) times plus one Bernoulli
copy with probability equal to the fraction, seeded by a hash of its id.

Defined results: a null text has size 0; null is a source of its own, last in
order; equal ids draw alike; an empty table gives an empty table; a source of
size 0 has target 0 and rate 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, hash_unit, id_text, release, staged

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEATS = 2
#: Sources up to this many are sent to every executor; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, size) rows: source, source_size, target, rate.

    Water filling: a target is min(cap, level * weight). The level starts as if no
    source stopped at its cap and rises as the excess of those that do is shared anew,
    until no further one stops. Sources are ranked by range and counted by
    aggregates, so that no task need hold them all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = staged(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())
    starts = [(k, sum(n for j, n in counts if j < k)) for k, _ in counts]
    starts = F.broadcast(ranged.sparkSession.createDataFrame(starts, "range int, start long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("start") + F.col("n")) % len(weights)).cast("int"))
    w = ranged.withColumn("n", place).join(starts, "range").select("source", "source_size", weight.alias("w"), (F.lit(float(max_repeats)) * F.col("source_size")).alias("cap"))
    w = staged(w, "mix-weights")
    release(ranged)
    first = w.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    total, level = (first["size"] or 0) * share_percent / 100.0, None
    new = total / first["w"] if first["w"] else float("inf")
    while new != level:
        level = new
        stops = F.col("cap") < F.lit(level) * F.col("w")
        got = w.agg(F.sum(F.when(stops, F.col("cap"))).alias("cap"), F.sum(F.when(~stops, F.col("w"))).alias("w")).first()
        new = (total - (got["cap"] or 0.0)) / got["w"] if got["w"] else float("inf")
    target = F.least(F.col("cap"), F.lit(level) * F.col("w"))
    some = F.col("source_size") > 0
    return w.select("source", "source_size", F.when(some, target).otherwise(0.0).alias("target"), F.when(some, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(rate: Column, key: Column, seed: str) -> Column:
    """floor(rate) and one more with probability rate - floor(rate)."""
    whole = F.floor(rate)
    return (whole + (hash_unit(key, seed) < rate - whole).cast("long")).cast("long")


def mix_plan(docs: DataFrame, seed: str = "mix", source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep: Sequence[Column] = (), **how) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies
    and ``keep``. Without ``keep`` sizes are staged, so texts are read once."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), *keep)
    if not keep:
        sized = staged(sized, "mix-sizes")
    rates = staged(targets(sized.select("source", "size"), **how), "mix-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    r = rates.withColumnRenamed("source", "__source")
    rest = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    return sized.join(r, sized["source"].eqNullSafe(r["__source"]), "left").select(
        "doc_id", "source", "size", "source_size", "target", "rate",
        copies(F.col("rate"), id_text(F.col("doc_id")), seed).alias("copies"), *rest,
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: each row ``copies`` times."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    plan = mix_plan(docs, keep=[row], **how)
    return plan.filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")

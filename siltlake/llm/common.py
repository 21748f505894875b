"""Shared helpers: table access, staged tables, and Column idioms."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_importable, shared_dir
from ..sources.fs import Files

#: The white space of every word rule here: space and U+0009 to U+000D.
SPACE_CLASS = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets Spark drop the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Drop the shuffle files of the queries inside as each of them ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so what
    follows neither recomputes it nor depends on a lost executor. ``release``
    deletes it when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        Files(t.sparkSession).delete(t.staged_at)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, as a lambda variable, for several uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, without building them all twice: pieces of the split
    less the empty ones that a leading or trailing space makes."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(t, SPACE_CLASS))
    edges = F.when(t == "", 1).otherwise(
        t.rlike(r"\A[ \t-\r]").cast("int") + t.rlike(r"[ \t-\r]\z").cast("int")
    )
    return F.greatest(pieces - edges, F.lit(0)).cast("long")


def hash_unit(key: Column, seed: str) -> Column:
    """A double in [0, 1) from md5 of ``key`` (a string) and ``seed``: 52 bits,
    the same in any engine."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def id_text(col: Column) -> Column:
    """A key column as text, null as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def text_digest(text_col: str) -> Column:
    """md5 of a text, null as the empty string."""
    return F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.lit(""))


def keep_least(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: one with its smallest id, no id last. ``groups``
    has doc_id, digest (of the text) and component for every row; rows that agree
    in id and digest are of one component."""
    names = staged(groups.groupBy("component", "doc_id", "digest").count(), "names")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest", "count"))
    kept = staged(names.groupBy("component").agg(least.alias("k")).select("k.id", "k.digest", "k.count"), "kept")
    release(names)
    # names are hashed per partition and whole rows stream by unsorted, at any size
    k = kept.select(F.col("id").alias("__id"), F.col("digest").alias("__kept")).hint("shuffle_hash")
    out = docs.withColumn("__digest", text_digest(text_col))
    out = out.join(k, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept")), "left_semi")
    # a name that stands on several rows keeps one of them
    if not kept.filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__digest"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Races between commits, plans without needless work, and indexes across schemas."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltlake.functions import predicate as P
from siltlake.operators import evolution, index
from siltlake.operators.merge import KIND, ROW_ID, SEQ
from siltlake.sources.table import Changes, CommitConflict, LakeTable, SequenceConflict, register_format

from test_tables import ks, make


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rows(spark):
    return spark.range(30).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 3).cast("int").alias("p"))


def test_a_hint_being_written_or_broken_hides_nothing(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 10"), rows.filter("k >= 10")])
    hint = tmp_path / "t" / "snapshot" / "LATEST"
    for text in ("", "1", "99", "not a number"):
        # by the file system this leaves a checksum, which then fits no more
        t.snapshots.files.write(str(hint), "2")
        hint.write_text(text)
        assert t.snapshots.latest_id() == 2 and ks(t.read()) == list(range(30))
    assert t.snapshots.files.read_hint(str(hint)) is None
    hint.unlink()
    assert t.snapshots.latest_id() == 2
    with ThreadPoolExecutor(8) as pool:
        jobs = [pool.submit(t.snapshots.files.write_hint, str(hint), str(1 + n % 2)) for n in range(200)]
        assert {t.snapshots.latest_id() for _ in range(100)} == {2}
        [j.result() for j in jobs]
    assert hint.read_text() in "12" and not [f for f in hint.parent.iterdir() if f.name.startswith(".LATEST")]


def test_late_deletions_and_compactions_are_refused_or_redone(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 10"), rows.filter("k >= 10")])
    late = t.prepare_delete(P.less_than("k", 5))
    t.compact()
    with pytest.raises(CommitConflict):
        t.commit(late)
    assert ks(t.read()) == list(range(30))
    t.delete_where(P.less_than("k", 5))
    late = t.prepare_compact()
    t.delete_where(P.greater_than("k", 25))
    with pytest.raises(CommitConflict):
        t.commit(late)
    assert ks(t.read()) == list(range(5, 26))
    t.compact()
    assert ks(t.read()) == list(range(5, 26)) and not t.snapshots.latest().deletions


def test_deletions_are_redone_when_a_compaction_comes_between(spark, tmp_path, rows, monkeypatch):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 10"), rows.filter("k >= 10")])
    prepare, raced = t.prepare_delete, []

    def between(p):
        made = prepare(p)
        if not raced:
            raced.append(1)
            LakeTable(spark, t.path).compact()
        return made

    monkeypatch.setattr(t, "prepare_delete", between)
    t.delete_where(P.less_than("k", 5))
    assert ks(t.read()) == list(range(5, 30))


def test_deletion_tables_become_one(spark, tmp_path, rows, monkeypatch):
    from siltlake.sources import table

    monkeypatch.setattr(table, "DELETIONS", 3)
    t = make(spark, tmp_path / "t", rows, [rows])
    for k in range(6):
        t.delete_where(P.equal("k", k))
    assert len(t.snapshots.latest().deletions) <= 3 and ks(t.read()) == list(range(6, 30))


def test_identifiers_are_kept_by_user(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 3"), rows.filter("k = 3"), rows.filter("k = 4")])
    assert t.snapshots.latest().identifier is None
    assert t.write(rows.filter("k = 5"), identifier=2) is not None and t.write(rows.filter("k = 5"), identifier=2) is None
    assert t.write(rows.filter("k = 6"), identifier=1, user="other") is not None and t.write(rows.filter("k = 6"), identifier=1, user="other") is None
    assert ks(t.read()) == list(range(7))


def test_sequence_numbers_are_not_given_twice(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows], primary_keys=["k"], options={"bucket": 2})
    first, second = (t.prepare(rows.withColumn("v", F.lit(v))) for v in ("a", "b"))
    t.commit(first)
    with pytest.raises(SequenceConflict):
        t.commit(second)
    t.write(rows.withColumn("v", F.lit("c")))
    assert {r.v for r in t.read().collect()} == {"c"}
    # a commit uses up as many numbers as its largest task has rows
    assert t.snapshots.latest().next_sequence <= 90


def test_columns_written_meanwhile_are_a_conflict(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows], options={"row-tracking.enabled": True, "data-evolution.enabled": True})
    base, (f,) = t.snapshots.latest(), t.plan().files if len(t.plan().files) == 1 else (t.plan().files[:1])
    evolution.write_columns(t, t.read([ROW_ID, "p"]).withColumn("p", F.lit(7)), ["p"])
    entry = {**f.asDict(), "write_cols": ["p"], "snapshot_id": None}
    with pytest.raises(CommitConflict):
        t.commit(Changes(added=[entry], schema_id=t.schema.id, base=base))
    t.overwrite(rows.limit(0))
    with pytest.raises(CommitConflict):
        t.commit(Changes(added=[entry], schema_id=t.schema.id))


def test_buckets_merge_without_a_shuffle(spark, tmp_path, rows):
    new = rows.filter("k % 2 = 0").withColumn("v", F.lit("new"))
    t = make(spark, tmp_path / "t", rows, [rows, new], primary_keys=["k"], options={"bucket": 4})
    df = t.read()
    assert "Exchange" not in plan_of(df) and "Bucketed: true" in plan_of(df)
    assert sorted((r.k, r.v) for r in df.collect()) == [(k, "new" if k % 2 == 0 else f"v{k}") for k in range(30)]
    # files of an older schema are in buckets too
    t.alter(lambda s: s.add_column("x", T.IntegerType()))
    t.write(rows.filter("k = 1").withColumn("v", F.lit("last")).withColumn("x", F.lit(5)))
    assert {r.k: (r.v, r.x) for r in t.read().collect()}[1] == ("last", 5) and t.read().count() == 30


def test_aggregations_run_by_hash(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows.drop("v"), [rows.drop("v"), rows.drop("v")], primary_keys=["k"], options={"bucket": 2, "merge-engine": "aggregation", "fields.p.aggregate-function": "sum"})
    df = t.read()
    assert "HashAggregate" in plan_of(df) and "SortAggregate" not in plan_of(df) and "Exchange" not in plan_of(df)
    assert {r.k: r.p for r in df.collect()} == {k: 2 * (k % 3) for k in range(30)}


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint"])
def test_sums_wrap(spark, kind):
    from siltlake.operators.merge import MergeSpec, merge

    bits = {"tinyint": 8, "int": 32, "bigint": 64}[kind]
    top = (1 << (bits - 1)) - 1
    df = spark.createDataFrame([(1, top, 0, 0), (1, top, 1, 0), (1, 5, 2, 3), (2, None, 0, 0), (2, -top - 1, 1, 0), (3, None, 0, 0), (3, None, 1, 0)], f"k int, x {kind}, {SEQ} long, {KIND} byte")
    got = {r.k: r.x for r in merge(df, MergeSpec(["k"], engine="aggregation", aggregators={"x": "sum"})).collect()}
    wrapped = lambda n: (n + (1 << (bits - 1))) % (1 << bits) - (1 << (bits - 1))
    assert got == {1: wrapped(2 * top - 5), 2: -top - 1, 3: None}


def test_one_column_is_one_scan(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows], options={"row-tracking.enabled": True, "data-evolution.enabled": True})
    evolution.write_columns(t, t.read([ROW_ID, "p"]).withColumn("p", F.lit(7)), ["p"])
    evolution.write_columns(t, t.read([ROW_ID, "v"]).withColumn("v", F.lit("w")), ["v"])
    assert plan_of(t.read(["k"])).count("Scan parquet") == 1 and plan_of(t.read(["p"])).count("Scan parquet") == 1
    assert {tuple(r) for r in t.read(["v", "p"]).collect()} == {("w", 7)}
    # ranges are pruned by the file that wins the column
    assert not t.plan(P.equal("p", 1)).files and t.read(predicate=P.equal("p", 1)).count() == 0
    assert t.read(["k"], P.and_(P.equal("p", 7), P.less_than("k", 3))).count() == 3


def test_deletion_vectors_on_keys(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows], primary_keys=["k"], options={"bucket": 2, "deletion-vectors.enabled": True})
    assert t.read().count() == 0
    t.compact()
    t.write(rows.filter("k < 10").withColumn("v", F.lit("new")))
    t.write(rows.filter("k = 3").withColumn(KIND, F.lit(3)))
    assert {r.v for r in t.read().collect()} == {f"v{k}" for k in range(30)}
    t.compact()
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {k: "new" if k < 10 else f"v{k}" for k in range(30) if k != 3}
    assert "Window" not in plan_of(t.read())
    assert [r.k for r in t.read(predicate=P.equal("v", "v20")).collect()] == [20]


def test_pruning_in_another_zone_and_under_older_schemas(spark, tmp_path):
    zone = "spark.sql.session.timeZone"
    before = spark.conf.get(zone)
    at = [dt.datetime(2024, 1, d, 3, 0, 0) for d in (1, 2, 3)]
    try:
        spark.conf.set(zone, "UTC")
        df = spark.createDataFrame([(k, a) for k, a in enumerate(at)], "k int, at timestamp")
        t = make(spark, tmp_path / "t", df, [df.filter(f"k = {k}") for k in range(3)])
        spark.conf.set(zone, "America/Los_Angeles")
        for k, a in enumerate(at):
            assert [r.k for r in t.read(predicate=P.equal("at", a)).collect()] == [k] and len(t.plan(P.equal("at", a)).files) == 1
    finally:
        spark.conf.set(zone, before)
    t.alter(lambda s: s.rename_column("k", "n")).alter(lambda s: s.change_type("n", T.LongType())).alter(lambda s: s.add_column("x", T.StringType()))
    assert len(t.plan(P.equal("n", 1)).files) == 1 and not t.plan(P.is_not_null("x")).files and len(t.plan(P.is_null("x")).files) == 3


@pytest.mark.parametrize("kind", ["bitmap", "bsi", "bloom-filter"])
def test_indexes_know_their_column_by_id(spark, tmp_path, rows, kind):
    t = make(spark, tmp_path / "t", rows.drop("v"), [rows.drop("v").filter(f"p = {p}") for p in range(3)])
    index.build_file_index(t, kind, "p")
    t.alter(lambda s: s.rename_column("p", "q")).alter(lambda s: s.change_type("q", T.LongType()))
    assert len(index.files_that_may_match(t, P.equal("q", 1), t.plan().files)) < len(t.plan().files)
    assert ks(index.read_indexed(t, P.equal("q", 1))) == list(range(1, 30, 3)) and ks(index.read_indexed(t, P.is_in("q", [0, 2]))) == [k for k in range(30) if k % 3 != 1]
    t.alter(lambda s: s.drop_column("q")).alter(lambda s: s.add_column("q", T.LongType()))
    assert index.read_indexed(t, P.is_null("q")).count() == 30 and index.read_indexed(t, P.equal("q", 1)).count() == 0


def test_bit_slices_answer_every_comparison(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = [None if x % 11 == 0 else int(x) - 500 for x in rng.integers(0, 1000, 400)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, x int").coalesce(1)
    t = make(spark, tmp_path / "t", df, [df])
    index.build_file_index(t, "bsi", "x")
    tests = {
        "eq": lambda a, v: a == v, "ne": lambda a, v: a != v, "lt": lambda a, v: a < v, "le": lambda a, v: a <= v, "gt": lambda a, v: a > v, "ge": lambda a, v: a >= v,
    }
    for v in (-2000, -500, values[1] or 3, 0, 499, 5000):
        for op, f in tests.items():
            found = index.select_positions(t, P.Leaf(op, "x", (v,)))[0]
            assert sorted(r.position for r in found.collect()) == [k for k, a in enumerate(values) if a is not None and f(a, v)], (op, v)
    nulls = index.select_positions(t, P.is_null("x"))[0]
    assert sorted(r.position for r in nulls.collect()) == [k for k, a in enumerate(values) if a is None]


def test_bloom_filters_grow_with_the_rows(spark, tmp_path):
    df = spark.range(60000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).coalesce(1)
    t = make(spark, tmp_path / "t", df, [df])
    index.build_file_index(t, "bloom-filter", "x")
    (entry,) = t.snapshots.latest().indexes
    false = sum(bool(index._bloom_hits(t, entry, P.equal("x", 2 * v + 1))) for v in range(40))
    assert false <= 12 and all(index._bloom_hits(t, entry, P.equal("x", 2 * v)) for v in (0, 31, 59999))


def test_global_index_names_the_files(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter(f"p = {p}").coalesce(1) for p in range(3)], options={"row-tracking.enabled": True})
    index.build_global_index(t, "p")
    assert len(index.plan_global(t, P.equal("p", 1)).files) == 1
    low = t.read([ROW_ID], row_ranges=[(2, 3)])
    assert sorted(r[0] for r in low.collect()) == [2, 3]
    picked = spark.createDataFrame([(29,)], f"{ROW_ID} long")
    assert t.read(["k"], limit=1, row_ids=picked).count() == 1


def test_vector_index_recall(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.concatenate([centres[i % 40] + rng.normal(size=(1, 16)) for i in range(3000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, e array<double>").coalesce(1)
    t = make(spark, tmp_path / "t", df, [df], options={"row-tracking.enabled": True})
    index.build_vector_index(t, "e")
    found = 0
    for q in range(0, 3000, 300):
        want = set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[:10].tolist())
        got = index.vector_search(t, "e", x[q].tolist(), 10).join(t.read([ROW_ID, "k"]), ROW_ID).collect()
        found += len(want & {r.k for r in got})
    assert found / 100 >= 0.9
    # written anew, the column's index is dropped; rows are then searched exactly
    assert [i["kind"] for i in t.snapshots.latest().indexes] == ["ivf"]


def test_formats_are_registered_by_name(spark, tmp_path, rows):
    register_format("lines", "json")
    t = make(spark, tmp_path / "t", rows, [], options={"file.format": "lines", "file.compression": "gzip"})
    with pytest.raises(ValueError):
        make(spark, tmp_path / "u", rows, [rows], options={"file.format": "unheard-of"})
    t.write(rows)
    assert ks(t.read(predicate=P.less_than("k", 4))) == [0, 1, 2, 3]

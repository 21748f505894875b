"""Tables: commits, conflicts, time travel, pruning, upkeep and streams."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltlake.functions import predicate as P
from siltlake.operators import evolution, index, maintenance
from siltlake.operators.merge import KIND, ROW_ID
from siltlake.plans import catalogue
from siltlake.session import ensure_importable
from siltlake.sources.catalog import Catalog
from siltlake.sources.schema import TableSchema
from siltlake.sources.table import CommitConflict, LakeTable
from siltlake.streaming.feed import ChangeFeed, sink, stream_changes


@pytest.fixture()
def rows(spark):
    ensure_importable(spark)
    return spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") % 3).cast("int").alias("p"), F.concat(F.lit("v"), F.col("id")).alias("v"))


def make(spark, path, df, parts=(), **how):
    t = LakeTable.create(spark, str(path), df.schema, **how)
    for x in parts:
        t.write(x)
    return t


def ks(df):
    return sorted(r.k for r in df.select("k").collect())


def test_time_travel_and_errors(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 10"), rows.filter("k >= 10")])
    assert ks(t.read(version=1)) == list(range(10)) and ks(t.read()) == list(range(30)) and ks(t.changes(2)) == list(range(10, 30))
    with pytest.raises(ValueError, match="does not exist"):
        t.read(version=9)
    assert make(spark, tmp_path / "e", rows).read().count() == 0
    with pytest.raises(ValueError, match="no table"):
        LakeTable(spark, str(tmp_path / "none"))


def test_two_writers_both_land(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows)
    prepared = [LakeTable(spark, t.path).prepare(rows.filter(f"k % 4 = {i}")) for i in range(4)]
    threads = [threading.Thread(target=lambda c=c: LakeTable(spark, t.path).commit(c)) for c in prepared]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert t.snapshots.ids() == [1, 2, 3, 4] and ks(t.read()) == list(range(30))


def test_conflict(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows], partition_keys=["p"])
    stale = t.plan(partitions=[{"p": "1"}]).files
    t.drop_partitions([{"p": "1"}])
    late = t.prepare(rows.limit(1))
    late.deleted = stale
    with pytest.raises(CommitConflict):
        t.commit(late)
    with pytest.raises(ValueError):
        t.drop_partitions([])
    with pytest.raises(ValueError, match="outside"):
        t.overwrite(rows, [{"p": "0"}])


def test_identifiers_commit_once(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows)
    assert t.write(rows, identifier=3, user="u") and t.write(rows, identifier=3, user="u") is None and t.write(rows, identifier=2, user="u") is None
    assert t.write(rows, identifier=3, user="w") and t.read().count() == 60
    assert t.write(rows, watermark=50).watermark == 50 and t.write(rows, watermark=20).watermark == 50


def test_pruning(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 10").coalesce(1), rows.filter("k >= 10").coalesce(1)], partition_keys=["p"])
    files = lambda p: len(t.plan(p).files)
    assert [files(None), files(P.equal("p", 1)), files(P.less_than("k", 5)), files(P.and_(P.equal("p", 1), P.greater_than("k", 20)))] == [6, 2, 3, 1]
    assert files(P.equal("v", "zzz")) == 0 and files(P.is_null("v")) == 0
    assert t.read(limit=4).count() == 4 and len(t.plan(limit=4).files) < 6


def test_filters_reach_the_scan(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows])
    plan = t.read(["v"], P.less_than("k", 5))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(k,5)" in plan and "p:int" not in plan.split("ReadSchema")[1]


def test_untouched_files_are_read_without_a_join(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 10").coalesce(1), rows.filter("k >= 10").coalesce(1)])
    t.delete_where(P.equal("k", 3))
    (mark,) = t.snapshots.latest().deletions
    assert mark["rows"] == 1 and mark["files"] == 1
    assert "Join" not in t.read(predicate=P.greater_than("k", 20))._jdf.queryExecution().executedPlan().toString()
    assert ks(t.read()) == [k for k in range(30) if k != 3]


def test_keys_merge_compact_and_skip(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows, rows.filter("k % 2 = 0").withColumn("v", F.lit("new"))], primary_keys=["k"], options={"bucket": 2})
    t.write(rows.filter("k = 4").withColumn(KIND, F.lit(3)))
    want = {k: "new" if k % 2 == 0 else f"v{k}" for k in range(30) if k != 4}
    assert {r.k: r.v for r in t.read().collect()} == want
    # a value filter must not see records below the merge
    assert t.read(predicate=P.equal("v", "v2")).count() == 0
    t.compact()
    raw, mixed = t._sections(t.plan().files)
    assert raw and not mixed and {r.k: r.v for r in t.read().collect()} == want
    assert "Aggregate" not in t.read()._jdf.queryExecution().executedPlan().toString()
    t.write(rows.filter("k = 1").withColumn("v", F.lit("again")))
    assert {r.k: r.v for r in t.read().collect()} == want | {1: "again"}


def test_vouched_keys_skip_the_merge(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, primary_keys=["k"], options={"bucket": 1})
    t.write(rows.coalesce(1), unique=True)
    raw, mixed = t._sections(t.plan().files)
    assert ks(t.read()) == list(range(30)) and raw and not mixed


def test_merge_options_in_tables(spark, tmp_path, rows):
    df = rows.select("k", F.lit(2).alias("x"))
    t = make(spark, tmp_path / "t", df, [df, df], primary_keys=["k"], options={"bucket": 1, "merge-engine": "aggregation", "fields.x.aggregate-function": "sum"})
    assert {r.x for r in t.read().collect()} == {4}


def test_schema_evolution(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows])
    t.alter(lambda s: s.rename_column("v", "w")).alter(lambda s: s.change_type("k", T.LongType())).alter(lambda s: s.add_column("n", T.DoubleType()))
    t.alter(lambda s: s.reorder(["n", "k", "w", "p"])).alter(lambda s: s.drop_column("p"))
    t.write(spark.createDataFrame([(1.5, 100, "hundred")], "n double, k long, w string"))
    got = {r.k: (r.w, r.n) for r in t.read().collect()}
    assert t.read().columns == ["n", "k", "w"] and got[100] == ("hundred", 1.5) and got[3] == ("v3", None)
    assert t.read(predicate=P.equal("n", 1.5)).count() == 1 and t.read(predicate=P.is_null("n")).count() == 30
    assert ks(LakeTable(spark, t.path).read(version=1)) == list(range(30))


def test_statistics_and_given_schemas(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows])
    made = t.analyze()
    assert made.kind == "ANALYZE" and made.statistics["columns"]["k"] == {"distinct": made.statistics["columns"]["k"]["distinct"], "nulls": 0, "min": "0", "max": "29"}
    assert t.write(rows).statistics is None and t.snapshots.latest().properties["commit.attempts"] == "1"
    old = t.schema.to_json()
    t.alter(lambda s: s.rename_column("v", "w"))
    assert LakeTable(spark, t.path, schema_json=old).read().columns == ["k", "p", "v"]


def test_wrong_schemas():
    f = T.StructType().add("k", "integer").add("v", "string").add("a", T.ArrayType(T.IntegerType()))
    for how in (
        {"primary_keys": ["x"]}, {"primary_keys": ["k", "k"]}, {"primary_keys": ["a"]}, {"options": {"bucket": 2}}, {"options": {"bucket-key": "k"}}, {"options": {"bucket": 0}},
        {"options": {"changelog-producer": "input"}}, {"options": {"snapshot.num-retained.min": 5, "snapshot.num-retained.max": 2}},
        {"options": {"data-evolution.enabled": True}}, {"primary_keys": ["k"], "options": {"row-tracking.enabled": True}}, {"primary_keys": ["k"], "options": {"sequence.field": "zz"}},
        {"primary_keys": ["k"], "options": {"merge-engine": "first-row", "deletion-vectors.enabled": True}}, {"primary_keys": ["k"], "partition_keys": ["v"], "options": {"bucket": 1}},
    ):
        with pytest.raises(ValueError):
            TableSchema.create(f, **how)
    with pytest.raises(ValueError, match="reserved"):
        TableSchema.create(T.StructType().add("_ROW_ID", "integer"))
    made = TableSchema.create(f, primary_keys=["k"])
    assert TableSchema.from_json(made.to_json()) == made and not made.fields["k"].nullable


def test_deletions_and_indexes(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows])
    for kind in ("bitmap", "bsi"):
        index.build_file_index(t, kind, "k")
    t.delete_where(P.less_than("k", 5))
    assert ks(t.read()) == list(range(5, 30)) and ks(t.read(version=1)) == list(range(30))
    assert ks(index.read_indexed(t, P.is_in("k", [3, 7, 8]))) == [7, 8]
    assert ks(index.read_indexed(t, P.or_(P.equal("k", 6), P.greater_than("k", 27)))) == [6, 28, 29]
    assert t.delete_where(P.equal("k", 99)) is None


def test_bloom_filters_skip_files(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k % 2 = 0").coalesce(1), rows.filter("k % 2 = 1").coalesce(1)])
    index.build_file_index(t, "bloom-filter", "v")
    p = P.equal("v", "v7")
    assert len(index.files_that_may_match(t, p, t.plan(p).files)) == 1 and ks(index.read_indexed(t, p)) == [7]


def test_global_index_and_ranges(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 20")], options={"row-tracking.enabled": True})
    index.build_global_index(t, "p")
    t.write(rows.filter("k >= 20"))
    assert ks(index.read_global(t, P.equal("p", 1))) == list(range(1, 30, 3))
    ids, gaps = index.global_lookup(t, P.equal("p", 1))
    assert ids.count() == 7 and gaps == [(20, 29)]
    assert index.global_lookup(t, P.or_(P.equal("p", 1), P.equal("v", "v2"))) is None
    picked = spark.createDataFrame([(i,) for i in (0, 1, 2, 7, 8, 20)], f"{ROW_ID} long")
    r = evolution.row_ranges(picked)
    assert sorted(map(tuple, r.collect())) == [(0, 2), (7, 8), (20, 20)] and evolution.ids_of(r).count() == 6
    assert t.read(["k", ROW_ID], row_ids=picked).count() == 6
    assert evolution.set_algebra("and_not", picked, picked.limit(0)).count() == 6


def test_data_evolution(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 20"), rows.filter("k >= 20")], options={"row-tracking.enabled": True, "data-evolution.enabled": True})
    first = t.read([ROW_ID, "k"]).filter("k < 20")
    evolution.write_columns(t, first.withColumn("p", F.col("k") * 10), ["p"])
    got = {r.k: (r.p, r.v) for r in t.read().collect()}
    assert got == {k: (k * 10 if k < 20 else k % 3, f"v{k}") for k in range(30)}
    with pytest.raises(ValueError, match="rows given"):
        evolution.write_columns(t, first.limit(3).withColumn("p", F.lit(1)), ["p"])


def test_expiry_and_orphans(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows, rows], partition_keys=["p"])
    t.overwrite(rows)
    assert maintenance.expire_snapshots(t, retain_min=1, retain_max=1) == 2 and t.snapshots.ids() == [3]
    assert t.read().count() == 30 and len([f for f in t.fs.walk(f"{t.path}/data") if f.name.endswith(".parquet")]) == len(t.plan().files)
    t.prepare(rows)
    assert maintenance.clean_orphans(t) == []
    assert maintenance.clean_orphans(t, older_than_ms=1 << 60, dry_run=True) and t.read().count() == 30
    maintenance.clean_orphans(t, older_than_ms=1 << 60)
    assert t.read().count() == 30 and maintenance.clean_orphans(t, older_than_ms=1 << 60) == []


def test_manifests_are_merged(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, options={"manifest.merge-min-count": 2})
    for i in range(4):
        t.write(rows.filter(f"k % 4 = {i}"))
    assert len(t.snapshots.latest().base) < 3 and ks(t.read()) == list(range(30)) and t.read(version=2).count() == rows.filter("k % 4 < 2").count()


def test_feed_modes(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter(f"k % 3 = {i}") for i in range(3)])
    t.overwrite(rows.filter("k = 0"))
    t.write(rows.filter("k = 1"))
    seen = lambda *a: [(n, df.count()) for n, df in ChangeFeed(t, *a)]
    assert seen("from-snapshot", 2) == [(2, 10), (3, 10), (5, 1)] and seen("from-snapshot-full", 2) == [(2, 20), (3, 10), (5, 1)]
    assert seen("latest-full") == [(5, 2)] and seen("latest") == []
    with pytest.raises(ValueError):
        ChangeFeed(t, "from-snapshot")
    maintenance.expire_snapshots(t, retain_min=1, retain_max=1)
    feed = ChangeFeed(t, "from-snapshot", 2)
    assert [n for n, _ in feed] == [5]
    feed.next_id = 2
    with pytest.raises(ValueError, match="expired"):
        feed.poll()


def test_stream_into_a_table(spark, tmp_path, rows):
    t = make(spark, tmp_path / "t", rows, [rows.filter("k < 10")])
    out = make(spark, tmp_path / "o", rows)
    run = lambda: stream_changes(t, sink(out, "copy"), str(tmp_path / "c")).awaitTermination()
    run()
    t.write(rows.filter("k >= 10"))
    run()
    run()
    assert ks(out.read()) == list(range(30))


def test_catalog_branches_and_fallback(spark, tmp_path, rows):
    cat = Catalog(spark, str(tmp_path / "w"))
    cat.create_database("db")
    t = cat.create_table("db.t", rows.schema, partition_keys=["p"])
    t.write(rows.filter("p = 0"))
    assert cat.databases() == ["db"] and cat.tables("db") == ["t"] and cat.load_schema("db.t").partition_keys == ["p"]
    for bad in (lambda: cat.create_database("db"), lambda: cat.create_database("sys"), lambda: cat.create_table("db.t", rows.schema), lambda: cat.create_table("no.t", rows.schema)):
        with pytest.raises(ValueError):
            bad()
    t.create_branch("b").write(rows.withColumn("v", F.lit("b")))
    assert cat.table("db.t$branch_b").read().count() == 30
    t.extra = {"scan.fallback-branch": "b"}
    got = t.read_with_fallback()
    assert got.count() == 30 and got.filter("v = 'b'").count() == 20
    with pytest.raises(ValueError, match="branches"):
        maintenance.clean_orphans(t)
    cat.register("db.t")
    assert spark.sql("select count(*) from db_t").first()[0] == 10


def test_vector_search(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)] + [(99, None)], "id long, e array<float>")
    got = index.vector_topk(df, "e", [7.2, 1.0], 3, id_col="id").collect()
    assert [r.id for r in got] == [6, 7, 8]
    assert [r.id for r in index.vector_topk(df, "e", [1.0, 0.0], 2, "inner_product", F.col("id") < 10, "id").collect()] == [8, 9]
    assert len(index.vector_topk(df, "e", [1.0, 0.0], 2, "cosine", None, "id").collect()) == 2
    with pytest.raises(ValueError):
        index.vector_topk(df, "e", [1.0], 1, "l9")


@pytest.mark.parametrize("rows, wide", [(0, 1), (1, 1), (3000, 1), (4000, 600)])
def test_rolled_files_are_packed_to_as_many_as_they_fill(spark, tmp_path, rows, wide):
    """None, one, and, of 80 MB, more than one file of 64 MB."""
    noise = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(wide)), lambda i: F.sha2(F.concat_ws(":", "id", i), 256)))
    orders = spark.range(rows).select(F.col("id").alias("o_orderkey"), noise.alias("o_orderpriority"))
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["rolling_files"](spark, str(tmp_path))
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*orders.columns).cast("decimal(38,0)"))).first()
    assert got.columns == orders.columns and digest(got) == digest(orders)

"""The registered queries over lake tables and their SQL equivalents.

Each entry is (query, SQL). Queries that need a table write one from the
driver's Parquet to a fresh folder in the shared store, over all of its rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts
from ..functions import predicate as P
from ..operators import evolution, index, maintenance
from ..operators.merge import KIND, ROW_ID, SEQ, MergeSpec, merge
from ..session import ensure_importable, shared_dir
from ..sources.catalog import Catalog
from ..sources.table import Changes, LakeTable
from ..streaming.feed import ChangeFeed, sink, stream_changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession) -> str:
    """A new folder in the store that driver and executors share."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def table_of(df: DataFrame, parts: list[DataFrame] | None = None, **how) -> LakeTable:
    """A table with the columns of ``df``, and one commit for each part."""
    t = LakeTable.create(df.sparkSession, fresh(df.sparkSession), df.schema, **how)
    for p in [df] if parts is None else parts:
        t.write(p)
    return t


_SHARED: dict[tuple[str, str, str], LakeTable] = {}


def in_thirds(spark: SparkSession, sf_dir: str, name: str, key: str) -> LakeTable:
    """A table of three commits, ordered by its key; made once for all that only read it."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _SHARED:
        df = source(spark, sf_dir, name)
        top = df.agg(F.max(key)).first()[0] or 0
        cuts = [F.col(key) <= top // 3, (F.col(key) > top // 3) & (F.col(key) <= 2 * top // 3), F.col(key) > 2 * top // 3]
        _SHARED[at] = table_of(df, [df.filter(c) for c in cuts])
    return _SHARED[at]


# ---- predicates on scans

_FILTERS: dict[str, tuple[str, P.Predicate, str]] = {
    "eq": ("orders", P.equal("o_orderstatus", "F"), "o_orderstatus = 'F'"),
    "ne": ("orders", P.not_equal("o_orderstatus", "F"), "o_orderstatus <> 'F'"),
    "lt": ("orders", P.less_than("o_totalprice", 50000.0), "o_totalprice < 50000"),
    "le": ("orders", P.less_or_equal("o_custkey", 300), "o_custkey <= 300"),
    "gt": ("orders", P.greater_than("o_totalprice", 200000.0), "o_totalprice > 200000"),
    "ge": ("orders", P.greater_or_equal("o_custkey", 700), "o_custkey >= 700"),
    "is_null": ("orders", P.is_null("o_orderpriority"), "o_orderpriority is null"),
    "is_not_null": ("orders", P.is_not_null("o_orderpriority"), "o_orderpriority is not null"),
    "in": ("orders", P.is_in("o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderpriority in ('1-URGENT', '2-HIGH')"),
    "not_in": ("orders", P.not_in("o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderpriority not in ('1-URGENT', '2-HIGH')"),
    "between": ("orders", P.between("o_custkey", 100, 200), "o_custkey between 100 and 200"),
    "and_or": (
        "orders",
        P.or_(P.and_(P.equal("o_orderstatus", "O"), P.less_than("o_totalprice", 90000.0)), P.equal("o_custkey", 7)),
        "(o_orderstatus = 'O' and o_totalprice < 90000) or o_custkey = 7",
    ),
    "starts_with": ("part", P.starts_with("p_name", "a"), "p_name like 'a%'"),
    "ends_with": ("part", P.ends_with("p_name", "e"), "p_name like '%e'"),
    "contains": ("part", P.contains("p_name", "an"), "p_name like '%an%'"),
}


def _scan_filter(name: str, p: P.Predicate) -> Query:
    return lambda spark, sf_dir: in_thirds(spark, sf_dir, name, "o_orderkey" if name == "orders" else "p_partkey").read(predicate=p)


for _name, (_table, _p, _sql) in _FILTERS.items():
    query(f"scan_filter_{_name}", f"select * from {_table} where {_sql}")(_scan_filter(_table, _p))


@query("table_scan_projection", "select o_custkey, o_orderkey from orders where o_custkey < 400")
def table_scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "orders"))
    return t.read(["o_custkey", "o_orderkey"], P.less_than("o_custkey", 400))


@query("partition_filter_in", "select * from orders where o_orderstatus in ('F', 'P')")
def partition_filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "orders"), partition_keys=["o_orderstatus"])
    return t.read(partitions=[{"o_orderstatus": "F"}, {"o_orderstatus": "P"}])


@query("partition_null_default", "select * from (select *, nullif(o_orderpriority, '5-LOW') as pri from orders) where pri is null")
def partition_null_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source(spark, sf_dir, "orders").withColumn("pri", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return table_of(o, partition_keys=["pri"]).read(partitions=[{"pri": "__DEFAULT_PARTITION__"}])


@query("bucket_filter", "select * from orders")
def bucket_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "orders"), options={"bucket": 4, "bucket-key": "o_custkey"})
    each = [t.read(buckets=[b]) for b in range(4)]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("partition_entries", "select o_orderstatus, count(*) as record_count from orders group by 1")
def partition_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "orders"), partition_keys=["o_orderstatus"])
    return t.partitions().select("o_orderstatus", F.col("record_count").cast("long").alias("record_count"))


@query("limit_count", "select least(count(*), 100) as n from orders")
def limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(source(spark, sf_dir, "orders")).read(limit=100).agg(F.count("*").alias("n"))


@query("orc_format", "select * from customer where c_acctbal > 0")
def orc_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "customer"), options={"file.format": "orc", "file.compression": "snappy"})
    return t.read(predicate=P.greater_than("c_acctbal", 0.0))


@query("mixed_formats", "select * from supplier")
def mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir, "supplier")
    t = table_of(s, [s.filter("s_suppkey % 2 = 0")])
    t.extra = {"file.format": "orc", "file.compression": "zlib"}
    t.write(s.filter("s_suppkey % 2 = 1"))
    return t.read()


@query("external_paths", "select * from supplier")
def external_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir, "supplier")
    outside = f"{fresh(spark)}/a,{fresh(spark)}/b"
    t = table_of(s, [s.filter("s_suppkey % 2 = 0"), s.filter("s_suppkey % 2 = 1")], options={"data-file.external-paths": outside})
    return t.read()


# ---- merge engines over changelogs


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of their users, in order of their ids."""
    e = source(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "ts", "event_type", "value", F.col("event_id").alias(SEQ), F.lit(0).cast("byte").alias(KIND))


def merged(df: DataFrame, spec: MergeSpec) -> DataFrame:
    return merge(df, spec).drop(SEQ, KIND)


_EVENTS = "user_id, event_id, ts, event_type, value"


@query("mor_dedup_events", f"select {_EVENTS} from events qualify row_number() over (partition by user_id order by ts desc nulls last, event_id desc) = 1")
def mor_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(changelog(spark, sf_dir), MergeSpec(["user_id"], sequence=["ts"]))


@query("mor_dedup_desc_seq", f"select {_EVENTS} from events qualify row_number() over (partition by user_id order by value asc nulls last, event_id desc) = 1")
def mor_dedup_desc_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(changelog(spark, sf_dir), MergeSpec(["user_id"], sequence=["value"], descending=True))


def _with_deletes(df: DataFrame, step: int) -> DataFrame:
    return df.withColumn(KIND, F.when(F.col("event_id") % step == 0, 3).otherwise(0).cast("byte"))


@query(
    "mor_dedup_delete",
    f"select {_EVENTS} from (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1) where event_id % 5 <> 0",
)
def mor_dedup_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(_with_deletes(changelog(spark, sf_dir), 5), MergeSpec(["user_id"]))


@query("mor_dedup_ignore_delete", f"select {_EVENTS} from events where event_id % 5 <> 0 qualify row_number() over (partition by user_id order by event_id desc) = 1")
def mor_dedup_ignore_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(_with_deletes(changelog(spark, sf_dir), 5), MergeSpec(["user_id"], ignore_delete=True))


@query("mor_first_row", f"select {_EVENTS} from events qualify row_number() over (partition by user_id order by event_id) = 1")
def mor_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(changelog(spark, sf_dir), MergeSpec(["user_id"], engine="first-row"))


def _cents(df: DataFrame) -> DataFrame:
    """Whole cents, so that sums do not hang on their order."""
    return df.withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("flag", F.col("cents") % 2 == 0).withColumn("some", F.when(F.col("event_id") % 3 == 0, F.col("cents")))


_AGGREGATES = {
    "sum": ("cents", "sum(c)::bigint"), "min": ("cents", "min(c)"), "max": ("cents", "max(c)"), "bool_and": ("flag", "bool_and(c % 2 = 0)"), "bool_or": ("flag", "bool_or(c % 2 = 0)"),
    "last_value": ("some", "arg_max_null(s, event_id)"), "last_non_null_value": ("some", "arg_max(s, event_id)"), "first_value": ("some", "arg_min_null(s, event_id)"),
    "first_non_null_value": ("some", "arg_min(s, event_id)"),
}


def _mor_agg(name: str, column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _cents(changelog(spark, sf_dir)).select("user_id", F.col(column).alias("x"), SEQ, KIND)
        return merged(df, MergeSpec(["user_id"], engine="aggregation", aggregators={"x": name}))

    return run


for _name, (_column, _sql) in _AGGREGATES.items():
    query(
        f"mor_agg_{_name}",
        f"with e as (select user_id, event_id, round(value * 100)::bigint as c, case when event_id % 3 = 0 then round(value * 100)::bigint end as s from events) select user_id, {_sql} as x from e group by 1",
    )(_mor_agg(_name, _column))


@query(
    "mor_agg_sum_retract",
    """with e as (select user_id, event_id % 4 = 0 as r, round(value * 100)::bigint as c from events)
    select user_id, sum(case when r then -c else c end)::bigint as x from e group by 1 having count(*) > 1 or not bool_or(r)""",
)
def mor_agg_sum_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cents(_with_deletes(changelog(spark, sf_dir), 4)).select("user_id", F.col("cents").alias("x"), SEQ, KIND)
    return merged(df, MergeSpec(["user_id"], engine="aggregation", aggregators={"x": "sum"}))


@query(
    "mor_agg_ignore_retract",
    """with e as (select user_id, event_id % 4 = 0 as r, round(value * 100)::bigint as c from events)
    select user_id, max(c) filter (where not r or (n = 1)) as x from (select *, count(*) over (partition by user_id) as n from e) group by 1 having count(*) > 1 or not bool_or(r)""",
)
def mor_agg_ignore_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cents(_with_deletes(changelog(spark, sf_dir), 4)).select("user_id", F.col("cents").alias("x"), SEQ, KIND)
    return merged(df, MergeSpec(["user_id"], engine="aggregation", aggregators={"x": "max"}, ignore_retract={"x"}))


@query(
    "mor_agg_lineitem",
    "select l_orderkey, sum(round(l_quantity)::bigint)::bigint as qty, max(l_shipdate) as last_ship, count(*) as n from lineitem group by 1",
)
def mor_agg_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = source(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.round("l_quantity").cast("long").alias("qty"), F.col("l_shipdate").alias("last_ship"), F.lit(1).cast("long").alias("n"),
        F.col("l_linenumber").cast("long").alias(SEQ), F.lit(0).cast("byte").alias(KIND),
    )
    return merged(li, MergeSpec(["l_orderkey"], engine="aggregation", aggregators={"qty": "sum", "last_ship": "max", "n": "sum"}))


def _partial(df: DataFrame) -> DataFrame:
    pick = lambda c, k: F.when(F.col("event_id") % 3 == k, F.col(c)).alias(c)
    return df.select("user_id", pick("event_type", 0), pick("value", 1), pick("ts", 2), SEQ, KIND)


_PARTIAL = "arg_max(case when event_id % 3 = 0 then event_type end, event_id) as event_type, arg_max(case when event_id % 3 = 1 then value end, event_id) as value, arg_max(case when event_id % 3 = 2 then ts end, event_id) as ts"


@query("mor_partial_update", f"select user_id, {_PARTIAL} from events group by 1")
def mor_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(_partial(changelog(spark, sf_dir)), MergeSpec(["user_id"], engine="partial-update"))


@query("mor_partial_update_ignore_delete", f"select user_id, {_PARTIAL} from events where event_id % 5 <> 0 group by 1")
def mor_partial_update_ignore_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _with_deletes(changelog(spark, sf_dir), 5)
    return merged(_partial(df), MergeSpec(["user_id"], engine="partial-update", ignore_delete=True))


@query(
    "mor_partial_update_remove_record",
    """with e as (select *, max(event_id) filter (where event_id % 5 = 0) over (partition by user_id) as d, count(*) over (partition by user_id) as n,
      max(event_id) over (partition by user_id) as top from events)
    select user_id, arg_max(case when event_id > coalesce(d, -1) then event_type end, event_id) as event_type,
      arg_max(case when event_id > coalesce(d, -1) then value end, event_id) as value from e where top % 5 <> 0 group by 1""",
)
def mor_partial_update_remove_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _with_deletes(changelog(spark, sf_dir), 5).select("user_id", "event_type", "value", SEQ, KIND)
    return merged(df, MergeSpec(["user_id"], engine="partial-update", remove_on_delete=True))


def _grouped(df: DataFrame) -> DataFrame:
    return df.select(
        "user_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("g1"), F.col("event_type").alias("a"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("g2"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("b"), SEQ, KIND,
    )


@query(
    "mor_seq_group",
    """with e as (select user_id, event_id, case when event_id % 7 <> 0 then ts end as g1, event_type as a, case when event_id % 4 <> 0 then value end as g2,
      case when event_id % 5 <> 0 then event_id end as b, count(*) over (partition by user_id) as n from events),
    x as (select user_id, g1, a from e where g1 is not null or n = 1 qualify row_number() over (partition by user_id order by g1 desc, event_id desc) = 1),
    y as (select user_id, g2, b from e where g2 is not null or n = 1 qualify row_number() over (partition by user_id order by g2 desc, event_id desc) = 1)
    select user_id, g1, a, g2, b from (select distinct user_id from e) left join x using (user_id) left join y using (user_id)""",
)
def mor_seq_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = MergeSpec(["user_id"], engine="partial-update", groups={("g1",): ["a"], ("g2",): ["b"]}, ignore_delete=True)
    return merged(_grouped(changelog(spark, sf_dir)), spec)


@query(
    "mor_seq_group_aggregate",
    """with e as (select *, round(value * 100)::bigint as c, count(*) over (partition by user_id) as n from events)
    select user_id, case when max(n) = 1 then max(ts) else max(ts) end as g, sum(c)::bigint as total, max(c) as top from e group by 1""",
)
def mor_seq_group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cents(changelog(spark, sf_dir)).select("user_id", F.col("ts").alias("g"), F.col("cents").alias("total"), F.col("cents").alias("top"), SEQ, KIND)
    spec = MergeSpec(["user_id"], engine="partial-update", groups={("g",): ["total", "top"]}, aggregators={"total": "sum", "top": "max"})
    return merged(df, spec)


# ---- tables: commits, time travel, deltas


def _thirds(df: DataFrame, key: str) -> list[DataFrame]:
    return [df.filter(F.col(key) % 3 == k) for k in range(3)]


def _orders_in_thirds(spark: SparkSession, sf_dir: str, **how) -> LakeTable:
    o = source(spark, sf_dir, "orders")
    return table_of(o, _thirds(o, "o_orderkey"), **how)


@query("time_travel_v2", "select * from orders where o_orderkey % 3 in (0, 1)")
def time_travel_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_in_thirds(spark, sf_dir).read(version=2)


@query("time_travel_timestamp", "select * from orders where o_orderkey % 3 = 0")
def time_travel_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders_in_thirds(spark, sf_dir)
    return t.read(timestamp_ms=t.snapshots.read(1).millis)


@query("delta_v2", "select 0::tinyint as _VALUE_KIND, * from orders where o_orderkey % 3 = 1")
def delta_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_in_thirds(spark, sf_dir).changes(2)


@query("stream_changelog", "select o_orderkey % 3 + 1 as snapshot, count(*) as n, min(o_orderkey) as low from orders where o_orderkey % 3 > 0 group by 1")
def stream_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = ChangeFeed(_orders_in_thirds(spark, sf_dir), "from-snapshot", 2)
    got = [df.agg(F.lit(n).cast("long").alias("snapshot"), F.count("*").alias("n"), F.min("o_orderkey").alias("low")) for n, df in feed]
    return got[0].unionByName(got[1])


@query("structured_stream_sink", "select * from orders")
def structured_stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders_in_thirds(spark, sf_dir)
    target = LakeTable.create(spark, fresh(spark), t.schema.fields)
    for _ in range(2):
        # the second run starts over from nothing: the sink drops what it has
        stream_changes(t, sink(target, "copy"), f"{fresh(spark)}/offsets").awaitTermination()
    return target.read()


@query("idempotent_commit", "select * from supplier")
def idempotent_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir, "supplier")
    t = table_of(s, [])
    for _ in range(2):
        t.write(s, identifier=7, user="loader")
    return t.read()


@query("overwrite_partition", "select o_orderkey, o_custkey, o_orderstatus, case when o_orderstatus = 'F' then 0 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders")
def overwrite_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source(spark, sf_dir, "orders")
    t = table_of(o, partition_keys=["o_orderstatus"])
    t.overwrite(o.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), [{"o_orderstatus": "F"}])
    return t.read()


@query("drop_partition", "select * from orders where o_orderstatus <> 'O'")
def drop_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "orders"), partition_keys=["o_orderstatus"])
    t.drop_partitions([{"o_orderstatus": "O"}])
    return t.read()


def _keyed(spark: SparkSession, sf_dir: str, **options) -> LakeTable:
    """Customers, then a third of them changed, then a fifth deleted."""
    c = source(spark, sf_dir, "customer")
    t = table_of(c, [c, c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0))], primary_keys=["c_custkey"], options={"bucket": 2, **options})
    t.write(c.filter("c_custkey % 5 = 0").withColumn(KIND, F.lit(3)))
    return t


_KEYED = "select c_custkey, c_name, c_nationkey, case when c_custkey % 3 = 0 then -1 else c_acctbal end as c_acctbal, c_mktsegment from customer where c_custkey % 5 <> 0"


@query("pk_table_read", _KEYED)
def pk_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).read()


@query("pk_table_compacted", _KEYED)
def pk_table_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _keyed(spark, sf_dir)
    t.compact()
    return t.read()


@query("pk_table_value_filter", f"select * from ({_KEYED}) where c_acctbal = -1 and c_custkey < 900")
def pk_table_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).read(predicate=P.and_(P.equal("c_acctbal", -1.0), P.less_than("c_custkey", 900)))


@query("pk_table_changelog", "select 3::tinyint as _VALUE_KIND, c_custkey from customer where c_custkey % 5 = 0")
def pk_table_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).changes(3, ["c_custkey"])


@query("postpone_bucket", "select (select count(*) from customer) as streamed, 0::bigint as batch")
def postpone_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "customer"), primary_keys=["c_custkey"], options={"bucket": -2})
    return t.changes(1).agg(F.count("*").alias("streamed")).crossJoin(t.read().agg(F.count("*").alias("batch")))


# ---- schema evolution and casts


@query(
    "schema_evolution_rename_cast",
    """select s_suppkey, s_name as title, s_nationkey::bigint as s_nationkey, s_acctbal::varchar is not null as has_balance,
      case when s_suppkey % 2 = 1 then 'new' end as extra from supplier""",
)
def schema_evolution_rename_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir, "supplier")
    t = table_of(s, [s.filter("s_suppkey % 2 = 0")])
    t.alter(lambda x: x.rename_column("s_name", "title")).alter(lambda x: x.change_type("s_nationkey", T.LongType())).alter(lambda x: x.add_column("extra", T.StringType()))
    t.write(s.filter("s_suppkey % 2 = 1").withColumnRenamed("s_name", "title").withColumn("extra", F.lit("new")))
    return t.read().select("s_suppkey", "title", "s_nationkey", F.col("s_acctbal").isNotNull().alias("has_balance"), "extra")


@query("schema_evolution_drop_readd", "select s_suppkey, s_name, s_acctbal, null::int as s_nationkey from supplier")
def schema_evolution_drop_readd(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "supplier"))
    t.alter(lambda x: x.drop_column("s_nationkey")).alter(lambda x: x.add_column("s_nationkey", T.IntegerType()))
    return t.read()


_I, _L, _D, _S, _B = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
_TS, _DATE, _DEC = T.TimestampNTZType(), T.DateType(), T.DecimalType(10, 2)
#: name: (table, key, column, types cast through, SQL)
_CASTS: dict[str, tuple[str, str, str, list[T.DataType], str]] = {
    "int_to_boolean": ("nation", "n_nationkey", "n_nationkey", [_I, _B], "n_nationkey::boolean"),
    "boolean_to_numeric": ("nation", "n_nationkey", "n_nationkey", [_I, _B, _D], "n_nationkey::boolean::int::double"),
    "boolean_to_decimal": ("nation", "n_nationkey", "n_nationkey", [_I, _B, _DEC], "n_nationkey::boolean::int::decimal(10, 2)"),
    "boolean_to_string": ("nation", "n_nationkey", "n_nationkey", [_I, _B, _S], "case when n_nationkey <> 0 then 'true' else 'false' end"),
    "int_wraps_to_tinyint": ("customer", "c_custkey", "c_custkey", [_L, T.ByteType()], "(((c_custkey + 128) % 256) - 128)::tinyint"),
    "double_to_int": ("customer", "c_custkey", "c_acctbal", [_D, _I], "trunc(c_acctbal)::int"),
    "int_to_double": ("customer", "c_custkey", "c_nationkey", [_I, _D], "c_nationkey::double"),
    "int_to_string": ("customer", "c_custkey", "c_custkey", [_L, _S], "c_custkey::varchar"),
    "string_to_numeric": ("customer", "c_custkey", "c_custkey", [_L, _S, _L], "c_custkey"),
    "string_to_boolean": ("nation", "n_nationkey", "n_nationkey", [_I, _B, _S, _B], "n_nationkey::boolean"),
    "string_to_decimal": ("customer", "c_custkey", "c_custkey", [_L, _S, _DEC], "c_custkey::decimal(10, 2)"),
    "string_binary_round_trip": ("customer", "c_custkey", "c_name", [_S, T.BinaryType(), _S], "c_name"),
    "double_to_decimal": ("customer", "c_custkey", "c_acctbal", [_D, _DEC], "c_acctbal::decimal(10, 2)"),
    "decimal_overflow_null": ("customer", "c_custkey", "c_custkey", [_L, T.DecimalType(18, 2), T.DecimalType(4, 2)], "case when c_custkey < 100 then c_custkey::decimal(4, 2) end"),
    "decimal_to_int": ("customer", "c_custkey", "c_acctbal", [_D, _DEC, _I], "trunc(c_acctbal::decimal(10, 2))::int"),
    "decimal_to_string": ("customer", "c_custkey", "c_acctbal", [_D, _DEC, _S], "c_acctbal::decimal(10, 2)::varchar"),
    "timestamp_to_date": ("orders", "o_orderkey", "o_orderdate", [_TS, _DATE], "o_orderdate::date"),
    "date_to_timestamp": ("orders", "o_orderkey", "o_orderdate", [_TS, _DATE, _TS], "o_orderdate::date::timestamp"),
    "date_to_string": ("orders", "o_orderkey", "o_orderdate", [_TS, _DATE, _S], "o_orderdate::date::varchar"),
    "string_to_date": ("orders", "o_orderkey", "o_orderdate", [_TS, _DATE, _S, _DATE], "o_orderdate::date"),
    "string_to_timestamp": ("orders", "o_orderkey", "o_orderdate", [_TS, _S, _TS], "o_orderdate"),
    "timestamp_to_epoch": ("orders", "o_orderkey", "o_orderdate", [_TS, _L], "epoch(o_orderdate)::bigint"),
    "epoch_to_timestamp": ("orders", "o_orderkey", "o_orderkey", [_L, _TS], "make_timestamp(o_orderkey * 1000000)"),
    "timestamp_zone_round_trip": ("orders", "o_orderkey", "o_orderdate", [_TS, T.TimestampType(), _TS], "o_orderdate"),
}


def _cast_query(table: str, key: str, column: str, kinds: list[T.DataType]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir, table)
        c: Column = F.col(column).cast(kinds[0])
        for a, b in zip(kinds[:-1], kinds[1:-1], strict=False):
            c = casts.cast(c, a, b)
        # the last cast is the table's own: files keep the type they were written with
        t = table_of(df.select(F.col(key).alias("k"), c.alias("x")))
        return t.alter(lambda s: s.change_type("x", kinds[-1])).read()

    return run


for _name, (_table, _key, _column, _kinds, _sql) in _CASTS.items():
    query(f"cast_{_name}", f"select {_key} as k, {_sql} as x from {_table}")(_cast_query(_table, _key, _column, _kinds))


@query("cast_timestamp_precision", "select event_id, date_trunc('second', ts) as x from events")
def cast_timestamp_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = casts.cast(F.col("ts").cast("timestamp_ntz"), _TS, _TS, precision=0)
    return source(spark, sf_dir, "events").select("event_id", x.alias("x"))


# ---- deletion vectors, row tracking, data evolution


@query("deletion_vector_read", "select * from orders where not (o_totalprice < 60000) and not (o_orderstatus = 'P')")
def deletion_vector_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "orders"), options={"deletion-vectors.enabled": True})
    t.delete_where(P.less_than("o_totalprice", 60000.0))
    t.delete_where(P.equal("o_orderstatus", "P"))
    return t.read()


_TRACKED = {"row-tracking.enabled": True}


@query("row_tracking_ids", "select count(*) as n, count(*) as ids, 0::bigint as low, count(*) - 1 as high from orders")
def row_tracking_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _orders_in_thirds(spark, sf_dir, options=_TRACKED).read([ROW_ID])
    return ids.agg(F.count("*").alias("n"), F.countDistinct(ROW_ID).alias("ids"), F.min(ROW_ID).alias("low"), F.max(ROW_ID).alias("high"))


@query("row_tracking_sequence", "select (o_orderkey % 3 + 1)::bigint as seq, count(*) as n from orders group by 1")
def row_tracking_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders_in_thirds(spark, sf_dir, options=_TRACKED)
    return t.read([SEQ, "o_orderkey"]).groupBy(F.col(SEQ).alias("seq")).agg(F.count("*").alias("n"))


@query("row_ranges", "select 0::bigint as low, count(*) - 1 as high from orders where o_orderkey % 3 < 2")
def row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders_in_thirds(spark, sf_dir, options=_TRACKED)
    two = t.read([ROW_ID], version=2)
    return evolution.row_ranges(two).select(F.col("from").alias("low"), F.col("to").alias("high"))


_EVOLVING = {"row-tracking.enabled": True, "data-evolution.enabled": True}


@query("data_evolution_merge", "select doc_id, text, lang, source, n_chars * 2 as n_chars from documents")
def data_evolution_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = source(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    t = table_of(d, options=_EVOLVING)
    evolution.write_columns(t, t.read([ROW_ID, "n_chars"]).withColumn("n_chars", F.col("n_chars") * 2), ["n_chars"])
    return t.read()


@query("data_evolution_added_column", "select doc_id, lang, length(source) as size from documents")
def data_evolution_added_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = source(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    t = table_of(d, options=_EVOLVING)
    t.alter(lambda s: s.add_column("size", T.LongType()))
    evolution.write_columns(t, t.read([ROW_ID, "source"]).withColumn("size", F.length("source")), ["size"])
    return t.read(["doc_id", "lang", "size"])


# ---- indexes


def _indexed(spark: SparkSession, sf_dir: str, kind: str, column: str) -> LakeTable:
    p = source(spark, sf_dir, "part")
    t = table_of(p, _thirds(p, "p_partkey")[:2])
    index.build_file_index(t, kind, column)
    # files that came after the index are read whole
    t.write(p.filter("p_partkey % 3 = 2"))
    return t


_INDEXED: dict[str, tuple[str, str, P.Predicate, str]] = {
    "bitmap_eq": ("bitmap", "p_size", P.equal("p_size", 10), "p_size = 10"),
    "bitmap_in": ("bitmap", "p_size", P.is_in("p_size", [1, 7, 50]), "p_size in (1, 7, 50)"),
    "bitmap_not_in": ("bitmap", "p_size", P.not_in("p_size", [1, 7, 50]), "p_size not in (1, 7, 50)"),
    "bsi_range": ("bsi", "p_size", P.and_(P.greater_than("p_size", 10), P.less_or_equal("p_size", 20)), "p_size > 10 and p_size <= 20"),
    "bsi_or_unindexed": ("bsi", "p_size", P.or_(P.less_than("p_size", 3), P.equal("p_partkey", 5)), "p_size < 3 or p_partkey = 5"),
    "bloom_eq": ("bloom-filter", "p_partkey", P.equal("p_partkey", 17), "p_partkey = 17"),
}


def _index_query(kind: str, column: str, p: P.Predicate) -> Query:
    return lambda spark, sf_dir: index.read_indexed(_indexed(spark, sf_dir, kind, column), p)


for _name, (_kind, _column, _p, _sql) in _INDEXED.items():
    query(f"index_{_name}", f"select * from part where {_sql}")(_index_query(_kind, _column, _p))


@query("global_index_lookup", "select * from orders where o_orderpriority in ('1-URGENT', '3-MEDIUM') and o_custkey < 500")
def global_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source(spark, sf_dir, "orders")
    t = table_of(o, _thirds(o, "o_orderkey")[:2], options=_TRACKED)
    index.build_global_index(t, "o_orderpriority")
    t.write(o.filter("o_orderkey % 3 = 2"))
    return index.read_global(t, P.and_(P.is_in("o_orderpriority", ["1-URGENT", "3-MEDIUM"]), P.less_than("o_custkey", 500)))


def _topk(spark: SparkSession, sf_dir: str, prefilter: Column | None) -> DataFrame:
    e = source(spark, sf_dir, "embeddings")
    target = e.filter("vec_id = 0").first()["embedding"]
    found = index.vector_topk(e, "embedding", target, 10, "l2", prefilter, "vec_id")
    return found.select("vec_id", F.round(F.col("_INDEX_SCORE").cast("double"), 3).alias("score"))


_TOPK = """with d as (select e.vec_id, e.label, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as d
    from embeddings e, (select embedding from embeddings where vec_id = 0) q)
    select vec_id, round(d, 3) as score from (select * from d {} order by d, vec_id limit 10)"""


@query("vector_topk", _TOPK.format(""))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, None)


@query("vector_topk_prefilter", _TOPK.format("where label = 1"))
def vector_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, F.col("label") == 1)


@query("analyze_statistics", "select count(*) as n, min(o_custkey)::varchar as low, max(o_custkey)::varchar as high, count(*) - count(o_orderpriority) as nulls from orders")
def analyze_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table_of(source(spark, sf_dir, "orders")).analyze(["o_custkey", "o_orderpriority"]).statistics
    key = s["columns"]["o_custkey"]
    row = (s["rows"], key["min"], key["max"], s["columns"]["o_orderpriority"]["nulls"])
    return spark.createDataFrame([row], "n long, low string, high string, nulls long")


# ---- maintenance, branches, catalog


@query("expire_then_read", "select 1::bigint as snapshots, count(*) as n from orders")
def expire_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders_in_thirds(spark, sf_dir)
    maintenance.expire_snapshots(t, retain_min=1, retain_max=1)
    return t.read().agg(F.lit(len(t.snapshots.ids())).cast("long").alias("snapshots"), F.count("*").alias("n"))


@query("orphan_clean", "select 1::bigint as orphans, count(*) as n from supplier")
def orphan_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir, "supplier").coalesce(1)
    t = table_of(s)
    t.prepare(s)  # files of a write that was never committed
    gone = [p for p in maintenance.clean_orphans(t, older_than_ms=1 << 60) if p.endswith(".parquet")]
    return t.read().agg(F.lit(len(gone)).cast("long").alias("orphans"), F.count("*").alias("n"))


@query("migrate_files", "select * from supplier")
def migrate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir, "supplier")
    t, loose = table_of(s, []), fresh(spark)
    s.write.parquet(loose)
    maintenance.migrate_files(t, [i.path for i in t.fs.walk(loose) if i.name.endswith(".parquet")])
    return t.read()


@query("fallback_branch", "select o_orderkey, o_orderstatus, case when o_orderstatus = 'F' then 1 else 2 end as origin from orders")
def fallback_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    main = o.withColumn("origin", F.lit(1))
    t = table_of(main, [main.filter("o_orderstatus = 'F'")], partition_keys=["o_orderstatus"])
    t.create_branch("rt").write(o.withColumn("origin", F.lit(2)))
    t.extra = {"scan.fallback-branch": "rt"}
    return t.read_with_fallback()


@query("catalog_sql_join", "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def catalog_sql_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, fresh(spark))
    cat.create_database("db")
    for name in ("customer", "nation"):
        df = source(spark, sf_dir, name)
        cat.create_table(f"db.{name}", df.schema).write(df)
        cat.register(f"db.{name}")
    return spark.sql("select n_name, count(*) as n from db_customer join db_nation on c_nationkey = n_nationkey group by 1")


# ---- merge engines on tables of several commits


def _in_halves(spark: SparkSession, df: DataFrame, columns: list[str], options: dict) -> DataFrame:
    """Rows of a keyed table that takes a changelog's odd records first, then the
    even ones: their numbers, not the commits, say which is newer."""
    t = LakeTable.create(spark, fresh(spark), df.drop(SEQ, KIND).schema, primary_keys=["user_id"], options={"bucket": 3, **options})
    for k in (1, 0):
        t.write(df.filter(F.col(SEQ) % 2 == k))
    return t.read(columns)


@query("table_deduplicate", ORACLES["mor_dedup_events"])
def table_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_halves(spark, changelog(spark, sf_dir), _EVENTS.split(", "), {"sequence.field": "ts"})


@query("table_first_row", ORACLES["mor_first_row"])
def table_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_halves(spark, changelog(spark, sf_dir), _EVENTS.split(", "), {"merge-engine": "first-row"})


@query(
    "table_aggregation",
    """with e as (select user_id, event_id, round(value * 100)::bigint as c from events)
    select user_id, sum(c)::bigint as total, max(c) as top, arg_max(c, event_id) as latest, arg_min(c, event_id) as first from e group by 1""",
)
def table_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cents")
    df = _cents(changelog(spark, sf_dir)).select("user_id", c.alias("total"), c.alias("top"), c.alias("latest"), c.alias("first"), SEQ, KIND)
    pick = {"total": "sum", "top": "max", "latest": "last_value", "first": "first_value"}
    options = {"merge-engine": "aggregation", **{f"fields.{n}.aggregate-function": a for n, a in pick.items()}}
    return _in_halves(spark, df, ["user_id", *pick], options)


@query("table_partial_update", ORACLES["mor_partial_update"])
def table_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_halves(spark, _partial(changelog(spark, sf_dir)), ["user_id", "event_type", "value", "ts"], {"merge-engine": "partial-update"})


@query(
    "mor_agg_primary_key",
    "select user_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
)
def mor_agg_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = changelog(spark, sf_dir).select("user_id", "event_type", SEQ, KIND)
    return merged(df, MergeSpec(["user_id"], engine="aggregation", aggregators={"event_type": "primary-key"}))


@query(
    "mor_seq_group_retract",
    """with e as (select user_id, event_id, event_id % 4 = 0 as r, event_type, count(*) over (partition by user_id) as n from events)
    select user_id, event_id as g, case when r then null else event_type end as a from e
    qualify row_number() over (partition by user_id order by event_id desc) = 1 and not (n = 1 and r)""",
)
def mor_seq_group_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _with_deletes(changelog(spark, sf_dir), 4).select("user_id", F.col("event_id").alias("g"), F.col("event_type").alias("a"), SEQ, KIND)
    return merged(df, MergeSpec(["user_id"], engine="partial-update", groups={("g",): ["a"]}))


@query("pk_deletion_vector_read", _KEYED)
def pk_deletion_vector_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction marks the rows that newer ones replace; what it has not seen is not read yet."""
    c = source(spark, sf_dir, "customer")
    t = table_of(c, primary_keys=["c_custkey"], options={"bucket": 2, "deletion-vectors.enabled": True})
    t.compact()
    t.write(c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)))
    t.write(c.filter("c_custkey % 5 = 0").withColumn(KIND, F.lit(3)))
    t.compact()
    t.write(c.withColumn("c_name", F.lit("unseen")))
    return t.read()


# ---- races, retries, and what a commit records


@query("race_delete_compact", "select * from orders where o_orderkey % 3 < 2 and o_custkey >= 300 and o_custkey < 900")
def race_delete_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion prepared before a compaction, and a compaction before a deletion:
    neither may lose or bring back rows, so both are refused and worked out anew."""
    o = source(spark, sf_dir, "orders")
    t = table_of(o, _thirds(o, "o_orderkey")[:2])
    late_delete = t.prepare_delete(P.less_than("o_custkey", 300))
    t.compact()
    _refused(t, late_delete)
    t.delete_where(P.less_than("o_custkey", 300))
    late_compact = t.prepare_compact()
    t.delete_where(P.greater_or_equal("o_custkey", 900))
    _refused(t, late_compact)
    t.compact()
    return t.read()


def _refused(t: LakeTable, changes: Changes) -> None:
    try:
        t.commit(changes)
    except RuntimeError:
        return
    raise AssertionError("a conflicting commit went through")


@query("identifier_after_plain", "select * from orders where o_orderkey % 3 < 2")
def identifier_after_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = _thirds(source(spark, sf_dir, "orders"), "o_orderkey")
    t = table_of(a, [a.filter("o_custkey % 2 = 0"), a.filter("o_custkey % 2 = 1")])
    for _ in range(2):
        t.write(b, identifier=1)
    return t.read()


@query("idempotent_overwrite", "select s_suppkey, s_name from supplier where s_suppkey % 2 = 1")
def idempotent_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    t = table_of(s)
    t.overwrite(s.filter("s_suppkey % 2 = 1"), identifier=3, user="loader")
    t.overwrite(s.filter("s_suppkey % 2 = 0"), identifier=3, user="loader")
    return t.read()


@query("commit_messages", "select * from supplier")
def commit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written here and committed there, by way of text."""
    s = source(spark, sf_dir, "supplier")
    t = table_of(s, [])
    text = t.prepare(s).to_json()
    other = LakeTable(spark, t.path)
    other.commit(Changes.from_json(text, other))
    return t.read()


@query("snapshot_facts", "select 3::bigint as snapshots, 700::bigint as watermark, 0::bigint as empty, count(*) as rows, '1' as attempts from supplier")
def snapshot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks never fall, empty commits make no snapshot, properties are kept."""
    s = source(spark, sf_dir, "supplier")
    t = table_of(s, [])
    t.write(s.filter("s_suppkey % 2 = 0"), watermark=700)
    t.write(s.filter("s_suppkey % 2 = 1"), watermark=500)
    empty = 0 if t.commit(Changes(schema_id=t.schema.id)) is None else 1
    t.analyze(["s_suppkey"])
    last = t.snapshots.latest()
    row = (last.id, last.watermark, empty, last.total_rows, last.properties["commit.attempts"])
    return spark.createDataFrame([row], "snapshots long, watermark long, empty long, rows long, attempts string")


@query("rolling_files", "select * from orders")
def rolling_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the target size, then packed into larger ones: as many as their bytes fill."""
    o = source(spark, sf_dir, "orders")
    t = table_of(o, options={"target-file-size": "64 kb"})
    rolled = [f["size"] for f in t.plan().files]
    if len(rolled) == 1 and rolled[0] > t.options.size("target-file-size"):
        raise AssertionError("files were not rolled")
    t.extra = {"target-file-size": "64 mb"}
    t.compact()
    full = -(-sum(rolled) // t.options.size("target-file-size"))
    # each task that packs files may leave a short one
    if len(t.plan().files) > max(1, 2 * full - 1):
        raise AssertionError("files were not packed")
    return t.read()


# ---- streams by startup mode, schemas given from outside


@query("stream_latest", "select o_orderkey % 3 as third, count(*) as n from orders where o_orderkey % 3 = 2 group by 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _thirds(source(spark, sf_dir, "orders"), "o_orderkey")
    t = table_of(parts[0], parts[:2])
    feed = ChangeFeed(t, "latest")
    if feed.poll() is not None:
        raise AssertionError("nothing is new yet")
    t.write(parts[2])
    return feed.poll()[1].groupBy((F.col("o_orderkey") % 3).alias("third")).agg(F.count("*").alias("n"))


@query("stream_from_snapshot_full", "select case when o_orderkey % 3 < 2 then 2 else 3 end::bigint as snapshot, count(*) as n from orders group by 1")
def stream_from_snapshot_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = [df.agg(F.lit(n).cast("long").alias("snapshot"), F.count("*").alias("n")) for n, df in ChangeFeed(_orders_in_thirds(spark, sf_dir), "from-snapshot-full", 2)]
    return got[0].unionByName(got[1])


@query("stream_default_full", "select 3::bigint as snapshot, count(*) as n from orders")
def stream_default_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Startup mode by default: the latest snapshot in full, as no other is named."""
    ((n, df),) = ChangeFeed(_orders_in_thirds(spark, sf_dir))
    return df.agg(F.lit(n).cast("long").alias("snapshot"), F.count("*").alias("n"))


@query("schema_override", "select s_suppkey::varchar as s_suppkey, s_name as title from supplier")
def schema_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "supplier"))
    given = json.loads(t.schema.to_json())
    given["fields"] = [f for f in given["fields"] if f["name"] in ("s_suppkey", "s_name")]
    for f in given["fields"]:
        f["name"], f["type"] = ("title", f["type"]) if f["name"] == "s_name" else (f["name"], "STRING")
    return LakeTable(spark, t.path, schema_json=json.dumps(given)).read()


# ---- pruning and indexes across schemas, zones and row ids


@query("prune_timestamp_zone", "select o_orderkey, o_orderdate from orders where o_orderdate = (select max(o_orderdate) from orders)")
def prune_timestamp_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written under one session zone and read under another: instants are the same."""
    zone = "spark.sql.session.timeZone"
    before = spark.conf.get(zone)
    try:
        spark.conf.set(zone, "UTC")
        o = source(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
        top = o.agg(F.max("at")).first()[0]
        t = table_of(o, _thirds(o, "o_orderkey"))
        spark.conf.set(zone, "America/Los_Angeles")
        found = t.read(predicate=P.equal("at", top)).collect()
    finally:
        spark.conf.set(zone, before)
    local = [(r[0], r[1]) for r in found]
    kept = spark.createDataFrame(local, "o_orderkey long, at timestamp")
    return kept.join(source(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate")


@query("prune_old_schema", "select p_partkey, p_size::bigint as p_size from part where p_size = 7")
def prune_old_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"))
    t = table_of(p, [p.filter("size < 10"), p.filter("size >= 10")])
    t.alter(lambda s: s.rename_column("size", "p_size")).alter(lambda s: s.change_type("p_size", T.LongType()))
    if len(t.plan(P.equal("p_size", 7)).files) != len(t.plan(P.less_than("p_size", 10)).files) or t.plan(P.greater_than("p_size", 1000)).files:
        raise AssertionError("files of an older schema were not pruned")
    return t.read(predicate=P.equal("p_size", 7))


@query("index_after_rename", "select p_partkey, p_size as size from part where p_size in (3, 9) or p_size is null")
def index_after_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source(spark, sf_dir, "part").select("p_partkey", "p_size")
    t = table_of(p, _thirds(p, "p_partkey"))
    index.build_file_index(t, "bitmap", "p_size")
    t.alter(lambda s: s.rename_column("p_size", "size"))
    index.build_file_index(t, "bsi", "size")
    return index.read_indexed(t, P.or_(P.is_in("size", [3, 9]), P.is_null("size")))


@query("bloom_after_cast", "select p_partkey::bigint as id, p_size from part where p_partkey = 17")
def bloom_after_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("id"), "p_size")
    t = table_of(p, _thirds(p, "id"))
    index.build_file_index(t, "bloom-filter", "id")
    t.alter(lambda s: s.change_type("id", T.LongType()))
    hit = index.files_that_may_match(t, P.equal("id", 17), t.plan().files)
    if not hit or len(hit) == len(t.plan().files):
        raise AssertionError("the filter rules nothing out, or too much")
    return index.read_indexed(t, P.equal("id", 17))


@query("row_ranges_read", "select 20::bigint as n, 20::bigint as ids, 5::bigint as low, 109::bigint as high")
def row_ranges_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders_in_thirds(spark, sf_dir, options=_TRACKED)
    got = t.read([ROW_ID], row_ranges=[(5, 14), (100, 109)])
    return got.agg(F.count("*").alias("n"), F.countDistinct(ROW_ID).alias("ids"), F.min(ROW_ID).alias("low"), F.max(ROW_ID).alias("high"))


@query("limit_row_ids", "select 2::bigint as n, count(*) - 2 as low from orders")
def limit_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders_in_thirds(spark, sf_dir, options=_TRACKED)
    last = t.snapshots.latest().next_row_id
    ids = spark.createDataFrame([(last - 1,), (last - 2,)], f"{ROW_ID} long")
    return t.read([ROW_ID], limit=3, row_ids=ids).agg(F.count("*").alias("n"), F.min(ROW_ID).alias("low"))


@query("row_id_sets", "select 'and' as op, 5::bigint as n union all select 'and_not', 5 union all select 'or', 15")
def row_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders_in_thirds(spark, sf_dir, options=_TRACKED)
    a, b = (t.read([ROW_ID], row_ranges=[r]) for r in ((0, 9), (5, 14)))
    out = [evolution.set_algebra(op, a, b).agg(F.lit(op).alias("op"), F.count("*").alias("n")) for op in ("and", "and_not", "or")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("global_index_row_range", "select * from orders where o_orderpriority = '2-HIGH'")
def global_index_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders_in_thirds(spark, sf_dir, options=_TRACKED)
    half = t.snapshots.latest().next_row_id // 2
    index.build_global_index(t, "o_orderpriority", (0, half))
    return index.read_global(t, P.equal("o_orderpriority", "2-HIGH"))


@query("data_evolution_filter", "select doc_id, n_chars + 1 as n_chars from documents where n_chars + 1 > 500 and lang = 'en'")
def data_evolution_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(source(spark, sf_dir, "documents"), options=_EVOLVING)
    evolution.write_columns(t, t.read([ROW_ID, "n_chars"]).withColumn("n_chars", F.col("n_chars") + 1), ["n_chars"])
    return t.read(["doc_id", "n_chars"], P.and_(P.greater_than("n_chars", 500), P.equal("lang", "en")))


@query("vector_index_search", _TOPK.format(""))
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list is probed, so that the result is the exact one; rows that came
    after the index are searched too."""
    e = source(spark, sf_dir, "embeddings")
    t = table_of(e, [e.filter("vec_id % 3 > 0")], options=_TRACKED)
    index.build_vector_index(t, "embedding", lists=16)
    t.write(e.filter("vec_id % 3 = 0"))
    target = e.filter("vec_id = 0").first()["embedding"]
    found = index.vector_search(t, "embedding", target, 10, probes=16).join(t.read([ROW_ID, "vec_id"]), ROW_ID)
    return found.select("vec_id", F.round(F.col("_INDEX_SCORE").cast("double"), 3).alias("score"))

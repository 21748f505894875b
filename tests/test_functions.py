"""Types, casts, predicates and options."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltlake.functions import predicate as P
from siltlake.functions import types as types_
from siltlake.functions.blob import descriptor, fetch
from siltlake.functions.casts import cast, supported
from siltlake.sources.options import Options

SCHEMA = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("d", T.DateType()), T.StructField("a", T.ArrayType(T.IntegerType()))])


@pytest.mark.parametrize("text", ["BOOLEAN", "TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "STRING", "BYTES", "DATE", "DECIMAL(12, 3)", "TIMESTAMP(6)", "TIMESTAMP(6) WITH LOCAL TIME ZONE"])
def test_type_names_go_round(text):
    assert types_.show(types_.parse(text)) == text
    assert types_.show(types_.parse(text), nullable=False) == text + " NOT NULL"


def test_types_that_are_refused():
    for text in ("CHAR(3)", "TIMESTAMP(4)", "TIME", "MULTISET"):
        with pytest.raises(ValueError):
            types_.parse(text)
    assert types_.parse("NUMERIC") == T.DecimalType(10, 0) and types_.parse("TIMESTAMP_LTZ(3)") == T.TimestampType()


def test_nested_fields_are_numbered():
    s, free = types_.with_ids(T.StructType().add("x", T.StructType().add("y", T.IntegerType())).add("z", T.ArrayType(T.StructType().add("w", T.IntegerType()))))
    assert free == 4 and [f.metadata["field_id"] for f in s.fields] == [0, 2]
    assert T.StructType([types_.field_of(types_.show_field(f)) for f in s.fields]) == s


def one(spark, value, source, target, **how):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", source)]))
    return df.select(cast(F.col("x"), source, target, **how)).first()[0]


I, L, B, S, D, Y = T.IntegerType(), T.LongType(), T.BooleanType(), T.StringType(), T.DoubleType(), T.ByteType()  # noqa: E741


@pytest.mark.parametrize(
    "value, source, target, want",
    [
        (300, I, Y, 44), (-129, I, Y, 127), (2**40 + 5, L, I, 5), (3.9, D, I, 3), (-3.9, D, I, -3), (float("nan"), D, I, 0), (1e30, D, L, 2**63 - 1), (None, D, I, None),
        (decimal.Decimal("300.99"), T.DecimalType(10, 2), Y, 44), (decimal.Decimal("123.45"), T.DecimalType(10, 2), T.DecimalType(4, 2), None),
        (12345, I, T.DecimalType(4, 0), None), (True, B, T.DecimalType(3, 1), decimal.Decimal("1.0")), (False, B, S, "false"), ("Yes", S, B, True), (" n ", S, B, False),
        ("12", S, I, 12), ("2024-02-29", S, T.DateType(), dt.date(2024, 2, 29)), (86400, I, T.TimestampNTZType(), dt.datetime(1970, 1, 2)),
        (dt.datetime(1970, 1, 2), T.TimestampNTZType(), L, 86400), ("ab", S, T.BinaryType(), b"ab"), (7, L, B, True), (0.5, D, S, "0.5"),
    ],
)
def test_casts(spark, value, source, target, want):
    assert one(spark, value, source, target) == want


@pytest.mark.parametrize("value, source, target", [("maybe", S, B), ("x1", S, I), ("soon", S, T.DateType()), (float("inf"), D, T.DecimalType(9, 2)), ("1x", S, T.DecimalType(9, 2))])
def test_casts_that_fail(spark, value, source, target):
    with pytest.raises(Exception, match="cannot cast"):
        one(spark, value, source, target)


def test_cast_pairs():
    assert ("double", "boolean") not in supported() and ("int", "boolean") in supported()
    with pytest.raises(ValueError):
        cast(F.lit(1.0), D, B)


def test_predicates_are_checked():
    P.validate(P.and_(P.equal("i", 1), P.or_(P.is_null("a"), P.is_in("s", ["x"]))), SCHEMA)
    for bad in (P.equal("i", None), P.equal("i", "1"), P.equal("i", True), P.equal("nope", 1), P.equal("a", 1), P.is_in("s", ["x", None]), P.equal("d", dt.datetime(2020, 1, 1))):
        with pytest.raises(ValueError):
            P.validate(bad, SCHEMA)
    with pytest.raises(ValueError):
        P.and_()


def test_null_fields_satisfy_nothing(spark):
    df = spark.createDataFrame([(1, "x", None, None), (None, None, None, None)], SCHEMA)
    n = lambda p: df.filter(P.to_column(p, SCHEMA)).count()
    assert [n(P.not_equal("i", 5)), n(P.not_in("i", [5])), n(P.is_null("i")), n(P.less_than("i", 5))] == [1, 1, 1, 1]


def test_split_and_statistics():
    p = P.and_(P.equal("i", 1), P.or_(P.equal("i", 2), P.equal("s", "x")), P.is_not_null("s"))
    assert P.pick(p, lambda n: n <= {"i"}) == P.equal("i", 1) and P.fields(p) == {"i", "s"}
    stats = {"i": (3, 7, 0), "s": (None, None, 10)}
    may = lambda q: P.may_match(q, stats, 10)
    assert [may(P.equal("i", 2)), may(P.equal("i", 5)), may(P.greater_than("i", 7)), may(P.is_in("i", [1, 3])), may(P.is_null("i"))] == [False, True, False, True, False]
    assert [may(P.equal("s", "x")), may(P.is_null("s")), may(P.is_not_null("s")), may(P.equal("other", 1))] == [False, True, False, True]
    assert not P.may_match(P.not_equal("i", 4), {"i": (4, 4, 0)}, 1) and P.may_match(P.starts_with("s", "b"), {"s": ("a", "c", 0)}, 3)


def test_options():
    o = Options({"a": "Yes", "size": "8 mb", "t": "2 h", "fields.x.aggregate-function": "sum", "merge-engine": "aggregation"})
    assert o.flag("a") and o.size("size") == 8 << 20 and o.millis("t") == 7_200_000 and o.merge_spec(["k"]).aggregators == {"x": "sum"}
    for bad in (lambda: Options({"a": "maybe"}).flag("a"), lambda: Options({"s": "big"}).size("s"), lambda: Options({"sequence.field.sort-order": "up"}).merge_spec([])):
        with pytest.raises(ValueError):
            bad()


def test_blob_descriptors(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    df = spark.createDataFrame([(str(tmp_path / "f"), 2, 3), (str(tmp_path / "f"), 5, -1), (None, 0, 1)], "u string, o long, n long")
    got = fetch(df.withColumn("d", descriptor(F.col("u"), F.col("o"), F.col("n"))), "d", "b").orderBy("o").collect()
    assert {(r.o, None if r.b is None else bytes(r.b)) for r in got} == {(0, None), (2, b"234"), (5, b"56789")}

"""Merge engines on hand-written changelogs and against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from siltlake.operators.merge import KIND, SEQ, MergeSpec, merge

SCHEMA = f"k int, seq int, a int, b string, {SEQ} long, {KIND} byte"


def run(spark, rows, spec, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.k: (r.seq, r.a, r.b, r[KIND]) for r in merge(df, spec, **how).collect()}


CASES = [
    ("single insert", [(1, 1, 1, "x", 1, 0)], {1: (1, 1, "x", 0)}),
    ("single delete", [(1, 1, 1, "x", 1, 3)], {}),
    ("insert then delete", [(1, 1, 1, "x", 1, 0), (1, 1, 1, "x", 2, 3)], {}),
    ("delete then insert", [(1, 1, 1, "x", 1, 3), (1, 1, 2, "y", 2, 0)], {1: (1, 2, "y", 0)}),
    ("out of order", [(1, 9, 1, "x", 1, 0), (1, 3, 2, "y", 2, 0)], {1: (9, 1, "x", 0)}),
    ("null sequence is first", [(1, 5, 1, "x", 1, 0), (1, None, 2, "y", 2, 0)], {1: (5, 1, "x", 0)}),
    ("equal sequence", [(1, 5, 1, "x", 1, 0), (1, 5, 2, "y", 2, 2)], {1: (5, 2, "y", 2)}),
]


@pytest.mark.parametrize("name, rows, want", CASES)
def test_deduplicate(spark, name, rows, want):
    assert run(spark, rows, MergeSpec(["k"], sequence=["seq"])) == want


def test_descending_keeps_nulls_first(spark):
    rows = [(1, 5, 1, "x", 1, 0), (1, None, 2, "y", 2, 0), (1, 7, 3, "z", 3, 0), (2, None, 1, "p", 1, 0), (2, None, 2, "q", 2, 0)]
    got = run(spark, rows, MergeSpec(["k"], sequence=["seq"], descending=True))
    assert got == {1: (5, 1, "x", 0), 2: (None, 2, "q", 0)}


def test_first_row(spark):
    rows = [(1, 1, 1, "x", 1, 0), (1, 2, 2, "y", 2, 0), (2, 1, 1, "d", 3, 3)]
    assert run(spark, rows, MergeSpec(["k"], engine="first-row")) == {1: (1, 1, "x", 0)}
    bad = [*rows, (1, 3, 3, "z", 4, 3)]
    with pytest.raises(Exception, match="first-row"):
        run(spark, bad, MergeSpec(["k"], engine="first-row"))
    assert run(spark, bad, MergeSpec(["k"], engine="first-row", ignore_delete=True)) == {1: (1, 1, "x", 0)}


def test_aggregation_retracts(spark):
    rows = [(1, 1, 10, "x", 1, 0), (1, 2, 4, None, 2, 1), (2, 1, 5, "y", 3, 3), (3, 1, 1, "p", 4, 3), (3, 2, 2, "q", 5, 3)]
    got = run(spark, rows, MergeSpec(["k"], engine="aggregation", aggregators={"a": "sum"}))
    # a lone retract is dropped; a key of retracts only still gives a row
    assert got == {1: (None, 6, "x", 0), 3: (None, -3, None, 0)}
    with pytest.raises(Exception, match="retract"):
        run(spark, rows, MergeSpec(["k"], engine="aggregation", aggregators={"a": "max"}))
    got = run(spark, rows, MergeSpec(["k"], engine="aggregation", aggregators={"a": "max"}, ignore_retract={"a"}))
    assert got[1][1] == 10 and got[3][1] is None


def test_sum_wraps(spark):
    df = spark.createDataFrame([(1, 100, 1, 0), (1, 100, 2, 0)], f"k int, x int, {SEQ} long, {KIND} byte").withColumn("x", F.col("x").cast("byte"))
    assert merge(df, MergeSpec(["k"], engine="aggregation", aggregators={"x": "sum"})).first().x == -56


def test_first_and_last_values_take_nulls(spark):
    rows = [(1, 1, None, "x", 1, 0), (1, 2, 2, "y", 2, 0), (1, 3, None, None, 3, 0)]
    for name, want in (("first_value", None), ("first_non_null_value", 2), ("last_value", None), ("last_non_null_value", 2)):
        assert run(spark, rows, MergeSpec(["k"], engine="aggregation", aggregators={"a": name}))[1][1] == want


def test_partial_update(spark):
    rows = [(1, 1, 1, None, 1, 0), (1, None, None, "y", 2, 0), (1, 3, None, None, 3, 0), (2, 1, 1, "d", 4, 3)]
    assert run(spark, rows, MergeSpec(["k"], engine="partial-update")) == {1: (3, 1, "y", 0)}
    with pytest.raises(Exception, match="partial-update"):
        run(spark, [*rows, (1, 4, 4, "z", 5, 3)], MergeSpec(["k"], engine="partial-update"))
    removed = MergeSpec(["k"], engine="partial-update", remove_on_delete=True)
    assert run(spark, [*rows, (1, 4, 4, "z", 5, 3)], removed) == {}
    assert run(spark, [*rows, (1, 4, 4, "z", 5, 3), (1, None, 7, None, 6, 0)], removed) == {1: (None, 7, None, 0)}
    assert run(spark, [*rows, (1, 4, 4, "z", 5, 1)], removed) == {1: (3, 1, "y", 0)}


def test_wrong_specs():
    for bad in (
        {"engine": "nothing"}, {"aggregators": {"a": "median"}}, {"engine": "partial-update", "remove_on_delete": True, "ignore_delete": True},
        {"engine": "partial-update", "aggregators": {"a": "sum"}}, {"engine": "partial-update", "groups": {("s",): ["a"], ("t",): ["a"]}},
    ):
        with pytest.raises(ValueError):
            MergeSpec(["k"], **bad)


def fold_groups(records, spec):
    """A record-by-record model of partial updates with one sequence group."""
    records = sorted(records, key=lambda r: r[3])
    if len(records) == 1:
        return records[0][:3] if records[0][4] in (0, 2) else None
    g = total = last = None
    for seq, a, b, _, kind in records:
        if seq is None:
            continue
        later = g is None or seq >= g
        if kind in (1, 3):
            total = total if a is None else (total or 0) - a
            if later:
                last, g = None, seq
            continue
        total = a if total is None else total if a is None else total + a
        if later:
            last, g = b, seq
    return g, total, last


@pytest.mark.parametrize("retracts", [False, True])
def test_sequence_group_against_a_fold(spark, retracts):
    rnd, rows = random.Random(11), []
    for i in range(400):
        kind = rnd.choice([0, 0, 0, 3]) if retracts else 0
        rows.append((rnd.randrange(60), rnd.choice([None, *range(6)]), rnd.choice([None, *range(9)]), rnd.choice([None, "p", "q", "r"]), i, kind))
    spec = MergeSpec(["k"], engine="partial-update", groups={("seq",): ["a", "b"]}, aggregators={"a": "sum"}, ignore_delete=False)
    keys = {}
    for k, *r in rows:
        keys.setdefault(k, []).append(tuple(r))
    want = {k: got for k, rs in keys.items() if (got := fold_groups(rs, spec)) is not None}
    got = {k: v[:3] for k, v in run(spark, rows, spec).items()}
    assert got == want


def test_fold_and_single_pass_agree(spark):
    """Aggregation in descending order folds; with the order turned by hand it is one pass."""
    rnd, rows = random.Random(12), []
    for i in range(300):
        rows.append((rnd.randrange(40), rnd.randrange(100), rnd.choice([None, *range(9)]), rnd.choice([None, "p", "q"]), i, 0))
    names = {"a": "last_non_null_value", "b": "first_value"}
    folded = run(spark, rows, MergeSpec(["k"], engine="aggregation", sequence=["seq"], descending=True, aggregators=names))
    turned = [(k, -s, *r) for k, s, *r in rows]
    single = run(spark, turned, MergeSpec(["k"], engine="aggregation", sequence=["seq"], aggregators=names))
    assert {k: v[1:] for k, v in folded.items()} == {k: v[1:] for k, v in single.items()}

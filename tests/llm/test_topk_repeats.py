"""Exact search where ids stand on several rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltlake.llm import topk
from siltlake.llm.topk import Candidates, DualSearch


@pytest.mark.parametrize("own", [1, 2, 6, 9])
@pytest.mark.parametrize("other", [1, 3, 7])
def test_only_the_own_row_is_left_out(own, other, k=5):
    ids = np.array([0] * own + [i for i in range(1, 8) for _ in range(other)] + [20, 21])
    x = np.array([[4, 4]] * (len(ids) - 2) + [[1, 1], [1, 0]])
    block = Candidates(ids, np.arange(len(ids)), x, k)
    rows, q_ids, found, scores = DualSearch(np.array([0]), np.array([0]), np.array([[4, 4]]), np.array([-np.inf]), block, k).run()
    want = sorted((-int(v @ [4, 4]), int(i)) for i, v in list(zip(ids, x, strict=True))[1:])[:k]
    assert [(-int(s), int(i)) for i, s in zip(found, scores, strict=True)] == want and set(q_ids) == set(rows) == {0}


def test_no_candidates():
    none = Candidates(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1), np.int64))
    assert [len(a) for a in DualSearch(np.array([0]), np.array([0]), np.array([[1]]), np.array([-np.inf]), none).run()] == [0] * 4


def test_query_rows_of_one_id_rank_apart(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (60, [1.0, 0.0]), (61, [0.5, 0.5]), (50, [1.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=2).collect()
    floors = [(i, [int(256 * c) for c in v]) for i, v in rows]
    want = []
    for n, (i, q) in enumerate(floors):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for m, (j, x) in enumerate(floors) if m != n)[:2]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_components_past_whole_scores_are_refused(spark):
    df = spark.createDataFrame([(50, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large for whole scores"):
        topk.top_k(df, F.col("vec_id") == 50).collect()

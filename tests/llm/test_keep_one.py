"""One row of each group stays, whatever ids its rows have."""

import pytest

import corpus_pipeline
from siltlake.llm import simhash


@pytest.mark.parametrize("keep", [simhash.keep_one, lambda docs: corpus_pipeline.deduplicated(docs.sparkSession, docs, "")], ids=["simhash", "stage"])
def test_null_and_reused_ids_lose_no_group(spark, keep):
    text = lambda g: " ".join(f"{g}{k}" for k in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (1, text("c"))]
    rows += [(7, text("d")), (7, text("e")), (7, text("e")), (8, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in keep(docs).collect()), key=repr)
    assert got == sorted([(None, text("a")), (None, text("b")), (1, text("c")), (7, text("d")), (7, text("e"))], key=repr)

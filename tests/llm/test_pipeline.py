"""The registered queries on a small fixture, and the pipeline's stages."""

import hashlib

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from siltlake.llm import mixing, quality, simhash, toxicity
from siltlake.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_the_fixture(spark, saved, name):
    df = QUERIES[name](spark, saved)
    rows = df.collect()
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        duck = duckdb.connect()
        for t in ("documents", "labels", "pages", "embeddings"):
            duck.sql(f"create view {t} as select * from '{saved}/{t}.parquet/*.parquet'")
        cols = sorted(df.columns)
        want = duck.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
        # a shorter vector stands in the fixture: SQL's zip fills it with nulls, as zeros
        assert sorted(map(repr, (tuple(r[c] for c in cols) for r in rows))) == sorted(map(repr, want))


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "mixing", "bpe"]


def test_pipeline_stage_by_stage(spark, tmp_path, vocabulary):
    """Against the operators' own verdicts, which their tests hold to plain Python."""
    base = "the town of the river and {} is in the west with all of its old houses that no one from the east has seen"
    rows = []
    for i in range(120):
        text = " ".join(base.format(f"place{i}x{k}") for k in range(4))
        if i % 10 == 3:
            text += " moronic trashy idiotic"
        rows.append((i, text if i % 9 else "too short", "en", f"s{i % 4}", len(text)))
    rows += [(200 + i, rows[1][1], "en", "s1", 1) for i in range(5)] + [(300, None, None, None, None), (301, "", None, None, 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 3)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    labels = spark.read.parquet(f"{d}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out-{name}")
        seen[name] = (docs, spark.read.parquet(f"{d}/out-{name}"))
        docs = seen[name][1]
    before, after = seen["quality"]
    want = {r.doc_id for r in quality.quality(before).filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == want and 300 not in want
    before, after = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity(before, toxicity.train(before, labels)).filter("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in simhash.near_duplicates(before).collect()}
    before, after = seen["mixing"]
    assert after.count() == sum(r.copies for r in mixing.mix_plan(before).collect())
    before, after = seen["bpe"]
    t = Tokenizer.from_file(vocabulary)
    plain = lambda x: hashlib.sha256(t.decode(t.encode(x, add_special_tokens=False).ids).encode()).hexdigest()
    assert sorted((r.doc_id, r.decoded_sha256) for r in after.collect()) == sorted((r.doc_id, plain(r.text)) for r in before.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(map(tuple, after.collect()))


def test_pipeline_on_nothing(spark, tmp_path, docs):
    d = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0

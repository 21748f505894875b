"""Quality, mixing and sharding against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltlake.llm import mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows):
    got = quality.quality(docs.withColumn("n", F.monotonically_increasing_id()), keep=("text",)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_stage_keeps_columns(docs, no_docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert quality.keep_good(no_docs).count() == 0
    assert quality.quality(no_docs).count() == 0


def test_quality_needs_no_python(docs):
    plan = quality.quality(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Share the total by weight, cut at the caps, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), share * sum(sizes.values())
    open_ = [s for s in order if sizes[s] > 0]
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        part = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, p in part.items():
            room = most * sizes[s] - target[s]
            target[s] += min(p, room)
            left += max(0.0, p - room)
        open_ = [s for s in open_ if most * sizes[s] - target[s] > 1e-9]
    return target


def test_mixing(docs, rows):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        draw = int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:mix".encode()).hexdigest()[:13], 16) / 2**52
        assert r.copies == int(rate) + (draw < rate - int(rate))
    assert sorted(map(tuple, mixing.mix_plan(docs).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixing_emits_copies(docs, no_docs):
    plan = mixing.mix_plan(docs)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(no_docs).count() == 0 and mixing.mix_plan(no_docs).count() == 0


def test_mixing_comes_near_targets(spark):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), 5).alias("text")
    )
    for r in mixing.mix_plan(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.05)


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [str(i) for i in range(3000)] + [""]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", *[sharding.jump(sharding.key_hash(F.col("k")), n).alias(f"n{n}") for n in (1, 24, 25)])
    rows = df.collect()
    for r in rows:
        key = int(hashlib.md5(r.k.encode()).hexdigest()[:15], 16)
        assert (r.n1, r.n24, r.n25) == (0, plain_jump(key, 24), plain_jump(key, 25))
        assert r.n25 in (r.n24, 24)
    assert 0.02 < sum(r.n25 == 24 for r in rows) / len(rows) < 0.06
    with pytest.raises(ValueError):
        sharding.jump(F.lit(1), 0)


def test_shards_are_numbered_without_gaps(docs, rows, no_docs):
    got = sharding.shard(docs, sub_buckets=4).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id])) for r in got)
    assert sharding.shard(no_docs).count() == 0


def test_shards_are_written(docs, rows, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = docs.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and set(r.shard for r in back.select("shard").collect()) <= {0, 1, 2}

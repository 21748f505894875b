"""Near copies by five-word shingles against brute force, and one row of each group."""

import hashlib
import random

import corpus_pipeline
from siltlake.llm import nearcopies, simhash


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts):
    sets = list(map(plain_set, texts))
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def edited_texts():
    rnd = random.Random(5)
    line = "this page is kept by the town and all of its rights are kept too".split()
    texts = [None, "", " \t", "one two", "One TWO", "one two three"]
    for g in range(25):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([12, 60, 150, 400]))] + line * (g % 3)
        for _ in range(rnd.randint(1, 6)):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(9999)}"
            texts.append(" ".join(words))
    # copies of one text that are too far from each other
    base = [f"m{k}" for k in range(200)]
    for c in range(40):
        words = list(base)
        for k in rnd.sample(range(0, 200, 12), 4):
            words[k] = f"y{c}"
        texts.append(" ".join(words))
    texts.append(" ".join(base))
    rnd.shuffle(texts)
    return texts


def test_stage_keeps_one_of_each_group(spark):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_groups(texts)
    kept = corpus_pipeline.deduplicated(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    got = {r.doc_id: r.component for r in nearcopies.groups(docs).collect()}
    assert len(set(zip(want, (got[i] for i in range(len(want))), strict=True))) == len(set(want)) == len(set(got.values()))


def test_stage_finds_edited_copies(spark):
    """One word in 120 is another: over two bits of a SimHash, Jaccard 0.92."""
    rnd, rows = random.Random(6), []
    for g in range(20):
        words = [f"w{rnd.randrange(3000)}" for _ in range(120)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:60], "edited", *words[61:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_threshold_is_met_exactly(spark):
    # 9 words less one at the end: 4 of 5 shingles, and one more below that
    words = [f"w{k}" for k in range(9)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:8])), (3, " ".join(f"v{k}" for k in range(8))), (4, " ".join(f"v{k}" for k in range(7)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == [1, 3, 4]


def test_simhashes_link_first(spark):
    """Without any shared key: what is linked is what SimHashes of five words within two
    bits name and whole sets confirm, and the links of large groups are kept."""
    rnd, texts = random.Random(7), []
    for _ in range(30):
        words = [f"w{rnd.randrange(3000)}" for _ in range(600)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join([*words[:300], "edited", *words[301:]])]
    sets = [nearcopies.shingle_set(t.encode()) for t in texts]
    prints = [simhash.fingerprint(s) for s in sets]
    numbers = [nearcopies.set_number(s) for s in sets]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = [(numbers[i], len(s), signed[i], nearcopies.parity_sketch(s), hashlib.md5(texts[i].encode()).hexdigest()) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, n int, fp long, sketch binary, digest string")
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = spark.createDataFrame([], "key long, node long, n int")
    root = {r.node: r.root for r in nearcopies.similar_sets(docs, keys, nodes).collect()}
    want = list(range(len(texts)))
    for i in want:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                want = [want[j] if g == want[i] else g for g in want]
    got = [root.get(n, n) for n in numbers]
    assert 30 <= len(set(want)) < 90 and len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))

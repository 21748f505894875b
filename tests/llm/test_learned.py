"""SimHash, toxicity, language and URL operators, and exact search."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltlake.llm import components, langid, simhash, topk, toxicity, urlfilter
from siltlake.llm.codepoints import CodePoints


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(docs, rows, no_docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fp = {r[0]: plain_fingerprint(r[1]) for r in rows}
    roots = plain_components(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fp.items():
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    for r in got:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}"
        assert r.component_id == least.get(roots[fp[r.doc_id]])
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("bucket", [4096, 3])
def test_pigeonring_loses_no_link(spark, bucket):
    rnd, fps = random.Random(2), set()
    for _ in range(30):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 40)):
            fps.add(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in components.components(simhash.link_edges(simhash.bucket_rows(df, bucket=bucket))).collect()}
    want = plain_components(sorted(map(signed, fps)), lambda a, b: ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2)
    assert {n: got.get(n, n) for n in want} == want


def test_chains_hold_for_every_pair():
    rnd, masks = random.Random(3), simhash.chain_masks(2, 5)
    for _ in range(4000):
        d = 0
        for _ in range(2):
            d |= 1 << rnd.randrange(64)
        assert any(all((d & m).bit_count() <= b for m, b in chain) for chain in masks)
    assert [b for _, b in masks[0]] == [0, 0, 1, 1, 2]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(docs, no_docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {2, 12}.isdisjoint(ids) and {1, 8, 9} <= set(ids)
    assert simhash.keep_one(no_docs).count() == 0


def _marked(spark, n=600):
    rnd = random.Random(4)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic = i % 3 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["idiotic", "trashy", "moronic"])
        # a group is named more often in toxic texts
        if rnd.random() < (0.8 if toxic else 0.1):
            words.insert(0, "women")
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_and_ignores_groups(spark):
    df = _marked(spark)
    labels = df.select("doc_id", "toxic")
    model = toxicity.train(df, labels)
    got = toxicity.toxicity(df, model).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    score = lambda t: float(model.score([t], CodePoints())[0])
    assert score("women waa wba wca") < 0.5
    loose = toxicity.fit(toxicity.sample_features(df, labels).toArrow(), counterfactual=0.0)
    gap = lambda m: abs(m.score(["women waa"], CodePoints())[0] - m.score(["men waa"], CodePoints())[0])
    assert gap(model) < gap(loose)


def test_toxicity_edges(docs, rows, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1), (3, 0), (7, None), (None, 1), (8, 1), (8, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, toxicity.train(docs, none)).collect()} == {0.0}
    got = toxicity.toxicity(docs, toxicity.train(docs, some)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep_civil(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert toxicity.keep_civil(no_docs, none).count() == 0
    assert toxicity.swap_terms("Women and men") == "men and women" and toxicity.swap_terms("nobody") is None


def test_language_ids(spark, docs, rows, no_docs):
    assert {r.lang_pred for r in langid.identify(docs, langid.train(no_docs)).collect()} == {"und"}
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (4, 5, 6, 13)} == dict.fromkeys((4, 5, 6, 13), "und")
    assert langid.identify(no_docs, langid.train(docs)).count() == 0


def test_language_accuracy(spark):
    rnd = random.Random(6)
    parts = {"aa": ["kra", "tol", "min"], "bb": ["zui", "pex", "woj"], "cc": ["kra", "zui", "hef"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang) for i, lang in enumerate(list(parts) * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.train(df)).join(df, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_more_than_64_languages():
    names = [f"l{i:02}" for i in range(70)]
    grams = {n: np.random.default_rng(i).integers(0, 2**63, 50).astype(np.uint64) for i, n in enumerate(names)}
    f = langid.Filters.of(names, grams)
    assert len(f.slices) == 2
    for i, n in enumerate(names):
        assert all(int(m) >> (i % 64) & 1 for m in f.masks(grams[n])[i // 64])


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, *best


def test_url_rules(spark):
    rnd = random.Random(7)
    hosts = ["com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "b.net", "net", "notexample.com", "com.", "", "x.org:80", "u@example.com"]
    urls = [None, "", "x", "http://"] + [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en', '/es/x', '/fr/', '/en/?q=/x', '#/en/', '?a://b'])}" for _ in range(400)]
    df = spark.createDataFrame([(i % 300, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = urlfilter.url_verdicts(df).collect()
    assert Counter((r.host, r.path, r.rule, r.verdict) for r in got) == Counter(map(plain_verdict, urls))
    assert urlfilter.url_verdicts(df.limit(0)).count() == 0


def test_trie_fragments_and_conflicts():
    t = urlfilter.UrlTrie([("allow", "a.com", "/x"), ("block", "a.com", "/xy/z"), ("allow", "a.com", ""), ("block", "a.com", "/q"), ("allow", "a.com", "/q")])
    assert t.match("a.com", "/xylo") == ("a.com/x", "allow")
    assert t.match("b.a.com", "/xy/zz") == ("a.com/xy/z", "block")
    assert t.match("a.com", "/n") == ("a.com", "allow") and t.match("a.com", "/q1")[1] == "block" and t.match("com", "/") is None
    with pytest.raises(ValueError):
        urlfilter.UrlTrie([("maybe", "a", "/")])


def plain_top(rows, k=5):
    vecs = {i: v for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in vecs.items()}
    out = []
    for q, a in whole.items():
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in whole.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark, saved):
    df = spark.read.parquet(f"{saved}/embeddings.parquet")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == plain_top([tuple(r) for r in df.collect()])
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SMALLEST", 64)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * 0.1 + (i % 5)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain_top(rows)


def test_dual_trees_prune_and_agree():
    rng = np.random.default_rng(9)
    x = np.floor(256 * (rng.normal(size=(3000, 4)) + 6 * rng.integers(0, 4, (3000, 1)))).astype(np.int64)
    q = x[:60]
    search = topk.DualSearch(np.arange(60), np.arange(60), q, np.full(60, -np.inf), topk.Candidates(np.arange(3000), np.arange(3000), x))
    got = {}
    for _, a, b, s in zip(*search.run(), strict=True):
        got.setdefault(int(a), []).append((-int(s), int(b)))
    for i in range(60):
        s = x @ q[i]
        assert sorted(got[i]) == sorted((-int(s[j]), j) for j in range(3000) if j != i)[:5]
    assert search.pruned > 0

"""The learned operators against plain versions of themselves, and on the real tables."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siltlake.llm import langid, toxicity
from siltlake.llm.codepoints import CodePoints

REAL = "/root/testdata"
real = pytest.mark.skipif(not os.path.isdir(f"{REAL}/sf0.1"), reason="the tables are not here")


def plain_features(text):
    """Words, and beginnings of 4, 5 and 6 letters of longer words."""
    words = re.findall(r"[a-z]+", (text or "").lower())
    return {("word", w) for w in words} | {("start", w[:k]) for w in words for k in (4, 5, 6) if len(w) > k}


def plain_scores(train, texts, steps=400, ridge=1e-3, support=4):
    """The classifier over dense matrices: its own choice of features, fit and scores."""
    y = np.array([t for _, t in train], float)
    sets = [plain_features(x) for x, _ in train]
    n1, n0 = y.sum(), (1 - y).sum()
    pos, neg = Counter(f for s, t in zip(sets, y, strict=True) if t for f in s), Counter(f for s, t in zip(sets, y, strict=True) if not t for f in s)
    names = set()
    for f in {*pos, *neg}:
        gain = abs(pos[f] / n1 - neg[f] / n0) * abs(np.log((pos[f] + 0.5) / (n1 + 1)) - np.log((neg[f] + 0.5) / (n0 + 1)))
        if gain > 0 and pos[f] + neg[f] >= min(support, n1):
            names.add(f)
    swaps = []
    for text, _ in train:
        for s in toxicity.sentences(text):
            if (other := toxicity.swap_terms(s)) is not None:
                a, b = plain_features(s), plain_features(other)
                swaps.append((a - b, b - a))
                names |= (a - b) | (b - a)
    at = {f: k for k, f in enumerate(sorted(names))}
    rows = lambda many: np.array([[float(f in s) for f in at] for s in many])
    x, d = rows(sets), rows([b for _, b in swaps]) - rows([a for a, _ in swaps]) if swaps else np.zeros((0, len(at)))
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, m, v = np.zeros(len(at) + 1), np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    for t in range(1, steps + 1):
        e = share * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
        g = np.append(x.T @ e + ridge * w[:-1] + (2 / len(d) * d.T @ (d @ w[:-1]) if len(d) else 0), e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return 1 / (1 + np.exp(-(rows([plain_features(t) for t in texts]) @ w[:-1] + w[-1])))


def test_toxicity_is_the_plain_classifier(spark):
    rnd, plain = np.random.default_rng(4), [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}stone" for i in range(40)]
    rows = []
    for i in range(300):
        words = rnd.choice(plain, rnd.integers(5, 40)).tolist()
        toxic = i % 3 == 0
        if toxic:
            words[int(rnd.integers(len(words)))] = str(rnd.choice(["idiotic", "trashy", "moronic"]))
        if rnd.random() < (0.8 if toxic else 0.1):
            words.insert(0, str(rnd.choice(["women", "men", "muslim", "asian"])))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    df = spark.createDataFrame([*rows, (300, None, None), (301, "", None)], "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(df, toxicity.train(df, df.select("doc_id", "toxic"))).collect()}
    train = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    want = plain_scores(train, [t for _, t, _ in rows] + [None, ""])
    assert np.allclose([got[i] for i in range(302)], want, atol=1e-6)


def plain_grams(text):
    """Four letters or blanks in a row with one blank at most; what is no letter is a blank."""
    t = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text or ''} ")
    return [g for g in (t[i : i + 4] for i in range(len(t) - 3)) if g.count(" ") <= 1]


@real
def test_languages_are_those_of_exact_sets(spark):
    rows = [r for r in spark.read.parquet(f"{REAL}/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, filters).collect()}
    known = [r for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    sets, cps = {}, CodePoints()
    for lang in {r.lang for r in known}:
        mine = [r for r in known if r.lang == lang]
        seen = Counter(g for r in mine for g in set(plain_grams(r.text)))
        sets[lang] = {g for g, n in seen.items() if n >= max(1, int(langid.LEAST_SHARE * len(mine)))}
        # the filter adds hits, it loses none
        keys = np.concatenate([cps.grams(g, langid.GRAM)[1] for g in sets[lang]])
        bit = np.uint64(1 << filters.languages.index(lang))
        assert len(keys) == len(sets[lang]) and ((filters.masks(keys)[0] & bit) != 0).all()
    compared = agreed = 0
    for r in rows:
        grams = plain_grams(r.text)
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        hits = {lang: sum(g in s for g in grams) for lang, s in sets.items()}
        top = max(hits.values())
        for k, lang in enumerate(filters.languages):
            assert filters.chance[k] < 0.02
        if grams and list(hits.values()).count(top) == 1:
            compared += 1
            agreed += hits[got[r.doc_id].lang_pred] >= top - 0.02 * len(grams)
            # a share corrected for chance stays near the exact one
            assert abs(got[r.doc_id].score - hits[got[r.doc_id].lang_pred] / len(grams)) < 0.05
    assert compared > 900 and agreed == compared


@real
def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{REAL}/sf0.1/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).filter("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.99


@real
def test_toxicity_of_held_out_rows_and_of_neutral_mentions(spark):
    docs, labels = (spark.read.parquet(f"{REAL}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = toxicity.toxicity(docs, model).filter("held_out").join(labels, "doc_id").filter("toxic is not null").collect()
    caught = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert caught / sum(r.toxic == 1 for r in got) > 0.85 and caught / sum(r.predicted == 1 for r in got) > 0.9
    terms = [t for g in toxicity.IDENTITY_TERMS for t in g]
    score = lambda t: float(model.score([t], CodePoints())[0])
    neutral = [f"The {t} of the old town met on the market and talked about the weather." for t in terms]
    plain = score("The people of the old town met on the market and talked about the weather.")
    assert all(score(t) < 0.5 for t in neutral) and max(abs(score(t) - plain) for t in neutral) < 0.2

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward, empty, prose

from grainsift.llm import kneser_ney as K


def brute(train, texts):
    """Log probabilities by the textbook recursion, on the words themselves."""
    seqs = [words(t) for t in train]
    bigrams = Counter(p for s in seqs for p in zip(s[:-1], s[1:], strict=True))
    d = K.discounts(np.array([sum(c == k for c in bigrams.values()) for k in (1, 2, 3, 4)]))
    before = Counter(w for _, w in bigrams)
    e = K.discounts(np.array([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)]))
    whole = sum(before.values())
    spare = sum(e[min(c, 3)] for c in before.values()) / whole
    sums, kinds = Counter(), Counter()
    for (v, _), c in bigrams.items():
        sums[v] += c
        kinds[v] += d[min(c, 3)]

    def p1(w):
        c = before[w]
        return (c - e[min(c, 3)] if c else 0) / whole + spare / (len(before) + 1)

    def p2(v, w):
        if not sums[v]:
            return p1(w)
        c = bigrams[v, w]
        return max(c - d[min(c, 3)], 0) / sums[v] * (c > 0) + kinds[v] / sums[v] * p1(w)

    # probabilities sum to one, an unknown word included
    for v in [*list(sums)[:5], "nowhere"]:
        assert sum(p2(v, w) for w in [*before, "unknown"]) == pytest.approx(1)
    out = []
    for t in texts:
        s = words(t)
        out.append(math.log(p1(s[0])) + sum(math.log(p2(v, w)) for v, w in zip(s[:-1], s[1:], strict=True)))
    return out


def words(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-\x7f]+", text or "") + ["<end>"]


def corpus(spark, n=160):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(3, 150), 400), rng.choice(["en", "de"]), "s", 0) for i in range(n)]
    labels = [(i, 1 if i % 4 else 0, 0) for i in range(n) if i % 3]
    from fixtures import DOCS

    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1] for r in rows}


@pytest.mark.parametrize("hot", [(0, 0), (40, 25), (1 << 20, 1 << 18)])
def test_scores_are_the_models(spark, monkeypatch, hot):
    """Whatever part of the model is hot, and with blocks of a few documents."""
    monkeypatch.setattr(K, "BLOCK_TOKENS", 900)
    monkeypatch.setattr(K, "KEYS_A_ROW", 1)
    monkeypatch.setattr(K, "HOT_PAIRS", hot[0])
    monkeypatch.setattr(K, "HOT_WORDS", hot[1])
    docs, labels, texts = corpus(spark)
    scored, trusted = K.scores(docs, labels)
    train = [texts[r["tid"]] for r in trusted.where("train").collect()]
    assert 10 < len(train) < 100
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == len(texts)
    for i, want in zip(texts, brute(train, texts.values()), strict=True):
        assert got[i]["logp"] == pytest.approx(want, rel=1e-5)
        assert got[i]["tokens"] == len(words(texts[i])) - 1


def test_judge_against_brute_force(spark):
    docs, labels, texts = corpus(spark, 400)
    trusted = {r["tid"]: r["train"] for r in K.trusted_ids(labels).collect()}
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    logp = dict(zip(texts, brute([texts[i] for i, t in trusted.items() if t], texts.values()), strict=True))
    score = {i: -logp[i] / len(words(texts[i])) for i in texts}
    held = {lang: [score[i] for i, t in trusted.items() if not t and langs[i] == lang] for lang in ("en", "de")}
    mean = {lang: sum(x) / len(x) for lang, x in held.items()}
    over = {lang: sorted(x - mean[lang] for x in xs) for lang, xs in held.items()}

    def quantile(xs):  # the least that so many don't exceed
        return xs[math.ceil(K.QUANTILE * len(xs)) - 1]

    every = quantile(sorted(over["en"] + over["de"]))
    limit = {}
    for lang, xs in over.items():
        own = quantile(xs)
        limit[lang] = math.exp(mean[lang] + own + max(every - own, 0) * K.SPREAD_TEXTS / (len(xs) + K.SPREAD_TEXTS)) * K.MARGIN
    got = {r["doc_id"]: r for r in K.judge(docs, labels).collect()}
    assert len(got) == 400
    for i, r in got.items():
        assert r["perplexity"] == pytest.approx(math.exp(score[i]), rel=1e-4)
        assert r["threshold"] == pytest.approx(limit[langs[i]], rel=1e-4)
        assert r["keep"] == (r["perplexity"] <= r["threshold"])


@pytest.mark.parametrize("docs", [1, 10**5, 10**8, 10**11])
def test_grid(docs):
    rng = np.random.default_rng(0)
    grid = K.Grid(docs)
    v, w = rng.integers(0, 1 << K.BITS, 1000).astype(np.uint64), rng.integers(0, 1 << K.BITS, 1000).astype(np.uint64)
    key = grid.key(v, w)
    a, b = grid.split(key)
    assert (a == v).all() and (b == w).all()
    assert len(np.unique(key)) == 1000
    short = grid.short(key, 52)
    assert (short >> np.uint64(52 - grid.bits) == key >> np.uint64(64 - grid.bits)).all()
    assert len(np.unique(short)) == 1000 and int(short.max()) < 1 << 52


def test_codec():
    rng = np.random.default_rng(0)
    for n in (0, 1, 500):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        counts = rng.integers(1, 9, len(keys)).astype(np.uint64)
        who = rng.integers(0, 60_000, int(counts.sum())).astype(np.uint64)
        for got, want in zip(K.decode(K.encode(keys, counts, who)), (keys, counts, who), strict=True):
            assert (got == want).all()
    everyone = np.tile(np.arange(4000, dtype=np.uint64), 5)  # five keys that all documents ask for
    assert len(K.encode(np.arange(5).astype(np.uint64), np.full(5, 4000, np.uint64), everyone)) < 200


def test_hot_part_is_bounded():
    counts = np.random.default_rng(3).zipf(1.3, 50_000)
    for most in (0, 10, 1000, 10**6):
        least = K._frequent(K._histogram(counts[counts < 1 << 40])[6:], most)
        assert (counts[counts < 1 << 40] >= least).sum() <= most


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(8)
    good = [(i, prose(rng, rng.randint(30, 150), 300), "en", "s", 0) for i in range(900)]
    junk = [(1000 + i, " ".join(f"{rng.randrange(10**9):x}###" for _ in range(80)), "en", "s", 0) for i in range(60)]
    from fixtures import DOCS

    docs = spark.createDataFrame(good + junk, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in K.drop_low_quality(docs, labels).collect()}
    assert len(kept & {r[0] for r in good}) >= 890
    assert not kept & {r[0] for r in junk}


def test_rare_languages_are_judged_by_their_own(spark):
    """A few trusted texts in a language of other words, and a language without any."""
    rng = random.Random(9)

    def rare(prefix):
        return prose(rng, rng.randint(60, 120), 3000).replace("w", prefix).replace("W", prefix)

    from fixtures import DOCS

    rows = [(i, prose(rng, rng.randint(60, 120), 60), "en", "s", 0) for i in range(600)]
    rows += [(1000 + i, rare("q"), "de", "s", 0) for i in range(60)]
    rows += [(2000 + i, rare("k"), "is", "s", 0) for i in range(20)]
    labels = [(i, 1, 0) for i in range(500)] + [(1000 + i, 1, 0) for i in range(24)]
    docs = spark.createDataFrame(rows, DOCS)
    rated = {r["doc_id"]: r for r in K.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    limits = {lang: {r["threshold"] for r in rated.values() if r["lang"] == lang} for lang in ("en", "de", "is")}
    assert all(len(x) == 1 for x in limits.values())
    assert limits["is"] == {None} and max(limits["de"]) > 2 * max(limits["en"])
    assert sum(rated[1000 + i]["keep"] for i in range(60)) >= 57
    assert all(rated[2000 + i]["keep"] for i in range(20))
    assert sum(rated[i]["keep"] for i in range(600)) >= 590


def test_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, 1, None) for i in range(30)] + [(None, 1, 0), (3, 0, 0), (4, None, 0), (5, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rated = K.judge(docs, labels).collect()
    assert len(rated) == docs.count()
    assert all((r["perplexity"] is None) == (not r["tokens"]) and r["keep"] in (True, False) for r in rated)
    assert not any(r["keep"] for r in rated if not r["tokens"])
    trusted = {r["tid"] for r in K.trusted_ids(labels).collect()}
    assert trusted == set(range(30)) - {3, 5}  # a null label says nothing
    kept = K.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["keep"] for r in rated)


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert K.judge(empty(spark), labels).count() == 0
    docs, some, _ = corpus(spark, 12)
    assert K.drop_low_quality(docs, labels).count() == 12  # nothing to judge by
    assert K.drop_low_quality(empty(spark), some).count() == 0

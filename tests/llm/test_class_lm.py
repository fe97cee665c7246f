"""Operator 11: contract columns against brute force, a normalised model, exact exchange gains, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import class_lm as lm
from tests.llm.conftest import ODD, SF, make


def words(text):
    return (text or "").encode().lower().split() + [b""]


def brute(model, docs):
    """{row: (n_tokens, n_known, base, score)} from the model's tables, one token after the other."""
    table = {bytes(r["word"]): (r["n"], r["cls"]) for r in model.words.collect()}
    k, out = len(model.sums), []
    for _, text in docs:
        before, base, score, known = lm.END_CLASS, 0.0, 0.0, 0
        toks = lm.tokens((text or "").encode())
        for w in toks:
            n, c = table.get(w, (0, k))
            known += n > 0
            base += math.log10((n + 1) / (model.total + model.size + 1))
            score += model.steps[before, c] + (math.log10(n) - model.sums[c] if n else 0)
            before = c
        out.append((len(toks), known, base, score))
    return out


def test_contract_columns_and_held_out_gain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = {r["doc_id"]: r for r in lm.query(spark, SF).collect()}
    assert len(out) == len(rows)
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    c = Counter(w for d, t in rows if d not in held for w in words(t))
    total, size = sum(c.values()), len(c)
    for d, t in rows:
        w, r = words(t), out[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d in held, len(w), sum(x in c for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (total + size + 1)) for x in w), rel_tol=1e-9)
    for part in (held, set(out) - held):
        assert sum(out[d]["score"] for d in part) > sum(out[d]["base_score"] for d in part)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "abc"]  # a, b, c words come in turn
    return [(i, " ".join(r.choice(kinds[j % 3]) for j in range(r.randrange(3, 40)))) for i in range(400)]


def test_classes_follow_the_contexts_and_scores_equal_brute_force(spark, corpus, monkeypatch):
    docs = make(spark, corpus).repartition(4)
    model = lm.fit(docs, n_classes=12)
    assert all(a <= b + 1e-6 for a, b in zip(model.likelihood, model.likelihood[1:]))  # no accepted round lowers it
    of = {bytes(r["word"]): r["cls"] for r in model.words.collect()}
    kinds = {c: {w[:1] for w in of if of[w] == c} for c in set(of.values())}
    assert sum(len(v) > 1 for v in kinds.values()) <= 1  # a class holds words of one kind
    got = lm.score(docs, model).collect()
    # shared words only, then words joined by the shuffle, then a mixture: the same scores
    for shared in (1, 120, lm.SHARED):
        got = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm.score(docs, model, shared=shared).collect()}
        for (d, _), want in zip(corpus, brute(model, corpus)):
            assert got[d][:2] == want[:2] and np.allclose(got[d][2:], want[2:], rtol=1e-9)
    # classes tell more than word counts
    m1 = lm.perplexity(sum(v[3] for v in got.values()), sum(v[0] for v in got.values()))
    m0 = lm.perplexity(sum(v[2] for v in got.values()), sum(v[0] for v in got.values()))
    assert m1 < 0.5 * m0


def test_words_outside_the_core_join_by_their_contexts(spark, corpus):
    docs = make(spark, corpus)
    model = lm.fit(docs, n_classes=12, core=124)  # some words are below 1/124 of the tokens
    n_core = sum(r["n"] * 124 >= model.total for r in model.words.collect())
    assert 12 < n_core < model.size
    c = Counter(w for _, t in corpus for w in words(t))
    assert {bytes(r["word"]): r["n"] for r in model.words.collect()} == dict(c)
    of = {bytes(r["word"]): r["cls"] for r in model.words.collect()}
    kinds = {k: Counter(w[:1] for w in of if of[w] == k) for k in set(of.values())}
    assert sum(max(v.values()) for v in kinds.values()) > 0.95 * len(of)


def test_probabilities_sum_to_one(spark, corpus):
    model = lm.fit(make(spark, corpus), n_classes=12)
    used = 10 ** model.steps
    assert np.allclose(used.sum(1), 1)
    totals = 10 ** model.sums
    per_class = Counter()
    for r in model.words.collect():
        per_class[r["cls"]] += r["n"] / totals[r["cls"]]
    assert all(math.isclose(v, 1) for v in per_class.values())


def test_gain_of_a_class_is_the_exact_difference_of_likelihoods():
    r = np.random.default_rng(2)
    words_, k = 9, 4
    pairs = r.integers(0, 6, (words_, words_)).astype(float)
    cls = r.integers(0, k, words_)

    def of(cls):
        m = np.zeros((k, k))
        np.add.at(m, (cls[:, None].repeat(words_, 1), cls[None, :].repeat(words_, 0)), pairs)
        return m

    for w in range(words_):
        others = np.arange(words_) != w
        right = np.bincount(cls[others], pairs[w][others], k)
        left = np.bincount(cls[others], pairs[:, w][others], k)
        m = of(cls)
        c = cls[w]
        m[c, :] -= right
        m[:, c] -= left
        m[c, c] -= pairs[w, w]
        gain = lm.class_gain(m, right, left, pairs[w, w])
        want = []
        for b in range(k):
            moved = cls.copy()
            moved[w] = b
            want.append(lm.likelihood(of(moved)))
        assert np.allclose(gain - gain[0], np.array(want) - want[0])


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    docs = make(spark, ODD).selectExpr("*", "1 as id", "2 as row", "3 as rare", "4 as word", "5 as n", "6 as cls", "7 as score")
    model = lm.fit(docs, n_classes=4)
    rows = [(r["doc_id"], r["n_tokens"], r["n_known"]) for r in lm.score(docs, model).collect()]
    assert sorted(rows, key=str) == sorted(((d, len(words(t)), len(words(t))) for d, t in ODD), key=str)
    for d, want in zip(ODD, brute(model, ODD)):
        assert want[3] <= 0
    assert lm.score(docs.limit(0), model).count() == 0
    nothing = lm.fit(docs.limit(0))
    got = lm.score(docs, nothing).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in got) and len(got) == len(ODD)
    unseen = lm.score(make(spark, [(1, "never " + "z" * 100_000)]), model).first()
    assert (unseen["n_tokens"], unseen["n_known"]) == (3, 1)


def test_the_split_is_by_id(spark):
    ids = spark.range(50).select(F.col("id"), lm.remainder(F.col("id")).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in ids)


def test_class_bigrams_count_every_neighbour(spark, monkeypatch):
    """Words outside the core, and outside the table that all tasks get, next to each other too."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "of", f"w{r.randrange(60)}", f"w{r.randrange(60)}"]) for _ in range(r.randrange(1, 30)))) for i in range(200)]
    monkeypatch.setattr(lm, "SHARED", 40)
    model = lm.fit(make(spark, rows).repartition(3), n_classes=4, core=20)
    of = {bytes(x["word"]): (x["n"], x["cls"]) for x in model.words.collect()}
    few = {w for w, (n, _) in of.items() if n * 40 < model.total}
    pairs = Counter()
    for _, t in rows:
        toks = [b"", *lm.tokens(t.encode())]
        pairs.update(zip(toks, toks[1:]))
    assert sum(n for (a, b), n in pairs.items() if a in few and b in few) > 100
    m, totals = np.zeros((4, 4)), np.zeros(4)
    for (a, b), n in pairs.items():
        m[of[a][1], of[b][1]] += n
    for n, c in of.values():
        totals[c] += n
    assert np.allclose(model.steps, lm.transitions(m, totals, sum(n == 1 for n, _ in of.values()), model.total, model.size))

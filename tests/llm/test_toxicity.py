import itertools
import random

import cases
import numpy as np
from pyspark.sql import functions as F

from firnline.llm import toxicity

def usable():
    return F.col("doc_id") % 5 != 0
BAD = ["nasty", "vilely", "vilest"]


def corpus(n=300):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        w = cases.words(rng, rng.randint(20, 60)).split()
        bad = i % 5 in (1, 0) and i % 2 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    doc = np.repeat(np.arange(40), rng.integers(1, 9, 40))
    e, trans, start = rng.normal(size=len(doc)) * 2, rng.normal(size=(2, 2)), 0.3
    trans[0, 0] = 0
    m = toxicity.forward_backward(e, doc, trans, start)[2]
    for d in range(40):
        at = np.flatnonzero(doc == d)
        total, marginal = 0.0, np.zeros(len(at))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(e[i] for i, v in zip(at, y) if v) + (start if y[0] else 0) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            marginal += w * np.array(y)
        assert np.allclose(m[at], marginal / total)


def test_long_chain_equals_plain_recursion():
    rng = np.random.default_rng(1)
    p, q, u, v = rng.random((4, 5000))
    q[0] = v[0] = 0
    x, want = 0.0, []
    for t in range(5000):
        x = (p[t] + q[t] * x) / (u[t] + v[t] * x)
        want.append(x)
    assert np.allclose(toxicity.mobius_scan(p, q, u, v), want)
    assert len(toxicity.mobius_scan(*np.empty((4, 0)))) == 0


def test_finds_documents_and_offsets(spark):
    rows, labels = corpus()
    got = toxicity.classify(cases.table(spark, rows), cases.labels(spark, labels), usable()).collect()
    texts = dict(rows)
    held = [r for r in got if r.doc_id % 5 == 0]
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.97
    spans = [texts[r.doc_id][s["start"] : s["end"]] for r in held for s in r.spans]
    assert spans and np.mean([all(w in BAD for w in s.split()) for s in spans]) > 0.95


def test_offsets_are_code_points(spark):
    rows, labels = corpus()
    rows.append((1000, "éé 梦😀 nasty ε nasty nasty"))
    r = toxicity.classify(cases.table(spark, rows), cases.labels(spark, labels), usable()).filter("doc_id = 1000").first()
    assert [rows[-1][1][s["start"] : s["end"]] for s in r.spans] == ["nasty", "nasty nasty"]


def test_odd_texts_labels_and_nothing(spark):
    some = cases.labels(spark, [(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)])
    got = toxicity.classify(cases.odd(spark), some, F.lit(True)).collect()
    assert len(got) == len(cases.odd_texts()) and all(0 <= r.score <= 1 for r in got)
    none = cases.labels(spark, [])
    assert all(r.score <= 0.5 for r in toxicity.classify(cases.odd(spark), none, usable()).collect())
    assert toxicity.classify(cases.empty(spark), none, usable()).count() == 0

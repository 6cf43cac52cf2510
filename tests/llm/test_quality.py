import random

import cases
import numpy as np
from pyspark.sql import functions as F

from firnline.llm import quality


def usable():
    return F.col("doc_id") % 3 != 1


def corpus(n=240):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        w = cases.words(rng, rng.randint(20, 60))
        rows.append((i, w if good else w.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    return rows, labels


def test_learns_what_the_labels_mark(spark):
    rows, labels = corpus()
    got = quality.classify(cases.table(spark, rows), cases.labels(spark, labels), usable()).collect()
    held = [(r.score, r.predicted, labels[r.doc_id][1]) for r in got if r.doc_id % 3 == 1]
    assert len(got) == len(rows) and np.mean([p == y for _, p, y in held]) > 0.97
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p, _ in held)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(120)
    flipped = [(i, 1 - q if i % 3 == 1 else q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in quality.classify(cases.table(spark, rows), cases.labels(spark, x), usable()).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_texts_and_labels(spark):
    some = cases.labels(spark, [(4, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 1), (6, None, None), (999, 1, 0)])
    got = quality.classify(cases.odd(spark), some, F.lit(True)).collect()
    assert len(got) == len(cases.odd_texts()) and all(0 <= r.score <= 1 for r in got)
    empties = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(empties) == 1


def test_no_labels_and_no_rows(spark):
    none = cases.labels(spark, [])
    assert {r.score for r in quality.classify(cases.odd(spark), none, usable()).collect()} == {0.5}
    assert quality.classify(cases.empty(spark), none, usable()).count() == 0


def test_scores_beside_all_columns(spark):
    docs = cases.odd(spark)
    out = quality.with_scores(docs, np.zeros((1 << 8) + 1, dtype=np.float32), "__score")
    assert out.columns == [*docs.columns, "__score"] and out.drop("__score").exceptAll(docs).count() == 0 and out.count() == docs.count()

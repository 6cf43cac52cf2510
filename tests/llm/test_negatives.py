import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.llm import negatives
from firnline.llm.negatives import Tree

SCHEMA = "vec_id long, embedding array<float>, label int, id string, query string, vec string, leaf string, lo string"


def plain(rows, every, positives=5, n_negatives=10):
    """Brute force over (id, vector, label) rows."""
    kept = {
        (i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label)
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for i, v, label in kept:
        if i % every:
            continue
        score = lambda o: sum(a * b for a, b in zip(v, o))  # noqa: B023, E731
        near = sorted((-score(o), j) for j, o, m in kept if m == label and j != i)[:positives]
        others = sorted((-score(o), j) for j, o, m in kept if m != label and j != i)
        for p, j in near:
            fits = [(s, k) for s, k in others if -30 * p <= -100 * s <= -90 * p][:n_negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, every=5, **more):
    df = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % every == 0, **more).collect())


def clustered(n, dims=12, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    return [(i, (centers[i % 6] + rng.normal(size=dims) * 0.4).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("leaf_rows", [4, 60, 10_000])
def test_equals_brute_force_at_every_depth(spark, leaf_rows):
    rows = clustered(260)
    got = run(spark, rows, leaf_rows=leaf_rows)
    assert got and got == plain(rows, 5)


def test_copies_ties_repeats_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "BLOCKS_TOGETHER", 2)
    rows = clustered(90)
    rows += [(200 + i, rows[5][1], i % 3) for i in range(120)]
    rows += [rows[3], rows[10], (10, rows[11][1], 2), (15, rows[15][1], (rows[15][2] + 1) % 3), (7, [0.0] * 12, 1), (500, [0.5, 1.0], 0), (505, [], 1)]
    rows += [(None, rows[0][1], 1), (400, None, 1), (405, rows[0][1], None), (410, [None] * 12, 1), (415, [float("nan")] * 12, 1), (420, [float("inf")] + [0.0] * 11, 1)]
    got = run(spark, rows, leaf_rows=8)
    assert got == plain(rows, 5)


def test_few_rows_one_label_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 2.0], 0)]) == []
    rows = [(i, [1.0, i / 8], 0) for i in range(8)]
    assert run(spark, rows) == []
    assert run(spark, rows + [(9, [0.5, 0.5], 1)]) == plain(rows + [(9, [0.5, 0.5], 1)], 5)
    # Without anchors.
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


def test_scores_beyond_the_doubles_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(1 << 20)) for _ in range(4)], i % 2) for i in range(40)]
    assert run(spark, rows) == plain(rows, 5)


def test_subtrees_are_left_out_only_if_no_row_is_inside():
    rows = np.array([r[1] for r in clustered(3000, seed=3)]) * 256 // 1
    tree = Tree(rows[::3], float((rows * rows).sum(axis=1).max()), 30)
    lifted = tree.lifted(rows)
    leaf = tree.leaves(lifted)
    found = defaultdict(lambda: (np.inf, -np.inf))
    for k in np.unique(leaf):
        for v, i, j, lo, hi in tree.ranges(lifted[leaf == k], k):
            found[v, i, j] = min(lo, found[v, i, j][0]), max(hi, found[v, i, j][1])
    tree.bounded((*k, *r) for k, r in found.items())
    queries = rows[:40]
    scores = queries @ rows.T
    best = np.sort(scores, axis=1)[:, -8]
    looked = np.zeros((len(queries), len(tree.paths)), dtype=bool)
    for k, which in tree.reached(queries, best[:, None], np.full((len(queries), 1), negatives.HIGHEST)):
        looked[which, k] = True
    for r in range(len(queries)):
        assert looked[r, leaf[scores[r] >= best[r]]].all()
    # The tree is worth it: most leaves stay closed.
    assert len(tree.paths) > 50 and looked.mean() < 0.5
    # A window that ends below the best rows leaves the nearest subtrees out as well.
    low = {k: w for k, w in tree.reached(queries, np.full((40, 1), negatives.LOWEST), np.full((40, 1), int(scores.min())))}
    assert sum(map(len, low.values())) < looked.size / 2

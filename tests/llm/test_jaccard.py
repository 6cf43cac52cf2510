import random
import re

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.llm import flat, graph, jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), 1 << 62 if d is None else d)
    return sorted((d or 0, len(sets[i]), 0 if least[find(i)] == 1 << 62 else least[find(i)]) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    got = jaccard.linked(cases.table(spark, rows)).collect()
    return sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got)


def near_copies(rng, n_groups, size, n_words, edits):
    rows = []
    for _ in range(n_groups):
        base = cases.words(rng, n_words).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**9)}"
            rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("seed,groups,size,n_words,edits", [(0, 40, 5, 60, 5), (1, 2, 110, 50, 4), (2, 60, 3, 9, 1), (3, 1, 200, 80, 6)])
def test_components_equal_brute_force(spark, monkeypatch, seed, groups, size, n_words, edits):
    # Small blocks, so that groups fall into several.
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 16)
    rng = random.Random(seed)
    texts = near_copies(rng, groups, size, n_words, edits)
    line = cases.words(rng, 40)
    texts += [line + " " + cases.words(rng, rng.randint(5, 60)) for _ in range(60)] + texts[:20]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_texts(spark):
    assert run(spark, cases.odd_texts()) == brute(cases.odd_texts())
    assert run(spark, []) == []


def test_one_of_each_group_stays(spark):
    docs = cases.odd(spark)
    left = jaccard.without_near_copies(docs)
    assert left.columns == docs.columns
    ids = sorted(r.doc_id for r in left.filter(F.col("doc_id").isNotNull()).collect())
    # 6 and 7 copy 5; the other text of id 7 stays.
    assert ids == sorted(i for i, t in cases.odd_texts() if i not in (None, 6, 7)) + [7] or ids == sorted([i for i, t in cases.odd_texts() if i not in (None, 6, 7)] + [7])
    same = cases.table(spark, [(1, "a b c d e f")] * 3)
    assert jaccard.without_near_copies(same).count() == 1


def test_overlaps_and_shingles():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = jaccard._overlaps(sets)
    off = ~np.eye(20, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()
    import pyarrow as pa

    texts = [t for _, t in cases.odd_texts()]
    for limit in (1, 1000, 1 << 21):
        n = [len(s) for part in flat.slices(pa.array(texts), limit) for s in jaccard.shingle_sets(part)]
        assert n == [len(shingles(t)) for t in texts]


def test_components_of_chains_stars_and_circles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0

import math
import random
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from firnline.llm import flat, lm
from firnline.llm.common import remainder

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def base(rows, training):
    c = Counter(w for i, t in rows if training(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((i or 0, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)


def in_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def test_base_equals_plain_counts(spark, monkeypatch):
    rng = random.Random(5)
    rows = cases.odd_texts() + [(i, cases.words(rng, rng.randint(0, 50))) for i in range(20, 80)]
    for bits in (21, 3):
        # With 3 bits most words are looked up by the join.
        monkeypatch.setattr(lm, "WORD_BITS", bits)
        got = lm.score(cases.table(spark, rows), remainder(7) != 2).collect()
        assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows, in_training)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def plain_tree(texts, depth):
    """Context-tree weighting by recursion over counts of whole contexts."""
    counts = {}
    for t in texts:
        data = bytes([lm._START] * depth) + t.encode() + bytes([lm._END])
        for p in range(depth, len(data)):
            for d in range(depth + 1):
                for k in range(8):
                    node = (d, data[p - d : p], (1 << k) + (data[p] >> (8 - k)))
                    counts.setdefault(node, [0, 0])[(data[p] >> (7 - k)) & 1] += 1
    below = {}
    for d, context, prefix in counts:
        if d:
            below.setdefault((d - 1, context[1:], prefix), []).append((d, context, prefix))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        own = kt(*counts[node])
        if node not in below:
            return own
        return np.logaddexp(own, sum(weighted(c) for c in below[node])) - math.log(2)

    def one(data, p, k):
        path = []
        for d in range(depth + 1):
            node = (d, data[p - d : p], (1 << k) + (data[p] >> (8 - k)))
            if node not in counts:
                break
            path.append(node)
        if not path:
            return 0.5
        q = (counts[path[-1]][1] + 0.5) / (sum(counts[path[-1]]) + 1)
        for node in reversed(path[:-1]):
            beta = math.exp(min(700, kt(*counts[node]) - sum(weighted(c) for c in below[node])))
            q = (beta * (counts[node][1] + 0.5) / (sum(counts[node]) + 1) + q) / (beta + 1)
        return q

    def score(t):
        data = bytes([lm._START] * depth) + t.encode() + bytes([lm._END])
        total = 0.0
        for p in range(depth, len(data)):
            for k in range(8):
                q = one(data, p, k)
                total += math.log10(q if (data[p] >> (7 - k)) & 1 else 1 - q)
        return total

    return score


def test_score_equals_recursion(spark):
    texts = ["abab abba", "abracadabra", "ab é", "", "zz"]
    want = plain_tree(texts[:4], lm.DEPTH)
    got = lm.score(cases.table(spark, list(enumerate(texts))), F.col("doc_id") < 4).collect()
    for r in got:
        assert r.score == __import__("pytest").approx(want(texts[r.doc_id]), rel=2e-4)


def test_no_context_is_dropped(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, cases.words(rng, rng.randint(1, 3))) for i in range(10)] + [(30, ""), (31, "zz \U0001f600"), (32, None)]
    want = plain_tree([t for i, t in rows if i < 6], lm.DEPTH)
    # A bound by size would keep contexts met in one of 16 training bytes.
    monkeypatch.setattr(lm, "TREE_BITS", 4)
    monkeypatch.setattr(lm, "MOST_RUNS", 50, raising=False)
    for bits in (21, 3):
        # With 3 bits nearly all byte runs are looked up by the join.
        monkeypatch.setattr(lm, "RUN_BITS", bits, raising=False)
        got = {r.doc_id: r.score for r in lm.score(cases.table(spark, rows).repartition(3), F.col("doc_id") < 6).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            assert abs(got[i] - want(t or "")) < 1e-6


def test_pruned_tree_is_a_distribution(spark):
    rng = random.Random(6)
    text = cases.words(rng, 400)
    counts = lm.corpus_counts(cases.table(spark, [(1, text)]))
    node, one, runs, values = lm.fit_tree(counts, len(text) << lm.TREE_BITS)
    node, one, _, _ = lm.fit_tree(counts, 20 << lm.TREE_BITS)
    for context in (b"alpha1"[-lm.DEPTH :], b"zzzzzz"[-lm.DEPTH :], b"a beta"[-lm.DEPTH :]):
        head = np.uint64(int.from_bytes(context, "big")) << np.uint64(8)
        p = 10 ** lm.evaluate(node, one, head | np.arange(256, dtype=np.uint64))
        assert abs(p.sum() - 1) < 1e-6


def test_code_length_is_near_the_entropy_of_the_source(spark):
    rng = random.Random(7)
    # Syllables of one of five kinds: log2(5) bits each, the blanks are sure after nine.
    rows = [(i, " ".join("".join(rng.choice(["ka", "lo", "mi", "ru", "sen"]) for _ in range(9)) for _ in range(60))) for i in range(200)]
    got = [r for r in lm.score(cases.table(spark, rows), remainder(7) != 2).collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    bits = -sum(r.score for r in got) / math.log10(2) / sum(r.n_bytes for r in got)
    assert math.log2(5) * 9 / (9 * 2.2 + 1) < bits < 1.35


def test_hash_table_gives_the_same_values():
    node, one = lm.weigh(*(np.array(x) for x in zip(*[(lm._node(d, 0, p), 3, 5) for d in (0,) for p in range(1, 256)])))
    runs = np.random.default_rng(0).integers(0, 1 << 40, 20_000).astype(np.uint64)
    tree = lm.Tree(node, one, runs[:100], lm.evaluate(node, one, runs[:100]))
    for _ in range(2):
        assert np.allclose(tree.log10(runs), lm.evaluate(node, one, runs), atol=1e-5)


def test_byte_runs_and_nothing(spark):
    [part] = flat.slices(pa.array(["aB", None, ""]))
    runs, doc = lm.byte_runs(part)
    assert doc.tolist() == [0, 0, 0, 1, 2] and [int(r) & 255 for r in runs] == [97, 98, 255, 255, 255]
    assert lm.score(cases.empty(spark), remainder(7) != 2).count() == 0
    r = lm.score(cases.table(spark, [(1, "abc")]), F.lit(False)).first()
    assert r.train_tokens == 0 and r.base_score == 0 and r.score == __import__("pytest").approx(-32 * math.log10(2))

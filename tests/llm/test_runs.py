import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from cases import empty, odd, odd_texts, table, words

from firnline.llm import queries, runs


def plain_runs(w, least_words, least_exponent):
    """All runs of a list of words, period by period."""
    found = {}
    for q in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least_words, least_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def stream(x):
    return np.array([*x, -1], dtype=np.int64)


@pytest.mark.parametrize("least_exponent", [2, 3, 4])
def test_equals_brute_force(least_exponent):
    rng = random.Random(least_exponent)
    for _ in range(1500):
        x = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
        if rng.random() < 0.5 and len(x) > 4:
            start, period = rng.randrange(len(x)), rng.randint(1, len(x) // 3)
            for i in range(start + period, len(x)):
                x[i] = x[i - period]
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = 9
        least = rng.choice([0, 6, 24])
        assert [tuple(r) for r in runs.find_runs(stream(x), len(x), least, least_exponent).tolist()] == plain_runs(x, least, least_exponent)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def nested(n):
    u, i = [0], 1
    while len(u) < n:
        u, i = u * 3 + [i], i + 1
    return u[:n]


@pytest.mark.parametrize("x", [fibonacci(600), nested(600), [0] * 600, [*range(7)] * 80, [bin(i).count("1") % 2 for i in range(600)]])
def test_texts_with_very_many_squares(x):
    for least_exponent in (2, 3):
        assert [tuple(r) for r in runs.find_runs(stream(x), len(x), 0, least_exponent).tolist()] == plain_runs(x, 0, least_exponent)


@pytest.mark.parametrize("x", [fibonacci(200_000), nested(200_000), [0] * 200_000, [*range(7)] * 30_000])
def test_long_texts_take_seconds(x):
    began = time.process_time()
    runs.find_runs(stream(x), len(x))
    assert time.process_time() - began < 20


def test_words_of_one_name_are_told_apart(monkeypatch):
    # With only four names everything seems to repeat; the reported stretches are still those of the words.
    monkeypatch.setattr(runs, "mix", lambda h: h % np.uint64(4))
    rng = random.Random(6)
    for _ in range(200):
        x = [rng.randrange(40) for _ in range(rng.randint(0, 60))] + [*range(3)] * rng.randint(0, 6)
        got = {tuple(r) for r in runs.find_runs(stream(x), len(x), 0, 3).tolist()}
        assert all(x[i] == x[i + q] for s, n, q in got for i in range(s, s + n - q))


def digests(doc_id, text, planted=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w, 24, 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = sha("".join(f"{s},{length},{q}\n" for s, length, q in found))
    kept = sha(" ".join(v for i, v in enumerate(w) if i not in gone))
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], told, kept)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_texts(spark):
    # The text of 30,000 words has its own test above.
    texts = [(i, t) for i, t in odd_texts() if len(t or "") < 100_000]
    got = runs.with_digests(runs.scan(table(spark, texts).repartition(3)))
    assert rows(got) == sorted((digests(i, t, planted=False) for i, t in texts), key=str)
    assert runs.scan(odd(spark)).count() == len(odd_texts())
    assert runs.scan(empty(spark)).count() == 0


def test_query_equals_a_plain_version(spark):
    rng = random.Random(8)
    docs = [(i, words(rng, rng.randint(0, 200))) for i in range(150)] + [(None, "a b " * 40), (3, "x " * 30), (3, "x " * 30), (5, None), (31, ""), (900, "ä\tb\nc " * 12)]
    got = runs.with_digests(runs.scan(queries.with_planted_periods(table(spark, docs))))
    assert rows(got) == sorted((digests(*d) for d in docs), key=str)


def test_ties_go_to_the_first_start_and_collapsed_text(spark):
    text = "s " + "a b " * 12 + "m " + "c d " * 12 + "e"
    [row] = runs.scan(table(spark, [(1, text)])).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 24, 2), (26, 24, 2)] and row["collapsed"] == "s a b m c d e"
    [row] = runs.with_digests(runs.scan(table(spark, [(1, text)]))).collect()
    assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (1, 24, 2, 12_000)

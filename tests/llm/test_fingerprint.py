import hashlib

import cases
import pytest
import xxhash
from pyspark.sql import functions as F

from firnline.llm import fingerprint


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fingerprint.fingerprints(df).select("doc_id", fingerprint.written(F.col("lanes")).alias("f"), "lanes").collect()
    return {r.doc_id: r for r in got}


def test_order_of_paragraphs_is_free_and_their_number_is_not(spark):
    p = prints(spark, ["a b\nc d\ne", "e\na b\nc d", "a b\nc d\ne\ne", "a b\nc d", "b a\nc d\ne", None, ""])
    assert p[0].f == p[1].f and p[5].f == p[6].f
    assert len({p[i].f for i in (0, 2, 3, 4, 5)}) == 5
    assert len(p[0].f) == (fingerprint.WIDE + fingerprint.SKETCH) * 8


def test_insert_and_delete(spark):
    df = spark.createDataFrame([(0, "x y z\nu v"), (1, "x y z"), (2, "u v")], "doc_id long, text string")
    p = fingerprint.fingerprints(df).groupBy().pivot("doc_id", [0, 1, 2]).agg(F.first("lanes"))
    one, two, both = F.col("1"), F.col("2"), F.col("0")
    r = p.select((fingerprint.combine(one, two) == both).alias("plus"), (fingerprint.combine(both, two, -1) == one).alias("minus")).first()
    assert r.plus and r.minus


def test_edits_of_odd_texts(spark):
    rows = cases.odd_texts()
    got = fingerprint.edits(cases.odd(spark)).collect()
    assert len(got) == len(rows)
    # Rows with one id each have a fixed successor.
    single = [(i, t or "") for i, t in rows if i is not None and [j for j, _ in rows].count(i) == 1]
    ordered = sorted(single, key=lambda r: -r[0])
    by = {r.doc_id: r for r in got}
    for (i, t), (j, nxt) in zip(ordered, ordered[1:]):
        if not any(j < k < i for k, _ in rows if k is not None):
            half = len(t) // 2
            assert by[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
            assert by[i].n_chars == len(t) and 0 <= by[i].near_edited <= 1 and 0 <= by[i].near_next <= 1
    last = by[-5]
    assert last.n_chars == 7 and last.edited_sha256
    assert by[2].fingerprint == by[1].fingerprint and by[1].edited_fingerprint == by[1].fingerprint and by[1].near_edited == 1


def test_single_row_and_none(spark):
    r = fingerprint.edits(cases.table(spark, [(3, "abcd")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1
    assert fingerprint.edits(cases.empty(spark)).count() == 0
    assert fingerprint.edits(cases.table(spark, [(None, "ab"), (None, None)])).count() == 2


def test_no_python_in_the_plan(spark):
    plan = fingerprint.edits(cases.odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_lanes(text):
    """Lanes of a text word pair by word pair."""
    wide, sketch = [0] * fingerprint.WIDE, [0] * fingerprint.SKETCH
    for paragraph in (text or "").split("\n"):
        digest = hashlib.sha256(paragraph.encode()).hexdigest()
        wide = [(w + int(digest[8 * i : 8 * i + 8], 16)) % 2**32 for i, w in enumerate(wide)]
        w = paragraph.split(" ")
        for k, a in enumerate(w):
            h = xxhash.xxh64(a.encode(), seed=42).intdigest()
            # The last word stands alone.
            h = xxhash.xxh64(w[k + 1].encode(), seed=h).intdigest() if k + 1 < len(w) else h
            sketch[h % fingerprint.SKETCH] += 1 if h >> 6 & 1 else -1
    return wide, sketch


def test_equals_a_plain_version(spark):
    texts = [t for _, t in cases.odd_texts()] + ["a b " * 50_000, "p\n\nq  r", "one\ntwo\none"]
    got = prints(spark, texts)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / max(sum(x * x for x in a) * sum(y * y for y in b), 1) ** 0.5
    plain = [plain_lanes(t) for t in texts]
    for i, (wide, sketch) in enumerate(plain):
        assert list(got[i].lanes) == wide + sketch
        assert got[i].f == "".join(f"{x % 2**32:08x}" for x in wide + sketch)
    df = spark.createDataFrame([(list(got[i].lanes), list(got[i + 1].lanes), float(i)) for i in range(len(texts) - 1)], "a array<long>, b array<long>, i double")
    for r in df.select("i", fingerprint.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        (wa, sa), (wb, sb) = plain[int(r.i)], plain[int(r.i) + 1]
        assert r.near == pytest.approx(1.0 if wa + sa == wb + sb else min(1.0, max(0.0, cosine(sa, sb))))

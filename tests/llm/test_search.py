import numpy as np
from pyspark.sql import functions as F

from firnline.llm import search

SCHEMA = "vec_id long, embedding array<float>, code string, ids string, label int"


def nearest(rows, k):
    """Brute force over (id, vector) rows."""
    codes = {(i, tuple(x is not None and x > 0 for x in v)) for i, v in rows if i is not None and v is not None}
    out = set()
    for q, c in codes:
        if q % 5 == 0:
            near = sorted({(sum(a != b for a, b in zip(c, d)), i) for i, d in codes})[:k]
            out |= {(q, r + 1, i, dist) for r, (dist, i) in enumerate(near)}
    return out


def run(spark, rows, dims, k=10):
    df = spark.createDataFrame([(i, v, "x", "y", 0) for i, v in rows], SCHEMA)
    return {tuple(r) for r in search.top_k(df, F.col("id") % 5 == 0, dims, k).collect()}


def test_equals_brute_force_with_ties_copies_and_nulls(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [rows[3], (None, rows[0][1]), (300, None), (301, [None] * 20)]
    assert run(spark, rows, 20) == nearest(rows, 10)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(i, [float(i), -1.0, 1.0]) for i in range(4)]
    assert run(spark, rows, 3) == nearest(rows, 10)
    assert run(spark, [], 3) == set()


def test_far_neighbours_are_found(spark):
    # All other codes are opposite: every radius has to be tried.
    rows = [(0, [1.0] * 12)] + [(i, [-1.0] * 12) for i in range(1, 5)]
    assert run(spark, rows, 12, k=3) == nearest(rows, 3)

"""Odd inputs that every operator has to take."""

from __future__ import annotations

import random

CLASHING = "row long, key string, score string, token string, bucket string, label string, place string, id string, n string, part string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "ε", "zeta,", "eta.", "theta"]) + str(rng.randint(0, 40)) for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    same = words(rng, 60)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, same), (6, same), (6, same), (7, same + " tail"), (7, words(rng, 30)),
        (None, same), (None, "two words"), (8, words(rng, 30_000)), (9, "x" * 50_000), (10, "\x00\x01 ÿ 😀 梦 é ▁ <|endoftext|>"), (11, "!" * 3000),
        (-5, "a b c d"), (1 << 40, "a b c d e"),
    ]


def table(spark, rows):
    """A documents table with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 0, *["x"] * 9) for i, t in rows], SCHEMA)


def odd(spark):
    return table(spark, odd_texts()).repartition(3)


def empty(spark):
    return table(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

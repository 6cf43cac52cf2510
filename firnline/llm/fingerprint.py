"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs (its lines). Each paragraph is hashed into a wide vector: WIDE strong lanes, cut from the SHA-256 of the whole
paragraph, and SKETCH lanes, all modulo 2**32, in the latter of which each of its word pairs adds or takes one at a place given by its hash. The
fingerprint is the sum of the paragraphs' vectors, so it does not depend on their order, and a paragraph is put in or taken out by
adding or subtracting its vector (`combine`). Equal texts have equal fingerprints; different multisets of paragraphs have different strong
lanes but for a chance of about 2**-256. The likeness of two fingerprints is the cosine of their sketch lanes, which estimates that of the
texts' word-pair counts (standard error about 1/8), cut to 0..1; for equal fingerprints it is 1.

Everything is DataFrame functions. Texts move once: they are dealt out by ranges of descending id, and the first text of each range goes
as a guest to the range before, so that every text meets its successor in its own task.

Defined cases: NULL text counts as empty, with one empty paragraph; NULL ids come last, rows of equal ids in the order of their texts' hash; the
successor of a single row is itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE, SKETCH = 8, 64
#: Rows of a range, about; and most ranges, whose bounds are part of the plan.
RANGE_ROWS = 20_000
MOST_RANGES = 1 << 14

_NO_ID = -(1 << 63)


def lanes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the lanes (w0.., s0..) of the column text, summed over the paragraphs and word pairs of all rows with equal keys."""
    paragraphs = texts.select(*keys, F.explode(F.split("text", "\n")).alias("paragraph"))
    word = F.split("paragraph", " ")
    pairs = paragraphs.select(*keys, F.sha2(F.col("paragraph").cast("binary"), 256).alias("digest"), word.alias("word")).select(
        *keys, "digest", F.posexplode(F.arrays_zip(F.col("word").alias("a"), F.slice("word", F.lit(2), F.size("word")).alias("b"))).alias("at", "pair")
    )
    h = F.xxhash64("pair.a", "pair.b")
    rows = pairs.select(
        *keys, "digest", "at", h.bitwiseAND(SKETCH - 1).cast("int").alias("lane"), (F.shiftright(h, 6).bitwiseAND(1) * 2 - 1).alias("sign")
    )
    wide = [F.sum(F.when(F.col("at") == 0, F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")).otherwise(F.lit(0))).alias(f"w{i}") for i in range(WIDE)]
    sketch = [F.sum(F.when(F.col("lane") == i, F.col("sign")).otherwise(F.lit(0))).alias(f"s{i}") for i in range(SKETCH)]
    return rows.groupBy(*keys).agg(*wide, *sketch)


def packed() -> Column:
    """The lanes as one array modulo 2**32, sketch lanes as signed numbers."""
    wide = [F.pmod(f"w{i}", F.lit(1 << 32)) for i in range(WIDE)]
    sketch = [F.pmod(F.col(f"s{i}") + (1 << 31), F.lit(1 << 32)) - (1 << 31) for i in range(SKETCH)]
    return F.array(*wide, *sketch)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint arrays of the multisets put together, or of a without b for sign -1."""
    parts = [F.pmod(F.get(a, F.lit(i)) + sign * F.get(b, F.lit(i)), F.lit(1 << 32)) for i in range(WIDE)]
    parts += [F.pmod(F.get(a, F.lit(i)) + sign * F.get(b, F.lit(i)) + (1 << 31), F.lit(1 << 32)) - (1 << 31) for i in range(WIDE, WIDE + SKETCH)]
    return F.array(*parts)


def written(lanes_array: Column) -> Column:
    """Fingerprint as lowercase hexadecimal digits."""
    wide = [F.lpad(F.hex(F.get(lanes_array, F.lit(i))), 8, "0") for i in range(WIDE)]
    sketch = [F.lpad(F.hex(F.pmod(F.get(lanes_array, F.lit(i)), F.lit(1 << 32))), 8, "0") for i in range(WIDE, WIDE + SKETCH)]
    return F.lower(F.concat(*wide, *sketch))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints."""

    def dot(x: Column, y: Column) -> Column:
        return reduce(add, (F.get(x, F.lit(i)).cast("double") * F.get(y, F.lit(i)) for i in range(WIDE, WIDE + SKETCH)))

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lanes) of every row."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return lanes(given, ["doc_id", "row"]).select("doc_id", packed().alias("lanes"))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below key, by two short searches instead of one long one."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)

    def below(values) -> Column:
        return F.size(F.filter(values, lambda b: b <= key))

    block = F.greatest(below(F.lit([b[0] for b in blocks])), F.lit(1))
    inside = below(F.element_at(F.lit([b if len(b) == step else b + [(1 << 63) - 1] * (step - len(b)) for b in blocks]), block))
    return (block - 1) * step + F.least(inside, F.lit(len(bounds)))


def with_successor(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, guest, place, doc_id, text, next_text): texts in ranges (part) of descending id with their successors; a guest is a copy of the row after its range."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    n = docs.select(id_col).count()
    ranges = min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))
    shares = [i / ranges for i in range(1, ranges)]
    # At most MOST_RANGES numbers.
    bounds = docs.select(key.alias("key")).agg(F.percentile_approx("key", F.lit(shares), F.lit(10 * ranges)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    part = _range_of(F.col("key"), bounds)
    # The largest id of each range, at most as many as there are ranges.
    tops = docs.select(key.alias("key")).groupBy(part.alias("part")).agg(F.max("key").alias("top")).orderBy("part").collect()
    order = [(r["part"], r["top"]) for r in tops]
    # The successor of a range's last row is the top of the range below; of the lowest, the top of all.
    guests = spark.createDataFrame([(order[i - 1][1], order[i][0]) for i in range(len(order))], "key long, part int")
    given = docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = given.withColumn("part", part).withColumn("guest", F.lit(0))
    invited = given.join(F.broadcast(guests), "key").withColumn("guest", F.lit(1))
    by_part = Window.partitionBy("part").orderBy("guest", F.desc("key"), F.xxhash64("text"))
    return own.unionByName(invited).select(
        "part", "guest", F.row_number().over(by_part).alias("place"), "doc_id", "text", F.lead("text").over(by_part).alias("next_text")
    )


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_successor(docs, id_col, text_col).select("part", "guest", "place", "doc_id", "text", F.coalesce(edited, F.lit("")).alias("edited"))
    texts = rows.select("part", "guest", "place", "doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.char_length("text").cast("long").alias("n_chars"), F.lit("").alias("sha"), F.col("text")),
        F.struct(F.lit(1).alias("kind"), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("text")),
    )).alias("t")).select("part", "guest", "place", "doc_id", "t.*")
    prints = lanes(texts, ["part", "guest", "place", "doc_id", "n_chars", "kind", "sha"])
    of = prints.select("part", "guest", "place", "doc_id", "n_chars", "kind", "sha", packed().alias("lanes"))
    both = of.groupBy("part", "place").agg(
        F.first("guest").alias("guest"), F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("kind") == 0, F.col("lanes"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("lanes"))).alias("edited"),
    )
    after = both.withColumn("next", F.lead("own").over(Window.partitionBy("part").orderBy("place"))).filter(F.col("guest") == 0)
    return after.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )

"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader (FTRL-Proximal).

Tokens are runs of letters and digits or runs of other visible characters. Features are hashed token 1-grams and 2-grams and
the 1-, 2- and 3-grams of token shapes (capitals, digits, marks, repeats), counted over the whole text; a count is divided by
the square root of the number of features. The model is fitted on a bounded sample of labelled rows (FIT_ROWS rows with the
smallest hash of their id), streamed through one task row by row as the update rule asks; its size is fixed (2**BITS weights),
so it is sent to every task. Scores are sparse dot products over all texts.

Defined cases: NULL and empty texts have no features and get the score of the bias; an id that is repeated is scored per row;
rows without a label, or with a NULL id, are never used for fitting; with no usable label every score is 0.5; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm import flat
from firnline.llm.common import add_column, column, stored

BITS = 18
#: Most labelled rows that the model is fitted on, and passes over them.
FIT_ROWS = 12_000
PASSES = 2
#: FTRL-Proximal: step sizes, and weights of the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 1e-3

# 1 letters and digits, 2 other visible characters.
_KINDS = np.where(flat.ALNUM, 1, 2).astype(np.uint8)
_KINDS[:33] = 0
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LOWERCASE = np.zeros(256, dtype=np.int64)
_LOWERCASE[97:123] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


def _shapes(part: flat.Flat, words: flat.Tokens, h: np.ndarray) -> np.ndarray:
    """A small number per token: its mix of capitals, small letters, digits and marks, and whether it repeats the one before."""

    def some(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[part.data])])
        return (sums[words.ends] - sums[words.starts] > 0).astype(np.uint64)

    repeat = np.zeros(len(h), dtype=np.uint64)
    repeat[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    mark = (_KINDS[part.data[words.starts]] == 2).astype(np.uint64)
    one = (words.ends - words.starts == 1).astype(np.uint64)
    return some(_UPPER) + 2 * some(_LOWERCASE) + 4 * some(_DIGIT) + 8 * mark + 16 * repeat + 32 * one


def features(part: flat.Flat, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of every text, repeats included."""
    words = flat.tokens(part, _KINDS[part.data])
    h = flat.hashes(part.data, words.starts, words.ends)
    shape = flat.mix(_shapes(part, words, h) + np.uint64(1))
    found, docs = [], []
    for salt, source, n in ((1, h, 1), (2, h, 2), (3, shape, 1), (4, shape, 2), (5, shape, 3)):
        run, first = flat.runs(source, words.doc, n)
        found.append(flat.mix(run + np.uint64(salt)) >> np.uint64(64 - bits))
        docs.append(words.doc[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(docs)


def _fit(rows: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """FTRL-Proximal over the rows in their order; yields the weights that are not 0. The last weight is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for batch in rows:
        labels = column(batch, "label").to_pylist()
        for part in flat.slices(column(batch, "text")):
            bucket, doc = features(part, bits)
            order = np.argsort(doc, kind="stable")
            bucket, ends = bucket[order], np.cumsum(np.bincount(doc, minlength=len(part)))
            for i in range(len(part)):
                mine = bucket[ends[i - 1] if i else 0 : ends[i]]
                at, count = np.unique(mine, return_counts=True)
                at, x = np.append(at, size - 1), np.append(count / np.sqrt(max(len(mine), 1)), 1.0)
                w = weights(at)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - labels[part.first + i]) * x
                more = n[at] + g * g
                z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
                n[at] = more
    w = weights(np.arange(size))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w[at])], names=["bucket", "weight"])


def sample(docs: DataFrame, labels: DataFrame, usable: Column, label: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """At most `rows` labelled texts, those with the smallest hash of their id: (doc_id, text, label, turn)."""
    known = labels.filter(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    # A document has one label: of several rows the largest counts.
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The ids are cut first, so that the texts of few rows move. Rows without a document make the sample smaller by as much.
    chosen = known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(rows)
    return texts.join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights by bucket, the bias last."""
    chosen = stored(sample(docs, labels, usable, label, id_col, text_col, rows), "quality-sample")
    passes = chosen.withColumn("turn", F.explode(F.array(*[F.xxhash64("doc_id", F.lit(i)).bitwiseAND((1 << 56) - 1) + F.lit(i << 56) for i in range(PASSES)])))
    ordered = passes.repartition(1).sortWithinPartitions("turn", "doc_id", F.xxhash64("text")).select("text", "label")
    # At most 2**bits + 1 rows of two numbers.
    found = ordered.mapInArrow(lambda it: _fit(it, bits), "bucket long, weight double").toPandas()
    weights = np.zeros((1 << bits) + 1, dtype=np.float32)
    weights[found["bucket"].to_numpy()] = found["weight"].to_numpy()
    return weights


def with_scores(docs: DataFrame, weights: np.ndarray, name: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, and a column of that name with their scores."""
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def work(text: pa.Array) -> Iterator[tuple[flat.Flat, np.ndarray]]:
        w = sent.value
        for part in flat.slices(text):
            bucket, doc = features(part, bits)
            n = np.bincount(doc, minlength=len(part))
            total = np.bincount(doc, weights=w[bucket], minlength=len(part)) / np.sqrt(np.maximum(n, 1)) + w[-1]
            yield part, 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    return add_column(docs, text_col, work, name, "double")


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_scores(given, weights, "score").drop("text")


def classify(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted): the model is fitted on labelled rows that `usable` admits, and scores all rows."""
    scored = score(docs, fit(docs, labels, usable, label, id_col, text_col), id_col, text_col)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

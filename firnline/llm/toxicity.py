"""Toxic spans by a linear-chain conditional random field with two states, and document scores from its marginals.

Tokens are lower-cased runs of letters and digits. A token's emission is the sum of hashed weights of its word, its beginnings
and its end; transitions tie neighbours. The model is fitted on a bounded sample of labelled documents (FIT_ROWS rows with the
smallest hash of their id). Only documents carry labels, so tokens get theirs first: a token of a toxic document is
offending if its word or beginning is found in a fixed share of toxic documents and many times more often there than in others.
Near copies count once in that. The weights then follow the gradient of the conditional likelihood (observed minus expected
features by forward-backward). Forward and backward passes run over all tokens of a batch at once: both are chains of
fractional linear maps, which are composed block by block and restart at each text.

Score of a document: a logistic function of its sum of marginals, that sum per token and its largest marginal, with four
coefficients fitted on the same sample. Tagged are the tokens with a marginal of 0.5 or more.

Defined cases: NULL and empty texts have no token and get the score of no evidence; repeated ids are scored per row; rows without a label or with a
NULL id are not used for fitting; with no usable label every score is below 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm import flat
from firnline.llm.common import add_column, column, stored
from firnline.llm.quality import sample

BITS = 18
#: Most labelled rows that the model is fitted on, and passes of gradient steps over them.
FIT_ROWS = 12_000
PASSES = 3
#: Bytes of text per gradient step, and step size.
STEP_BYTES = 1 << 16
RATE = 0.5
#: A feature marks its tokens if at least this share of toxic documents, and so many, have it, so many times as often as others.
LEAST_SHARE = 0.01
LEAST_DOCS = 6
LEAST_LIFT = 20.0
#: Lengths in bytes of the beginnings and of the end that are features.
PREFIXES = (4, 5, 6)
SUFFIX = 5
N_FEATURES = 2 + len(PREFIXES)
#: Marginals below it are no evidence, however many there are.
LEAST_MARGINAL = 0.2
#: Bias, start, three transitions, four coefficients of the score.
N_REST = 9


def mobius_scan(p: np.ndarray, q: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """x[t] = (p[t] + q[t] x[t-1]) / (u[t] + v[t] x[t-1]); q and v are 0 where a chain begins, as they are at 0.

    Blocks of about sqrt(n) steps run side by side, first for their composed maps, then for the values.
    """
    n = len(p)
    if n == 0:
        return np.empty(0)
    steps = int(np.sqrt(n)) + 1
    lanes = -(-n // steps)

    def by_step(a, fill):
        out = np.full(lanes * steps, fill)
        out[:n] = a
        return np.ascontiguousarray(out.reshape(lanes, steps).T)

    p, q, u, v = by_step(p, 0.0), by_step(q, 0.0), by_step(u, 1.0), by_step(v, 0.0)
    a, b, c, d = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(steps):
        a, b, c, d = q[t] * a + p[t] * c, q[t] * b + p[t] * d, v[t] * a + u[t] * c, v[t] * b + u[t] * d
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    x, into = 1.0, np.empty(lanes)
    for k, (ak, bk, ck, dk) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        into[k] = x
        x = (ak * x + bk) / max(ck * x + dk, 1e-300)
    out = np.empty((steps, lanes))
    x = into
    for t in range(steps):
        x = (p[t] + q[t] * x) / (u[t] + v[t] * x)
        out[t] = x
    return out.T.reshape(-1)[:n]


def forward_backward(emission: np.ndarray, doc: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of state 1 before the later tokens, those after them, and marginals of state 1.

    emission and start are log-weights of state 1 against state 0, trans[i, j] those of a step from i to j.
    """
    n = len(emission)
    psi = np.exp(np.clip(emission, -30, 30))
    (a00, a01), (a10, a11) = np.exp(trans)
    first = np.ones(n, dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    forth = mobius_scan(
        np.where(first, psi * np.exp(start), psi * a01), np.where(first, 0.0, psi * a11), np.where(first, 1.0, a00), np.where(first, 0.0, a10)
    )
    last = np.roll(first, -1)[::-1]
    after = np.roll(psi, -1)[::-1]
    back = mobius_scan(
        np.where(last, 1.0, a10), np.where(last, 0.0, a11 * after), np.where(last, 1.0, a00), np.where(last, 0.0, a01 * after)
    )[::-1]
    odds = forth * back
    return forth, back, odds / (1 + odds)


def features(part: flat.Flat, bits: int = BITS) -> tuple[flat.Tokens, np.ndarray, np.ndarray]:
    """Tokens, their hashed features (N_FEATURES rows), and their word hashes."""
    low = flat.LOWER[part.data]
    words = flat.tokens(part, flat.ALNUM[low].astype(np.uint8))
    h = flat.hashes(low, words.starts, words.ends)
    shift = np.uint64(64 - bits)
    rows = [h] + [flat.hashes(low, words.starts, np.minimum(words.starts + k, words.ends)) for k in PREFIXES]
    rows.append(flat.hashes(low, np.maximum(words.ends - SUFFIX, words.starts), words.ends))
    found = np.stack([flat.mix(r + np.uint64(i + 1)) >> shift for i, r in enumerate(rows)]).astype(np.int64)
    return words, found, h


def evidence(marginal: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: 1, log of 1 + sum of marginals, the same per thousand tokens, and the largest marginal."""
    n = len(counts)
    total = np.bincount(doc, weights=np.where(marginal >= LEAST_MARGINAL, marginal, 0.0), minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, marginal)
    return np.stack([np.ones(n), np.log1p(total), np.log1p(1000 * total / np.maximum(counts, 1)), most], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression until they are small."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit(rows: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of turn 0 give the association of features and labels, later turns the gradient steps, the last one the score's coefficients."""
    size = 1 << bits
    weights, squares = np.zeros(size), np.full(size, 1e-8)
    # Of the bias, the start and the three free transitions.
    rest, rest_squares = np.array([-3.0, -1.0, 0.0, 0.0, 0.0]), np.full(5, 1e-8)
    have = np.zeros((2, size))
    n_docs = np.zeros(2)
    seen: set[int] = set()
    marks = None
    # One text without evidence that is not toxic keeps the score below 0.5 where nothing is known.
    seen_evidence, seen_labels = [np.array([[1.0, 0.0, 0.0, 0.0]])], [np.zeros(1)]
    for batch in rows:
        labels, turns = np.array(column(batch, "label").to_pylist()), np.array(column(batch, "turn").to_pylist())
        for part in flat.slices(column(batch, "text"), STEP_BYTES):
            words, found, h = features(part, bits)
            here = slice(part.first, part.first + len(part))
            if turns[here].max() == 0:
                ends = np.cumsum(words.counts)
                for i in range(len(part)):
                    lo, hi = ends[i] - words.counts[i], ends[i]
                    run, _ = flat.runs(h[lo:hi], words.doc[lo:hi], min(5, max(hi - lo, 1)))
                    keys = {int((run * np.uint64(k)).min()) ^ k for k in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)} if len(run) else set()
                    if not keys & seen:
                        label = labels[part.first + i]
                        have[label, np.unique(found[:-1, lo:hi])] += 1
                        n_docs[label] += 1
                    seen |= keys
                continue
            if marks is None:
                lift = (have[1] + 0.5) / (n_docs[1] + 1) / ((have[0] + 0.5) / (n_docs[0] + 1))
                marks = (lift >= LEAST_LIFT) & (have[1] >= max(LEAST_DOCS, LEAST_SHARE * n_docs[1]))
            trans = np.array([[0.0, rest[2]], [rest[3], rest[4]]])
            emission = weights[found].sum(axis=0) + rest[0]
            forth, back, marginal = forward_backward(emission, words.doc, trans, rest[1])
            if turns[here].max() > PASSES:
                seen_evidence.append(evidence(marginal, words.doc, words.counts))
                seen_labels.append(labels[here])
                continue
            if not len(words):
                continue
            y = (marks[found[:-1]].any(axis=0) & (labels[here][words.doc] == 1)).astype(float)
            miss = y - marginal
            g = sum(np.bincount(f, weights=miss, minlength=size) for f in found)
            squares += g * g
            weights += RATE * g / np.sqrt(squares)
            first = np.ones(len(y), dtype=bool)
            first[1:] = words.doc[1:] != words.doc[:-1]
            inner = np.flatnonzero(~first)
            r, ahead = forth[inner - 1], np.exp(np.clip(emission[inner], -30, 30)) * back[inner]
            joint = np.stack([np.ones(len(inner)), np.exp(rest[2]) * ahead, np.exp(rest[3]) * r, np.exp(rest[4]) * r * ahead])
            expected = (joint / joint.sum(axis=0)).sum(axis=1)
            a, b = y[inner - 1], y[inner]
            g = np.array([miss.sum(), miss[first].sum(), ((1 - a) * b).sum() - expected[1], (a * (1 - b)).sum() - expected[2], (a * b).sum() - expected[3]])
            rest_squares += g * g
            rest += 0.1 * g / np.sqrt(rest_squares)
    rest = np.concatenate([rest, _logistic(np.concatenate(seen_evidence), np.concatenate(seen_labels))])
    at = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - np.arange(len(rest))])), pa.array(np.concatenate([weights[at], rest]))], names=["bucket", "weight"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, bits: int = BITS) -> np.ndarray:
    """Feature weights, then bias, start, transitions 0-1, 1-0, 1-1, and the four coefficients of the score."""
    chosen = stored(sample(docs, labels, usable, label, id_col, text_col, rows), "toxicity-sample")
    turns = chosen.drop("turn").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(PASSES + 1))))
    ordered = turns.repartition(1).sortWithinPartitions("turn", F.xxhash64("doc_id", "turn"), F.xxhash64("text")).select("text", "label", "turn")
    # At most 2**bits + N_REST rows of two numbers.
    found = ordered.mapInArrow(lambda it: _fit(_by_turn(it), bits), "bucket long, weight double").toPandas()
    model = np.zeros((1 << bits) + N_REST, dtype=np.float32)
    model[-4] = -1.0
    bucket, weight = found["bucket"].to_numpy(), found["weight"].to_numpy()
    model[np.where(bucket >= 0, bucket, (1 << bits) - 1 - bucket)] = weight
    return model


def _by_turn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches where the turn changes."""
    for batch in rows:
        turn = np.array(column(batch, "turn").to_pylist())
        cuts = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(turn)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def with_tags(docs: DataFrame, model: np.ndarray, name: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, and a column of that name: score, and spans as (start, end) in code points and the largest marginal, in their order."""
    bits = (len(model) - N_REST).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(text: pa.Array) -> Iterator[tuple[flat.Flat, pa.Array]]:
        m = sent.value
        weights, (bias, start, t01, t10, t11), coefficients = m[:-N_REST], m[-N_REST:-4].astype(float), m[-4:].astype(float)
        trans = np.array([[0.0, t01], [t10, t11]])
        for part in flat.slices(text):
            words, found, _ = features(part, bits)
            emission = weights[found].sum(axis=0, dtype=float) + bias
            marginal = forward_backward(emission, words.doc, trans, start)[2]
            total = evidence(marginal, words.doc, words.counts) @ coefficients
            tagged = np.flatnonzero(marginal >= 0.5)
            # A span is a run of tagged tokens of one text.
            doc = words.doc[tagged]
            begin = np.ones(len(tagged), dtype=bool)
            begin[1:] = (np.diff(tagged) > 1) | (np.diff(doc) > 0)
            at = np.flatnonzero(begin)
            end = np.append(at[1:], len(tagged)) - 1 if len(at) else at
            points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)]) if len(at) else np.zeros(1, dtype=np.int64)
            where = doc[at]
            zero = points[part.starts[where]] if len(at) else 0
            spans = pa.StructArray.from_arrays(
                [pa.array(points[words.starts[tagged[at]]] - zero, pa.int64()), pa.array(points[words.ends[tagged[end]]] - zero, pa.int64()), pa.array(np.maximum.reduceat(marginal[tagged], at) if len(at) else np.empty(0))],
                names=["start", "end", "score"],
            )
            offsets = np.searchsorted(where, np.arange(len(part) + 1)).astype(np.int32)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield part, pa.StructArray.from_arrays([pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["score", "spans"])

    return add_column(docs, text_col, work, name, "struct<score: double, spans: array<struct<start: long, end: long, score: double>>>")


def tag(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) for every row."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_tags(given, model, "tags").select("doc_id", "tags.*")


def classify(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans): the model is fitted on labelled rows that `usable` admits, and tags all rows."""
    tagged = tag(docs, fit(docs, labels, usable, "toxic", id_col, text_col), id_col, text_col)
    return tagged.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Periodic runs of words by online dyadic square catching.

The words of a batch of texts are appended to one stream, a mark of its own after each text. Level k looks for periods from 2**k up to
2**(k+1) - 1. Its catchers are the completed blocks of w words that begin at multiples of w, w being a power of two: every stretch
that a wanted square can begin with holds one of them whole. A catcher waits for its block to come again: a word appended at
distance d behind the end of the block, for a period d of the level, makes the suffix of w words end there, and it is compared with the block (names of all
suffixes of w words come from those of w/2 words). Thus each appended word advances one comparison (two, where squares below an
exponent of three are wanted) per level; the words of the batch take that step together, as one array operation. A comparison that
holds catches a repeat at distance d; it is advanced word by word to both sides, and once it spans two periods it is a square.
Squares caught by neighbouring blocks at one distance are one stretch, and squares that lie in a run of a shorter period are that
run again and go no further (by Fine and Wilf's theorem such a run has a period that divides d).

A run is a stretch of consecutive words with smallest period q and at least max(least_words, least_exponent * q) words that no
neighbouring word extends. Names are hashes, so each stretch is compared word by word before it is reported; words are numbered exactly.
The work is n log n steps for n words, in arrays of n; a batch is cut into slices of about a megabyte, a longer text is one slice.

Defined cases: a NULL or empty text, or one without words, has no words and no runs; repeated ids are rows of their own; a NULL id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import column
from firnline.llm.flat import NOT_BLANK, Flat, mix, slices, tokens

LEAST_WORDS = 24
LEAST_EXPONENT = 3
#: Steps to a side that all caught repeats make together; the few that go on make the rest in growing strides.
STEPS = 16


def _matched(x: np.ndarray, i: int, j: int, step: int, most: int) -> int:
    """How many words agree from x[i] and x[j] on, in direction step, at most `most`."""
    n, stride = 0, 64
    while n < most:
        m = min(stride, most - n)
        if step > 0:
            differ = np.flatnonzero(x[i + n : i + n + m] != x[j + n : j + n + m])
        else:
            differ = np.flatnonzero((x[i - n - m + 1 : i - n + 1] != x[j - n - m + 1 : j - n + 1])[::-1])
        if len(differ):
            return n + int(differ[0])
        n, stride = n + m, 2 * stride
    return n


def _extended(x: np.ndarray, at: np.ndarray, d: np.ndarray, step: int) -> np.ndarray:
    """For each pair of places at and at + d, how many words agree from there on in direction step."""
    n = np.zeros(len(at), dtype=np.int64)
    going = np.arange(len(at))
    for _ in range(STEPS):
        i = at[going] + step * n[going]
        j = i + d[going]
        inside = (i >= 0) & (j < len(x))
        going, i, j = going[inside], i[inside], j[inside]
        going = going[x[i] == x[j]]
        n[going] += 1
        if not len(going):
            return n
    for k in going.tolist():
        i = int(at[k] + step * n[k])
        j = i + int(d[k])
        n[k] += _matched(x, i, j, step, len(x) - j if step > 0 else i + 1)
    return n


def _renamed(names: np.ndarray, w: int) -> np.ndarray:
    """Names of all stretches of 2 w words from those of w words."""
    return mix(names[:-w] * np.uint64(0x9E3779B97F4A7C15) + mix(names[w:]))


def _by_words(x: np.ndarray, start: int, end: int, d: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, d) of the stretches of period d in x[start:end]: the whole of it, unless different words had one name."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[start : end - d] == x[start + d : end]).view(np.int8), [0]])))
    return [(start + i, j - i + d, d) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()) if j - i + d >= least_exponent * d]


def find_runs(x: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs of x, by start and period; no text in x has more than `longest` words.

    x has integers; numbers below 0 stand for marks between texts and occur once each.
    """
    if least_exponent < 2:
        raise ValueError("a run has at least two periods")
    found = np.empty((0, 3), dtype=np.int64)
    # With three periods the first two hold a block of 2**k words whole, with two the first holds one of half as many.
    halved = 0 if least_exponent >= 3 else 1
    names, named, k = mix(x.astype(np.uint64)), 1, 0
    while least_exponent << k <= longest:
        w = max(1, (1 << k) >> halved)
        if w > named:
            names, named = _renamed(names, named), w
        blocks = np.arange(0, len(names), w)
        caught_at, caught_d = [], []
        # Block b is met again at b + d; b + d runs over the distances of the level in strides of w.
        for lo in range(1 << k, 2 << k, w):
            shift = np.arange(lo, lo + w)
            whole = blocks[: max(0, (len(names) - lo - w) // w + 1)]
            rows = names[lo : lo + len(whole) * w].reshape(-1, w) == names[whole][:, None]
            which, offset = np.nonzero(rows)
            caught_at.append(whole[which])
            caught_d.append(shift[offset])
            # The last block may be met by fewer words than w.
            for b in blocks[len(whole) :].tolist():
                rest = np.flatnonzero(names[b + lo : b + lo + w] == names[b])
                caught_at.append(np.full(len(rest), b))
                caught_d.append(shift[rest])
        at, d = np.concatenate(caught_at), np.concatenate(caught_d)
        real = x[at] >= 0
        at, d = at[real], d[real]
        if len(at) and len(found):
            # The run that reaches farthest of those that begin at or before each word.
            begin = found[:, 0]
            reach = np.maximum.accumulate(found[:, 0] + found[:, 1])
            new = np.append(True, reach[1:] > reach[:-1])
            farthest = np.maximum.accumulate(np.where(new, np.arange(len(begin)), 0))
            place = np.searchsorted(begin, at, side="right") - 1
            holder = farthest[np.maximum(place, 0)]
            again = (place >= 0) & (reach[np.maximum(place, 0)] >= at + d + w) & (d % found[holder, 2] == 0)
            at, d = at[~again], d[~again]
        if len(at):
            order = np.lexsort((at, d))
            at, d = at[order], d[order]
            # Neighbouring blocks that are met again at one distance are in one stretch.
            first = np.append(True, (np.diff(at) != w) | (np.diff(d) != 0))
            last = np.append(first[1:], True)
            start, end, d = at[first], at[last] + w, d[first]
            start = start - _extended(x, start - 1, d, -1)
            end = end + d + _extended(x, end, d, 1)
            long = end - start >= least_exponent * d
            made = np.array([r for s, e, q in zip(start[long].tolist(), end[long].tolist(), d[long].tolist()) for r in _by_words(x, s, e, q, least_exponent)], dtype=np.int64)
            if not len(made):
                k += 1
                continue
            found = np.concatenate([found, made])
            # The same stretch keeps its shortest period.
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            same = np.append(False, (np.diff(found[:, 0]) == 0) & (np.diff(found[:, 1]) == 0))
            found = found[~same]
        k += 1
    found = found[found[:, 1] >= least_words]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _words(flat: Flat) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a slice end to end, their texts, and the number of words of each text."""
    toks = tokens(flat, NOT_BLANK[flat.data].view(np.int8))
    lengths = toks.ends - toks.starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.zeros(len(flat.data) + 1, dtype=np.int8)
    np.add.at(inside, toks.starts, 1)
    np.add.at(inside, toks.ends, -1)
    body = flat.data[np.cumsum(inside[:-1]) > 0]
    words = pa.Array.from_buffers(pa.large_binary(), len(toks), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    return words, toks.doc, toks.counts


def _slice_runs(flat: Flat, least_words: int, least_exponent: int) -> tuple[list[pa.Array], pa.Array]:
    """Runs of each text of a slice (as list columns start, length, period) and its words that are kept, joined by blanks."""
    words, doc, counts = _words(flat)
    n = len(flat)
    number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # A mark after each text; word i of text t is at place i + t of the stream.
    x = np.empty(len(number) + n, dtype=np.int64)
    x[np.arange(len(number)) + doc] = number
    ends = np.cumsum(counts) + np.arange(n)
    x[ends] = -1 - np.arange(n)
    runs = find_runs(x, int(counts.max(initial=0)), least_words, least_exponent)
    text = np.searchsorted(ends, runs[:, 0], side="right") if len(runs) else np.empty(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    start = runs[:, 0] - before[text] - text
    bounds = np.searchsorted(text, np.arange(n + 1))
    columns = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v)) for v in (start, runs[:, 1], runs[:, 2])]
    # Words after the first period of a run go.
    gone = np.zeros(len(number) + 1, dtype=np.int64)
    np.add.at(gone, before[text] + start + runs[:, 2], 1)
    np.add.at(gone, before[text] + start + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    left = np.searchsorted(doc[kept], np.arange(n + 1))
    lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.take(pa.array(kept)))
    return columns, pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def scan(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): runs of each text by start and period, and its words without those that a run holds after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = column(batch, "doc_id")
            for flat in slices(column(batch, "text")):
                (start, length, period), collapsed = _slice_runs(flat, least_words, least_exponent)
                structs = pa.StructArray.from_arrays([start.values, length.values, period.values], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [names.slice(flat.first, len(flat)), pa.ListArray.from_arrays(start.offsets, structs), collapsed.cast(pa.large_string()).cast(pa.string())],
                    names=["doc_id", "runs", "collapsed"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_digests(scanned: DataFrame) -> DataFrame:
    """n_runs, the run of greatest exponent (ties: smallest start, then period), and digests of all runs and of the collapsed text."""

    def better(a, b):
        # length / period as integers: a beats b if a.length * b.period is more.
        mine, other = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a["length"].isNull() | (other > mine), b).otherwise(a)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # Runs come by start and period, so the first of equals stays.
    best = F.aggregate("runs", none, better)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return scanned.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

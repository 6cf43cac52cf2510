"""Texts of an Arrow batch as one flat byte array: tokens, hashes and n-grams without a Python loop per token."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Anything but a blank or the control characters tab to carriage return belongs to a word.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: ASCII letters and digits, and every byte of a character outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the finisher of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for n positions at least."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * SLICE_BYTES)
        steps = np.full(size, _MULTIPLIER, dtype=np.uint64)
        back = np.full(size, pow(_MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
        steps[0] = back[0] = 1
        _powers, _inverses = np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers, _inverses


@dataclass
class Flat:
    """Bytes of consecutive texts; text i is data[starts[i]:ends[i]]. first is the place of text 0 in its batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.starts)


@dataclass
class Tokens:
    """Token j is data[starts[j]:ends[j]] of text doc[j]; counts has the tokens of each text."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def place(self) -> np.ndarray:
        """Place of each token in its text, from 0."""
        before = np.cumsum(self.counts) - self.counts
        return np.arange(len(self.doc)) - before[self.doc]


def slices(texts: pa.Array, limit: int | None = None) -> Iterator[Flat]:
    """Cut a string column into runs of about `limit` bytes; NULL counts as the empty text."""
    limit = limit or SLICE_BYTES
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, dtype=np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    if texts.null_count:
        ends = np.where(np.asarray(texts.is_null()), starts, ends)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        base = int(starts[at])
        yield Flat(data[base : int(offsets[to])], starts[at:to] - base, ends[at:to] - base, at)
        at = to


def tokens(flat: Flat, kind: np.ndarray) -> Tokens:
    """Maximal runs of one kind of byte inside each text; kind has a small integer per byte, 0 belongs to no token."""
    n = len(flat.data)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Tokens(none, none, none, np.zeros(len(flat), dtype=np.int64))
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[flat.starts] = True
    edge[flat.ends] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    doc = np.searchsorted(flat.starts, starts, side="right") - 1
    inside = (kind[starts] != 0) & (starts < flat.ends[doc])
    starts, ends, doc = starts[inside], ends[inside], doc[inside]
    return Tokens(starts, ends, doc, np.bincount(doc, minlength=len(flat)).astype(np.int64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], equal for equal bytes: polynomial sums divided by the power at their start."""
    powers, inverses = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def runs(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive tokens of one text, and the index of their first token."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = np.zeros(len(whole), dtype=np.uint64)
    for i in range(k):
        out = (out + h[whole + i]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out), whole

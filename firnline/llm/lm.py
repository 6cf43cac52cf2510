"""Language-model scores: context-tree weighting over bytes, beside a unigram base over words.

Texts are lower-cased (A-Z) and end with an end mark. A byte is coded as eight binary decisions; the context of a decision is the
bits already coded and the 0 to DEPTH bytes before. Every context keeps a Krichevsky-Trofimov estimate, and context-tree
weighting mixes those of all depths on the path with weights from how well each has coded the training texts. The tasks count
byte runs and words of all texts, Spark adds the counts up, and every context of the training texts is in the tree. The tree is
weighed where it lies: contexts that share their last LOW bytes are one subtree, which a task weighs on its own (it has at most
256**(DEPTH + 1 - LOW) byte runs), and the levels above are aggregated and joined as tables. A path ends at its deepest met
context. Divided by n_bytes * log10(2), the score is the code length.

The probabilities of byte runs are looked up in two ways: at most 2**RUN_BITS of the most frequent ones in the tasks, the others by a
join with the table of all.

Words are looked up in two ways: those of at least one of 2**WORD_BITS training tokens (at most 2**WORD_BITS) in the tasks, the
others by a join with the table of all counts.

Defined cases: NULL counts as the empty text, which has one token, its end; repeated ids are scored per row; a NULL id is not
in the training part (its remainder is NULL) and is not held out; without training texts every byte costs eight bits and the base is 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm import flat
from firnline.llm.common import column, stored
from firnline.session import moved

#: Longest context in bytes. A context and its byte fill the low bytes of a long.
DEPTH = 5
#: Contexts that agree in so many last bytes are weighed by one task.
LOW = 3
RUN_BITS = 21
WORD_BITS = 21
#: Byte runs of subtrees that a task weighs at a time; a larger subtree is weighed whole.
MOST_RUNS = 1 << 16
#: Bound of `fit_tree`.
TREE_BITS = 19
#: Entries of a task's counts before they are handed on.
MOST_COUNTS = 1 << 21
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 19

#: Probabilities of a bit are kept this far from 0 and 1.
LEAST = 1e-7
# Bytes that are in no UTF-8 text.
_START, _END = 0xFE, 0xFF
_END_WORD = np.uint64(0xE0D0)


def byte_runs(part: flat.Flat) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end mark: the DEPTH bytes before and itself as one number, and its text."""
    lengths = part.ends - part.starts
    sizes = lengths + DEPTH + 1
    ends = np.cumsum(sizes)
    body = part.data if lengths.sum() == len(part.data) else np.concatenate([part.data[a:b] for a, b in zip(part.starts, part.ends)])
    inner = np.ones(int(ends[-1]) if len(ends) else 0, dtype=bool)
    for i in range(DEPTH):
        inner[ends - sizes + i] = False
    whole = inner.copy()
    inner[ends - 1] = False
    padded = np.full(len(inner), _START, dtype=np.uint8)
    padded[inner] = flat.LOWER[body]
    padded[ends - 1] = _END
    run = np.zeros(max(len(padded) - DEPTH, 0), dtype=np.uint64)
    for i in range(DEPTH + 1):
        run <<= np.uint64(8)
        run |= padded[i : i + len(run)]
    return run[whole[DEPTH:]], np.repeat(np.arange(len(part), dtype=np.int32), lengths + 1)


def words(part: flat.Flat) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end, and their text."""
    low = flat.LOWER[part.data]
    found = flat.tokens(part, flat.NOT_BLANK[low].astype(np.uint8))
    h = flat.hashes(low, found.starts, found.ends)
    return np.concatenate([h, np.full(len(part), _END_WORD)]), np.concatenate([found.doc, np.arange(len(part))])


class _Counts:
    """Counts by key, merged as they come; keys that were only met uncounted stay, with 0."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counted: np.ndarray) -> None:
        self.more.append((keys, counted))
        self.waiting += len(keys)
        if self.waiting > MOST_COUNTS:
            self.merge()

    def merge(self) -> None:
        fresh, n = [self.keys], [self.counts]
        met = np.concatenate([np.empty(0, dtype=np.uint64), *(k[c] for k, c in self.more)])
        for keys, counted in ((met, True), (np.concatenate([np.empty(0, dtype=np.uint64), *(k[~c] for k, c in self.more)]), False)):
            once, times = np.unique(keys, return_counts=True)
            fresh.append(once)
            n.append(times if counted else np.zeros(len(once), dtype=np.int64))
        keys, counts = np.concatenate(fresh), np.concatenate(n)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.more, self.waiting = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.counts
        self.__init__()
        return out


def corpus_counts(texts: DataFrame, counted: Column | None = None) -> DataFrame:
    """(key, count) over all texts (column text): byte runs shifted left by one, word hashes with the lowest bit set.

    Texts for which `counted` does not hold add their keys with a count of 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, found = _Counts(), _Counts()

        def hand_on(c: _Counts):
            keys, counts = c.take()
            for lo in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 18)].view(np.int64)), pa.array(counts[lo : lo + (1 << 18)])], names=["key", "count"])

        for batch in batches:
            counts = column(batch, "counted").to_numpy(zero_copy_only=False)
            for part in flat.slices(column(batch, "text"), SLICE_BYTES):
                here = counts[part.first : part.first + len(part)]
                keys, of = byte_runs(part)
                runs.add(keys << np.uint64(1), here[of])
                keys, of = words(part)
                found.add(keys | np.uint64(1), here[of])
                for c in (runs, found):
                    if len(c.keys) > MOST_COUNTS:
                        yield from hand_on(c)
        yield from hand_on(runs)
        yield from hand_on(found)

    marked = texts.select("text", F.coalesce(counted if counted is not None else F.lit(True), F.lit(False)).alias("counted"))
    return marked.mapInArrow(run, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))


def _node(depth: int, context, prefix):
    """One long per (depth, context, bits so far); prefix is 1 and the bits after it. Works on columns and arrays."""
    return context * (256 * 8) + prefix * 8 + depth


def tree_nodes(counts: DataFrame, least: int) -> DataFrame:
    """(node, zeros, ones) of every context that was met at least `least` times."""
    runs = counts.filter(F.col("key").bitwiseAND(1) == 0).select(F.shiftrightunsigned("key", 1).alias("run"), "count")
    levels = []
    for depth in range(DEPTH, -1, -1):
        runs = runs.groupBy(F.col("run").bitwiseAND((1 << (8 * depth + 8)) - 1).alias("run")).agg(F.sum("count").alias("count"))
        context, byte = F.shiftrightunsigned("run", 8), F.col("run").bitwiseAND(255)
        bits = [F.struct(
            _node(depth, context, F.lit(1 << k) + F.shiftright(byte, 8 - k)).alias("node"), F.shiftright(byte, 7 - k).bitwiseAND(1).alias("bit")
        ) for k in range(8)]
        levels.append(runs.select("count", F.explode(F.array(*bits)).alias("b")).select("count", "b.*"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    one = F.col("count") * F.col("bit")
    return every.groupBy("node").agg(F.sum(F.col("count") - one).alias("zeros"), F.sum(one).alias("ones")).filter(F.col("zeros") + F.col("ones") >= least)


def gammaln(x, log=np.log):
    """Logarithm of the gamma function for x > 0, an array or a column: Stirling's series after eight steps up."""
    steps = sum(log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * log(y) - y + 0.5 * float(np.log(2 * np.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - steps


def _kt(zeros, ones, log=np.log):
    """Logarithm of the Krichevsky-Trofimov probability of a sequence; columns need their own log."""
    return gammaln(zeros + 0.5, log) + gammaln(ones + 0.5, log) - gammaln(zeros + ones + 1.0, log) - float(np.log(np.pi))


def weigh(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted nodes and, for paths that end there, the mixed probability of a one."""
    order = np.argsort(node)
    node, zeros, ones = node[order], zeros[order].astype(float), ones[order].astype(float)
    depth, prefix, context = node & 7, (node >> 3) & 255, node >> 11
    own = _kt(zeros, ones)
    # A context's parent lacks its oldest byte.
    parent = np.full(len(node), -1)
    for d in range(1, DEPTH + 1):
        at = np.flatnonzero(depth == d)
        parent[at] = np.searchsorted(node, _node(d - 1, context[at] & ((1 << (8 * (d - 1))) - 1), prefix[at]))
    weighted, below, rest0, rest1, inner = own.copy(), np.zeros(len(node)), zeros.copy(), ones.copy(), np.zeros(len(node), dtype=bool)
    beta = np.full(len(node), np.inf)
    for d in range(DEPTH, -1, -1):
        at = np.flatnonzero((depth == d) & inner)
        split = below[at] + _kt(rest0[at], rest1[at])
        weighted[at] = np.logaddexp(own[at], split) - np.log(2)
        beta[at] = np.exp(np.clip(own[at] - split, -700, 700))
        if d:
            at = np.flatnonzero(depth == d)
            up = parent[at]
            np.add.at(below, up, weighted[at])
            np.subtract.at(rest0, up, zeros[at])
            np.subtract.at(rest1, up, ones[at])
            inner[up] = True
    estimate = (ones + 0.5) / (zeros + ones + 1)
    sure, open_ = np.zeros(len(node)), np.ones(len(node))
    for d in range(1, DEPTH + 1):
        at = np.flatnonzero(depth == d)
        up = parent[at]
        share = np.where(np.isinf(beta[up]), 1.0, beta[up] / (1 + beta[up]))
        sure[at] = sure[up] + open_[up] * share * estimate[up]
        open_[at] = open_[up] * (1 - share)
    return node, sure + open_ * estimate


class Tree:
    """Log10 probabilities of byte runs under the weighted tree; runs already met are kept in a hash table of the task."""

    def __init__(self, node: np.ndarray, one: np.ndarray, known_runs: np.ndarray, known_values: np.ndarray):
        self.node, self.one = node, one
        self.size = 1 << max(12, int(2 * max(len(known_runs), 1) - 1).bit_length())
        self.keys, self.values = np.full(self.size, 1 << 63, dtype=np.uint64), np.zeros(self.size, dtype=np.float32)
        self._put(known_runs, known_values)

    def _slot(self, runs: np.ndarray) -> np.ndarray:
        return (flat.mix(runs) >> np.uint64(65 - self.size.bit_length())).astype(np.int64)

    def _put(self, runs: np.ndarray, values: np.ndarray) -> None:
        """Entries whose eight slots are taken are left out and computed anew when met."""
        slot = self._slot(runs)
        left = np.arange(len(runs))
        for _ in range(8):
            free = left[self.keys[slot[left]] == np.uint64(1 << 63)]
            self.keys[slot[free]] = runs[free]
            won = free[self.keys[slot[free]] == runs[free]]
            self.values[slot[won]] = values[won]
            left = left[self.keys[slot[left]] != runs[left]]
            slot[left] = (slot[left] + 1) & (self.size - 1)
        self.filled = int((self.keys != np.uint64(1 << 63)).sum())

    def log10(self, runs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(runs))
        slot, left = self._slot(runs), np.arange(len(runs))
        for _ in range(8):
            met = self.keys[slot] == runs[left]
            out[left[met]] = self.values[slot[met]]
            left, slot = left[~met], (slot[~met] + 1) & (self.size - 1)
            if not len(left):
                return out
        fresh, back = np.unique(runs[left], return_inverse=True)
        values = evaluate(self.node, self.one, fresh)
        out[left] = values[back]
        if self.filled + len(fresh) > self.size // 2:
            keep = self.keys != np.uint64(1 << 63)
            keys, kept = self.keys[keep], self.values[keep]
            if self.size < 1 << 23:
                self.size *= 2
                self.keys, self.values = np.full(self.size, 1 << 63, dtype=np.uint64), np.zeros(self.size, dtype=np.float32)
                self._put(keys, kept)
            else:
                return out
        self._put(fresh, values)
        return out


def evaluate(node: np.ndarray, one: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Log10 probability of the last byte of each run after the others."""
    value, bits = evaluate_below(node, one, runs)
    return value + (8 - bits) * np.log10(0.5)


def evaluate_below(node: np.ndarray, one: np.ndarray, runs: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probability of the first bits of the last byte of each run, as many as have a context of at least depth `least`, and their number."""
    byte, context = (runs & np.uint64(255)).astype(np.int64), (runs >> np.uint64(8)).astype(np.int64)
    out, bits = np.zeros(len(runs)), np.zeros(len(runs), dtype=np.int64)
    depth = np.full(len(runs), DEPTH)
    for k in range(8):
        prefix, bit = (1 << k) + (byte >> (8 - k)), (byte >> (7 - k)) & 1
        # With one more bit, contexts are met less often: the deepest kept one is no deeper than before.
        left = np.flatnonzero(depth >= least)
        while len(left) and len(node):
            key = _node(depth[left], context[left] & ((np.int64(1) << (8 * depth[left])) - 1), prefix[left])
            at = np.minimum(np.searchsorted(node, key), len(node) - 1)
            met = node[at] == key
            of = left[met]
            p = np.clip(one[at[met]], LEAST, 1 - LEAST)
            out[of] += np.log10(np.where(bit[of] == 1, p, 1 - p))
            bits[of] += 1
            left = left[~met]
            depth[left] -= 1
            left = left[depth[left] >= least]
    return out, bits


def _weighed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes in; nodes and their probabilities of a one out, then runs that are whole in the tree and their log10 probabilities."""
    parts = [[column(b, c).to_numpy() for c in ("node", "zeros", "ones")] for b in rows]
    if not parts:
        return
    node, one = weigh(*(np.concatenate(c) for c in zip(*parts)))
    last = node[((node & 7) == DEPTH) & (((node >> 3) & 255) >= 128)]
    context, prefix = last >> 11, (last >> 3) & 127
    for bit in (0, 1):
        run = (context << 8) | (prefix << 1) | bit
        for lo in range(0, len(run), 1 << 17):
            some = run[lo : lo + (1 << 17)]
            value = evaluate(node, one, some.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), dtype=bool)), pa.array(some), pa.array(value.astype(np.float32))], names=["run", "key", "value"])
    for lo in range(0, len(node), 1 << 17):
        some = node[lo : lo + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), dtype=bool)), pa.array(some), pa.array(one[lo : lo + (1 << 17)].astype(np.float32))], names=["run", "key", "value"])


def fit_tree(counts: DataFrame, n_bytes: int) -> tuple[np.ndarray, ...]:
    """A small tree for one machine, which `score` does not use: nodes, probabilities of a one, runs that are whole in it, and their log10 probabilities.

    It keeps contexts met in at least one of 2**TREE_BITS bytes, at most 2**TREE_BITS per depth and bit.
    """
    nodes = tree_nodes(counts, max(1, n_bytes >> TREE_BITS))
    found = nodes.repartition(1).mapInArrow(_weighed, "run boolean, key long, value float").toArrow()
    run = found["run"].to_numpy()
    key, value = found["key"].to_numpy(), found["value"].to_numpy()
    return key[~run], value[~run], key[run].astype(np.uint64), value[run]


class Subtrees:
    """The levels from LOW down of the contexts of some byte runs, as arrays by depth; runs with the same LOW last bytes of context are all here."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray):
        context, byte = runs >> 8, runs & 255
        node = np.concatenate([_node(DEPTH, context, (1 << k) + (byte >> (8 - k))) for k in range(8)])
        one = np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)])
        times = np.tile(counts.astype(float), 8)
        self.node, self.up, self.zeros, self.ones, self.below, self.own = {}, {}, {}, {}, {}, {}
        self.node[DEPTH], at = np.unique(node, return_inverse=True)
        size = len(self.node[DEPTH])
        self.ones[DEPTH] = np.bincount(at, weights=times * one, minlength=size)
        self.zeros[DEPTH] = np.bincount(at, weights=times * (1 - one), minlength=size)
        for d in range(DEPTH, LOW - 1, -1):
            own = _kt(self.zeros[d], self.ones[d])
            self.own[d] = own
            if d == LOW:
                break
            weighted = own if d == DEPTH else np.logaddexp(own, self.below[d]) - np.log(2)
            self.node[d - 1], up = np.unique(parent(self.node[d], d), return_inverse=True)
            self.up[d] = up
            for of, what in ((self.zeros, self.zeros[d]), (self.ones, self.ones[d]), (self.below, weighted)):
                of[d - 1] = np.bincount(up, weights=what, minlength=len(self.node[d - 1]))

    def probabilities(self, sure: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted nodes below depth LOW and at it, and the mixed probability of a one for paths that end there; given: what the levels above add, and the weight they leave."""
        nodes, found = [], []
        for d in range(LOW, DEPTH + 1):
            estimate = (self.ones[d] + 0.5) / (self.zeros[d] + self.ones[d] + 1)
            nodes.append(self.node[d])
            found.append(sure + rest * estimate)
            if d < DEPTH:
                beta = np.exp(np.clip(self.own[d] - self.below[d], -700, 700))
                up = self.up[d + 1]
                sure, rest = (sure + rest * beta / (1 + beta) * estimate)[up], (rest / (1 + beta))[up]
        node, one = np.concatenate(nodes), np.concatenate(found)
        order = np.argsort(node)
        return node[order], one[order]


def parent(node, depth: int):
    """The node one depth up: without the oldest byte of its context. For arrays."""
    return _node(depth - 1, (node >> 11) & ((1 << (8 * (depth - 1))) - 1), (node >> 3) & 255)


def _parent(depth: int) -> Column:
    context = F.shiftrightunsigned("node", 11).bitwiseAND((1 << (8 * (depth - 1))) - 1)
    return _node(depth - 1, context, F.shiftrightunsigned("node", 3).bitwiseAND(255))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by `low`, joined to runs of whole groups of about MOST_RUNS rows, as arrays."""
    names, waiting, n = [], [], 0
    for batch in batches:
        names = batch.schema.names
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        waiting.append(rows)
        n += batch.num_rows
        if n > MOST_RUNS:
            rows = [np.concatenate(c) for c in zip(*waiting)]
            low = rows[names.index("low")]
            last = int(np.searchsorted(low, low[-1]))
            if last:
                yield {k: v[:last] for k, v in zip(names, rows)}
            waiting, n = [[v[last:] for v in rows]], len(low) - last
    if n:
        yield dict(zip(names, (np.concatenate(c) for c in zip(*waiting))))


def _low_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted runs in; nodes of depth LOW out, with their bits and the logarithm of what their children have coded."""
    for rows in _whole_groups(batches):
        t = Subtrees(rows["run"], rows["count"])
        yield from _batches({"node": t.node[LOW], "zeros": t.zeros[LOW].astype(np.int64), "ones": t.ones[LOW].astype(np.int64), "below": t.below[LOW]})


def _run_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (kind 1) and what depths above LOW make of the nodes of depth LOW (kind 0) in; per run: count, log10 probability of the first `bits` bits."""
    for rows in _whole_groups(batches):
        above, counted = rows["kind"] == 0, (rows["kind"] == 1) & (rows["count"] > 0)
        node, one = np.empty(0, dtype=np.int64), np.empty(0)
        if counted.any():
            t = Subtrees(rows["run"][counted], rows["count"][counted])
            order = np.argsort(rows["run"][above])
            node, one = t.probabilities(rows["sure"][above][order], rows["rest"][above][order])
        run, count = rows["run"][~above], rows["count"][~above]
        for lo in range(0, len(run), MOST_RUNS):
            some = run[lo : lo + MOST_RUNS]
            value, bits = evaluate_below(node, one, some.view(np.uint64), LOW)
            yield from _batches({"run": some, "count": count[lo : lo + MOST_RUNS], "value": value, "bits": bits})


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for lo in range(0, n, 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 17)]) for c in columns.values()], names=list(columns))


def run_values(counts: DataFrame) -> DataFrame:
    """(run, count, value): log10 probability, under the tree of all counted runs, of the last byte of each run in `counts`, whatever its count."""
    runs = counts.filter(F.col("key").bitwiseAND(1) == 0).select(F.shiftrightunsigned("key", 1).alias("run"), "count")
    runs = runs.select(F.shiftrightunsigned("run", 8).bitwiseAND((1 << (8 * LOW)) - 1).alias("low"), "run", "count")
    grouped = lambda rows: rows.repartition("low").sortWithinPartitions("low")
    # Up: each level adds up its children's bits and the logarithms of what they have coded.
    levels = {LOW: stored(grouped(runs.filter("count > 0")).mapInArrow(_low_nodes, "node long, zeros long, ones long, below double"), f"lm-depth-{LOW}")}
    own = _kt(F.col("zeros"), F.col("ones"), F.log)
    for d in range(LOW, 0, -1):
        # The logarithm of the mean of own and below.
        weighted = F.greatest(own, "below") + F.log1p(F.exp(-F.abs(own - F.col("below")))) - float(np.log(2))
        up = levels[d].groupBy(_parent(d).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum(weighted).alias("below"))
        levels[d - 1] = stored(up, f"lm-depth-{d - 1}")
    # Down: each level takes its part of the weight and leaves the rest to its children.
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    beta = F.exp(F.greatest(F.least(own - F.col("below"), F.lit(700.0)), F.lit(-700.0)))
    paths = levels[0].withColumns({"sure": F.lit(0.0), "rest": F.lit(1.0)})
    ends = []
    for d in range(1, LOW + 1):
        ends.append(paths.select("node", (F.col("sure") + F.col("rest") * estimate).alias("one")))
        above = paths.select(
            F.col("node").alias("up"), (F.col("sure") + F.col("rest") * beta / (1 + beta) * estimate).alias("sure"), (F.col("rest") / (1 + beta)).alias("rest"))
        paths = stored(levels[d].withColumn("up", _parent(d)).join(above, "up").drop("up"), f"lm-paths-{d}")
    # Runs meet the subtree they belong to.
    of_node = F.shiftrightunsigned("node", 11)
    rows = runs.select("low", F.lit(1).alias("kind"), "run", "count", F.lit(0.0).alias("sure"), F.lit(0.0).alias("rest")).unionByName(
        paths.select(of_node.alias("low"), F.lit(0).alias("kind"), F.col("node").alias("run"), F.lit(0).cast("long").alias("count"), "sure", "rest"))
    found = stored(grouped(rows).mapInArrow(_run_values, "run long, count long, value double, bits long"), "lm-runs")
    # Bits whose context of depth LOW was not met end higher up.
    byte = F.col("run").bitwiseAND(255)
    short = found.filter("bits < 8").select("run", byte.alias("byte"), F.explode(F.sequence(F.col("bits").cast("int"), F.lit(7))).alias("k"))
    at = lambda d: _node(d, F.shiftrightunsigned("run", 8).bitwiseAND((1 << (8 * d)) - 1), F.expr("shiftleft(1L, k) + shiftright(byte, 8 - k)"))
    short = short.select("run", "k", F.expr("shiftright(byte, 7 - k) & 1").alias("bit"), F.explode(F.array(*map(at, range(LOW)))).alias("node"))
    nodes = ends[0]
    for e in ends[1:]:
        nodes = nodes.unionByName(e)
    met = short.join(nodes, "node", "left").groupBy("run", "k", "bit").agg(F.max(F.when(F.col("one").isNotNull(), F.struct(F.col("node").bitwiseAND(7), "one")))["one"].alias("one"))
    p = F.greatest(F.least(F.coalesce("one", F.lit(0.5)), F.lit(1 - LEAST)), F.lit(LEAST))
    higher = met.groupBy("run").agg(F.sum(F.log10(F.when(F.col("bit") == 1, p).otherwise(1 - p))).alias("more"))
    whole = found.filter("bits = 8").select("run", "count", "value")
    rest = found.filter("bits < 8").join(higher, "run").select("run", "count", (F.col("value") + F.col("more")).alias("value"))
    return whole.unionByName(rest)


def most_frequent(values: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs that were counted at least as often as the least power of two that leaves at most 2**RUN_BITS of them, and their values."""
    per_bit = values.filter("count > 0").groupBy(F.floor(F.log2("count")).alias("bit")).count().collect()
    least, n = 1 << 62, 0
    for r in sorted(per_bit, key=lambda r: -r["bit"]):
        n += r["count"]
        if n > 1 << RUN_BITS:
            break
        least = 1 << r["bit"]
    found = values.filter(F.floor(F.log2("count")) >= least.bit_length() - 1).select("run", "value").toArrow()
    return found["run"].to_numpy().view(np.uint64), found["value"].to_numpy()


class RunTable:
    """Values of runs in a hash table: slots are tried one after the other."""

    def __init__(self, runs: np.ndarray, values: np.ndarray):
        self.bits = max(12, int(2 * max(len(runs), 1) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, 1 << 63, dtype=np.uint64), np.zeros(1 << self.bits)
        slot, left = self._slot(runs), np.arange(len(runs))
        while len(left):
            free = self.keys[slot] == np.uint64(1 << 63)
            self.keys[slot[free]] = runs[left[free]]
            won = self.keys[slot] == runs[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, runs: np.ndarray) -> np.ndarray:
        return (flat.mix(runs) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each run, 0 for those that are not in the table, and where those are."""
        out, slot, left, missing = np.zeros(len(runs)), self._slot(runs), np.arange(len(runs)), []
        while len(left):
            here = self.keys[slot]
            met = here == runs[left]
            out[left[met]] = self.values[slot[met]]
            free = here == np.uint64(1 << 63)
            missing.append(left[free])
            on = ~(met | free)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out, np.sort(np.concatenate(missing)) if missing else left


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes; learned where `training` holds.

    `training` is a condition on docs.
    """
    spark = docs.sparkSession
    counts = stored(corpus_counts(docs.select(F.col(text_col).alias("text"), training.alias("training")), F.col("training")), "lm-counts")
    word = F.col("key").bitwiseAND(1) == 1
    totals = counts.filter("count > 0").agg(F.coalesce(F.sum(F.when(word, F.col("count"))), F.lit(0)).alias("n"), F.count(F.when(word, 1)).alias("v")).first()
    values = stored(run_values(counts), "lm-values")
    known_runs = spark.sparkContext.broadcast(most_frequent(values))
    often = -(-totals["n"] >> WORD_BITS) if totals["n"] else 1
    # At most 2**WORD_BITS rows of two numbers.
    frequent = counts.filter(word & (F.col("count") >= max(often, 1))).toArrow().sort_by("key")
    table = spark.sparkContext.broadcast((frequent["key"].to_numpy(), frequent["count"].to_numpy()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RunTable(*known_runs.value)
        keys, times = table.value
        for batch in batches:
            for part in flat.slices(column(batch, "text"), SLICE_BYTES):
                runs, doc = byte_runs(part)
                n = len(part)
                found, other = model.find(runs)
                value = np.bincount(doc, weights=found, minlength=n)
                h, of = words(part)
                key = (h | np.uint64(1)).view(np.int64)
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                met = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
                known = np.bincount(of[met], minlength=n)
                logs = np.bincount(of[met], weights=np.log10(times[at[met]] + 1.0), minlength=n)
                # The other words and runs, each once per text.
                rare = np.concatenate([key[~met], (runs[other] << np.uint64(1)).view(np.int64)])
                whose = np.concatenate([of[~met], doc[other]])
                order = np.lexsort((rare, whose))
                rare, whose = rare[order], whose[order]
                first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (whose[1:] != whose[:-1])])) if len(rare) else np.empty(0, dtype=np.int64)
                times_here = np.diff(np.append(first, len(rare)))
                offsets = pa.array(np.searchsorted(whose[first], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").slice(part.first, n), column(batch, "row").slice(part.first, n),
                     pa.array(np.bincount(of, minlength=n), pa.int64()), pa.array(known, pa.int64()), pa.array(logs.astype(float)), pa.array(value.astype(float)), pa.array(part.ends - part.starts),
                     pa.ListArray.from_arrays(offsets, pa.array(rare[first])), pa.ListArray.from_arrays(offsets, pa.array(times_here.astype(np.int32)))],
                    names=["doc_id", "row", "n_tokens", "n_known", "logs", "score", "n_bytes", "rare", "times"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    schema = "doc_id long, row long, n_tokens long, n_known long, logs double, score double, n_bytes long, rare array<long>, times array<int>"
    scored = stored(given.mapInArrow(work, schema), "lm-scores")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
    amounts = counts.filter(word & (F.col("count") > 0)).select("key", F.log10(F.col("count") + 1.0).alias("amount")).unionByName(
        values.select(F.shiftleft("run", 1).alias("key"), F.col("value").alias("amount")))
    part = F.col("times") * F.col("amount")
    looked_up = moved(rare).join(moved(amounts), "key").groupBy("row").agg(
        F.sum(F.when(word, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.when(word, part).otherwise(0.0)).alias("more_logs"),
        F.sum(F.when(word, 0.0).otherwise(part)).alias("more_score"))
    each = float(np.log10(totals["n"] + totals["v"] + 1))
    return scored.join(looked_up, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"), "n_bytes",
    )

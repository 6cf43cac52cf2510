"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

Vectors become whole numbers, and a score is their inner product. One more component, sqrt(M - |x|**2) with M the largest squared norm,
gives all rows one norm, and 0 there for a query makes the distance from it fall exactly as the score rises. So a window of scores around a query is an annulus.

The tree is fitted on a bounded sample of rows (`SAMPLE_ROWS`, `SAMPLE_BYTES`): a node takes up to `FANOUT` far-apart split points, and each row
goes to the nearest one (the regions are cut by hyperplanes), until about `LEAF_ROWS` rows of the whole table are left. Then every row is
indexed: it goes to its leaf, and rows of a leaf are packed into blocks of about `BLOCK_ROWS`. For each split point of a node
and each of its subtrees the least and greatest distance from the point to the rows of the subtree are kept. A search goes down from the root with all its
annuli: a subtree is left out once the range of some split point puts all of its rows outside every annulus. Leaves that
are left meet the query block by block, where all scores are exact.

A search takes two rounds. The first looks into the query's own leaf; if that has k rows in a window, the window begins at the k-th
score. The second looks into all leaves that the raised windows reach, so results are exact, whatever the tree is. First the
positives are searched (same label, all scores), then the negatives (another label, a window for each positive).

Result: for each anchor and each of its positives the best rows of another label whose score s has
window[0] * p <= 100 * s <= window[1] * p, p being the positive's score; ties go to the smaller id.

Defined cases: rows with a NULL id, label or vector, or with a component that is NULL or not finite, take no part; a row that repeats
another in id, label and vector is one with it; rows of the anchor's id are never its positives or negatives; rows of one id with different
vectors or labels are rows of their own; shorter vectors go on with zeros; scores have to fit in a long; an anchor without another row of its label
has no positives, a positive with a score below zero no negatives, and neither has rows in the result; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.common import column, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
WINDOW = (30, 90)
#: The sample that the tree is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 32 << 20
FANOUT = 8
LEAF_ROWS, BLOCK_ROWS = 2048, 4096
#: Blocks of a leaf that a message of queries meets, and queries in a message.
BLOCKS_TOGETHER = 16
QUERIES_TOGETHER = 256

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def vectors(rows: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vec, norm): rows that take part, with components floor(scale * x) as doubles and the squared norm of these."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & whole)
    numbers = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    made = given.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), numbers.alias("vec")).distinct()
    return made.withColumn("norm", F.aggregate("vec", F.lit(0e0), lambda a, x: a + x * x))


def matrix(vec: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, made up to dims by zeros."""
    lengths = np.asarray(pc.list_value_length(vec))
    values = vec.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    which = np.repeat(np.arange(len(lengths)), lengths)
    out[which, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class Tree:
    """Split points of all nodes, and once rows are indexed, the ranges of distances.

    children[v][j] is a node if at least 0, else leaf -1 - children[v][j]. low[v][i, j] and high[v][i, j] bound the distances from
    split point i of node v to the rows below its child j.
    """

    def __init__(self, sample: np.ndarray, most: float, leaf_rows: int, fanout: int = FANOUT):
        self.dims, self.most, self.fanout = sample.shape[1], most, fanout
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.paths: list[list[tuple[int, int]]] = []
        self._grow(self.lifted(sample), leaf_rows, [])
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that gives them all one norm."""
        return np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))])

    def _distances(self, x: np.ndarray, squares: np.ndarray | float, v: int) -> np.ndarray:
        return np.sqrt(np.maximum(np.reshape(squares, (-1, 1)) + self.most - 2 * (x @ self.points[v].T), 0))

    def _grow(self, x: np.ndarray, leaf_rows: int, path: list[tuple[int, int]]) -> int:
        """Number of the node or leaf that is made of these rows."""
        points = self._split_points(x) if len(x) > leaf_rows else x[:0]
        nearest = np.argmax(x @ points.T, axis=1) if len(points) > 1 else np.zeros(len(x), dtype=int)
        if len(points) < 2 or len(np.unique(nearest)) < 2:
            self.paths.append(path)
            return -len(self.paths)
        v = len(self.points)
        self.points.append(points)
        self.children.append([])
        self.children[v] = [self._grow(x[nearest == j], leaf_rows, [*path, (v, j)]) for j in range(len(points))]
        return v

    def _split_points(self, x: np.ndarray) -> np.ndarray:
        """Each the farthest from those before among evenly taken rows; equal ones once."""
        some = x[np.linspace(0, len(x) - 1, min(len(x), 8 * self.fanout)).astype(int)]
        chosen = [some[0]]
        gap = ((some - chosen[0]) ** 2).sum(axis=1)
        while len(chosen) < self.fanout and gap.max() > 0:
            chosen.append(some[int(gap.argmax())])
            gap = np.minimum(gap, ((some - chosen[-1]) ** 2).sum(axis=1))
        return np.array(chosen)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each lifted row (or query, whose lifted component is 0)."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            v, which = todo.pop()
            nearest = np.argmax(x[which] @ self.points[v].T, axis=1)
            for j, child in enumerate(self.children[v]):
                inside = which[nearest == j]
                if child < 0:
                    out[inside] = -1 - child
                elif len(inside):
                    todo.append((child, inside))
        return out

    def ranges(self, x: np.ndarray, leaf: int) -> list[tuple[int, int, int, float, float]]:
        """(node, point, child, least, greatest distance) on the way to the leaf that holds these lifted rows."""
        out = []
        for v, j in self.paths[leaf]:
            d = self._distances(x, self.most, v)
            out += [(v, i, j, lo, hi) for i, (lo, hi) in enumerate(zip(d.min(axis=0).tolist(), d.max(axis=0).tolist()))]
        return out

    def bounded(self, ranges) -> Tree:
        """This tree with the ranges of all rows; children without rows have none and are never looked into."""
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        for v, i, j, lo, hi in ranges:
            self.low[v][i, j], self.high[v][i, j] = lo, hi
        return self

    def reached(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, queries that have to look into it). Row r has windows of scores lo[r, w] to hi[r, w], empty ones where lo > hi."""
        squares = (q * q).sum(axis=1)
        # Scores turn to distances; a little is added for rounding.
        slack = 1e-6 * (1 + np.sqrt(self.most + squares.max(initial=0)))
        outer = np.where(lo <= hi, np.sqrt(np.maximum(squares[:, None] + self.most - 2.0 * lo, 0)) + slack, -np.inf)
        inner = np.sqrt(np.maximum(squares[:, None] + self.most - 2.0 * hi, 0)) - slack
        any_window = np.flatnonzero((lo <= hi).any(axis=1))
        if not self.points:
            return [(0, any_window)] if len(any_window) else []
        lifted = np.column_stack([q, np.zeros(len(q))])
        out, todo = [], [(0, any_window)]
        while todo:
            v, which = todo.pop()
            d = self._distances(lifted[which], squares[which], v)
            for j, child in enumerate(self.children[v]):
                low, high = self.low[v][:, j], self.high[v][:, j]
                if low[0] > high[0]:
                    continue
                nearest = np.maximum(low - d, d - high).max(axis=1)
                farthest = (d + high).min(axis=1)
                alive = ((nearest[:, None] <= outer[which]) & (farthest[:, None] >= inner[which])).any(axis=1)
                if alive.any():
                    (out if child < 0 else todo).append((-1 - child if child < 0 else child, which[alive]))
        return out


def _index(rows: DataFrame, tree: Tree, blocks_label: str) -> DataFrame:
    """Blocks of rows of one leaf: (leaf, slice, ids, labels, vecs, ranges), stored."""
    dims = tree.dims

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaves(tree.lifted(matrix(column(batch, "vec"), dims)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *(column(batch, c) for c in ("id", "label", "vec"))], names=["leaf", "id", "label", "vec"])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*held))
            found = [dict(zip(("node", "point", "child", "low", "high"), r)) for r in tree.ranges(tree.lifted(x), key[0])]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1] // BLOCKS_TOGETHER], pa.int32()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids, labels, x)),
                 pa.array([found], pa.list_(pa.struct([("node", pa.int32()), ("point", pa.int32()), ("child", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])))],
                names=["leaf", "slice", "ids", "labels", "vecs", "ranges"],
            )

        before = None
        for batch in batches:
            leaf, chunk = (column(batch, c).to_numpy() for c in ("leaf", "chunk"))
            cuts = np.append(np.append(0, np.flatnonzero((np.diff(leaf) != 0) | (np.diff(chunk) != 0)) + 1), len(leaf))
            ids, labels, x = column(batch, "id").to_numpy(), column(batch, "label").to_numpy(), matrix(column(batch, "vec"), dims)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                key = (int(leaf[a]), int(chunk[a]))
                if held and (key != before or sum(len(h[0]) for h in held) >= 2 * BLOCK_ROWS):
                    yield block(before)
                    held = []
                held.append((ids[a:b], labels[a:b], x[a:b]))
                before = key
        if held:
            yield block(before)

    placed = stored(rows.select("id", "label", "vec").mapInArrow(to_leaf, "leaf int, id long, label long, vec array<double>"), f"{blocks_label}-leaves")
    # One row per leaf of the tree, which is bounded by the sample.
    chunks = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("chunks"))
    dealt = placed.join(F.broadcast(chunks), "leaf").withColumn("chunk", F.pmod(F.xxhash64("id", "vec"), F.col("chunks")).cast("int")).drop("chunks")
    sorted_ = dealt.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk")
    kind = "leaf int, slice int, ids binary, labels binary, vecs binary, ranges array<struct<node: int, point: int, child: int, low: double, high: double>>"
    return stored(sorted_.mapInArrow(to_blocks, kind), blocks_label)


def _messages(queries: DataFrame, tree: Tree, slices: dict[int, int], own_leaf: bool) -> DataFrame:
    """(leaf, slice, queries packed): each query goes to its own leaf, or to all that its windows reach."""
    dims = tree.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES_TOGETHER):
                batch = whole.slice(at, QUERIES_TOGETHER)
                q = matrix(column(batch, "vec"), dims)
                keys = [column(batch, c).to_numpy() for c in ("query", "id", "label")]
                bounds = [c.to_pylist() for c in (column(batch, "lo"), column(batch, "hi"))]
                width = max(map(len, bounds[0]))
                # Missing windows are empty ones.
                lo, hi = (np.array([r + [none] * (width - len(r)) for r in b], dtype=np.int64).reshape(len(q), width) for b, none in zip(bounds, (HIGHEST, LOWEST)))
                if own_leaf:
                    leaf = tree.leaves(np.column_stack([q, np.zeros(len(q))]))
                    reached = [(k, np.flatnonzero(leaf == k)) for k in np.unique(leaf).tolist()]
                else:
                    reached = tree.reached(q, lo, hi)
                for k, which in reached:
                    packed = [pa.array([np.ascontiguousarray(a[which]).tobytes()], pa.binary()) for a in (*keys, q, lo, hi)]
                    for s in range(slices.get(k, 0)):
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s], pa.int32()), *packed], names=["leaf", "slice", "query", "own_id", "own_label", "q", "lo", "hi"])

    return queries.select("query", "id", "label", "vec", "lo", "hi").mapInArrow(run, "leaf int, slice int, query binary, own_id binary, own_label binary, q binary, lo binary, hi binary")


def _scored(met: DataFrame, dims: int, k: int, same_label: bool, exact_doubles: bool) -> DataFrame:
    """(query, window, score, id): the k best rows of a block in each window of each query that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(column(batch, name)[r].as_buffer(), dtype=kind)  # noqa: B023, E731
                query, own_id, own_label = (get(c, np.int64) for c in ("query", "own_id", "own_label"))
                ids, labels = get("ids", np.int64), get("labels", np.int64)
                q, x = get("q", np.float64).reshape(len(query), dims), get("vecs", np.float64).reshape(len(ids), dims)
                lo, hi = (get(c, np.int64).reshape(len(query), -1) for c in ("lo", "hi"))
                scores = q @ x.T if exact_doubles else q.astype(np.int64) @ x.astype(np.int64).T
                fits = (own_id[:, None] != ids) & ((own_label[:, None] == labels) == same_label)
                out = []
                for i in range(len(query)):
                    usable = np.flatnonzero(fits[i])
                    mine = scores[i, usable]
                    for w in range(lo.shape[1]):
                        inside = np.flatnonzero((mine >= lo[i, w]) & (mine <= hi[i, w]))
                        if len(inside) > k:
                            inside = inside[mine[inside] >= np.partition(mine[inside], len(inside) - k)[len(inside) - k]]
                        best = inside[np.lexsort((ids[usable[inside]], -mine[inside]))[:k]]
                        out.append((np.full(len(best), query[i]), np.full(len(best), w), mine[best].astype(np.int64), ids[usable[best]]))
                if out:
                    query, w, score, found = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(w.astype(np.int32)), pa.array(score), pa.array(found)], names=["query", "window", "score", "id"])

    # Few rows at a time reach Python: each is a block beside a message.
    return met.select("query", "own_id", "own_label", "q", "lo", "hi", "ids", "labels", "vecs").mapInArrow(run, "query long, window int, score long, id long")


class Index:
    """All rows of a table in the leaves of a tree."""

    def __init__(self, rows: DataFrame, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS):
        """rows are stored `vectors`, not empty."""
        n, most, dims = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("vec"))).first()
        dims = max(dims, 1)
        size = max(1, min(sample_rows, SAMPLE_BYTES // (8 * dims)))
        # At most `size` rows.
        sample = rows.select("vec").orderBy(F.xxhash64("id", "vec")).limit(size).toArrow()
        sample = matrix(sample.column("vec").combine_chunks(), dims)
        tree = Tree(sample, most, max(1, int(leaf_rows * len(sample) / n)))
        self.exact_doubles = most < 1 << 53
        self.blocks = _index(rows, tree, "negatives-blocks")
        # As many rows as the tree has ranges, and one per leaf: bounded by the sample.
        ranges = self.blocks.select(F.explode("ranges").alias("r")).groupBy("r.node", "r.point", "r.child").agg(F.min("r.low"), F.max("r.high")).collect()
        self.slices = {r["leaf"]: r["n"] for r in self.blocks.groupBy("leaf").agg((F.max("slice") + 1).alias("n")).collect()}
        self.tree = tree.bounded(map(tuple, ranges))

    def _round(self, queries: DataFrame, k: int, same_label: bool, own_leaf: bool) -> DataFrame:
        met = _messages(queries, self.tree, self.slices, own_leaf).join(self.blocks.drop("ranges"), ["leaf", "slice"])
        found = _scored(met, self.tree.dims, k, same_label, self.exact_doubles)
        best_first = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """(query, window, rank, score, id): the k best rows in each window of each query.

        queries has (query, id, label, vec, lo, hi); lo and hi are arrays of scores (long), one pair for each window.
        Only rows of the query's label count, or only those of others, and none of its id.
        """
        first = self._round(queries, k, same_label, own_leaf=True).filter(F.col("rank") == k)
        raised = stored(first.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth")), "negatives-kth")
        at_least = F.transform("lo", lambda x, w: F.greatest(x, F.try_element_at("kth", w)))
        lifted = queries.join(raised, "query", "left").withColumn("lo", F.when(F.col("kth").isNull(), F.col("lo")).otherwise(at_least))
        return self._round(lifted, k, same_label, own_leaf=False)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: float = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor is a condition on `id`."""
    spark = rows.sparkSession
    given = stored(vectors(rows, scale, id_col, vector_col, label_col), "negatives-vectors")
    anchors = stored(given.filter(is_anchor).withColumn("query", F.monotonically_increasing_id()), "negatives-anchors")
    if anchors.isEmpty():
        return spark.createDataFrame([], RESULT)
    index = Index(given, leaf_rows, sample_rows)
    everything = anchors.withColumn("lo", F.array(F.lit(LOWEST))).withColumn("hi", F.array(F.lit(HIGHEST)))
    near = stored(index.search(everything, positives, same_label=True).select("query", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # At most `positives` windows per query, in whole scores: 100 * s between window[0] * p and window[1] * p.
    of = F.col("rank").alias("of")
    lowest, highest = (F.expr(f"{x} DIV 100").cast("long") for x in (f"(CAST(positive_score AS DECIMAL(19)) * {window[0]} + 99)", f"(CAST(positive_score AS DECIMAL(19)) * {window[1]})"))
    bounds = near.filter(F.col("positive_score") >= 0).select("query", of, lowest.alias("from"), highest.alias("to"))
    windows = bounds.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("of", "from", "to"))).alias("windows"))
    queries = stored(anchors.join(windows, "query").select("query", "id", "label", "vec", F.col("windows.from").alias("lo"), F.col("windows.to").alias("hi"), F.col("windows.of").alias("of")), "negatives-windows")
    found = index.search(queries, negatives, same_label=False).select("query", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = found.join(queries.select("query", F.col("id").alias("anchor_id"), F.posexplode("of").alias("window", "of")), ["query", "window"])
    told = told.join(near.select("query", of, "positive_id", "positive_score"), ["query", "of"])
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

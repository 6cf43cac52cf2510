"""N-gram Jaccard join with a token-group matrix.

A document is its set of distinct word 5-grams (shingles); two link when the shared ones are at least 3/4 of all of theirs. The result is
exact: no link between different texts is lost.

1. Equal sets are one node, whatever the number of copies. A first pass over the texts hashes the sets, and adds up shingles that
   several texts of a window share; the most frequent ones (a bounded number) give the order in which shingles are ranked: rare before
   frequent, then by hash. The order only decides how much work there is.
2. If two sets link, at least LEVEL shingles stand in the leading part of both: the first n - ceil(3n/4) + LEVEL of n in that order. Only these are
   shuffled, and those that a single node has are dropped.
3. Nodes are partitioned into groups of similar ones: with the smallest node of most of their shared shingles, in blocks of bounded
   size. All pairs of a block are verified at once in one task, and components are formed.
4. The token-group matrix has a row for each leading shingle and each group that still meets nodes of another component in it. Its
   counts bound how much a block of queries can share with a group; only pairs of blocks that reach the bound are opened, and there only queries
   that reach it for themselves are verified against each other. Groups that are in one component already are never opened against each other.
5. The components of all links give every document the smallest id it is connected with.

Sets are made again from the texts of the nodes that need them, and go straight to the task of their block.

Defined cases: NULL and empty texts, and texts without words, have the empty set and link with nothing; equal rows link with each other
unless empty; a repeated id is handled per row; a NULL id is larger than any other, and a component of only NULL ids has a NULL component_id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm import flat
from firnline.llm.common import column, stored
from firnline.llm.graph import components

WORDS = 5
#: Shingles of the leading parts that a linked pair shares at least.
LEVEL = 3
#: A shingle that so many of the different texts of a window have is counted over the corpus; of those counted, the most frequent are
#: ranked by frequency. A window is a run of texts of a task with about so many shingles.
WINDOW_TIMES = 2
WINDOW_SHINGLES = 1 << 21
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 20
MOST_RANKED = 1 << 20
LEAST_TIMES = 16
#: Nodes, and shingles of all its nodes, that a block may have, unless it is a single node.
BLOCK_NODES = 128
BLOCK_SHINGLES = 1 << 18

_NO_ID = (1 << 63) - 1


def overlap_needed(n: Column) -> Column:
    """Least overlap with any set, of a set of n shingles that links with it."""
    return F.ceil(3 * n / 4)


def lead_size(n: Column) -> Column:
    return F.least(n, n - overlap_needed(n) + LEVEL)


def shingle_sets(part: flat.Flat) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = flat.LOWER[part.data]
    words = flat.tokens(part, flat.NOT_BLANK[low].astype(np.uint8))
    h = flat.hashes(low, words.starts, words.ends)
    found, first = flat.runs(h, words.doc, WORDS)
    docs = words.doc[first]
    for k in range(1, WORDS):
        # Shorter texts are one shingle as a whole.
        some, at = flat.runs(h, words.doc, k)
        whole = words.counts[words.doc[at]] == k
        found, docs = np.concatenate([found, some[whole] + np.uint64(k)]), np.concatenate([docs, words.doc[at[whole]]])
    order = np.argsort(docs, kind="stable")
    found, ends = found[order], np.cumsum(np.bincount(docs, minlength=len(part)))
    return [np.unique(found[lo:hi]) for lo, hi in zip(np.append(0, ends[:-1]), ends)]


def set_key(shingles: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    with np.errstate(over="ignore"):
        total = flat.mix(shingles * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(flat.mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, n, key) of documents, and rows (token, times) of shingles frequent in a batch."""
    window, keys_seen, size = [], set(), 0

    def frequent() -> pa.RecordBatch:
        token, times = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *window]), return_counts=True)
        often = times >= WINDOW_TIMES
        token, times = token[often].view(np.int64), times[often]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token), pa.array(times)], names=["id", "mark", "n", "key", "token", "times"])

    for batch in batches:
        ids, marks = column(batch, "id"), column(batch, "mark")
        for part in flat.slices(column(batch, "text"), SLICE_BYTES):
            sets = shingle_sets(part)
            keys = [set_key(s) for s in sets]
            for key, s in zip(keys, sets):
                if key not in keys_seen:
                    keys_seen.add(key)
                    window.append(s)
                    size += len(s)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(part.first, len(part)), marks.slice(part.first, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), none, none],
                names=["id", "mark", "n", "key", "token", "times"],
            )
            if size > WINDOW_SHINGLES:
                yield frequent()
                window, keys_seen, size = [], set(), 0
    yield frequent()


def _leading(ranked: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, key) of the leading parts; a token is the rank of its shingle: class of frequency, then hash."""
    known, classes = ranked
    for batch in batches:
        for part in flat.slices(column(batch, "text"), SLICE_BYTES):
            different = {set_key(s): s for s in shingle_sets(part) if len(s)}
            tokens, keys = [], []
            for key, s in different.items():
                rank = s >> np.uint64(7)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = rank | np.where(known[at] == s, classes[at], 0).astype(np.uint64) << np.uint64(57)
                size = min(len(s), len(s) + 3 * len(s) // -4 + LEVEL)
                tokens.append(np.partition(rank, size - 1)[:size] if size < len(s) else rank)
                keys.append(np.full(size, key))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys))], names=["token", "key"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, salt, key, component, shingles) of (group, salt, key, component, text); rows that repeat in a batch once."""
    names = ["group", "salt", "key", "component"]
    for batch in batches:
        places = zip(*(column(batch, c).to_pylist() for c in names[:3]))
        batch = batch.take(pa.array(sorted({p: i for i, p in enumerate(places)}.values()), pa.int64()))
        for part in flat.slices(column(batch, "text"), SLICE_BYTES):
            sets = pa.array([s.tobytes() for s in shingle_sets(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(part.first, len(part)) for c in names), sets], names=[*names, "shingles"])


def _verified(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links that join components, of all pairs of nodes wanted together: (group, salt, key, component, id, mark).

    id and mark name the row whose text has the node's set; rows that repeat both are the same text.
    """
    sets = texts.join(wanted, ["id", "mark"]).select("group", "salt", "key", "component", "text").mapInArrow(
        _with_sets, "group long, salt int, key long, component long, shingles binary")
    return sets.groupBy("group", "salt").applyInArrow(_verify, "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of overlap sizes of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], token[shared]
    place = np.cumsum(times > 1) - 1
    token, n = place[token], int((times > 1).sum())
    out = np.zeros((len(sets), len(sets)))
    width = max(1, (1 << 22) // len(sets))
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for lo in range(0, n, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        block = np.zeros((len(sets), min(width, n - lo)), dtype=np.float32)
        block[owner[a:b], token[a:b] - lo] = 1
        out += block @ block.T
    return out


def _forest(keys: np.ndarray, parts: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges that connect what links connect; parts are the components before."""
    sizes = np.array([len(s) for s in sets])
    shared = _overlaps(sets)
    a, b = np.nonzero(np.triu(4 * shared >= 3 * (sizes[:, None] + sizes[None, :] - shared), 1))
    root = {p: p for p in parts.tolist()}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    left, right = [], []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(int(parts[i])), find(int(parts[j]))
        if x != y:
            root[y] = x
            left.append(int(keys[i]))
            right.append(int(keys[j]))
    return left, right


def _verify(block: pa.Table) -> pa.Table:
    """All pairs of a block (key, component, shingles); (a, b) of the links that join components."""
    keys = block["key"].to_numpy()
    keys, first = np.unique(keys, return_index=True)
    sets = [np.frombuffer(s, dtype=np.uint64) for s in block["shingles"].take(pa.array(first)).to_pylist()]
    a, b = _forest(keys, block["component"].to_numpy()[first], sets)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _salted(rows: DataFrame, group: str) -> DataFrame:
    """rows (key, n, group) with the number of blocks of their group (salts) and their block (salt)."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("all"))
    salts = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.least(F.col("nodes"), F.ceil(F.col("all") / BLOCK_SHINGLES))).cast("int")
    return rows.join(sizes.select(group, "nodes", salts.alias("salts")), group).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) of every row; mark is the hash of its text."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    seen = stored(texts.mapInArrow(_first_pass, "id long, mark long, n long, key long, token long, times long"), "jaccard-sets")
    rows = seen.filter(F.col("token").isNull()).select("id", "mark", "n", "key")
    nodes = rows.filter(F.col("n") > 0).groupBy("key").agg(F.min(F.struct("id", "mark")).alias("row"), F.min("n").alias("n")).select("key", "row.*", "n")
    nodes = stored(nodes, "jaccard-nodes")

    # Classes of frequency: powers of two, from the first at which at most MOST_RANKED shingles are left.
    frequent = seen.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= LEAST_TIMES)
    frequent = stored(frequent.select("token", F.floor(F.log2("times")).cast("int").alias("class")), "jaccard-frequent")
    total, least = 0, 64
    for r in sorted(frequent.groupBy("class").count().collect(), reverse=True):
        total += r["count"]
        if total > MOST_RANKED:
            break
        least = r["class"]
    ranked = frequent.filter(F.col("class") >= least).toArrow()
    known = ranked["token"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[order], ranked["class"].to_numpy()[order].astype(np.uint64)))

    leading = texts.select("text").mapInArrow(lambda it: _leading(sent.value, it), "token long, key long")
    by_token = Window.partitionBy("token")
    shared = leading.repartition("token").dropDuplicates(["token", "key"]).withColumn("least", F.min("key").over(by_token))
    shared = stored(shared.withColumn("most", F.max("key").over(by_token)).filter(F.col("least") < F.col("most")).select("token", "key", F.col("least").alias("leader")), "jaccard-shared")

    # Similar nodes: a node's group is that of the leader with which it shares most. They need not link: a group only has to be compact.
    counts = shared.groupBy("key", "leader").agg(F.count(F.lit(1)).alias("c"))
    enough = counts.groupBy("key").agg(F.sum("c").alias("c")).join(nodes, "key").filter(F.col("c") >= F.least(F.lit(LEVEL), overlap_needed(F.col("n"))))
    enough = stored(enough.select("key", "id", "mark", "n"), "jaccard-open")
    best = counts.groupBy("key").agg(F.max(F.struct("c", F.bitwise_not("leader").alias("h"), "leader")).alias("b"))
    members = enough.join(best, "key", "left").select("key", "n", F.coalesce("b.leader", "key").alias("label"))
    members = stored(_salted(members, "label"), "jaccard-members")

    # Pairs inside the blocks; the leader is in each block of its group, so that blocks can meet over it.
    own = members.filter(F.col("nodes") > 1).select("key", "label", "salt")
    guests = members.filter(F.col("salts") > 1).select("label", "salts").distinct().select(F.col("label").alias("key"), "label", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    named_rows = enough.select("key", "id", "mark")
    blocks = own.union(guests).distinct().join(named_rows, "key").select(F.col("label").alias("group"), "salt", "key", F.col("key").alias("component"), "id", "mark")
    edges = stored(_verified(texts, blocks), "jaccard-edges")
    parts = stored(components(edges), "jaccard-parts")

    # What is open: shingles in which nodes of different components meet.
    placed = members.join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "label", F.coalesce("component", "key").alias("component"), F.col("component").isNotNull().alias("joined"), F.col("salts").alias("old_salts"))
    meet = shared.select("token", "key").join(placed, "key")
    meet = meet.withColumn("least", F.min("component").over(by_token)).withColumn("most", F.max("component").over(by_token)).filter(F.col("least") < F.col("most"))
    meet = stored(meet.select("token", "key"), "jaccard-meet")
    # Groups now: those of one component, and of a leader's single nodes.
    left = placed.join(meet.select("key").distinct(), "key", "left_semi")
    left = left.withColumn("group", F.when(F.col("joined"), F.xxhash64("component", F.lit(1))).otherwise(F.xxhash64("label", F.lit(0))))
    left = _salted(left, "group").withColumn("block", F.xxhash64("group", "salt"))
    left = stored(left.select("key", "n", "component", "joined", "group", "block", "nodes", "old_salts"), "jaccard-left")
    facts = left.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.first("group").alias("group"), F.first("joined").alias("joined"), F.count(F.lit(1)).alias("size"), F.max("old_salts").alias("old_salts"))
    matrix = stored(meet.join(left.select("key", "block"), "key").select("token", "block").distinct().join(facts, "block"), "jaccard-matrix")
    a, b = (matrix.select("token", *[F.col(c).alias(c + s) for c in ("block", "low", "high", "group", "joined")]) for s in ("_a", "_b"))
    bound = a.join(b, "token").filter((F.col("block_a") < F.col("block_b")) & ~((F.col("group_a") == F.col("group_b")) & F.col("joined_a")))
    bound = bound.groupBy("block_a", "block_b").agg(F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in ("low_a", "low_b", "high_a", "high_b")])
    opened = bound.filter(_may_link(F.col("c"), F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b"))).select("block_a", "block_b")
    # Single nodes of a group that was in several blocks meet inside their new block too.
    inside = facts.filter(~F.col("joined") & (F.col("size") > 1) & (F.col("old_salts") > 1)).select(F.col("block").alias("block_a"), F.col("block").alias("block_b"))
    opened = stored(opened.union(inside).withColumn("pair", F.xxhash64("block_a", "block_b")), "jaccard-opened")
    # Of an opened pair only the queries go on that can link with the group on the other side.
    sides = opened.select("pair", F.col("block_a").alias("block"), F.col("block_b").alias("other")).union(opened.select("pair", "block_b", "block_a")).distinct()
    queries = left.select("key", "n", "component", "block").join(meet.groupBy("key").agg(F.collect_list("token").alias("tokens")), "key")
    groups = matrix.groupBy(F.col("block").alias("other")).agg(F.collect_list("token").alias("union"), F.first("low").alias("low"), F.first("high").alias("high"))
    asked = sides.join(groups, "other").join(queries, "block")
    asked = asked.filter(_may_link(F.size(F.array_intersect("tokens", "union")), F.col("n"), F.col("n"), F.col("low"), F.col("high")))
    facing = asked.select(F.col("pair").alias("group"), F.lit(0).alias("salt"), "key", "component").distinct().join(named_rows, "key")
    more = stored(_verified(texts, facing), "jaccard-edges")

    final = components(edges.union(more))
    named = nodes.join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # Read anew by both: the minima are pre-aggregated, and a large component's side of the join can be split.
    named = stored(named.select("key", "id", "component"), "jaccard-named")
    least_id = named.groupBy("component").agg(F.min("id").alias("least"))
    by_node = named.join(least_id, "component").select("key", "least")
    # Documents without shingles have no node.
    result = rows.withColumn("key", F.when(F.col("n") > 0, F.col("key"))).join(by_node, "key", "left")
    return result.select(
        F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "mark", F.col("n").alias("n_shingles"), F.nullif(F.coalesce("least", "id"), F.lit(_NO_ID)).alias("component_id")
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest id; rows without an id stay, and one of rows that repeat id and text."""
    found = stored(linked(docs, id_col, text_col).filter(F.col("doc_id").isNotNull()), "jaccard-result")
    names = {"id": "__id", "mark": "__mark"}
    marked = docs.withColumns({names["id"]: F.col(id_col).cast("long"), names["mark"]: F.xxhash64(text_col)})
    by = list(names.values())
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    left = marked.join(gone, by, "left_anti")
    repeated = found.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).count().filter(F.col("count") > 1).drop("count")
    if not repeated.isEmpty():
        again = left.join(repeated, by, "left_semi").dropDuplicates(by)
        left = left.join(repeated, by, "left_anti").unionByName(again)
    return left.drop(*by)


def _may_link(c: Column, low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether sets of low..high shingles can link with sets of other_low..other_high, if they share at most c leading shingles.

    Of the set whose leading part ends first, the leading shingles not shared are not in the other one; a link of sizes n and m needs an
    overlap of 3 (n + m) / 7.
    """
    most = F.greatest(high, other_high)
    needed = F.ceil(3 * (low + other_low) / 7)
    sized = (4 * high >= 3 * other_low) & (4 * other_high >= 3 * low)
    return sized & (c >= F.least(F.lit(LEVEL), overlap_needed(F.least(low, other_low)))) & (c + most - lead_size(most) >= needed)

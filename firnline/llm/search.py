"""Exact top-k search in binary codes by incremental multi-index hashing.

A code is cut into m segments, each indexed by its value. Round r looks up every segment value at distance r of each open query
and verifies the codes found by their whole Hamming distance. After round r every code at a distance of at most m (r + 1) - 1 has been
found, since one of its segments is within r; a query is closed once its k-th verified distance is covered. Codes farther than the k-th
so far are dropped inside the lookup. Equal codes are one entry with its k smallest ids. A segment has about log2(n) - 2 bits, so that a
bucket holds a few codes at any size.

Result: the k nearest rows of each query, nearest first, ties to the smaller id; a query that is itself a row finds itself.
With fewer than k rows all are returned.

Defined cases: rows with a NULL id, or a NULL embedding, are neither found nor searched for; components that are missing, NULL or not above 0 give
bit 0; a repeated (id, code) is one row, an id with several codes is found by each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.common import stored

K = 10
MOST_SEGMENT_BITS = 16


def binary_codes(rows: DataFrame, dims: int, segment_bits: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): signs of the components as an array of segment values."""

    def bit(i: int) -> Column:
        return F.when(F.get(vector_col, F.lit(i)) > 0, F.lit(1 << (i % segment_bits))).otherwise(F.lit(0))

    segments = []
    for lo in range(0, dims, segment_bits):
        value = bit(lo)
        for i in range(lo + 1, min(lo + segment_bits, dims)):
            value = value + bit(i)
        segments.append(value.cast("int"))
    given = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return given.select(F.col(id_col).cast("long").alias("id"), F.array(*segments).alias("code"))


def _distance(m: int) -> Column:
    total = F.bit_count(F.get("code", F.lit(0)).bitwiseXOR(F.get("query", F.lit(0))))
    for i in range(1, m):
        total = total + F.bit_count(F.get("code", F.lit(i)).bitwiseXOR(F.get("query", F.lit(i))))
    return total


def top_k(rows: DataFrame, is_query: Column, dims: int, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance) for the rows that `is_query` (a condition on id) admits, against all rows."""
    spark = rows.sparkSession
    n = rows.count()
    bits = max(4, min(MOST_SEGMENT_BITS, max(n, 2).bit_length() - 3, dims))
    m = -(-dims // bits)
    codes = stored(binary_codes(rows, dims, bits, id_col, vector_col), "codes")
    # The k smallest ids of a code, repeats as one: the limit on ranks is applied before the shuffle, so a very common code costs k rows per task.
    by_code = Window.partitionBy("code").orderBy("id")
    index = stored(codes.withColumn("place", F.dense_rank().over(by_code)).filter(F.col("place") <= k)
                   .groupBy("code").agg(F.array_sort(F.collect_set("id")).alias("ids")), "code-index")
    segments = stored(index.select("code", F.posexplode("code").alias("segment", "value")), "code-segments")
    masks = spark.range(1 << bits).select(F.bit_count("id").alias("radius"), F.col("id").cast("int").alias("mask"))
    # Queries with equal codes are searched once.
    queries = codes.filter(is_query).select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    open_ = stored(queries.select("query").distinct().withColumn("limit", F.lit(dims)), "open-queries")
    best, done = None, None
    nearest_first = Window.partitionBy("query").orderBy("distance", F.get("ids", F.lit(0)))
    for radius in range(bits + 1):
        # At most 2**bits masks over all rounds.
        near = F.broadcast(masks.filter(F.col("radius") == radius).select(F.lit(radius).alias("radius"), "mask"))
        probes = open_.select("query", "limit", F.lit(radius).alias("radius"), F.posexplode("query").alias("segment", "own")).join(near, "radius")
        probes = probes.select("query", "limit", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        at = (probes["segment"] == segments["segment"]) & (probes["value"] == segments["value"])
        found = probes.join(segments, at & (_distance(m) <= F.col("limit"))).select("query", "code").distinct().withColumn("distance", _distance(m).cast("int"))
        if best is not None:
            found = found.unionByName(best.select("query", "code", "distance")).distinct()
        kept = found.join(index, "code").withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k)
        best = stored(kept.select("query", "code", "distance", "ids", "rank"), "nearest")
        # The k-th distance counts rows, not codes. Once all segment values are tried nothing is left to find.
        counted = best.withColumn("n", F.sum(F.size("ids")).over(nearest_first)).withColumn("kth", F.when(F.col("n") >= k, F.col("distance")))
        state = stored(counted.groupBy("query").agg(F.min("kth").alias("kth")), "query-state")
        closed = state.filter(F.lit(radius == bits) | (F.col("kth") <= m * (radius + 1) - 1)).select("query")
        part = best.join(closed, "query", "left_semi").select("query", "distance", "ids")
        done = part if done is None else done.unionByName(part)
        open_ = open_.join(closed, "query", "left_anti").join(state, "query", "left")
        open_ = stored(open_.select("query", F.coalesce("kth", F.lit(dims)).cast("int").alias("limit")), "open-queries")
        if open_.isEmpty():
            break
        best = best.join(closed, "query", "left_anti")
    each = done.join(queries, "query").select("query_id", "distance", F.explode("ids").alias("id"))
    by_query = Window.partitionBy("query_id").orderBy("distance", "id")
    return each.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

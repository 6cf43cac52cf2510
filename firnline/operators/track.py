"""Ordered operators along a flight frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_SECONDS = 6 * 3600


def interpolate(df: DataFrame, value: str, out: str, *, frame: str = "frame_id", time: str = "slow_time",
                tie: str = "trace_id", min_known: int = 2, chunk: Column | None = None) -> DataFrame:
    """Linear interpolation over the row positions of a frame, ends held at the nearest known value.

    A two-level scan: windows inside (frame, time chunk), one summary row per
    chunk, windows over a frame's summaries, then the two are put together.  No
    task ever sorts a whole frame.  Frames with fewer than ``min_known`` known
    values give NULL.
    """
    c = chunk if chunk is not None else F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(CHUNK_SECONDS * 1_000_000))
    v = F.col(value)
    order = W.partitionBy(frame, "_c").orderBy(time, tie)
    so_far, from_here = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    rows = df.withColumn("_c", c).withColumn("_p", F.row_number().over(order).cast("long"))
    known = F.when(v.isNotNull(), F.struct(F.col("_p").alias("p"), v.alias("v")))
    rows = rows.withColumn("_k", known).withColumns({
        "_back": F.last("_k", ignorenulls=True).over(so_far),
        "_next": F.first("_k", ignorenulls=True).over(from_here)})

    chunks = rows.groupBy(frame, "_c").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_k").alias("_nk"), F.max("_k").alias("_last"), F.min("_k").alias("_first"))
    line = W.partitionBy(frame).orderBy("_c")
    before, after = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(1, W.unboundedFollowing)
    chunks = chunks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    def moved(s: str) -> Column:
        return F.when(F.col(s).isNotNull(), F.struct((F.col(s)["p"] + F.col("_off")).alias("p"), F.col(s)["v"].alias("v")))

    chunks = chunks.withColumns({"_last": moved("_last"), "_first": moved("_first")}).select(
        F.col(frame).alias("_f"), F.col("_c").alias("_cc"), "_off",
        F.last("_last", ignorenulls=True).over(before).alias("_pb"),
        F.first("_first", ignorenulls=True).over(after).alias("_nb"),
        F.sum("_nk").over(W.partitionBy(frame)).alias("_known"))
    j = rows.join(chunks, (F.col(frame).eqNullSafe(F.col("_f"))) & (F.col("_c").eqNullSafe(F.col("_cc"))))
    b = F.coalesce(moved("_back"), F.col("_pb"))
    n = F.coalesce(moved("_next"), F.col("_nb"))
    pos = F.col("_p") + F.col("_off")
    lerp = (
        F.when(F.col("_b").isNull(), F.col("_n2")["v"])
        .when(F.col("_n2").isNull() | (F.col("_n2")["p"] == F.col("_b")["p"]), F.col("_b")["v"])
        .otherwise(F.col("_b")["v"] + (F.col("_n2")["v"] - F.col("_b")["v"]) * (pos - F.col("_b")["p"])
                   / (F.col("_n2")["p"] - F.col("_b")["p"])))
    return j.withColumns({"_b": b, "_n2": n}).withColumn(out, F.when(F.col("_known") >= min_known, lerp)).select(*df.columns, out)


def greedy_levels(sorted_heights: Column, min_gap: float = 200.0) -> Column:
    """Largest number of heights with consecutive gaps of at least ``min_gap``."""
    return F.aggregate(
        sorted_heights,
        F.struct(F.lit(0).alias("n"), F.lit(float("-inf")).alias("last")),
        lambda s, h: F.when(h - s["last"] >= min_gap, F.struct((s["n"] + 1).alias("n"), h.alias("last"))).otherwise(s),
        lambda s: s["n"],
    )

"""Scores, histograms, curves and summaries used by the analysis jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def score(truth: Column, mean: Column, sd: Column) -> dict[str, Column]:
    """RMSE, MAE, one-sigma coverage and count as aggregate columns."""
    e = truth - mean
    return {
        "rmse_dB": F.sqrt(F.avg(e * e)),
        "mae_dB": F.avg(F.abs(e)),
        "coverage_1sigma": F.avg((F.abs(e) <= sd).cast("double")),
        "n_points": F.count(e),
    }


def pooled(value: str, weight: str) -> dict[str, Column]:
    return {
        f"{value}_mean": F.sum(F.col(value) * F.col(weight)) / F.sum(weight),
        f"{value}_min": F.min(value),
        f"{value}_max": F.max(value),
    }


def normalizer(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population sd per column in one pass; a constant column gets sd 1."""
    aggs = []
    for c in columns:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}__mean"), F.when(sd > 0, sd).otherwise(1.0).alias(f"{c}__sd")]
    return df.groupBy(*keys).agg(*aggs)


def bin_of(v: Column, lo: float, width: float, n: int) -> Column:
    """Half-open bin number, NULL outside the n bins."""
    b = F.floor((v - F.lit(float(lo))) / F.lit(float(width)))
    return F.when((b >= 0) & (b < n), b).cast("int")


def edge_bin(v: Column, edges: Sequence[float], right_closed: bool = True) -> Column:
    """Number of the interval of irregular ``edges`` a value lies in, NULL outside."""
    out = None
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        c = (v > a) & (v <= b) if right_closed else (v >= a) & (v < b)
        out = F.when(c, i) if out is None else out.when(c, i)
    return out.cast("int")


def histogram_bin(v: Column, lo: float, hi: float, n: int) -> Column:
    """Equal bins over [lo, hi] with the last bin closed on both sides, NULL outside."""
    b = F.floor((v - F.lit(float(lo))) / F.lit((float(hi) - float(lo)) / n))
    b = F.when(v == F.lit(float(hi)), F.lit(n - 1)).otherwise(b)
    return F.when((v >= F.lit(float(lo))) & (v <= F.lit(float(hi))), F.least(b, F.lit(n - 1))).cast("int")


def density(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, n: int) -> DataFrame:
    """Fixed-edge density histogram: count over (values in range x bin width)."""
    keys = list(keys)
    counts = df.withColumn("bin", histogram_bin(F.col(value), lo, hi, n)).where("bin is not null").groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(w) * F.lit((hi - lo) / n)))


def clamped_bin(v: Column, lo: Column | float, hi: Column | float, n: int) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - lo) / (hi - lo) * n))).cast("int")


def share_above(hist: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Reverse-cumulative percentage over at most a few hundred bins per group."""
    w = W.partitionBy(*keys)
    above = F.sum(count).over(w.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0))
    return hist.withColumns({"pct": F.col(count) / F.sum(count).over(w) * 100, "pct_above": above / F.sum(count).over(w) * 100})


def detection_curve(df: DataFrame, keys: Sequence[str], margin: str, detected: Column, lo: float, width: float, n: int,
                    min_n: int) -> DataFrame:
    """Detected fraction per margin bin, NULL where fewer than ``min_n`` traces."""
    return (
        df.withColumn("bin", bin_of(F.col(margin), lo, width, n)).where("bin is not null")
        .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(detected.cast("double")).alias("_f"))
        .select(*keys, "bin", "n", F.when(F.col("n") >= min_n, F.col("_f")).alias("fraction")))


def gaussian_kernels(levels: DataFrame, sd_scale: float, width: float) -> DataFrame:
    """(sd, offset, weight) for every quantised sd of levels (column sd): normalised over offsets up to four sigma."""
    s = F.col("sd") / F.lit(sd_scale * width)
    half = F.greatest(F.lit(1), F.ceil(4 * s)).cast("int")
    k = levels.select("sd", s.alias("s"), F.explode(F.sequence(-half, half)).alias("offset"))
    w = F.when(F.col("s") > 0, F.exp(-0.5 * F.col("offset") * F.col("offset") / (F.col("s") * F.col("s")))).otherwise((F.col("offset") == 0).cast("double"))
    k = k.select("sd", "offset", w.alias("w"))
    return k.join(k.groupBy("sd").agg(F.sum("w").alias("t")), "sd").select("sd", "offset", (F.col("w") / F.col("t")).alias("weight"))


def mixture_histogram(cells: DataFrame, keys: Sequence[str], value: str, sd: str, sd_scale: float, lo: float, hi: float,
                      nbins: int) -> DataFrame:
    """Area-weighted mixture of every cell's normal, on fixed bins.

    ``sd`` is a quantised integer, so cells collapse to (group, sd, bin) counts
    first; each count is then spread over the kernel of its sd.  A cell without
    sd is a point mass.  Mass beyond the axis is dropped.
    """
    keys = list(keys)
    counts = cells.groupBy(*keys, F.coalesce(F.col(sd).cast("int"), F.lit(0)).alias("sd"), clamped_bin(F.col(value), lo, hi, nbins).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"))
    k = gaussian_kernels(counts.select("sd").distinct(), sd_scale, (hi - lo) / nbins)
    spread = counts.join(k, "sd").select(*keys, (F.col("_b") + F.col("offset")).alias("bin"), (F.col("_c") * F.col("weight")).alias("_m"))
    return spread.where((F.col("bin") >= 0) & (F.col("bin") < nbins)).groupBy(*keys, "bin").agg(F.sum("_m").alias("mass"))


def every_kth_draw(draws: DataFrame, draw: str, n_draws: int, max_samples: int = 1000) -> DataFrame:
    """Thin posterior draws (numbered from 0) to at most ``max_samples``."""
    step = -(-n_draws // max_samples) if n_draws > max_samples else 1
    return draws.where(F.col(draw) % step == 0)

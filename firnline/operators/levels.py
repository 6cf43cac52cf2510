"""Height levels of a site: frame medians, then a greedy count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from firnline.operators.track import greedy_levels

MIN_GAP_M = 200.0


def site_levels(df: DataFrame, keys: Sequence[str], frame: str, height: str, out: str = "n_levels",
                min_gap: float = MIN_GAP_M) -> DataFrame:
    """Levels per site from the median height of each frame; 0 where fewer than two frames.

    A frame crosses a site once, so its median is a built-in exact percentile over few rows, counted in the
    tasks before they are moved; what is put side by side per site is one distinct number per overflight.
    """
    keys = list(keys)
    med = df.where(F.col(height).isNotNull()).groupBy(*keys, frame).agg(F.percentile(F.col(height).cast("double"), 0.5).alias("_h"))
    sites = med.groupBy(*keys).agg(F.count(F.lit(1)).alias("_frames"), F.collect_set("_h").alias("_hs"))
    levels = greedy_levels(F.array_sort("_hs"), min_gap)
    return sites.select(*keys, F.when(F.col("_frames") >= 2, levels).otherwise(0).cast("int").alias(out))

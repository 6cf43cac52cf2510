"""Trace filters and calibration quality control, null-safe throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Default calibration rules and the threshold variants of the sensitivity table.
CALIBRATION_QC = {
    "max_seam_offset_dB": 3.0,
    "drop_unmeasured_seam": False,
    "require_img1_surface": True,
    "min_ceiling_margin_dB": 2.0,
}
QC_VARIANTS = {
    "adopted": {},
    "max_seam_offset_dB=2.0": {"max_seam_offset_dB": 2.0},
    "max_seam_offset_dB=5.0": {"max_seam_offset_dB": 5.0},
    "min_ceiling_margin_dB=1.0": {"min_ceiling_margin_dB": 1.0},
    "min_ceiling_margin_dB=3.0": {"min_ceiling_margin_dB": 3.0},
    "require_img1_surface=false": {"require_img1_surface": False},
    "drop_unmeasured_seam=true": {"drop_unmeasured_seam": True},
}


def truth(c: Column, missing: bool = False) -> Column:
    """A nullable condition with NULL decided."""
    return F.coalesce(c.cast("boolean"), F.lit(missing))


def passing_traces(df: DataFrame, qc_only: bool = True, include_nondetections: bool = False) -> DataFrame:
    """QC-passing traces; optionally attempted-but-unpicked ones with a good surface too."""
    if not qc_only or "qc_pass" not in df.columns:
        return df
    keep = truth(F.col("qc_pass"))
    flags = ["qc_surface_pass", "bed_pick_attempted", "bed_pick_available"]
    if include_nondetections and set(flags) <= set(df.columns):
        keep = keep | (truth(F.col(flags[0])) & truth(F.col(flags[1])) & ~truth(F.col(flags[2])))
    return df.where(keep)


def min_thickness(df: DataFrame, limit_m: float | None, thickness: Column | None = None) -> DataFrame:
    """Drop rows known to be thinner than the limit; unknown thickness stays."""
    if limit_m is None:
        return df
    t = thickness if thickness is not None else F.col("surface_elevation") - F.col("bed_elevation")
    return df.where(truth(t >= float(limit_m), missing=True))


def without_seasons(df: DataFrame, seasons: Sequence[str], column: str = "collection") -> DataFrame:
    if not seasons:
        return df
    return df.where(truth(~F.col(column).isin(list(seasons)), missing=True))


def calibration_flags(columns: Sequence[str], qc: dict | None = None) -> dict[str, Column]:
    """Rejection flags; a missing column or a missing value rejects nothing."""
    q = {**CALIBRATION_QC, **(qc or {})}
    no = F.lit(False)
    have = set(columns)
    seam = truth(F.abs("img_comb_offset_dB") >= q["max_seam_offset_dB"]) if "img_comb_offset_dB" in have else no
    if q["drop_unmeasured_seam"]:
        seam = seam | (F.col("img_comb_offset_dB").isNull() if "img_comb_offset_dB" in have else F.lit(True))
    img2 = no
    if q["require_img1_surface"] and "surface_source_image_index" in have:
        img2 = truth(F.col("surface_source_image_index") >= 2)
    saturated = no
    if "surface_ceiling_margin_dB" in have:
        saturated = truth(F.col("surface_ceiling_margin_dB") < q["min_ceiling_margin_dB"])
    return {"seam": seam, "img2": img2, "saturated": saturated}


def any_of(flags: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in flags.values():
        out = out | c
    return out


def qc_counts(df: DataFrame, qc: dict | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rejections per rule, in total, and rows before; one pass."""
    f = calibration_flags(df.columns, qc)
    return df.groupBy(*keys).agg(
        *[F.count_if(c).alias(n) for n, c in f.items()], F.count_if(any_of(f)).alias("any"), F.count(F.lit(1)).alias("n_before"))


def apply_calibration_qc(df: DataFrame, qc: dict | None = None, enabled: bool = True) -> DataFrame:
    return df.where(~any_of(calibration_flags(df.columns, qc))) if enabled else df


def removal_by_season(df: DataFrame, excluded: Sequence[str], qc: dict | None = None) -> DataFrame:
    """Share of traces each rule removes per season; a trace counts for its first rule only."""
    f = calibration_flags(df.columns, qc)
    share = {
        "seam": f["seam"], "img2": f["img2"] & ~f["seam"], "saturated": f["saturated"] & ~f["seam"] & ~f["img2"],
        "any": any_of(f), "seam_unmeasured": F.col("img_comb_offset_dB").isNull(),
        "margin_unmeasured": F.col("surface_ceiling_margin_dB").isNull(),
    }
    return df.groupBy("sheet", "collection").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in share.items()]
    ).withColumn("excluded", truth(F.col("collection").isin(list(excluded)))).orderBy("sheet", "collection")


def qc_sensitivity(df: DataFrame, sheets: Sequence[str], qc: dict | None = None) -> DataFrame:
    """Rejected percentage per sheet for every threshold variant, all variants in one scan."""
    aggs = [
        F.avg(any_of(calibration_flags(df.columns, {**(qc or {}), **over})).cast("double")).alias(f"v{i}")
        for i, over in enumerate(QC_VARIANTS.values())
    ]
    wide = df.groupBy("sheet").agg(*aggs)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("variant"), F.col(f"v{i}").alias("share")) for i, n in enumerate(QC_VARIANTS)])).alias("s")
    return wide.select("sheet", pairs).groupBy("s.variant").agg(*[
        F.bround(100 * F.max(F.when(F.col("sheet") == s, F.col("s.share"))), 1).alias(f"{s}_rejected_pct") for s in sheets])


def picked_rows(df: DataFrame, target: str) -> DataFrame:
    """Keep picked rows with a target and attempted rows without a pick; adds ``picked``."""
    picked = F.when(F.col("bed_pick_available").isNull(), F.col(target).isNotNull()).otherwise(F.col("bed_pick_available").cast("boolean"))
    attempted = truth(F.col("bed_pick_attempted"))
    return df.withColumn("picked", picked).where((F.col("picked") & F.col(target).isNotNull()) | (~F.col("picked") & attempted))


def censored(margin: Column, threshold: float) -> Column:
    return truth(margin < float(threshold))


def usable(target: str | None, features: Sequence[str], min_thickness_m: float | None, thickness: str) -> Column:
    """All features known, target known if named, and not known to be too thin."""
    c = F.lit(True)
    for f in features:
        c = c & F.col(f).isNotNull()
    if target:
        c = c & F.col(target).isNotNull()
    if min_thickness_m is not None:
        c = c & truth(F.col(thickness) >= float(min_thickness_m), missing=True)
    return c


def likelihood_nondetects(df: DataFrame, max_delta: float | None = 8.0) -> DataFrame:
    """Non-detections that enter the likelihood: known ceiling and, with the filter on, a small known delta."""
    keep = F.col("C_dB").isNotNull()
    if max_delta is not None:
        keep = keep & truth(F.col("nd_delta_dB") < float(max_delta))
    return df.where(keep)

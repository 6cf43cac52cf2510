"""Column contracts and the load-time rule "missing is NULL"."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

TARGET = "required_surface_snr_dB"
THICKNESS = "bedmachine_thickness_m"
FEATURES = [THICKNESS, "era5_t2m_mean_K", "surface_v_m_yr", "ghf_mW_m2"]

# Carried trace columns, sheet codes and projections.
CARRY_COLUMNS = [
    "frame_id", "slow_time", "latitude", "longitude", "elevation", "surface_elevation",
    "bed_elevation", "surface_power_dB", "bed_power_dB", "surface_twtt",
    "required_surface_snr_dB", "pre_surface_noise_dB", "post_bed_noise_dB",
    "post_bed_noise_interp_dB", "post_bed_peak_interp_dB", "bed_pick_available",
    "bed_pick_attempted", "qc_surface_pass", "qc_pass", "img_comb_offset_dB",
    "img_comb_pair", "surface_source_image_index", "surface_ceiling_margin_dB",
]
SHEET_CODE = {"antarctic": "ant", "greenland": "grl"}
SHEET_CRS = {"antarctic": "EPSG:3031", "greenland": "EPSG:3413"}


def missing_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column, in one projection."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name)
        for f in df.schema.fields
    ])


def with_absent(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add NULL columns for the names the table does not have."""
    have = set(df.columns)
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in have})

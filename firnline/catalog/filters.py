"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog.registry import query
from firnline.catalog.scans import rounded
from firnline.functions import radio
from firnline.operators import qc, raster
from firnline.plans import exponent, sites, split
from firnline.schema import FEATURES, TARGET, THICKNESS

SEAM = "coalesce(abs(img_comb_offset_dB) >= 3e0, false)"
IMG2 = "coalesce(surface_source_image_index >= 2, false)"
SAT = "coalesce(surface_ceiling_margin_dB < 2e0, false)"
EXCLUDED = ["2017_Antarctica_Basler", "2013_Greenland_P3"]


@query("b01_qc_passing", "SELECT trace_id FROM {traces_fx} WHERE qc_pass")
def b01(c):
    return qc.passing_traces(c("traces_fx")).select("trace_id")


@query("b02_with_nondetections", """
SELECT trace_id FROM {traces_fx} WHERE qc_pass OR (qc_surface_pass AND bed_pick_attempted AND NOT coalesce(bed_pick_available, false))
""")
def b02(c):
    return qc.passing_traces(c("traces_fx"), include_nondetections=True).select("trace_id")


@query("b03_min_thickness_traces", """
SELECT trace_id, surface_elevation - bed_elevation AS thickness FROM {traces_fx} WHERE coalesce(surface_elevation - bed_elevation >= 100e0, true)
""")
def b03(c):
    return qc.min_thickness(c("traces_fx"), 100.0).select("trace_id", (F.col("surface_elevation") - F.col("bed_elevation")).alias("thickness"))


@query("b04_min_thickness_grid", """
SELECT grid_id FROM {grid_fx} WHERE coalesce(bedmachine_thickness_m >= 100e0, true)
""")
def b04(c):
    return qc.min_thickness(c("grid_fx"), 100.0, F.col(THICKNESS)).select("grid_id")


@query("b05_exclude_seasons", """
SELECT grid_id, collection FROM {split_fx} WHERE collection IS NULL OR collection NOT IN ('2014_Antarctica_DC8', '2013_Greenland_P3')
""")
def b05(c):
    return qc.without_seasons(c("split_fx"), ["2014_Antarctica_DC8", "2013_Greenland_P3"]).select("grid_id", "collection")


@query("b06_calibration_flags", f"""
SELECT trace_id, {SEAM} AS seam, {IMG2} AS img2, {SAT} AS saturated, {SEAM} OR img_comb_offset_dB IS NULL AS seam_strict FROM {{traces_fx}}
""")
def b06(c):
    t = c("traces_fx")
    f = qc.calibration_flags(t.columns)
    strict = qc.calibration_flags(t.columns, {"drop_unmeasured_seam": True})["seam"]
    return t.select("trace_id", *[v.alias(k) for k, v in f.items()], strict.alias("seam_strict"))


@query("b07_apply_calibration_qc", f"SELECT trace_id FROM {{traces_fx}} WHERE NOT ({SEAM} OR {IMG2} OR {SAT})")
def b07(c):
    return qc.apply_calibration_qc(c("traces_fx")).select("trace_id")


@query("b08_picked_or_attempted", """
SELECT trace_id, picked FROM (SELECT *, coalesce(bed_pick_available, required_surface_snr_dB IS NOT NULL) AS picked FROM {traces_fx}) t
WHERE (picked AND required_surface_snr_dB IS NOT NULL) OR (NOT picked AND coalesce(bed_pick_attempted, false))
""")
def b08(c):
    return qc.picked_rows(c("traces_fx"), TARGET).select("trace_id", "picked")


@query("b09_usable_and_predictable", """
SELECT grid_id, u AND fold >= 0 AS is_train, u AND is_test AS is_held_out, p AS predictable FROM (
  SELECT *, required_surface_snr_dB IS NOT NULL AND p AS u FROM (
    SELECT *, bedmachine_thickness_m IS NOT NULL AND era5_t2m_mean_K IS NOT NULL AND surface_v_m_yr IS NOT NULL AND ghf_mW_m2 IS NOT NULL
      AND bedmachine_thickness_m >= 100e0 AS p FROM {split_fx}) a) b WHERE coalesce(p, false) OR required_surface_snr_dB IS NOT NULL
""")
def b09(c):
    s = c("split_fx")
    u, p = qc.usable(TARGET, FEATURES, 100.0, THICKNESS), qc.usable(None, FEATURES, 100.0, THICKNESS)
    return s.where(p | F.col(TARGET).isNotNull()).select(
        "grid_id", (u & (F.col("fold") >= 0)).alias("is_train"), (u & F.col("is_test")).alias("is_held_out"), p.alias("predictable"))


@query("b10_region_layers", """
SELECT m.raster_id, m.var, count(*) AS n_cells FROM {raster_meta_fx} m JOIN {raster_cells_fx} c ON m.raster_id = c.raster_id AND m.var = c.var
WHERE m.region IN ('global', 'greenland') GROUP BY m.raster_id, m.var
""")
def b10(c):
    m = raster.region_layers(c("raster_meta_fx"), "greenland").select("raster_id", "var")
    return c("raster_cells_fx").join(m, ["raster_id", "var"]).groupBy("raster_id", "var").agg(F.count(F.lit(1)).alias("n_cells"))


@query("b11_unknown_test_cells", """
SELECT cell_id FROM (VALUES ('ant:-48:-60'), ('ant:99:99'), ('grl:-48:-60'), ('grl:0:1')) AS r(cell_id) WHERE cell_id NOT IN (SELECT cell_id FROM {split_fx})
""")
def b11(c):
    wanted = ["ant:-48:-60", "ant:99:99", "grl:-48:-60", "grl:0:1"]
    missing = split.unknown_cells(c("split_fx").select("cell_id"), wanted)
    return c.spark.createDataFrame([(m,) for m in missing], "cell_id string")


@query("b12_censored_flag", "SELECT grid_id, coalesce(obs_margin_dB < 10e0, false) AS censored FROM {split_fx}")
def b12(c):
    return c("split_fx").select("grid_id", qc.censored(F.col("obs_margin_dB"), 10.0).alias("censored"))


@query("b13_likelihood_nondetects", """
SELECT grid_id, nd_delta_dB FROM {split_fx} WHERE is_nondetect AND C_dB IS NOT NULL AND nd_delta_dB IS NOT NULL AND nd_delta_dB < 8e0
""")
def b13(c):
    return qc.likelihood_nondetects(c("split_fx").where("is_nondetect")).select("grid_id", "nd_delta_dB")


@query("b14_nondetection_candidates", """
SELECT grid_id FROM {split_fx} WHERE is_nondetect AND bedmachine_thickness_m >= 100e0 AND surface_v_m_yr IS NOT NULL AND fold >= 0
""")
def b14(c):
    return c("split_fx").where(F.col("is_nondetect") & qc.usable(None, FEATURES, 100.0, THICKNESS) & (F.col("fold") >= 0)).select("grid_id")


@query("b15_high_margin_traces", """
SELECT trace_id, round(bed_power_dB - coalesce(post_bed_noise_interp_dB, post_bed_noise_dB), 6) AS margin FROM {traces_fx}
WHERE required_surface_snr_dB IS NOT NULL AND bed_power_dB - coalesce(post_bed_noise_interp_dB, post_bed_noise_dB) > 15e0
""")
def b15(c):
    return rounded(high_margin(c("traces_fx")).select("trace_id", "margin"))


def high_margin(t, limit=15.0):
    m = F.col("bed_power_dB") - radio.noise_reference(F.col("post_bed_noise_interp_dB"), F.col("post_bed_noise_dB"))
    return t.withColumn("margin", m).where(F.col(TARGET).isNotNull() & (F.col("margin") > limit))


def analysis_population(t):
    return t.where(qc.truth(F.col("qc_surface_pass")) & qc.truth(F.col("bed_pick_attempted")))


@query("b16_analysis_population", "SELECT trace_id FROM {traces_fx} WHERE qc_surface_pass AND bed_pick_attempted")
def b16(c):
    return analysis_population(c("traces_fx")).select("trace_id")


@query("b17_height_window", """
SELECT trace_id FROM {traces_fx} WHERE elevation - surface_elevation - 1000e0 BETWEEN 50e0 AND 15000e0 AND latitude IS NOT NULL AND longitude IS NOT NULL
""")
def b17(c):
    return sites.in_height_window(c("traces_fx").withColumn("surface_elevation", F.col("surface_elevation") + 1000.0)).select("trace_id")


PREPARED = """
v AS (SELECT s.*, regexp_replace(frame_id, '_[^_]*$', '') AS segment FROM {sites_fx} s WHERE surface_power_dB IS NOT NULL AND r_surf > 0 AND surface_gate_ok),
w AS (SELECT v.*, c.S_dB FROM v JOIN {clip_fx} c ON v.season = c.season AND v.segment = c.segment WHERE c.S_dB IS NOT NULL AND c.S_dB - surface_power_dB >= 4e0),
f AS (SELECT site_id, frame_id, median(r_surf) AS h FROM w GROUP BY site_id, frame_id),
o AS (SELECT site_id, list_sort(list(h)) AS hs, count(*) AS nf FROM f GROUP BY site_id),
lev AS (SELECT site_id, CASE WHEN nf < 2 THEN 0 ELSE list_reduce(list_transform(hs, lambda h: {{'n': 1, 'last': h}}),
   lambda a, b: CASE WHEN b.last - a.last >= 200e0 THEN {{'n': a.n + 1, 'last': b.last}} ELSE a END).n END AS n_lev FROM o)
"""


@query("b18_prepared_channel", f"""
WITH {PREPARED}
SELECT w.trace_id, w.site_id, round(log10(r_surf) - avg(log10(r_surf)) OVER (PARTITION BY w.site_id), 6) AS clogR,
  round(surface_power_dB - avg(surface_power_dB) OVER (PARTITION BY w.site_id), 6) AS cP
FROM w JOIN lev ON w.site_id = lev.site_id WHERE n_lev >= 2
""")
def b18(c):
    d = exponent.prepare(c("sites_fx"), "r_surf", "surface_power_dB", exponent.GATED, exponent.with_clip_levels(c("clip_fx"), 4.0))
    return rounded(d.select("trace_id", "site_id", "clogR", "cP"))


GATE_VALID = """
gv AS (SELECT t.trace_id, t.collection AS season, t.sheet, c.S_dB, c.S_dB - t.surface_power_dB AS headroom, t.surface_power_dB, t.surface_twtt
FROM (SELECT *, regexp_replace(frame_id, '_[^_]*$', '') AS segment FROM {traces_fx}) t
JOIN {windows_fx} w ON t.collection = w.season AND t.segment = w.segment
JOIN {clip_fx} c ON t.collection = c.season AND t.segment = c.segment
WHERE t.surface_power_dB IS NOT NULL AND t.surface_twtt >= greatest(w.lo_s, 2.5e-6) AND t.surface_twtt <= w.hi_s AND c.S_dB IS NOT NULL)
"""


def gate_valid(c):
    from firnline.functions import labels
    t = c("traces_fx").where("surface_power_dB is not null").select(
        "trace_id", F.col("collection").alias("season"), "sheet", "surface_twtt", "surface_power_dB", labels.segment(F.col("frame_id")).alias("segment"))
    t = t.join(c("windows_fx"), ["season", "segment"]).where(
        (F.col("surface_twtt") >= F.greatest("lo_s", F.lit(sites.NEAR_RANGE_S))) & (F.col("surface_twtt") <= F.col("hi_s")))
    t = t.join(c("clip_fx").where("S_dB is not null"), ["season", "segment"])
    return t.withColumn("headroom", F.col("S_dB") - F.col("surface_power_dB"))


@query("b19_gate_valid_surface", f"WITH {GATE_VALID} SELECT trace_id, season, S_dB, round(headroom, 6) AS headroom FROM gv")
def b19(c):
    return rounded(gate_valid(c).select("trace_id", "season", "S_dB", "headroom"))


FLAG_VALUES, FLAG_MEANINGS = [0, 1, 2, 3, 4, 5, 6], "none gimpdem mass_conservation synthetic interpolation hydrostatic kriging"


def flagged(cells, meaning, values=FLAG_VALUES, meanings=FLAG_MEANINGS):
    """Error cells whose source code carries a named flag (code found by name, as schemes differ)."""
    names = F.split(F.lit(meanings), " ")
    code = F.element_at(F.array(*[F.lit(v) for v in values]), F.array_position(names, meaning).cast("int")).cast("double")
    err = cells.where("raster_id = 'bed' and var = 'errbed' and value <> -9999").select("row", "col", F.col("value").alias("errbed"))
    src = cells.where("raster_id = 'bed' and var = 'source' and value <> -9999").where(F.col("value") == code).select("row", "col")
    return err.join(src, ["row", "col"])


@query("b20_flagged_error_cells", """
SELECT e.row, e.col, e.value AS errbed FROM {raster_cells_fx} e JOIN {raster_cells_fx} s ON e.row = s.row AND e.col = s.col
WHERE e.var = 'errbed' AND s.var = 'source' AND s.value = 2 AND e.value <> -9999
""")
def b20(c):
    return flagged(c("raster_cells_fx"), "mass_conservation").select("row", "col", "errbed")


@query("b21_exclusive_attribution", f"""
SELECT trace_id, CASE WHEN {SEAM} THEN 'seam' WHEN {IMG2} THEN 'img2' WHEN {SAT} THEN 'saturated' ELSE 'kept' END AS rule FROM {{traces_fx}}
""")
def b21(c):
    t = c("traces_fx")
    f = qc.calibration_flags(t.columns)
    return t.select("trace_id", F.when(f["seam"], "seam").when(f["img2"], "img2").when(f["saturated"], "saturated").otherwise("kept").alias("rule"))


@query("b22_truth_set", """
SELECT grid_id FROM {split_fx} WHERE required_surface_snr_dB IS NOT NULL AND surface_v_m_yr IS NOT NULL AND bedmachine_thickness_m >= 100e0
  AND fold >= 0 AND obs_margin_dB > 20e0
""")
def b22(c):
    return truth_set(c("split_fx")).select("grid_id")


def truth_set(s, margin=20.0):
    return s.where(qc.usable(TARGET, FEATURES, 100.0, THICKNESS) & (F.col("fold") >= 0) & qc.truth(F.col("obs_margin_dB") > margin))


PASSES = """
v AS (SELECT s.*, regexp_replace(frame_id, '_[^_]*$', '') AS segment FROM {sites_fx} s WHERE surface_power_dB IS NOT NULL AND surface_gate_ok),
p AS (SELECT site_id, sheet, v.season, frame_id, median(surface_power_dB) AS P, median(r_surf) AS R, min(c.S_dB) AS S
  FROM v JOIN {clip_fx} c ON v.season = c.season AND v.segment = c.segment WHERE c.S_dB IS NOT NULL GROUP BY site_id, sheet, v.season, frame_id),
pp AS (SELECT a.site_id, a.sheet, a.season, a.frame_id AS frame_low, b.frame_id AS frame_high, -(b.P - a.P) / (10 * log10(b.R / a.R)) AS x_pair,
  log10(b.R / a.R) AS dlogR, CASE WHEN a.P > b.P THEN a.S - a.P ELSE b.S - b.P END AS headroom_bright
  FROM p a JOIN p b ON a.site_id = b.site_id AND a.sheet = b.sheet AND a.season = b.season AND b.R - a.R >= 200e0)
"""


@query("b23_pass_gap_filter", f"WITH {PASSES} SELECT site_id, frame_low, frame_high FROM pp")
def b23(c):
    return exponent.pass_pairs(c("sites_fx"), c("clip_fx")).select("site_id", "frame_low", "frame_high")


@query("b24_valid_cells", """
SELECT g.grid_id FROM {grid_fx} g JOIN {predictions_fx} p ON g.grid_id = p.grid_id
WHERE p.pred_mean IS NOT NULL AND p.pred_std IS NOT NULL AND g.bedmachine_thickness_m IS NOT NULL AND g.bedmachine_mask > 0
""")
def b24(c):
    j = c("grid_fx").join(c("predictions_fx").select("grid_id", "pred_mean", "pred_std"), "grid_id")
    ok = F.col("pred_mean").isNotNull() & F.col("pred_std").isNotNull() & F.col(THICKNESS).isNotNull() & qc.truth(F.col("bedmachine_mask") > 0)
    return j.where(ok).select("grid_id")


def mask_row(c):
    return c("raster_meta_fx").where("raster_id = 'bed' and var = 'mask'").first().asDict()


@query("b25_strided_ice_points", f"""
WITH s AS (
  SELECT 'antarctic' AS ice_sheet, row, col, -1750000e0 + col * 2500e0 AS x, -620000e0 + row * 4000e0 AS y FROM {{raster_cells_fx}} WHERE raster_id = 'bed' AND var = 'mask' AND value IN (2, 3, 4)
  UNION ALL SELECT 'greenland', row, col, -500000e0 + col * 10000e0, -1450000e0 - row * 11500e0 FROM {{northern_cells_fx}} WHERE raster_id = 'bed_greenland' AND var = 'mask' AND value IN (2, 3, 4)
)
SELECT ice_sheet, CAST(floor(col / 3e0) AS INTEGER) AS grid_ix, CAST(floor(row / 3e0) AS INTEGER) AS grid_iy, x, y FROM s WHERE row % 3 = 0 AND col % 3 = 0
""")
def b25(c):
    out = None
    for sheet, meta, cells, raster_id in (("antarctic", "raster_meta_fx", "raster_cells_fx", "bed"), ("greenland", "northern_meta_fx", "northern_cells_fx", "bed_greenland")):
        row = c(meta).where((F.col("raster_id") == raster_id) & (F.col("var") == "mask")).first().asDict()
        pts = raster.strided_points(row, c(cells), 3, [2, 3, 4]).select(F.lit(sheet).alias("ice_sheet"), "grid_ix", "grid_iy", "x", "y")
        out = pts if out is None else out.unionByName(pts)
    return out


@query("b26_season_contains", "SELECT trace_id, collection FROM {traces_fx} WHERE contains(collection, 'DC8')")
def b26(c):
    return c("traces_fx").where(F.col("collection").contains("DC8")).select("trace_id", "collection")

"""Joins: raster lookups, near neighbours, dimension attachments, run-to-run comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog.filters import FLAG_MEANINGS, GATE_VALID, PASSES, high_margin  # noqa: F401
from firnline.catalog.registry import query
from firnline.catalog.scans import MEAN_FIELD, XY3031, rounded, sampled, sampled_on, sheet_positions
from firnline.session import new_path
from firnline.functions import geo, labels, parse, radio
from firnline.operators import near, qc, raster
from firnline.plans import exponent, lineage, linkbudget as lb, sites, split
from firnline.schema import SHEET_CODE, TARGET
from firnline.sources import covariates, stages


def layer(c, raster_id, *names):
    m = c("raster_meta_fx").where((F.col("raster_id") == raster_id) & F.col("var").isin(list(names)))
    v = c("raster_cells_fx").where((F.col("raster_id") == raster_id) & F.col("var").isin(list(names)))
    return m, v


def places(c):
    return c("traces_fx").select("trace_id", "longitude", "latitude")


@query("c01_bilinear_sample", f"""
WITH {XY3031}, {sampled('bed')}
SELECT t.trace_id, round(s.value, 5) AS value FROM {{traces_fx}} t LEFT JOIN s_bed s ON t.trace_id = s.trace_id
""")
def c01(c):
    m, v = layer(c, "bed", "bed")
    return rounded(raster.sample(places(c), m, v, point_id="trace_id").select("trace_id", "value"), 5)


NEAREST = """
n AS (SELECT trace_id, (px - x0) / dx AS fc, (py - y0) / dy AS fr, nx, ny FROM xy CROSS JOIN (SELECT * FROM {raster_meta_fx} WHERE var = 'mask') m)
"""


@query("c02_nearest_sample", f"""
WITH {XY3031}, {NEAREST}
SELECT n.trace_id, c.value FROM n LEFT JOIN {{raster_cells_fx}} c ON c.var = 'mask' AND fc >= 0 AND fc <= nx - 1 AND fr >= 0 AND fr <= ny - 1
  AND c.col = CAST(ceil(fc - 0.5e0) AS BIGINT) AND c.row = CAST(ceil(fr - 0.5e0) AS BIGINT)
""")
def c02(c):
    m, v = layer(c, "bed", "mask")
    return raster.sample(places(c), m, v, point_id="trace_id", method="nearest").select("trace_id", "value")


@query("c03_affine_pixel_sample", f"""
WITH {XY3031}, {NEAREST}, {sampled('v', 'pixel')}
SELECT n.trace_id, c.value AS mask_value, round(s.value, 6) AS v_value FROM n
LEFT JOIN {{raster_cells_fx}} c ON c.var = 'mask' AND c.col = CAST(round_even(fc, 0) AS BIGINT) AND c.row = CAST(round_even(fr, 0) AS BIGINT)
LEFT JOIN s_v s ON n.trace_id = s.trace_id
""")
def c03(c):
    meta = c("raster_meta_fx").where("raster_id = 'bed' and var = 'mask' or raster_id = 'velocity' and var = 'v'")
    layout = raster.grids(meta, raster.PIXEL)
    # A windowed read: tiles are kept as files once, and the points' own tiles are read back.
    path = new_path(c.spark, "tiles")
    raster.write_tiles(raster.tiles(c("raster_cells_fx"), layout), path)
    columns = {(g.name, layer.var): f"{layer.var}_value" for g in layout for layer in g.layers}
    return rounded(raster.at_points(places(c), lambda found: raster.read_tiles(c.spark, path, found), layout, columns, point_id="trace_id").select("trace_id", "mask_value", "v_value"))


PRODUCTS = ["bedmachine", "measures_vel", "itslive", "ghf", "era5"]
#: (name, positions, raster, layer, edge rule, nearest) of every layer that c04 looks up.
SOURCES = [
    ("bed_s", "at_antarctic", "bed", "bed", "centre", False), ("bed_n", "at_greenland", "bed_greenland", "bed", "centre", False),
    ("thick_s", "at_antarctic", "bed", "thickness", "centre", False), ("thick_n", "at_greenland", "bed_greenland", "thickness", "centre", False),
    ("mask_s", "at_antarctic", "bed", "mask", "centre", True), ("mask_n", "at_greenland", "bed_greenland", "mask", "centre", True),
    ("errbed_s", "at_antarctic", "bed", "errbed", "centre", False),
    ("vx", "at_antarctic", "vector_velocity", "vx", "centre", False), ("vy", "at_antarctic", "vector_velocity", "vy", "centre", False),
    ("ex", "at_antarctic", "vector_velocity", "errx", "centre", False), ("ey", "at_antarctic", "vector_velocity", "erry", "centre", False),
    ("v_n", "at_greenland", "velocity", "v", "pixel", False), ("ve_n", "at_greenland", "velocity", "v_error", "pixel", False),
    ("hf_s", "at_antarctic", "heat_flow", "HF", "centre", False), ("hf_n", "at_greenland", "heat_flow_greenland", "HF", "centre", False),
    ("hfmin", "at_antarctic", "heat_flow", "HFmin", "centre", False), ("hfmax", "at_antarctic", "heat_flow", "HFmax", "centre", False),
]
_S = "sqrt(vx.value * vx.value + vy.value * vy.value)"


@query("c04_all_covariates", f"""
WITH {MEAN_FIELD}, {sheet_positions('{places_fx}')}, {sampled_on('t2m', 'at_all', 'temperature', 't2m', meta='mean_meta', cells='mean_cells')},
{', '.join(sampled_on(*s[:4], edge=s[4], nearest=s[5]) for s in SOURCES)}
SELECT p.trace_id, round(coalesce(bed_s.value, bed_n.value), 5) AS bedmachine_bed_m, round(coalesce(thick_s.value, thick_n.value), 5) AS bedmachine_thickness_m,
  coalesce(mask_s.value, mask_n.value) AS bedmachine_mask, round(errbed_s.value, 5) AS bedmachine_errbed_m,
  round(coalesce({_S}, v_n.value), 5) AS surface_v_m_yr,
  round(coalesce(CASE WHEN {_S} > 0 THEN sqrt(pow(vx.value * ex.value, 2) + pow(vy.value * ey.value, 2)) / {_S} ELSE sqrt(pow(ex.value, 2) + pow(ey.value, 2)) END, ve_n.value), 5) AS surface_v_error_m_yr,
  round(coalesce(hf_s.value, hf_n.value) * 1000, 5) AS ghf_mW_m2, round(hfmin.value * 1000, 5) AS ghf_min_mW_m2, round(hfmax.value * 1000, 5) AS ghf_max_mW_m2,
  round(t2m.value + 1e-9, 6) AS era5_t2m_mean_K
FROM {{places_fx}} p LEFT JOIN t2m ON p.trace_id = t2m.trace_id {' '.join(f'LEFT JOIN {s[0]} ON p.trace_id = {s[0]}.trace_id' for s in SOURCES)}
""")
def c04(c):
    meta, cells = covariates.climatology_raster(c("climatology_fx"))
    meta = c("sheet_meta_fx").unionByName(meta)
    cells = c("sheet_cells_fx").unionByName(cells)
    out = covariates.attach_all(c("places_fx"), PRODUCTS, F.col("ice_sheet"), meta, cells, "trace_id")
    # Many places have short weights, so halves occur: a nudge sends them one way on both sides.
    out = out.withColumn("era5_t2m_mean_K", F.round(F.col("era5_t2m_mean_K") + 1e-9, 6))
    return rounded(out.drop("ice_sheet", "longitude", "latitude", "bedmachine_surface_m"), 5, keep=("era5_t2m_mean_K",))


def knn1(radius: float, extra: str = "") -> str:
    return f"""
nn AS (SELECT grid_id, trace_id, dist FROM (
  SELECT g.grid_id, t.trace_id, sqrt(pow(g.x - t.x, 2) + pow(g.y - t.y, 2)) AS dist,
    row_number() OVER (PARTITION BY g.grid_id ORDER BY pow(g.x - t.x, 2) + pow(g.y - t.y, 2), t.trace_id) AS rn
  FROM {{grid_fx}} g JOIN {{traces_fx}} t ON t.x BETWEEN g.x - {radius} AND g.x + {radius} AND t.y BETWEEN g.y - {radius} AND g.y + {radius}
    AND pow(g.x - t.x, 2) + pow(g.y - t.y, 2) < {radius * radius} {extra}) q WHERE rn = 1)
"""


@query("c05_nearest_observation", f"""
WITH {knn1(1000.0)} SELECT g.grid_id, nn.trace_id, round(nn.dist, 6) AS dist FROM {{grid_fx}} g LEFT JOIN nn ON g.grid_id = nn.grid_id
""")
def c05(c):
    m = near.nearest_within(c("grid_fx"), c("traces_fx"), 1000.0, left_id="grid_id", right_id="trace_id")
    return rounded(c("grid_fx").select("grid_id").join(m, "grid_id", "left").select("grid_id", "trace_id", "dist"))


@query("c06_nearest_value", f"""
WITH {knn1(700.0)} SELECT g.grid_id, t.bed_power_dB AS value, round(nn.dist, 6) AS dist
FROM {{grid_fx}} g LEFT JOIN nn ON g.grid_id = nn.grid_id LEFT JOIN {{traces_fx}} t ON nn.trace_id = t.trace_id
""")
def c06(c):
    t = c("traces_fx")
    m = near.nearest_within(c("grid_fx"), t, 700.0, left_id="grid_id", right_id="trace_id").join(
        t.select("trace_id", F.col("bed_power_dB").alias("value")), "trace_id")
    return rounded(c("grid_fx").select("grid_id").join(m, "grid_id", "left").select("grid_id", "value", "dist"))


OBS = """
obs AS (SELECT *, coalesce(post_bed_noise_interp_dB, post_bed_noise_dB) AS noise_ref FROM (
  SELECT *, coalesce(bed_pick_available, required_surface_snr_dB IS NOT NULL) AS picked FROM {traces_fx}
  WHERE collection NOT IN ('2017_Antarctica_Basler') AND NOT (coalesce(abs(img_comb_offset_dB) >= 3e0, false)
    OR coalesce(surface_source_image_index >= 2, false) OR coalesce(surface_ceiling_margin_dB < 2e0, false))) o
  WHERE (picked AND required_surface_snr_dB IS NOT NULL) OR (NOT picked AND coalesce(bed_pick_attempted, false))),
nn AS (SELECT grid_id, trace_id, dist FROM (
  SELECT g.grid_id, t.trace_id, sqrt(pow(g.x - t.x, 2) + pow(g.y - t.y, 2)) AS dist,
    row_number() OVER (PARTITION BY g.grid_id ORDER BY pow(g.x - t.x, 2) + pow(g.y - t.y, 2), t.trace_id) AS rn
  FROM {grid_fx} g JOIN obs t ON g.ice_sheet = t.ice_sheet AND t.x BETWEEN g.x - 1000e0 AND g.x + 1000e0 AND t.y BETWEEN g.y - 1000e0 AND g.y + 1000e0
    AND pow(g.x - t.x, 2) + pow(g.y - t.y, 2) < 1e6) q WHERE rn = 1),
sp AS (SELECT g.grid_id, g.ice_sheet, g.x, g.y, nn.dist AS obs_dist_m, CASE WHEN picked THEN o.required_surface_snr_dB END AS required_surface_snr_dB,
  CASE WHEN picked THEN o.bed_power_dB - noise_ref END AS obs_margin_dB, coalesce(NOT picked, false) AS is_nondetect,
  CASE WHEN NOT picked THEN o.post_bed_peak_interp_dB - o.post_bed_noise_interp_dB END AS nd_delta_dB,
  CASE WHEN picked THEN o.required_surface_snr_dB + o.bed_power_dB - noise_ref WHEN NOT picked THEN o.surface_power_dB - noise_ref
    + 20 * log10((299792458e0 * o.surface_twtt / 2) / (299792458e0 * o.surface_twtt / 2 + g.bedmachine_thickness_m / sqrt(3.17e0))) END AS C_dB,
  o.collection, CASE WHEN o.collection IS NULL THEN NULL WHEN o.collection LIKE '%\\_BaslerJKB' ESCAPE '\\' OR o.collection LIKE '%\\_BaslerMKB' ESCAPE '\\' THEN 'UTIG' ELSE 'CReSIS' END AS institution,
  concat(CASE WHEN g.ice_sheet = 'greenland' THEN 'grl' ELSE 'ant' END, ':', CAST(CAST(floor(g.x / 25000e0) AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor(g.y / 5000e0) AS BIGINT) AS VARCHAR)) AS cell_id
  FROM {grid_fx} g LEFT JOIN nn ON g.grid_id = nn.grid_id LEFT JOIN obs o ON nn.trace_id = o.trace_id)
"""


def matched(c):
    obs = split.observations(c("traces_fx"), exclude=["2017_Antarctica_Basler"], calibration={})
    return split.attach_target(c("grid_fx"), obs, cutoff_m=1000.0)


@query("c07_attach_nearest_attempted", f"""
WITH {OBS}
SELECT grid_id, round(obs_dist_m, 6) AS obs_dist_m, round(required_surface_snr_dB, 6) AS required_surface_snr_dB, round(obs_margin_dB, 6) AS obs_margin_dB,
  is_nondetect, round(nd_delta_dB, 6) AS nd_delta_dB, round(C_dB, 6) AS C_dB, collection, institution FROM sp
""")
def c07(c):
    return rounded(matched(c).select("grid_id", "obs_dist_m", TARGET, "obs_margin_dB", "is_nondetect", "nd_delta_dB", "C_dB", "collection", "institution"))


#: Held-out cells of the split stage, one of each sheet.
HELD_OUT = ["ant:-47:-12", "grl:-45:-12"]


@query("c26_split_stage", f"""
WITH {OBS},
t AS (SELECT *, cell IN {tuple(HELD_OUT)} AS is_test FROM (SELECT *, concat(CASE WHEN ice_sheet = 'greenland' THEN 'grl' ELSE 'ant' END, ':', CAST(CAST(floor(x / 25000e0) AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor(y / 25000e0) AS BIGINT) AS VARCHAR)) AS cell FROM sp) u),
n AS (SELECT cell, count(*) AS n_obs FROM t WHERE required_surface_snr_dB IS NOT NULL AND NOT is_test GROUP BY cell),
o AS (SELECT cell, sum(n_obs) OVER (ORDER BY md5(concat('42:', cell)), cell) - n_obs AS before, sum(n_obs) OVER () AS total FROM n)
SELECT t.grid_id, t.cell AS cell_id, t.is_test, CAST(CASE WHEN t.is_test THEN -1 ELSE coalesce(floor(before * 5e0 / total), -1) END AS INTEGER) AS fold,
  round(t.obs_dist_m, 6) AS obs_dist_m, round(t.required_surface_snr_dB, 6) AS required_surface_snr_dB, round(t.obs_margin_dB, 6) AS obs_margin_dB, t.is_nondetect, round(t.C_dB, 6) AS C_dB, t.institution
FROM t LEFT JOIN o ON t.cell = o.cell
""")
def c26(c):
    """The whole stage: observations, nearest one per point, cells, held-out cells, folds, written with its manifest and read back."""
    config = {"cutoff_m": 1000.0, "cell_size_m": 25_000.0, "n_folds": 5, "seed": 42}
    points = split.run_split(c("grid_fx"), c("traces_fx"), test_cells=HELD_OUT, exclude=["2017_Antarctica_Basler"], calibration={}, **config)
    path = stages.write_stage(points, lineage.manifest("split", config, ["snap-a", "snap-b"], test_cells=HELD_OUT), new_path(c.spark, "split"))
    return rounded(c.spark.read.parquet(path).select(
        "grid_id", "cell_id", "is_test", "fold", "obs_dist_m", TARGET, "obs_margin_dB", "is_nondetect", "C_dB", "institution"))


STRONG = """
hm AS (SELECT trace_id, collection, frame_id, x, y, required_surface_snr_dB AS v FROM {traces_fx}
  WHERE required_surface_snr_dB IS NOT NULL AND bed_power_dB - coalesce(post_bed_noise_interp_dB, post_bed_noise_dB) > 15e0)
"""


def cross_season(c):
    t = high_margin(c("traces_fx")).withColumn("season", F.col("collection"))
    m = near.nearest_within(
        t.withColumnsRenamed({"season": "season_a"}), t.withColumnsRenamed({"season": "season_b", "trace_id": "trace_b"}), 500.0,
        left_id="trace_id", right_id="trace_b", per=["season_b"], carry=["season_a"], keep=lambda: F.col("season_a") < F.col("season_b"))
    v = t.select("trace_id", F.col(TARGET).alias("va"))
    w = t.select(F.col("trace_id").alias("trace_b"), F.col(TARGET).alias("vb"))
    return m.join(v, "trace_id").join(w, "trace_b").withColumn("delta", F.col("va") - F.col("vb"))


CROSS = """
cross_pairs AS (SELECT * FROM (SELECT a.trace_id, b.trace_id AS trace_b, a.collection AS season_a, b.collection AS season_b, a.v - b.v AS delta,
    sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist,
    row_number() OVER (PARTITION BY a.trace_id, b.collection ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.trace_id) AS rn
  FROM hm a JOIN hm b ON a.collection < b.collection AND b.x BETWEEN a.x - 500 AND a.x + 500 AND b.y BETWEEN a.y - 500 AND a.y + 500
    AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 250000) q WHERE rn = 1)
"""


@query("c08_cross_season_crossovers", f"""
WITH {STRONG}, {CROSS} SELECT trace_id, season_a, season_b, trace_b, round(dist, 6) AS dist, round(delta, 6) AS delta FROM cross_pairs
""")
def c08(c):
    return rounded(cross_season(c).select("trace_id", "season_a", "season_b", "trace_b", "dist", "delta"))


def within_season(c):
    """Among the 8 nearest of the season (the trace itself counts) the first of another frame."""
    t = high_margin(c("traces_fx")).withColumn("season", F.col("collection"))
    m = near.nearest_within(t, t.withColumnRenamed("trace_id", "trace_b"), 500.0, k=8, on=["season"], left_id="trace_id", right_id="trace_b",
                            carry=["frame_id"])
    b = t.select(F.col("trace_id").alias("trace_b"), F.col("frame_id").alias("frame_b"), F.col(TARGET).alias("vb"))
    other = m.join(b, "trace_b").where(F.col("frame_b") != F.col("frame_id"))
    first = other.groupBy("trace_id").agg(F.min(F.struct("rank", "trace_b", "dist", "vb")).alias("f")).select("trace_id", "f.trace_b", "f.dist", "f.vb")
    a = t.select("trace_id", "season", F.col(TARGET).alias("va"))
    return first.join(a, "trace_id").withColumn("delta", F.col("va") - F.col("vb"))


SAME = """
same_pairs AS (SELECT trace_id, season, trace_b, dist, delta FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY rn) AS pick FROM (
  SELECT a.trace_id, a.collection AS season, a.frame_id AS fa, b.frame_id AS fb, b.trace_id AS trace_b, a.v - b.v AS delta, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist,
    row_number() OVER (PARTITION BY a.trace_id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.trace_id) AS rn
  FROM hm a JOIN hm b ON a.collection = b.collection AND b.x BETWEEN a.x - 500 AND a.x + 500 AND b.y BETWEEN a.y - 500 AND a.y + 500
    AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 250000) q WHERE rn <= 8 AND fb <> fa) r WHERE pick = 1)
"""


@query("c09_within_season_crossovers", f"""
WITH {STRONG}, {SAME} SELECT trace_id, season, trace_b, round(dist, 6) AS dist, round(delta, 6) AS delta FROM same_pairs
""")
def c09(c):
    return rounded(within_season(c).select("trace_id", "season", "trace_b", "dist", "delta"))


@query("c10_ball_neighbours", """
SELECT a.trace_id, a.collection, count(*) AS n_ball FROM {traces_fx} a JOIN {traces_fx} b ON a.collection = b.collection
  AND b.x BETWEEN a.x - 500 AND a.x + 500 AND b.y BETWEEN a.y - 500 AND a.y + 500 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 250000
GROUP BY a.trace_id, a.collection
""")
def c10(c):
    return near.ball_counts(c("traces_fx"), 500.0, id_col="trace_id", on=["collection"]).select("trace_id", "collection", "n_ball")


@query("c11_surface_gate", """
SELECT t.trace_id, coalesce(w.lo_s IS NOT NULL AND w.hi_s IS NOT NULL AND t.surface_twtt >= greatest(w.lo_s, 2.5e-6) AND t.surface_twtt <= w.hi_s, false) AS gate_ok,
  coalesce(t.surface_twtt <= 7.7e-6 OR (t.elevation - t.surface_elevation >= 3000e0 AND contains(t.collection, 'DC8') AND t.surface_twtt <= 72e-6), false) AS fallback_ok
FROM (SELECT *, regexp_replace(frame_id, '_[^_]*$', '') AS segment FROM {traces_fx}) t LEFT JOIN {windows_fx} w ON t.collection = w.season AND t.segment = w.segment
""")
def c11(c):
    t = c("traces_fx").withColumns({"season": F.col("collection"), "segment": labels.segment(F.col("frame_id")), **radio.heights()})
    j = t.join(c("windows_fx"), ["season", "segment"], "left")
    return j.select("trace_id", sites.surface_gate(F.col("season"), F.col("surface_twtt"), F.col("lo_s"), F.col("hi_s")).alias("gate_ok"),
                    sites.fallback_gate(F.col("season"), F.col("regime"), F.col("surface_twtt")).alias("fallback_ok"))


@query("c12_attach_clip_level", """
SELECT s.trace_id, c.S_dB FROM (SELECT *, regexp_replace(frame_id, '_[^_]*$', '') AS segment FROM {sites_fx}) s
LEFT JOIN {clip_fx} c ON s.season = c.season AND s.segment = c.segment
""")
def c12(c):
    s = c("sites_fx").withColumn("segment", labels.segment(F.col("frame_id")))
    return s.join(c("clip_fx"), ["season", "segment"], "left").select("trace_id", "S_dB")


FOLDS = "folds AS (SELECT DISTINCT cell_id, CAST(block % 5 AS INTEGER) AS cell_fold FROM {split_fx} WHERE block % 17 <> 3)"


@query("c13_fold_by_cell", f"""
WITH {FOLDS} SELECT s.grid_id, CAST(CASE WHEN s.is_test THEN -1 ELSE coalesce(f.cell_fold, -1) END AS INTEGER) AS fold
FROM {{split_fx}} s LEFT JOIN folds f ON s.cell_id = f.cell_id
""")
def c13(c):
    s = c("split_fx")
    folds = s.where("block % 17 <> 3").select("cell_id", (F.col("block") % 5).cast("int").alias("fold")).distinct()
    return split.attach_folds(s.drop("fold"), folds).select("grid_id", "fold")


@query("c14_predictions_on_grid", """
SELECT s.grid_id, p.pred_mean, p.pred_std FROM {split_fx} s LEFT JOIN {predictions_fx} p
  ON s.ice_sheet = p.ice_sheet AND s.grid_iy = p.grid_iy AND s.grid_ix = p.grid_ix
""")
def c14(c):
    p = c("predictions_fx").drop("grid_id")
    return c("split_fx").join(p, ["ice_sheet", "grid_iy", "grid_ix"], "left").select("grid_id", "pred_mean", "pred_std")


def unique_external(c):
    """External cells once each: means of the values, attributes of the first row."""
    return c("external_fx").groupBy("x", "y").agg(
        F.avg("snr_pred").alias("snr_pred"), F.avg("snr_pred_std").alias("snr_pred_std"), F.avg("snr").alias("snr"),
        F.min(F.struct("row_id", "mask", "v")).alias("_f")).select("x", "y", "snr_pred", "snr_pred_std", "snr", F.col("_f.mask").alias("mask"), F.col("_f.v").alias("v"))


EXT = """
ext AS (SELECT x, y, avg(snr_pred) AS snr_pred, avg(snr_pred_std) AS snr_pred_std, avg(snr) AS snr, arg_min(mask, row_id) AS mask,
  arg_min(struct_pack(v := v), row_id).v AS v FROM {external_fx} GROUP BY x, y)
"""
FOOT = """
foot AS (SELECT e.*, EXISTS (SELECT 1 FROM {predictions_fx} p WHERE p.pred_mean IS NOT NULL AND p.ice_sheet = 'antarctic'
  AND p.grid_ix = CAST(round_even((e.x + 1200000e0) / 2000e0, 0) AS BIGINT) AND p.grid_iy = CAST(round_even((e.y + 300000e0) / 260e0, 0) AS BIGINT)) AS inside FROM ext e)
"""


def footprint(c):
    ours = c("predictions_fx").where("pred_mean is not null and ice_sheet = 'antarctic'").select("grid_ix", "grid_iy").distinct().withColumn("_hit", F.lit(True))
    e = unique_external(c).withColumns({
        "grid_ix": F.rint((F.col("x") + 1200000.0) / 2000.0).cast("int"), "grid_iy": F.rint((F.col("y") + 300000.0) / 260.0).cast("int")})
    return e.join(ours, ["grid_ix", "grid_iy"], "left").withColumn("inside", F.coalesce("_hit", F.lit(False))).drop("_hit")


@query("c15_footprint_flag", f"WITH {EXT}, {FOOT} SELECT x, y, inside FROM foot")
def c15(c):
    return footprint(c).select("x", "y", "inside")


@query("c16_pass_pairs", f"""
WITH {PASSES} SELECT site_id, sheet, season, frame_low, frame_high, round(x_pair, 6) AS x_pair, round(dlogR, 6) AS dlogR, round(headroom_bright, 6) AS headroom_bright FROM pp
""")
def c16(c):
    return rounded(exponent.pass_pairs(c("sites_fx"), c("clip_fx")))


@query("c17_changed_targets", """
SELECT a.ice_sheet, count(*) AS n_changed FROM {split_fx} a JOIN {split_fx} b ON a.ice_sheet = b.ice_sheet AND a.grid_ix = b.grid_ix AND a.grid_iy = b.grid_iy
WHERE a.required_surface_snr_dB <> CASE WHEN b.grid_id % 10 = 3 THEN b.required_surface_snr_dB + 1e0 WHEN b.grid_id % 10 = 4 THEN NULL ELSE b.required_surface_snr_dB END
GROUP BY a.ice_sheet
""")
def c17(c):
    old = c("split_fx").select("ice_sheet", "grid_ix", "grid_iy", F.col(TARGET).alias("before"))
    new = c("split_fx").select("ice_sheet", "grid_ix", "grid_iy", F.when(F.col("grid_id") % 10 == 3, F.col(TARGET) + 1.0).when(
        F.col("grid_id") % 10 == 4, F.lit(None)).otherwise(F.col(TARGET)).alias("after"))
    return old.join(new, ["ice_sheet", "grid_ix", "grid_iy"]).where(F.col("before") != F.col("after")).groupBy("ice_sheet").agg(F.count(F.lit(1)).alias("n_changed"))


def shifts(c):
    a = c("predictions_fx").select("ice_sheet", "grid_iy", "grid_ix", F.col("pred_mean").alias("ma"), F.col("pred_std").alias("sa"))
    b = c("predictions_b_fx").select("ice_sheet", "grid_iy", "grid_ix", "grid_id", F.col("pred_mean").alias("mb"), F.col("pred_std").alias("sb"))
    return a.join(b, ["ice_sheet", "grid_iy", "grid_ix"]).withColumns({"shift": F.col("mb") - F.col("ma"), "std_ratio": F.col("sb") / F.col("sa")})


@query("c18_prediction_difference", """
SELECT b.grid_id, round(b.pred_mean - a.pred_mean, 6) AS shift, round(b.pred_std / a.pred_std, 6) AS std_ratio
FROM {predictions_fx} a JOIN {predictions_b_fx} b ON a.ice_sheet = b.ice_sheet AND a.grid_iy = b.grid_iy AND a.grid_ix = b.grid_ix
""")
def c18(c):
    return rounded(shifts(c).select("grid_id", "shift", "std_ratio"))


@query("c19_predictions_with_thickness", """
SELECT g.grid_id, g.bedmachine_thickness_m AS thk, g.bedmachine_mask AS mask, p.pred_mean FROM {grid_fx} g JOIN {predictions_fx} p
  ON g.ice_sheet = p.ice_sheet AND g.grid_iy = p.grid_iy AND g.grid_ix = p.grid_ix
""")
def c19(c):
    p = c("predictions_fx").select("ice_sheet", "grid_iy", "grid_ix", "pred_mean")
    return c("grid_fx").join(p, ["ice_sheet", "grid_iy", "grid_ix"]).select(
        "grid_id", F.col("bedmachine_thickness_m").alias("thk"), F.col("bedmachine_mask").alias("mask"), "pred_mean")


REGION = """CASE WHEN {s} = 'greenland' THEN CASE WHEN {lat} >= 72 THEN 'Northern Greenland' ELSE 'Southern Greenland' END
  WHEN {lat} > -75 AND {lon} BETWEEN -75 AND -55 THEN 'Antarctic peninsula' WHEN {lon} < -30 OR {lon} > 165 THEN 'West Antarctica' ELSE 'East Antarctica' END"""
CELL_REGION = "reg AS (SELECT cell_id, " + REGION.format(s="min(ice_sheet)", lat="avg(latitude)", lon="avg(longitude)") + " AS region FROM {split_fx} GROUP BY cell_id)"


def cell_regions(s):
    return s.groupBy("cell_id").agg(F.min("ice_sheet").alias("s"), F.avg("longitude").alias("lon"), F.avg("latitude").alias("lat")).select(
        "cell_id", labels.region(F.col("s"), F.col("lon"), F.col("lat")).alias("region"))


@query("c20_region_of_cell", f"WITH {CELL_REGION} SELECT s.grid_id, reg.region FROM {{split_fx}} s JOIN reg ON s.cell_id = reg.cell_id")
def c20(c):
    return c("split_fx").join(cell_regions(c("split_fx")), "cell_id").select("grid_id", "region")


@query("c21_image_pulse_length", """
SELECT row_id, CASE WHEN imgs IS NULL OR imgs IN ('{{}}') THEN tpd_wf1 WHEN imgs LIKE '%ones(1,6)%' THEN tpd_wf1
  WHEN imgs LIKE '%2*ones(3,1)%' THEN greatest(tpd_wf2, tpd_wf3) WHEN imgs LIKE '%[1 2; 3 4]%' THEN greatest(tpd_wf1, tpd_wf3) ELSE tpd_wf1 END AS tpd_img1_s
FROM {params_fx}
""")
def c21(c):
    p = c("params_fx").select("row_id", parse.first_image_waveforms(F.col("imgs")).alias("w"), "tpd_wf1", "tpd_wf2", "tpd_wf3")
    p = p.withColumn("w", F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(F.lit(1))))
    long = p.select("row_id", "w", F.explode(F.array(*[F.struct(F.lit(i).alias("wf"), F.col(f"tpd_wf{i}").alias("tpd")) for i in (1, 2, 3)])).alias("r"))
    return long.groupBy("row_id").agg(F.max(F.when(F.array_contains("w", F.col("r.wf")), F.col("r.tpd"))).alias("tpd_img1_s"))


SIDE = """
sl AS (SELECT win, i, j, tb, x, level FROM {sidelobe_fx}),
sl_cell AS (SELECT a.win, a.i, a.j, a.tb AS tb0, b.tb AS tb1, a.x AS x0, d.x AS x1, a.level AS l00, b.level AS l10, d.level AS l01, e.level AS l11
  FROM sl a JOIN sl b ON a.win = b.win AND b.i = a.i + 1 AND b.j = a.j JOIN sl d ON a.win = d.win AND d.i = a.i AND d.j = a.j + 1
  JOIN sl e ON a.win = e.win AND e.i = a.i + 1 AND e.j = a.j + 1),
cs AS (SELECT c.*, d.*, 2 * c.thickness_m * d.n_ice / 299792458e0 AS delay FROM {cells_fx} c CROSS JOIN {designs_fx} d),
lv AS (SELECT cs.grid_id, cs.scenario_id, (1 - fi) * (1 - fj) * l00 + fi * (1 - fj) * l10 + (1 - fi) * fj * l01 + fi * fj * l11 AS level FROM (
  SELECT cs.grid_id, cs.scenario_id, k.*, least(1e0, greatest(0e0, (ln(bandwidth_Hz * pulse_length_s) - ln(tb0)) / (ln(tb1) - ln(tb0)))) AS fi,
    least(1e0, greatest(0e0, (delay / pulse_length_s - x0) / (x1 - x0))) AS fj
  FROM cs JOIN sl_cell k ON k.win = CASE WHEN sidelobe_window = 'hann' THEN 'hann' ELSE 'rect' END
    AND k.i = (SELECT count(*) FROM (SELECT DISTINCT i, tb FROM sl) g WHERE g.i BETWEEN 1 AND 9 AND g.tb < bandwidth_Hz * pulse_length_s)
    AND k.j = (SELECT count(*) FROM (SELECT DISTINCT j, x FROM sl) g WHERE g.j BETWEEN 1 AND 12 AND g.x < delay / pulse_length_s)
  WHERE delay < pulse_length_s) cs),
bs AS (SELECT cs.grid_id, cs.ice_sheet, cs.mask, cs.sd_dB, cs.sd_q, cs.scenario_id, cs.overlap_mode, delay, pulse_length_s, noise_dBm, surface_snr_dB, pulse_compression_gain_dB AS gpc,
  CASE WHEN overlap_mode <> 'adaptive' AND delay < pulse_length_s THEN lv.level END AS level,
  20 * log10(altitude_m / (altitude_m + thickness_m / n_ice)) AS spread, bandwidth_Hz, mu_dB
  FROM cs LEFT JOIN lv ON cs.grid_id = lv.grid_id AND cs.scenario_id = lv.scenario_id),
snr AS (SELECT *, surface_snr_dB + spread + gain - mu_dB AS snr_dB FROM (SELECT *, CASE WHEN overlap_mode = 'adaptive' THEN 10 * log10(bandwidth_Hz * least(greatest(delay, 1 / bandwidth_Hz), pulse_length_s))
  WHEN level IS NOT NULL THEN gpc - 10 * log10(1 + pow(10e0, (surface_snr_dB + gpc + level) / 10)) ELSE gpc END AS gain FROM bs) q)
"""


def cell_snr(c):
    rows = lb.with_scenarios(c("cells_fx"), c("designs_fx"))
    return lb.with_basal_snr(rows, lb.SidelobeTable(c("sidelobe_fx")))


@query("c22_scenario_cells", """
SELECT grid_id, scenario_id, thickness_m, altitude_m FROM {cells_fx} CROSS JOIN {designs_fx}
""")
def c22(c):
    return lb.with_scenarios(c("cells_fx"), c("designs_fx")).select("grid_id", "scenario_id", "thickness_m", "altitude_m")


@query("c23_sidelobe_lookup", f"WITH {SIDE} SELECT grid_id, scenario_id, round(level, 6) AS sidelobe_dB FROM lv")
def c23(c):
    rows = lb.with_scenarios(c("cells_fx"), c("designs_fx")).withColumn("delay", 2 * F.col("thickness_m") * F.col("n_ice") / lb.LIGHT_M_S)
    table = lb.SidelobeTable(c("sidelobe_fx"))
    lev = table.attach(rows.where("delay < pulse_length_s"), F.col("sidelobe_window"), F.col("bandwidth_Hz") * F.col("pulse_length_s"),
                       F.col("delay") / F.col("pulse_length_s"), "sidelobe_dB")
    return rounded(lev.select("grid_id", "scenario_id", "sidelobe_dB"))


@query("c24_excluded_season_flag", """
SELECT trace_id, collection IN ('2017_Antarctica_Basler', '2013_Greenland_P3') AS excluded FROM {traces_fx}
""")
def c24(c):
    return c("traces_fx").select("trace_id", qc.truth(F.col("collection").isin("2017_Antarctica_Basler", "2013_Greenland_P3")).alias("excluded"))


@query("c25_safe_window_observations", """
SELECT t.trace_id, w.season, w.segment FROM (SELECT *, regexp_replace(frame_id, '_[^_]*$', '') AS segment FROM {traces_fx}) t
JOIN {windows_fx} w ON t.collection = w.season AND t.segment = w.segment WHERE t.surface_twtt BETWEEN w.lo_s AND w.hi_s
""")
def c25(c):
    t = c("traces_fx").select("trace_id", "surface_twtt", F.col("collection").alias("season"), labels.segment(F.col("frame_id")).alias("segment"))
    return t.join(c("windows_fx"), ["season", "segment"]).where(F.col("surface_twtt").between(F.col("lo_s"), F.col("hi_s"))).select("trace_id", "season", "segment")

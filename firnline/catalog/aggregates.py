"""Aggregations of the analysis jobs."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from firnline.catalog.filters import EXCLUDED, FLAG_MEANINGS, GATE_VALID, IMG2, PASSES, SAT, SEAM, analysis_population, gate_valid
from firnline.catalog.joins import CELL_REGION, CROSS, EXT, FOOT, SAME, SIDE, STRONG, cell_regions, cell_snr, cross_season, footprint, shifts, unique_external, within_season
from firnline.catalog.registry import query
from firnline.catalog.scans import rounded
from firnline.functions import geo, labels, radio
from firnline.functions.normal import hash_normal, hash_normal_sql
from firnline.operators import ordering as od, qc, stats
from firnline.operators.levels import site_levels
from firnline.plans import exponent, linkbudget as lb, split
from firnline.schema import TARGET, THICKNESS
from firnline.session import cut_lineage
from firnline.sources import covariates


def truth_rows(c):
    """Observed rows with both prediction runs beside them."""
    p = c("predictions_fx").select("grid_id", "pred_mean", "pred_std")
    q = c("predictions_b_fx").select("grid_id", F.col("pred_mean").alias("pred_mean_b"), F.col("pred_std").alias("pred_std_b"))
    return c("split_fx").join(p, "grid_id").join(q, "grid_id")


SCORED = """
sc AS (SELECT s.*, p.pred_mean, p.pred_std, q.pred_mean AS pred_mean_b, q.pred_std AS pred_std_b
FROM {split_fx} s JOIN {predictions_fx} p ON s.grid_id = p.grid_id JOIN {predictions_b_fx} q ON s.grid_id = q.grid_id)
"""


@query("d01_observations_per_cell", """
SELECT cell_id, count(*) AS n_obs FROM {split_fx} WHERE required_surface_snr_dB IS NOT NULL AND NOT is_test GROUP BY cell_id
""")
def d01(c):
    return split.cell_counts(c("split_fx"))


@query("d02_cells_summary", """
SELECT cell_id, min(ice_sheet) AS ice_sheet, CAST(split_part(cell_id, ':', 2) AS BIGINT) * 25000e0 AS x_min, CAST(split_part(cell_id, ':', 3) AS BIGINT) * 25000e0 AS y_min,
  count(*) AS n_grid_points, count(required_surface_snr_dB) AS n_obs, CAST(min(fold) AS INTEGER) AS fold, bool_and(is_test) AS is_test FROM {split_fx} GROUP BY cell_id ORDER BY cell_id
""")
def d02(c):
    return split.cells_summary(c("split_fx"), 25000.0).select("cell_id", "ice_sheet", "x_min", "y_min", "n_grid_points", "n_obs", "fold", "is_test")


@query("d03_fold_sizes", """
WITH p AS (SELECT CASE WHEN is_test THEN 'test' WHEN fold >= 0 THEN CAST(fold AS VARCHAR) ELSE 'none' END AS part, count(*) AS n
  FROM {split_fx} WHERE required_surface_snr_dB IS NOT NULL GROUP BY 1)
SELECT part, n, CAST((SELECT sum(n) FROM p WHERE part NOT IN ('test', 'none')) AS BIGINT) AS n_train, CAST((SELECT sum(n) FROM p WHERE part = 'test') AS BIGINT) AS n_test FROM p
""")
def d03(c):
    return split.fold_sizes(c("split_fx"))


@query("d04_qc_counts", f"""
SELECT sheet, count(*) FILTER ({SEAM}) AS seam, count(*) FILTER ({IMG2}) AS img2, count(*) FILTER ({SAT}) AS saturated,
  count(*) FILTER ({SEAM} OR {IMG2} OR {SAT}) AS "any", count(*) AS n_before FROM {{traces_fx}} GROUP BY sheet
""")
def d04(c):
    return qc.qc_counts(c("traces_fx"), keys=["sheet"])


@query("d05_prediction_scores", f"""
WITH {SCORED} SELECT ice_sheet, round(sqrt(avg(pow(required_surface_snr_dB - pred_mean, 2))), 6) AS rmse_dB, round(avg(abs(required_surface_snr_dB - pred_mean)), 6) AS mae_dB,
  round(avg(CASE WHEN abs(required_surface_snr_dB - pred_mean) <= pred_std THEN 1e0 ELSE 0e0 END), 6) AS coverage_1sigma, count(required_surface_snr_dB - pred_mean) AS n_points
FROM sc WHERE required_surface_snr_dB IS NOT NULL AND pred_mean IS NOT NULL GROUP BY ice_sheet
""")
def d05(c):
    s = truth_rows(c).where(F.col(TARGET).isNotNull() & F.col("pred_mean").isNotNull())
    return rounded(s.groupBy("ice_sheet").agg(*[v.alias(k) for k, v in stats.score(F.col(TARGET), F.col("pred_mean"), F.col("pred_std")).items()]))


PER_FOLD = """
pf AS (SELECT fold, sqrt(avg(pow(required_surface_snr_dB - pred_mean, 2))) AS rmse_dB, avg(abs(required_surface_snr_dB - pred_mean)) AS mae_dB, count(*) AS n_points
  FROM sc WHERE required_surface_snr_dB IS NOT NULL AND pred_mean IS NOT NULL AND fold >= 0 GROUP BY fold)
"""


@query("d06_pooled_cv", f"""
WITH {SCORED}, {PER_FOLD} SELECT round(sum(rmse_dB * n_points) / sum(n_points), 6) AS rmse_dB_mean, round(min(rmse_dB), 6) AS rmse_dB_min, round(max(rmse_dB), 6) AS rmse_dB_max,
  round(sum(mae_dB * n_points) / sum(n_points), 6) AS mae_dB_mean, round(min(mae_dB), 6) AS mae_dB_min, round(max(mae_dB), 6) AS mae_dB_max, CAST(sum(n_points) AS BIGINT) AS n_points FROM pf
""")
def d06(c):
    s = truth_rows(c).where(F.col(TARGET).isNotNull() & F.col("pred_mean").isNotNull() & (F.col("fold") >= 0))
    pf = s.groupBy("fold").agg(*[v.alias(k) for k, v in stats.score(F.col(TARGET), F.col("pred_mean"), F.col("pred_std")).items()])
    aggs = {**stats.pooled("rmse_dB", "n_points"), **stats.pooled("mae_dB", "n_points")}
    return rounded(pf.agg(*[v.alias(k) for k, v in aggs.items()], F.sum("n_points").alias("n_points")))


@query("d07_train_normalizer", """
SELECT f.fit_id, round(avg(bedmachine_thickness_m), 5) AS bedmachine_thickness_m__mean, round(stddev_pop(bedmachine_thickness_m), 5) AS bedmachine_thickness_m__sd,
  round(avg(bedmachine_mask * 0 + 3), 5) AS flat__mean, 1e0 AS flat__sd
FROM {split_fx} s JOIN (VALUES (0), (1), (2), (3), (4), (-1)) AS f(fit_id) ON s.fold <> f.fit_id
WHERE s.fold >= 0 AND required_surface_snr_dB IS NOT NULL GROUP BY f.fit_id
""")
def d07(c):
    s = c("split_fx").where((F.col("fold") >= 0) & F.col(TARGET).isNotNull()).withColumn("flat", F.col("bedmachine_mask") * 0 + 3)
    s = s.select("fold", THICKNESS, "flat", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2, 3, 4, -1)])).alias("fit_id")).where("fold <> fit_id")
    return rounded(stats.normalizer(s, [THICKNESS, "flat"], ["fit_id"]), 5)


@query("d10_climatology_mean", """
SELECT longitude, latitude, round(avg(t2m), 6) AS t2m FROM {climatology_fx} GROUP BY longitude, latitude
""")
def d10(c):
    return rounded(covariates.mean_field(c("climatology_fx")))


@query("d11_qc_removal_by_season", f"""
SELECT sheet, collection, count(*) AS n, round(avg(CASE WHEN {SEAM} THEN 1e0 ELSE 0e0 END), 6) AS seam,
  round(avg(CASE WHEN {IMG2} AND NOT {SEAM} THEN 1e0 ELSE 0e0 END), 6) AS img2, round(avg(CASE WHEN {SAT} AND NOT {SEAM} AND NOT {IMG2} THEN 1e0 ELSE 0e0 END), 6) AS saturated,
  round(avg(CASE WHEN {SEAM} OR {IMG2} OR {SAT} THEN 1e0 ELSE 0e0 END), 6) AS "any", round(avg(CASE WHEN img_comb_offset_dB IS NULL THEN 1e0 ELSE 0e0 END), 6) AS seam_unmeasured,
  round(avg(CASE WHEN surface_ceiling_margin_dB IS NULL THEN 1e0 ELSE 0e0 END), 6) AS margin_unmeasured, collection = '2017_Antarctica_Basler' AS excluded
FROM {{traces_fx}} GROUP BY sheet, collection ORDER BY sheet, collection
""")
def d11(c):
    return rounded(qc.removal_by_season(c("traces_fx"), EXCLUDED))


def _variant(name: str, seam="3e0", sat="2e0", img=True, strict=False) -> str:
    s = f"(coalesce(abs(img_comb_offset_dB) >= {seam}, false)" + (" OR img_comb_offset_dB IS NULL)" if strict else ")")
    i = IMG2 if img else "false"
    a = f"coalesce(surface_ceiling_margin_dB < {sat}, false)"
    cols = ", ".join(
        f"round_even(100 * avg(CASE WHEN {s} OR {i} OR {a} THEN 1e0 ELSE 0e0 END) FILTER (sheet = '{sh}'), 1) AS {sh}_rejected_pct" for sh in ("antarctic", "greenland"))
    return f"SELECT '{name}' AS variant, {cols} FROM {{traces_fx}}"


@query("d12_qc_sensitivity", " UNION ALL ".join([
    _variant("adopted"), _variant("max_seam_offset_dB=2.0", seam="2e0"), _variant("max_seam_offset_dB=5.0", seam="5e0"),
    _variant("min_ceiling_margin_dB=1.0", sat="1e0"), _variant("min_ceiling_margin_dB=3.0", sat="3e0"),
    _variant("require_img1_surface=false", img=False), _variant("drop_unmeasured_seam=true", strict=True)]))
def d12(c):
    return qc.qc_sensitivity(c("traces_fx"), ["antarctic", "greenland"])


MIN_PAIRS = 30


@query("d13_crossover_matrix", f"""
WITH {STRONG}, {CROSS}, {SAME},
allp AS (SELECT season_a, season_b, delta FROM cross_pairs UNION ALL SELECT season, season, delta FROM same_pairs),
g AS (SELECT season_a, season_b, median(delta) AS m, stddev_pop(delta) AS s, count(*) AS n FROM allp GROUP BY season_a, season_b),
h AS (SELECT season_a AS row_season, season_b AS col_season, CASE WHEN n >= {MIN_PAIRS} THEN m END AS m, CASE WHEN n >= {MIN_PAIRS} THEN s END AS s, n FROM g)
SELECT row_season, col_season, round(m, 6) AS median_dB, round(s, 6) AS sd_dB, n AS n_pairs FROM h
UNION ALL SELECT col_season, row_season, round(-m, 6), round(s, 6), n FROM h WHERE row_season <> col_season
""")
def d13(c):
    pairs = cross_season(c).select("season_a", "season_b", "delta").unionByName(
        within_season(c).select(F.col("season").alias("season_a"), F.col("season").alias("season_b"), "delta"))
    keys = ["season_a", "season_b"]
    half = od.exact_quantiles(cut_lineage(pairs), keys, "delta", {"med": 0.5}, extra={"sd": F.stddev_pop("delta")}).withColumnRenamed("n_values", "n_pairs")
    enough = F.col("n_pairs") >= MIN_PAIRS
    half = half.select("season_a", "season_b", F.when(enough, F.col("med")).alias("med"), F.when(enough, F.col("sd")).alias("sd"), "n_pairs")
    # Both triangles come out of one row each, so the pairs are matched once.
    sides = F.when(F.col("season_a") == F.col("season_b"), F.array(F.struct(F.col("season_a").alias("r"), F.col("season_b").alias("q"), F.col("med").alias("m")))).otherwise(
        F.array(F.struct(F.col("season_a").alias("r"), F.col("season_b").alias("q"), F.col("med").alias("m")),
                F.struct(F.col("season_b").alias("r"), F.col("season_a").alias("q"), (-F.col("med")).alias("m"))))
    return rounded(half.select(F.explode(sides).alias("e"), "sd", "n_pairs").select(
        F.col("e.r").alias("row_season"), F.col("e.q").alias("col_season"), F.col("e.m").alias("median_dB"), F.col("sd").alias("sd_dB"), "n_pairs"))


@query("d14_margin_quantiles", """
SELECT sheet, count(*) AS n, round(quantile_cont(m, 0.01), 6) AS q01, round(quantile_cont(m, 0.05), 6) AS q05, round(quantile_cont(m, 0.25), 6) AS q25, round(median(m), 6) AS q50,
  round(avg(CASE WHEN m < 3 THEN 1e0 ELSE 0e0 END), 6) AS lt3, round(avg(CASE WHEN m < 5 THEN 1e0 ELSE 0e0 END), 6) AS lt5, round(avg(CASE WHEN m < 10 THEN 1e0 ELSE 0e0 END), 6) AS lt10
FROM (SELECT sheet, bed_power_dB - post_bed_noise_dB AS m FROM {traces_fx} WHERE required_surface_snr_dB IS NOT NULL AND bed_power_dB IS NOT NULL) t GROUP BY sheet
""")
def d14(c):
    t = c("traces_fx").where(F.col(TARGET).isNotNull()).select("sheet", (F.col("bed_power_dB") - F.col("post_bed_noise_dB")).alias("m")).where("m is not null")
    low = {f"lt{v}": F.avg((F.col("m") < v).cast("double")) for v in (3, 5, 10)}
    q = od.exact_quantiles(t, ["sheet"], "m", {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5}, extra=low)
    return rounded(q.withColumnRenamed("n_values", "n"))


@query("d15_binned_median", """
SELECT sheet, CAST(floor((m + 2) / 2) AS INTEGER) AS bin, round(median(v), 6) AS median_target, count(*) AS n FROM (
  SELECT sheet, bed_power_dB - post_bed_noise_dB AS m, required_surface_snr_dB AS v FROM {traces_fx}) t WHERE v IS NOT NULL AND m >= -2 AND m < 48 GROUP BY 1, 2
""")
def d15(c):
    t = c("traces_fx").withColumn("bin", stats.bin_of(F.col("bed_power_dB") - F.col("post_bed_noise_dB"), -2.0, 2.0, 25)).where("bin is not null")
    return rounded(od.exact_median(t, ["sheet", "bin"], TARGET, "median_target").withColumnRenamed("n_values", "n"))


@query("d16_detection_curve", """
SELECT collection, CAST(floor((m + 5) / 2) AS INTEGER) AS bin, count(*) AS n, round(CASE WHEN count(*) >= 15 THEN avg(CASE WHEN coalesce(bed_pick_available, false) THEN 1e0 ELSE 0e0 END) END, 6) AS fraction
FROM (SELECT collection, bed_pick_available, bed_power_dB - post_bed_noise_dB AS m FROM {traces_fx} WHERE qc_surface_pass AND bed_pick_attempted) t
WHERE m >= -5 AND m < 43 GROUP BY 1, 2
""")
def d16(c):
    t = analysis_population(c("traces_fx")).withColumn("m", F.col("bed_power_dB") - F.col("post_bed_noise_dB"))
    return rounded(stats.detection_curve(t, ["collection"], "m", qc.truth(F.col("bed_pick_available")), -5.0, 2.0, 24, 15))


@query("d17_offset_summary", """
SELECT coalesce(collection, 'ALL') AS season, round(quantile_cont(d, 0.25), 6) AS q25, round(median(d), 6) AS med, round(quantile_cont(d, 0.75), 6) AS q75, count(*) AS n
FROM (SELECT collection, post_bed_noise_interp_dB - post_bed_noise_dB AS d FROM {traces_fx} WHERE bed_pick_available) t WHERE d IS NOT NULL GROUP BY ROLLUP (collection)
""")
def d17(c):
    t = c("traces_fx").where(qc.truth(F.col("bed_pick_available"))).select(
        F.explode(F.array("collection", F.lit("ALL"))).alias("season"), (F.col("post_bed_noise_interp_dB") - F.col("post_bed_noise_dB")).alias("d"))
    return rounded(od.exact_quantiles(t, ["season"], "d", {"q25": 0.25, "med": 0.5, "q75": 0.75}).withColumnRenamed("n_values", "n"))


def with_headroom(c):
    return c("traces_fx").withColumn("headroom_us", (F.col("record_end_twtt") - F.col("bed_twtt")) * 1e6).where("headroom_us is not null")


@query("d18_record_headroom", """
SELECT collection, round(median(h), 5) AS med, round(quantile_cont(h, 0.05), 5) AS q05, round(min(h), 5) AS lowest, round(avg(CASE WHEN h < 5 THEN 1e0 ELSE 0e0 END), 6) AS lt5, round(avg(CASE WHEN h < 10 THEN 1e0 ELSE 0e0 END), 6) AS lt10
FROM (SELECT collection, (record_end_twtt - bed_twtt) * 1e6 AS h FROM {traces_fx}) t WHERE h IS NOT NULL GROUP BY collection
""")
def d18(c):
    t = with_headroom(c)
    more = {"lowest": F.min("headroom_us"), **{f"lt{v}": F.avg((F.col("headroom_us") < v).cast("double")) for v in (5, 10)}}
    j = od.exact_quantiles(t, ["collection"], "headroom_us", {"med": 0.5, "q05": 0.05}, extra=more)
    return j.select("collection", *[F.round(k, 5).alias(k) for k in ("med", "q05", "lowest")], F.round("lt5", 6).alias("lt5"), F.round("lt10", 6).alias("lt10"))


@query("d19_baseline_relative_noise", """
WITH h AS (SELECT collection, record_tail_noise_dB AS v, (record_end_twtt - bed_twtt) * 1e6 + 1e-7 AS h FROM {traces_fx} WHERE bed_twtt IS NOT NULL),
r AS (SELECT collection, median(v) AS ref FROM h WHERE h > 15 GROUP BY collection)
SELECT h.collection, CAST(floor(h.h / 2) AS INTEGER) AS bin, count(*) AS n, round(CASE WHEN count(*) >= 25 THEN median(v) - min(ref) END, 6) AS rel
FROM h JOIN r ON h.collection = r.collection WHERE h.h >= 0 AND h.h < 40 GROUP BY 1, 2
""")
def d19(c):
    t = with_headroom(c).withColumn("h", F.col("headroom_us") + 1e-7)
    ref = od.exact_median(t.where("h > 15"), ["collection"], "record_tail_noise_dB", "ref").drop("n_values")
    b = t.withColumn("bin", stats.bin_of(F.col("h"), 0.0, 2.0, 20)).where("bin is not null")
    med = od.exact_median(b, ["collection", "bin"], "record_tail_noise_dB", "med").withColumnRenamed("n_values", "n")
    return rounded(med.join(ref, "collection").select("collection", "bin", "n", F.when(F.col("n") >= 25, F.col("med") - F.col("ref")).alias("rel")))


@query("d20_clip_headroom_report", f"""
WITH {GATE_VALID} SELECT season, count(*) AS n, round(quantile_cont(headroom, 0.001), 5) AS edge_p01, round(quantile_cont(headroom, 0.01), 5) AS p1, round(median(headroom), 5) AS med,
  round(100 * avg(CASE WHEN headroom < 3 THEN 1e0 ELSE 0e0 END), 4) AS within3, round(100 * avg(CASE WHEN headroom < 6 THEN 1e0 ELSE 0e0 END), 4) AS within6,
  round(100 * avg(CASE WHEN headroom < 10 THEN 1e0 ELSE 0e0 END), 4) AS within10 FROM gv GROUP BY season ORDER BY edge_p01
""")
def d20(c):
    g = gate_valid(c)
    more = {f"within{v}": 100 * F.avg((F.col("headroom") < v).cast("double")) for v in (3, 6, 10)}
    q = od.exact_quantiles(g, ["season"], "headroom", {"edge_p01": 0.001, "p1": 0.01, "med": 0.5}, extra=more).withColumnRenamed("n_values", "n")
    return q.select("season", "n", *[F.round(k, 5).alias(k) for k in ("edge_p01", "p1", "med")],
                                      *[F.round(f"within{v}", 4).alias(f"within{v}") for v in (3, 6, 10)]).orderBy("edge_p01")


HEAD_EDGES = [-3, 0, 3, 6, 10, 15, 20, 30, 60]


@query("d21_knee_table", f"""
WITH {PASSES}, e AS (SELECT * FROM (VALUES (0, -3, 0), (1, 0, 3), (2, 3, 6), (3, 6, 10), (4, 10, 15), (5, 15, 20), (6, 20, 30), (7, 30, 60)) AS e(bin, lo, hi)),
l AS (SELECT 'all' AS label, * FROM pp UNION ALL SELECT sheet, * FROM pp UNION ALL SELECT 'dc8', * FROM pp WHERE contains(season, 'DC8'))
SELECT label, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(median(x_pair), 6) AS med, round(quantile_cont(x_pair, 0.25), 6) AS q25, round(quantile_cont(x_pair, 0.75), 6) AS q75
FROM l JOIN e ON round(headroom_bright, 6) > lo AND round(headroom_bright, 6) <= hi GROUP BY label, bin
""")
def d21(c):
    p = exponent.pass_pairs(c("sites_fx"), c("clip_fx"))
    which = F.when(F.col("season").contains("DC8"), F.array(F.lit("all"), F.col("sheet"), F.lit("dc8"))).otherwise(F.array(F.lit("all"), F.col("sheet")))
    p = p.select(F.explode(which).alias("label"), "x_pair", stats.edge_bin(F.round("headroom_bright", 6), HEAD_EDGES).alias("bin")).where("bin is not null")
    return rounded(od.exact_quantiles(p, ["label", "bin"], "x_pair", {"med": 0.5, "q25": 0.25, "q75": 0.75}).withColumnRenamed("n_values", "n"))


@query("d22_empirical_cdf", f"""
WITH {SCORED} SELECT ice_sheet, required_surface_snr_dB AS value, round(CAST(row_number() OVER (PARTITION BY ice_sheet ORDER BY required_surface_snr_dB) AS DOUBLE) / count(*) OVER (PARTITION BY ice_sheet), 9) AS fraction
FROM sc WHERE required_surface_snr_dB IS NOT NULL
""")
def d22(c):
    r = od.with_rank(c("split_fx").select("grid_id", "ice_sheet", TARGET), ["ice_sheet"], TARGET, "grid_id")
    return r.select("ice_sheet", F.col(TARGET).alias("value"), F.round(F.col("rank") / F.col("n_total"), 9).alias("fraction"))


def _summary_sql(source: str, table: str, col: str, where: str = "true") -> str:
    cls = "CASE WHEN mask = 3 THEN 'Ice shelf' WHEN v > 50 THEN 'Fast-moving ice' ELSE 'Slow-moving ice' END"
    return f"""SELECT '{source}' AS source, coalesce(cls, 'All Antarctica') AS class, count(*) AS n, round(quantile_cont(val, 0.1), 6) AS p10, round(quantile_cont(val, 0.25), 6) AS p25,
  round(median(val), 6) AS p50, round(quantile_cont(val, 0.75), 6) AS p75, round(quantile_cont(val, 0.9), 6) AS p90,
  round(avg(CASE WHEN val <= 40 THEN 1e0 ELSE 0e0 END), 6) AS le40, round(avg(CASE WHEN val <= 60 THEN 1e0 ELSE 0e0 END), 6) AS le60,
  round(avg(CASE WHEN val <= 80 THEN 1e0 ELSE 0e0 END), 6) AS le80, round(avg(CASE WHEN val <= 100 THEN 1e0 ELSE 0e0 END), 6) AS le100
  FROM (SELECT {cls} AS cls, {col} AS val FROM {table} WHERE {where}) q WHERE val IS NOT NULL GROUP BY ROLLUP (cls)"""


OURS = "ours AS (SELECT bedmachine_mask AS mask, surface_v_m_yr AS v, pred_mean, required_surface_snr_dB, latitude FROM sc WHERE ice_sheet = 'antarctic')"


@query("d23_distribution_summary", f"WITH {SCORED}, {OURS}, {EXT}, {FOOT} " + " UNION ALL ".join([
    _summary_sql("ours_prediction", "ours", "pred_mean"), _summary_sql("ours_observations", "ours", "required_surface_snr_dB"),
    _summary_sql("external_prediction", "foot", "snr_pred"), _summary_sql("external_prediction_footprint", "foot", "snr_pred", "inside"),
    _summary_sql("external_training", "foot", "snr")]))
def d23(c):
    ours = truth_rows(c).where("ice_sheet = 'antarctic'").withColumn("cls", labels.ice_class(F.col("bedmachine_mask"), F.col("surface_v_m_yr")))
    ext = footprint(c).withColumn("cls", labels.ice_class(F.col("mask"), F.col("v")))

    def entries(*pairs):
        return F.explode(F.array(*[F.struct(F.lit(n).alias("source"), v.alias("val")) for n, v in pairs])).alias("e")

    a = ours.select("cls", entries(("ours_prediction", F.col("pred_mean")), ("ours_observations", F.col(TARGET))))
    b = ext.select("cls", entries(("external_prediction", F.col("snr_pred")), ("external_training", F.col("snr")),
                                  ("external_prediction_footprint", F.when(F.col("inside"), F.col("snr_pred")))))
    rows = a.unionByName(b).select("e.*", F.explode(F.array("cls", F.lit("All Antarctica"))).alias("class")).where("val is not null")
    keys = ["source", "class"]
    low = {f"le{v}": F.avg((F.col("val") <= v).cast("double")) for v in (40, 60, 80, 100)}
    q = od.exact_quantiles(rows, keys, "val", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}, extra=low)
    return rounded(q.withColumnRenamed("n_values", "n"))


@query("d24_unique_external_cells", f"WITH {EXT} SELECT x, y, round(snr_pred, 6) AS snr_pred, round(snr_pred_std, 6) AS snr_pred_std, round(snr, 6) AS snr, mask, v FROM ext")
def d24(c):
    return rounded(unique_external(c))


@query("d25_speed_threshold_sweep", f"""
WITH {SCORED} SELECT thr, CASE WHEN bedmachine_mask = 3 THEN 'Ice shelf' WHEN surface_v_m_yr > thr THEN 'Fast-moving ice' ELSE 'Slow-moving ice' END AS class, round(median(pred_mean), 6) AS med
FROM sc CROSS JOIN (VALUES (25e0), (50e0), (100e0), (200e0)) AS t(thr) WHERE pred_mean IS NOT NULL AND ice_sheet = 'antarctic' GROUP BY 1, 2
""")
def d25(c):
    s = truth_rows(c).where("pred_mean is not null and ice_sheet = 'antarctic'")
    s = s.withColumn("thr", F.explode(F.array(*[F.lit(v) for v in (25.0, 50.0, 100.0, 200.0)])))
    s = s.withColumn("class", labels.ice_class(F.col("bedmachine_mask"), F.col("surface_v_m_yr"), F.col("thr")))
    return rounded(od.exact_median(s, ["thr", "class"], "pred_mean", "med").drop("n_values"))


@query("d26_latitude_slopes", f"""
WITH {SCORED}, g AS (SELECT * FROM sc WHERE ice_sheet = 'greenland' AND required_surface_snr_dB IS NOT NULL),
o AS (SELECT regr_slope(required_surface_snr_dB, latitude) AS s, corr(required_surface_snr_dB, latitude) AS r FROM g)
SELECT 'observed' AS series, round(s, 6) AS slope, round(r, 6) AS r, 100e0 AS captured FROM o
UNION ALL SELECT 'run_a', round(regr_slope(pred_mean, latitude), 6), round(corr(pred_mean, latitude), 6), round(100 * regr_slope(pred_mean, latitude) / min(o.s), 3) FROM g, o WHERE pred_mean IS NOT NULL
UNION ALL SELECT 'run_b', round(regr_slope(pred_mean_b, latitude), 6), round(corr(pred_mean_b, latitude), 6), round(100 * regr_slope(pred_mean_b, latitude) / min(o.s), 3) FROM g, o WHERE pred_mean_b IS NOT NULL
""")
def d26(c):
    g = truth_rows(c).where((F.col("ice_sheet") == "greenland") & F.col(TARGET).isNotNull())
    rows = g.select("latitude", F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.col(v).alias("val")) for n, v in (
        ("observed", TARGET), ("run_a", "pred_mean"), ("run_b", "pred_mean_b"))])).alias("e")).select("latitude", "e.*").where("val is not null")
    per = rows.groupBy("series").agg(F.regr_slope("val", "latitude").alias("slope"), F.corr("val", "latitude").alias("r"))
    base = F.max(F.when(F.col("series") == "observed", F.col("slope"))).over(W.partitionBy(F.lit(0)))  # three rows
    return per.select("series", F.round("slope", 6).alias("slope"), F.round("r", 6).alias("r"), F.round(100 * F.col("slope") / base, 3).alias("captured"))


@query("d27_latitude_bin_means", f"""
WITH {SCORED} SELECT CAST(floor((latitude - 60) / 2) AS INTEGER) AS bin, round(avg(required_surface_snr_dB), 6) AS observed, round(avg(pred_mean), 6) AS predicted
FROM sc WHERE ice_sheet = 'greenland' AND required_surface_snr_dB IS NOT NULL AND latitude >= 60 AND latitude < 82 GROUP BY 1
""")
def d27(c):
    g = truth_rows(c).where((F.col("ice_sheet") == "greenland") & F.col(TARGET).isNotNull()).withColumn("bin", stats.bin_of(F.col("latitude"), 60.0, 2.0, 11))
    return rounded(g.where("bin is not null").groupBy("bin").agg(F.avg(TARGET).alias("observed"), F.avg("pred_mean").alias("predicted")))


@query("d28_rmse_by_sheet_and_run", f"""
WITH {SCORED} SELECT ice_sheet, is_test, count(*) AS n, round(sqrt(avg(pow(pred_mean - required_surface_snr_dB, 2))), 6) AS rmse_a, round(avg(pred_mean - required_surface_snr_dB), 6) AS bias_a,
  round(sqrt(avg(pow(pred_mean_b - required_surface_snr_dB, 2))), 6) AS rmse_b, round(avg(pred_mean_b - required_surface_snr_dB), 6) AS bias_b
FROM sc WHERE required_surface_snr_dB IS NOT NULL AND pred_mean IS NOT NULL GROUP BY ice_sheet, is_test
""")
def d28(c):
    s = truth_rows(c).where(F.col(TARGET).isNotNull() & F.col("pred_mean").isNotNull())
    runs = s.select("ice_sheet", "is_test", F.explode(F.array(*[F.struct(F.lit(n).alias("run"), (F.col(v) - F.col(TARGET)).alias("e")) for n, v in (
        ("a", "pred_mean"), ("b", "pred_mean_b"))])).alias("q")).select("ice_sheet", "is_test", "q.*")
    p = runs.groupBy("ice_sheet", "is_test").pivot("run", ["a", "b"]).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))
    return rounded(p.select("ice_sheet", "is_test", F.col("a_n").alias("n"), F.col("a_rmse").alias("rmse_a"), F.col("a_bias").alias("bias_a"),
                            F.col("b_rmse").alias("rmse_b"), F.col("b_bias").alias("bias_b")))


@query("d29_residuals_by_season", f"""
WITH {SCORED}, r AS (SELECT collection, institution, pred_mean - required_surface_snr_dB AS e FROM sc WHERE required_surface_snr_dB IS NOT NULL AND pred_mean IS NOT NULL AND collection IS NOT NULL
  AND NOT coalesce(obs_margin_dB < 10, false)),
i AS (SELECT institution, avg(e) AS im, stddev_samp(e) AS isd, count(*) AS ic FROM r GROUP BY institution)
SELECT r.collection, min(r.institution) AS institution, count(*) AS n, round(median(e), 6) AS med, round(quantile_cont(e, 0.02), 6) AS p02, round(quantile_cont(e, 0.25), 6) AS q25, round(quantile_cont(e, 0.75), 6) AS q75,
  round(quantile_cont(e, 0.98), 6) AS p98, round(min(im), 6) AS inst_mean, round(min(isd), 6) AS inst_sd, min(ic) AS inst_n FROM r JOIN i ON r.institution = i.institution GROUP BY r.collection
""")
def d29(c):
    r = truth_rows(c).where(F.col(TARGET).isNotNull() & F.col("pred_mean").isNotNull() & F.col("collection").isNotNull() & ~qc.censored(F.col("obs_margin_dB"), 10.0))
    r = r.select("collection", "institution", (F.col("pred_mean") - F.col(TARGET)).alias("e"))
    q = od.exact_quantiles(r, ["collection", "institution"], "e", {"med": 0.5, "p02": 0.02, "q25": 0.25, "q75": 0.75, "p98": 0.98}).withColumnRenamed("n_values", "n")
    i = r.groupBy("institution").agg(F.avg("e").alias("inst_mean"), F.stddev_samp("e").alias("inst_sd"), F.count(F.lit(1)).alias("inst_n"))
    return rounded(q.join(i, "institution"))


def source_errors(c):
    cells = c("raster_cells_fx").where("raster_id = 'bed' and value <> -9999")
    wide = cells.where("var in ('errbed', 'source')").groupBy("row", "col").agg(
        F.max(F.when(F.col("var") == "errbed", F.col("value"))).alias("e"), F.max(F.when(F.col("var") == "source", F.col("value"))).alias("code"))
    names = F.split(F.lit(FLAG_MEANINGS), " ")
    code = F.col("code").cast("int")
    name = F.when(code >= 10, "bathymetry (10-53)").when(code < F.size(names), F.element_at(names, code + 1)).otherwise(F.concat(F.lit("code"), code.cast("string")))
    return wide.where("e is not null and code is not null").withColumn("name", name)


SOURCE_ERR = """
se AS (SELECT e.value AS e, CASE WHEN s.value >= 10 THEN 'bathymetry (10-53)' WHEN s.value < 7 THEN
    list_extract(['none', 'gimpdem', 'mass_conservation', 'synthetic', 'interpolation', 'hydrostatic', 'kriging'], CAST(s.value AS BIGINT) + 1)
  ELSE concat('code', CAST(CAST(s.value AS BIGINT) AS VARCHAR)) END AS name
  FROM {raster_cells_fx} e JOIN {raster_cells_fx} s ON e.row = s.row AND e.col = s.col WHERE e.var = 'errbed' AND s.var = 'source' AND e.value <> -9999 AND s.value <> -9999)
"""


@query("d30_error_by_source", f"""
WITH {SOURCE_ERR} SELECT coalesce(name, 'All sources') AS name, count(*) AS n, min(e) AS lowest, median(e) AS med, max(e) AS highest FROM se GROUP BY ROLLUP (name)
""")
def d30(c):
    rows = source_errors(c).select(F.explode(F.array("name", F.lit("All sources"))).alias("name"), "e")
    m = od.exact_quantiles(rows, ["name"], "e", {"med": 0.5}, extra={"lowest": F.min("e"), "highest": F.max("e")}).withColumnRenamed("n_values", "n")
    return m.select("name", "n", "lowest", "med", "highest")


@query("d31_error_field_distributions", """
WITH w AS (SELECT row, col, max(CASE WHEN var = 'vx' THEN value END) AS vx, max(CASE WHEN var = 'vy' THEN value END) AS vy, max(CASE WHEN var = 'errx' THEN value END) AS ex,
  max(CASE WHEN var = 'erry' THEN value END) AS ey, max(CASE WHEN var = 'HFmin' THEN value END) AS lo, max(CASE WHEN var = 'HFmax' THEN value END) AS hi
  FROM {raster_cells_fx} WHERE value <> -9999 AND var IN ('vx', 'vy', 'errx', 'erry', 'HFmin', 'HFmax') GROUP BY row, col),
f AS (SELECT 'speed_error' AS field, CASE WHEN sqrt(vx * vx + vy * vy) > 0 THEN sqrt(pow(vx * ex, 2) + pow(vy * ey, 2)) / sqrt(vx * vx + vy * vy) ELSE sqrt(ex * ex + ey * ey) END AS v
  FROM w UNION ALL SELECT 'heat_flow_band', (hi - lo) * 1000 FROM w)
SELECT field, count(*) AS n, round(min(v), 6) AS lowest, round(median(v), 6) AS med, round(quantile_cont(v, 0.99), 6) AS p99, round(quantile_cont(v, 0.995), 6) AS clip, round(max(v), 6) AS highest FROM f WHERE v IS NOT NULL GROUP BY field
""")
def d31(c):
    names = {"vx": "vx", "vy": "vy", "errx": "ex", "erry": "ey", "HFmin": "lo", "HFmax": "hi"}
    w = c("raster_cells_fx").where(F.col("var").isin(list(names)) & (F.col("value") != -9999.0)).groupBy("row", "col").agg(
        *[F.max(F.when(F.col("var") == v, F.col("value"))).alias(n) for v, n in names.items()])
    err = radio.speed_error(F.col("vx"), F.col("vy"), F.col("ex"), F.col("ey"))
    f = w.select(F.explode(F.array(F.struct(F.lit("speed_error").alias("field"), err.alias("v")), F.struct(F.lit("heat_flow_band").alias("field"), ((F.col("hi") - F.col("lo")) * 1000).alias("v")))).alias("e")).select("e.*")
    f = f.where("v is not null")
    q = od.exact_quantiles(f, ["field"], "v", {"med": 0.5, "p99": 0.99, "clip": 0.995}, extra={"lowest": F.min("v"), "highest": F.max("v")})
    return rounded(q.withColumnRenamed("n_values", "n"))


@query("d32_bed_sanity", """
WITH d AS (SELECT t.bed_elevation AS b, t.bed_elevation + ((t.trace_id * 13) % 200) / 2e0 - 50e0 AS a FROM {traces_fx} t WHERE t.bed_elevation IS NOT NULL)
SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(median(a - b), 6) AS median_diff, round(quantile_cont(a - b, 0.75) - quantile_cont(a - b, 0.25), 6) AS iqr_diff,
  min(a) AS a_min, max(a) AS a_max, min(b) AS b_min, max(b) AS b_max, corr(a, b) > 0.9e0 AS passes FROM d
""")
def d32(c):
    d = c("traces_fx").where("bed_elevation is not null").select(
        F.col("bed_elevation").alias("b"), (F.col("bed_elevation") + ((F.col("trace_id") * 13) % 200) / 2.0 - 50.0).alias("a")).withColumn("d", F.col("a") - F.col("b"))
    more = {"r": F.corr("a", "b"), **{f"{v}_{n}": f(v) for v in "ab" for n, f in (("min", F.min), ("max", F.max))}}
    j = od.exact_quantiles(d, [], "d", {"med": 0.5, "lo": 0.25, "hi": 0.75}, extra=more)
    return j.select(F.col("n_values").alias("n"), F.round("r", 6).alias("r"), F.round("med", 6).alias("median_diff"), F.round(F.col("hi") - F.col("lo"), 6).alias("iqr_diff"),
                    "a_min", "a_max", "b_min", "b_max", (F.col("r") > 0.9).alias("passes"))


@query("d33_observed_ceiling", f"""
WITH t AS (SELECT collection AS season, regexp_replace(frame_id, '_[^_]*$', '') AS segment, surface_twtt, surface_power_dB FROM {{traces_fx}})
SELECT t.season, t.segment, count(*) AS n_valid, round(quantile_cont(surface_power_dB, 0.995), 6) AS obs_p995 FROM t JOIN {{windows_fx}} w ON t.season = w.season AND t.segment = w.segment
WHERE surface_twtt BETWEEN lo_s AND hi_s GROUP BY t.season, t.segment
""")
def d33(c):
    t = c("traces_fx").select(F.col("collection").alias("season"), labels.segment(F.col("frame_id")).alias("segment"), "surface_twtt", "surface_power_dB")
    t = t.join(c("windows_fx"), ["season", "segment"]).where(F.col("surface_twtt").between(F.col("lo_s"), F.col("hi_s")))
    return rounded(od.exact_quantiles(t, ["season", "segment"], "surface_power_dB", {"obs_p995": 0.995}).withColumnRenamed("n_values", "n_valid"))


LEVELS = """
fm AS (SELECT site_id, frame_id, median(r_surf) AS h FROM {sites_fx} GROUP BY site_id, frame_id),
hs AS (SELECT site_id, list_sort(list(h)) AS hs, count(*) AS nf FROM fm GROUP BY site_id),
lv2 AS (SELECT site_id, CAST(CASE WHEN nf < 2 THEN 0 ELSE list_reduce(list_transform(hs, lambda h: {{'n': 1, 'last': h}}),
   lambda a, b: CASE WHEN b.last - a.last >= 200e0 THEN {{'n': a.n + 1, 'last': b.last}} ELSE a END).n END AS INTEGER) AS n_levels FROM hs)
"""


@query("d34_site_counts", f"""
WITH {LEVELS} SELECT s.sheet, s.season, s.regime, count(DISTINCT s.site_id) AS n_sites, count(*) AS n_traces, count(DISTINCT CASE WHEN n_levels >= 3 THEN s.site_id END) AS n_sites_3
FROM {{sites_fx}} s JOIN lv2 ON s.site_id = lv2.site_id GROUP BY s.sheet, s.season, s.regime
""")
def d34(c):
    s = c("sites_fx").join(site_levels(c("sites_fx"), ["site_id"], "frame_id", "r_surf"), "site_id")
    per = s.groupBy("sheet", "season", "regime", "site_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_levels").alias("lev"))
    return per.groupBy("sheet", "season", "regime").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("n").alias("n_traces"), F.count_if(F.col("lev") >= 3).alias("n_sites_3"))


@query("d35_site_centroids", f"""
WITH {LEVELS} SELECT s.sheet, s.site_id, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, min(n_levels) AS n_levels
FROM {{sites_fx}} s JOIN lv2 ON s.site_id = lv2.site_id GROUP BY s.sheet, s.site_id
""")
def d35(c):
    a = c("sites_fx").groupBy("sheet", "site_id").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    return rounded(a.join(site_levels(c("sites_fx"), ["site_id"], "frame_id", "r_surf"), "site_id"))


@query("d36_mixed_season_sites", "SELECT site_id, count(DISTINCT season) AS n_seasons FROM {sites_fx} GROUP BY site_id HAVING count(DISTINCT season) > 1")
def d36(c):
    per = c("sites_fx").groupBy("site_id", "season").agg(F.lit(1).alias("one"))
    return per.groupBy("site_id").agg(F.count("one").alias("n_seasons")).where("n_seasons > 1")


CDF = """(CASE WHEN {z} > 0 THEN 1 - {t} ELSE {t} END)"""


def cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419e0 * abs({z})))"
    poly = f"(0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0))))"
    return CDF.format(z=z, t=f"(0.3989422804014327e0 * exp(-({z}) * ({z}) / 2) * {t} * {poly})")


@query("d37_coverage", f"""
WITH {SIDE}, p AS (SELECT *, 'all' AS part FROM snr UNION ALL SELECT *, CASE WHEN mask = 3 THEN 'floating' ELSE 'grounded' END FROM snr WHERE ice_sheet = 'antarctic')
SELECT scenario_id, ice_sheet, part, count(*) AS n, round(100 * avg(CASE WHEN round(snr_dB, 9) >= 30e0 THEN 1e0 ELSE 0e0 END), 6) AS pct, round(100 * avg({cdf_sql('((snr_dB - 30e0) / sd_dB)')}), 6) AS pct_predictive,
  round(count(*) * 25e0 / 1e6, 9) AS area_Mkm2 FROM p GROUP BY scenario_id, ice_sheet, part
""")
def d37(c):
    return lb.coverage(cell_snr(c), 30.0, ["scenario_id", "ice_sheet"]).select(
        "scenario_id", "ice_sheet", "part", "n", F.round("pct", 6).alias("pct"), F.round("pct_predictive", 6).alias("pct_predictive"), F.round("area_Mkm2", 9).alias("area_Mkm2"))


@query("d38_clamped_histogram", f"""
WITH {SIDE}, h AS (SELECT scenario_id, ice_sheet, CAST(greatest(0, least(159, floor((round(snr_dB, 6) - (-20e0)) / 120e0 * 160))) AS INTEGER) AS bin, count(*) AS n FROM snr GROUP BY 1, 2, 3)
SELECT scenario_id, ice_sheet, bin, n, round(100e0 * n / sum(n) OVER (PARTITION BY scenario_id, ice_sheet), 6) AS pct,
  round(100e0 * sum(n) OVER (PARTITION BY scenario_id, ice_sheet ORDER BY bin DESC) / sum(n) OVER (PARTITION BY scenario_id, ice_sheet), 6) AS pct_above FROM h
""")
def d38(c):
    keys = ["scenario_id", "ice_sheet"]
    h = cell_snr(c).groupBy(*keys, stats.clamped_bin(F.round("snr_dB", 6), -20.0, 100.0, 160).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(stats.share_above(h, keys))


@query("d39_snr_axis", f"""
WITH {SIDE}, q AS (SELECT scenario_id, least(min(snr_dB) - 3 * max(sd_dB), 30e0) AS lo, greatest(max(snr_dB) + 3 * max(sd_dB), 30e0) AS hi FROM snr GROUP BY scenario_id)
SELECT scenario_id, round(lo - greatest(hi - lo, 1e0) * 0.03e0, 6) AS axis_lo, round(hi + greatest(hi - lo, 1e0) * 0.03e0, 6) AS axis_hi FROM q
""")
def d39(c):
    return rounded(lb.snr_axis(cell_snr(c), 30.0, ["scenario_id"], predictive=True))


@query("d40_predictive_histogram", f"""
WITH {SIDE}, b AS (SELECT scenario_id, sd_q, CAST(greatest(0, least(159, floor((round(snr_dB, 6) + 60e0) / 200e0 * 160))) AS INTEGER) AS b, count(*) AS n FROM snr GROUP BY 1, 2, 3),
k AS (SELECT *, sd_q / 4e0 / 1.25e0 AS s, CAST(greatest(1, ceil(4 * sd_q / 4e0 / 1.25e0)) AS BIGINT) AS half FROM b),
e AS (SELECT scenario_id, b, n, s, half, unnest(range(-half, half + 1)) AS j FROM k),
w AS (SELECT *, exp(-0.5e0 * j * j / (s * s)) AS w, sum(exp(-0.5e0 * j * j / (s * s))) OVER (PARTITION BY scenario_id, b, s) AS tot FROM e)
SELECT scenario_id, CAST(b + j AS INTEGER) AS bin, round(sum(n * w / tot), 6) AS mass FROM w WHERE b + j >= 0 AND b + j < 160 GROUP BY 1, 2
""")
def d40(c):
    s = cell_snr(c).withColumn("snr_dB", F.round("snr_dB", 6))
    return rounded(stats.mixture_histogram(s, ["scenario_id"], "snr_dB", "sd_q", 4.0, -60.0, 140.0, 160))


@query("d41_density_histogram", """
WITH h AS (SELECT ice_sheet, CASE WHEN required_surface_snr_dB = 120 THEN 69 ELSE CAST(floor((required_surface_snr_dB + 20) / 2) AS INTEGER) END AS bin, count(*) AS n FROM {split_fx}
WHERE fold >= 0 AND required_surface_snr_dB BETWEEN -20 AND 120 GROUP BY 1, 2)
SELECT ice_sheet, bin, n, round(n / (sum(n) OVER (PARTITION BY ice_sheet) * 2e0), 9) AS density FROM h
""")
def d41(c):
    d = stats.density(c("split_fx").where("fold >= 0"), ["ice_sheet"], TARGET, -20.0, 120.0, 70)
    return rounded(d, 9)


@query("d42_draw_summaries", """
WITH d AS (SELECT o_orderstatus AS param, o_totalprice / 1e5 - 1e0 AS value FROM {orders})
SELECT param, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END), 6) AS p_positive,
  round(quantile_cont(value, 0.055), 6) AS eti_lo, round(quantile_cont(value, 0.945), 6) AS eti_hi FROM d GROUP BY param
""")
def d42(c):
    d = c("orders").select(F.col("o_orderstatus").alias("param"), (F.col("o_totalprice") / 1e5 - 1.0).alias("value"))
    more = {"mean": F.avg("value"), "sd": F.stddev_pop("value"), "p_positive": F.avg((F.col("value") > 0).cast("double"))}
    return rounded(od.exact_quantiles(d, ["param"], "value", {"eti_lo": 0.055, "eti_hi": 0.945}, extra=more).withColumnRenamed("n_values", "n"))


@query("d43_prediction_shift", """
WITH s AS (SELECT a.ice_sheet, b.pred_mean - a.pred_mean AS d, b.pred_std / a.pred_std AS r FROM {predictions_fx} a JOIN {predictions_b_fx} b ON a.grid_id = b.grid_id WHERE a.pred_mean IS NOT NULL)
SELECT ice_sheet, count(*) AS n_grid, round(median(d), 6) AS median_shift_dB, round(quantile_cont(d, 0.05), 6) AS p5_dB, round(quantile_cont(d, 0.95), 6) AS p95_dB, round(median(r), 6) AS median_pred_std_ratio FROM s GROUP BY ice_sheet
""")
def d43(c):
    q = od.quantiles_of(shifts(c), ["ice_sheet"], {"median_shift_dB": ("shift", 0.5), "p5_dB": ("shift", 0.05), "p95_dB": ("shift", 0.95), "median_pred_std_ratio": ("std_ratio", 0.5)})
    return rounded(q.withColumnRenamed("n_values", "n_grid"))


@query("d44_fixed_subset_scores", f"""
WITH {SCORED}, u AS (SELECT * FROM sc WHERE pred_mean IS NOT NULL)
SELECT round(sqrt(avg(pow(pred_mean - required_surface_snr_dB, 2)) FILTER (fold >= 0 AND obs_margin_dB > 20)), 6) AS clean_rmse_dB,
  round(avg(pred_mean - required_surface_snr_dB) FILTER (fold >= 0 AND obs_margin_dB > 20), 6) AS clean_bias_dB,
  round(avg(pred_mean) FILTER (fold >= 0 AND required_surface_snr_dB IS NOT NULL AND obs_margin_dB < 10), 6) AS saturated_pred_dB,
  round(avg(pred_mean) FILTER (ice_sheet = 'antarctic'), 6) AS antarctica_dB, round(avg(pred_mean) FILTER (ice_sheet = 'greenland'), 6) AS greenland_dB,
  round(avg(pred_mean) FILTER (ice_sheet = 'greenland' AND latitude < 72), 6) AS s_greenland_dB FROM u
""")
def d44(c):
    return rounded(subset_scores(truth_rows(c).where("pred_mean is not null"), []))


def subset_scores(u, keys):
    e = F.col("pred_mean") - F.col(TARGET)
    obs = (F.col("fold") >= 0) & F.col(TARGET).isNotNull()
    clean = obs & (F.col("obs_margin_dB") > 20)
    grl = F.col("ice_sheet") == "greenland"
    return u.groupBy(*keys).agg(
        F.sqrt(F.avg(F.when(clean, e * e))).alias("clean_rmse_dB"), F.avg(F.when(clean, e)).alias("clean_bias_dB"),
        F.avg(F.when(obs & (F.col("obs_margin_dB") < 10), F.col("pred_mean"))).alias("saturated_pred_dB"),
        F.avg(F.when(F.col("ice_sheet") == "antarctic", F.col("pred_mean"))).alias("antarctica_dB"),
        F.avg(F.when(grl, F.col("pred_mean"))).alias("greenland_dB"), F.avg(F.when(grl & (F.col("latitude") < 72), F.col("pred_mean"))).alias("s_greenland_dB"))


@query("d45_mode_scores", f"""
WITH {SCORED}, q AS (SELECT ice_sheet, quantile_cont(required_surface_snr_dB, 0.75) AS ceil FROM sc WHERE fold >= 0 GROUP BY ice_sheet),
r AS (SELECT fold, m.mode, required_surface_snr_dB > ceil AS cens, CASE WHEN m.mode = 'naive' THEN pred_mean ELSE pred_mean_b END - required_surface_snr_dB AS e
  FROM sc JOIN q ON sc.ice_sheet = q.ice_sheet CROSS JOIN (VALUES ('naive'), ('tobit')) AS m(mode) WHERE fold >= 0 AND required_surface_snr_dB IS NOT NULL AND pred_mean IS NOT NULL),
f AS (SELECT mode, fold, sqrt(avg(e * e)) AS ra, avg(e) AS ba, sqrt(avg(e * e) FILTER (cens)) AS rc, avg(e) FILTER (cens) AS bc FROM r GROUP BY mode, fold)
SELECT mode, round(avg(ra), 6) AS rmse_all, round(avg(ba), 6) AS bias_all, round(avg(rc), 6) AS rmse_censored, round(avg(bc), 6) AS bias_censored FROM f GROUP BY mode
""")
def d45(c):
    from firnline.catalog.ordered import with_ceiling
    s = with_ceiling(truth_rows(c).where((F.col("fold") >= 0) & F.col(TARGET).isNotNull()))
    s = s.where("pred_mean is not null").withColumn("m", F.explode(F.array(*[F.struct(F.lit(n).alias("mode"), F.col(v).alias("p")) for n, v in (("naive", "pred_mean"), ("tobit", "pred_mean_b"))])))
    return rounded(mode_scores(s.select("fold", "m.mode", "censored", (F.col("m.p") - F.col("y_true")).alias("e"))))


def mode_scores(rows):
    """Per fold and mode, then the mean over folds."""
    e, ec = F.col("e"), F.when(F.col("censored"), F.col("e"))
    f = rows.groupBy("mode", "fold").agg(F.sqrt(F.avg(e * e)).alias("ra"), F.avg(e).alias("ba"), F.sqrt(F.avg(ec * ec)).alias("rc"), F.avg(ec).alias("bc"))
    return f.groupBy("mode").agg(F.avg("ra").alias("rmse_all"), F.avg("ba").alias("bias_all"), F.avg("rc").alias("rmse_censored"), F.avg("bc").alias("bias_censored"))


@query("d46_observed_vs_predictive", f"""
WITH {SCORED}, r AS (SELECT ice_sheet, 'predictive' AS series, pred_mean + {hash_normal_sql("grid_id", 0)} * pred_std AS v FROM sc WHERE pred_mean IS NOT NULL
  UNION ALL SELECT ice_sheet, 'observed', required_surface_snr_dB FROM sc WHERE pred_mean IS NOT NULL)
SELECT ice_sheet, series, count(*) AS n_values, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90,
  round(CASE WHEN series = 'observed' THEN stddev_samp(v) ELSE stddev_pop(v) END, 6) AS sd FROM r WHERE v IS NOT NULL GROUP BY ice_sheet, series
""")
def d46(c):
    s = truth_rows(c).where("pred_mean is not null")
    ppc = F.col("pred_mean") + hash_normal(F.col("grid_id"), 0) * F.col("pred_std")
    rows = s.select("ice_sheet", F.explode(F.array(F.struct(F.lit("predictive").alias("series"), ppc.alias("v")), F.struct(F.lit("observed").alias("series"), F.col(TARGET).alias("v")))).alias("e")).select("ice_sheet", "e.*").where("v is not null")
    sd = F.when(F.first("series") == "observed", F.stddev_samp("v")).otherwise(F.stddev_pop("v"))
    return rounded(od.exact_quantiles(rows, ["ice_sheet", "series"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, extra={"sd": sd}))


@query("d47_window_summary", """
SELECT season, round(1e6 * min(lo_s), 6) AS lo_min, round(1e6 * median(lo_s), 6) AS lo_med, round(1e6 * max(lo_s), 6) AS lo_max, round(1e6 * min(hi_s), 6) AS hi_min, round(1e6 * median(hi_s), 6) AS hi_med, round(1e6 * max(hi_s), 6) AS hi_max
FROM {windows_fx} GROUP BY season
""")
def d47(c):
    w = c("windows_fx").select("season", (F.col("lo_s") * 1e6).alias("lo"), (F.col("hi_s") * 1e6).alias("hi"))
    more = {f"{v}_{n}": f(v) for v in ("lo", "hi") for n, f in (("min", F.min), ("max", F.max))}
    return rounded(od.quantiles_of(w, ["season"], {"lo_med": ("lo", 0.5), "hi_med": ("hi", 0.5)}, extra=more).drop("n_values"))


@query("d48_missing_coverage", f"""
WITH {SCORED} SELECT ice_sheet, count(*) AS n, round(avg(CASE WHEN pred_mean IS NULL THEN 1e0 ELSE 0e0 END), 6) AS missing, round(avg(CASE WHEN latitude < -84 THEN 1e0 ELSE 0e0 END) FILTER (pred_mean IS NULL), 6) AS missing_south,
  round(avg(CASE WHEN surface_v_m_yr IS NULL THEN 1e0 ELSE 0e0 END), 6) AS speed_missing FROM sc GROUP BY ice_sheet
""")
def d48(c):
    gap = F.col("pred_mean").isNull()
    return rounded(truth_rows(c).groupBy("ice_sheet").agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap.cast("double")).alias("missing"), F.avg(F.when(gap, (F.col("latitude") < -84).cast("double"))).alias("missing_south"),
        F.avg(F.col("surface_v_m_yr").isNull().cast("double")).alias("speed_missing")))


@query("d49_runs_side_by_side", """
SELECT model, count(*) AS n_runs, round(min(rmse_mean), 6) AS best_rmse, arg_min(run_id, rmse_mean * 1e6 + doc_id / 1e3) AS best_run, round(avg(CASE WHEN censored THEN rmse_mean END), 6) AS rmse_censored, round(avg(CASE WHEN NOT censored THEN rmse_mean END), 6) AS rmse_plain
FROM {metrics_fx} GROUP BY model
""")
def d49(c):
    m = c("metrics_fx")
    return rounded(m.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_runs"), F.min("rmse_mean").alias("best_rmse"), F.min(F.struct("rmse_mean", "doc_id", "run_id"))["run_id"].alias("best_run"),
        F.avg(F.when(F.col("censored"), F.col("rmse_mean"))).alias("rmse_censored"), F.avg(F.when(~F.col("censored"), F.col("rmse_mean"))).alias("rmse_plain")))


@query("d50_confidence_counts", f"""
WITH t AS (SELECT collection AS season, regexp_replace(frame_id, '_[^_]*$', '') AS segment, surface_power_dB FROM {{traces_fx}}),
o AS (SELECT season, segment, count(*) AS n, quantile_cont(surface_power_dB, 0.995) AS p FROM t GROUP BY season, segment)
SELECT CASE WHEN S_dB IS NULL THEN 'unknown' WHEN p IS NULL OR n < 30 THEN 'no-data' WHEN S_dB - p < 3 THEN 'validated-at-ceiling' WHEN S_dB - p < 6 THEN 'near-ceiling' ELSE 'inactive-bound' END AS confidence, count(*) AS n
FROM {{clip_fx}} c LEFT JOIN o ON c.season = o.season AND c.segment = o.segment GROUP BY 1
""")
def d50(c):
    t = c("traces_fx").select(F.col("collection").alias("season"), labels.segment(F.col("frame_id")).alias("segment"), "surface_power_dB")
    o = od.exact_quantiles(t, ["season", "segment"], "surface_power_dB", {"p": 0.995})
    j = c("clip_fx").join(o, ["season", "segment"], "left")
    conf = radio.clip_confidence(F.col("S_dB"), F.col("S_dB") - F.col("p"), F.when(F.col("n_values") >= 30, 100).otherwise(0))
    return j.groupBy(conf.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))

"""Fits, scores and experiments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from firnline.catalog.aggregates import mode_scores, subset_scores
from firnline.catalog.filters import analysis_population, high_margin, truth_set
from firnline.catalog.ordered import with_ceiling
from firnline.catalog.registry import query
from firnline.catalog.scalars import NORM, with_indicators
from firnline.catalog.scans import rounded
from firnline.operators import qc, stats, track
from firnline.plans import detection, exponent, fit as ft, split
from firnline.plans.design import Design
from firnline.schema import FEATURES, TARGET, THICKNESS
from firnline.session import cut_lineage, moved

LINEAR = Design("linear", indicators=("is_greenland", "is_floating"))
ATTEN = Design("atten_refl", indicators=("is_greenland", "is_floating"))
DETECT = ft.Detection()


def split_rows(c):
    return with_indicators(c("split_fx"))


def fold_ids(c):
    """The folds that the split has."""
    return sorted(r[0] for r in c("split_fx").where("fold >= 0").select("fold").distinct().collect())


def train_rows(c, design=LINEAR, extra=()):
    return ft.training_rows(split_rows(c), design, min_thickness_m=100.0, extra=extra)


@query("i01_gram_of_linear_model", """
WITH z AS (SELECT 1e0 AS o, (bedmachine_thickness_m - 1600e0) / 900e0 AS t, (era5_t2m_mean_K - 245e0) / 14e0 AS a, CASE WHEN ice_sheet = 'greenland' THEN 1e0 ELSE 0e0 END AS g, required_surface_snr_dB AS y
  FROM {split_fx} WHERE fold >= 0 AND bedmachine_thickness_m IS NOT NULL AND required_surface_snr_dB IS NOT NULL),
l AS (SELECT unnest([{{'i': 'alpha', 'v': o}}, {{'i': 'beta[bedmachine_thickness_m]', 'v': t}}, {{'i': 'beta[era5_t2m_mean_K]', 'v': a}}, {{'i': 'beta[is_greenland]', 'v': g}}, {{'i': 'y', 'v': y}}]) AS e, row_number() OVER () AS k FROM z)
SELECT a.e.i AS term_i, b.e.i AS term_j, round(sum(a.e.v * b.e.v), 1) AS value FROM l a JOIN l b ON a.k = b.k
WHERE list_position(['alpha', 'beta[bedmachine_thickness_m]', 'beta[era5_t2m_mean_K]', 'beta[is_greenland]', 'y'], a.e.i) >= list_position(['alpha', 'beta[bedmachine_thickness_m]', 'beta[era5_t2m_mean_K]', 'beta[is_greenland]', 'y'], b.e.i)
GROUP BY 1, 2
""")
def i01(c):
    d = Design("linear", features=(THICKNESS, "era5_t2m_mean_K"), indicators=("is_greenland",))
    s = split_rows(c).where((F.col("fold") >= 0) & F.col(THICKNESS).isNotNull() & F.col(TARGET).isNotNull())
    return rounded(ft.gram(s, d.terms(F.col, NORM, F.lit(1.0)), F.col(TARGET)), 1)


@query("i01_linear_posterior")
def i01_posterior(c):
    rows = train_rows(c).where(~F.col("is_nondetect"))
    fits = ft.fit_all(rows, LINEAR, [ft.Fit(ft.FINAL)])
    return ft.fit_table(c.spark, LINEAR, fits)


@query("i02_attenuation_posterior")
def i02(c):
    rows = train_rows(c, ATTEN).where(~F.col("is_nondetect"))
    return ft.fit_table(c.spark, ATTEN, ft.fit_all(rows, ATTEN, [ft.Fit(ft.FINAL)]))


@query("i03_tobit_fit")
def i03(c):
    rows = train_rows(c).where(~F.col("is_nondetect"))
    return ft.fit_table(c.spark, LINEAR, ft.fit_all(rows, LINEAR, [ft.Fit(ft.FINAL, censor_below=10.0)]))


@query("i04_detection_fit")
def i04(c):
    fits = ft.fit_all(train_rows(c), LINEAR, [ft.Fit(ft.FINAL, censor_below=10.0)], DETECT)
    return ft.fit_table(c.spark, LINEAR, fits, detection=True)


@query("i05_blocked_cv")
def i05(c):
    """One row per fold, and the pooled row with fold NULL."""
    _, metrics = ft.cross_validate(split_rows(c), LINEAR, folds=fold_ids(c), censor_below=10.0, detection=DETECT, min_thickness_m=100.0, draws=200)
    metrics = cut_lineage(metrics)
    pooled = ft.pooled_cv(metrics).select(F.lit(None).cast("int").alias("fold"), *[F.col(f"{m}_mean").alias(m) for m in ft.POOLED], "n_points", "n_censored", "n_total", "n_nd_val")
    return metrics.select(*pooled.columns).unionByName(pooled)


@query("i06_final_fit_and_test")
def i06(c):
    rows = train_rows(c).where(~F.col("is_nondetect"))
    f = ft.fit_all(rows, LINEAR, [ft.Fit(ft.FINAL, censor_below=10.0)])[0]
    return ft.held_out_metrics(split_rows(c).where(F.col("is_test") & qc.usable(TARGET, FEATURES, 100.0, THICKNESS)), LINEAR, f)


FIXED = Design("linear", features=(THICKNESS, "era5_t2m_mean_K"), indicators=())
LOG_SIGMA = math.log(0.7)


def fixed_fit(c) -> ft.Fit:
    """The given posterior with the normaliser of the training rows."""
    post = c("posterior_fx").orderBy("pos").collect()
    low = np.array([[r["l0"], r["l1"], r["l2"]] for r in post])
    cov = np.zeros((4, 4))
    cov[:3, :3] = low @ low.T
    n = stats.normalizer(c("split_fx").where((F.col("fold") >= 0) & F.col(TARGET).isNotNull()), [THICKNESS, "era5_t2m_mean_K", TARGET]).first()
    norm = {k: (n[f"{k}__mean"], n[f"{k}__sd"]) for k in (THICKNESS, "era5_t2m_mean_K", TARGET)}
    return ft.Fit(ft.FINAL, norm=norm, params=np.array([*[r["mean"] for r in post], LOG_SIGMA]), cov=cov)


POSTERIOR_PRED = """
nm AS (SELECT avg(bedmachine_thickness_m) AS tm, stddev_pop(bedmachine_thickness_m) AS ts, avg(era5_t2m_mean_K) AS am, stddev_pop(era5_t2m_mean_K) AS sa, avg(required_surface_snr_dB) AS ym, stddev_pop(required_surface_snr_dB) AS ys
  FROM {split_fx} WHERE fold >= 0 AND required_surface_snr_dB IS NOT NULL),
pz AS (SELECT s.*, (bedmachine_thickness_m - tm) / ts AS z1, (era5_t2m_mean_K - am) / sa AS z2, ym, ys FROM {split_fx} s, nm WHERE bedmachine_thickness_m IS NOT NULL),
pr AS (SELECT *, (0.05e0 + 0.8e0 * z1 - 0.4e0 * z2) * ys + ym AS pm, sqrt(pow(0.02e0 + 0.004e0 * z1 - 0.002e0 * z2, 2) + pow(0.03e0 * z1 + 0.001e0 * z2, 2) + pow(0.025e0 * z2, 2)) AS smu FROM pz),
pp2 AS (SELECT *, smu * ys AS pred_std_mu, sqrt(smu * smu + 0.49e0) * ys AS pred_std FROM pr)
"""


@query("i07_full_grid_prediction", f"WITH {POSTERIOR_PRED} SELECT grid_id, round(pm, 5) AS pred_mean, round(pred_std_mu, 5) AS pred_std_mu, round(pred_std, 5) AS pred_std FROM pp2")
def i07(c):
    s = c("split_fx").where(F.col(THICKNESS).isNotNull())
    return rounded(ft.predictions(s, FIXED, fixed_fit(c), ["grid_id"]), 5)


@query("i08_benchmark_best_model", """
SELECT model, run_id, round_even(rmse_mean, 3) AS cv_rmse_dB FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rmse_mean, doc_id) AS rn FROM {metrics_fx}) q WHERE rn = 1
""")
def i08(c):
    m = c("metrics_fx").groupBy("model").agg(F.min(F.struct("rmse_mean", "doc_id", "run_id")).alias("b"))
    return m.select("model", "b.run_id", F.bround("b.rmse_mean", 3).alias("cv_rmse_dB"))


@query("i09_out_of_fold_residuals")
def i09(c):
    rows = train_rows(c).where(~F.col("is_nondetect"))
    fits = ft.fit_all(rows, LINEAR, ft.cv_fits(fold_ids(c), 10.0, final=False))
    obs = split_rows(c).where(qc.usable(TARGET, FEATURES, 100.0, THICKNESS) & (F.col("fold") >= 0))
    p = ft.held_out_predictions(obs, LINEAR, fits, ["grid_id", "fold", "collection", "institution", TARGET])
    return p.select("grid_id", "fold", "collection", "institution", (F.col("pred_mean") - F.col(TARGET)).alias("resid"))


THRESHOLDS = [0.0, 5.0, 10.0, 15.0, 20.0]


@query("i10_threshold_ablation")
def i10(c):
    """Every threshold's folds and final fit in one series of jobs."""
    one = Design("linear", features=(THICKNESS, "era5_t2m_mean_K"), indicators=("is_greenland",))
    rows = train_rows(c, one).where(~F.col("is_nondetect"))
    fits = [f for i, t in enumerate(THRESHOLDS) for f in ft.cv_fits(fold_ids(c), t, start=1000 * (i + 1))]
    done = ft.fit_all(rows, one, fits)
    s = split_rows(c).where(qc.usable(None, FEATURES, 100.0, THICKNESS))
    keep = ["fold", TARGET, "obs_margin_dB", "ice_sheet", "latitude"]
    out = None
    for i, t in enumerate(THRESHOLDS):
        mine = [f for f in done if f.fit_id // 1000 == i + 1]
        oof = ft.held_out_predictions(s, one, mine, keep).drop("fit_id").select(*keep, "pred_mean", F.lit("oof").alias("kind"))
        grid = ft.predictions(s, one, next(f for f in mine if f.held_out is None), keep).select(*keep, "pred_mean", F.lit("grid").alias("kind"))
        part = oof.unionByName(grid).withColumn("threshold_dB", F.lit(t))
        out = part if out is None else out.unionByName(part)
    oof, grid = F.col("kind") == "oof", F.col("kind") == "grid"
    e = F.when(oof & F.col(TARGET).isNotNull() & (F.col("obs_margin_dB") > 20), F.col("pred_mean") - F.col(TARGET))
    grl = grid & (F.col("ice_sheet") == "greenland")
    return out.groupBy("threshold_dB").agg(
        F.count_if(oof & F.col(TARGET).isNotNull() & (F.col("obs_margin_dB") < F.col("threshold_dB"))).alias("n_censored_train"),
        F.sqrt(F.avg(e * e)).alias("clean_rmse_dB"), F.avg(e).alias("clean_bias_dB"),
        F.avg(F.when(oof & F.col(TARGET).isNotNull() & (F.col("obs_margin_dB") < 10), F.col("pred_mean"))).alias("mean_oof_pred_saturated_dB"),
        F.avg(F.when(grid & (F.col("ice_sheet") == "antarctic"), F.col("pred_mean"))).alias("mean_grid_pred_antarctica_dB"),
        F.avg(F.when(grl, F.col("pred_mean"))).alias("mean_grid_pred_greenland_dB"),
        F.avg(F.when(grl & (F.col("latitude") < 72), F.col("pred_mean"))).alias("mean_grid_pred_s_greenland_dB"))


@query("i11_naive_vs_tobit")
def i11(c):
    """Cut the target at a known ceiling; the censored fit should see through it."""
    s = with_ceiling(truth_set(split_rows(c)))
    s = cut_lineage(s.withColumn("cut", F.col("censored").cast("double")))
    rows = ft.training_rows(s, LINEAR, extra=["y_obs", "y_true", "cut"])
    naive = [ft.Fit(k, held_out=k, target="y_obs") for k in fold_ids(c)]
    tobit = [ft.Fit(100 + k, held_out=k, target="y_obs", censor_flag="cut") for k in fold_ids(c)]
    fits = ft.fit_all(rows, LINEAR, naive + tobit)
    p = ft.held_out_predictions(s, LINEAR, fits, ["fold", "y_true", "censored"])
    p = p.select("fold", "censored", F.when(F.col("fit_id") < 100, "naive").otherwise("tobit").alias("mode"), (F.col("pred_mean") - F.col("y_true")).alias("e"))
    return mode_scores(p)


@query("i12_shared_vs_group_slopes")
def i12(c):
    out = None
    for name, inter in (("shared slopes", ()), ("sheet-specific slopes", ("is_greenland",))):
        d = Design("linear", indicators=("is_greenland",), interactions=inter)
        _, m = ft.cross_validate(split_rows(c), d, folds=fold_ids(c), min_thickness_m=100.0)
        row = m.agg(*[v.alias(k) for k, v in stats.pooled("rmse_dB", "n_points").items()], F.sum("n_points").alias("n_points")).withColumns(
            {"run": F.lit(name), "n_terms": F.lit(len(d.term_names()))})
        out = row if out is None else out.unionByName(row)
    return out


@query("i13_score_given_posterior", f"""
WITH {POSTERIOR_PRED} SELECT round(sqrt(avg(pow(pm - required_surface_snr_dB, 2))), 5) AS rmse_dB, round(avg(abs(pm - required_surface_snr_dB)), 5) AS mae_dB,
  round(avg(CASE WHEN abs(pm - required_surface_snr_dB) <= pred_std THEN 1e0 ELSE 0e0 END), 6) AS coverage_1sigma, count(*) AS n_points, round(avg(pm - required_surface_snr_dB), 5) AS bias_dB
FROM pp2 WHERE is_test AND required_surface_snr_dB IS NOT NULL AND NOT coalesce(obs_margin_dB < 10, false)
""")
def i13(c):
    pts = c("split_fx").where(F.col("is_test") & F.col(TARGET).isNotNull() & F.col(THICKNESS).isNotNull() & ~qc.censored(F.col("obs_margin_dB"), 10.0))
    p = ft.predictions(pts, FIXED, fixed_fit(c), [TARGET])
    s = {**stats.score(F.col(TARGET), F.col("pred_mean"), F.col("pred_std")), "bias_dB": F.avg(F.col("pred_mean") - F.col(TARGET))}
    return p.agg(*[F.round(v, 6 if k == "coverage_1sigma" else 5).alias(k) if k != "n_points" else v.alias(k) for k, v in s.items()])


@query("d08_predictive_log_score")
def d08(c):
    rows = ft.training_rows(split_rows(c), FIXED, min_thickness_m=100.0).where(~F.col("is_nondetect"))
    f = fixed_fit(c)
    f.censor_below = 10.0
    return ft.log_scores(rows, FIXED, [f], held_out=False)


@query("d09_nondetection_log_score")
def d09(c):
    rows = train_rows(c)
    fits = ft.fit_all(rows, LINEAR, ft.cv_fits(fold_ids(c), 10.0, final=False), DETECT)
    return ft.log_scores(rows.where(F.col("is_nondetect")), LINEAR, fits)


@query("i14_mixture_probit")
def i14(c):
    t = analysis_population(c("traces_fx")).select("trace_id", "frame_id", "slow_time", "collection", "bed_power_dB", "post_bed_noise_interp_dB", "bed_pick_available")
    t = track.interpolate(t, "bed_power_dB", "bed_interp")
    det = qc.truth(F.col("bed_pick_available"))
    m = F.when(det, F.col("bed_power_dB")).otherwise(F.col("bed_interp")) - F.col("post_bed_noise_interp_dB")
    return detection.fit_mixture_probit(t.select("collection", m.alias("margin"), det.cast("int").alias("detected")), "collection", "margin", "detected")


def surface_channel(c, **kw):
    return exponent.prepare(c("sites_fx"), "r_surf", "surface_power_dB", exponent.GATED, exponent.with_clip_levels(c("clip_fx")), **kw)


@query("i15_range_exponent")
def i15(c):
    return exponent.fit_rows(c.spark, [("surface", exponent.fit_exponent(surface_channel(c), "surface_power_dB"), {})])


@query("i16_noise_pedestal_exponent")
def i16(c):
    d = exponent.prepare(c("sites_fx"), "r_bed_refr", "bed_power_dB", exponent.with_noise_floor)
    return exponent.fit_rows(c.spark, [("bed", exponent.fit_exponent(d, "bed_power_dB", censor=True), {})])


@query("i17_clip_level_exponent")
def i17(c):
    return exponent.fit_rows(c.spark, [("surface clipped", exponent.fit_exponent(surface_channel(c), "surface_power_dB", saturate=True), {})])


@query("i18_site_selection_robustness")
def i18(c):
    """{within, cross} x {>= 2, >= 3 levels} x {surface, bed}: one table of eight fits, one series of jobs."""
    t = c("sites_fx")
    seasons = t.select("site_id", "season").distinct().groupBy("site_id").agg(F.count(F.lit(1)).alias("n_seasons"))
    t = t.join(moved(seasons), "site_id")
    surface = exponent.prepare(t, "r_surf", "surface_power_dB", exponent.GATED, exponent.with_clip_levels(c("clip_fx"), 4.0))
    bed = exponent.prepare(t, "r_bed_refr", "bed_power_dB", exponent.with_noise_floor)
    chan = exponent.as_fit_rows(surface, "surface_power_dB").withColumn("channel", F.lit("surface")).unionByName(
        exponent.as_fit_rows(bed, "bed_power_dB", censor=True).withColumn("channel", F.lit("bed")))
    combos = [(scope, lev, ch) for scope in ("within", "cross") for lev in (2, 3) for ch in ("surface", "bed")]
    # A bit for each fit: a row is kept once, however many fits it takes part in.
    bits = [F.when((F.col("channel") == ch) & (F.col("levels") >= lev) & (F.lit(scope == "cross") | (F.col("n_seasons") == 1)), 1 << i).otherwise(0)
            for i, (scope, lev, ch) in enumerate(combos)]
    rows = cut_lineage(chan.withColumn("fits", sum(bits, F.lit(0).cast("bigint"))).drop("channel", "levels").where("fits <> 0"))
    fits = exponent.fit_exponents(rows, season_fits=[i for i, (s, _, _) in enumerate(combos) if s == "cross"])
    return exponent.fit_rows(c.spark, [
        (f"{ch} / {scope} / >={lev}", fits[i], {"channel": ch, "scope": scope, "min_levels": lev, "n_seasons_mixed_sites": fits[i].n_mixed})
        for i, (scope, lev, ch) in enumerate(combos) if i in fits])


@query("i19_synthetic_recovery")
def i19(c):
    sim = exponent.simulate_power(surface_channel(c))
    return exponent.fit_rows(c.spark, [("synthetic x = 2.5", exponent.fit_exponent(sim, "P_sim"), {})])


@query("i20_fit_summary")
def i20(c):
    f = exponent.fit_exponent(surface_channel(c), "surface_power_dB")
    row = f.row("surface")
    return c.spark.createDataFrame([(k, None if v is None else str(v)) for k, v in row.items()], "field string, value string")

"""Windows, ordered walks, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog.aggregates import LEVELS
from firnline.catalog.filters import FLAG_MEANINGS, PREPARED, analysis_population, truth_set  # noqa: F401
from firnline.catalog.registry import query
from firnline.catalog.scalars import RULE_HITS
from firnline.catalog.scans import rounded
from firnline.operators import ordering as od, qc, raster, stats, track
from firnline.operators.levels import site_levels
from firnline.plans import exponent, linkbudget as lb, sites, split
from firnline.schema import TARGET
from firnline.sources import traces


def interp_sql(col: str, need: int, out: str, digits: int = 6, scale: str = "1e0") -> str:
    return f"""
WITH p AS (SELECT trace_id, frame_id, {col} AS v, row_number() OVER (PARTITION BY frame_id ORDER BY slow_time, trace_id) AS pos,
    count({col}) OVER (PARTITION BY frame_id) AS known FROM {{traces_fx}} WHERE qc_surface_pass AND bed_pick_attempted),
q AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
    first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1 FROM p
  WINDOW b AS (PARTITION BY frame_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY frame_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT trace_id, round(CASE WHEN known >= {need} THEN CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END END * {scale}, {digits}) AS {out} FROM q
"""


@query("e01a_interpolated_bed_power", interp_sql("bed_power_dB", 2, "bed_power_interp"))
def e01a(c):
    t = analysis_population(c("traces_fx")).select("trace_id", "frame_id", "slow_time", "bed_power_dB")
    return rounded(track.interpolate(t, "bed_power_dB", "bed_power_interp").select("trace_id", "bed_power_interp"))


@query("e01b_interpolated_single_known", interp_sql("CASE WHEN trace_id % 40 = 1 THEN bed_power_dB END", 1, "bed_power_interp"))
def e01b(c):
    t = analysis_population(c("traces_fx")).select("trace_id", "frame_id", "slow_time", F.when(F.col("trace_id") % 40 == 1, F.col("bed_power_dB")).alias("v"))
    return rounded(track.interpolate(t, "v", "bed_power_interp", min_known=1).select("trace_id", "bed_power_interp"))


@query("e01c_interpolated_headroom", interp_sql("bed_twtt", 2, "bed_twtt_us", 5, "1e6"))
def e01c(c):
    t = analysis_population(c("traces_fx")).select("trace_id", "frame_id", "slow_time", "bed_twtt")
    return track.interpolate(t, "bed_twtt", "b").select("trace_id", F.round(F.col("b") * 1e6, 5).alias("bed_twtt_us"))


@query("e02_greedy_levels", f"WITH {LEVELS} SELECT site_id, n_levels FROM lv2")
def e02(c):
    return site_levels(c("sites_fx"), ["site_id"], "frame_id", "r_surf")


@query("e03_site_centred", f"""
WITH {PREPARED} SELECT w.trace_id, round(log10(r_surf), 6) AS logR, round(log10(r_surf) - avg(log10(r_surf)) OVER (PARTITION BY w.site_id), 6) AS clogR
FROM w JOIN lev ON w.site_id = lev.site_id WHERE n_lev >= 2
""")
def e03(c):
    d = exponent.prepare(c("sites_fx"), "r_surf", "surface_power_dB", exponent.GATED, exponent.with_clip_levels(c("clip_fx"), 4.0))
    return rounded(d.select("trace_id", "logR", "clogR"))


def with_ceiling(s, q=0.75):
    """Per-sheet quantile ceiling and the target cut at it."""
    top = od.exact_quantiles(s, ["ice_sheet"], TARGET, {"ceiling": q}).drop("n_values")
    return s.join(top, "ice_sheet").withColumns({
        "y_true": F.col(TARGET), "y_obs": F.least(F.col(TARGET), F.col("ceiling")), "censored": F.col(TARGET) > F.col("ceiling")})


@query("e04_artificial_censoring", """
WITH t AS (SELECT * FROM {split_fx} WHERE required_surface_snr_dB IS NOT NULL AND surface_v_m_yr IS NOT NULL AND bedmachine_thickness_m >= 100e0 AND fold >= 0 AND obs_margin_dB > 20e0),
q AS (SELECT ice_sheet, quantile_cont(required_surface_snr_dB, 0.75) AS ceiling FROM t GROUP BY ice_sheet)
SELECT grid_id, round(least(required_surface_snr_dB, ceiling), 6) AS y_obs, round(required_surface_snr_dB - ceiling, 9) > 0 AS censored FROM t JOIN q ON t.ice_sheet = q.ice_sheet
""")
def e04(c):
    s = with_ceiling(truth_set(c("split_fx")))
    return s.select("grid_id", F.round("y_obs", 6).alias("y_obs"), (F.round(F.col("y_true") - F.col("ceiling"), 9) > 0).alias("censored"))


@query("e05_levels_per_trace", f"WITH {LEVELS} SELECT s.trace_id, n_levels FROM {{sites_fx}} s JOIN lv2 ON s.site_id = lv2.site_id")
def e05(c):
    s = c("sites_fx").select("trace_id", "site_id", "frame_id", "r_surf")
    return s.join(site_levels(s, ["site_id"], "frame_id", "r_surf"), "site_id").select("trace_id", "n_levels")


@query("e06_thinned_draws", """
SELECT o_orderkey AS draw, o_totalprice AS value FROM {orders} WHERE o_orderkey % CAST(ceil((SELECT count(*) FROM {orders}) / 1000e0) AS BIGINT) = 0
""")
def e06(c):
    d = c("orders").select(F.col("o_orderkey").alias("draw"), F.col("o_totalprice").alias("value"))
    return stats.every_kth_draw(d, "draw", d.count())


@query("e07_fold_assignment", """
WITH n AS (SELECT cell_id, count(*) AS n_obs FROM {split_fx} WHERE required_surface_snr_dB IS NOT NULL AND NOT is_test GROUP BY cell_id),
o AS (SELECT cell_id, sum(n_obs) OVER (ORDER BY md5(concat('42:', cell_id)), cell_id) - n_obs AS before, sum(n_obs) OVER () AS total FROM n)
SELECT cell_id, CAST(floor(before * 5e0 / total) AS INTEGER) AS fold FROM o
""")
def e07(c):
    return split.assign_folds(split.cell_counts(c("split_fx")), 5, 42)


@query("e08_site_partition")
def e08(c):
    t = sites.in_height_window(c("traces_fx")).withColumn("h_agl", F.col("elevation") - F.col("surface_elevation"))
    return sites.partition_sites(t, ["sheet", "collection"])


BLOCKS = """
z AS (SELECT row, col, CASE WHEN value > 2 THEN 1 ELSE 0 END AS z FROM {raster_cells_fx} WHERE var = 'mask'),
b AS (SELECT a.row, a.col, a.z + 2 * p.z + 4 * r.z + 8 * q.z AS code FROM z a JOIN z p ON p.row = a.row AND p.col = a.col + 1
  JOIN z q ON q.row = a.row + 1 AND q.col = a.col JOIN z r ON r.row = a.row + 1 AND r.col = a.col + 1),
cr AS (SELECT row, col, code, (code & 1) <> ((code >> 1) & 1) AS t, ((code >> 1) & 1) <> ((code >> 2) & 1) AS r, ((code >> 2) & 1) <> ((code >> 3) & 1) AS b, ((code >> 3) & 1) <> (code & 1) AS l FROM b)
"""


@query("e09_mask_boundary", f"""
WITH {BLOCKS} SELECT row, col, CAST(code AS INTEGER) AS code, CAST(CASE WHEN t AND r AND b AND l THEN 2 ELSE 1 END AS BIGINT) AS n_segments,
  col * 2 + CASE WHEN t AND r AND b AND l THEN 2 * col + 2e0 ELSE (CASE WHEN t THEN 0.5e0 ELSE 0 END) + (CASE WHEN r THEN 1e0 ELSE 0 END) + (CASE WHEN b THEN 0.5e0 ELSE 0 END) END AS x_sum
FROM cr WHERE t OR r OR b OR l
""")
def e09(c):
    cells = c("raster_cells_fx").where("raster_id = 'bed' and var = 'mask'").select("row", "col", "value")
    seg = raster.boundary_segments(cells, F.col("value") > 2)
    return seg.groupBy("row", "col", F.col("code").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("x0") + F.col("x1")).alias("x_sum"))


@query("e10_strided_index", """
SELECT grid_id, CAST(floor(grid_ix / 4e0) AS INTEGER) AS jx, CAST(floor(grid_iy / 4e0) AS INTEGER) AS jy FROM {grid_fx} WHERE grid_ix % 4 = 0 AND grid_iy % 4 = 0
""")
def e10(c):
    return c("grid_fx").where("grid_ix % 4 = 0 and grid_iy % 4 = 0").select(
        "grid_id", F.expr("grid_ix div 4").cast("int").alias("jx"), F.expr("grid_iy div 4").cast("int").alias("jy"))


@query("f01_first_traces", "SELECT trace_id, frame_id FROM {traces_fx} ORDER BY trace_id LIMIT 500")
def f01(c):
    return traces.first_traces(c("traces_fx"), 500).select("trace_id", "frame_id")


@query("f02_ordered_outputs", """
SELECT ice_sheet, collection, count(*) AS n FROM {split_fx} WHERE collection IS NOT NULL GROUP BY ice_sheet, collection ORDER BY ice_sheet, collection
""")
def f02(c):
    return c("split_fx").where("collection is not null").groupBy("ice_sheet", "collection").agg(F.count(F.lit(1)).alias("n")).orderBy("ice_sheet", "collection")


@query("f03_top_dropped_seasons", """
SELECT s.season, count(*) AS n FROM (SELECT *, regexp_replace(frame_id, '_[^_]*$', '') AS segment FROM {sites_fx}) s JOIN {clip_fx} c ON s.season = c.season AND s.segment = c.segment
WHERE c.S_dB - s.surface_power_dB < 10 GROUP BY s.season ORDER BY n DESC, s.season LIMIT 3
""")
def f03(c):
    return exponent.near_clip_by_season(c("sites_fx"), "surface_power_dB", c("clip_fx"), 10.0)


@query("f04_panels_by_count", """
SELECT name, n, CAST(row_number() OVER (ORDER BY is_all DESC, n DESC, name) AS INTEGER) AS panel FROM (
SELECT coalesce(n_name, 'All') AS name, count(*) AS n, CASE WHEN n_name IS NULL THEN 1 ELSE 0 END AS is_all FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)) q
""")
def f04(c):
    from pyspark.sql import Window as W
    j = c("customer").join(c("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per = j.rollup("n_name").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("n_name", F.lit("All")).alias("name"), "n", F.col("n_name").isNull().alias("is_all"))
    # One row per panel, so the window is over a handful of rows.
    w = W.partitionBy(F.lit(0)).orderBy(F.col("is_all").desc(), F.col("n").desc(), "name")
    return per.select("name", "n", F.row_number().over(w).alias("panel")).orderBy("panel")


@query("f05_errors_before_warnings", f"""
WITH {RULE_HITS}
SELECT scenario_id, split_part(h, '|', 3) AS id, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY split_part(h, '|', 2), split_part(h, '|', 3)) AS INTEGER) AS position
FROM r WHERE h IS NOT NULL ORDER BY scenario_id, position
""")
def f05(c):
    return lb.check(lb.scalars(c("scenarios_fx"))).select("scenario_id", "id", F.col("position").cast("int").alias("position")).orderBy("scenario_id", "position")


@query("g01_union_all", """
SELECT 'antarctic' AS sheet, count(*) AS n, CAST(sum(trace_id) AS BIGINT) AS ids FROM {traces_fx} WHERE sheet = 'antarctic'
UNION ALL SELECT 'greenland', count(*), CAST(sum(trace_id) AS BIGINT) FROM {traces_fx} WHERE sheet = 'greenland'
""")
def g01(c):
    t = c("traces_fx").select("trace_id", "sheet")
    both = t.where("sheet = 'antarctic'").unionByName(t.where("sheet = 'greenland'"))
    return both.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.sum("trace_id").alias("ids"))


@query("g02_set_difference", """
SELECT DISTINCT concat('ant:', CAST(p_size - 50 AS VARCHAR), ':', CAST(p_partkey % 9 - 61 AS VARCHAR)) AS cell_id FROM {part}
WHERE concat('ant:', CAST(p_size - 50 AS VARCHAR), ':', CAST(p_partkey % 9 - 61 AS VARCHAR)) NOT IN (SELECT cell_id FROM {split_fx})
""")
def g02(c):
    wanted = c("part").select(F.concat(F.lit("ant:"), (F.col("p_size") - 50).cast("string"), F.lit(":"), (F.col("p_partkey") % 9 - 61).cast("string")).alias("cell_id")).distinct()
    return wanted.join(c("split_fx").select("cell_id").distinct(), "cell_id", "left_anti")


@query("g03_distinct_seasons", "SELECT DISTINCT collection FROM {traces_fx} ORDER BY collection")
def g03(c):
    return c("traces_fx").select("collection").distinct().orderBy("collection")


@query("g04_one_row_per_site", "SELECT DISTINCT site_id FROM {sites_fx}")
def g04(c):
    return c("sites_fx").dropDuplicates(["site_id"]).select("site_id")

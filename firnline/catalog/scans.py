"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog.registry import query
from firnline.functions import radio
from firnline.operators import raster
from firnline.plans import augment, lineage
from firnline.session import new_path
from firnline.sources import covariates, stages, traces

R3, R6 = 3, 6


def rounded(df, digits=6, keep=()):
    """Doubles rounded so both engines print the same digits."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") and n not in keep else F.col(f"`{n}`") for n, t in df.dtypes])


@query("a01_pinned_trace_read", """
SELECT trace_id, collection, bed_power_dB, qc_pass FROM {traces_fx} WHERE snapshot_id = 'snap-a'
""")
def a01(c):
    return traces.pinned(c("traces_fx"), "snap-a").select("trace_id", "collection", "bed_power_dB", "qc_pass")


@query("a02_resolve_snapshot", """
SELECT branch, snapshot_id FROM (SELECT branch, snapshot_id, row_number() OVER (PARTITION BY branch ORDER BY committed_at DESC, snapshot_id DESC) rn
FROM {snapshots_fx} WHERE branch = 'main') t WHERE rn = 1
""")
def a02(c):
    return traces.resolve_snapshot(c("snapshots_fx"), "main")


@query("a03_carried_columns", """
SELECT trace_id, frame_id, elevation, surface_power_dB, qc_pass, img_comb_offset_dB FROM {traces_fx}
""")
def a03(c):
    return traces.carried(c("traces_fx"), ["frame_id", "elevation", "surface_power_dB", "absent_column", "qc_pass", "img_comb_offset_dB"], ["trace_id"])


@query("a04_decode_time", """
SELECT trace_id, CAST(strftime(make_timestamp(CAST(round((time_s + 1388534400e0) * 1e6) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS VARCHAR) AS decoded
FROM {traces_fx}
""")
def a04(c):
    t = traces.decode_time(F.col("time_s"), 1388534400.0)
    return c("traces_fx").select("trace_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("decoded"))


@query("a05_season_by_index", """
WITH seasons AS (SELECT CAST(n_nationkey AS INTEGER) AS frame_index, n_name AS season FROM {nation} WHERE n_nationkey < 4)
SELECT t.trace_id, coalesce(s.season, '') AS collection FROM {traces_fx} t LEFT JOIN seasons s ON t.frame_index = s.frame_index
""")
def a05(c):
    seasons = c("nation").where("n_nationkey < 4").select(F.col("n_nationkey").cast("int").alias("frame_index"), F.col("n_name").alias("collection"))
    return traces.with_season(c("traces_fx").select("trace_id", "frame_index"), seasons).select("trace_id", "collection")


@query("a06_pooled_stores", """
SELECT 'antarctica' AS store, trace_id, bed_power_dB, CAST(NULL AS BOOLEAN) AS bed_pick_available FROM {traces_fx} WHERE sheet = 'antarctic'
UNION ALL SELECT 'greenland', trace_id, bed_power_dB, bed_pick_available FROM {traces_fx} WHERE sheet = 'greenland'
""")
def a06(c):
    t = c("traces_fx")
    return traces.pool({
        "antarctica": t.where("sheet = 'antarctic'").select("trace_id", "bed_power_dB"),
        "greenland": t.where("sheet = 'greenland'").select("trace_id", "bed_power_dB", "bed_pick_available"),
    }).select("store", "trace_id", "bed_power_dB", "bed_pick_available")


# Projection and bilinear weights of the trace positions, written out for the checking engine.
XY3031 = """
xy AS (
  SELECT trace_id, rho * sin(radians(longitude)) AS px, rho * cos(radians(longitude)) AS py FROM (
    SELECT trace_id, longitude, latitude, 6378137e0 * mts / tts * tan(pi() / 4 + radians(latitude) / 2)
        * pow((1 - e * sin(radians(latitude))) / (1 + e * sin(radians(latitude))), e / 2) AS rho
    FROM {traces_fx} CROSS JOIN (
      SELECT e, cos(radians(71e0)) / sqrt(1 - e * e * pow(sin(radians(71e0)), 2)) AS mts,
        tan(pi() / 4 - radians(71e0) / 2) * pow((1 + e * sin(radians(71e0))) / (1 - e * sin(radians(71e0))), e / 2) AS tts
      FROM (SELECT sqrt(2 / 298.257223563e0 - pow(1 / 298.257223563e0, 2)) AS e) q) k) r)
"""


def sampled(var: str, edge: str = "centre", raster_id: str | None = None) -> str:
    """CTE text: bilinear value of one layer at every trace."""
    rid = f"AND c.raster_id = '{raster_id}'" if raster_id else ""
    rid_m = f"AND raster_id = '{raster_id}'" if raster_id else ""
    base = "greatest(least(floor(fc), nx - 2), 0)" if edge == "centre" else "floor(fc)"
    base_r = "greatest(least(floor(fr), ny - 2), 0)" if edge == "centre" else "floor(fr)"
    ok = "WHERE fc >= 0 AND fc <= nx - 1 AND fr >= 0 AND fr <= ny - 1" if edge == "centre" else ""
    return f"""
pos_{var} AS (SELECT trace_id, fc, fr, CAST({base} AS BIGINT) AS c0, CAST({base_r} AS BIGINT) AS r0 FROM (
  SELECT trace_id, (px - x0) / dx AS fc, (py - y0) / dy AS fr, nx, ny FROM xy CROSS JOIN (SELECT * FROM {{raster_meta_fx}} WHERE var = '{var}' {rid_m}) m) p {ok}),
s_{var} AS (SELECT p.trace_id, CASE WHEN count(c.value) = 4 THEN
    sum(c.value * (CASE WHEN c.col = c0 THEN 1 - (fc - c0) ELSE fc - c0 END) * (CASE WHEN c.row = r0 THEN 1 - (fr - r0) ELSE fr - r0 END)) END AS value
  FROM pos_{var} p JOIN {{raster_cells_fx}} c ON c.var = '{var}' {rid} AND c.col IN (c0, c0 + 1) AND c.row IN (r0, r0 + 1) AND c.value <> -9999
  GROUP BY p.trace_id)
"""


def polar_sql(src: str, key: str, lat_ts: float, lon0: float, sign: int) -> str:
    """Projected positions of the rows of src, written out for the checking engine."""
    p, tsr = f"radians({sign} * latitude)", f"radians({abs(lat_ts)})"
    return f"""SELECT {key}, rho * sin(radians(longitude) - radians({lon0})) AS px, {-sign} * rho * cos(radians(longitude) - radians({lon0})) AS py FROM (
  SELECT {key}, longitude, 6378137e0 * m / t0 * tan(pi() / 4 - {p} / 2) * pow((1 + e * sin({p})) / (1 - e * sin({p})), e / 2) AS rho
  FROM {src} CROSS JOIN (SELECT e, cos({tsr}) / sqrt(1 - e * e * pow(sin({tsr}), 2)) AS m, tan(pi() / 4 - {tsr} / 2) * pow((1 + e * sin({tsr})) / (1 - e * sin({tsr})), e / 2) AS t0
    FROM (SELECT sqrt(2 / 298.257223563e0 - pow(1 / 298.257223563e0, 2)) AS e) q) k) r"""


def sheet_positions(src: str) -> str:
    """CTEs at_antarctic, at_greenland and at_all: projected positions of the rows of each sheet, and degrees of all."""
    south = polar_sql(f"(SELECT * FROM {src} WHERE ice_sheet = 'antarctic') g", "trace_id", -71.0, 0.0, -1)
    north = polar_sql(f"(SELECT * FROM {src} WHERE ice_sheet = 'greenland') g", "trace_id", 70.0, -45.0, 1)
    return f"at_antarctic AS ({south}),\nat_greenland AS ({north}),\nat_all AS (SELECT trace_id, longitude AS px, latitude AS py FROM {src})"


def sampled_on(name: str, at: str, raster_id: str, var: str, edge: str = "centre", nearest: bool = False, meta: str = "{sheet_meta_fx}", cells: str = "{sheet_cells_fx}") -> str:
    """CTE text: value of one layer at the positions of ``at``, as (trace_id, value)."""
    pos = f"""p_{name} AS (SELECT trace_id, (px - x0) / dx AS fc, (py - y0) / dy AS fr, nx, ny, nodata FROM {at} CROSS JOIN (SELECT * FROM {meta} WHERE raster_id = '{raster_id}' AND var = '{var}') m)"""
    inside = "fc >= 0 AND fc <= nx - 1 AND fr >= 0 AND fr <= ny - 1" if edge == "centre" else "true"
    layer = f"(SELECT * FROM {cells} WHERE raster_id = '{raster_id}' AND var = '{var}') c"
    if nearest:
        near = (lambda f: f"ceil({f} - 0.5e0)") if edge == "centre" else (lambda f: f"round_even({f}, 0)")
        return f"""{pos},
{name} AS (SELECT p.trace_id, c.value FROM p_{name} p JOIN {layer} ON c.col = CAST({near('fc')} AS BIGINT) AND c.row = CAST({near('fr')} AS BIGINT) AND coalesce(c.value <> p.nodata, true) WHERE {inside})"""
    low = (lambda f, n: f"greatest(least(floor({f}), {n} - 2), 0)") if edge == "centre" else (lambda f, n: f"floor({f})")
    return f"""{pos},
q_{name} AS (SELECT *, CAST({low('fc', 'nx')} AS BIGINT) AS c0, CAST({low('fr', 'ny')} AS BIGINT) AS r0 FROM p_{name} WHERE {inside}),
{name} AS (SELECT p.trace_id, sum(c.value * (CASE WHEN c.col = c0 THEN 1 - (fc - c0) ELSE fc - c0 END) * (CASE WHEN c.row = r0 THEN 1 - (fr - r0) ELSE fr - r0 END)) AS value
  FROM q_{name} p JOIN {layer} ON c.col IN (c0, c0 + 1) AND c.row IN (r0, r0 + 1) AND coalesce(c.value <> p.nodata, true) GROUP BY p.trace_id HAVING count(c.value) = 4)"""


@query("a07_bed_layers", f"""
WITH {XY3031}, {sampled('bed')}, {sampled('thickness')}
SELECT t.trace_id, round(b.value, 5) AS bedmachine_bed_m, round(h.value, 5) AS bedmachine_thickness_m
FROM {{traces_fx}} t LEFT JOIN s_bed b ON t.trace_id = b.trace_id LEFT JOIN s_thickness h ON t.trace_id = h.trace_id
""")
def a07(c):
    meta = c("raster_meta_fx").where("var in ('bed', 'thickness')")
    out = covariates.attach(c("traces_fx").select("trace_id", "longitude", "latitude"), "bedmachine", meta, c("raster_cells_fx"), "trace_id")
    return rounded(out.select("trace_id", "bedmachine_bed_m", "bedmachine_thickness_m"), 5)


@query("a08_velocity_bands", f"""
WITH {XY3031}, {sampled('v', 'pixel')}, {sampled('v_error', 'pixel')}
SELECT t.trace_id, round(a.value, 6) AS surface_v_m_yr, round(b.value, 6) AS surface_v_error_m_yr
FROM {{traces_fx}} t LEFT JOIN s_v a ON t.trace_id = a.trace_id LEFT JOIN s_v_error b ON t.trace_id = b.trace_id
""")
def a08(c):
    out = covariates.attach(c("traces_fx").select("trace_id", "longitude", "latitude"), "itslive", c("raster_meta_fx"), c("raster_cells_fx"), "trace_id")
    return rounded(out.select("trace_id", "surface_v_m_yr", "surface_v_error_m_yr"))


@query("a09_vector_velocity", f"""
WITH {XY3031}, {sampled('vx')}, {sampled('vy')}, {sampled('errx')}, {sampled('erry')}
SELECT t.trace_id, round(sqrt(x.value * x.value + y.value * y.value), 6) AS surface_v_m_yr,
  round(CASE WHEN sqrt(x.value * x.value + y.value * y.value) > 0
    THEN sqrt(pow(x.value * ex.value, 2) + pow(y.value * ey.value, 2)) / sqrt(x.value * x.value + y.value * y.value)
    ELSE sqrt(pow(ex.value, 2) + pow(ey.value, 2)) END, 6) AS surface_v_error_m_yr
FROM {{traces_fx}} t LEFT JOIN s_vx x ON t.trace_id = x.trace_id LEFT JOIN s_vy y ON t.trace_id = y.trace_id
LEFT JOIN s_errx ex ON t.trace_id = ex.trace_id LEFT JOIN s_erry ey ON t.trace_id = ey.trace_id
""")
def a09(c):
    out = covariates.attach(c("traces_fx").select("trace_id", "longitude", "latitude"), "measures_vel", c("raster_meta_fx"), c("raster_cells_fx"), "trace_id")
    return rounded(out.select("trace_id", "surface_v_m_yr", "surface_v_error_m_yr"))


@query("a10_heat_flow", f"""
WITH {XY3031}, {sampled('HF')}, {sampled('HFmin')}, {sampled('HFmax')}
SELECT t.trace_id, round(a.value * 1000, 5) AS ghf_mW_m2, round(b.value * 1000, 5) AS ghf_min_mW_m2, round(d.value * 1000, 5) AS ghf_max_mW_m2
FROM {{traces_fx}} t LEFT JOIN s_HF a ON t.trace_id = a.trace_id LEFT JOIN s_HFmin b ON t.trace_id = b.trace_id LEFT JOIN s_HFmax d ON t.trace_id = d.trace_id
""")
def a10(c):
    out = covariates.attach(c("traces_fx").select("trace_id", "longitude", "latitude"), "ghf", c("raster_meta_fx"), c("raster_cells_fx"), "trace_id")
    return rounded(out.select("trace_id", "ghf_mW_m2", "ghf_min_mW_m2", "ghf_max_mW_m2"), 5)


# The mean field of the climatology as a raster of degrees, its seam closed.
MEAN_FIELD = """
f AS (SELECT CASE WHEN longitude >= 180 THEN longitude - 360 ELSE longitude END AS x, latitude AS y, avg(t2m) AS value FROM {climatology_fx} GROUP BY 1, 2),
closed AS (SELECT x, y, value FROM f UNION ALL SELECT 180e0, y, value FROM f WHERE x = -180 AND y NOT IN (SELECT y FROM f WHERE x >= 180)),
mean_meta AS (SELECT 'temperature' AS raster_id, 't2m' AS var, min(x) AS x0, (max(x) - min(x)) / greatest(count(DISTINCT x) - 1, 1) AS dx, count(DISTINCT x) AS nx,
  min(y) AS y0, (max(y) - min(y)) / greatest(count(DISTINCT y) - 1, 1) AS dy, count(DISTINCT y) AS ny, CAST(NULL AS DOUBLE) AS nodata FROM closed),
mean_cells AS (SELECT 'temperature' AS raster_id, 't2m' AS var, CAST(round((x - x0) / dx) AS BIGINT) AS col, CAST(round((y - y0) / dy) AS BIGINT) AS row, value FROM closed CROSS JOIN mean_meta)
"""


@query("a11_climatology_source", f"""
WITH {MEAN_FIELD}, {sheet_positions('{places_fx}')}, {sampled_on('t', 'at_all', 'temperature', 't2m', meta='mean_meta', cells='mean_cells')}
SELECT p.trace_id, round(t.value + 1e-9, 6) AS era5_t2m_mean_K FROM {{places_fx}} p LEFT JOIN t ON p.trace_id = t.trace_id
""")
def a11(c):
    meta, cells = covariates.climatology_raster(c("climatology_fx"))
    out = covariates.attach(c("places_fx").select("trace_id", "longitude", "latitude"), "era5", meta, cells, "trace_id")
    # Many places have short weights, so halves occur: a nudge sends them one way on both sides.
    return out.select("trace_id", F.round(F.col("era5_t2m_mean_K") + 1e-9, 6).alias("era5_t2m_mean_K"))


@query("a12_write_trace_table", """
SELECT trace_id, collection, bed_power_dB, substr(sha256(concat('snap-asnap-b', sha256('{{"store": "antarctica"}}'))), 1, 12) AS run_id FROM {traces_fx}
""")
def a12(c):
    path = new_path(c.spark, "traces")
    m = lineage.manifest("augment", {"store": "antarctica"}, ["snap-b", "snap-a"])
    stages.write_stage(c("traces_fx").select("trace_id", "collection", "bed_power_dB"), m, path, ["collection"])
    return c.spark.read.parquet(path).withColumn("run_id", F.lit(stages.read_run_id(c.spark, path)))


@query("a13_write_stage_table", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(grid_ix) AS BIGINT) AS sum_ix FROM {grid_fx}")
def a13(c):
    path = new_path(c.spark, "grid")
    m = lineage.manifest("grid", {"stride": 1}, ["snap-b"])
    stages.write_stage(c("grid_fx").withColumn("run_id", F.lit(m["run_id"])), m, path)
    return c.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("grid_ix").cast("long").alias("sum_ix"))


@query("a14_read_manifest", """
WITH d AS (SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 11 = 5 THEN 'absent' WHEN s_suppkey % 9 = 4 THEN 'corrupt' WHEN s_suppkey % 7 = 3 THEN 'unasked' ELSE 'ok' END AS state, s_name FROM {supplier})
SELECT doc_id, state, CASE WHEN state IN ('ok', 'unasked') THEN substr(sha256(concat(CAST(doc_id AS VARCHAR), s_name)), 1, 12) END AS run_id,
  CASE WHEN state IN ('ok', 'unasked') THEN CASE WHEN doc_id % 2 = 0 THEN 'grid' ELSE 'augment' END END AS stage, CASE WHEN state IN ('ok', 'unasked') THEN CAST(doc_id % 4 AS INTEGER) END AS n_inputs
FROM d
""")
def a14(c):
    """Manifests in files of their own, some cut off or missing, and one that nobody asked for in seven."""
    key = F.col("s_suppkey")
    inputs = F.transform(F.slice(F.array(*[F.lit(f"snap-{i}") for i in range(4)]), F.lit(1), (key % 4).cast("int")), lambda v: F.concat(v, key.cast("string")))
    document = F.to_json(F.struct(
        F.substring(F.sha2(F.concat(key.cast("string"), "s_name"), 256), 1, 12).alias("run_id"),
        F.when(key % 2 == 0, "grid").otherwise("augment").alias("stage"), inputs.alias("inputs")), {"pretty": "true"})
    text = F.when(key % 9 == 4, F.expr("left(d, length(d) - 5)")).otherwise(F.col("d"))
    docs = c("supplier").where(key % 11 != 5).withColumn("d", document).select(key.alias("doc_id"), text.alias("value"))
    path = stages.write_documents(docs, new_path(c.spark, "manifests"))
    broken = (key % 11 == 5) | (key % 9 == 4)
    wanted = c("supplier").where(broken | (key % 7 != 3)).select(key.alias("doc_id"))
    found = stages.read_documents(c.spark, path, "run_id string, stage string, inputs array<string>", wanted)
    return found.select("doc_id", "state", "run_id", "stage", F.when(F.col("inputs").isNotNull(), F.size("inputs")).alias("n_inputs"))


@query("a15_csv_round_trip", """
SELECT trace_id, collection, bed_power_dB FROM {traces_fx} WHERE bed_power_dB IS NOT NULL
""")
def a15(c):
    t = c("traces_fx").where("bed_power_dB is not null").select("trace_id", "collection", "bed_power_dB", F.lit("POINT").alias("geometry"))
    path = stages.to_csv(t, new_path(c.spark, "csv"), "0123456789ab")
    return stages.read_csv(c.spark, path, "trace_id long, collection string, bed_power_dB double")


@query("a16_external_csv", """
SELECT x, y, snr_pred, mask FROM {external_fx}
""")
def a16(c):
    path = new_path(c.spark, "external")
    c("external_fx").select("x", "y", "snr_pred", "mask").write.option("header", True).csv(path)
    return stages.read_csv(c.spark, path, "x double, y double, snr_pred double, mask double")


@query("a17_pair_table_csv", """
SELECT a.season AS row_season, count(*) AS n_segments FROM {segments_fx} a GROUP BY a.season
""")
def a17(c):
    path = new_path(c.spark, "pairs")
    c("segments_fx").groupBy(F.col("season").alias("row_season")).agg(F.count(F.lit(1)).alias("n_segments")).write.option("header", True).csv(path)
    return stages.read_csv(c.spark, path, "row_season string, n_segments long")


@query("a18_dense_layers", """
WITH geom AS (SELECT ice_sheet, max(grid_iy) + 1 AS ny, 125 AS nx FROM {split_fx} GROUP BY ice_sheet),
frame AS (SELECT ice_sheet, CAST(iy AS INTEGER) AS grid_iy, CAST(ix AS INTEGER) AS grid_ix FROM geom, range(0, (SELECT max(ny) FROM geom)) a(iy), range(0, 125) b(ix) WHERE iy < ny)
SELECT f.ice_sheet, f.grid_iy, f.grid_ix, round(CAST(CAST(p.pred_mean AS FLOAT) AS DOUBLE), 3) AS pred_mean,
  CAST(coalesce(CASE WHEN s.is_test THEN 100 ELSE s.fold END, -1) AS INTEGER) AS fold
FROM frame f LEFT JOIN {split_fx} s ON f.ice_sheet = s.ice_sheet AND f.grid_iy = s.grid_iy AND f.grid_ix = s.grid_ix
LEFT JOIN {predictions_fx} p ON s.grid_id = p.grid_id
""")
def a18(c):
    s = c("split_fx").join(c("predictions_fx").select("grid_id", "pred_mean"), "grid_id")
    geom = s.groupBy("ice_sheet").agg((F.max("grid_iy") + 1).alias("ny"), F.lit(125).alias("nx"))
    out = raster.dense_layers(s, geom, {"pred_mean": "pred_mean"})
    return out.select("ice_sheet", "grid_iy", "grid_ix", F.round(F.col("pred_mean").cast("double"), 3).alias("pred_mean"), "fold")


@query("a19_packed_cells", """
SELECT CAST(floor(g.grid_iy / 2e0) AS BIGINT) * 63 + CAST(floor(g.grid_ix / 2e0) AS BIGINT) AS idx,
  CAST(trunc(least(greatest(g.bedmachine_thickness_m, 0e0), 65535e0)) AS INTEGER) AS thk,
  CAST(trunc(least(greatest(p.pred_mean * 10e0, -32768e0), 32767e0)) AS INTEGER) AS mu,
  CAST(trunc(least(greatest(p.pred_std * 4e0, 0e0), 255e0)) AS INTEGER) AS sd, CAST(g.bedmachine_mask AS INTEGER) AS mask
FROM {grid_fx} g JOIN {predictions_fx} p ON g.grid_id = p.grid_id
WHERE g.grid_ix % 2 = 0 AND g.grid_iy % 2 = 0 AND g.bedmachine_thickness_m IS NOT NULL AND p.pred_mean IS NOT NULL AND g.bedmachine_mask > 0
ORDER BY idx
""")
def a19(c):
    pts = c("grid_fx").join(c("predictions_fx").select("grid_id", "pred_mean", "pred_std"), "grid_id")
    return raster.packed_cells(pts, 125, stride=2).orderBy("idx")


@query("a20_benchmark_table", """
SELECT model, round_even(rmse_mean, 3) AS cv_rmse_dB, round_even(rmse_min, 3) AS cv_rmse_min, round_even(rmse_max, 3) AS cv_rmse_max,
  round_even(mae_mean, 3) AS cv_mae_dB, round_even(coverage_mean, 3) AS cv_coverage_1sigma, round_even(logscore_mean, 3) AS cv_logscore_dB,
  censored, round_even(test_rmse, 3) AS test_rmse_dB, CAST(n_points AS BIGINT) AS n_train, run_id
FROM {metrics_fx} ORDER BY cv_rmse_dB
""")
def a20(c):
    m = c("metrics_fx")
    st = lambda **k: F.struct(*[F.col(v).alias(n) for n, v in k.items()])
    docs = m.select("model", F.to_json(F.struct(
        "model", "run_id",
        F.struct(st(mean="rmse_mean", min="rmse_min", max="rmse_max").alias("rmse_dB"), st(mean="mae_mean").alias("mae_dB"),
                 st(mean="coverage_mean").alias("coverage_1sigma"),
                 F.when(F.col("logscore_mean").isNotNull(), st(mean="logscore_mean")).alias("logscore_dB"),
                 F.col("n_points").alias("n_points")).alias("pooled_cv"),
        F.struct(F.col("censored").alias("enabled")).alias("censoring"),
        F.when(F.col("test_rmse").isNotNull(), st(rmse_dB="test_rmse")).alias("test"))).alias("doc"))
    # One file of documents per model and task, read back by path.
    path = new_path(c.spark, "metrics")
    docs.select("model", F.col("doc").alias("value")).write.partitionBy("model").text(path)
    return stages.benchmark_rows(c.spark.read.schema(stages.METRICS_SCHEMA).option("pathGlobFilter", "*.txt").json(f"{path}/*"))


@query("a21_source_labels", """
SELECT doc_id, replace(CASE WHEN name LIKE 'bedmachine\\_antarctic%' ESCAPE '\\' THEN 'BedMachine Antarctica v{{version}}'
  WHEN name LIKE 'bedmachine\\_greenland%' ESCAPE '\\' THEN 'BedMachine Greenland v{{version}}'
  WHEN starts_with(name, 'measures_phase_vel_antarctic') THEN 'MEaSUREs phase-based ice velocity'
  WHEN starts_with(name, 'itslive_greenland') THEN 'ITS_LIVE ice velocity v{{version}}' WHEN starts_with(name, 'era5_t2m') THEN 'ERA5 2 m air temperature ({{version}})'
  WHEN starts_with(name, 'ghf_antarctic') THEN 'Geothermal heat flow, Antarctica' WHEN starts_with(name, 'ghf_greenland') THEN 'Geothermal heat flow, Greenland'
  ELSE name END, '{{version}}', coalesce(version, '')) AS label
FROM {datasets_fx}
""")
def a21(c):
    return c("datasets_fx").select("doc_id", stages.source_labels(F.col("name"), F.col("version")).alias("label"))


@query("a22_augment_stage", f"""
WITH {XY3031}, {sampled('bed')}, {sampled('thickness')}, {sampled('vx')}, {sampled('vy')}, {sampled('HF')}
SELECT t.trace_id, t.collection, t.bed_power_dB, round(b.value, 5) AS bedmachine_bed_m, round(h.value, 5) AS bedmachine_thickness_m, round(sqrt(x.value * x.value + y.value * y.value), 5) AS surface_v_m_yr,
  round(g.value * 1000, 5) AS ghf_mW_m2, substr(sha256(concat('snap-b', sha256('{{{{"products": ["bedmachine", "measures_vel", "ghf"]}}}}'))), 1, 12) AS run_id
FROM {{traces_fx}} t LEFT JOIN s_bed b ON t.trace_id = b.trace_id LEFT JOIN s_thickness h ON t.trace_id = h.trace_id
LEFT JOIN s_vx x ON t.trace_id = x.trace_id LEFT JOIN s_vy y ON t.trace_id = y.trace_id LEFT JOIN s_HF g ON t.trace_id = g.trace_id
WHERE t.snapshot_id = 'snap-b' AND t.qc_pass AND coalesce(t.surface_elevation - t.bed_elevation >= 100, true)
""")
def a22(c):
    """The whole stage: pinned traces, quality and thickness, all products of the sheet, written with its manifest and read back."""
    products = ["bedmachine", "measures_vel", "ghf"]
    out = augment.augment(c("traces_fx"), "snap-b", products, "antarctic", c("raster_meta_fx"), c("raster_cells_fx"), min_thickness_m=100.0)
    path = new_path(c.spark, "augmented")
    augment.write_augmented(out, path, {"products": products}, ["snap-b"])
    return rounded(c.spark.read.parquet(path).select(
        "trace_id", "collection", "bed_power_dB", "bedmachine_bed_m", "bedmachine_thickness_m", "surface_v_m_yr", "ghf_mW_m2", "run_id"), 5, keep=("bed_power_dB",))

"""Input relations derived from the given tables.

The same text runs in Spark SQL and in the checking engine.  Every relation
reads a given table (``{name}``), so its size follows that table; columns come
from integer arithmetic on ids, which both engines compute exactly.
"""

def spread(alias: str, columns: str, *rows: str) -> str:
    """A short list of literal rows beside every row of the relation before it.

    Written as an exploded literal array in Spark (no join) and as a VALUES list
    in the checking engine; the registry picks the form.
    """
    return "@@" + "|".join([alias, columns, *rows]) + "@@"


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]

RELATIONS: dict[str, str] = {}

# Traces: one per event, on eight-trace lines 2.5 km apart, five seasons, frames per user.
RELATIONS["traces_fx"] = """
SELECT event_id AS trace_id,
  CASE event_type WHEN 'click' THEN '2014_Antarctica_DC8' WHEN 'error' THEN '2016_Antarctica_BaslerJKB'
    WHEN 'purchase' THEN '2017_Antarctica_Basler' WHEN 'signup' THEN '2017_Greenland_P3'
    ELSE '2019_Antarctica_GV' END AS collection,
  CASE event_type WHEN 'signup' THEN 'greenland' ELSE 'antarctic' END AS sheet,
  CASE event_type WHEN 'signup' THEN 'greenland' ELSE 'antarctic' END AS ice_sheet,
  CASE event_id % 7 WHEN 0 THEN 'snap-a' ELSE 'snap-b' END AS snapshot_id,
  CAST(event_id % 6 AS INT) AS frame_index,
  concat('Data_', CAST(20140101 + user_id % 9 AS STRING), '_',
         lpad(CAST(user_id % 7 AS STRING), 2, '0'), '_', lpad(CAST(user_id AS STRING), 6, '0')) AS frame_id,
  ts AS slow_time,
  event_id * 1e0 + 0.5e0 AS time_s,
  -1200000e0 + (CAST(floor(event_id / 8e0) AS BIGINT) % 100) * 2500 + ((event_id * 7919) % 1201) AS x,
  -300000e0 + floor(CAST(floor(event_id / 8e0) AS BIGINT) / 100e0) * 2500 + ((event_id * 104729) % 1201) AS y,
  -110e0 + ((event_id * 7919) % 10007) / 1000e0 AS longitude,
  -75e0 + ((event_id * 104729) % 10007) / 10000e0 AS latitude,
  1500e0 + (event_id * 17) % 900 + 400e0 + (event_id * 1301) % 9000 AS elevation,
  1500e0 + (event_id * 17) % 900 AS surface_elevation,
  CASE WHEN event_id % 47 = 0 THEN NULL ELSE 1500e0 + (event_id * 17) % 900 - (event_id * 37) % 3500 END AS bed_elevation,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE -100e0 + ((event_id * 31) % 400) / 10e0 END AS bed_power_dB,
  -100e0 + ((event_id * 7) % 50) / 10e0 AS post_bed_noise_dB,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE -101e0 + ((event_id * 11) % 60) / 10e0 END AS post_bed_noise_interp_dB,
  -95e0 + ((event_id * 19) % 200) / 10e0 AS post_bed_peak_interp_dB,
  -60e0 + ((event_id * 29) % 300) / 10e0 AS surface_power_dB,
  3e-6 + ((event_id * 41) % 700) / 1e8 AS surface_twtt,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE 1e-5 + ((event_id * 43) % 3000) / 1e8 END AS bed_twtt,
  45e-6 + ((event_id * 13) % 100) / 1e7 AS record_end_twtt,
  -102e0 + ((event_id * 3) % 70) / 10e0 AS record_tail_noise_dB,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE 20e0 + value / 5e0 END AS required_surface_snr_dB,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 23 <> 0 END AS bed_pick_available,
  event_id % 29 <> 0 AS bed_pick_attempted,
  event_id % 31 <> 0 AS qc_surface_pass,
  event_id % 19 <> 0 AS qc_pass,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE ((event_id * 43) % 90) / 10e0 - 4.5e0 END AS img_comb_offset_dB,
  CASE WHEN event_id % 17 = 0 THEN -1 WHEN event_id % 16 = 0 THEN 2 ELSE 1 END AS surface_source_image_index,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE ((event_id * 47) % 200) / 10e0 END AS surface_ceiling_margin_dB
FROM {events}
"""

# Grid: one point per order on a 125-wide lattice over the trace extent.
RELATIONS["grid_fx"] = """
SELECT o_orderkey AS grid_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'greenland' ELSE 'antarctic' END AS ice_sheet,
  CAST(o_orderkey % 125 AS INT) AS grid_ix,
  CAST(floor(o_orderkey / 125e0) AS INT) AS grid_iy,
  -1200000e0 + (o_orderkey % 125) * 2000 AS x,
  -300000e0 + floor(o_orderkey / 125e0) * 260 AS y,
  CASE WHEN o_orderkey % 3 = 0 THEN -60e0 + (o_orderkey * 31) % 40 ELSE -179e0 + (o_orderkey * 37) % 359 END AS longitude,
  CASE WHEN o_orderkey % 3 = 0 THEN 60e0 + ((o_orderkey * 41) % 230) / 10e0 ELSE -88e0 + ((o_orderkey * 43) % 230) / 10e0 END AS latitude,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 50e0 + (o_orderkey * 53) % 3200 END AS bedmachine_thickness_m,
  2e0 + (o_orderkey * 7) % 3 AS bedmachine_mask,
  220e0 + ((o_orderkey * 71) % 500) / 10e0 AS era5_t2m_mean_K,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE ((o_orderkey * 97) % 4000) / 10e0 END AS surface_v_m_yr,
  40e0 + ((o_orderkey * 59) % 600) / 10e0 AS ghf_mW_m2
FROM {orders}
"""

# Split table: the grid with a target, margins, non-detections, blocking cells, folds and held-out cells.
RELATIONS["split_fx"] = """
SELECT *,
  CASE WHEN is_test THEN -1 WHEN block % 17 = 3 THEN -1 ELSE CAST(block % 5 AS INT) END AS fold
FROM (
SELECT g.*,
  CASE WHEN grid_id % 4 = 0 THEN NULL
    ELSE 0.02e0 * coalesce(bedmachine_thickness_m, 900e0) - 0.5e0 * (era5_t2m_mean_K - 250e0)
      + CASE WHEN ice_sheet = 'greenland' THEN 5e0 ELSE 0e0 END
      + ((grid_id * 7919) % 1009) / 100e0 - 5e0 END AS required_surface_snr_dB,
  CASE WHEN grid_id % 4 = 0 OR grid_id % 53 = 0 THEN NULL ELSE ((grid_id * 89) % 450) / 10e0 END AS obs_margin_dB,
  ((grid_id * 61) % 9990) / 10e0 AS obs_dist_m,
  grid_id % 8 = 0 AS is_nondetect,
  CASE WHEN grid_id % 8 = 0 AND grid_id % 72 <> 0 THEN ((grid_id * 67) % 160) / 10e0 ELSE NULL END AS nd_delta_dB,
  CASE WHEN grid_id % 8 = 0 AND grid_id % 40 <> 0 THEN 30e0 + ((grid_id * 73) % 300) / 10e0 ELSE NULL END AS C_dB,
  CASE grid_id % 4 WHEN 0 THEN '2014_Antarctica_DC8' WHEN 1 THEN '2016_Antarctica_BaslerJKB' WHEN 2 THEN '2017_Greenland_P3' ELSE NULL END AS collection,
  CASE grid_id % 4 WHEN 0 THEN 'CReSIS' WHEN 1 THEN 'UTIG' WHEN 2 THEN 'CReSIS' ELSE NULL END AS institution,
  concat(CASE WHEN ice_sheet = 'greenland' THEN 'grl' ELSE 'ant' END, ':',
         CAST(CAST(floor(x / 25000e0) AS BIGINT) AS STRING), ':', CAST(CAST(floor(y / 5000e0) AS BIGINT) AS STRING)) AS cell_id,
  CAST(floor(x / 25000e0) AS BIGINT) + 7 * CAST(floor(y / 5000e0) AS BIGINT) + 1000 AS block,
  (CAST(floor(x / 25000e0) AS BIGINT) + 7 * CAST(floor(y / 5000e0) AS BIGINT) + 1000) % 11 = 5 AS is_test
FROM {grid_fx} g
) t
"""

# Two prediction runs with fixed coefficients.
RELATIONS["predictions_fx"] = """
SELECT grid_id, ice_sheet, grid_iy, grid_ix,
  CASE WHEN bedmachine_thickness_m IS NULL OR surface_v_m_yr IS NULL OR bedmachine_thickness_m < 100e0 THEN NULL
    ELSE 1e0 + 0.018e0 * bedmachine_thickness_m - 0.45e0 * (era5_t2m_mean_K - 250e0) END AS pred_mean,
  CASE WHEN bedmachine_thickness_m IS NULL OR surface_v_m_yr IS NULL OR bedmachine_thickness_m < 100e0 THEN NULL
    ELSE 8e0 + (grid_id % 40) / 10e0 END AS pred_std
FROM {grid_fx}
"""
RELATIONS["predictions_b_fx"] = """
SELECT grid_id, ice_sheet, grid_iy, grid_ix,
  CASE WHEN bedmachine_thickness_m IS NULL OR surface_v_m_yr IS NULL OR bedmachine_thickness_m < 100e0 THEN NULL
    ELSE 0.5e0 + 0.0195e0 * bedmachine_thickness_m - 0.48e0 * (era5_t2m_mean_K - 250e0) END AS pred_mean,
  CASE WHEN bedmachine_thickness_m IS NULL OR surface_v_m_yr IS NULL OR bedmachine_thickness_m < 100e0 THEN NULL
    ELSE 7.5e0 + (grid_id % 37) / 10e0 END AS pred_std
FROM {grid_fx}
"""

# Packed cells: quantised prediction, spread, thickness and mask of predicted points.
RELATIONS["cells_fx"] = """
SELECT g.grid_id, g.ice_sheet, g.bedmachine_thickness_m AS thickness_m, CAST(g.bedmachine_mask AS INT) AS mask,
  p.pred_mean AS mu_dB, p.pred_std AS sd_dB, CAST(floor(p.pred_std * 4e0) AS INT) AS sd_q
FROM {grid_fx} g JOIN {predictions_fx} p ON g.grid_id = p.grid_id
WHERE p.pred_mean IS NOT NULL
"""

# Raster layers over the projected position of the traces: one cell per event and layer, 100 columns wide.
RELATIONS["raster_cells_fx"] = """
SELECT v.raster_id, v.var, CAST(floor(e.event_id / 100e0) AS BIGINT) AS row, e.event_id % 100 AS col,
  CASE WHEN v.var = 'mask' THEN 1e0 + (CAST(floor(e.event_id / 900e0) AS BIGINT) + CAST(floor((e.event_id % 100) / 9e0) AS BIGINT)) % 4
    WHEN e.event_id % 503 = 77 THEN -9999e0
    WHEN v.var = 'bed' THEN -400e0 + 7e0 * (e.event_id % 100) + 3e0 * floor(e.event_id / 100e0)
    WHEN v.var = 'thickness' THEN 900e0 + 11e0 * (e.event_id % 100) - 2e0 * floor(e.event_id / 100e0)
    WHEN v.var = 'errbed' THEN 10e0 + (e.event_id * 7) % 190
    WHEN v.var = 'source' THEN 1e0 * ((e.event_id * 13) % 14)
    WHEN v.var = 'v' THEN ((e.event_id * 97) % 4000) / 10e0
    WHEN v.var = 'v_error' THEN ((e.event_id * 89) % 300) / 10e0
    WHEN v.var = 'vx' THEN CASE WHEN e.event_id % 61 = 0 THEN 0e0 ELSE ((e.event_id * 31) % 800) / 10e0 - 40e0 END
    WHEN v.var = 'vy' THEN CASE WHEN e.event_id % 61 = 0 THEN 0e0 ELSE ((e.event_id * 37) % 700) / 10e0 - 30e0 END
    WHEN v.var = 'errx' THEN 1e0 + (e.event_id % 50) / 10e0
    WHEN v.var = 'erry' THEN 2e0 + (e.event_id % 30) / 10e0
    WHEN v.var = 'HF' THEN 0.05e0 + (e.event_id % 60) / 1000e0
    WHEN v.var = 'HFmin' THEN 0.04e0 + (e.event_id % 60) / 1000e0
    WHEN v.var = 'HFmax' THEN 0.062e0 + (e.event_id % 60) / 1000e0
    END AS value
FROM {events} e """ + spread("v", "raster_id, var", "'bed', 'bed'", "'bed', 'thickness'", "'bed', 'mask'", "'bed', 'errbed'", "'bed', 'source'", "'velocity', 'v'", "'velocity', 'v_error'", "'vector_velocity', 'vx'", "'vector_velocity', 'vy'", "'vector_velocity', 'errx'", "'vector_velocity', 'erry'", "'heat_flow', 'HF'", "'heat_flow', 'HFmin'", "'heat_flow', 'HFmax'") + """
"""
RELATIONS["raster_meta_fx"] = """
SELECT v.raster_id, v.var, v.method, v.region, 'EPSG:3031' AS crs, -1750000e0 AS x0, 2500e0 AS dx, CAST(100 AS BIGINT) AS nx,
  -620000e0 AS y0, 4000e0 AS dy, e.ny, -9999e0 AS nodata
FROM (SELECT CAST(floor((max(event_id) + 1) / 100e0) AS BIGINT) AS ny FROM {events}) e
""" + spread("v", "raster_id, var, method, region", "'bed', 'bed', 'bilinear', 'global'", "'bed', 'thickness', 'bilinear', 'global'", "'bed', 'mask', 'nearest', 'global'", "'bed', 'errbed', 'bilinear', 'global'", "'bed', 'source', 'nearest', 'global'", "'velocity', 'v', 'bilinear', 'greenland'", "'velocity', 'v_error', 'bilinear', 'greenland'", "'vector_velocity', 'vx', 'bilinear', 'antarctic'", "'vector_velocity', 'vy', 'bilinear', 'antarctic'", "'vector_velocity', 'errx', 'bilinear', 'antarctic'", "'vector_velocity', 'erry', 'bilinear', 'antarctic'", "'heat_flow', 'HF', 'bilinear', 'antarctic'", "'heat_flow', 'HFmin', 'bilinear', 'antarctic'", "'heat_flow', 'HFmax', 'bilinear', 'antarctic'") + """
"""

# Trace places on their own sheet: Greenland ones in the north, and some at the seam of longitudes.
RELATIONS["places_fx"] = """
SELECT trace_id, ice_sheet,
  CASE WHEN trace_id % 50 = 3 THEN 179.9e0 - (trace_id % 3) * 179.93e0 WHEN ice_sheet = 'greenland' THEN -55e0 + ((trace_id * 7919) % 10007) / 500e0 ELSE longitude END AS longitude,
  CASE WHEN ice_sheet = 'greenland' THEN 66e0 + ((trace_id * 104729) % 10007) / 1000e0 ELSE latitude END AS latitude
FROM {traces_fx}
"""

# The northern counterparts of the raster layers, in their own projection, with rows from north to south.
RELATIONS["northern_cells_fx"] = """
SELECT v.raster_id, v.var, CAST(floor(e.event_id / 100e0) AS BIGINT) AS row, e.event_id % 100 AS col,
  CASE WHEN v.var = 'mask' THEN 1e0 + (CAST(floor(e.event_id / 700e0) AS BIGINT) + CAST(floor((e.event_id % 100) / 7e0) AS BIGINT)) % 4
    WHEN e.event_id % 401 = 55 THEN -9999e0
    WHEN v.var = 'bed' THEN -200e0 + 5e0 * (e.event_id % 100) - 2e0 * floor(e.event_id / 100e0)
    WHEN v.var = 'thickness' THEN 1200e0 - 4e0 * (e.event_id % 100) + 3e0 * floor(e.event_id / 100e0)
    WHEN v.var = 'v' THEN ((e.event_id * 83) % 3000) / 10e0
    WHEN v.var = 'v_error' THEN ((e.event_id * 79) % 250) / 10e0
    WHEN v.var = 'HF' THEN 0.055e0 + (e.event_id % 50) / 1000e0
    END AS value
FROM {events} e """ + spread("v", "raster_id, var", "'bed_greenland', 'bed'", "'bed_greenland', 'thickness'", "'bed_greenland', 'mask'", "'velocity', 'v'", "'velocity', 'v_error'", "'heat_flow_greenland', 'HF'") + """
"""
RELATIONS["northern_meta_fx"] = """
SELECT v.raster_id, v.var, v.method, 'greenland' AS region, 'EPSG:3413' AS crs, -500000e0 AS x0, 10000e0 AS dx, CAST(100 AS BIGINT) AS nx,
  -1450000e0 AS y0, -11500e0 AS dy, e.ny, -9999e0 AS nodata
FROM (SELECT CAST(floor((max(event_id) + 1) / 100e0) AS BIGINT) AS ny FROM {events}) e
""" + spread("v", "raster_id, var, method", "'bed_greenland', 'bed', 'bilinear'", "'bed_greenland', 'thickness', 'bilinear'", "'bed_greenland', 'mask', 'nearest'", "'velocity', 'v', 'bilinear'", "'velocity', 'v_error', 'bilinear'", "'heat_flow_greenland', 'HF', 'bilinear'") + """
"""
# All layers of both sheets, each valid on its own sheet.
RELATIONS["sheet_cells_fx"] = """
SELECT raster_id, var, row, col, value FROM {raster_cells_fx} WHERE raster_id <> 'velocity' UNION ALL SELECT raster_id, var, row, col, value FROM {northern_cells_fx}
"""
RELATIONS["sheet_meta_fx"] = """
SELECT raster_id, var, method, 'antarctic' AS region, crs, x0, dx, nx, y0, dy, ny, nodata FROM {raster_meta_fx} WHERE raster_id <> 'velocity'
UNION ALL SELECT raster_id, var, method, region, crs, x0, dx, nx, y0, dy, ny, nodata FROM {northern_meta_fx}
"""

# Hour x day x latitude x longitude temperatures, one per event.
RELATIONS["climatology_fx"] = """
SELECT (CAST(floor(event_id / 108e0) AS BIGINT) % 4) * 6 AS hour, CAST(floor(event_id / 432e0) AS BIGINT) AS dayofyear,
  (event_id % 12) * 30e0 AS longitude, 80e0 - 20e0 * (CAST(floor(event_id / 12e0) AS BIGINT) % 9) AS latitude,
  230e0 + ((event_id * 113) % 700) / 10e0 AS t2m
FROM {events}
"""

RELATIONS["snapshots_fx"] = """
SELECT CASE o_orderstatus WHEN 'O' THEN 'main' WHEN 'F' THEN 'dev' ELSE 'old' END AS branch,
  concat('snap-', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS snapshot_id, o_orderdate AS committed_at
FROM {orders}
"""

RELATIONS["segments_fx"] = """
SELECT DISTINCT collection AS season, regexp_replace(frame_id, '_[^_]*$', '') AS segment FROM {traces_fx}
"""
RELATIONS["windows_fx"] = """
SELECT season, segment, 1e-6 * (1 + CAST(substr(segment, 15, 2) AS INT) % 5) AS lo_s,
  CASE WHEN CAST(substr(segment, 12, 2) AS INT) % 7 = 3 THEN NULL ELSE 1e-6 * (7 + CAST(substr(segment, 12, 2) AS INT) % 3) END AS hi_s
FROM {segments_fx}
WHERE NOT (season = '2019_Antarctica_GV' AND substr(segment, 15, 2) = '06')
"""
RELATIONS["clip_fx"] = """
SELECT season, segment,
  CASE WHEN CAST(substr(segment, 15, 2) AS INT) = 5 THEN NULL
    ELSE -38e0 + CAST(substr(segment, 12, 2) AS INT) % 10 + CAST(substr(segment, 15, 2) AS INT) / 4e0 END AS S_dB
FROM {segments_fx}
"""

# Parameter-sheet cells in every form the readers must know, one row per part.
RELATIONS["params_fx"] = """
SELECT p_partkey AS row_id, concat('season_', CAST(p_partkey % 20 AS STRING)) AS season,
  concat(CAST(20120101 + p_partkey % 300 AS STRING), '_', lpad(CAST(p_partkey % 12 AS STRING), 2, '0')) AS seg,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '[3e-06 -Inf 1e-06]' WHEN 3 THEN '[3e-06, 2e-06, 1e-06, 1e-05 Inf 3e-06]'
    WHEN 4 THEN ' ' ELSE concat('[', CAST(1 + p_partkey % 9 AS STRING), 'e-06 0 1e-06]') END AS img_comb,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '{{}}' WHEN 2 THEN '{{[ones(1,6).'' (1:6).'']}}'
    WHEN 3 THEN '{{[1*ones(7,1) (1:7).''],[2*ones(7,1) (1:7).'']}}' WHEN 4 THEN '{{[1 2; 3 4],[2 1; 2 2],[5 6]}}'
    WHEN 5 THEN '{{[2*ones(3,1) [1 2 3].''; 3*ones(3,1) [1 2 3].'']}}' ELSE '{{[1 1],[2 1]}}' END AS imgs,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '72 - 12*ones(1,7)' WHEN 2 THEN '10.^((52-0*ones(1,6)/20)'
    WHEN 3 THEN '10^((44 - [3 3 4])/20)' WHEN 4 THEN '63.5 - [1.5 1 2]' WHEN 5 THEN '48*ones(1,3);' WHEN 6 THEN '51.25'
    WHEN 7 THEN '[45 45 45]' ELSE '(72 - 20*ones(1,6))' END AS gain_expr,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 1e0 + p_partkey % 3 END AS vpp,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1e-6 * (p_partkey % 4) END AS t_start_s,
  3e-5 + 1e-6 * (p_partkey % 13) AS t_end_s,
  CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 1e-6 * (1 + p_partkey % 10) END AS tpd_wf1,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1e-6 * (2 + p_partkey % 7) END AS tpd_wf2,
  1e-6 * (1 + p_partkey % 5) AS tpd_wf3
FROM {part}
"""

# An external export that repeats its cells.
RELATIONS["external_fx"] = """
SELECT -1200000e0 + (l_partkey % 125) * 2000 + (l_suppkey % 3 - 1) * 400e0 AS x, -300000e0 + (l_partkey % 120) * 260 AS y,
  l_orderkey * 10 + l_linenumber AS row_id,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE 20e0 + (l_orderkey % 900) / 10e0 END AS snr,
  30e0 + (l_partkey * 7 % 700) / 10e0 AS snr_pred, 5e0 + (l_partkey % 30) / 10e0 AS snr_pred_std,
  2e0 + (l_partkey % 3) AS mask, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE (l_partkey * 11 % 4000) / 10e0 END AS v
FROM {lineitem}
"""

# Site traces: six to a site, frames by user, two sheets and seasons.
RELATIONS["sites_fx"] = """
SELECT concat('s', lpad(CAST(CAST(floor(event_id / 6e0) AS BIGINT) AS STRING), 9, '0')) AS site_id,
  CASE WHEN CAST(floor(event_id / 6e0) AS BIGINT) % 3 = 0 THEN 'greenland' ELSE 'antarctica' END AS sheet,
  CASE WHEN event_id % 11 = 0 THEN '2019_Antarctica_GV' WHEN CAST(floor(event_id / 6e0) AS BIGINT) % 3 = 0 THEN '2017_Greenland_P3'
    WHEN CAST(floor(event_id / 6e0) AS BIGINT) % 2 = 0 THEN '2014_Antarctica_DC8' ELSE '2016_Antarctica_BaslerJKB' END AS season,
  concat('Data_', CAST(20140101 + user_id % 9 AS STRING), '_', lpad(CAST(user_id % 7 AS STRING), 2, '0'), '_',
         lpad(CAST(user_id % 4 AS STRING), 3, '0')) AS frame_id,
  -75e0 + (event_id % 1000) / 100e0 AS latitude, -110e0 + (event_id % 700) / 10e0 AS longitude,
  event_id AS trace_id,
  300e0 + (event_id * 1301) % 9000 AS r_surf, 300e0 + (event_id * 1301) % 9000 + 900e0 AS r_bed_refr,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE -60e0 + ((event_id * 29) % 300) / 10e0 END AS surface_power_dB,
  -100e0 + ((event_id * 31) % 400) / 10e0 AS bed_power_dB,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE ((event_id * 53) % 350) / 10e0 END AS bed_margin_dB,
  CASE WHEN 300e0 + (event_id * 1301) % 9000 >= 3000e0 THEN 'high' ELSE 'low' END AS regime,
  event_id % 10 <> 0 AS surface_gate_ok
FROM {events}
"""

# Link-budget scenarios: one design per part, around four base designs; some invalid on purpose.
RELATIONS["scenarios_fx"] = """
SELECT p_partkey AS scenario_id,
  CASE WHEN p_partkey % 97 = 13 THEN 0e0 ELSE CASE p_partkey % 4 WHEN 0 THEN 200e0 WHEN 1 THEN 14000e0 WHEN 2 THEN 500000e0 ELSE 500e0 END
    + (p_partkey % 50) * 10e0 END AS altitude_m,
  CASE p_partkey % 4 WHEN 0 THEN 20e0 WHEN 1 THEN 20e0 WHEN 2 THEN 7062e0 ELSE 130e0 END AS velocity_ms,
  CASE WHEN p_partkey % 101 = 7 THEN NULL ELSE 45e0 + (p_partkey % 30) * 20e0 END AS payload_power_W,
  CASE WHEN p_partkey % 89 = 5 THEN 1.5e0 ELSE 0.3e0 + (p_partkey % 5) / 10e0 END AS pa_efficiency,
  3000e0 + (p_partkey % 5) * 500e0 AS max_ice_thickness_m,
  CASE WHEN p_partkey % 83 = 3 THEN 5e9 ELSE 60e6 + (p_partkey % 10) * 30e6 END AS frequency_Hz,
  CASE WHEN p_partkey % 79 = 11 THEN 900e6 ELSE 10e6 + (p_partkey % 6) * 5e6 END AS bandwidth_Hz,
  2e0 + p_partkey % 21 AS gain_tx_dBi, 2e0 + p_partkey % 13 AS gain_rx_dBi, (p_partkey % 7) * 1e0 AS system_loss_dB,
  CASE WHEN p_partkey % 73 = 1 THEN -1e0 ELSE (p_partkey % 23) * 1e0 END AS noise_figure_dB,
  CASE WHEN p_partkey % 71 = 2 THEN 3e0 ELSE -5e0 - p_partkey % 24 END AS surface_reflectivity_dB,
  CASE WHEN p_partkey % 67 = 6 THEN 0.5e0 WHEN p_partkey % 61 = 4 THEN 6e0 ELSE 3.17e0 END AS epsilon_r,
  CASE p_partkey % 3 WHEN 0 THEN 'adaptive' ELSE 'sidelobe' END AS overlap_mode,
  CASE p_partkey % 5 WHEN 0 THEN 'hann' WHEN 1 THEN 'kaiser' ELSE 'rect' END AS sidelobe_window,
  CASE p_partkey % 3 WHEN 0 THEN 'fresnel' WHEN 1 THEN 'infinite' ELSE 'unknown' END AS radar_equation,
  CASE WHEN p_partkey % 6 = 0 THEN 2e-5 ELSE NULL END AS ov_pulse_length_s,
  CASE WHEN p_partkey % 10 = 0 THEN 230e-6 WHEN p_partkey % 59 = 8 THEN 1e-6 ELSE NULL END AS ov_pri_s,
  CASE WHEN p_partkey % 8 = 0 THEN 100e0 ELSE NULL END AS ov_tx_power_W,
  CASE WHEN p_partkey % 9 = 0 THEN 290e0 ELSE NULL END AS ov_noise_temp_K,
  CASE WHEN p_partkey % 12 = 0 THEN 0e0 WHEN p_partkey % 25 = 1 THEN 5000e0 ELSE NULL END AS ov_azimuth_distance_m
FROM {part}
"""

# Four base designs with their scalar columns given, so per-cell work can be checked on its own.
RELATIONS["designs_fx"] = """
SELECT * FROM (VALUES
  ('haps', 14000e0, 1.780449e0, 15e6, 20e-6, 24.771212547196626e0, 95e0, 'adaptive', 'rect', -100e0),
  ('uav', 200e0, 1.780449e0, 50e6, 1e-6, 16.989700043360187e0, 110e0, 'sidelobe', 'hann', -98e0),
  ('orbital', 500000e0, 1.780449e0, 10e6, 10e-6, 20e0, 60e0, 'sidelobe', 'rect', -101e0),
  ('airborne', 500e0, 1.780449e0, 30e6, 10e-6, 24.771212547196626e0, 115e0, 'sidelobe', 'other', -99e0))
  AS t(scenario_id, altitude_m, n_ice, bandwidth_Hz, pulse_length_s, pulse_compression_gain_dB, surface_snr_dB, overlap_mode,
       sidelobe_window, noise_dBm)
"""

# A sidelobe table from a rule: levels fall with time-bandwidth product and delay.
RELATIONS["sidelobe_fx"] = """
SELECT w.win, i.i, j.j, 10e0 * pow(10e0, i.i * 4e0 / 10e0) AS tb,
  CASE WHEN j.j = 0 THEN 0e0 ELSE pow(10e0, -3e0 + (j.j - 1) * 3e0 / 12e0) END AS x,
  CASE WHEN j.j = 0 THEN 0e0 WHEN j.j = 13 THEN -200e0 ELSE -1e0 * w.slope * (i.i + 1) * j.j / 3e0 END AS level
FROM (VALUES ('rect', 1e0), ('hann', 1.75e0)) AS w(win, slope)
""" + spread("i", "i", *map(str, range(11))) + " " + spread("j", "j", *map(str, range(14))) + """
"""

# Stage chain: suppliers augment, nations split, regions train.
RELATIONS["lineage_fx"] = """
SELECT concat('split-', CAST(n_nationkey AS STRING)) AS run_id, 'split' AS stage, concat('augment-', CAST(s_suppkey AS STRING)) AS input_id
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT concat('train-', CAST(r_regionkey AS STRING)), 'train', concat('split-', CAST(n_nationkey AS STRING))
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('tool-', CAST(r_regionkey % 2 AS STRING)), 'tool', concat('train-', CAST(r_regionkey AS STRING)) FROM {region}
"""

# Training metrics documents, one per customer.
RELATIONS["metrics_fx"] = """
SELECT c_custkey AS doc_id, concat('model-', c_mktsegment) AS model, concat('run', lpad(CAST(c_custkey AS STRING), 9, '0')) AS run_id,
  10e0 + (c_custkey % 500) / 128e0 AS rmse_mean, 9e0 + (c_custkey % 300) / 128e0 AS rmse_min, 15e0 + (c_custkey % 200) / 128e0 AS rmse_max,
  7e0 + (c_custkey % 100) / 128e0 AS mae_mean, 0.5e0 + (c_custkey % 40) / 128e0 AS coverage_mean,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE -4e0 + (c_custkey % 60) / 128e0 END AS logscore_mean,
  1000 + c_custkey AS n_points, c_custkey % 3 = 0 AS censored,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 12e0 + (c_custkey % 90) / 128e0 END AS test_rmse
FROM {customer}
"""

# Manifest datasets, one per part.
RELATIONS["datasets_fx"] = """
SELECT p_partkey AS doc_id,
  CASE p_partkey % 8 WHEN 0 THEN 'bedmachine_antarctic' WHEN 1 THEN 'bedmachine_greenland_x' WHEN 2 THEN 'measures_phase_vel_antarctic'
    WHEN 3 THEN 'itslive_greenland' WHEN 4 THEN 'era5_t2m_mean' WHEN 5 THEN 'ghf_antarctic' WHEN 6 THEN 'ghf_greenland' ELSE p_type END AS name,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat('v', CAST(p_size AS STRING)) END AS version
FROM {part}
"""

# Fixed posterior of the linear model: means and a lower-triangular factor of the covariance.
RELATIONS["posterior_fx"] = """
SELECT * FROM (VALUES
  (0, 'alpha', 0.05e0, 0.02e0, 0e0, 0e0), (1, 'bedmachine_thickness_m', 0.8e0, 0.004e0, 0.03e0, 0e0), (2, 'era5_t2m_mean_K', -0.4e0, -0.002e0, 0.001e0, 0.025e0))
  AS t(pos, param, mean, l0, l1, l2)
"""

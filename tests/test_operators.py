import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firnline.functions import geo
from firnline.operators import near, ordering, qc, raster, stats, track
from firnline.operators.levels import site_levels
from firnline.schema import SHEET_CRS, missing_as_null
from firnline.sources import covariates


def brute(left, right, r, k=1, strict=True):
    out = {}
    for i, x, y in left:
        d = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in right)
        out[i] = [(j, d2 ** 0.5) for d2, j in d if (d2 < r * r if strict else d2 <= r * r)][:k]
    return out


def clustered(n, seed, hot=0.4):
    """A third or more of the points in one spot, many of them exact copies."""
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 5000, (n, 2))
    m = int(n * hot)
    xy[:m] = 1000 + rng.uniform(0, 3, (m, 2))
    xy[: m // 2] = (1000.25, 1000.5)
    return [(int(i), float(a), float(b)) for i, (a, b) in enumerate(xy)]


@pytest.mark.parametrize("k,leaf", [(1, 4096), (1, 5), (3, 40), (8, 5)])
def test_nearest_equals_brute_force_on_hot_cells(spark, k, leaf):
    left, right = clustered(150, 1), clustered(260, 2)
    a = spark.createDataFrame(left, "left_id long, x double, y double")
    b = spark.createDataFrame(right, "right_id long, x double, y double")
    got = {}
    for r in near.nearest_within(a, b, 300.0, k=k, leaf_points=leaf).orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append((r.right_id, r.dist))
    want = {i: v for i, v in brute(left, right, 300.0, k).items() if v}
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    assert all(abs(x[1] - y[1]) < 1e-9 for i in want for x, y in zip(got[i], want[i]))


def test_cutoff_is_strict_and_empty_right_gives_nothing(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0)], "left_id long, x double, y double")
    b = spark.createDataFrame([(0, 1.0, 0.0), (1, 8.0, 0.0), (2, 15.0, 0.0)], "right_id long, x double, y double")
    got = {r.left_id: (r.right_id, r.dist) for r in near.nearest_within(a, b, 5.0).collect()}
    assert got == {0: (0, 1.0), 1: (1, 2.0)}
    assert near.nearest_within(a, b.where("right_id = 2"), 5.0).count() == 0
    assert near.nearest_within(a, b.where("right_id = 2"), 5.0, strict=False).count() == 1
    assert near.nearest_within(a, b.where("false"), 5.0).count() == 0


def test_only_full_cells_are_cut(spark):
    # One place with 20,000 positions, and single points elsewhere.
    rng = np.random.default_rng(3)
    dense = pd.DataFrame({"x": 1000 + rng.random(20_000) * 30, "y": 1000 + rng.random(20_000) * 30})
    thin = pd.DataFrame({"x": rng.random(300) * 1e5 + 5000, "y": rng.random(300) * 1e5})
    b = spark.createDataFrame(pd.concat([dense, thin], ignore_index=True))
    cells = near.with_leaves(b, [], 300.0, "x", "y", 1000)[0].groupBy("_lv", "_fx", "_fy").count().toPandas()
    assert cells["count"].max() <= 1000 and cells["count"].sum() == 20_300
    assert set(cells.loc[cells["count"] <= 2, "_lv"]) >= {1} and len(cells[cells["_lv"] == 1]) >= 290
    # A point far from the dense place meets no more cells than before: its neighbours were not cut.
    far = near._cells(near.with_leaves(b, [], 300.0, "x", "y", 1000)[0].withColumn("_copies", F.lit(1)), [], 300.0, "x", "y")
    assert far.where("_x0 > 5000").groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] <= 10


def test_ball_counts(spark):
    pts = clustered(200, 4)
    df = spark.createDataFrame(pts, "id long, x double, y double")
    want = {i: sum((x - a) ** 2 + (y - b) ** 2 <= 250.0**2 for _, a, b in pts) for i, x, y in pts}
    for leaf in (4096, 5):
        assert {r.id: r.n_ball for r in near.ball_counts(df, 250.0, id_col="id", leaf_points=leaf).collect()} == want


def test_near_plans_have_no_product_joins(spark, sf_dir):
    from firnline.catalog import queries
    for name in ("c05_nearest_observation", "c07_attach_nearest_attempted", "c08_cross_season_crossovers", "c09_within_season_crossovers", "c10_ball_neighbours"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_quantiles_with_hot_values_and_null_keys(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.where(rng.random(900) < 0.7, "hot", np.where(rng.random(900) < 0.5, "a", None)), "v": np.round(rng.normal(20, 30, 900), 1)})
    pdf.loc[::17, "v"] = np.nan
    pdf.loc[:200, "v"] = 4.5
    df = missing_as_null(spark.createDataFrame(pdf))
    got = ordering.exact_quantiles(df, ["g"], "v", {"lo": 0.01, "q": 0.25, "m": 0.5, "hi": 0.995}, extra={"top": F.max("v")}).toPandas()
    for _, r in got.iterrows():
        part = pdf[pdf["g"].isna() if r["g"] is None else pdf["g"] == r["g"]]["v"].dropna()
        assert r["n_values"] == len(part) and r["top"] == part.max()
        assert np.allclose(r[["lo", "q", "m", "hi"]].astype(float), part.quantile([0.01, 0.25, 0.5, 0.995]), atol=1e-9)
    assert len(got) == 3


def test_quantiles_of_a_narrow_range_are_spread(spark):
    v = np.random.default_rng(3).random(100_000) * 1e-3
    rows = spark.createDataFrame(pd.DataFrame({"g": "a", "_v": v}))
    got = ordering.exact_quantiles(rows, ["g"], "_v", {"p": 0.37, "m": 0.5}).first()
    assert np.allclose([got.p, got.m], np.quantile(v, [0.37, 0.5]), rtol=1e-12)
    assert ordering.bucketed(rows, ["g"]).groupBy("_b").count().agg(F.max("count")).first()[0] < 3 * len(v) / ordering.BUCKETS


def test_ranks_are_distinct_and_ordered(spark):
    pdf = pd.DataFrame({"id": range(300), "g": ["a"] * 200 + ["b"] * 100, "v": [1.0] * 120 + list(np.linspace(-3, 5, 180))})
    got = ordering.with_rank(spark.createDataFrame(pdf), ["g"], "v", "id").toPandas().sort_values(["g", "rank"])
    for g, part in got.groupby("g"):
        assert list(part["rank"]) == list(range(1, len(part) + 1)) and part["v"].is_monotonic_increasing and (part["n_total"] == len(part)).all()


@pytest.mark.parametrize("k,most", [(1, 24), (4, 60)])
def test_candidates_stay_few_where_every_cell_is_cut(spark, k, most):
    # 24 x 24 cells of radius / 8, each with 400 positions and room for 50: all of them are cut.
    rng = np.random.default_rng(11)
    xy = [(c * 10 + x, r * 10 + y) for c in range(24) for r in range(24) for x, y in rng.uniform(0, 10, (60, 2))]
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "right_id long, _rx double, _ry double").withColumn("_copies", F.lit(1)).repartition(8).cache()
    seekers = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(85, 155, (60, 2)))], "_lid long, _lx double, _ly double")
    leaf, depth = near.with_leaves(right, [], 80.0, "_rx", "_ry", 20)
    assert depth == 2 and leaf.where("_lv = 1").count() == 0
    found = near.candidates(seekers, leaf, depth, 80.0, on=[], per=[], carry=[], k=k)
    held = found.join(leaf, ["_lv", "_fx", "_fy"]).groupBy("_lid").count().agg(F.max("count"), F.count("count")).first()
    # Of 34,560 positions around each of them.
    assert held[0] <= most and held[1] == 60
    got = near.nearest_within(seekers.select(F.col("_lid").alias("left_id"), F.col("_lx").alias("x"), F.col("_ly").alias("y")), right.select("right_id", F.col("_rx").alias("x"), F.col("_ry").alias("y")), 80.0, k=k, leaf_points=20)
    want = brute([tuple(r) for r in seekers.collect()], [(i, x, y) for i, (x, y) in enumerate(xy)], 80.0, k)
    assert {(r["left_id"], r["rank"], r["right_id"]) for r in got.collect()} == {(i, n + 1, j) for i, js in want.items() for n, (j, _) in enumerate(js)}


def test_one_nearest_needs_no_window_and_moves_seekers_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pts = spark.range(100).select(F.col("id"), F.col("id").cast("double").alias("x"), (F.col("id") * 7 % 50).cast("double").alias("y"))
        plan = near.nearest_within(pts.withColumnRenamed("id", "left_id"), pts.withColumnRenamed("id", "right_id"), 5.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" not in plan
    # Nine coarse cells are dealt by _cx and _cy: seekers, and cells for either pass (one of them is reused at run time).
    assert plan.count("Exchange hashpartitioning(_cx") <= 3


def linear_raster(spark, n=11, nodata=None):
    cells = [("r", "v", r, c, 2.0 * (100 + c * 10) + 3.0 * (50 + r * 10) + 1) for r in range(n) for c in range(n)]
    if nodata:
        cells = [(a, b, r, c, -9999.0 if (r, c) == nodata else v) for a, b, r, c, v in cells]
    meta = [("r", "v", "bilinear", "EPSG:4326", 100.0, 10.0, n, 50.0, 10.0, n, -9999.0)]
    return (spark.createDataFrame(meta, "raster_id string, var string, method string, crs string, x0 double, dx double, nx long, y0 double, dy double, ny long, nodata double"),
            spark.createDataFrame(cells, "raster_id string, var string, row long, col long, value double"))


def sampled(spark, pts, **kw):
    meta, cells = linear_raster(spark, nodata=kw.pop("nodata", None))
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "id long, longitude double, latitude double")
    return [r.value for r in raster.sample(df, meta, cells, point_id="id", **kw).orderBy("id").collect()]


def test_bilinear_is_exact_on_a_linear_field_and_null_outside(spark):
    pts = [(123.4, 77.7), (100.0, 50.0), (200.0, 150.0), (200.1, 77.0), (99.0, 77.0)]
    got = sampled(spark, pts)
    assert got[:3] == pytest.approx([2 * x + 3 * y + 1 for x, y in pts[:3]], abs=1e-9) and got[3:] == [None, None]
    pixel = sampled(spark, pts, edge=raster.PIXEL)
    assert pixel[:2] == pytest.approx(got[:2]) and pixel[2:] == [None, None, None]
    with pytest.raises(ValueError):
        sampled(spark, pts, method="cubic")


def test_missing_corner_and_nearest_rules(spark):
    assert sampled(spark, [(101.0, 51.0), (131.0, 81.0)], nodata=(0, 0))[0] is None
    # Tie between two cells: lower index for centres, half to even for pixels.
    assert sampled(spark, [(115.0, 50.0)], method="nearest") == [2.0 * 110 + 3 * 50 + 1]
    assert sampled(spark, [(115.0, 50.0)], method="nearest", edge=raster.PIXEL) == [2.0 * 120 + 3 * 50 + 1]


def test_strided_points_keep_only_wanted_mask_values(spark):
    rows = [("m", "mask", r, c, float(0 if r < 5 else (2 if c < 15 else 3))) for r in range(20) for c in range(30)]
    cells = spark.createDataFrame(rows, "raster_id string, var string, row long, col long, value double")
    meta = {"raster_id": "m", "var": "mask", "crs": "EPSG:3031", "x0": -1e6, "dx": 1000.0, "y0": 5e5, "dy": -1000.0}
    assert raster.strided_points(meta, cells, 1, [2, 3]).count() == 15 * 30
    p = raster.strided_points(meta, cells, 5, [3]).toPandas()
    assert set(p["grid_ix"]) == {3, 4, 5} and set(p["y"]) == {5e5 - 5000.0, 5e5 - 10000.0, 5e5 - 15000.0}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_interpolation_does_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(6)
    rows = []
    for f in ("a", "b", "c"):
        v = pd.Series(rng.normal(size=40)).where(pd.Series(rng.random(40) < 0.3))
        if f == "c":
            v[:] = np.nan
            v[7] = 2.0
        rows += [(f, i, None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame([(k, f, t, v) for k, (f, t, v) in enumerate(rows)], "trace_id long, frame_id string, slow_time long, v double")
    for need in (1, 2):
        got = track.interpolate(df, "v", "o", min_known=need, chunk=F.floor(F.col("slow_time") / chunk)).toPandas().sort_values(["frame_id", "slow_time"])
        for f, part in got.groupby("frame_id"):
            want = part["v"].interpolate(method="linear", limit_direction="both").to_numpy()
            if part["v"].notna().sum() < need:
                want[:] = np.nan
            assert np.allclose(part["o"].astype(float), want, equal_nan=True)


def test_greedy_levels(spark):
    rows = [("s", f, h) for f, h in (("a", 400.0), ("a", 500.0), ("b", 700.0), ("c", 640.0), ("d", 1000.0))] + [("t", "a", 1.0), ("t", "a", 900.0)]
    df = spark.createDataFrame(rows, "site_id string, frame_id string, h double")
    assert {r.site_id: r.n_levels for r in site_levels(df, ["site_id"], "frame_id", "h").collect()} == {"s": 3, "t": 0}


def test_calibration_truth_table(spark):
    nan = float("nan")
    rows = [(0.0, 1, 5.0), (3.0, 1, 5.0), (-3.5, 1, 5.0), (nan, 1, 5.0), (0.0, -1, 5.0), (0.0, 2, 5.0), (0.0, 1, nan), (0.0, 1, 1.9)]
    df = missing_as_null(spark.createDataFrame(rows, "img_comb_offset_dB double, surface_source_image_index int, surface_ceiling_margin_dB double"))
    r = qc.qc_counts(df).first().asDict()
    assert r == {"seam": 2, "img2": 1, "saturated": 1, "any": 4, "n_before": 8}
    assert qc.apply_calibration_qc(df, {"drop_unmeasured_seam": True}).count() == 3
    assert qc.apply_calibration_qc(df, enabled=False).count() == 8
    assert qc.apply_calibration_qc(df.drop("img_comb_offset_dB")).count() == 6


def test_thickness_keeps_border_and_unknown(spark):
    df = spark.createDataFrame([(100.0, 50.0), (100.0, 0.0), (1000.0, 0.0), (None, 0.0)], "surface_elevation double, bed_elevation double")
    assert qc.min_thickness(df, 100.0).count() == 3 and qc.min_thickness(df, None).count() == 4


def test_nondetection_filter(spark):
    df = spark.createDataFrame([(50.0, 4.0), (50.0, 8.0), (50.0, None), (None, 4.0)], "C_dB double, nd_delta_dB double")
    assert qc.likelihood_nondetects(df).count() == 1 and qc.likelihood_nondetects(df, None).count() == 3


def test_normalizer_constant_column(spark):
    r = stats.normalizer(spark.createDataFrame([(0.0, 3.0), (2.0, 3.0)], "a double, b double"), ["a", "b"]).first()
    assert (r["a__mean"], r["a__sd"], r["b__sd"]) == (1.0, 1.0, 1.0)


def test_mixture_histogram_keeps_wide_and_unknown_cells(spark):
    df = spark.createDataFrame([("a", 50.0, 300), ("b", 50.0, None)], "k string, snr double, sd int")
    got = stats.mixture_histogram(df, ["k"], "snr", "sd", 40.0, 0.0, 100.0, 160).groupBy("k").agg(F.sum("mass").alias("m")).collect()
    assert {r.k: round(r.m, 4) for r in got} == {"a": 1.0, "b": 1.0}


def test_mixture_histogram_keeps_mass(spark):
    df = spark.createDataFrame([("g", float(v), 8) for v in range(40, 60)], "k string, snr double, sd int")
    got = stats.mixture_histogram(df, ["k"], "snr", "sd", 4.0, 0.0, 100.0, 160).toPandas()
    assert got["mass"].sum() == pytest.approx(20.0, abs=1e-9)


META = "raster_id string, var string, method string, crs string, x0 double, dx double, nx long, y0 double, dy double, ny long, nodata double, region string"


def two_sheets(spark, nx=150, ny=70):
    meta = [("south", "a", "bilinear", "EPSG:3031", -75e3, 1e3, nx, -35e3, 1e3, ny, -9999.0, "antarctic"), ("south", "m", "nearest", "EPSG:3031", -75e3, 1e3, nx, -35e3, 1e3, ny, -9999.0, "antarctic"),
            ("north", "a", "bilinear", "EPSG:3413", -75e3, 1e3, nx, 35e3, -1e3, ny, None, "greenland")]
    cells = [(r, v, i, j, float(-9999 if (r, v, i, j) == ("south", "a", 3, 3) else k * 1e6 + 1e3 * i + j)) for k, (r, v) in enumerate([("south", "a"), ("south", "m"), ("north", "a")]) for i in range(ny) for j in range(nx)]
    return spark.createDataFrame(meta, META), spark.createDataFrame(cells, "raster_id string, var string, row long, col long, value double")


def at_metres(spark, rows):
    """(id, sheet, x, y) as degrees in the system of the sheet."""
    lon, lat = geo.unproject_by_sheet(F.col("x"), F.col("y"), F.col("sheet"), SHEET_CRS)
    return spark.createDataFrame(rows, "id long, sheet string, x double, y double").select("id", "sheet", lon.alias("longitude"), lat.alias("latitude"))


@pytest.mark.parametrize("size", [3, 64, 1000])
def test_each_row_meets_the_rasters_of_its_sheet_whatever_the_tiles(spark, size):
    meta, cells = two_sheets(spark)
    rng = np.random.default_rng(5)
    rows = [(i, s, float(rng.uniform(-80e3, 80e3)), float(rng.uniform(-40e3, 40e3))) for i, s in enumerate(["antarctic", "greenland"] * 150)] + [(900, None, 0.0, 0.0), (901, "antarctic", -71.5e3, -31.5e3)]
    layout = raster.grids(meta)
    names = {("south", "a"): "a", ("south", "m"): "m", ("north", "a"): "a"}
    got = {r["id"]: r for r in raster.at_points(at_metres(spark, rows), raster.tiles(cells, layout, size), layout, names, point_id="id", sheet=F.col("sheet"), size=size).collect()}
    assert len(got) == len(rows)
    for i, sheet, x, y in rows:
        c, r = (x + 75e3) / 1e3, ((y + 35e3) if sheet == "antarctic" else (35e3 - y)) / 1e3
        inside = sheet is not None and 0 <= c <= 149 and 0 <= r <= 69
        if not inside or i == 901:
            assert got[i]["a"] is None
        else:
            assert got[i]["a"] == pytest.approx((0 if sheet == "antarctic" else 2e6) + 1e3 * r + c, abs=1e-3)
        assert got[i]["m"] == (1e6 + 1e3 * math.ceil(r - 0.5) + math.ceil(c - 0.5) if inside and sheet == "antarctic" else None)


def test_a_task_gets_a_bounded_part_of_cells_and_points(spark, monkeypatch):
    meta, cells = two_sheets(spark)
    layout = raster.grids(meta)
    rows = [(i, "antarctic", -74e3 + 500.0 * (i % 40), -30e3 + 100.0 * i) for i in range(100)] + [(100, None, 0.0, 0.0)]
    points = at_metres(spark, rows)

    def looked():
        return raster.at_points(points, raster.tiles(cells, layout, 16), layout, {("south", "a"): "a", ("south", "m"): "m"}, point_id="id", sheet=F.col("sheet"), size=16)

    want = sorted(map(tuple, looked().collect()), key=lambda r: r[0])
    monkeypatch.setattr(raster, "CELLS_PER_TASK", 3000)
    monkeypatch.setattr(raster, "POINTS_PER_TASK", 9)
    df = looked()
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == want
    plan = df._jdf.queryExecution().sparkPlan().toString()
    # 31,500 cells of three layers, 101 points; spots and tiles are merged, not sent to every task.
    assert "hashpartitioning(id" in plan and ", 12)" in plan and ", 11)" in plan and "BroadcastHashJoin [grid" not in plan and "SortMergeJoin [grid" in plan


def test_points_outside_are_not_moved_and_files_without_points_not_read(spark, tmp_path):
    meta, cells = two_sheets(spark)
    layout = raster.grids(meta)
    # 5 x 10 tiles of 16 cells in blocks of 2 x 2, per grid.
    path = str(tmp_path / "tiles")
    raster.write_tiles(raster.tiles(cells, layout, 16), path, group=2)
    stored = spark.read.parquet(path)
    assert stored.count() == 100 and len(stored.inputFiles()) == 30
    rows = [(1, "antarctic", -74e3, -34e3), (2, "antarctic", -73.5e3, -33e3), (3, "antarctic", 9e6, 0.0), (4, "greenland", 70e3, -30e3)]
    found = raster.spots(at_metres(spark, rows), layout, point_id="id", sheet=F.col("sheet"), size=16)
    assert sorted(r["id"] for r in found.collect()) == [1, 2, 4]
    read = raster.read_tiles(spark, path, found, group=2)
    assert sorted(map(tuple, read.select("grid", "tile_row", "tile_col").collect())) == [("north", 4, 9), ("south", 0, 0)]
    scan = next(line for line in read._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line and "block" in line)
    assert "0_0" in scan and "2_4" in scan
    one = raster.at_points(at_metres(spark, rows), lambda f: raster.read_tiles(spark, path, f, group=2), layout, {("south", "m"): "m"}, point_id="id", sheet=F.col("sheet"), size=16)
    whole = raster.at_points(at_metres(spark, rows), raster.tiles(cells, layout, 16), layout, {("south", "m"): "m"}, point_id="id", sheet=F.col("sheet"), size=16)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, whole.collect()))
    none = raster.read_tiles(spark, path, found.where("id > 99"), group=2)
    assert none.count() == 0


def test_climatology_is_periodic(spark):
    rows = [(h, d, float(lon), float(lat), lon + lat / 10 + h) for h in (0, 6) for d in (1, 2) for lon in range(0, 360, 30) for lat in range(80, -81, -20)]
    meta, cells = covariates.climatology_raster(spark.createDataFrame(rows, "hour int, dayofyear int, longitude double, latitude double, t2m double"))
    pts = spark.createDataFrame([(1, 179.9, 0.0), (2, -179.9, 0.0), (3, 180.0, 20.0), (4, 15.0, 10.0), (5, 0.0, 85.0), (6, None, 0.0)], "id long, longitude double, latitude double")
    got = {r["id"]: r["era5_t2m_mean_K"] for r in covariates.attach(pts, "era5", meta, cells, "id").collect()}
    # From 150 to 180 degrees the field goes from 150 to 180, from -180 on from 180 to 210.
    assert got[1] == pytest.approx(179.9 + 3) and got[2] == pytest.approx(180.1 + 3) and got[3] == pytest.approx(180 + 2 + 3)
    assert got[4] == pytest.approx(15 + 1 + 3) and got[5] is None and got[6] is None
    again = covariates.climatology_raster(spark.createDataFrame([], "hour int, dayofyear int, longitude double, latitude double, t2m double"))
    assert [r["era5_t2m_mean_K"] for r in covariates.attach(pts, "era5", *again, "id").collect()] == [None] * 6


def test_products_of_both_sheets_in_one_pass(spark):
    cells = [("velocity", v, r, c, 5.0 + r) for v in ("v", "v_error") for r in range(4) for c in range(4)] + [("vector_velocity", v, r, c, k) for v, k in (("vx", 3.0), ("vy", 4.0), ("errx", 1.0), ("erry", 2.0)) for r in range(4) for c in range(4)]
    meta = [("velocity", v, "bilinear", "EPSG:3413", -2e3, 1e3, 4, -2e3, 1e3, 4, None, "greenland") for v in ("v", "v_error")] + [("vector_velocity", v, "bilinear", "EPSG:3031", -2e3, 1e3, 4, -2e3, 1e3, 4, None, "antarctic") for v in ("vx", "vy", "errx", "erry")]
    meta, cells = spark.createDataFrame(meta, META), spark.createDataFrame(cells, "raster_id string, var string, row long, col long, value double")
    pts = at_metres(spark, [(1, "antarctic", 0.5e3, 0.5e3), (2, "greenland", 0.0, -1e3), (3, "greenland", 9e5, 0.0)])
    out = {r["id"]: r for r in covariates.attach_all(pts, ["measures_vel", "itslive", "ghf"], F.col("sheet"), meta, cells, "id").collect()}
    assert out[1]["surface_v_m_yr"] == pytest.approx(5.0) and out[1]["surface_v_error_m_yr"] == pytest.approx(math.hypot(3, 8) / 5)
    assert out[2]["surface_v_m_yr"] == pytest.approx(6.0, abs=1e-6) and out[3]["surface_v_m_yr"] is None and out[1]["ghf_mW_m2"] is None
    one = covariates.attach_all(pts, ["measures_vel", "itslive"], "greenland", meta, cells, "id")
    assert {r["id"]: r["surface_v_m_yr"] for r in one.collect()}[1] is None


def test_growing_tables_are_not_copied_through_the_driver(spark, tmp_path):
    from firnline.plans import sites

    spark.range(500).selectExpr("id", "double(id % 50) AS x", "double(id % 7) AS y", "concat('f', id % 3) AS f").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    for made in (near.nearest_within(t.withColumnRenamed("id", "a"), t.withColumnRenamed("id", "b"), 10.0, left_id="a", right_id="b"),
                 near.ball_counts(t, 3.0, id_col="id"), sites.components(t, 4.0, ["f"])):
        assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_cell_goes_to_few_blocks(spark):
    t = spark.range(4000).selectExpr("id * 37.0D % 4001 AS _rx", "id * 91.0D % 3989 AS _ry", "1 AS _copies")
    leaf, _ = near.with_leaves(t, [], 100.0, "_rx", "_ry")
    cells = leaf.select("_lv", "_fx", "_fy").distinct().count()
    assert cells <= near._cells(leaf, [], 100.0, "_rx", "_ry").count() < 3 * cells

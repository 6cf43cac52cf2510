import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions import geo, labels, normal, parse, radio


def one(df):
    return df.first()


def test_projection_spot_values_and_round_trip(spark):
    x, y = geo.project(F.col("lon"), F.col("lat"), "EPSG:3031")
    r = one(spark.createDataFrame([(0.0, -75.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")))
    assert abs(r.x) < 1e-6 and r.y == pytest.approx(1638783.238, abs=1e-3)
    x, y = geo.project(F.col("lon"), F.col("lat"), "EPSG:3413")
    r = one(spark.createDataFrame([(-45.0, 75.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")))
    assert abs(r.x) < 1e-6 and r.y == pytest.approx(-1633879.497, abs=1e-3)
    for crs in geo.POLAR:
        pts = spark.createDataFrame([(float(a), float(b)) for a in range(-2700000, 2700001, 900000) for b in range(-2700000, 2700001, 900000) if a or b], "x double, y double")
        lon, lat = geo.unproject(F.col("x"), F.col("y"), crs)
        back = geo.project(F.col("lon"), F.col("lat"), crs)
        d = pts.select("x", "y", lon.alias("lon"), lat.alias("lat")).select((back[0] - F.col("x")).alias("dx"), (back[1] - F.col("y")).alias("dy"))
        worst = one(d.agg(F.max(F.greatest(F.abs("dx"), F.abs("dy"))).alias("w"))).w
        assert worst < 1e-6


def test_cell_ids_at_borders(spark):
    rows = [(0.0, 0.0, "antarctic"), (499e3, 0.0, "antarctic"), (500e3, 0.0, "antarctic"), (-1.0, 0.0, "antarctic"), (500e3, -500e3, "greenland")]
    df = spark.createDataFrame(rows, "x double, y double, s string")
    ids = [r[0] for r in df.select(geo.cell_id(F.col("x"), F.col("y"), F.col("s"), 500e3, {"antarctic": "ant", "greenland": "grl"})).collect()]
    assert ids == ["ant:0:0", "ant:0:0", "ant:1:0", "ant:-1:0", "grl:1:-1"]


def test_antimeridian_is_closed_once(spark):
    f = spark.createDataFrame([(-180.0, 1.0, 5.0), (0.0, 1.0, 6.0)], "x double, y double, v double")
    a = geo.close_antimeridian(f)
    assert sorted(r.x for r in a.collect()) == [-180.0, 0.0, 180.0]
    assert geo.close_antimeridian(a).count() == 3


def test_ceiling(spark):
    df = spark.createDataFrame([(-50.0, 10e-6, -160.0, 0.0), (-50.0, 10e-6, None, 0.0)], "p double, t double, n double, h double")
    out = [r[0] for r in df.select(radio.detection_ceiling(*[F.col(c) for c in "ptnh"])).collect()]
    assert out[0] == pytest.approx(110.0) and out[1] is None


def test_indicators_only_floating_is_three(spark):
    df = spark.createDataFrame([("antarctic", 3.0), ("greenland", 2.0), ("greenland", 4.0), ("antarctic", None)], "ice_sheet string, bedmachine_mask double")
    cols = labels.indicator_columns(["is_greenland", "is_floating"], df.columns)
    assert [tuple(r) for r in df.select(*cols.values()).collect()] == [(0.0, 1.0), (1.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    with pytest.raises(ValueError):
        labels.indicator_columns(["is_moon"], df.columns)


def test_log_cdf_arrays_match_erf():
    z = np.concatenate([np.linspace(-8, 8, 400), [-35.0, -20.0]])
    got = normal.np_log_cdf(z)
    want = [math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in z]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_hash_noise_is_standard_normal_and_repeatable(spark):
    df = spark.range(20000).select(normal.hash_normal(F.col("id"), 7).alias("z"))
    m, s = one(df.agg(F.avg("z"), F.stddev("z")))
    assert abs(m) < 0.03 and abs(s - 1) < 0.03
    assert df.repartition(7).agg(F.sum("z")).first()[0] == pytest.approx(df.agg(F.sum("z")).first()[0])


def test_parsers(spark):
    df = spark.createDataFrame([("[3e-06 -Inf 1e-06]",), ("",), (None,), ("None",)], "s string")
    v = [r[0] for r in df.select(parse.numeric_vector(F.col("s"))).collect()]
    assert v[0] == [3e-6, -math.inf, 1e-6] and v[1:] == [None, None, None]
    cells = ["{[2*ones(3,1) [1 2 3].'; 3*ones(3,1) [1 2 3].']}", "{[1 2; 3 4],[5 6]}", "{}", "{[ones(1,6).' (1:6).']}"]
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    got = [(r[0], r[1]) for r in df.select(parse.bracket_groups(F.col("s")), parse.first_image_waveforms(F.col("s"))).collect()]
    assert got == [(1, [2, 3]), (2, [1, 3]), (None, []), (1, [1])]
    gains = {"72 - 12*ones(1,7)": 60.0, "63.5 - [1.5 1 2]": 62.0, "48*ones(1,3);": 48.0, "((51.25))": 51.25, "[45 45]": 45.0, "abc": None,
             "10^((44 - [3 3 4])/20)": 41.0}
    df = spark.createDataFrame([(g,) for g in gains], "s string")
    assert {r[0]: r[1] for r in df.select("s", parse.gain_dB(F.col("s"))).collect()} == gains

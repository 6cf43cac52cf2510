"""Gridded products: which layers they have, where they are valid, what columns they give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from firnline.functions import geo, radio
from firnline.operators import raster


Columns = dict[str, Column]


def _same(columns: Columns) -> Columns:
    return columns


@dataclass(frozen=True)
class Covariate:
    """A product: its rasters (one per region they cover), layer -> output column, edge rule, validity, and a step after sampling."""

    name: str
    rasters: tuple[str, ...]
    columns: dict[str, str]
    region: str = "global"
    edge: str = raster.CENTRE
    finish: Callable[[Columns], Columns] = _same


_REGISTRY: dict[str, Covariate] = {}


def register(c: Covariate) -> Covariate:
    if c.name in _REGISTRY:
        raise ValueError(f"covariate {c.name!r} is already registered")
    _REGISTRY[c.name] = c
    return c


def get(name: str) -> Covariate:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise KeyError(f"unknown covariate {name!r}; known: {names()}") from None


def names() -> list[str]:
    return sorted(_REGISTRY)


def vector_speed(c: Columns) -> Columns:
    vx, vy, ex, ey = (c[n] for n in ("vx", "vy", "ex", "ey"))
    return {"surface_v_m_yr": radio.speed(vx, vy), "surface_v_error_m_yr": radio.speed_error(vx, vy, ex, ey)}


def milliwatts(c: Columns) -> Columns:
    return {f"ghf{s}_mW_m2": c[f"hf{s}"] * 1000 for s in ("", "_min", "_max")}


for _c in (
    Covariate("bedmachine", ("bed", "bed_greenland"), {"bed": "bedmachine_bed_m", "surface": "bedmachine_surface_m",
                                    "thickness": "bedmachine_thickness_m", "mask": "bedmachine_mask",
                                    "errbed": "bedmachine_errbed_m"}),
    Covariate("itslive", ("velocity",), {"v": "surface_v_m_yr", "v_error": "surface_v_error_m_yr"}, "greenland", raster.PIXEL),
    Covariate("measures_vel", ("vector_velocity",), {"vx": "vx", "vy": "vy", "errx": "ex", "erry": "ey"}, "antarctic",
              finish=vector_speed),
    Covariate("ghf", ("heat_flow", "heat_flow_greenland"), {"HF": "hf", "HFmin": "hf_min", "HFmax": "hf_max"}, finish=milliwatts),
    Covariate("era5", ("temperature",), {"t2m": "era5_t2m_mean_K"}),
):
    register(_c)


def attach(points: DataFrame, name: str, meta: DataFrame, cells: DataFrame, point_id: str) -> DataFrame:
    """Sample one product's layers at the points, wherever its rasters cover them, and finish its columns."""
    return attach_all(points, [name], None, meta, cells, point_id)


def attach_all(points: DataFrame, products: list[str], sheet: str | Column | None, meta: DataFrame, cells: DataFrame, point_id: str) -> DataFrame:
    """Every product valid on the sheet, all in one lookup.

    ``sheet`` is one name or a column, so that each row meets the rasters of its own sheet in their own
    projection; None takes all rasters as valid.  A product that is not valid on any row's sheet adds no columns
    where ``sheet`` is one name.  Two products on one column are filled from the first that has a value.
    """
    chosen = [get(n) for n in products if not isinstance(sheet, str) or get(n).region in ("global", sheet)]
    by_raster = {r: c for c in chosen for r in c.rasters}
    pairs = [(r, v) for r, c in by_raster.items() for v in c.columns]
    if not pairs:
        return points
    wanted = F.lit(False)
    for r, c in by_raster.items():
        wanted = wanted | ((F.col("raster_id") == r) & F.col("var").isin(list(c.columns)))
    layout = raster.grids(meta.where(wanted), lambda r: by_raster[r].edge)
    # Raw columns have the product's name in front, so that products can end in one column.
    raw = lambda c, n: f"_{c.name}_{n}"
    columns = {(g.name, layer.var): raw(c, c.columns[layer.var]) for g in layout for layer in g.layers for c in [by_raster[layer.raster_id]]}
    out = points
    if columns:
        on = F.lit(sheet) if isinstance(sheet, str) else sheet
        out = raster.at_points(points, raster.tiles(cells.where(wanted), layout), layout, columns, point_id=point_id, sheet=on)
    have = set(columns.values())
    made: dict[str, list[Column]] = {}
    for c in chosen:
        own = {n: F.col(raw(c, n)) if raw(c, n) in have else F.lit(None).cast("double") for n in c.columns.values()}
        for n, v in c.finish(own).items():
            made.setdefault(n, []).append(v)
    return out.select(*points.columns, *[(F.coalesce(*vs) if len(vs) > 1 else vs[0]).alias(n) for n, vs in made.items()])


def mean_field(climatology: DataFrame) -> DataFrame:
    """Unweighted mean over hours and days per (longitude, latitude)."""
    return climatology.groupBy("longitude", "latitude").agg(F.avg("t2m").alias("t2m"))


def climatology_raster(climatology: DataFrame, raster_id: str = "temperature", var: str = "t2m") -> tuple[DataFrame, DataFrame]:
    """(meta, cells) of the mean field: longitudes wrapped, the seam closed, both axes ascending and numbered.

    The axes are those met in the table and have to be regular; the field is periodic, so the closed seam is exact.
    """
    field = mean_field(climatology).select(geo.wrap_longitude(F.col("longitude")).alias("x"), F.col("latitude").alias("y"), F.col("t2m").alias("value"))
    field = geo.close_antimeridian(field)
    ends = field.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.count_distinct("x").alias("nx"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.count_distinct("y").alias("ny"))
    step = lambda a: F.when(F.col(f"n{a}") > 1, (F.col(f"{a}1") - F.col(f"{a}0")) / (F.col(f"n{a}") - 1)).otherwise(F.lit(1.0))
    meta = ends.where("nx > 0").select(
        F.lit(raster_id).alias("raster_id"), F.lit(var).alias("var"), F.lit("bilinear").alias("method"), F.lit("global").alias("region"), F.lit("EPSG:4326").alias("crs"),
        "x0", step("x").alias("dx"), "nx", "y0", step("y").alias("dy"), "ny", F.lit(None).cast("double").alias("nodata"))
    # One row beside each cell of the field.
    at = field.crossJoin(F.broadcast(meta.select("x0", "dx", "y0", "dy")))
    cells = at.select(F.lit(raster_id).alias("raster_id"), F.lit(var).alias("var"), F.rint((F.col("y") - F.col("y0")) / F.col("dy")).cast("long").alias("row"),
                      F.rint((F.col("x") - F.col("x0")) / F.col("dx")).cast("long").alias("col"), "value")
    return meta, cells

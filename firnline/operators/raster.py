"""Rasters as tables: point sampling, strided points, boundaries, dense export.

A raster is one row per (raster_id, var) in ``meta`` (crs, x0, dx, nx, y0, dy,
ny, nodata, method; x0/y0 are the centre of pixel 0) and one row per cell in
``cells`` (raster_id, var, row, col, value).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from firnline.functions import geo
from firnline.session import moved

CENTRE, PIXEL = "centre", "pixel"
#: Rows and columns of a tile, and tiles along a side of a stored block.
TILE, TILE_GROUP = 64, 8
#: Cells that a task sorts into tiles, about 300 MB.
CELLS_PER_TASK = 1 << 19
#: Points whose values a task puts together.
POINTS_PER_TASK = 1 << 18


SPOTS = [("v00", 0, 0), ("v10", 1, 0), ("v01", 0, 1), ("v11", 1, 1)]


def blocks(cells: DataFrame, keys: Sequence[str] = ("raster_id", "var"), values: Sequence[str] = ("value",)) -> DataFrame:
    """2 x 2 blocks keyed by their low-index corner: v00, v10 (col + 1), v01 (row + 1), v11.

    Every cell goes to the four blocks it belongs to and one partial aggregation
    puts them together, so a later point lookup is a single equi-join.  With
    several value columns the corners are named ``<column>_v00`` and so on.
    """
    spread = cells.select(*keys, "row", "col", *values).withColumn("_q", F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), (F.col("row") - dr).alias("r"), (F.col("col") - dc).alias("c")) for n, dc, dr in SPOTS])))
    name = (lambda v, n: n) if len(values) == 1 else (lambda v, n: f"{v}_{n}")
    return spread.groupBy(*keys, F.col("_q.r").alias("row"), F.col("_q.c").alias("col")).agg(
        *[F.max(F.when(F.col("_q.n") == n, F.col(v))).alias(name(v, n)) for v in values for n, _, _ in SPOTS])


@dataclass(frozen=True)
class Layer:
    """One variable of a grid; categorical ones are looked up at the nearest cell."""

    raster_id: str
    var: str
    nearest: bool
    nodata: float | None


@dataclass(frozen=True)
class Grid:
    """Layers on one geometry: they share positions, tiles and the join that finds them."""

    name: str
    crs: str
    x0: float
    dx: float
    nx: int
    y0: float
    dy: float
    ny: int
    region: str
    edge: str
    layers: tuple[Layer, ...]


def grids(meta: DataFrame, edge: str | Callable[[str], str] = CENTRE, method: str | None = None) -> list[Grid]:
    """Geometries of ``meta`` with their layers; ``edge`` may be a function of the raster id.

    ``meta`` describes the layers of the products in use, a few dozen rows, and is read on the driver.
    """
    have = set(meta.columns)
    wanted = [c for c in ("raster_id", "var", "method", "crs", "x0", "dx", "nx", "y0", "dy", "ny", "nodata", "region") if c in have]
    found: dict[tuple, list[Layer]] = {}
    for r in sorted((r.asDict() for r in meta.select(*wanted).collect()), key=lambda r: (r["raster_id"], r["var"])):
        key = (r["raster_id"], r["crs"], float(r["x0"]), float(r["dx"]), int(r["nx"]), float(r["y0"]), float(r["dy"]), int(r["ny"]), r.get("region") or "global")
        nodata = None if r["nodata"] is None else float(r["nodata"])
        layer = Layer(r["raster_id"], r["var"], (method or r["method"]) == "nearest", nodata)
        if layer not in found.setdefault(key, []):
            found[key].append(layer)
    often = Counter(k[0] for k in found)
    rule = edge if callable(edge) else lambda _: edge
    return [Grid(k[0] if often[k[0]] == 1 else f"{k[0]}:{ls[0].var}", *k[1:], rule(k[0]), tuple(ls)) for k, ls in found.items()]


def tiles(cells: DataFrame, layout: Sequence[Grid], size: int = TILE) -> DataFrame:
    """Square tiles of dense values: (grid, tile_row, tile_col, layers), layers[i] for layer i of the grid.

    A tile has ``size`` rows and columns and one more of each, so that the 2 x 2 block of any of its
    cells is inside; only cells on a tile's first row or column go to a second tile.  Values are laid
    row by row; missing and nodata cells are NULL.  A tile is put together from its own cells, at
    most (size + 1)**2 for each layer.  Larger rasters are dealt to more tasks, whatever the session's number.
    """
    side = size + 1
    # One row per layer in use.
    of = cells.sparkSession.createDataFrame(
        [(l.raster_id, l.var, k, i, l.nodata) for k, g in enumerate(layout) for i, l in enumerate(g.layers)], "raster_id string, var string, grid int, layer int, nodata double")
    known = cells.where("value is not null").join(F.broadcast(of), ["raster_id", "var"]).where("not coalesce(value = nodata, false)")

    def homes(c: str) -> Column:
        """Tiles along one axis that hold a cell."""
        own = F.floor(F.col(c) / size).cast("int")
        return F.when((F.col(c) % size == 0) & (F.col(c) > 0), F.array(own - 1, own)).otherwise(F.array(own))

    spread = known.select("row", "col", "value", "grid", "layer", F.explode(homes("row")).alias("tile_row"))
    spread = spread.select("*", F.explode(homes("col")).alias("tile_col"))
    at = (F.col("row") - F.col("tile_row") * size) * side + F.col("col") - F.col("tile_col") * size
    names, n_layers = [g.name for g in layout], [len(g.layers) for g in layout]

    def dense(key: tuple, table: pa.Table) -> pa.Table:
        grid = key[0].as_py()
        n = n_layers[grid]
        values = np.full((n, side * side), np.nan)
        values[table.column("layer").to_numpy(), table.column("at").to_numpy()] = table.column("value").to_numpy()
        flat = pa.array(values.ravel(), from_pandas=True)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (side * side)), flat)
        layers = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows)
        return pa.table({"grid": [names[grid]], "tile_row": pa.array([key[1].as_py()], pa.int32()), "tile_col": pa.array([key[2].as_py()], pa.int32()), "layers": layers})

    placed = spread.select("grid", "tile_row", "tile_col", "layer", at.cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    tasks = -(-sum(g.nx * g.ny * len(g.layers) for g in layout) // CELLS_PER_TASK)
    if tasks > int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        placed = placed.repartition(tasks, "grid", "tile_row", "tile_col")
    return placed.groupBy("grid", "tile_row", "tile_col").applyInArrow(dense, "grid string, tile_row int, tile_col int, layers array<array<double>>")


def spots(points: DataFrame, layout: Sequence[Grid], *, point_id: str, sheet: Column | None = None, lon: str = "longitude", lat: str = "latitude", size: int = TILE) -> DataFrame:
    """Where each point falls on each grid that is valid for its sheet: the tile, the place in it and the weights.

    A point that a grid does not cover has no row for it, so it takes no part in the lookup.
    """
    systems = sorted({g.crs for g in layout})
    placed = points.select(point_id, lon, lat, (sheet if sheet is not None else F.lit(None).cast("string")).alias("_sheet"))
    for i, crs in enumerate(systems):
        px, py = geo.project(F.col(lon), F.col(lat), crs)
        placed = placed.withColumns({f"_px{i}": px, f"_py{i}": py})

    # One row per point and grid, with the grid's numbers beside the point; those out of range go before anything is moved.
    # Along an axis of n cells: first and last position with a nearest cell, last one with a block, and the last first cell of a block.
    def limits(n: int, edge: str) -> tuple[float, float, float, int]:
        if edge == CENTRE:
            # The last centre itself is in range: its block is the one before, with full weight on it.
            return 0.0, n - 1.0, n - 1.0, max(n - 2, 0)
        # Half to even: the end of the last pixel belongs to it if its number is even.
        return -0.5, n - 0.5 if n % 2 else math.nextafter(n - 0.5, 0), math.nextafter(n - 1.0, 0), n

    def literals(g: Grid) -> Column:
        per_axis = {f"{k}{a}": v for a, n in (("c", g.nx), ("r", g.ny)) for k, v in zip(("lo", "hi", "bl", "mx"), limits(n, g.edge))}
        fields = {"grid": g.name, "s": systems.index(g.crs), "x0": g.x0, "dx": g.dx, "y0": g.y0, "dy": g.dy, "centre": g.edge == CENTRE, **per_axis}
        region = F.lit(None if g.region == "global" else g.region).cast("string").alias("region")
        return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], region)

    each = placed.withColumn("_g", F.explode(F.array(*map(literals, layout)))).select(point_id, "_sheet", *[f"_p{a}{i}" for i in range(len(systems)) for a in "xy"], "_g.*")
    if sheet is not None:
        each = each.where("region is null or region = _sheet")

    def of_system(a: str) -> Column:
        out = F.col(f"_p{a}0")
        for i in range(1, len(systems)):
            out = F.when(F.col("s") == i, F.col(f"_p{a}{i}")).otherwise(out)
        return out

    numbers = ["centre", "loc", "hic", "blc", "mxc", "lor", "hir", "blr", "mxr"]
    each = each.select(point_id, "grid", *numbers, ((of_system("x") - F.col("x0")) / F.col("dx")).alias("fc"), ((of_system("y") - F.col("y0")) / F.col("dy")).alias("fr"))
    each = each.where("fc between loc and hic and fr between lor and hir")
    first = lambda a: F.greatest(F.least(F.floor(f"f{a}"), f"mx{a}"), F.lit(0)).cast("int").alias(a)
    near = lambda a: F.when(F.col("centre"), F.ceil(F.col(f"f{a}") - 0.5)).otherwise(F.rint(f"f{a}").cast("long")).cast("int").alias(f"near_{a}")
    block = F.expr("fc >= 0 and fc <= blc and fr >= 0 and fr <= blr").alias("block")
    each = each.select(point_id, "grid", "fc", "fr", first("c"), first("r"), near("c"), near("r"), block)
    c, r = F.col("c"), F.col("r")
    return each.select(
        point_id, "grid", F.expr(f"r div {size}").cast("int").alias("tile_row"), F.expr(f"c div {size}").cast("int").alias("tile_col"), ((r % size) * (size + 1) + c % size).alias("at"),
        F.when(F.col("block"), F.col("fc") - c).alias("u"), F.when(F.col("block"), F.col("fr") - r).alias("v"), ((F.col("near_r") - r) * (size + 1) + F.col("near_c") - c).alias("step"))


def values(found: DataFrame, tile_rows: DataFrame, layout: Sequence[Grid], *, point_id: str, size: int = TILE) -> DataFrame:
    """(point_id, grid, v0, v1, ...): the value of layer i of the grid at each spot, NULL next to a missing cell."""
    met = moved(found).join(moved(tile_rows), ["grid", "tile_row", "tile_col"])
    u, v = F.col("u"), F.col("v")
    out = []
    for i in range(max(len(g.layers) for g in layout)):
        cell = lambda d: F.get(F.get("layers", F.lit(i)), F.col("at") + d)  # noqa: B023, E731
        nearest = [g.name for g in layout if i < len(g.layers) and g.layers[i].nearest]
        blended = (cell(0) * (1 - u) + cell(1) * u) * (1 - v) + (cell(size + 1) * (1 - u) + cell(size + 2) * u) * v
        out.append((F.when(F.col("grid").isin(nearest), cell(F.col("step"))).otherwise(blended) if nearest else blended).alias(f"v{i}"))
    return met.select(point_id, "grid", *out)


def at_points(points: DataFrame, tile_rows: DataFrame | Callable[[DataFrame], DataFrame], layout: Sequence[Grid], columns: dict[tuple[str, str], str], *, point_id: str,
              sheet: Column | None = None, lon: str = "longitude", lat: str = "latitude", size: int = TILE) -> DataFrame:
    """points with one column per name in ``columns``, which maps (grid, var) to it; grids that share a name fill it together.

    All grids are looked up in one join, and one aggregation brings the values back to their points.
    ``tile_rows`` may be a function that reads the tiles of given spots.  ``point_id`` has to be unique.
    """
    found = spots(points, layout, point_id=point_id, sheet=sheet, lon=lon, lat=lat, size=size)
    looked = values(found, tile_rows(found) if callable(tile_rows) else tile_rows, layout, point_id=point_id, size=size)
    sources: dict[str, list[Column]] = {name: [] for name in columns.values()}
    for g in layout:
        for i, layer in enumerate(g.layers):
            if (g.name, layer.var) in columns:
                sources[columns[g.name, layer.var]].append(F.when(F.col("grid") == g.name, F.col(f"v{i}")))
    picked = [F.max(F.coalesce(*cs) if len(cs) > 1 else cs[0]).alias(name) for name, cs in sources.items() if cs]
    if not picked:
        return points.withColumns({n: F.lit(None).cast("double") for n in sources})
    # Rows go to their point's task before anything is put together: a task of a tile with many points would hold all of them.
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // POINTS_PER_TASK))
    wide = looked.repartition(tasks, point_id).groupBy(point_id).agg(*picked).withColumnRenamed(point_id, "_id")
    joined = moved(points).join(moved(wide), points[point_id] == F.col("_id"), "left").drop("_id")
    absent = {n: F.lit(None).cast("double") for n, cs in sources.items() if not cs}
    return joined.withColumns(absent) if absent else joined


def sample(points: DataFrame, meta: DataFrame, cells: DataFrame, *, point_id: str, method: str = "bilinear",
           edge: str = CENTRE, lon: str = "longitude", lat: str = "latitude", size: int = TILE) -> DataFrame:
    """Value of every layer at every point: (point_id, raster_id, var, value).

    ``edge="centre"``: positions from the first to the last pixel centre are in
    range, both ends included; nearest takes the lower index at a tie.
    ``edge="pixel"``: affine reads; nearest rounds half to even and covers whole
    pixels, bilinear needs a pixel to the right and below even at weight zero.
    Missing corners, nodata and positions out of range give NULL.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown sampling method {method!r}")
    layout = grids(meta, edge, method)
    names = {(g.name, layer.var): f"_v{k}_{i}" for k, g in enumerate(layout) for i, layer in enumerate(g.layers)}
    wide = at_points(points.select(point_id, lon, lat), tiles(cells, layout, size), layout, names, point_id=point_id, lon=lon, lat=lat, size=size)
    each = F.array(*[F.struct(F.lit(layer.raster_id).alias("raster_id"), F.lit(layer.var).alias("var"), F.col(names[g.name, layer.var]).alias("value")) for g in layout for layer in g.layers])
    return wide.select(point_id, F.explode(each).alias("_e")).select(point_id, "_e.*")


def attach(points: DataFrame, meta: DataFrame, cells: DataFrame, names: dict[str, str], *, point_id: str,
           edge: str = CENTRE, lon: str = "longitude", lat: str = "latitude", size: int = TILE) -> DataFrame:
    """All layers as columns: nearest for categorical ones, bilinear for the rest, one row per point."""
    layout = grids(meta.where(F.col("var").isin(list(names))), edge)
    if not layout:
        return points.withColumns({n: F.lit(None).cast("double") for n in names.values()})
    columns = {(g.name, layer.var): names[layer.var] for g in layout for layer in g.layers}
    out = at_points(points, tiles(cells, layout, size), layout, columns, point_id=point_id, lon=lon, lat=lat, size=size)
    absent = [n for n in names.values() if n not in columns.values()]
    return out.withColumns({n: F.lit(None).cast("double") for n in absent}) if absent else out


def write_tiles(tile_rows: DataFrame, path: str, group: int = TILE_GROUP) -> None:
    """Keep tiles as files: a folder per grid and per block of ``group`` x ``group`` tiles."""
    kept = tile_rows.withColumn("block", _block(group))
    kept.repartition("grid", "block").sortWithinPartitions("grid", "block", "tile_row", "tile_col").write.partitionBy("grid", "block").parquet(path)


def _block(group: int) -> Column:
    return F.concat_ws("_", F.floor(F.col("tile_row") / group).cast("int"), F.floor(F.col("tile_col") / group).cast("int"))


def read_tiles(spark: SparkSession, path: str, found: DataFrame, group: int = TILE_GROUP) -> DataFrame:
    """Kept tiles that spots fall on: folders without a spot are not listed among the files to read, tiles without one are dropped.

    The list of folders is collected; there are no more of them than the store has, however many points there are.
    """
    keys = found.select("grid", "tile_row", "tile_col").distinct()
    wanted: dict[str, list[str]] = {}
    for r in keys.select("grid", _block(group).alias("block")).distinct().collect():
        wanted.setdefault(r["grid"], []).append(r["block"])
    kept = spark.read.schema("tile_row int, tile_col int, layers array<array<double>>, grid string, block string").parquet(path)
    held = F.lit(False)
    for grid, names in sorted(wanted.items()):
        held = held | ((F.col("grid") == grid) & F.col("block").isin(sorted(names)))
    return kept.where(held).drop("block").join(keys, ["grid", "tile_row", "tile_col"], "left_semi")


def region_layers(meta: DataFrame, sheet: str) -> DataFrame:
    """Layers valid on a sheet: its own and the global ones."""
    return meta.where(F.col("region").isin("global", sheet))


def strided_points(meta_row: dict, cells: DataFrame, stride: int, mask_values: Sequence[int]) -> DataFrame:
    """Every ``stride``-th cell whose mask value is wanted, with positions and degrees."""
    m = meta_row
    kept = cells.where(
        (F.col("raster_id") == m["raster_id"]) & (F.col("var") == m["var"])
        & (F.col("row") % stride == 0) & (F.col("col") % stride == 0) & F.col("value").isin([float(v) for v in mask_values]))
    x = F.lit(float(m["x0"])) + F.col("col") * F.lit(float(m["dx"]))
    y = F.lit(float(m["y0"])) + F.col("row") * F.lit(float(m["dy"]))
    pts = kept.select(
        F.expr(f"col div {stride}").cast("int").alias("grid_ix"), F.expr(f"row div {stride}").cast("int").alias("grid_iy"),
        x.alias("x"), y.alias("y"))
    lon, lat = geo.unproject(F.col("x"), F.col("y"), m["crs"])
    return pts.withColumns({"longitude": lon, "latitude": lat})


def boundary_segments(cells: DataFrame, inside: Column, valid: Column | None = None) -> DataFrame:
    """Level-0.5 boundary of a yes/no field, one row per segment of a crossed 2 x 2 block.

    The four corner bits of a block say which of its edges are crossed; a
    crossing sits halfway along its edge because the field is 0 or 1.  Blocks
    with a missing or invalid corner are skipped.
    """
    z = F.when(valid if valid is not None else F.lit(True), inside.cast("int"))
    b = blocks(cells.select("row", "col", z.alias("z")), keys=(), values=("z",))
    code = F.col("v00") + 2 * F.col("v10") + 4 * F.col("v11") + 8 * F.col("v01")
    mid = {"t": (0.5, 0.0), "r": (1.0, 0.5), "b": (0.5, 1.0), "l": (0.0, 0.5)}
    # Crossed edges (top, right, bottom, left) per corner code; a saddle has two segments.
    crossed = {1: ["tl"], 2: ["tr"], 3: ["lr"], 4: ["rb"], 5: ["tl", "rb"], 6: ["tb"], 7: ["lb"],
               8: ["lb"], 9: ["tb"], 10: ["tr", "lb"], 11: ["rb"], 12: ["lr"], 13: ["tr"], 14: ["tl"]}
    segments = None
    for n, pairs in crossed.items():
        items = F.array(*[F.struct(
            (F.col("col") + mid[p][0]).alias("x0"), (F.col("row") + mid[p][1]).alias("y0"),
            (F.col("col") + mid[q][0]).alias("x1"), (F.col("row") + mid[q][1]).alias("y1")) for p, q in pairs])
        segments = F.when(F.col("code") == n, items) if segments is None else segments.when(F.col("code") == n, items)
    return b.withColumn("code", code).where("code between 1 and 14").select(
        "row", "col", "code", F.explode(segments).alias("s")).select("row", "col", "code", "s.*")


def dense_layers(points: DataFrame, geometry: DataFrame, layers: dict[str, str], fold: str | None = "fold",
                 test: str | None = "is_test", test_code: int = 100) -> DataFrame:
    """One row for every raster cell of every sheet; float layers NULL where no point lies,
    the fold layer -1 there and ``test_code`` on test points."""
    rows = geometry.select("ice_sheet", F.col("nx").alias("_nx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("grid_iy"))
    frame = rows.select("ice_sheet", "grid_iy", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)).alias("grid_ix"))
    cols = [F.col(src).cast("float").alias(name) for name, src in layers.items()]
    if fold:
        code = F.when(F.col(test), test_code).otherwise(F.col(fold)) if test else F.col(fold)
        cols.append(code.cast("int").alias("fold"))
    have = points.select("ice_sheet", "grid_iy", "grid_ix", *cols)
    out = frame.join(have, ["ice_sheet", "grid_iy", "grid_ix"], "left")
    return out.withColumn("fold", F.coalesce("fold", F.lit(-1))) if fold else out


def packed_cells(points: DataFrame, nx: int, stride: int = 1, mu_scale: float = 10.0, sd_scale: float = 4.0) -> DataFrame:
    """Valid cells as small integers: clip to the field's range, then truncate."""
    def clip(c: Column, lo: float, hi: float, t: str) -> Column:
        return F.least(F.greatest(c, F.lit(lo)), F.lit(hi)).cast(t)

    out_nx = -(-nx // stride)
    kept = points.where(
        (F.col("grid_ix") % stride == 0) & (F.col("grid_iy") % stride == 0) & F.col("pred_mean").isNotNull()
        & F.col("pred_std").isNotNull() & F.col("bedmachine_thickness_m").isNotNull()
        & F.coalesce(F.col("bedmachine_mask") > 0, F.lit(False)))
    return kept.select(
        (F.expr(f"grid_iy div {stride}").cast("long") * out_nx + F.expr(f"grid_ix div {stride}")).alias("idx"),
        clip(F.col("bedmachine_thickness_m"), 0.0, 65535.0, "int").alias("thk"),
        clip(F.col("pred_mean") * mu_scale, -32768.0, 32767.0, "int").alias("mu"),
        clip(F.col("pred_std") * sd_scale, 0.0, 255.0, "int").alias("sd"),
        F.col("bedmachine_mask").cast("int").alias("mask"))

"""Near-neighbour joins on a plane as equi-joins over grid cells.

Right-hand points are summarised into fine cells (bounding box and count).
Each left point meets the summaries around it, keeps only the cells that can
still hold one of its k nearest, and meets the points of those cells alone.
Copies at one position count as one candidate position (the k smallest ids
decide ties).  A cell that is too full is cut into smaller ones, and only that
cell: a dense place costs nothing elsewhere.  Results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from firnline.session import cut_lineage, moved

FIRST_SPLIT = 8
LEAF_POINTS = 4096
#: Width in radii of the blocks that balls are counted in.
BALL_BLOCK = 4


def with_leaves(points: DataFrame, keys: list[str], radius: float, x: str, y: str, leaf_points: int = LEAF_POINTS) -> tuple[DataFrame, int]:
    """points (distinct positions) with the cell they are in, level ``_lv`` and numbers ``_fx``, ``_fy``; and the deepest level.

    A cell of level n is ``radius / FIRST_SPLIT ** n`` wide. Cells over ``leaf_points`` positions go
    one level down, cell by cell, until none is left; most tables need a single check.
    """
    on = [*keys, "_fx", "_fy"]
    level, rest, settled = 1, points, None
    while True:
        size = radius / FIRST_SPLIT**level
        placed = rest.withColumns({"_lv": F.lit(level), "_fx": F.floor(F.col(x) / size), "_fy": F.floor(F.col(y) / size)})
        full = placed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > leaf_points).drop("_n")
        # Below a billionth of a radius positions are as good as equal.
        last = size < radius * 1e-9
        if not last:
            full = cut_lineage(full)
            last = full.isEmpty()
        if last:
            return (placed if settled is None else settled.unionByName(placed)), level
        same = _same(on)
        full = full.withColumnsRenamed({k: f"_h{k}" for k in on})
        done = placed.join(moved(full), same, "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        rest = cut_lineage(placed.join(moved(full), same, "left_semi").drop("_lv", "_fx", "_fy"))
        level += 1


def _nodes(leaves: DataFrame, keys: list[str], radius: float, x: str, y: str, level: int) -> DataFrame:
    """Summaries of all cells of one level, whole or cut: box, positions, and whether the cell is cut further."""
    size = radius / FIRST_SPLIT**level
    return leaves.where(F.col("_lv") >= level).groupBy(*keys, F.floor(F.col(x) / size).alias("_nx"), F.floor(F.col(y) / size).alias("_ny")).agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"), F.sum("_copies").alias("_nc"), (F.max("_lv") > level).alias("_cut"))


def _same(on: list[str]) -> Column:
    out = F.lit(True)
    for k in on:
        out = out & F.col(k).eqNullSafe(F.col(f"_h{k}"))
    return out


def _around(cells: DataFrame, radius: float) -> DataFrame:
    """Summaries repeated for the nine coarse cells that may look at them."""
    coarse_x, coarse_y = F.floor(F.col("_x0") / radius), F.floor(F.col("_y0") / radius)
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return (
        cells.withColumns({"_ox": coarse_x, "_oy": coarse_y})
        .withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
        .withColumns({"_cx": F.col("_ox") + F.col("_dx"), "_cy": F.col("_oy") + F.col("_dy")})
        .drop("_ox", "_oy", "_dx", "_dy")
    )


def _cells(leaves: DataFrame, keys: list[str], radius: float, x: str, y: str) -> DataFrame:
    """Summaries of leaf cells, repeated for the blocks with places nearer than the radius: one block for most, four at a corner."""
    fine = leaves.groupBy(*keys, "_lv", "_fx", "_fy").agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"),
        F.sum("_copies").alias("_nc"))
    wide = BALL_BLOCK * radius

    def met(lo: str, hi: str) -> Column:
        # A hair more than the radius, against rounding.
        reach = radius * (1 + 1e-9)
        return F.explode(F.sequence(F.floor((F.col(lo) - reach) / wide), F.floor((F.col(hi) + reach) / wide)))

    return fine.withColumn("_cx", met("_x0", "_x1")).withColumn("_cy", met("_y0", "_y1"))


def _gap(v: Column, lo: str, hi: str) -> Column:
    return F.greatest(F.col(lo) - v, v - F.col(hi), F.lit(0.0))


def _reach(v: Column, lo: str, hi: str) -> Column:
    return F.greatest(F.abs(v - F.col(lo)), F.abs(v - F.col(hi)))


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    *,
    k: int = 1,
    strict: bool = True,
    left_id: str = "left_id",
    right_id: str = "right_id",
    on: Sequence[str] = (),
    per: Sequence[str] = (),
    keep: Callable[[], Column] | None = None,
    carry: Sequence[str] = (),
    xy: tuple[str, str] = ("x", "y"),
    leaf_points: int = LEAF_POINTS,
) -> DataFrame:
    """The k nearest right points of every left point inside ``radius``.

    ``on``   columns that must be equal on both sides.
    ``per``  right-hand columns; the k nearest are taken for each of their values.
    ``keep`` extra condition between left ``carry`` columns and right ``per`` columns.
    Returns left_id, carry, per, right_id, dist, rank; ties go to the smaller right_id.
    """
    on, per, carry = list(on), list(per), list(carry)
    x, y = xy
    keys = [*on, *per]
    r2 = float(radius) ** 2
    points = right.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(right_id), F.col(x).cast("double").alias("_rx"), F.col(y).cast("double").alias("_ry"))
    if k == 1:
        points = points.groupBy(*keys, "_rx", "_ry").agg(F.min(right_id).alias(right_id)).withColumn("_copies", F.lit(1))
    else:
        w = W.partitionBy(*keys, "_rx", "_ry").orderBy(right_id)
        points = points.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn").withColumn(
            "_copies", F.lit(1))
    leaf, depth = with_leaves(points, keys, radius, "_rx", "_ry", leaf_points)
    seekers = left.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *on, F.col(left_id).alias("_lid"), *carry, F.col(x).cast("double").alias("_lx"), F.col(y).cast("double").alias("_ly"))
    cand = candidates(seekers, leaf, depth, radius, on=on, per=per, carry=carry, k=k, keep=keep)
    lx, ly = F.col("_lx"), F.col("_ly")
    d2 = F.pow(F.col("_rx") - lx, 2) + F.pow(F.col("_ry") - ly, 2)
    pairs = cand.join(moved(leaf.drop("_copies")), [*keys, "_lv", "_fx", "_fy"]).withColumn("_d2", d2)
    pairs = pairs.where(F.col("_d2") < r2 if strict else F.col("_d2") <= r2)
    if k == 1:
        # The nearest is a minimum: tasks bring one row per point and cell set to the shuffle.
        best = pairs.groupBy("_lid", *carry, *per).agg(F.min(F.struct("_d2", right_id)).alias("_b")).select("_lid", *carry, *per, "_b.*")
        return best.select(F.col("_lid").alias(left_id), *carry, *per, right_id, F.sqrt("_d2").alias("dist"), F.lit(1).alias("rank"))
    rank = F.row_number().over(W.partitionBy("_lid", *per).orderBy("_d2", right_id))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("_lid").alias(left_id), *carry, *per, right_id, F.sqrt("_d2").alias("dist"), "rank")


def candidates(seekers: DataFrame, leaf: DataFrame, depth: int, radius: float, *, on: list[str], per: list[str], carry: list[str], k: int = 1,
               keep: Callable[[], Column] | None = None) -> DataFrame:
    """(on, _lid, carry, per, _lx, _ly, _lv, _fx, _fy): leaf cells that may hold one of the k nearest of each seeker.

    Seekers meet the cells of level 1 in their 3 x 3 coarse cells.  Seekers and cells are moved by coarse cell and stay there
    for both passes: the first finds how far the k-th can be at most, the second keeps the cells that begin
    nearer.  Only kept cells that are cut are followed to their parts, level by level, with the bound
    drawn in each time, so a dense place costs a seeker no more than the cells its bound crosses.
    """
    keys = [*on, *per]
    r2 = float(radius) ** 2
    lx, ly = F.col("_lx"), F.col("_ly")
    low2 = F.pow(_gap(lx, "_x0", "_x1"), 2) + F.pow(_gap(ly, "_y0", "_y1"), 2)
    high2 = F.pow(_reach(lx, "_x0", "_x1"), 2) + F.pow(_reach(ly, "_y0", "_y1"), 2)
    mine = [*on, "_lid", *carry, *per, "_lx", "_ly"]

    def bounded(met: DataFrame, group: list[str]) -> DataFrame:
        """met with the square of the distance that the k-th nearest does not pass, from counts of cells in order of their far corners."""
        over = W.partitionBy(*group)
        if k == 1:
            return met.withColumn("_most", F.min("_high").over(over))
        cum = F.sum("_nc").over(over.orderBy("_high", "_nx", "_ny").rowsBetween(W.unboundedPreceding, 0))
        met = met.withColumn("_cum", cum)
        return met.withColumn("_most", F.min(F.when(F.col("_cum") >= k, F.col("_high"))).over(over)).drop("_cum")

    # A hair of slack keeps rounding of the two bounds from dropping the winner.
    inside = F.col("_low") <= F.least(F.coalesce("_most", F.lit(r2)), F.lit(r2)) * (1 + 1e-12) + 1e-9
    first = _nodes(leaf, keys, radius, "_rx", "_ry", 1)
    around = _around(first, radius)
    placed = seekers.withColumns({"_cx": F.floor(lx / radius), "_cy": F.floor(ly / radius)})

    def met_with(rows: DataFrame) -> DataFrame:
        met = rows.join(moved(around), [*on, "_cx", "_cy"])
        if keep is not None:
            met = met.where(keep())
        return met.withColumns({"_low": low2, "_high": high2}).where(F.col("_low") <= r2)

    here = [*on, "_cx", "_cy", "_lid", *carry, "_lx", "_ly"]
    if k == 1 and not per:
        # Rows of a seeker are in one place by its coarse cell: a minimum without a further shuffle, no order needed.
        far = met_with(placed).groupBy(*here).agg(F.min("_high").alias("_most"))
        cand = met_with(far).where(inside)
    else:
        cand = bounded(met_with(placed), [*on, "_cx", "_cy", "_lid", *per]).where(inside)
    cand = cand.select(*mine, F.lit(1).alias("_lv"), "_nx", "_ny", "_cut", "_nc", "_high", "_most")
    for level in range(2, depth + 1):
        # What is kept is read twice below.
        cand = cut_lineage(cand)
        parts = _nodes(leaf, keys, radius, "_rx", "_ry", level).withColumns(
            {"_qx": F.floor(F.col("_nx") / FIRST_SPLIT), "_qy": F.floor(F.col("_ny") / FIRST_SPLIT)})
        cut = cand.where("_cut").select(*mine, F.col("_nx").alias("_qx"), F.col("_ny").alias("_qy"), F.col("_most").alias("_before"))
        opened = cut.join(moved(parts), [*keys, "_qx", "_qy"]).withColumns({"_low": low2, "_high": high2}).where(F.col("_low") <= F.least("_before", F.lit(r2)) * (1 + 1e-12) + 1e-9)
        opened = opened.select(*mine, F.lit(level).alias("_lv"), "_nx", "_ny", "_cut", "_nc", "_high", "_low")
        whole = cand.where("not _cut").withColumn("_low", F.lit(0.0)).select(*opened.columns)
        cand = bounded(whole.unionByName(opened), ["_lid", *per]).where(inside).drop("_low")
    return cand.select(*mine, "_lv", F.col("_nx").alias("_fx"), F.col("_ny").alias("_fy"))


def ball_counts(df: DataFrame, radius: float, *, id_col: str, on: Sequence[str] = (), xy: tuple[str, str] = ("x", "y"),
                name: str = "n_ball", leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Points within ``radius`` (inclusive, self counted) of every point.

    Cells wholly inside the ball add their count without being opened; only
    cells crossed by its edge are compared point by point.
    """
    on = list(on)
    x, y = xy
    r2 = float(radius) ** 2
    places = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        *on, F.col(x).cast("double").alias("_rx"), F.col(y).cast("double").alias("_ry")).agg(F.count(F.lit(1)).alias("_copies"))
    leaf, _ = with_leaves(places, on, radius, "_rx", "_ry", leaf_points)
    cells = _cells(leaf, on, radius, "_rx", "_ry")
    wide = BALL_BLOCK * radius
    lx, ly = F.col("_lx"), F.col("_ly")
    centres = places.select(*on, F.col("_rx").alias("_lx"), F.col("_ry").alias("_ly")).withColumns(
        {"_cx": F.floor(lx / wide), "_cy": F.floor(ly / wide)})
    low2 = F.pow(_gap(lx, "_x0", "_x1"), 2) + F.pow(_gap(ly, "_y0", "_y1"), 2)
    high2 = F.pow(_reach(lx, "_x0", "_x1"), 2) + F.pow(_reach(ly, "_y0", "_y1"), 2)
    met = centres.join(moved(cells), [*on, "_cx", "_cy"]).withColumns({"_low": low2, "_high": high2}).where(F.col("_low") <= r2 + 1e-9)
    inside = F.col("_high") <= r2 - 1e-6
    whole = met.where(inside).select(*on, "_lx", "_ly", F.col("_nc").alias("_c"))
    edge = met.where(~inside).select(*on, "_lx", "_ly", "_lv", "_fx", "_fy").join(moved(leaf), [*on, "_lv", "_fx", "_fy"]).where(
        F.pow(F.col("_rx") - lx, 2) + F.pow(F.col("_ry") - ly, 2) <= r2).select(*on, "_lx", "_ly", F.col("_copies").alias("_c"))
    balls = whole.unionByName(edge).groupBy(*on, "_lx", "_ly").agg(F.sum("_c").alias(name))
    mine = df.select(*on, id_col, F.col(x).cast("double").alias("_lx"), F.col(y).cast("double").alias("_ly"))
    return mine.join(moved(balls), [*on, "_lx", "_ly"]).select(id_col, *on, name)

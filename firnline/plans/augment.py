"""Augment traces with covariates, and build the covariate grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from firnline.operators import raster
from firnline.plans import lineage
from firnline.sources import covariates, stages, traces as trace_source


def augment(traces: DataFrame, snapshot_id: str, products: Sequence[str], sheet: str, meta: DataFrame, cells: DataFrame,
            **extract) -> DataFrame:
    """Pinned traces with every valid product's columns, joined by trace id."""
    pts = trace_source.extract(traces, snapshot_id, **extract)
    return covariates.attach_all(pts, list(products), sheet, meta, cells, "trace_id")


def build_grid(mask_rows: dict[str, dict], cells: DataFrame, stride: int, mask_values: Sequence[int],
               products: Sequence[str], meta: DataFrame) -> DataFrame:
    """Ice points of every sheet with their covariates; ``mask_rows`` maps sheet to its mask layer."""
    out = None
    for sheet, row in mask_rows.items():
        pts = raster.strided_points(row, cells, stride, mask_values).withColumns({
            "ice_sheet": F.lit(sheet), "grid_id": F.concat_ws(":", F.lit(sheet), "grid_iy", "grid_ix")})
        pts = covariates.attach_all(pts, list(products), sheet, meta, cells, "grid_id")
        out = pts if out is None else out.unionByName(pts, allowMissingColumns=True)
    return out


def write_augmented(df: DataFrame, path: str, config: dict, input_ids: list[str]) -> dict:
    seasons = [r[0] for r in df.select("collection").distinct().orderBy("collection").collect()]
    m = lineage.manifest("augment", config, input_ids, seasons=seasons)
    stages.write_stage(df.withColumn("run_id", F.lit(m["run_id"])), m, path)
    return m

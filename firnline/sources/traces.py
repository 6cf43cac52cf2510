"""Trace tables: pinned snapshots, pooling of stores, season names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from firnline.operators import qc
from firnline.schema import CARRY_COLUMNS, missing_as_null


def resolve_snapshot(snapshots: DataFrame, branch: str = "main") -> DataFrame:
    """Latest snapshot id of a branch (ties by the larger id)."""
    return snapshots.where(F.col("branch") == branch).groupBy("branch").agg(
        F.max(F.struct("committed_at", "snapshot_id"))["snapshot_id"].alias("snapshot_id"))


def carried(df: DataFrame, columns: Sequence[str] = CARRY_COLUMNS, always: Sequence[str] = ()) -> DataFrame:
    """The carried columns the table really has."""
    have = set(df.columns)
    return df.select(*[c for c in dict.fromkeys([*always, *columns]) if c in have])


def pinned(df: DataFrame, snapshot_id: str | None) -> DataFrame:
    """Rows of one snapshot; a partition filter when the table is partitioned by it."""
    if not snapshot_id:
        raise ValueError("snapshot_id is required: reads are pinned")
    return df.where(F.col("snapshot_id") == snapshot_id)


def extract(df: DataFrame, snapshot_id: str | None, columns: Sequence[str] = CARRY_COLUMNS, *, key: str = "trace_id",
            qc_only: bool = True, include_nondetections: bool = False, min_thickness_m: float | None = None,
            max_traces: int | None = None) -> DataFrame:
    """Pinned, filtered, projected traces."""
    rows = pinned(missing_as_null(df), snapshot_id)
    rows = qc.min_thickness(qc.passing_traces(rows, qc_only, include_nondetections), min_thickness_m)
    rows = carried(rows, columns, always=[key, "collection", "latitude", "longitude"])
    return first_traces(rows, max_traces, key) if max_traces is not None else rows


def first_traces(df: DataFrame, n: int, key: str = "trace_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def read_store(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = missing_as_null(spark.read.parquet(path))
    return carried(df, columns) if columns else df


def decode_time(seconds: Column, epoch_seconds: float = 0.0) -> Column:
    """Seconds since an epoch to a timestamp."""
    return F.timestamp_micros(F.rint((seconds + F.lit(float(epoch_seconds))) * 1e6).cast("long"))


def with_season(df: DataFrame, seasons: DataFrame, index: str = "frame_index") -> DataFrame:
    """Season name by integer index, empty text where the index has none."""
    return df.join(seasons, index, "left").withColumn("collection", F.coalesce("collection", F.lit("")))


def pool(stores: dict[str, DataFrame]) -> DataFrame:
    """Stores put together; a column a store lacks is NULL there."""
    out = None
    for name, df in stores.items():
        part = df.withColumn("store", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

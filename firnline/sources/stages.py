"""Stage outputs: a Parquet table with its manifest beside it, CSV exports, metrics tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Dataset prefixes and the labels they are shown under.
SOURCE_LABELS = {
    "bedmachine_antarctic": "BedMachine Antarctica v{version}",
    "bedmachine_greenland": "BedMachine Greenland v{version}",
    "measures_phase_vel_antarctic": "MEaSUREs phase-based ice velocity",
    "itslive_greenland": "ITS_LIVE ice velocity v{version}",
    "era5_t2m": "ERA5 2 m air temperature ({version})",
    "ghf_antarctic": "Geothermal heat flow, Antarctica",
    "ghf_greenland": "Geothermal heat flow, Greenland",
}


def write_stage(df: DataFrame, manifest: dict, path: str, partition_by: list[str] | None = None) -> str:
    """Write the table and a one-row JSON dataset ``<path>.manifest``."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}.manifest")
    return path


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{path}.manifest")


def write_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "value") -> str:
    """One file per row, in a folder named by its key, so that a file that cannot be read still says whose it is."""
    rows = docs.select(key, F.col(text).alias("value")).repartition(key).sortWithinPartitions(key)
    # Tasks put their files in place themselves; else the driver would move them all, one after the other.
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(path)
    return path


def read_documents(spark: SparkSession, path: str, schema: str, wanted: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, path, state, columns of ``schema``) of every JSON document below ``path``, each a file of any number of lines.

    ``state`` is ``ok``; ``corrupt`` for a file that is no JSON document or has a value of another kind; and, where the keys that
    should be there are given, ``absent`` for those without a file and ``unasked`` for files without such a key.
    """
    found = spark.read.schema(f"{schema}, _corrupt string, {key} long").option("multiLine", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").json(path)
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    rows = found.select(key, F.col("_metadata.file_path").alias("path"), F.when(F.col("_corrupt").isNotNull(), "corrupt").otherwise("ok").alias("state"), *fields)
    # Of a broken document no value counts, not even those before the break.
    rows = rows.select(key, "path", "state", *[F.when(F.col("state") == "ok", F.col(n)).alias(n) for n in fields])
    if wanted is None:
        return rows
    asked = wanted.select(key).distinct().withColumn("_asked", F.lit(True))
    joined = asked.join(rows, key, "full")
    state = F.when(F.col("path").isNull(), "absent").when(F.col("_asked").isNull(), "unasked").otherwise(F.col("state"))
    return joined.withColumn("state", state).drop("_asked")


def read_run_id(spark: SparkSession, path: str) -> str:
    return read_manifest(spark, path, "run_id string").first()["run_id"]


def to_csv(df: DataFrame, path: str, run_id: str, drop: tuple[str, ...] = ("geometry",)) -> str:
    """CSV parts with a header, without geometry; the run id is a one-line comment part."""
    df.drop(*drop).write.mode("overwrite").option("header", True).csv(path)
    spark = df.sparkSession
    spark.createDataFrame([(f"# run_id={run_id}",)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


METRICS_SCHEMA = """
    model string, run_id string,
    pooled_cv struct<rmse_dB: struct<mean: double, min: double, max: double>, mae_dB: struct<mean: double>,
                     coverage_1sigma: struct<mean: double>, logscore_dB: struct<mean: double>, n_points: bigint>,
    censoring struct<enabled: boolean>, test struct<rmse_dB: double>
"""


def benchmark_rows(metrics: DataFrame) -> DataFrame:
    """One comparison row per metrics document, best model first."""
    cv = "pooled_cv"
    return metrics.select(
        "model",
        F.bround(f"{cv}.rmse_dB.mean", 3).alias("cv_rmse_dB"), F.bround(f"{cv}.rmse_dB.min", 3).alias("cv_rmse_min"),
        F.bround(f"{cv}.rmse_dB.max", 3).alias("cv_rmse_max"), F.bround(f"{cv}.mae_dB.mean", 3).alias("cv_mae_dB"),
        F.bround(f"{cv}.coverage_1sigma.mean", 3).alias("cv_coverage_1sigma"),
        F.bround(f"{cv}.logscore_dB.mean", 3).alias("cv_logscore_dB"),
        F.coalesce("censoring.enabled", F.lit(False)).alias("censored"),
        F.bround("test.rmse_dB", 3).alias("test_rmse_dB"), F.col(f"{cv}.n_points").alias("n_train"), "run_id",
    ).orderBy("cv_rmse_dB")


def source_labels(name: Column, version: Column) -> Column:
    """Label of a dataset by the first matching prefix, else its own name."""
    out = name
    for prefix, label in reversed(SOURCE_LABELS.items()):
        out = F.when(name.startswith(prefix), F.lit(label)).otherwise(out)
    return F.replace(out, F.lit("{version}"), F.coalesce(version, F.lit("")))

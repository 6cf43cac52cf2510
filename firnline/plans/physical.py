"""Coefficients of the attenuation model in physical units."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from firnline.functions.labels import INDICATORS
from firnline.schema import TARGET, THICKNESS


def physical_coefficients(posterior: DataFrame, norm: DataFrame) -> DataFrame:
    """dB/km for attenuation terms, sign-flipped dB for reflectivity terms, per original unit of the covariate.

    ``posterior`` has (param, mean); ``norm`` is the one-row statistics table of
    the fit, whose columns are ``<name>__sd``.
    """
    base = F.regexp_replace(F.regexp_extract("param", r"\[(.*)\]", 1), "^(" + "|".join(INDICATORS) + ")_x_", "")
    stats = norm.first().asDict()
    sd = {n[: -len("__sd")]: float(v) for n, v in stats.items() if n.endswith("__sd")}
    by_name = F.create_map(*[F.lit(v) for n in sd for v in (n, sd[n])])
    j = posterior.withColumn("_base", base)
    per = F.when((F.col("_base") == "") | F.col("_base").isin(list(INDICATORS)), 1.0).otherwise(F.try_element_at(by_name, F.col("_base")))
    atten = F.col("param").contains("atten")
    sy, st = F.lit(sd[TARGET]), F.lit(sd[THICKNESS])
    value = F.when(atten, F.col("mean") * sy / st * 1000 / per).otherwise(-F.col("mean") * sy / per)
    return j.select(*posterior.columns, value.alias("value"), F.when(atten, "dB/km").otherwise("dB").alias("unit"))

"""Normal distribution: column expressions, and array versions for Python tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Five-term rational approximation of the normal CDF (error about 1e-7).
CDF_T = 0.2316419
CDF_PHI0 = 0.3989422804014327
CDF_COEF = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + F.lit(CDF_T) * F.abs(z))
    poly = F.lit(CDF_COEF[-1])
    for c in reversed(CDF_COEF[:-1]):
        poly = F.lit(c) + t * poly
    tail = F.lit(CDF_PHI0) * F.exp(-z * z / 2) * t * poly
    return F.when(z > 0, 1 - tail).otherwise(tail)


def log_normal_cdf(z: Column) -> Column:
    """log of the CDF; the far left tail uses the asymptotic series."""
    s = 1 / (z * z)
    tail = -z * z / 2 - F.log(-z) - F.lit(0.5 * math.log(2 * math.pi)) + F.log1p(-s + 3 * s * s - 15 * s * s * s)
    return F.when(z < -6.0, tail).otherwise(F.log(normal_cdf(z)))


def add_db(a: Column, b: Column) -> Column:
    """Power sum of two levels in dB, stable for any difference."""
    k = math.log(10) / 10
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b) * k)) / k


def soft_min(a: Column, b: Column, sharpness: float = 1.0) -> Column:
    return F.least(a, b) - F.log1p(F.exp(-F.abs(a - b) * sharpness)) / sharpness


def hash_normal(key: Column, seed: int) -> Column:
    """Standard normal noise from a key: the same row gets the same value at any partitioning, and in any SQL engine with md5."""

    def uniform(i: int) -> Column:
        digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}:{i}")).cast("binary")), 1, 13)
        return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))

    u = [uniform(1), uniform(2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(F.lit(2 * math.pi) * u[1])


def hash_normal_sql(key: str, seed: int) -> str:
    """The same as SQL text."""
    u = [f"((CAST(concat('0x', substr(md5(concat(CAST({key} AS VARCHAR), ':{seed}:{i}')), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0)" for i in (1, 2)]
    return f"(sqrt(-2e0 * ln({u[0]})) * cos(2e0 * pi() * {u[1]}))"


def np_log_cdf(z: np.ndarray) -> np.ndarray:
    """log CDF for arrays: odd-power series in the centre, continued fraction in the tail."""
    z = np.asarray(z, dtype="float64")
    out = np.empty_like(z)
    left, right = z < -3.0, z > 3.0
    mid = ~(left | right)
    if mid.any():
        v = z[mid]
        term, acc = v.copy(), v.copy()
        for k in range(1, 60):
            term = term * v * v / (2 * k + 1)
            acc = acc + term
        out[mid] = np.log(0.5 + acc * np.exp(-v * v / 2) / math.sqrt(2 * math.pi))
    for side, flip in ((left, True), (right, False)):
        if side.any():
            a = np.abs(z[side])
            frac = a.copy()
            for k in range(60, 0, -1):
                frac = a + k / frac
            log_tail = -a * a / 2 - 0.5 * math.log(2 * math.pi) - np.log(frac)
            out[side] = log_tail if flip else np.log1p(-np.exp(log_tail))
    return out


def np_mills(z: np.ndarray, log_cdf: np.ndarray) -> np.ndarray:
    """Density over CDF."""
    return np.exp(-z * z / 2 - 0.5 * math.log(2 * math.pi) - log_cdf)

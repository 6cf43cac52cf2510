"""Detection curves: P(detect | margin) = (1 - pi) Phi((margin - theta) / tau) per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from firnline.functions.normal import np_log_cdf
from firnline.session import cut_lineage

# The three starting points (theta, tau, logit pi).
STARTS = [(8.0, 3.0, -4.0), (15.0, 5.0, -3.0), (5.0, 2.0, -5.0)]


def fit_mixture_probit(df: DataFrame, group: str, margin: str, detected: str, *, pooled: str = "ALL", max_iter: int = 300,
                       tol: float = 1e-5) -> DataFrame:
    """Maximum likelihood per group and for all rows together.

    Rows are first counted per (group, margin, detected).  Each scoring step is
    one distributed sum of score and information per (group, start); groups
    are survey seasons, so what returns to the driver is a few numbers each.
    ``converged`` tells whether the best start of a group came to rest.
    """
    counts = df.where(F.col(margin).isNotNull()).groupBy(
        F.col(group).alias("g"), F.col(margin).cast("double").alias("m"), F.col(detected).cast("double").alias("d")).agg(
        F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.withColumn("g", F.explode(F.array("g", F.lit(pooled)))).groupBy("g", "m", "d").agg(F.sum("n").alias("n")))
    groups = [r[0] for r in counts.select("g").distinct().collect()]
    state = {(g, s): {"at": np.array([t, math.log(u), q]), "best": -np.inf, "lam": 1e-2, "done": False}
             for g in groups for s, (t, u, q) in enumerate(STARTS)}
    for v in state.values():
        v["try"] = v["at"].copy()
    for _ in range(max_iter):
        live = {k: v["try"] for k, v in state.items() if not v["done"]}
        if not live:
            break

        def partial(batches, live=live):
            acc: dict = {}
            for pdf in batches:
                for g, part in pdf.groupby("g"):
                    m, d, n = part["m"].to_numpy(), part["d"].to_numpy(), part["n"].to_numpy(dtype="float64")
                    for s in range(len(STARTS)):
                        if (g, s) in live:
                            acc[g, s] = acc.get((g, s), 0.0) + _sums(live[g, s], m, d, n)
            if acc:
                yield pd.concat([pd.DataFrame({"g": g, "s": s, "pos": np.arange(13), "value": v}) for (g, s), v in acc.items()])

        got: dict = {}
        for r in counts.mapInPandas(partial, "g string, s int, pos int, value double").groupBy("g", "s", "pos").agg(
                F.sum("value").alias("value")).collect():
            got.setdefault((r["g"], r["s"]), np.zeros(13))[r["pos"]] = r["value"]
        for k in live:
            st, v = state[k], got[k]
            if v[0] >= st["best"]:
                gain = v[0] - st["best"]
                st.update(best=v[0], at=st["try"], g=v[1:4], h=v[4:].reshape(3, 3), lam=max(st["lam"] / 5, 1e-10))
                # Without a turning point the likelihood flattens as theta runs off: what counts is the gain beside its size.
                if gain < tol * (1 + abs(v[0])):
                    st["done"] = True
            else:
                st["lam"] *= 10
                if st["lam"] > 1e10:
                    # No step goes up any more: this is the top only if the quadratic through it promises next to nothing.
                    promise = 0.5 * float(st["g"] @ np.linalg.lstsq(st["h"], st["g"], rcond=None)[0])
                    st.update(done=True, stuck=promise > 100 * tol * (1 + abs(st["best"])))
            a = st["h"] + st["lam"] * np.diag(np.diag(st["h"]) + 1e-9)
            st["try"] = st["at"] + np.clip(np.linalg.lstsq(a, st["g"], rcond=None)[0], -2, 2)
    n_of = {r["g"]: r["n"] for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    out = []
    for g in groups:
        b = max((state[g, s] for s in range(len(STARTS))), key=lambda v: v["best"])
        out.append((g, float(b["at"][0]), float(math.exp(b["at"][1])), float(1 / (1 + math.exp(-b["at"][2]))), int(n_of[g]), float(-b["best"]), bool(b["done"] and not b.get("stuck"))))
    return df.sparkSession.createDataFrame(out, "season string, theta_dB double, tau_dB double, pi double, n bigint, nll double, converged boolean")


def _sums(params: np.ndarray, m: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
    theta, log_tau, q = params
    tau = math.exp(log_tau)
    pi = 1 / (1 + math.exp(-q))
    u = (m - theta) / tau
    cdf = np.exp(np_log_cdf(u))
    pdf = np.exp(-u * u / 2) / math.sqrt(2 * math.pi)
    p = np.clip((1 - pi) * cdf, 1e-9, 1 - 1e-9)
    inner = ((1 - pi) * cdf > 1e-9) & ((1 - pi) * cdf < 1 - 1e-9)
    j = np.column_stack([-(1 - pi) * pdf / tau, -(1 - pi) * pdf * u, -pi * (1 - pi) * cdf]) * inner[:, None]
    w = n / (p * (1 - p))
    ll = (n * (d * np.log(p) + (1 - d) * np.log1p(-p))).sum()
    return np.concatenate([[ll], j.T @ (w * (d - p)), (j.T @ (j * w[:, None])).ravel()])

"""Censoring- and detection-aware regressions as distributed likelihood sums.

One job per Newton step serves every fit at once (all folds, the final fit, all
thresholds or modes): each task adds up negative log posterior, gradient and
Hessian of its rows per fit and emits one short row per fit; Spark sums those.
Only parameters (a few dozen numbers per fit) travel to the driver and back.

Parameters of a fit: regression terms, log sigma, and with the detection layer
theta and log tau.  Targets are z-scored per fit; theta and tau are in dB.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from firnline.functions.normal import np_log_cdf, np_mills
from firnline.operators import stats
from firnline.plans.design import Design
from firnline.schema import THICKNESS

FINAL = -1


@dataclass(frozen=True)
class Detection:
    theta_mean: float = 10.0
    theta_sd: float = 5.0
    tau_sd: float = 5.0


@dataclass
class Fit:
    """One fit: what it leaves out, how it reads rows, and its result."""

    fit_id: int
    held_out: int | None = None          # fold left out; None trains on every fold
    censor_below: float | None = None    # margin threshold of the Tobit rows; None = off
    target: str | None = None            # other target column than the design's
    censor_flag: str | None = None       # a ready-made 0/1 censoring column
    norm: dict = field(default_factory=dict)
    params: np.ndarray | None = None
    cov: np.ndarray | None = None
    iterations: int = 0
    gradient: float = math.nan
    condition: float = math.nan

    def sigma2(self, d: int) -> float:
        """E[sigma^2] under the normal approximation of log sigma."""
        return float(np.exp(2 * self.params[d] + 2 * self.cov[d, d]))


#: Rows per task of a fit, about.
TASK_ROWS = 100_000
#: Numbers that are held at a time while rows are scored on draws (8 MB an array), and tasks per core to score in.
SCORE_CELLS, SCORE_TASKS = 1 << 20, 4


def _tasks(spark, per_core: int) -> int:
    return spark.sparkContext.defaultParallelism * per_core


def _merge(stats_by_fold: list[dict], keep) -> tuple[float, float]:
    """Mean and population sd of the kept folds from per-fold counts, means and variances."""
    n = mean = m2 = 0.0
    for s in stats_by_fold:
        if not keep(s["fold"]) or not s["n"]:
            continue
        d = s["mean"] - mean
        tot = n + s["n"]
        mean += d * s["n"] / tot
        m2 += s["var"] * s["n"] + d * d * n * s["n"] / tot
        n = tot
    sd = math.sqrt(m2 / n) if n else 0.0
    return mean, (sd if sd > 0 else 1.0)


def fit_normalizers(rows: DataFrame, columns: Sequence[str], fits: Sequence[Fit]) -> dict[int, dict]:
    """Train-only statistics of every fit from one aggregate per fold."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}|m"), F.var_pop(c).alias(f"{c}|v")]
    per_fold = [r.asDict() for r in rows.groupBy("fold").agg(*aggs).collect()]
    out = {}
    for f in fits:
        out[f.fit_id] = {
            c: _merge([{"fold": r["fold"], "n": r["n"], "mean": r[f"{c}|m"], "var": r[f"{c}|v"]} for r in per_fold],
                      lambda k, f=f: k != f.held_out)
            for c in columns}
    return out


def _log_cdf_terms(v: np.ndarray):
    ll = np_log_cdf(v)
    lam = np_mills(v, ll)
    return ll, lam, -lam * (v + lam)


def _outer(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    return a.T @ (a * w[:, None])


def row_sums(design: Design, fit: Fit, detection: Detection | None, pdf: pd.DataFrame) -> np.ndarray:
    """[log likelihood, gradient, Hessian] of a batch for one fit, flattened."""
    norm = fit.norm
    target = fit.target or design.target
    d = len(design.term_names())
    p = d + 1 + (2 if detection else 0)
    ll, grad, hess = 0.0, np.zeros(p), np.zeros((p, p))
    use = np.ones(len(pdf), bool) if fit.held_out is None else (pdf["fold"].to_numpy() != fit.held_out)
    nd = pdf["is_nondetect"].to_numpy(dtype=bool)
    beta, ls = fit.params[:d], fit.params[d]
    sigma = math.exp(ls)

    def matrix(part: pd.DataFrame) -> np.ndarray:
        one = np.ones(len(part))
        return np.column_stack(list(design.terms(lambda c: part[c].to_numpy(dtype="float64"), norm, one).values()))

    obs = pdf[use & ~nd]
    if len(obs):
        X = matrix(obs)
        y = (obs[target].to_numpy(dtype="float64") - norm[target][0]) / norm[target][1]
        if fit.censor_flag:
            cens = obs[fit.censor_flag].to_numpy(dtype=bool)
        elif fit.censor_below is not None:
            m = obs["obs_margin_dB"].to_numpy(dtype="float64")
            with np.errstate(invalid="ignore"):
                cens = m < fit.censor_below
        else:
            cens = np.zeros(len(obs), bool)
        u = (X @ beta - y) / sigma
        r, Xe = -u[~cens], X[~cens]
        ll += float(-(ls + 0.5 * math.log(2 * math.pi)) * len(r) - 0.5 * (r @ r))
        grad[:d] += Xe.T @ r / sigma
        grad[d] += r @ r - len(r)
        hess[:d, :d] -= Xe.T @ Xe / sigma**2
        cross = -2 * (Xe.T @ r) / sigma
        hess[:d, d] += cross
        hess[d, :d] += cross
        hess[d, d] -= 2 * (r @ r)
        if cens.any():
            v, Xc = u[cens], X[cens]
            l, lam, dlam = _log_cdf_terms(v)
            ll += float(l.sum())
            g = np.column_stack([Xc / sigma, -v])
            grad[: d + 1] += g.T @ lam
            hess[: d + 1, : d + 1] += _outer(g, dlam)
            cross = -(Xc.T @ lam) / sigma
            hess[:d, d] += cross
            hess[d, :d] += cross
            hess[d, d] += lam @ v
        if detection:
            m = obs["obs_margin_dB"].to_numpy(dtype="float64")
            m = m[np.isfinite(m)]
            theta, tau = fit.params[d + 1], math.exp(fit.params[d + 2])
            v = (m - theta) / tau
            l, lam, dlam = _log_cdf_terms(v)
            ll += float(l.sum())
            g = np.column_stack([np.full(len(v), -1 / tau), -v])
            i = [d + 1, d + 2]
            grad[i] += g.T @ lam
            hess[np.ix_(i, i)] += _outer(g, dlam)
            hess[d + 1, d + 2] += lam.sum() / tau
            hess[d + 2, d + 1] += lam.sum() / tau
            hess[d + 2, d + 2] += lam @ v
    miss = pdf[use & nd]
    if detection and len(miss):
        X = matrix(miss)
        mean, sd = norm[target]
        theta, tau = fit.params[d + 1], math.exp(fit.params[d + 2])
        s = math.sqrt(tau**2 + (sigma * sd) ** 2)
        A, B = (sigma * sd / s) ** 2, (tau / s) ** 2
        v = (X @ beta * sd + mean - (miss["C_dB"].to_numpy(dtype="float64") - theta)) / s
        l, lam, dlam = _log_cdf_terms(v)
        ll += float(l.sum())
        Xs = X * (sd / s)
        g = np.column_stack([Xs, -v * A, np.full(len(v), 1 / s), -v * B])
        grad += g.T @ lam
        h = _outer(g, dlam)
        bx = Xs.T @ lam
        h[:d, d] -= A * bx
        h[d, :d] -= A * bx
        h[:d, d + 2] -= B * bx
        h[d + 2, :d] -= B * bx
        one = lam.sum() / s
        h[d, d + 1] -= A * one
        h[d + 1, d] -= A * one
        h[d + 1, d + 2] -= B * one
        h[d + 2, d + 1] -= B * one
        lv = lam @ v
        h[d, d] += lv * (A * A - 2 * A * B)
        h[d, d + 2] += 3 * A * B * lv
        h[d + 2, d] += 3 * A * B * lv
        h[d + 2, d + 2] += lv * (B * B - 2 * A * B)
        hess += h
    return np.concatenate([[ll], grad, hess.ravel()])


def log_prior(params: np.ndarray, d: int, detection: Detection | None):
    """Standard normal terms, half-normal sigma and tau (on the log scale), normal theta."""
    p = len(params)
    g, h = np.zeros(p), np.zeros((p, p))
    beta, sigma2 = params[:d], math.exp(2 * params[d])
    ll = -0.5 * beta @ beta - 0.5 * sigma2 + params[d]
    g[:d], g[d] = -beta, 1 - sigma2
    h[range(d), range(d)] = -1.0
    h[d, d] = -2 * sigma2
    if detection:
        t = (params[d + 1] - detection.theta_mean) / detection.theta_sd
        q = math.exp(2 * params[d + 2]) / detection.tau_sd**2
        ll += -0.5 * t * t - 0.5 * q + params[d + 2]
        g[d + 1], g[d + 2] = -t / detection.theta_sd, 1 - q
        h[d + 1, d + 1], h[d + 2, d + 2] = -1 / detection.theta_sd**2, -2 * q
    return ll, g, h


def _evaluate(rows: DataFrame, design: Design, fits: Sequence[Fit], detection: Detection | None) -> dict[int, np.ndarray]:
    frozen = [replace(f, cov=None) for f in fits]

    def partial(batches):
        acc = {f.fit_id: 0.0 for f in frozen}
        for pdf in batches:
            for f in frozen:
                acc[f.fit_id] = acc[f.fit_id] + row_sums(design, f, detection, pdf)
        parts = [pd.DataFrame({"fit_id": k, "pos": np.arange(len(v)), "value": v}) for k, v in acc.items() if not np.isscalar(v)]
        if parts:
            yield pd.concat(parts)

    sums = rows.mapInPandas(partial, "fit_id int, pos int, value double").groupBy("fit_id", "pos").agg(F.sum("value").alias("value"))
    out: dict[int, dict[int, float]] = {}
    for r in sums.collect():  # fits x (1 + p + p^2) numbers
        out.setdefault(r["fit_id"], {})[r["pos"]] = r["value"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def training_rows(split: DataFrame, design: Design, *, min_thickness_m: float | None = None,
                  extra: Sequence[str] = (), max_delta: float | None = 8.0) -> DataFrame:
    """Columns and rows the likelihood reads: usable observations of training folds, and their non-detections with a known
    ceiling and a small delta."""
    from firnline.operators import qc
    features = qc.usable(None, design.features, min_thickness_m, THICKNESS)
    nd = F.coalesce(F.col("is_nondetect"), F.lit(False))
    rows = split.where(features & (F.col("fold") >= 0))
    rows = rows.where(F.col(design.target).isNotNull() & ~nd).unionByName(qc.likelihood_nondetects(rows.where(nd), max_delta))
    cols = [*design.raw_columns(), design.target, *extra]
    return rows.select("fold", nd.alias("is_nondetect"), F.col("obs_margin_dB").cast("double"), F.col("C_dB").cast("double"),
                       *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(cols)])


def fit_all(rows: DataFrame, design: Design, fits: Sequence[Fit], detection: Detection | None = None, *,
            max_iter: int = 200, tol: float = 1e-5) -> list[Fit]:
    """Damped Newton on all fits in lockstep; fills params, cov and diagnostics.

    ``rows`` are spread evenly once, over as many tasks as they need, and persisted on the
    executors (memory, then disk), because every step scans them.
    """
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    rows = rows.repartition(tasks).persist()
    try:
        d = len(design.term_names())
        p = d + 1 + (2 if detection else 0)
        columns = [*design.features, *dict.fromkeys([f.target or design.target for f in fits])]
        norms = fit_normalizers(rows.where(~F.col("is_nondetect")), columns, fits)
        state = {}
        fits = list(fits)
        for f in fits:
            f.norm = norms[f.fit_id]
            f.params = np.zeros(p)
            if detection:
                f.params[d + 1], f.params[d + 2] = detection.theta_mean, math.log(detection.tau_sd)
            state[f.fit_id] = {"lam": 1e-3, "best": -np.inf, "done": False}
        for _ in range(max_iter):
            live = [f for f in fits if not state[f.fit_id]["done"]]
            if not live:
                break
            sums = _evaluate(rows, design, live, detection)
            for f in live:
                st = state[f.fit_id]
                v = sums.get(f.fit_id, np.zeros(1 + p + p * p))
                lp, gp, hp = log_prior(f.params, d, detection)
                value, g, h = v[0] + lp, v[1:1 + p] + gp, v[1 + p:].reshape(p, p) + hp
                f.iterations += 1
                if np.isfinite(value) and value >= st["best"] - 1e-9:
                    st.update(best=value, at=f.params.copy(), g=g, h=h, lam=max(st["lam"] / 10, 1e-12))
                    f.gradient = float(np.abs(g).max())
                    if f.gradient < tol * (1 + abs(value)) ** 0.5:
                        st["done"] = True
                        continue
                else:
                    st["lam"] = max(st["lam"] * 20, 1e-3)
                    if st["lam"] > 1e12:
                        # No step goes up any more: either this is the top, as far as sums of doubles can tell, or the fit has failed.
                        if f.gradient > 1e3 * tol * (1 + abs(st["best"])) ** 0.5:
                            raise ArithmeticError(f"fit {f.fit_id} is stuck after {f.iterations} steps with a gradient of {f.gradient:.3g}")
                        st["done"] = True
                        continue
                n = -st["h"]
                lam = st["lam"]
                scale = np.diag(np.maximum(np.abs(np.diag(n)), 1e-6))
                while True:
                    try:
                        np.linalg.cholesky(n + lam * scale)
                        break
                    except np.linalg.LinAlgError:
                        lam = max(lam * 10, 1e-6)
                step = np.linalg.solve(n + lam * scale, st["g"])
                f.params = st["at"] + np.clip(step, -3.0, 3.0)
        open_fits = [f.fit_id for f in fits if not state[f.fit_id]["done"]]
        if open_fits:
            raise RuntimeError(f"fits {open_fits} have not converged in {max_iter} steps")
        for f in fits:
            st = state[f.fit_id]
            f.params = st["at"]
            f.cov = np.linalg.inv(-st["h"])
            f.condition = float(np.linalg.cond(st["h"]))
        return fits
    finally:
        rows.unpersist()


def cv_fits(folds: Sequence[int], censor_below: float | None = None, final: bool = True, start: int = 0, **kw) -> list[Fit]:
    """One fit per left-out fold and the final one."""
    out = [Fit(start + int(k), held_out=int(k), censor_below=censor_below, **kw) for k in folds]
    return [*out, Fit(start + FINAL if start == 0 else start + 99, None, censor_below, **kw)] if final else out


# ---- prediction -----------------------------------------------------------------------------

def predictions(df: DataFrame, design: Design, fit: Fit, keep: Sequence[str], prefix: str = "pred") -> DataFrame:
    """Mean, parameter sd and predictive sd in dB from mean and covariance; plain arithmetic columns."""
    mean, sd_mu, sd = prediction_columns(design, fit)
    return df.select(*keep, mean.alias(f"{prefix}_mean"), sd_mu.alias(f"{prefix}_std_mu"), sd.alias(f"{prefix}_std"))


def prediction_columns(design: Design, fit: Fit) -> tuple[Column, Column, Column]:
    d = len(design.term_names())
    target = fit.target or design.target
    mean, sd = fit.norm[target]
    terms = list(design.terms(lambda c: F.col(c), fit.norm, F.lit(1.0)).values())
    chol = np.linalg.cholesky(fit.cov[:d, :d])

    def dot(w: np.ndarray) -> Column:
        out = F.lit(0.0)
        for t, v in zip(terms, w):
            if v != 0.0:
                out = out + t * F.lit(float(v))
        return out

    var = F.lit(0.0)
    for j in range(d):
        q = dot(chol[:, j])
        var = var + q * q
    return dot(fit.params[:d]) * sd + mean, F.sqrt(var) * sd, F.sqrt(var + fit.sigma2(d)) * sd


def held_out_predictions(split: DataFrame, design: Design, fits: Sequence[Fit], keep: Sequence[str]) -> DataFrame:
    """Each row predicted by the fit that left its fold out."""
    each = []
    for f in fits:
        if f.held_out is not None:
            mean, sd_mu, sd = prediction_columns(design, f)
            each.append(F.when(F.col("fold") == f.held_out, F.struct(
                mean.alias("pred_mean"), sd_mu.alias("pred_std_mu"), sd.alias("pred_std"), F.lit(f.fit_id).alias("fit_id"))))
    # One scan, however many fits there are.
    met = F.filter(F.array(*each), lambda p: p.isNotNull())
    return split.select(*keep, F.explode(met).alias("_p")).select(*keep, "_p.*")


def _draws(fit: Fit, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).multivariate_normal(fit.params, fit.cov, size=n, method="eigh")


def log_scores(rows: DataFrame, design: Design, fits: Sequence[Fit], *, held_out: bool = True, draws: int = 1000,
               seed: int = 0) -> DataFrame:
    """Mean held-out log score per fit in dB units, over observed (density or survival mass) rows,
    and mean log P(no detection) over non-detections.  Scores are averaged over posterior draws."""
    d = len(design.term_names())
    spec = [(f, _draws(f, draws, seed)) for f in fits]

    def mixed(lp: np.ndarray) -> np.ndarray:
        """Logarithm of the mean over draws; the array is used up."""
        top = lp.max(axis=1)
        base = np.where(np.isfinite(top), top, 0.0)
        lp -= base[:, None]
        with np.errstate(divide="ignore"):
            return np.log(np.exp(lp, out=lp).sum(axis=1)) + base - math.log(draws)

    def score_part(f: Fit, th: np.ndarray, part: pd.DataFrame) -> pd.DataFrame:
        target = f.target or design.target
        mean, sd = f.norm[target]
        X = np.column_stack(list(design.terms(lambda c: part[c].to_numpy(dtype="float64"), f.norm, np.ones(len(part))).values()))
        sigma = np.exp(th[:, d])[None, :]
        nd = part["is_nondetect"].to_numpy(dtype=bool)
        s = np.full(len(part), np.nan)
        o = np.flatnonzero(~nd)
        if len(o):
            u = ((part[target].to_numpy(dtype="float64")[o] - mean) / sd)[:, None] - X[o] @ th[:, :d].T
            u /= sigma
            m = part["obs_margin_dB"].to_numpy(dtype="float64")[o]
            with np.errstate(invalid="ignore"):
                cens = m < f.censor_below if f.censor_below is not None else np.zeros(len(m), bool)
            # The mass above is worked out where a row is censored, the density elsewhere.
            if cens.any():
                s[o[cens]] = mixed(np_log_cdf(-u[cens])) - math.log(sd)
                u = u[~cens]
            u *= u
            u *= -0.5
            u -= 0.5 * math.log(2 * math.pi) + np.log(sigma)
            if len(u):
                s[o[~cens]] = mixed(u) - math.log(sd)
        if nd.any() and th.shape[1] > d + 1:
            theta, tau = th[:, d + 1], np.exp(th[:, d + 2])
            width = np.sqrt(tau**2 + (np.exp(th[:, d]) * sd) ** 2)
            v = (X[nd] @ th[:, :d].T * sd + mean - (part["C_dB"].to_numpy(dtype="float64")[nd][:, None] - theta)) / width
            s[nd] = mixed(np_log_cdf(v))
        return pd.DataFrame({"fit_id": f.fit_id, "is_nondetect": nd, "s": s}).dropna()

    def score(batches):
        for pdf in batches:
            for f, th in spec:
                part = pdf[pdf["fold"] == f.held_out] if held_out and f.held_out is not None else pdf
                # Rows by draws is held for a few rows at a time.
                for lo in range(0, len(part), max(1, SCORE_CELLS // draws)):
                    yield score_part(f, th, part.iloc[lo:lo + max(1, SCORE_CELLS // draws)])

    # Few files hold many rows: they are spread over all cores, and only what is read.
    read = ["fold", "is_nondetect", "obs_margin_dB", "C_dB", *design.raw_columns(), *[f.target or design.target for f in fits]]
    wanted = rows.select(*[c for c in dict.fromkeys(read) if c in rows.columns])
    scored = wanted.repartition(_tasks(rows.sparkSession, SCORE_TASKS)).mapInPandas(score, "fit_id int, is_nondetect boolean, s double")
    return scored.groupBy("fit_id", "is_nondetect").agg(F.avg("s").alias("logscore"), F.count(F.lit(1)).alias("n"))


#: Metrics of a fold that are pooled, and the counts that weigh them: the log score is over censored rows too.
POOLED = {"rmse_dB": "n_points", "mae_dB": "n_points", "coverage_1sigma": "n_points", "logscore_dB": "n_total", "nd_logscore": "n_nd_val"}


def with_log_scores(metrics: DataFrame, scores: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """metrics per fold with the mean log score of its observed rows and of its non-detections, and their numbers."""
    of_fold = F.create_map(*[F.lit(v) for f in fits if f.held_out is not None for v in (f.fit_id, f.held_out)])
    one = lambda nd, c: F.max(F.when(F.col("is_nondetect") == nd, F.col(c)))
    per_fold = scores.withColumn("fold", F.try_element_at(of_fold, F.col("fit_id"))).groupBy("fold").agg(
        one(False, "logscore").alias("logscore_dB"), one(True, "logscore").alias("nd_logscore"), one(True, "n").alias("n_nd_val"))
    joined = metrics.join(per_fold, "fold", "left")
    return joined.withColumns({"n_nd_val": F.coalesce("n_nd_val", F.lit(0)), "n_total": F.col("n_points") + F.col("n_censored")})


def pooled_cv(metrics: DataFrame) -> DataFrame:
    """One row over all folds: mean (weighted by the rows behind it), least and greatest of each metric, and the summed counts.

    A fold without a value, such as one without non-detections, has no weight in that metric.
    """
    aggs = []
    for value, weight in POOLED.items():
        w = F.when(F.col(value).isNotNull(), F.col(weight))
        aggs += [F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias(f"{value}_mean"), F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max")]
    return metrics.agg(F.count(F.lit(1)).alias("n_folds"), *aggs, *[F.sum(n).alias(n) for n in ("n_points", "n_censored", "n_total", "n_nd_val")])


def cross_validate(split: DataFrame, design: Design, *, folds: Sequence[int], censor_below: float | None = None, detection: Detection | None = None,
                   min_thickness_m: float | None = None, draws: int = 1000, seed: int = 0) -> tuple[list[Fit], DataFrame]:
    """Blocked CV and final fit in one series of jobs, and the metrics of each left-out fold.

    RMSE, MAE and coverage are over uncensored rows, the log score over all observed ones (of a censored row the mass above its
    value counts), the non-detection score over the fold's non-detections where a detection layer is fitted.
    """
    rows = training_rows(split, design, min_thickness_m=min_thickness_m)
    fits = fit_all(rows, design, cv_fits(folds, censor_below), detection)
    return fits, with_log_scores(_fold_metrics(rows, design, fits, censor_below), log_scores(rows, design, [f for f in fits if f.held_out is not None], draws=draws, seed=seed), fits)


def _fold_metrics(rows: DataFrame, design: Design, fits: Sequence[Fit], censor_below: float | None) -> DataFrame:
    obs = rows.where(~F.col("is_nondetect"))
    pred = held_out_predictions(obs, design, fits, ["fold", design.target, "obs_margin_dB"])
    low = F.coalesce(F.col("obs_margin_dB") < censor_below, F.lit(False)) if censor_below is not None else F.lit(False)
    return pred.groupBy("fold").agg(
        *[v.alias(k) for k, v in stats.score(F.when(~low, F.col(design.target)), F.col("pred_mean"), F.col("pred_std")).items()],
        F.count_if(low).alias("n_censored"))


def held_out_metrics(rows: DataFrame, design: Design, fit: Fit, *, draws: int = 1000, seed: int = 0) -> DataFrame:
    """One row of metrics of a fit on rows it has not seen, with the log score over censored and other rows."""
    low = F.coalesce(F.col("obs_margin_dB") < fit.censor_below, F.lit(False)) if fit.censor_below is not None else F.lit(False)
    p = predictions(rows, design, fit, [design.target, "obs_margin_dB"])
    one = p.agg(*[v.alias(k) for k, v in stats.score(F.when(~low, F.col(design.target)), F.col("pred_mean"), F.col("pred_std")).items()], F.count_if(low).alias("n_censored"))
    given = rows.withColumn("is_nondetect", F.lit(False))
    score = log_scores(given, design, [fit], held_out=False, draws=draws, seed=seed).agg(F.max("logscore").alias("logscore_dB"))
    # Two one-row tables side by side.
    return one.withColumn("n_total", F.col("n_points") + F.col("n_censored")).crossJoin(score)


def fit_table(spark, design: Design, fits: Sequence[Fit], detection: bool = False) -> DataFrame:
    """(fit_id, param, mean, sd) rows with the convergence report."""
    names = [*design.term_names(), "log_sigma", *(["theta", "log_tau"] if detection else [])]
    data = [(f.fit_id, n, float(f.params[i]), float(math.sqrt(f.cov[i, i])), f.iterations, f.gradient, f.condition)
            for f in fits for i, n in enumerate(names)]
    return spark.createDataFrame(data, "fit_id int, param string, mean double, sd double, iterations int, gradient double, condition double")


# ---- closed form ----------------------------------------------------------------------------

def gram(df: DataFrame, terms: dict[str, Column], target: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Lower-triangle sums of [terms, y] products per group: (keys, i, j, value), one scan."""
    cols = {**terms, "y": target}
    names = list(cols)
    base = df.select(*keys, *[cols[n].cast("double").alias(f"_t{i}") for i, n in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    wide = base.groupBy(*keys).agg(*[F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")).alias(f"_s{i}_{j}") for i, j in pairs])
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(names[i]).alias("term_i"), F.lit(names[j]).alias("term_j"), F.col(f"_s{i}_{j}").alias("value"))
        for i, j in pairs])).alias("g")).select(*keys, "g.*")

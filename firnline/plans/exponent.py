"""Range-exponent fits: site intercepts, slope against log range, regime and season offsets.

Each step is iteratively reweighted least squares with the site intercepts
eliminated: rows are summed per site where they lie, sites give the reduced
normal equations, and the driver sees one small matrix per fit.  A step moves no
rows and writes no files.  All fits of a study run in the same jobs over the same
rows, told apart by a bit in ``fits``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from firnline.functions import labels
from firnline.functions.normal import hash_normal, soft_min
from firnline.functions.radio import pair_exponent
from firnline.operators.levels import site_levels
from firnline.session import cut_lineage, moved

NU = 4.0
# Prior scales of the exponent, offsets and intercepts; default thresholds.
PRIOR_X = (3.0, 1.5)
PRIOR_SD = {"delta_high": 3.0, "season": 5.0, "clip": 2.0, "alpha": 20.0}
MIN_MARGIN_DB = 10.0
MIN_HEADROOM_DB = 10.0
ALPHA_PRIOR = 1 / PRIOR_SD["alpha"] ** 2
#: Rows of a site that a task holds at once, and steps whose intercepts are found again before they are written.
SITE_ROWS, REPLAYED = 1 << 16, 4
#: Rows per task of a step, per block that is worked on at once, and that are dealt to blocks together, about.
TASK_ROWS, BLOCK_ROWS, PACKED_ROWS = 250_000, 1 << 14, 1 << 17


Step = Callable[[DataFrame, str], DataFrame]


def only(condition: str) -> Step:
    """Rows for which the condition is known to hold."""
    return lambda d, power: d.where(condition)


LOW_REGIME: Step = only("regime = 'low'")
GATED: Step = only("surface_gate_ok")
WITH_MARGIN: Step = only(f"bed_margin_dB > {MIN_MARGIN_DB}D")


def with_noise_floor(d: DataFrame, power: str) -> DataFrame:
    """The floor that the margin is counted from; rows without a margin go."""
    return d.withColumn("noise_dB", F.col(power) - F.col("bed_margin_dB")).where("noise_dB IS NOT NULL")


def with_clip_levels(levels: DataFrame, min_headroom: float | None = None) -> Step:
    """The clip level of the row's season and segment; rows without one, or nearer to it than the headroom, go."""
    known = levels.select("season", "segment", "S_dB").where("S_dB IS NOT NULL")

    def step(d: DataFrame, power: str) -> DataFrame:
        j = d.withColumn("segment", labels.segment(F.col("frame_id"))).join(known, ["season", "segment"])
        return j if min_headroom is None else j.where(F.col("S_dB") - F.col(power) >= min_headroom)

    return step


def prepare(t: DataFrame, range_col: str, power: str, *steps: Step, min_levels: int = 2) -> DataFrame:
    """Rows of one channel with a known power and range after the given steps, at sites that still have enough height levels;
    log range and power are centred per site."""
    for step in (only(f"{range_col} > 0 AND {power} IS NOT NULL"), *steps):
        t = step(t, power)
    t = t.withColumns({"logR": F.log10(range_col), "is_high": (F.col("regime") == "high").cast("double"), "segment": labels.segment(F.col("frame_id"))})
    rich = site_levels(t, ["site_id"], "frame_id", "r_surf", "levels").where(F.col("levels") >= min_levels)
    centre = t.groupBy("site_id").agg(F.avg("logR").alias("_r"), F.avg(power).alias("_p"))
    joined = t.drop("levels").join(moved(rich.join(moved(centre), "site_id")), "site_id")
    return joined.withColumns({"clogR": F.col("logR") - F.col("_r"), "cP": F.col(power) - F.col("_p")}).drop("_r", "_p")


def near_clip_by_season(t: DataFrame, power: str, clip_levels: DataFrame, min_headroom: float, top: int = 3) -> DataFrame:
    """Seasons losing most traces to the headroom rule."""
    seg = t.withColumn("segment", labels.segment(F.col("frame_id")))
    j = seg.join(clip_levels.select("season", "segment", "S_dB").where("S_dB is not null"), ["season", "segment"])
    return j.where(F.col("S_dB") - F.col(power) < min_headroom).groupBy("season").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "season").limit(top)


@dataclass
class ExponentFit:
    names: list[str]
    mean: np.ndarray
    cov: np.ndarray
    sigma: float
    n_traces: int
    n_sites: int
    iterations: int
    n_mixed: int = 0

    def row(self, name: str) -> dict:
        sd = np.sqrt(np.diag(self.cov))
        out = {"fit": name, "n_traces": self.n_traces, "n_sites": self.n_sites, "x_mean": float(self.mean[0]), "x_sd": float(sd[0]),
               "x_eti89_lb": float(self.mean[0] - 1.5982 * sd[0]), "x_eti89_ub": float(self.mean[0] + 1.5982 * sd[0]),
               "sigma_mean": self.sigma, "delta_high_mean": None, "delta_high_sd": None}
        if "delta_high" in self.names:
            i = self.names.index("delta_high")
            out["delta_high_mean"], out["delta_high_sd"] = float(self.mean[i]), float(sd[i])
        return out


def _t_density(z: np.ndarray) -> np.ndarray:
    return 0.375 * (1 + z * z / NU) ** -2.5


def _t_cdf(z: np.ndarray) -> np.ndarray:
    q = 1 + z * z / NU
    return np.maximum(0.5 + 0.375 * z / np.sqrt(q) * (1 - z * z / (12 * q)), 1e-12)


def as_fit_rows(d: DataFrame, power: str, *, censor: bool = False, saturate: bool = False) -> DataFrame:
    """Rows of one fit.  A known ``noise_dB`` adds the pedestal and left-censors picks at the
    floor; a known ``S_dB`` limits the mean softly with one global offset."""
    none = F.lit(None).cast("double")
    noise = F.col("noise_dB").cast("double") if censor else none
    clip = F.col("S_dB").cast("double") if saturate else none
    keep = [n for n in ("levels", "n_seasons") if n in d.columns]
    return d.select(F.lit(1).cast("bigint").alias("fits"), "site_id", F.col("season").cast("string").alias("season"), "clogR", "is_high",
                    F.col(power).cast("double").alias("P"), noise.alias("noise_dB"), clip.alias("S_dB"), *keep)


def fit_exponent(d: DataFrame, power: str, *, censor: bool = False, saturate: bool = False, season_offset: bool = False,
                 likelihood: str = "studentt", max_iter: int = 200, tol: float = 1e-3) -> ExponentFit:
    """One channel on its own."""
    rows = cut_lineage(as_fit_rows(d, power, censor=censor, saturate=saturate))
    return fit_exponents(rows, season_fits=[0] if season_offset else [], likelihood=likelihood, max_iter=max_iter, tol=tol)[0]


@dataclass(frozen=True)
class _Move:
    """Where the fits stood before a step, by fit, and how far they went; the alphas are those of wide sites, by fit and number."""

    theta: dict[int, np.ndarray]
    sigma: dict[int, float]
    alphas: dict[int, np.ndarray]
    steps: dict[int, np.ndarray] | None = None
    pace: dict[int, float] | None = None


def _softened(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic function of the gap, and how far a soft limit is from the hard one."""
    e = np.exp(-np.abs(gap))
    up = 1 / (1 + e)
    return np.where(gap >= 0, up, e * up), np.log(1 + e)


class _Block:
    """Whole sites (or pieces of wide ones) whose rows take part in the same fits: columns of the rows, kept as bytes."""

    ROW = "clogR binary, is_high binary, P binary, noise_dB binary, S_dB binary, season_code binary"
    SCHEMA = f"fits bigint, starts binary, wide binary, mean_P binary, alpha binary, {ROW}"

    def __init__(self, row: dict, n_seasons: int):
        of = lambda n, kind=np.float64: np.frombuffer(row[n], kind)
        self.fits = _bits(row["fits"])
        self.starts, self.wide, self.mean = of("starts", np.int32), of("wide", np.int32), of("mean_P")
        self.P, self.x, n = of("P"), -10 * of("clogR"), len(row["P"]) // 8
        self.high = of("is_high", np.int8).astype(float) if len(row["is_high"]) == n else of("is_high")
        self.code = of("season_code", np.int16)
        self.n_seasons = n_seasons
        # A floor or limit that a row does not have is infinitely far.
        self.noise, self.clip = (np.where(np.isnan(v := of(k)), away, v) if row[k] else None for k, away in (("noise_dB", -np.inf), ("S_dB", np.inf)))
        self.site = np.repeat(np.arange(len(self.starts)), np.diff(self.starts, append=n))
        self.cell = self.site * (n_seasons + 1) + self.code
        self.seen = self.P if self.noise is None else np.maximum(self.P, self.noise)
        self.at_floor = np.flatnonzero(self.P <= self.noise) if self.noise is not None else np.empty(0, int)
        self.broad = self.wide >= 0
        self.alpha = of("alpha").reshape(len(self.fits), len(self.starts))

    def per_site(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.starts)

    def along(self, theta: np.ndarray, seasonal: bool) -> np.ndarray:
        """The linear part of the parameters, by row."""
        v = theta[0] * self.x + theta[1] * self.high
        return v + np.append(theta[2:-1], 0.0)[self.code] if seasonal else v

    def terms(self, alpha: np.ndarray, theta: np.ndarray, sigma: float, likelihood: str, seasonal: bool, observed: bool):
        """By row, curvature and score of the mean, how the mean follows its linear part and the clip offset, and the sum of squares."""
        m, a, b, s2 = alpha[self.site] + self.along(theta, seasonal), None, None, sigma * sigma
        if self.clip is not None:
            top = self.clip + theta[-1]
            a, low = _softened(top - m)
            m, b = np.minimum(m, top) - low, 1 - a
        if self.noise is not None:
            kdb = math.log(10) / 10
            g, up = _softened(kdb * (m - self.noise))
            m = np.maximum(m, self.noise) + up / kdb
            a, b = (g if a is None else a * g), (None if b is None else b * g)
        r = self.seen - m
        if likelihood == "studentt":
            r2 = r * r
            near = NU * s2 + r2
            w = (NU + 1) / near
            s, h, unit = w * r, w * (NU * s2 - r2) / near if observed else w, s2
        else:
            s, h, unit = r / s2, np.full(len(r), 1 / s2), s2
        z = self.at_floor
        if len(z):
            s[z] = 0.0
        squares = unit * (s @ r)
        if len(z):
            t = (self.noise[z] - m[z]) / sigma
            mills = _t_density(t) / _t_cdf(t) / sigma
            s[z], h[z] = -mills, mills * mills
        return h, s, a, b, squares

    def moved(self, alpha: np.ndarray, fit: int, move: _Move, likelihood: str, seasonal: bool) -> np.ndarray:
        """Intercepts after a step, as the step left them in place of their site's sums."""
        step = move.steps[fit]
        h, s, a, b, _ = self.terms(alpha, move.theta[fit], move.sigma[fit], likelihood, seasonal, False)
        u, v = (h, s) if a is None else (h * a * a, s * a)
        pulled = u * self.along(step, seasonal)
        if b is not None:
            pulled += h * a * b * step[-1]
        ra = self.per_site(v - pulled) + ALPHA_PRIOR * (self.mean - alpha)
        return alpha + move.pace[fit] * ra / (self.per_site(u) + ALPHA_PRIOR)

    def sums(self, alpha: np.ndarray, theta: np.ndarray, sigma: float, likelihood: str, seasonal: bool, observed: bool):
        """Hessian and gradient of the parameters, the sum of squares and its rows, and per site the sums of the intercept."""
        h, s, a, b, squares = self.terms(alpha, theta, sigma, likelihood, seasonal, observed)
        u, v = (h, s) if a is None else (h * a * a, s * a)
        k, S = len(theta), self.n_seasons
        H, g, Saq = np.zeros((k, k)), np.zeros(k), np.zeros((k, len(self.starts)))
        lin = {0: self.x, 1: self.high}
        if b is not None:
            # The clip offset is a column of its own.
            ub = h * a * b
            H[-1, -1], g[-1], Saq[-1] = (h * b) @ b, s @ b, self.per_site(ub)
        for j, q in lin.items():
            uq = u * q
            for i in range(j + 1):
                H[i, j] = H[j, i] = uq @ lin[i]
            g[j], Saq[j] = v @ q, self.per_site(uq)
            if b is not None:
                H[j, -1] = H[-1, j] = ub @ q
            if seasonal:
                H[j, 2:-1] = H[2:-1, j] = self.by_season(uq)
        if seasonal:
            Saq[2:-1] = np.bincount(self.cell + (self.code < 0) * (S + 1), u, len(self.starts) * (S + 1)).reshape(-1, S + 1)[:, :S].T
            g[2:-1] = self.by_season(v)
            H[range(2, k - 1), range(2, k - 1)] = Saq[2:-1].sum(axis=1)
            if b is not None:
                H[-1, 2:-1] = H[2:-1, -1] = self.by_season(ub)
        return H, g, squares, len(s) - len(self.at_floor), self.per_site(u), self.per_site(v), Saq

    def by_season(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.code + 1, v, self.n_seasons + 1)[1:]


def _bits(fits: int) -> list[int]:
    return [f for f in range(fits.bit_length()) if fits >> f & 1]


def _packed(t: pa.Table) -> Iterator[dict]:
    """Blocks of whole sites: rows of one set of fits go together, about ``BLOCK_ROWS`` at a time."""
    fits, site, piece = t["fits"].to_numpy(), t["site_id"].combine_chunks(), t["_piece"].to_numpy()
    other = np.r_[True, pc.not_equal(site.slice(1), site.slice(0, len(site) - 1)).to_numpy(zero_copy_only=False) | (np.diff(piece) != 0)]
    starts = np.flatnonzero(other | np.r_[True, np.diff(fits) != 0])
    sets, sizes = fits[starts], np.diff(starts, append=len(fits))
    heads = np.flatnonzero(other[starts])
    if (np.add.reduceat(np.bitwise_count(sets), heads) != np.bitwise_count(np.bitwise_or.reduceat(sets, heads))).any():
        raise ValueError("rows of a site that have a fit in common must have all their fits in common")
    c = {n: t[n].to_numpy().astype(float, copy=False) for n in ("clogR", "is_high", "P", "noise_dB", "S_dB", "mean_P")}
    code, wide = t["season_code"].to_numpy().astype(np.int16), t["wide"].to_numpy().astype(np.int32)
    for kind in np.unique(sets):
        mine = np.flatnonzero(sets == kind)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[mine]) // BLOCK_ROWS)) + 1
        for at in np.split(mine, cuts):
            n, first = sizes[at], starts[at]
            begin = np.cumsum(n) - n
            rows = np.repeat(first - begin, n) + np.arange(n.sum())
            of = {k: v[rows] for k, v in c.items()}
            mean = np.add.reduceat(of["P"], begin) / n
            mean = np.where(np.isnan(of["mean_P"][begin]), mean, of["mean_P"][begin])
            high, short = of["is_high"], of["is_high"].astype(np.int8)
            yield {"fits": int(kind), "starts": begin.astype(np.int32).tobytes(), "wide": wide[first].tobytes(), "mean_P": mean.tobytes(),
                   "alpha": np.tile(mean, int(kind).bit_count()).tobytes(), "clogR": of["clogR"].tobytes(), "P": of["P"].tobytes(),
                   "is_high": (short if (short == high).all() else high).tobytes(), "season_code": code[rows].tobytes(),
                   **{k: b"" if np.isnan(of[k]).all() else of[k].tobytes() for k in ("noise_dB", "S_dB")}}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of sites to blocks; a site is cut nowhere."""
    schema = pa.schema([(n, pa.int64() if kind == "bigint" else pa.binary()) for n, kind in (c.split() for c in _Block.SCHEMA.split(", "))])

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for block in _packed(t):
            yield pa.RecordBatch.from_pylist([block], schema)

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(b.num_rows for b in rest) < PACKED_ROWS:
            continue
        t = pa.Table.from_batches(rest)
        ends = pc.or_(pc.not_equal(t["site_id"], t["site_id"][-1]), pc.not_equal(t["_piece"], t["_piece"][-1]))
        cut = pc.sum(pc.cast(ends, pa.int64())).as_py()  # rows are in order: those of the last site come last
        if cut:
            yield from out(t.slice(0, cut))
        rest = t.slice(cut).to_batches()
    if any(b.num_rows for b in rest):
        yield from out(pa.Table.from_batches(rest))


SUMS = "fit_id int, wide_id int, pos int, value double"


def _step(blocks: DataFrame, since: Sequence[_Move], at: _Move, n_seasons: int, season_fits: Sequence[int], likelihood: str, observed: bool, write: bool) -> DataFrame:
    """(fit_id, wide_id, pos, value), per task: normal equations of each fit without the intercepts (wide_id -1), and the intercept sums of wide sites;
    with ``write`` also the blocks with the intercepts that the given steps lead to."""
    names = [c.split()[0] for c in _Block.SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            fresh = []
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() if n == "fits" else c[i].as_buffer() for n, c in zip(names, columns)}
                with np.errstate(over="ignore", invalid="ignore"):
                    fresh.append(one(_Block(row, n_seasons), total))
            if write:
                full = [pa.array(fresh, pa.binary()) if n == "alpha" else c for n, c in zip(names, columns)]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(fresh), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64())], *full], names=["fit_id", "wide_id", "pos", "value", *names])
        for (fit, wide), v in total.items():
            sums = [pa.array([fit] * len(v), pa.int32()), pa.array([wide] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)]
            if write:
                sums += [pa.nulls(len(v), pa.int64() if n == "fits" else pa.binary()) for n in names]
            yield pa.RecordBatch.from_arrays(sums, names=["fit_id", "wide_id", "pos", "value", *(names if write else [])])

    def one(block: _Block, total: dict) -> bytes:
        broad, own = block.broad, ~block.broad
        alphas = np.empty_like(block.alpha)
        for j, fit in enumerate(block.fits):
            alpha, seasonal = block.alpha[j], fit in season_fits
            if own.any():
                for move in since:
                    alpha = block.moved(alpha, fit, move, likelihood, seasonal)
            alphas[j] = alpha
            if broad.any():
                alpha = np.where(broad, at.alphas[fit][np.maximum(block.wide, 0)], alpha)
            H, g, squares, n, Saa, Sar, Saq = block.sums(alpha, at.theta[fit], at.sigma[fit], likelihood, seasonal, observed)
            A, ra, mine = (Saa + ALPHA_PRIOR)[own], (Sar + ALPHA_PRIOR * (block.mean - alpha))[own], Saq[:, own]
            v = np.concatenate([(H - (mine / A) @ mine.T).ravel(), g - mine @ (ra / A), [squares, n, (Saa[own] / A).sum()]])
            total[fit, -1] = total.get((fit, -1), 0.0) + v
            for i in np.flatnonzero(broad):
                at_site = fit, int(block.wide[i])
                total[at_site] = total.get(at_site, 0.0) + np.array([Saa[i], Sar[i], *Saq[:, i]])
        return alphas.tobytes()

    return blocks.mapInArrow(run, f"{SUMS}, {_Block.SCHEMA}" if write else SUMS)


def _planless(d: DataFrame) -> DataFrame:
    """The same rows without the plan that makes them: plans of tables kept one after another are told twice at each level."""
    spark = d.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(d._jdf.toJavaRDD(), d._jdf.schema()), spark)


def _placed(rows: DataFrame, wide: DataFrame, seasons: Sequence[str], tasks: int) -> DataFrame:
    """Blocks of rows side by side by site; a wide site goes in pieces, each like a site of its own."""
    code = F.lit(-1)
    for i, s in enumerate(seasons):
        code = F.when(F.col("season") == s, i).otherwise(code)
    rows = rows.where("site_id IS NOT NULL AND P IS NOT NULL AND clogR IS NOT NULL AND is_high IS NOT NULL").withColumn("_n", F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(wide), ["fits", "site_id"], "left").withColumn("_piece", F.coalesce(F.col("_n") % F.col("pieces"), F.lit(0)))
    rows = rows.select("fits", "site_id", "_piece", F.coalesce("wide", F.lit(-1)).alias("wide"), F.col("wide_mean").alias("mean_P"), code.alias("season_code"),
                       "clogR", "is_high", "P", "noise_dB", "S_dB")
    return rows.repartition(tasks, "site_id", "_piece").sortWithinPartitions("site_id", "_piece", "fits").mapInArrow(_pack, _Block.SCHEMA)


def fit_exponents(rows: DataFrame, *, season_fits: Sequence[int] = (), likelihood: str = "studentt", max_iter: int = 200,
                  tol: float = 1e-3) -> dict[int, ExponentFit]:
    """Every fit of the table in lockstep: number of the fit -> result.

    ``fits`` has a bit for each fit that a row takes part in; rows of a site that have one in common have all in common.

    Rows are laid side by side by site once, as blocks of bytes that all their fits share, and kept on the executors; each step
    reads them and sends home one short row per task and fit.  Intercepts are not sent: a task finds those of its sites again from
    the steps since they were last written beside the rows, which a step does on its way whenever there are ``REPLAYED``.
    Sites with more than ``SITE_ROWS`` rows of a fit, of which a table has few, lie in pieces, and their intercepts are kept with
    the parameters.
    """
    spark = rows.sparkSession
    several = F.max(F.col("n_seasons") > 1) if "n_seasons" in rows.columns else F.lit(False)
    per = rows.groupBy("fits", "site_id").agg(
        F.max("is_high").alias("high"), F.count("S_dB").alias("clip"), F.count(F.lit(1)).alias("n"), F.avg("P").alias("mean"), several.alias("mixed"))
    large = F.when((F.col("n") > SITE_ROWS) & F.col("site_id").isNotNull(), F.struct("site_id", "n", "mean"))
    sets = {r["fits"]: r for r in per.groupBy("fits").agg(
        (F.max("high") > 0).alias("high"), F.sum("clip").alias("clip"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sites"),
        F.count(F.when(F.col("mixed"), 1)).alias("n_mixed"), F.collect_list(large).alias("large")).collect()}
    of = {f: [r for s, r in sets.items() if s >> f & 1] for f in sorted({f for s in sets for f in _bits(s)})}
    facts = {f: {k: sum(r[k] or 0 for r in v) for k in ("clip", "n", "n_sites", "n_mixed", "high")} for f, v in of.items()}
    seasons = sorted(r[0] for r in rows.where(F.col("fits").bitwiseAND(sum(1 << f for f in season_fits)) != 0).select("season").distinct().collect()) if season_fits else []
    names = ["x", "delta_high", *[f"season[{s}]" for s in seasons], "clip_offset"]
    k = len(names)
    fixed = 1e-6  # a parameter a fit does not have is held at zero
    prior_mean = np.array([PRIOR_X[0]] + [0.0] * (k - 1))
    prior_sd = {f: np.array([PRIOR_X[1], PRIOR_SD["delta_high"] if r["high"] else fixed,
                             *[PRIOR_SD["season"] if f in season_fits else fixed] * len(seasons), PRIOR_SD["clip"] if r["clip"] else fixed])
                for f, r in facts.items()}
    theta = {f: prior_mean.copy() for f in facts}
    sigma = dict.fromkeys(facts, 5.0)
    wide = [(s, v["site_id"], i, -(-v["n"] // SITE_ROWS), v["mean"]) for i, (s, v) in enumerate((s, v) for s, r in sets.items() for v in r["large"])]
    means = np.array([w[4] for w in wide], dtype=float)
    alphas = {f: means.copy() for f in facts}
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(r["n"] for r in sets.values()) // TASK_ROWS))
    placed = _placed(rows, spark.createDataFrame(wide, "fits bigint, site_id string, wide int, pieces bigint, wide_mean double"), seasons, tasks).persist()
    since: list[_Move] = []
    written = 0  # the longer they go on, the more steps are between them, so that few hang on one another

    def reduced(at: _Move, observed: bool) -> tuple[dict, dict]:
        """Per fit the normal equations with the prior and the sums of squares; per wide site and fit the sums of its intercept."""
        nonlocal placed, written
        write = len(since) >= max(REPLAYED, written)
        made = _step(placed.where("fits IS NOT NULL").select(*[c.split()[0] for c in _Block.SCHEMA.split(", ")]), list(since), at, len(seasons), season_fits, likelihood, observed, write)
        made = _planless(made).persist() if write else made
        got: dict[tuple[int, int], dict[int, float]] = {}
        try:
            for r in made.where("fit_id IS NOT NULL").groupBy("fit_id", "wide_id", "pos").agg(F.sum("value").alias("value")).collect():  # one short row per fit and per wide site
                got.setdefault((r["fit_id"], r["wide_id"]), {})[r["pos"]] = r["value"]
        finally:
            if write:
                placed.unpersist()
                placed, written = made, written + 1
                since.clear()
        flat = {key: np.array([v[i] for i in range(len(v))]) for key, v in got.items()}
        out = {f: [v[:k * k].reshape(k, k), v[k * k:k * k + k], *v[k * k + k:]] for (f, w), v in flat.items() if w < 0}
        sites = {(f, w): (v[0], v[1] + ALPHA_PRIOR * (means[w] - alphas[f][w]), v[2:]) for (f, w), v in flat.items() if w >= 0}
        for (f, _), (Saa, ra, Saq) in sites.items():
            o, A = out[f], Saa + ALPHA_PRIOR
            o[0], o[1], o[4] = o[0] - np.outer(Saq, Saq) / A, o[1] - Saq * ra / A, o[4] + Saa / A
        for f, o in out.items():
            sd = prior_sd[f]
            o[0], o[1] = o[0] + np.diag(1 / sd**2), o[1] + (prior_mean - theta[f]) / sd**2
        return out, sites

    rounds = 0
    # A fit whose steps turn back on themselves takes shorter ones.
    pace, before = dict.fromkeys(facts, 1.0), {f: np.zeros(k) for f in facts}
    try:
        for rounds in range(1, max_iter + 1):
            at = _Move(dict(theta), dict(sigma), alphas)
            sums, sites = reduced(at, observed=False)
            moved, steps = 0.0, {}
            for f, (H, grad, S2, N2, V) in sums.items():
                steps[f] = np.linalg.solve(H, grad)
                pace[f] = max(pace[f] / 2, 1 / 64) if steps[f] @ before[f] < 0 else min(1.0, 1.2 * pace[f])
                before[f] = steps[f]
                theta[f] = theta[f] + pace[f] * steps[f]
                # Residuals around a fitted intercept are too small by its own uncertainty.
                new = math.sqrt(max((S2 + sigma[f] ** 2 * V) / max(N2, 1), 1e-8))
                moved = max(moved, float(np.abs(steps[f]).max()), abs(new - sigma[f]))
                sigma[f] = new
            alphas = {f: v.copy() for f, v in alphas.items()}
            for (f, w), (Saa, ra, Saq) in sites.items():
                alphas[f][w] += pace[f] * (ra - Saq @ steps[f]) / (Saa + ALPHA_PRIOR)
            since.append(replace(at, steps=steps, pace=dict(pace)))
            if moved < tol:
                break
        else:
            raise RuntimeError(f"the fit still moved by {moved:.2g} in step {max_iter}")
        last, _ = reduced(_Move(theta, sigma, alphas), observed=True)
    finally:
        placed.unpersist()
    out = {}
    for f, (H, *_) in last.items():
        # Held parameters stay out of the inverse: their 1e12 on the diagonal would drown its digits.
        has = [i for i in range(k) if prior_sd[f][i] != fixed]
        out[f] = ExponentFit([names[i] for i in has], theta[f][has], np.linalg.inv(H[np.ix_(has, has)]), sigma[f], int(facts[f]["n"]), int(facts[f]["n_sites"]), rounds, int(facts[f]["n_mixed"]))
    return out


def simulate_power(d: DataFrame, x_true: float = 2.5, sigma: float = 3.0, seed: int = 20260831, clip: bool = False) -> DataFrame:
    """Powers on the real geometry with a known exponent; noise comes from hashed row keys."""
    site = F.xxhash64("site_id")
    row = F.xxhash64("site_id", "frame_id", "clogR", "r_surf")
    mu = F.lit(-40.0) + 15.0 * hash_normal(site, seed) - 10 * x_true * F.col("clogR")
    mu = soft_min(mu, F.col("S_dB")) if clip else mu
    chi = F.lit(0.0)
    for i in range(4):
        z = hash_normal(row, seed + 10 + i)
        chi = chi + z * z
    return d.withColumn("P_sim", mu + sigma * hash_normal(row, seed + 1) / F.sqrt(chi / 4))


def fit_rows(spark, fits: Sequence[tuple[str, ExponentFit, dict]]) -> DataFrame:
    data = [{**f.row(n), **extra} for n, f, extra in fits]
    schema = ("fit string, n_traces bigint, n_sites bigint, x_mean double, x_sd double, x_eti89_lb double, x_eti89_ub double, "
              "sigma_mean double, delta_high_mean double, delta_high_sd double")
    names = [c.split()[0] for c in schema.split(", ")]
    extra = [k for k in (data[0] if data else {}) if k not in names]
    schema += "".join(f", {k} {'bigint' if isinstance(data[0][k], int) else 'string'}" for k in extra)
    return spark.createDataFrame([tuple(r[k] for k in [*names, *extra]) for r in data], schema)


def pass_pairs(t: DataFrame, clip_levels: DataFrame, min_gap: float = 200.0) -> DataFrame:
    """Pairwise exponents of the passes over one site: each pass against every higher one
    at least ``min_gap`` above it.

    Passes are medians per (site, frame), so a pair is two overflights, not two traces.
    """
    seg = t.where(F.coalesce("surface_gate_ok", F.lit(False)) & F.col("surface_power_dB").isNotNull()).withColumn(
        "segment", labels.segment(F.col("frame_id")))
    j = seg.join(clip_levels.select("season", "segment", "S_dB").where("S_dB is not null"), ["season", "segment"])
    keys = ["site_id", "sheet", "season", "frame_id"]
    median = lambda c: F.percentile(F.col(c).cast("double"), 0.5)
    passes = j.groupBy(*keys).agg(median("surface_power_dB").alias("P"), median("r_surf").alias("R"), F.min("S_dB").alias("S"))
    a, b = passes.alias("a"), passes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys[:3]]
    pairs = a.join(b, [*on, F.col("b.R") - F.col("a.R") >= min_gap])
    bright_a = F.col("a.P") > F.col("b.P")
    return pairs.select(
        *[F.col(f"a.{k}") for k in keys[:3]], F.col("a.frame_id").alias("frame_low"), F.col("b.frame_id").alias("frame_high"),
        pair_exponent(F.col("a.P"), F.col("a.R"), F.col("b.P"), F.col("b.R")).alias("x_pair"),
        F.log10(F.col("b.R") / F.col("a.R")).alias("dlogR"),
        F.when(bright_a, F.col("a.S") - F.col("a.P")).otherwise(F.col("b.S") - F.col("b.P")).alias("headroom_bright"))

"""Exact order statistics and ranks without sorting a large group in one task, one way for groups of any size.

A group is cut into buckets by splitters taken from its own values (an approximate percentile sketch, pre-aggregated in the
tasks). Values are counted per (keys, bucket, value), so a hot group is spread over many tasks and copies of one value
collapse into one row. Only the buckets that hold a wanted rank are looked at again. Splitters only decide how evenly
the work is spread; the counts that the result comes from are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS = 128
SALTS = 32


def bucketed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ``_b``, a monotone bucket of ``_v`` in its group that holds about 1 of ``BUCKETS`` parts of the different places."""
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", shares, 20 * BUCKETS).alias("_cuts"))
    cuts = cuts.withColumn("_cuts", F.array_distinct("_cuts"))
    with_cuts = _join_keys(rows, cuts, keys)
    return with_cuts.withColumn("_b", F.size(F.filter("_cuts", lambda x: x <= F.col("_v"))).cast("long")).drop("_cuts")


def _totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each bucket of a group, and rows of the group."""
    per_bucket = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_nb"))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return per_bucket.select(
        *keys, "_b", "_nb",
        (F.sum("_nb").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_nb")).alias("_before"),
        F.sum("_nb").over(w).alias("_total"),
    )


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL meets NULL; the right-hand keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = eq if cond is None else cond & eq
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *,
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group: one output column per entry of ``probs``.

    NULL values are ignored; groups without any value do not appear.  The
    result also carries ``n_values``, the number of values per group, and the
    ``extra`` aggregates of the same groups.
    """
    return quantiles_of(df, keys, {n: (value, p) for n, p in probs.items()}, extra=extra)


def quantiles_of(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, float]], *,
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """Quantiles of several columns of the same groups; ``n_values`` counts the first column."""
    keys, extra = list(keys), extra or {}
    if not keys:
        return quantiles_of(df.withColumn("_all", F.lit(0)), ["_all"], specs, extra=extra).drop("_all")
    first = next(iter(specs.values()))[0]
    out = None
    for v in dict.fromkeys(v for v, _ in specs.values()):
        rows = df.where(F.col(v).isNotNull()).select(*keys, F.col(v).cast("double").alias("_v"))
        part = _spread(rows, keys, {n: p for n, (c, p) in specs.items() if c == v})
        part = part if v == first else part.drop("n_values")
        out = part if out is None else _join_keys(out, part, keys, "left")
    if extra:
        more = df.groupBy(*keys).agg(*[c.alias(n) for n, c in extra.items()])
        out = _join_keys(out, more, keys)
    return out.select(*keys, "n_values", *specs, *extra)


def _spread(rows: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Counts per bucket, then only the buckets that matter."""
    counts = bucketed(rows, keys).groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    totals = _totals(counts, keys)
    wanted = None
    for p in probs.values():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        for r in (F.floor(pos), F.ceil(pos)):
            c = (F.col("_before") <= r) & (r < F.col("_before") + F.col("_nb"))
            wanted = c if wanted is None else wanted | c
    picked = totals.where(wanted).drop("_nb")
    on = [*keys, "_b"]
    near = _join_keys(counts, picked, on)
    end = F.sum("_n").over(W.partitionBy(*on).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")
    placed = near.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    aggs = [F.max("_total").alias("n_values")]
    for i, p in enumerate(probs.values()):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}")]
    out = placed.groupBy(*keys).agg(*aggs)
    cols = []
    for i, (name, p) in enumerate(probs.items()):
        pos = (F.col("n_values") - 1) * F.lit(float(p))
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, "n_values", *cols)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def with_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, rank: str = "rank", total: str = "n_total") -> DataFrame:
    """1-based rank of every row in its group by (value, salt of tie, tie), and the group size.

    Equal values get distinct consecutive ranks.  A value shared by very many
    rows is split over salts, so no task numbers a whole group.
    """
    keys = list(keys)
    if not keys:
        return with_rank(df.withColumn("_all", F.lit(0)), ["_all"], value, tie, rank, total).drop("_all")
    rows = bucketed(df.where(F.col(value).isNotNull()).withColumns({
        "_v": F.col(value).cast("double"), "_s": F.pmod(F.xxhash64(tie), F.lit(SALTS))}), keys)
    counts = rows.groupBy(*keys, "_b", "_v", "_s").agg(F.count(F.lit(1)).alias("_n"))
    totals = _totals(counts, keys).drop("_nb")
    on = [*keys, "_b"]
    offs = _join_keys(counts, totals, on).select(
        *on, "_v", "_s", "_total",
        (F.col("_before") + F.sum("_n").over(
            W.partitionBy(*on).orderBy("_v", "_s").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_off"))
    on = [*keys, "_b", "_v", "_s"]
    joined = _join_keys(rows, offs, on)
    w = W.partitionBy(*on).orderBy(tie)
    return joined.withColumns({rank: F.col("_off") + F.row_number().over(w), total: F.col("_total")}).drop(
        "_v", "_b", "_s", "_total", "_off")

"""Two-sample comparisons of a value inside and outside a mask.

The tests share one table of distinct values with counts per side; ties are already collapsed
there, and running totals give ranks and distribution functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.mathx import normal_cdf, uniform
from meltgrid.functions.nulls import finite
from meltgrid.operators.grid import downsample
from meltgrid.operators.masks import flag
from meltgrid.operators.ordered import GROUP_ROWS, dense_index, midpoint_quantile, prefix_sums
from meltgrid.session import sized

KS_TERMS = 101


def pooled(df: DataFrame, value: str, mask: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(x, n_in, n_out, cum_n_in, cum_n_out)`` over distinct finite values."""
    inside = flag(F.col(mask))
    counts = df.filter(finite(F.col(value))).groupBy(F.col(value).cast("double").alias("x")).agg(
        F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))
    return prefix_sums(counts, [], "x", ["n_in", "n_out"], group_rows)


def ranksum(df: DataFrame, value: str, mask: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rank-sum test with tie correction and continuity correction; superiority ``ps = U / n1 n2``."""
    t = F.col("n_in") + F.col("n_out")
    before = F.col("cum_n_in") + F.col("cum_n_out") - t
    tab = pooled(df, value, mask, group_rows).agg(
        F.sum("n_in").alias("n1"), F.sum("n_out").alias("n2"),
        F.sum(F.col("n_in") * (before + (t + 1) / 2.0)).alias("w"),
        F.sum(t.cast("double") * t * t - t).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    var = n1 * n2 * (n + 1 - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0))) / 12.0
    d = F.col("w") - n1 * (n + 1) / 2.0
    z = (d - 0.5 * F.signum(d)) / F.nullif(F.sqrt(var), F.lit(0.0))
    u = F.col("w") - n1 * (n1 + 1) / 2.0
    return tab.select("n1", "n2", "w", u.alias("u"), z.alias("z"), (2.0 * normal_cdf(-F.abs(z))).alias("p"),
                      (u / F.nullif(n1 * n2, F.lit(0.0))).alias("ps"))


def ks_2samp(df: DataFrame, value: str, mask: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and its asymptotic p-value."""
    tab = pooled(df, value, mask, group_rows)
    tot = tab.agg(F.sum("n_in").alias("n1"), F.sum("n_out").alias("n2")).first()
    n1, n2 = tot["n1"] or 0, tot["n2"] or 0
    gap = F.abs(F.col("cum_n_in") / F.lit(float(max(n1, 1))) - F.col("cum_n_out") / F.lit(float(max(n2, 1))))
    out = tab.agg(F.max(gap).alias("d")).withColumns({"n1": F.lit(n1).cast("long"), "n2": F.lit(n2).cast("long")})
    n = n1 * n2 / max(n1 + n2, 1)
    root = max(n, 1e-300) ** 0.5
    lam = F.greatest((root + 0.12 + 0.11 / root) * F.col("d"), F.lit(0.0))
    terms = F.transform(F.sequence(F.lit(1), F.lit(KS_TERMS)),
                        lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * lam * lam * j * j))
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return out.withColumn("p", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def prob_superiority(df: DataFrame, value: str, mask: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exact P(in > out) + P(in = out) / 2 over all pairs, from ranks."""
    return ranksum(df, value, mask, group_rows).select("n1", "n2", "ps")


def prob_superiority_mc(df: DataFrame, value: str, mask: str, n_pairs: int, n_boot: int, n_pairs_boot: int,
                        seed: int = 1, block: str = "ri", order: Sequence[str] = ("ci",), draws: str = "fast",
                        summary: bool = True) -> DataFrame:
    """Paired Monte Carlo estimate (replicate 0) with a percentile interval from replicates 1..B."""
    spark = df.sparkSession
    src = df.filter(finite(F.col(value))).select(flag(F.col(mask)).alias("_m"), block, *order, F.col(value).alias("_v"))
    ranked = dense_index(src, block, order, ["_m"])
    n = {r["_m"]: r["n"] for r in src.groupBy("_m").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        raise ValueError("both sides need finite values")
    first = spark.range(n_pairs).select(F.lit(0).cast("long").alias("rep"), F.col("id").alias("draw"))
    more = spark.range(n_boot * n_pairs_boot).select(
        F.expr(f"id div {n_pairs_boot} + 1").alias("rep"), F.expr(f"id % {n_pairs_boot}").alias("draw"))
    pairs = first.unionByName(more)

    def pick(tag: str, size: int) -> Column:
        return F.floor(uniform(F.lit(seed), tag, F.col("rep"), F.col("draw"), kind=draws) * F.lit(size))

    pairs = pairs.select("rep", pick("in", n[True]).alias("_i"), pick("out", n[False]).alias("_o"))
    a = ranked.filter("_m").select(F.col("idx").alias("_i"), F.col("_v").alias("_a"))
    b = ranked.filter("NOT _m").select(F.col("idx").alias("_o"), F.col("_v").alias("_b"))
    both = pairs.join(a, "_i").join(b, "_o")
    score = F.when(F.col("_a") > F.col("_b"), 1.0).when(F.col("_a") == F.col("_b"), 0.5).otherwise(0.0)
    reps = both.groupBy("rep").agg(F.avg(score).alias("ps"))
    if not summary:
        return reps
    point = reps.agg(F.max(F.when(F.col("rep") == 0, F.col("ps"))).alias("ps"), F.lit(0).alias("_k"))
    ci = midpoint_quantile(reps.filter("rep > 0"), "ps", {"lo95": 0.025, "hi95": 0.975}).withColumn("_k", F.lit(0))
    return point.join(ci, "_k").select("ps", "lo95", "hi95", F.col("n").alias("n_boot"))


def group_shift(df: DataFrame, value: str, mask: str, thr: float) -> DataFrame:
    """Medians and exceedance shares of both sides and their difference."""
    src = df.filter(finite(F.col(value))).select(flag(F.col(mask)).alias("_m"), F.col(value).alias("_v"))
    share = src.groupBy("_m").agg(F.avg((F.col("_v") >= thr).cast("double")).alias("share"))
    both = midpoint_quantile(src, "_v", {"med": 0.5}, ["_m"]).join(share, "_m")

    def side(c: str, inside: bool) -> Column:
        return F.max(F.when(F.col("_m") == inside, F.col(c)))

    out = both.agg(*[side(c, m).alias(f"{c}_{t}") for c in ("n", "med", "share") for m, t in ((True, "in"), (False, "out"))])
    return out.withColumn("d_med", F.col("med_in") - F.col("med_out"))


def quantile_shift(df: DataFrame, value: str, mask: str, levels: Sequence[int] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """Quantiles of both sides and their shift, one row per level."""
    src = df.filter(finite(F.col(value))).select(flag(F.col(mask)).alias("_m"), F.col(value).alias("_v"))
    q = midpoint_quantile(src, "_v", {f"p{n}": n / 100 for n in levels}, ["_m"])
    pairs = ", ".join(f"{n}, p{n}" for n in levels)
    long = q.selectExpr("_m", f"stack({len(levels)}, {pairs}) AS (level, v)")
    out = long.groupBy("level").agg(F.max(F.when(F.col("_m"), F.col("v"))).alias("q_in"),
                                    F.max(F.when(~F.col("_m"), F.col("v"))).alias("q_out"))
    return out.withColumn("dq", F.col("q_in") - F.col("q_out"))


def stride_sample(df: DataFrame, k: int) -> DataFrame:
    """Every k-th cell in both directions."""
    return df if k <= 1 else downsample(df, k)


def stride_for(share: float = 0.02, most: int = 25) -> int:
    """Row and column stride keeping about ``share`` of the cells."""
    return min(max(1, math.floor(math.sqrt(1.0 / share) + 0.5)), most)


def robustness(df: DataFrame, value: str, mask: str, k: int | None = None, least: int = 1000) -> DataFrame:
    """The tests on a spatial subsample, by default of about 2 %; skipped when a side has fewer
    than ``least`` cells."""
    k = stride_for() if k is None else k
    sub = stride_sample(df, k)
    rs = ranksum(sub, value, mask).withColumn("_k", F.lit(0))
    ks = ks_2samp(sub, value, mask).select(F.lit(0).alias("_k"), "d", F.col("p").alias("p_ks"))
    out = rs.join(sized(ks), "_k")
    run = (F.col("n1") >= least) & (F.col("n2") >= least)
    return out.select(F.lit(k).alias("stride"), F.col("n1").alias("n_in"), F.col("n2").alias("n_out"), run.alias("did_run"),
                      *[F.when(run, F.col(c)).alias(t) for c, t in (("p", "p_rank"), ("p_ks", "p_ks"), ("d", "d"), ("ps", "ps"))])

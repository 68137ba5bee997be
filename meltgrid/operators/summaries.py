"""Distribution summaries, coverage and diagnostic tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.mathx import EPS
from meltgrid.functions.nulls import finite
from meltgrid.functions.physics import ADV_DENSITY, SECONDS_PER_YEAR, basal_gradient, heat_capacity
from meltgrid.functions.truth import logistic_anchors
from meltgrid.operators.grid import extents, regrid_bilinear
from meltgrid.operators.masks import flag
from meltgrid.operators.ordered import midpoint_quantile
from meltgrid.session import cut_lineage, sized

LEVELS = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90,
          "p95": 0.95, "p99": 0.99}


def summarize(df: DataFrame, col: str, masks: Mapping[str, Column]) -> DataFrame:
    """Count, extremes, moments and quantiles of ``col`` under each mask; masks may overlap."""
    tags = F.array_compact(F.array(*[F.when(flag(m), F.lit(n)) for n, m in masks.items()]))
    src = df.select(F.col(col).alias("_v"), tags.alias("_t")).filter(finite(F.col("_v")))
    src = src.select("_v", F.explode("_t").alias("mask"))
    base = src.groupBy("mask").agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"))
    return base.join(midpoint_quantile(src, "_v", LEVELS, ["mask"]).drop("n"), "mask")


def calibrate_logistic(df: DataFrame, col: str, q_low: float = 0.5, q_high: float = 0.95,
                       w_low: float = 0.6, w_high: float = 0.95) -> DataFrame:
    """One row with the two quantile anchors, the slope ``k`` and the midpoint ``tmid``."""
    anchors = midpoint_quantile(df, col, {"sc_low": q_low, "sc_high": q_high}).drop("n")
    k, mid = logistic_anchors(F.col("sc_low"), F.col("sc_high"), w_low, w_high)
    return anchors.withColumns({"k": k, "tmid": mid})


def coverage_report(df: DataFrame) -> DataFrame:
    """Mask sizes, missing shares inside the scored area and the wet base rate, in one aggregate."""
    roi = flag(F.col("roi"))

    def missing(c: str) -> Column:
        return (100.0 * F.avg(F.when(flag(F.col("reg")), (~finite(F.col(c))).cast("double")))).alias(f"pct_missing_{c}")

    n_reg, n_viz, n_roi = F.count_if(flag(F.col("reg"))), F.count_if(flag(F.col("viz"))), F.count_if(roi)
    return df.agg(
        n_reg.alias("n_reg"), n_viz.alias("n_viz"), n_roi.alias("n_roi"),
        (100.0 * n_roi / F.greatest(n_reg, F.lit(1))).alias("roi_pct"),
        missing("q"), missing("h"), missing("icevel"),
        (100.0 * F.avg(F.when(roi, F.col("y").cast("double")))).alias("base_rate_pct"))


WEIGHT_BINS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def weight_diagnostics(df: DataFrame, label: str = "y", weight: str = "w") -> DataFrame:
    """How soft labels spread and disagree with the hard ones; effective sample sizes."""
    w, y = F.col(weight), F.col(label)
    src = df.filter(finite(w))
    last = len(WEIGHT_BINS) - 2
    shares = []
    for i, (a, b) in enumerate(zip(WEIGHT_BINS, WEIGHT_BINS[1:])):
        inside = (w >= a) & ((w <= b) if i == last else (w < b))
        shares.append(F.avg(inside.cast("double")).alias(f"share_{i}"))
    dry = 1.0 - w
    return src.agg(
        F.count(F.lit(1)).alias("n"), F.avg(y.cast("double")).alias("wet_share"), F.avg(w).alias("mean_weight"),
        *shares, F.avg(((y == 1) != (w > 0.5)).cast("double")).alias("disagree"),
        (F.pow(F.sum(w), F.lit(2.0)) / F.greatest(F.sum(w * w), F.lit(EPS))).alias("ess_wet"),
        (F.pow(F.sum(dry), F.lit(2.0)) / F.greatest(F.sum(dry * dry), F.lit(EPS))).alias("ess_dry"),
        F.avg(w.between(0.25, 0.75).cast("double")).alias("ambiguous"))


def change_stats(df: DataFrame, before: str, after: str, by: Sequence[str]) -> DataFrame:
    """Absolute and percent change of a corrected field, per model; the changes are written once for all passes."""
    b, a = F.col(before), F.col(after)
    src = cut_lineage(df.filter(finite(b) & finite(a) & (b != 0)).select(
        *by, (a - b).alias("abs"), (100.0 * (a - b) / b).alias("pct")))
    share = {f"frac_gt_{n}": F.avg((F.abs(F.col("pct") / 100.0) > x).cast("double"))
             for n, x in (("05", 0.05), ("10", 0.10), ("25", 0.25))}
    out = src.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{s}") for c in ("abs", "pct")
                                        for s, f in (("mean", F.avg), ("std", F.stddev_samp))],
        *[e.alias(n) for n, e in share.items()])
    for c in ("abs", "pct"):
        q = midpoint_quantile(src, c, {f"{c}_p05": 0.05, f"{c}_median": 0.5, f"{c}_p95": 0.95}, by, store=False).drop("n")
        out = out.join(q, list(by))
    return out


def clip_stats(df: DataFrame, col: str, lo: float | None, hi: float | None, by: Sequence[str] = ()) -> DataFrame:
    """Share of finite values at the floor and at the cap."""
    v = F.col(col)
    src = df.filter(finite(v))
    floor = F.lit(0.0) if lo is None else F.avg((v <= lo + EPS).cast("double"))
    cap = F.lit(0.0) if hi is None else F.avg((v >= hi - EPS).cast("double"))
    return src.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
                                floor.alias("f_floor"), cap.alias("f_cap"))


def field_summary(df: DataFrame, col: str) -> DataFrame:
    v = F.col(col)
    base = df.filter(finite(v)).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
                                    F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    ps = {k: LEVELS[k] for k in ("p01", "p05", "p25", "p50", "p75", "p95", "p99")}
    return base.join(sized(midpoint_quantile(df, col, ps)), "n", "left")


def field_corr(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation over cells where both fields are known."""
    both = df.filter(finite(F.col(a)) & finite(F.col(b)))
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("corr"))


def error_quantiles(df: DataFrame, err: str) -> DataFrame:
    return midpoint_quantile(df, err, {"p50": 0.5, "p95": 0.95})


def gradient_check(df: DataFrame, col: str, slope: str, step: float, ncols: int, nrows: int) -> DataFrame:
    """Absolute error between the along-flow slope and a finite difference of the field sampled
    one step ahead and behind along ``ex, ey``."""
    src = df.select(F.col("ci").alias("ix"), F.col("ri").alias("iy"), F.col(col).alias("z"))
    out = df.select("cell_id", "x_m", "y_m", "ex", "ey", slope)
    for tag, sign in (("f", 1.0), ("b", -1.0)):
        moved = out.withColumns({"_x": F.col("x_m"), "_y": F.col("y_m")}).withColumns({
            "x_m": F.col("_x") + sign * step * F.col("ex"), "y_m": F.col("_y") + sign * step * F.col("ey")})
        moved = regrid_bilinear(src, moved, x0=0.0, dx=step, nx=ncols, y0=0.0, dy=step, ny=nrows,
                                extrap="nearest", name=f"_z{tag}")
        out = moved.drop("x_m", "y_m").withColumnsRenamed({"_x": "x_m", "_y": "y_m"})
    err = F.abs((F.col("_zf") - F.col("_zb")) / (2.0 * step) - F.col(slope))
    return error_quantiles(out.select("cell_id", err.alias("err")), "err")


def depth_check(df: DataFrame, flux: str, steps: int = 200) -> DataFrame:
    """Trapezoid depth integral of the advected heat against the closed form ``flux``.

    Needs ``h, ts, mb, speed`` and the slopes ``dts, dh, dmb``.  The integrand is linear in the
    step, so the trapezoid weights of all steps are summed beforehand and every cell stays one row:
    nothing is exploded and nothing shuffled.
    """
    h, ts = F.col("h"), F.col("ts")
    rate, drate = F.col("mb") / SECONDS_PER_YEAR, F.col("dmb") / SECONDS_PER_YEAR
    u_bar = 0.5 * (F.col("speed") / SECONDS_PER_YEAR)
    shape = F.col("dh") / h - drate / F.greatest(rate, F.lit(1e-12))
    dz = h / (steps - 1)
    weights = [0.5 if i in (0, steps - 1) else 1.0 for i in range(steps)]
    level, slope = sum(weights), sum(i * w for i, w in enumerate(weights))
    total = F.col("dts") * level + 0.5 * basal_gradient(h, ts) * shape * dz * slope
    src = df.filter(F.col(flux).isNotNull() & (h > 0))
    err = F.abs(ADV_DENSITY * heat_capacity(ts) * u_bar * dz * total - F.col(flux))
    return error_quantiles(src.select(err.alias("err")), "err")


def orientation_check(df: DataFrame, layer: str, label: str, mask: Column) -> DataFrame:
    """Agreement of ``layer >= p80`` with the labels, as stored and with rows reversed."""
    e = extents(df).first()
    last = e["r0"] + e["r1"]
    inside = df.filter(flag(mask) & finite(F.col(layer)))
    cut = midpoint_quantile(inside, layer, {"c": 0.8}).first()["c"]
    turned = df.select((F.lit(last) - F.col("ri")).alias("ri"), "ci", F.col(layer).alias("_t"))
    both = inside.select("ri", "ci", layer, label).join(turned, ["ri", "ci"], "left")

    def agree(c: str) -> Column:
        high = F.coalesce(F.col(c) >= cut, F.lit(False))
        return F.avg((high == (F.col(label) == 1)).cast("double"))

    out = both.agg(F.count(F.lit(1)).alias("n"), agree(layer).alias("as_is"), agree("_t").alias("flipped"))
    return out.withColumn("suspect", F.col("flipped") > F.col("as_is") + 0.02)


def detect_axis_mode(x_axis: DataFrame, y_axis: DataFrame, attrs: Mapping[str, str] | None = None) -> DataFrame:
    """Unit of a pair of axes ``(i, v)``: degrees, kilometers or meters.

    Attribute text decides first, then the magnitude of the coordinates, then their spacing.
    """
    from pyspark.sql import Window

    attrs = {k: v.lower() for k, v in (attrs or {}).items()}
    units = (attrs.get("x_units", ""), attrs.get("y_units", ""))
    named = attrs.get("x_name") in ("lon", "longitude") or attrs.get("y_name") in ("lat", "latitude")
    text = None
    if any("degree" in u for u in units) or named or "longitude" in attrs.get("x_standard", "") \
            or "latitude" in attrs.get("y_standard", ""):
        text = "degrees"
    elif any("kilometer" in u or "km" in u for u in units):
        text = "kilometers"
    elif any("metre" in u or "meter" in u for u in units):
        text = "meters"

    def stats(axis: DataFrame, tag: str) -> DataFrame:
        w = Window.partitionBy(F.lit(0)).orderBy("i")
        gaps = axis.select("v", F.abs(F.col("v") - F.lag("v").over(w)).alias("d"))
        return gaps.agg(F.lit(0).alias("one"), F.max(F.abs("v")).alias(f"max_{tag}"), F.median("d").alias(f"gap_{tag}"))

    out = sized(stats(x_axis, "x")).join(sized(stats(y_axis, "y")), "one").drop("one")
    mx, my = F.col("max_x"), F.col("max_y")
    guess = (F.when((mx <= 370) & (my <= 95), "degrees").when((mx > 5e3) | (my > 5e3), "meters")
             .when((F.col("gap_x") < 5) & (F.col("gap_y") < 5) & (mx <= 720) & (my <= 180), "degrees")
             .otherwise("meters"))
    return out.withColumn("mode", F.lit(text) if text else guess)


def axis_in_metres(axis: DataFrame, mode: str) -> DataFrame:
    """Coordinates ``v`` of an axis in metres; degrees stay as they are until they are projected."""
    return axis.withColumn("v", F.col("v") * 1000.0) if mode == "kilometers" else axis

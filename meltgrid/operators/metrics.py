"""Confusion metrics per model, region and threshold.

All sums are one grouped aggregate with partial aggregation on the map side; only rows of report
size leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.mathx import EPS, clamp, ratio
from meltgrid.functions.names import is_flat
from meltgrid.functions.nulls import at_least
from meltgrid.functions.truth import p_wet
from meltgrid.operators.masks import flag
from meltgrid.operators.ordered import midpoint_quantile
from meltgrid.session import cut_lineage, sized

SCORES = ("acc", "prec", "spec", "rec", "f1", "g_mean", "g_prod")


def hard_counts(pred: Column, y: Column) -> list[Column]:
    """TP, FP, TN, FN of a boolean prediction against a 0/1 label."""
    wet = y == 1
    return [F.count_if(pred & wet).alias("tp"), F.count_if(pred & ~wet).alias("fp"),
            F.count_if(~pred & ~wet).alias("tn"), F.count_if(~pred & wet).alias("fn")]


def soft_counts(weight: Column, y: Column) -> list[Column]:
    """Confusion mass for a wet weight in [0, 1] (0/1 for a plain prediction) and a soft label."""
    y = clamp(y, 0.0, 1.0)
    return [F.sum(weight * y).alias("tp"), F.sum(weight * (1.0 - y)).alias("fp"),
            F.sum((1.0 - weight) * (1.0 - y)).alias("tn"), F.sum((1.0 - weight) * y).alias("fn")]


def with_scores(df: DataFrame) -> DataFrame:
    """Add the score columns to a frame holding tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    df = df.withColumns({
        "acc": ratio(tp + tn, tp + fp + tn + fn), "prec": ratio(tp, tp + fp),
        "spec": ratio(tn, tn + fp), "rec": ratio(tp, tp + fn)})
    return df.withColumns({
        "f1": 2.0 * F.col("prec") * F.col("rec") / F.greatest(F.col("prec") + F.col("rec"), F.lit(EPS)),
        "g_mean": F.sqrt(F.greatest(F.col("rec"), F.lit(0.0)) * F.greatest(F.col("spec"), F.lit(0.0))),
        "g_prod": F.col("rec") * F.col("spec")})


def count_ratios(df: DataFrame) -> DataFrame:
    """TP/FP and TN/FN, with an empty divisor counted as the smallest positive number."""
    return df.withColumns({"tp_fp": ratio(F.col("tp").cast("double"), F.col("fp")),
                           "tn_fn": ratio(F.col("tn").cast("double"), F.col("fn"))})


def confusion(df: DataFrame, by: Sequence[str], pred: str = "pred", label: str = "y") -> DataFrame:
    return with_scores(df.groupBy(*by).agg(*hard_counts(F.col(pred), F.col(label))))


def confusion_soft(df: DataFrame, by: Sequence[str], pred: str = "pred", label: str = "w") -> DataFrame:
    return with_scores(df.groupBy(*by).agg(*soft_counts(F.col(pred).cast("double"), F.col(label))))


def confusion_expected(df: DataFrame, by: Sequence[str], pw: str = "pw", label: str = "y") -> DataFrame:
    """Expected confusion under the wet probability; rows without one are left out."""
    kept = df.filter(F.col(pw).isNotNull() & F.col(label).isNotNull())
    return with_scores(kept.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *soft_counts(F.col(pw), F.col(label).cast("double"))))


def regional_sums(weight: Column, y: Column, inner: Column, outer: Column) -> list[Column]:
    y = y.cast("double")
    return [F.sum(F.when(inner, weight * y)).alias("_wn"), F.sum(F.when(inner, y)).alias("_wd"),
            F.sum(F.when(outer, (1.0 - weight) * (1.0 - y))).alias("_dn"),
            F.sum(F.when(outer, 1.0 - y)).alias("_dd")]


def with_regional(df: DataFrame) -> DataFrame:
    """Wet recall inside, dry recall outside and their geometric mean; NULL for an empty class."""
    wet = F.when(F.col("_wd") > 0, F.col("_wn") / F.nullif(F.col("_wd"), F.lit(0.0)))
    dry = F.when(F.col("_dd") > 0, F.col("_dn") / F.nullif(F.col("_dd"), F.lit(0.0)))
    df = df.withColumns({"rec_in_wet": wet, "rec_out_dry": dry})
    g = F.when(F.col("rec_in_wet").isNotNull() & F.col("rec_out_dry").isNotNull(),
               F.sqrt(F.greatest("rec_in_wet", F.lit(0.0)) * F.greatest("rec_out_dry", F.lit(0.0))))
    return df.withColumn("g_regional", g).drop("_wn", "_wd", "_dn", "_dd")


def regional_recall(df: DataFrame, by: Sequence[str], weight: str, label: str) -> DataFrame:
    """Regional recalls; the same form serves hard, soft and expected metrics."""
    kept = df.filter(F.col(weight).isNotNull() & F.col(label).isNotNull())
    return with_regional(kept.groupBy(*by).agg(*regional_sums(
        F.col(weight).cast("double"), F.col(label), flag(F.col("ispb")), flag(F.col("ospb")))))


def point_metrics(df: DataFrame, label: str = "y", soft: bool = False, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per-model table: counts, scores, regional recalls and the number of scored cells, in one
    aggregate."""
    pred, y = F.col("pred"), F.col(label)
    weight = pred.cast("double")
    counts = soft_counts(weight, y) if soft else hard_counts(pred, y)
    aggs = [F.count(F.lit(1)).alias("n_roi"), *counts,
            *regional_sums(weight, y, flag(F.col("ispb")), flag(F.col("ospb")))]
    return with_regional(with_scores(df.groupBy(*by).agg(*aggs)))


def expected_metrics(df: DataFrame, by: Sequence[str] = ("model",), label: str = "y") -> DataFrame:
    kept = df.filter(F.col("pw").isNotNull() & F.col(label).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n_roi"), *soft_counts(F.col("pw"), F.col(label).cast("double")),
            *regional_sums(F.col("pw"), F.col(label), flag(F.col("ispb")), flag(F.col("ospb")))]
    return with_regional(with_scores(kept.groupBy(*by).agg(*aggs)))


# Spread of the heat-flow margin and decision margins -------------------------------------------

def with_sigma(df: DataFrame, scalar: str | None = None) -> DataFrame:
    """Model sigma by precedence: per cell, 95 % bounds, one number per model, zero."""
    from meltgrid.functions.physics import sigma_from_bounds

    bounds = sigma_from_bounds(F.col("bmin"), F.col("bmax"))
    fixed = F.col(scalar) if scalar else F.lit(None).cast("double")
    source = (F.when(F.col("sigma").isNotNull(), "cell").when(bounds.isNotNull(), "bounds")
              .when(fixed.isNotNull(), "scalar").otherwise("none"))
    return df.withColumns({"s_model": F.coalesce(F.col("sigma"), bounds, fixed, F.lit(0.0)),
                           "sigma_source": source})


def margin_sigma(s_model: Column, s_gmin: Column) -> Column:
    return F.sqrt(s_model * s_model + s_gmin * s_gmin)


def sigma_summary(df: DataFrame, by: Sequence[str] = ("model",), s_gmin: str | None = "s_gmin") -> DataFrame:
    """Mean and median margin sigma per model; both read spreads that are written once."""
    sg = F.col(s_gmin) if s_gmin else F.lit(0.0)
    src = cut_lineage(df.select(*by, margin_sigma(F.col("s_model"), sg).alias("_s")))
    mean = src.groupBy(*by).agg(F.avg("_s").alias("sigma_mean"))
    med = midpoint_quantile(src, "_s", {"sigma_median": 0.5}, by, store=False).drop("n")
    return mean.join(med, list(by), "left")


def suggested_margin(sigma: DataFrame) -> DataFrame:
    """Median over the non-flat models, over all models where every one is flat (a report table
    with one row per model)."""
    varied = ~is_flat(F.col("model"))

    def median(c: str) -> Column:
        return F.coalesce(F.median(F.when(varied, F.col(c))), F.median(c))

    return sigma.agg(median("sigma_mean").alias("suggested_mean"), median("sigma_median").alias("suggested_median"))


MARGIN_MODES = ("fixed", "auto_mean", "auto_median", "auto_per_model_mean", "auto_per_model_median")


def margin_table(sigma: DataFrame, mode: str = "fixed", fixed: float = 0.0) -> DataFrame:
    """One margin per model; the fixed margin fills in where no spread is known."""
    if mode not in MARGIN_MODES:
        raise ValueError(f"unknown margin mode: {mode}")
    if mode == "fixed":
        return sigma.select("model", F.lit(float(fixed)).alias("margin"))
    stat = "mean" if mode.endswith("mean") else "median"
    if mode.startswith("auto_per_model"):
        m = F.col(f"sigma_{stat}")
        return sigma.select("model", F.coalesce(m, F.lit(float(fixed))).alias("margin"))
    value = suggested_margin(sigma).first()[f"suggested_{stat}"]
    return sigma.select("model", F.lit(float(fixed if value is None else value)).alias("margin"))


def decide(df: DataFrame, margins: DataFrame | float) -> DataFrame:
    """Add ``margin`` and ``pred = gdiff >= margin``; a missing difference predicts dry."""
    if isinstance(margins, DataFrame):
        df = df.join(sized(margins), "model")
    else:
        df = df.withColumn("margin", F.lit(float(margins)))
    return df.withColumn("pred", at_least(F.col("gdiff"), F.col("margin")))


def with_p_wet(df: DataFrame, s_gmin: str | None = "s_gmin") -> DataFrame:
    sg = F.col(s_gmin) if s_gmin else F.lit(0.0)
    return df.withColumn("pw", p_wet(F.col("gdiff"), F.col("s_model"), sg, F.col("margin")))


# Threshold detectors ---------------------------------------------------------------------------

def detector_metrics(df: DataFrame) -> DataFrame:
    """Detector scores from tp, fp, tn, fn; empty classes divide by one."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def safe(num: Column, den: Column) -> Column:
        return num / F.greatest(den, F.lit(1.0))

    df = df.withColumns({
        "tpr": safe(tp, tp + fn), "fpr": safe(fp, fp + tn), "precision": safe(tp, tp + fp),
        "specificity": safe(tn, tn + fp), "f1": safe(2.0 * tp, 2.0 * tp + fp + fn),
        "mcc": (tp * tn - fp * fn) / F.sqrt(F.greatest((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn), F.lit(1.0))),
        "odds_ratio": (tp + 0.5) * (tn + 0.5) / ((fp + 0.5) * (fn + 0.5))})
    return df.withColumns({"bal_acc": 0.5 * (F.col("tpr") + F.col("specificity")),
                           "youden": F.col("tpr") - F.col("fpr")})

"""Labels from specularity and wet probabilities from heat-flow margins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from meltgrid.functions.mathx import EPS, clamp, normal_cdf


def truth_binary(q: Column, thr: Column | float) -> Column:
    """Hard label ``q > thr``; a missing observation counts as dry."""
    return F.coalesce((q > thr).cast("int"), F.lit(0))


def truth_weight(q: Column, mode: str, *, t0: float = 0.2, tmid: Column | float = 0.2,
                 k: Column | float = 20.0, p: float = 2.0) -> Column:
    """Soft label in [0, 1]; a missing observation weighs 0."""
    if mode == "logistic":
        w = 1.0 / (1.0 + F.exp(-(k * (q - tmid))))
    elif mode in ("ramp", "power"):
        w = clamp((q - t0) / max(1.0 - t0, EPS), 0.0, 1.0)
        if mode == "power":
            w = F.pow(w, F.lit(float(p)))
    else:
        raise ValueError(f"unknown truth mode: {mode}")
    return F.coalesce(w, F.lit(0.0))


def wet_prob(q: Column, kind: str, *, sc0: float, sc1: float = 1.0, k: float = 20.0,
             missing_as_dry: bool = False) -> Column:
    """Wet probability of an observation; missing stays NULL unless asked to count as dry."""
    if kind == "linear_clip":
        w = clamp((q - sc0) / max(sc1 - sc0, EPS), 0.0, 1.0)
    elif kind == "logistic":
        w = clamp(1.0 / (1.0 + F.exp(-k * (q - sc0))), 0.0, 1.0)
    else:
        raise ValueError(f"unknown weight kind: {kind}")
    return F.coalesce(w, F.lit(0.0)) if missing_as_dry else w


def p_wet(gdiff: Column, s_model: Column, s_gmin: Column, margin: Column | float) -> Column:
    """Probability that the true margin is reached: normal tail, or a step where sigma is 0."""
    s2 = s_model * s_model + s_gmin * s_gmin
    z = (gdiff - margin) / F.sqrt(F.greatest(s2, F.lit(EPS)))
    step = F.coalesce((gdiff >= margin).cast("double"), F.lit(0.0))
    return F.when(s2 == 0, step).when(s2.isNotNull(), normal_cdf(z))


def logistic_anchors(q_low: Column, q_high: Column, w_low: float, w_high: float) -> tuple[Column, Column]:
    """Slope and midpoint of the logistic through two (quantile, weight) anchors."""
    lo = max(min(w_low, 0.999), 0.001)
    hi = max(min(w_high, 0.999), 0.001)
    l1, l2 = math.log(lo / (1 - lo)), math.log(hi / (1 - hi))
    k = (l2 - l1) / F.greatest(q_high - q_low, F.lit(EPS))
    return k, q_low - l1 / F.greatest(k, F.lit(EPS))

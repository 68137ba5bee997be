"""Guarded ratios, the error function, and draws that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16

# Abramowitz and Stegun, formula 7.1.26 (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

_TWO52 = 4503599627370496.0
_TWO53 = 9007199254740992.0


def ratio(num: Column, den: Column, floor: float = EPS) -> Column:
    """``num / max(den, floor)``: an empty class scores 0 instead of raising."""
    return num / F.greatest(den.cast("double"), F.lit(floor))


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    tail = poly * F.exp(-x * x)
    return F.when(x < 0, tail - 1.0).otherwise(1.0 - tail)


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def uniform(*parts: Column | str | int, kind: str = "md5") -> Column:
    """Uniform in [0, 1) from the given key parts only.

    ``md5`` can be reproduced in any SQL engine; ``fast`` uses xxhash64 and is several times
    cheaper per draw.  Both give the same value however the rows are partitioned.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    if kind == "md5":
        key = F.concat_ws("|", *[c.cast("string") for c in cols])
        return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / _TWO52
    if kind == "fast":
        return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / _TWO53
    raise ValueError(f"unknown draw kind: {kind}")


def normal_draw(*parts: Column | str | int, kind: str = "md5") -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u1 = F.greatest(uniform(*parts, "u1", kind=kind), F.lit(1.0 / _TWO53))
    u2 = uniform(*parts, "u2", kind=kind)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def clamp(c: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    """Limit to [lo, hi]; a missing value stays missing."""
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(c.isNotNull(), out)

"""Boolean masks on cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.nulls import finite


@dataclass(frozen=True)
class MaskConfig:
    """Which cells are scored.  ``region`` is one of ALL, ISPB, OSPB, SPB."""

    v_keep: float = 10.0
    region: str = "ALL"
    gate_sinks: bool = True
    x_range: tuple[float, float] | None = None
    y_range: tuple[float, float] | None = None
    rects: tuple[tuple[float, float, float, float], ...] = ()
    rect_mode: str = "include"


def flag(c: Column) -> Column:
    """Mask column with missing read as false."""
    return F.coalesce(c, F.lit(False))


def combine(masks: Sequence[Column], how: str = "and") -> Column:
    """AND / OR of masks, missing as false."""
    flags = [flag(m) for m in masks]
    return reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), flags)


def rect_mask(x: Column, y: Column, rects: Sequence[Sequence[float]], mode: str = "include") -> Column:
    """Union of closed rectangles ``(xa, xb, ya, yb)``, corners in any order; no rectangle passes all."""
    if not rects:
        return F.lit(True)
    hits = []
    for xa, xb, ya, yb in rects:
        hits.append(x.between(min(xa, xb), max(xa, xb)) & y.between(min(ya, yb), max(ya, yb)))
    hit = combine(hits, "or")
    return ~hit if mode == "exclude" else hit


def region_mask(region: str) -> Column:
    inner, outer = flag(F.col("ispb")), flag(F.col("ospb"))
    return {"ALL": F.lit(True), "ISPB": inner, "OSPB": outer, "SPB": inner | outer}[region.upper()]


def with_masks(cells: DataFrame, cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """Add ``valid, slow, reg, viz, roi``.  ``q`` must already be cleaned; cells marked
    ``q_sentinel`` count as observed."""
    seen = finite(F.col("q"))
    if "q_sentinel" in cells.columns:
        seen = seen | flag(F.col("q_sentinel"))
    valid = seen & finite(F.col("h")) & finite(F.col("icevel"))
    slow = valid & ~flag(F.col("icevel") > cfg.v_keep)
    reg = rect_mask(F.col("x_m"), F.col("y_m"), cfg.rects, cfg.rect_mode) & region_mask(cfg.region)
    for axis, lim in (("x_m", cfg.x_range), ("y_m", cfg.y_range)):
        if lim is not None:
            reg = reg & F.col(axis).between(*lim)
    roi = slow & reg
    if cfg.gate_sinks:
        roi = roi & flag(F.col("sink"))
    return cells.withColumns({"valid": valid, "slow": slow, "reg": reg, "viz": slow & reg, "roi": roi})


def replace_where(base: Column, alt: Column, pred: Column) -> Column:
    """Take ``alt`` where the predicate holds and ``alt`` has a value."""
    return F.when(flag(pred) & finite(alt), alt).otherwise(base)


def replace_report(df: DataFrame, base: Column, alt: Column, pred: Column, cell_m2: float) -> DataFrame:
    """Number, area and share of replaced cells."""
    swapped = flag(pred) & finite(alt)
    n = F.count_if(swapped)
    known = F.count_if(finite(replace_where(base, alt, pred)))
    return df.agg(n.alias("n_replaced"), (n * (cell_m2 / 1e6)).alias("area_km2"),
                  (100.0 * n / F.greatest(known, F.lit(1))).alias("pct"))


def layer_diff(a: Column, b: Column, floor: float | None = None) -> Column:
    """``a - b``, optionally not below ``floor``; missing stays missing."""
    d = a - b
    return d if floor is None else F.when(d.isNotNull(), F.greatest(d, F.lit(float(floor))))


def sink_depth(head: Column, filled: Column) -> tuple[Column, Column]:
    """Depth of filled hollows and the mask of cells inside one."""
    depth = filled - head
    return depth, flag((depth > 0) & finite(depth))


def mask_crop(df: DataFrame, mask: Column) -> DataFrame:
    """Offsets and size of the smallest window holding the true cells."""
    return df.filter(flag(mask)).agg(
        F.min("ri").alias("r0"), F.min("ci").alias("c0"), F.max("ri").alias("r1"), F.max("ci").alias("c1"),
        F.count(F.lit(1)).alias("cells"))

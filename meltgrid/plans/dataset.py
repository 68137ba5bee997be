"""Static dataset: aligned layers, melt minimum, advection, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.nulls import SENTINEL, clean
from meltgrid.functions.physics import advection_flux, flow_dir, gdiff, gmin, sigma_gmin, topo_correct
from meltgrid.operators.grid import along_flow, gradient2d
from meltgrid.operators.masks import flag
from meltgrid.operators.models import with_flat_fields
from meltgrid.operators.ordered import trim_central
from meltgrid.session import cut_lineage

SENTINEL_LAYERS = ("q", "h", "ts", "mb", "icevel")


def clean_layers(cells: DataFrame, sentinel_as_dry: bool = False) -> DataFrame:
    """Missing values to NULL.  ``sentinel_as_dry`` marks cells whose observation is the sentinel,
    so that masks keep them as observed; without a value they are labelled dry."""
    out = cells
    if sentinel_as_dry:
        out = out.withColumn("q_sentinel", flag(F.col("q") == SENTINEL))
    return out.withColumns({c: clean(F.col(c)) for c in SENTINEL_LAYERS if c in cells.columns})


def with_flow(cells: DataFrame, step: float) -> DataFrame:
    """Add ``speed, ex, ey`` from ``vx, vy`` and the slopes ``dts, dh, dmb`` along the flow."""
    df = gradient2d(cells, ["ts", "h", "mb"], step, step)
    speed, ex, ey = flow_dir(F.col("vx"), F.col("vy"))
    df = df.withColumns({"speed": speed, "ex": ex, "ey": ey})
    df = df.withColumns({f"d{c}": along_flow(c, F.col("ex"), F.col("ey")) for c in ("ts", "h", "mb")})
    return df.drop(*[f"d{c}_{a}" for c in ("ts", "h", "mb") for a in ("dx", "dy")])


def with_advection(cells: DataFrame, step: float, f: float = 0.5, k: float = 0.333, trim: float | None = 0.95) -> DataFrame:
    """Add the advected flux ``adv`` (mW/m2) from ``vx, vy`` and the gradients of the layers."""
    df = with_flow(cells, step)
    flux = advection_flux(F.col("h"), F.col("ts"), F.col("mb"), F.col("speed"), *[F.col(c) for c in ("dts", "dh", "dmb")], f=f, k=k)
    df = df.withColumn("adv", 1000.0 * flux).drop("speed", "ex", "ey", "dts", "dh", "dmb")
    # Trimming reads the flux three times; the gradients behind it run once.
    return df if trim is None else trim_central(cut_lineage(df), "adv", trim).drop("trimmed")


def with_minimum(cells: DataFrame, spread: dict | None = None) -> DataFrame:
    """Add ``gmin`` and its spread ``s_gmin`` (zero unless input spreads are given)."""
    h, ts, mb = F.col("h"), F.col("ts"), F.col("mb")
    s = sigma_gmin(h, ts, mb, **spread) if spread else F.lit(0.0)
    return cells.withColumns({"gmin": gmin(h, ts, mb), "s_gmin": s})


def _with_margin(rows: DataFrame, topo_applied: bool) -> DataFrame:
    g = F.col("g")
    if "delta" in rows.columns:
        g = topo_correct(g, F.col("delta"), topo_applied)
    adv = F.col("adv") if "adv" in rows.columns else None
    return rows.withColumn("gdiff", gdiff(g, F.col("gmin"), adv))


def listed_rows(cells: DataFrame, models: DataFrame, key: str = "cell_id", topo_applied: bool = False) -> DataFrame:
    """(cell, model) rows of stored model fields with the margin ``gdiff``."""
    return _with_margin(cells.join(models, key), topo_applied)


def flat_rows(cells: DataFrame, models: DataFrame, flats: tuple[int, int], topo_applied: bool = False) -> DataFrame:
    """The same rows of the flat family; they are made inside the tasks that read the cells."""
    flat = with_flat_fields(cells, *flats)
    for c in ("bmin", "bmax"):
        if c in models.columns:
            flat = flat.withColumn(c, F.lit(None).cast("double"))
    return _with_margin(flat, topo_applied)


def model_rows(cells: DataFrame, models: DataFrame, flats: tuple[int, int] | None = (20, 80), key: str = "cell_id",
               topo_applied: bool = False) -> DataFrame:
    """(cell, model) rows of stored and flat models with the margin ``gdiff``."""
    rows = listed_rows(cells, models, key, topo_applied)
    if flats is None:
        return rows
    return rows.unionByName(flat_rows(cells, models, flats, topo_applied).select(*rows.columns))

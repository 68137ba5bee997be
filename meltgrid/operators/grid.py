"""Cells keyed by (ri, ci): layer alignment, regridding, neighbours, gradients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meltgrid.session import sized

KEYS = ("ri", "ci")
TILE = 512


def cell_grid(spark: SparkSession, x0: float, x1: float, y0: float, y1: float, step: float) -> DataFrame:
    """Regular grid with both ends included; rows follow y, columns follow x."""
    nx, ny = round((x1 - x0) / step) + 1, round((y1 - y0) / step) + 1
    ri, ci = F.expr(f"cast(id div {nx} as int)"), F.expr(f"cast(id % {nx} as int)")
    return spark.range(nx * ny).select(
        F.col("id").alias("cell_id"), ri.alias("ri"), ci.alias("ci"),
        (x0 + step * ci).alias("x_m"), (y0 + step * ri).alias("y_m"))


def extents(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("cells"), F.min("ri").alias("r0"), F.max("ri").alias("r1"),
                  F.min("ci").alias("c0"), F.max("ci").alias("c1"))


def layer_extents(layers: Mapping[str, DataFrame]) -> DataFrame:
    """One row of extents per layer, from one job."""
    parts = [extents(df).withColumn("layer", F.lit(name)) for name, df in layers.items()]
    return reduce(DataFrame.unionByName, parts).select("layer", "cells", "r0", "r1", "c0", "c1")


def stack_layers(layers: Mapping[str, DataFrame], optional: Mapping[str, DataFrame | None] | None = None,
                 check: bool = True) -> DataFrame:
    """Align layers ``(ri, ci, <value>)`` cell by cell; a size mismatch is an error, never a resize.

    Optional layers add a nullable column and may be absent altogether.
    """
    if check:
        rows = layer_extents(layers).collect()
        if len({tuple(r)[1:] for r in rows}) > 1:
            raise ValueError("layer extents differ: " + "; ".join(str(r.asDict()) for r in rows))

    def value(df: DataFrame, name: str) -> DataFrame:
        (v,) = [c for c in df.columns if c not in KEYS]
        return df.select(*KEYS, F.col(v).alias(name))

    out = reduce(lambda a, b: a.join(b, list(KEYS)), [value(df, n) for n, df in layers.items()])
    for name, df in (optional or {}).items():
        out = (out.withColumn(name, F.lit(None).cast("double")) if df is None
               else out.join(value(df, name), list(KEYS), "left"))
    return out


def transpose(df: DataFrame) -> DataFrame:
    return df.withColumns({"ri": F.col("ci"), "ci": F.col("ri")})


def align(a: DataFrame, b: DataFrame, transposed: bool = False) -> DataFrame:
    """Equi-join on the cell; ``transposed`` swaps the right side's axes first."""
    return a.join(transpose(b) if transposed else b, list(KEYS))


def to_single(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in cols})


def with_km(df: DataFrame) -> DataFrame:
    return df.withColumns({"x_km": F.col("x_m") / 1000.0, "y_km": F.col("y_m") / 1000.0})


def downsample(df: DataFrame, k: int = 8) -> DataFrame:
    """Every k-th row and column, counting from the first."""
    return df.filter((F.col("ri") % k == 0) & (F.col("ci") % k == 0))


def expand_mask(crop: DataFrame, grid: DataFrame, r0: int, c0: int, name: str = "mask") -> DataFrame:
    """Place the true cells of a cropped mask on the full grid."""
    placed = crop.select((F.col("ri") + r0).alias("ri"), (F.col("ci") + c0).alias("ci"),
                         F.lit(True).alias(name)).distinct()
    return grid.join(placed, list(KEYS), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def resize_nearest(mask: DataFrame, grid: DataFrame, shape: tuple[int, int], target: tuple[int, int],
                   name: str = "mask") -> DataFrame:
    """Read a mask of another size at the source pixel under each target centre."""
    def source(index: str, n: int, m: int) -> Column:
        return F.floor((F.col(index) + 0.5) * n / m).cast("int")

    src = mask.select(F.col("ri").alias("_sr"), F.col("ci").alias("_sc"), name)
    out = grid.withColumns({"_sr": source("ri", shape[0], target[0]), "_sc": source("ci", shape[1], target[1])})
    return out.join(src, ["_sr", "_sc"], "left").drop("_sr", "_sc")


def regrid_bilinear(src: DataFrame, target: DataFrame, *, x0: float, dx: float, nx: int, y0: float,
                    dy: float, ny: int, extrap: str = "none", value: str = "z",
                    name: str = "z_interp") -> DataFrame:
    """Raster ``(ix, iy, value)`` read at target ``x_m, y_m``.

    The source is packed once into 2 x 2 blocks, so the large target side is joined a single
    time.  A missing corner gives a missing result; outside is missing or the nearest edge.
    """
    off = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    spread = src.select("ix", "iy", F.col(value).alias("_z"), off.alias("o"))
    packed = spread.groupBy((F.col("ix") - F.col("o.a")).alias("_i"), (F.col("iy") - F.col("o.b")).alias("_j")).agg(
        *[F.max(F.when((F.col("o.a") == a) & (F.col("o.b") == b), F.col("_z"))).alias(f"_z{a}{b}")
          for a in (0, 1) for b in (0, 1)])
    fx, fy = (F.col("x_m") - x0) / dx, (F.col("y_m") - y0) / dy
    inside = fx.between(0, nx - 1) & fy.between(0, ny - 1)
    if extrap == "nearest":
        fx = F.least(F.greatest(fx, F.lit(0.0)), F.lit(float(nx - 1)))
        fy = F.least(F.greatest(fy, F.lit(0.0)), F.lit(float(ny - 1)))
    elif extrap != "none":
        raise ValueError(f"unknown extrapolation: {extrap}")
    base = target.withColumns({"_fx": fx, "_fy": fy})
    base = base.withColumns({
        "_ok": F.lit(True) if extrap == "nearest" else inside,
    })
    # Outside there is no key: such cells meet no block, and no edge block gathers them.
    base = base.withColumns({
        "_i": F.when(F.col("_ok"), F.least(F.greatest(F.floor("_fx"), F.lit(0)), F.lit(nx - 2)).cast("int")),
        "_j": F.when(F.col("_ok"), F.least(F.greatest(F.floor("_fy"), F.lit(0)), F.lit(ny - 2)).cast("int"))})
    u, v = F.col("_fx") - F.col("_i"), F.col("_fy") - F.col("_j")
    low = F.col("_z00") * (1.0 - u) + F.col("_z10") * u
    high = F.col("_z01") * (1.0 - u) + F.col("_z11") * u
    out = base.join(packed, ["_i", "_j"], "left").withColumn(
        name, F.when(F.col("_ok"), low * (1.0 - v) + high * v))
    return out.drop("_i", "_j", "_fx", "_fy", "_ok", "_z00", "_z10", "_z01", "_z11")


def regrid_nearest(src: DataFrame, target: DataFrame, *, x0: float, dx: float, y0: float, dy: float,
                   value: str = "z", name: str = "z_nearest") -> DataFrame:
    """Value of the nearest source pixel; outside the source there is none."""
    near = src.select(F.col("ix").alias("_i"), F.col("iy").alias("_j"), F.col(value).alias(name))
    return (target.withColumns({"_i": F.round((F.col("x_m") - x0) / dx).cast("int"),
                                "_j": F.round((F.col("y_m") - y0) / dy).cast("int")})
            .join(near, ["_i", "_j"], "left").drop("_i", "_j"))


HALF_OFFSETS = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, 0), (1, 1), (1, -1))}


def neighbours(cells: DataFrame, conn: int = 8) -> DataFrame:
    """Each adjacent pair of cells once, as ``(ri, ci, ri2, ci2)``."""
    off = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in HALF_OFFSETS[conn]])
    left = cells.select("ri", "ci", F.explode(off).alias("o"))
    left = left.select("ri", "ci", (F.col("ri") + F.col("o.dr")).alias("ri2"), (F.col("ci") + F.col("o.dc")).alias("ci2"))
    return left.join(cells.select(F.col("ri").alias("ri2"), F.col("ci").alias("ci2")), ["ri2", "ci2"]).select(
        "ri", "ci", "ri2", "ci2")


def gradient2d(df: DataFrame, cols: Sequence[str], dx: float, dy: float,
               bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Add ``d<col>_dx`` and ``d<col>_dy``: central inside, one-sided on the outer index only.

    A missing neighbour makes the derivative missing.  Cells are shuffled once, into square tiles
    that also receive a one-cell rim; both window directions then run inside the tiles.
    """
    if bounds is None:
        e = extents(df).first()
        bounds = (e["r0"], e["r1"], e["c0"], e["c1"])
    r0, r1, c0, c1 = bounds
    ri, ci = F.col("ri").cast("long"), F.col("ci").cast("long")

    def tile_of(r: Column, c: Column) -> Column:
        return F.shiftleft(F.floor(r / TILE), 31) + F.floor(c / TILE)

    around = F.array_distinct(F.array(*[tile_of(ri + a, ci + b) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]))
    tiled = df.withColumn("_tile", F.explode(around)).repartition("_tile")
    new = {}
    for line, along, lo, hi, d, tag in (("ri", "ci", c0, c1, dx, "dx"), ("ci", "ri", r0, r1, dy, "dy")):
        w = Window.partitionBy("_tile", line).orderBy(along)
        i = F.col(along)
        prev_ok, next_ok = F.lag(along).over(w) == i - 1, F.lead(along).over(w) == i + 1
        for c in cols:
            prev, nxt = F.when(prev_ok, F.lag(c).over(w)), F.when(next_ok, F.lead(c).over(w))
            new[f"d{c}_{tag}"] = (F.when(i == lo, (nxt - F.col(c)) / d).when(i == hi, (F.col(c) - prev) / d)
                                  .otherwise((nxt - prev) / (2.0 * d)))
    return tiled.withColumns(new).filter(F.col("_tile") == tile_of(ri, ci)).drop("_tile")


def along_flow(col: str, ex: Column, ey: Column) -> Column:
    """Projection of the gradient columns of ``col`` on a unit direction."""
    return F.col(f"d{col}_dx") * ex + F.col(f"d{col}_dy") * ey


def export_extent(df: DataFrame, step: float) -> DataFrame:
    """World limits of the grid: cell centres widened by half a cell."""
    half = step / 2.0
    return df.agg((F.min("x_m") - half).alias("x_lo"), (F.max("x_m") + half).alias("x_hi"),
                  (F.min("y_m") - half).alias("y_lo"), (F.max("y_m") + half).alias("y_hi"),
                  F.count(F.lit(1)).alias("cells"))


def index_bounds(df: DataFrame, axis: str) -> DataFrame:
    """Length and direction of an axis table ``(i, <axis>)``."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  (F.max_by(axis, "i") >= F.min_by(axis, "i")).alias("ascending"))


def raster_to_cells(rows: DataFrame, x_axis: DataFrame, y_axis: DataFrame, transposed: bool = False) -> DataFrame:
    """Array-per-line raster to ``(ix, iy, x_m, y_m, z)`` with both axes ascending.

    ``rows(i, values)`` holds one array per stored line; ``x_axis(i, x_m)`` and ``y_axis(i, y_m)``
    give coordinates.  Values beyond an axis are clipped by the join.
    """
    flat = rows.select(F.col("i").alias("_line"), F.posexplode("values").alias("_pos", "z"))
    line, pos = ("_pos", "_line") if transposed else ("_line", "_pos")

    def normal(axis: DataFrame, coord: str, key: str, name: str) -> DataFrame:
        b = index_bounds(axis, coord).first()
        i = F.col("i") if b["ascending"] else F.lit(b["n"] - 1) - F.col("i")
        return sized(axis.select(F.col("i").cast("int").alias(key), i.cast("int").alias(name), coord))

    return (flat.join(normal(x_axis, "x_m", pos, "ix"), pos)
            .join(normal(y_axis, "y_m", line, "iy"), line)
            .select("ix", "iy", "x_m", "y_m", "z"))

"""Polygons and scattered points against grid cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meltgrid.functions.nulls import finite
from meltgrid.session import sized


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """Directed edges of closed rings.  ``polygons(region[, part], seq, x_m, y_m)``; a vertex
    without coordinates separates rings of the same part."""
    df = polygons if "part" in polygons.columns else polygons.withColumn("part", F.lit(0))
    w = Window.partitionBy("region", "part").orderBy("seq")
    gap = (~(finite(F.col("x_m")) & finite(F.col("y_m")))).cast("int")
    df = df.withColumn("ring", F.sum(gap).over(w)).filter(finite(F.col("x_m")) & finite(F.col("y_m")))
    ring = Window.partitionBy("region", "part", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select("region", "part", "ring", F.col("x_m").alias("x1"), F.col("y_m").alias("y1"),
                     F.coalesce(F.lead("x_m").over(ring), F.first("x_m").over(whole)).alias("x2"),
                     F.coalesce(F.lead("y_m").over(ring), F.first("y_m").over(whole)).alias("y2"))


def _packed_bands(polygons: DataFrame, band: float, rings: str) -> DataFrame:
    """``(_band, _shapes)``: per height band every shape's region, edges and x range in one row.

    ``rings="union"`` makes a shape of every ring; ``"parity"`` makes one of all rings of a part,
    so a ring inside another is a hole.
    """
    shape = {"union": ["region", "part", "ring"], "parity": ["region", "part"]}[rings]
    edges = polygon_edges(polygons)
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    spread = edges.withColumn("_band", F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band))))
    flat = sized(spread)
    shapes = flat.groupBy("_band", *shape).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    box = edges.groupBy(*shape).agg(
        F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"))
    packed = shapes.join(box, shape).groupBy("_band").agg(
        F.collect_list(F.struct("region", "edges", "x0", "x9")).alias("_shapes"))
    # Packing keeps the number of edges, so the size proven for the flat edges holds for it.
    return packed if flat is spread else F.broadcast(packed)


def _regions_at(points: DataFrame, polygons: DataFrame, band: float, rings: str) -> DataFrame:
    """Points with ``_regions``, the regions they are inside or on; nothing is multiplied."""
    x, y = F.col("x_m"), F.col("y_m")

    def crosses(e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.coalesce(spans & (x < at), F.lit(False))

    def touches(e):
        side = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        return ((side == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    def holds(shape):
        odd = F.size(F.filter(shape["edges"], crosses)) % 2 == 1
        return x.between(shape["x0"], shape["x9"]) & (odd | F.exists(shape["edges"], touches))

    near = points.withColumn("_band", F.floor(F.col("y_m") / band))
    out = near.join(_packed_bands(polygons, band, rings), "_band", "left")
    hit = F.array_distinct(F.transform(F.filter("_shapes", holds), lambda s: s["region"]))
    return out.withColumn("_regions", F.coalesce(hit, F.array())).drop("_band", "_shapes")


def points_in_polygons(points: DataFrame, polygons: DataFrame, band: float, key: Sequence[str],
                       rings: str = "union") -> DataFrame:
    """``(key..., region)`` for every point inside or on a region; parts are united.

    Rings of one part are united as well, or count by parity (``rings``), so that inner rings are
    holes.  Edges are packed per height band, so a point meets only the edges at its own height
    through an equi-join and the crossings are counted inside the row: the large side is neither
    paired with all edges nor shuffled for the count.
    """
    at = _regions_at(points.select(*key, "x_m", "y_m"), polygons, band, rings)
    return at.select(*key, F.explode("_regions").alias("region"))


def region_columns(points: DataFrame, polygons: DataFrame, regions: Sequence[str], band: float,
                   key: Sequence[str], rings: str = "union") -> DataFrame:
    """One boolean column per region on the points, computed inside each row."""
    out = _regions_at(points, polygons, band, rings)
    return out.withColumns({f"in_{r.lower()}": F.array_contains("_regions", r) for r in regions}).drop("_regions")


def coverage(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points inside the target box and their share."""
    x0, x1, y0, y1 = box
    inside = F.coalesce(F.col("x_m").between(x0, x1) & F.col("y_m").between(y0, y1), F.lit(False))
    return points.agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_in"),
                      (100.0 * F.avg(inside.cast("double"))).alias("pct_in"))


def interp_points(points: DataFrame, targets: DataFrame, *, step: float, radius: float, k: int = 4,
                  value: str = "z", order: str = "pid") -> DataFrame:
    """Inverse-distance mean of the ``k`` nearest points within ``radius`` of each grid cell.

    Points at one place keep the first by ``order``.  Every point is sent to the grid cells it can
    reach, a number fixed by radius and spacing, so the work is linear in the points however
    densely they cluster, and Spark cuts each cell to its best ``k`` before the shuffle.
    """
    from meltgrid.operators.models import stable_unique

    pts = points.filter(finite(F.col("x_m")) & finite(F.col("y_m")) & finite(F.col(value)))
    pts = stable_unique(pts.select("x_m", "y_m", F.col(order).alias("_o"), F.col(value).alias("_z")),
                        ["x_m", "y_m"], ["_o"])
    n = math.ceil(radius / step)
    span = F.sequence(F.lit(-n), F.lit(n))
    near = pts.select("x_m", "y_m", "_o", "_z", F.explode(span).alias("_dr")).select(
        "*", F.explode(span).alias("_dc"))
    near = near.select("_o", "_z", "x_m", "y_m",
                       (F.round(F.col("y_m") / step) + F.col("_dr")).cast("int").alias("ri"),
                       (F.round(F.col("x_m") / step) + F.col("_dc")).cast("int").alias("ci"))
    gx, gy = F.col("ci") * step - F.col("x_m"), F.col("ri") * step - F.col("y_m")
    near = near.withColumn("_d2", gx * gx + gy * gy).filter(F.col("_d2") <= radius * radius)
    w = Window.partitionBy("ri", "ci").orderBy("_d2", "_o")
    best = near.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    weight = 1.0 / F.greatest(F.col("_d2"), F.lit(1e-6))
    mean = best.groupBy("ri", "ci").agg((F.sum(F.col("_z") * weight) / F.sum(weight)).alias("z_interp"),
                                        F.count(F.lit(1)).alias("n_near"))
    return targets.join(mean, ["ri", "ci"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))

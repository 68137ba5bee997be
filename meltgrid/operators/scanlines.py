"""Polygons as column intervals of grid rows.

The crossings of all rings with a grid row are found once for the row, not once for each of its cells.  Sorted, they
pair up to the intervals inside a shape.  Cells meet the intervals of their own row and tile, so a cell tests
the few that reach into its tile and no edge at all, but for the edges it may lie on exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meltgrid.operators.spatial import polygon_edges

SHAPES = {"union": ["region", "part", "ring"], "parity": ["region", "part"]}


def row_spans(rows: DataFrame, polygons: DataFrame, band: float, rings: str = "union") -> DataFrame:
    """``(region, y_m, lo, hi, edge)`` for the distinct heights ``rows(y_m)``.

    Without an edge, ``lo <= x < hi`` is inside.  With one, places from ``lo`` to ``hi`` may lie on that edge.
    """
    shape = SHAPES[rings]
    edges = polygon_edges(polygons)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    spread = edges.withColumn("_band", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    y = F.col("y_m")
    met = (spread.join(rows.withColumn("_band", F.floor(y / band)), "_band")
           .filter((low <= y) & (y <= high)).drop("_band"))
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    met = met.withColumn("_at", at)
    line = Window.partitionBy(*shape, "y_m").orderBy("_at")
    edge = F.struct("x1", "y1", "x2", "y2")
    pairs = (met.filter((F.col("y1") > y) != (F.col("y2") > y))
             .withColumns({"_n": F.row_number().over(line), "hi": F.lead("_at").over(line)})
             .filter((F.col("_n") % 2 == 1) & (F.col("_at") < F.col("hi")))
             .select("region", "y_m", F.col("_at").alias("lo"), "hi",
                     F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double>").alias("edge")))
    # A little room on both sides, as the crossing is rounded; level edges reach from end to end.
    room = 1e-9 * (F.abs("x1") + F.abs("x2") + 1.0)
    on = met.select("region", "y_m", (F.coalesce("_at", F.least("x1", "x2")) - room).alias("lo"),
                    (F.coalesce("_at", F.greatest("x1", "x2")) + room).alias("hi"), edge.alias("edge"))
    return pairs.unionByName(on)


def cells_in_spans(cells: DataFrame, polygons: DataFrame, *, band: float, tile: float, key: Sequence[str],
                   rings: str = "union") -> DataFrame:
    """``(key..., region)`` for every cell inside or on a region, as ``spatial.points_in_polygons`` gives it.

    Meant for cells on grid rows (few heights for many cells); other points are served as well, each as a row of its
    own.  Intervals are cut at tiles of ``tile`` metres; within one, equal parts of a region count once.
    """
    at = cells.select(*key, "x_m", "y_m").withColumn("_tile", F.floor(F.col("x_m") / tile))
    spans = row_spans(cells.select("y_m").filter(F.col("y_m").isNotNull()).distinct(), polygons, band, rings)
    parts = spans.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor(F.col("hi") / tile))))
    start = F.col("_tile") * F.lit(float(tile))
    whole = F.col("edge").isNull()
    parts = parts.withColumns({"lo": F.when(whole, F.greatest("lo", start)).otherwise(F.col("lo")),
                               "hi": F.when(whole, F.least("hi", start + float(tile))).otherwise(F.col("hi"))})
    packed = parts.groupBy("y_m", "_tile").agg(F.collect_set(F.struct("region", "lo", "hi", "edge")).alias("_spans"))
    x, y = F.col("x_m"), F.col("y_m")

    def holds(s):
        e = s["edge"]
        side = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        touches = ((side == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                   & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
        return F.when(e.isNull(), (s["lo"] <= x) & (x < s["hi"])).otherwise(touches)

    hit = F.array_distinct(F.transform(F.filter("_spans", holds), lambda s: s["region"]))
    return at.join(packed, ["y_m", "_tile"]).select(*key, F.explode(hit).alias("region"))

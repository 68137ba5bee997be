"""Connected regions of a mask and tables per region.

The grid is cut into square tiles.  A task labels the regions inside a tile; only regions that touch
a tile border take part in the graph rounds, and only touching border cells of two tiles are edges,
so the graph grows with the borders and not with the cells.  Each round hooks every region to its
smallest neighbouring region, flattens the hooks by pointer jumping and contracts the edges, so the
edge table shrinks geometrically.  Between rounds the lineage is cut by a written table.  Cells meet
the result through the region of their own tile, so no key holds more than a tile's runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.nulls import finite
from meltgrid.operators.masks import flag
from meltgrid.operators.ordered import GROUP_ROWS, midpoint_quantile, prefix_sums
from meltgrid.session import cut_lineage, sized, spread

#: Cells along the side of a tile.
TILE = 512
_SHIFT = 31
_AREA_SHIFT = 55
_LOCAL = "area int, ri int, start int, stop int, region long, wet boolean, border boolean"


def _hooked(n: int, a, b):
    """Smallest node that each of n nodes reaches through the edges a-b."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def tile_regions(cells: DataFrame, conn: int = 8, tile: int = TILE) -> DataFrame:
    """Horizontal runs of the cells ``(area, ri, ci, wet)`` of every tile, with their region inside the tile.

    A region's number is that of its first cell by column and row, led by the area; ``wet`` tells whether a run holds
    a wet cell and ``border`` whether it touches the tile's border.
    """
    reach = {4: 0, 8: 1}[conn]

    def label(key, table):
        import numpy as np
        import pyarrow as pa

        area, top, left = (k.as_py() for k in key)
        ri, ci = (table.column(c).to_numpy().astype("int64") for c in ("ri", "ci"))
        wet = table.column("wet").to_numpy()
        width = tile + 4
        place, where = np.unique((ri - top * tile) * width + ci - left * tile + 2, return_inverse=True)
        hit = np.zeros(len(place), dtype=bool)
        np.logical_or.at(hit, where, wet)
        head = np.flatnonzero(np.append(True, np.diff(place) != 1))
        start, stop = place[head], place[np.append(head[1:], len(place)) - 1]
        # Runs of the next row that overlap, by the row's own stretch of places.
        low = np.searchsorted(stop, start + width - reach)
        high = np.searchsorted(start, stop + width + reach, "right")
        count = np.maximum(high - low, 0)
        a = np.repeat(np.arange(len(head)), count)
        b = low[a] + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        row, first, last = start // width + top * tile, start % width - 2 + left * tile, stop % width - 2 + left * tile
        root = _hooked(len(head), a, b)
        number = (first << _SHIFT) + row + (area << _AREA_SHIFT)
        least = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(least, root, number)
        edge = ((row == top * tile) | (row == (top + 1) * tile - 1) | (first == left * tile)
                | (last == (left + 1) * tile - 1))
        return pa.table({"area": pa.array(np.full(len(head), area), pa.int32()), "ri": pa.array(row, pa.int32()),
                         "start": pa.array(first, pa.int32()), "stop": pa.array(last, pa.int32()), "region": least[root],
                         "wet": np.logical_or.reduceat(hit, head), "border": edge})

    at = [F.floor(F.col(c) / tile).cast("long").alias(n) for c, n in (("ri", "_top"), ("ci", "_left"))]
    return cells.select("area", "ri", "ci", "wet", *at).groupBy("area", "_top", "_left").applyInArrow(label, _LOCAL)


def border_edges(runs: DataFrame, conn: int = 8, tile: int = TILE) -> DataFrame:
    """Touching regions ``(a, b)`` of neighbouring tiles."""
    cells = runs.filter("border").select("area", "ri", F.explode(F.sequence("start", "stop")).alias("ci"), "region")
    r, c = F.pmod(F.col("ri"), F.lit(tile)), F.pmod(F.col("ci"), F.lit(tile))
    cells = cells.filter((r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if conn == 8 else [])
    near = F.explode(F.array(*[F.struct((F.col("ri") + i).alias("ri"), (F.col("ci") + j).alias("ci")) for i, j in steps]))
    reach = cells.select("area", F.col("region").alias("a"), "ri", "ci", near.alias("n"))

    def tile_of(ri: str, ci: str) -> Column:
        return F.struct(F.floor(F.col(ri) / tile), F.floor(F.col(ci) / tile))

    other = reach.filter(tile_of("ri", "ci") != tile_of("n.ri", "n.ci")).select("area", "a", "n.ri", "n.ci")
    return other.join(cells.withColumnRenamed("region", "b"), ["area", "ri", "ci"]).select("a", "b").distinct()


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)`` with the smallest node of each region as root.  ``edges(a, b)``.

    A round of many edges is joined by shuffle, so that the driver never holds its nodes.
    """
    def tidy(e: DataFrame) -> DataFrame:
        big, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        return e.filter("a <> b").select(big, low).distinct()

    e = cut_lineage(tidy(edges))
    maps = []
    while rows := e.count():  # every round hooks each region that has a smaller neighbour, so the edges run out
        hook = cut_lineage(e.groupBy("a").agg(F.min("b").alias("p")))
        while True:
            up = spread(hook.select(F.col("a").alias("p"), F.col("p").alias("pp")), rows)
            jump = cut_lineage(hook.join(up, "p", "left").select("a", "p", F.coalesce("pp", "p").alias("np")))
            moved = not jump.filter("p <> np").isEmpty()
            hook = jump.select("a", F.col("np").alias("p"))
            if not moved:
                break
        maps.append(spread(hook.select(F.col("a").alias("root"), F.col("p").alias("_p")), rows))
        ma = spread(hook.withColumnRenamed("p", "pa"), rows)
        mb = spread(hook.select(F.col("a").alias("b"), F.col("p").alias("pb")), rows)
        e = e.join(ma, "a", "left").join(mb, "b", "left").select(
            F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        e = cut_lineage(tidy(e))
    out = nodes.select("node", F.col("node").alias("root"))
    for step in maps:
        out = out.join(step, "root", "left").select("node", F.coalesce("_p", "root").alias("root"))
    return out


def _regions(cells: DataFrame, conn: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Runs of the cells, and ``(region, root, cells, wet)`` of the regions inside tiles."""
    runs = cut_lineage(tile_regions(cells, conn, tile))
    local = runs.groupBy("region").agg(F.sum(F.col("stop") - F.col("start") + 1).alias("cells"), F.bool_or("wet").alias("wet"))
    edges = cut_lineage(border_edges(runs, conn, tile))
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = cut_lineage(graph_components(ends, edges).withColumnRenamed("node", "region"))
    return runs, cut_lineage(local.join(roots, "region", "left").withColumn("root", F.coalesce("root", "region")))


def connected_components(mask: DataFrame, conn: int = 8, min_size: int = 1, group_rows: int = GROUP_ROWS,
                         tile: int = TILE) -> DataFrame:
    """``(ri, ci, comp_id)`` of the true cells in regions of at least ``min_size`` cells.

    Regions are numbered from 1 in column-major order of their first cell, among those kept.
    """
    runs, local = _regions(mask.select(F.lit(0).alias("area"), "ri", "ci", F.lit(False).alias("wet")), conn, tile)
    # The root is the smallest number of a region's parts, so that of its first cell.
    kept = local.groupBy("root").agg(F.sum("cells").alias("cells")).filter(F.col("cells") >= min_size)
    ids = prefix_sums(kept.withColumn("one", F.lit(1)), [], "root", ["one"], group_rows)
    ids = local.join(ids.select("root", F.col("cum_one").cast("long").alias("comp_id")), "root").select("region", "comp_id")
    return runs.join(sized(cut_lineage(ids)), "region").select("ri", F.explode(F.sequence("start", "stop")).alias("ci"), "comp_id")


def component_sizes(members: DataFrame, warn_below: int = 50) -> DataFrame:
    """Distribution of region sizes, with a flag when regions are too few for stable intervals."""
    sizes = members.filter("comp_id > 0").groupBy("comp_id").agg(F.count(F.lit(1)).alias("cells"))
    ps = {"min": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "p90": 0.90, "p95": 0.95, "max": 1.0}
    out = midpoint_quantile(sizes, "cells", ps).withColumnRenamed("n", "n_comp")
    return out.withColumn("too_few", F.col("n_comp") < warn_below)


def component_wet(members: DataFrame, label: str = "y") -> DataFrame:
    """Cells of regions holding at least one wet cell are marked wet."""
    wet = members.groupBy("comp_id").agg(F.coalesce(F.bool_or(F.col(label) == 1), F.lit(False)).alias("wet_comp"))
    return members.join(sized(cut_lineage(wet)), "comp_id")


def component_records(members: DataFrame, cell_km2: float, step: float, label: str = "y") -> DataFrame:
    """One row per region: centroid snapped to the grid, wet flag, cells and area."""
    rec = members.groupBy("comp_id").agg(
        F.avg("ri").alias("_r"), F.avg("ci").alias("_c"), F.count(F.lit(1)).alias("cells"),
        F.coalesce(F.bool_or(F.col(label) == 1), F.lit(False)).alias("is_wet"))
    return rec.select("comp_id", (F.round("_c") * step).alias("cx_m"), (F.round("_r") * step).alias("cy_m"), "is_wet",
                      F.when(F.col("is_wet"), "WET").otherwise("DRY").alias("state"), "cells",
                      (F.col("cells") * cell_km2).alias("area_km2"))


def region_stats(members: DataFrame, regions: dict[str, Column], cell_km2: float, label: str = "y",
                 conn: int = 8, tile: int = TILE) -> DataFrame:
    """Cells, regions, mean area and wet share per (overlapping) report area.

    Regions are labelled again inside each area, so one that an area's border cuts in two counts
    twice there.  All areas share one graph whose region numbers start with the area; runs carry the counts.
    """
    areas = list(regions)
    tags = F.array_compact(F.array(*[F.when(flag(m), F.lit(i)) for i, m in enumerate(regions.values())]))
    cells = members.filter(finite(F.col(label).cast("double"))).select(
        F.explode(tags).alias("area"), "ri", "ci", (F.col(label) == 1).alias("wet"))
    _, local = _regions(cells, conn, tile)
    area = F.shiftright("root", _AREA_SHIFT).cast("int").alias("_area")
    comps = local.groupBy(area, "root").agg(F.sum("cells").alias("_n"), F.bool_or("wet").alias("_wet"))
    name = F.element_at(F.array(*[F.lit(a) for a in areas]), F.col("_area") + 1).alias("region")
    out = comps.groupBy(name).agg(
        F.sum("_n").cast("long").alias("cells"), F.count(F.lit(1)).alias("comps"), (F.avg("_n") * cell_km2).alias("mean_km2"),
        (100.0 * F.avg(F.col("_wet").cast("double"))).alias("pct_wet"))
    return out.withColumn("pct_dry", 100.0 - F.col("pct_wet"))


def members_of(cells: DataFrame, components: DataFrame) -> DataFrame:
    """Scored cells inside a region, with its number."""
    return cells.join(components.filter("comp_id > 0"), ["ri", "ci"])

"""Linear interpolation between scattered points, tile by tile.

The triangle of the Delaunay triangulation that holds a place is the cheapest way to write the place as a weighted
mean of points, when a point costs its squared distance from any fixed origin: a linear programme with three weights.
So no triangulation is stored.  All cells of a tile improve their triangles together, by the point that lies deepest in
each one's circle, until no circle holds a point of the tile or its rim.

A triangle counts only if its circle lies inside the tile and its rim.  Then it is empty of all points there are, so
every tile that meets the triangle accepts the same one and borders do not show.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meltgrid.functions.nulls import finite
from meltgrid.operators.models import stable_unique

#: Places times points that one step looks at.
_MATRIX = 4_000_000
#: Points on one circle are told apart by this much, the same for a point in every tile.
_TIE = 1e-11
_STEPS = 2_000


def _jitter(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each place, from its coordinates alone."""
    h = (x + 0.0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (y + 0.0).view(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(float) / 2.0**53


def _shares(x, y, at_x, at_y):
    """Weights of three corners (rows of x, y) at one place for each row, and twice the signed area."""
    area = (x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (x[:, 2] - x[:, 0]) * (y[:, 1] - y[:, 0])
    dx, dy = at_x - x[:, 0], at_y - y[:, 0]
    b = (dx * (y[:, 2] - y[:, 0]) - (x[:, 2] - x[:, 0]) * dy) / area
    c = ((x[:, 1] - x[:, 0]) * dy - dx * (y[:, 1] - y[:, 0])) / area
    return np.stack([1 - b - c, b, c], axis=1), area


def _gap(x, y, cost, px, py, own):
    """For each row of corners and each point: the point's cost less that of the plane through the corners."""
    area = _shares(x, y, x[:, 0], y[:, 0])[1]
    c1, c2 = cost[:, 1] - cost[:, 0], cost[:, 2] - cost[:, 0]
    a = (c1 * (y[:, 2] - y[:, 0]) - c2 * (y[:, 1] - y[:, 0])) / area
    b = ((x[:, 1] - x[:, 0]) * c2 - (x[:, 2] - x[:, 0]) * c1) / area
    return own[None, :] - (cost[:, 0] - a * x[:, 0] - b * y[:, 0])[:, None] - np.outer(a, px) - np.outer(b, py)


def triangles_at(px, py, height, qx, qy) -> np.ndarray:
    """Corners (as point numbers) of the triangle that holds each place, -1 outside the hull; all in about [-1, 1]."""
    n = len(px)
    corners = np.full((len(qx), 3), -1)
    if n < 3 or not len(qx):
        return corners
    # A place on an edge is judged a little inwards, towards a mean of the points that lies on no edge.
    pull = 1 + _jitter(py, px)
    pull /= pull.sum()
    qx, qy = qx + 1e-8 * (px @ pull - qx), qy + 1e-8 * (py @ pull - qy)
    # Three far corners hold every place; a place that cannot do without them is outside.
    x = np.append(px, [-20.0, 20.0, 0.3])
    y = np.append(py, [-19.0, -18.0, 21.0])
    cost = np.append(height, np.zeros(3))
    far = np.append(np.zeros(n), np.ones(3))
    for lo in range(0, len(qx), max(1, _MATRIX // n)):
        some = np.arange(lo, min(len(qx), lo + max(1, _MATRIX // n)))
        tri = np.tile(np.arange(n, n + 3), (len(some), 1))
        busy = np.arange(len(some))
        for _ in range(_STEPS):
            if not len(busy):
                break
            t = tri[busy]
            tx, ty = x[t], y[t]
            held = far[t].any(axis=1)
            gap = np.empty((len(busy), n))
            for flag, price, own in ((True, far, far[:n]), (False, cost, height)):
                i = np.flatnonzero(held == flag)
                if len(i):
                    gap[i] = _gap(tx[i], ty[i], price[t[i]], px, py, own)
            # Corners cost what their plane says; rounding must not let them enter again.
            row, col = np.nonzero(t < n)
            gap[row, t[row, col]] = 0
            best = gap.argmin(axis=1)
            go = gap[np.arange(len(busy)), best] < -1e-14
            if not go.any():
                busy = busy[:0]
                break
            busy, best, t, tx, ty = busy[go], best[go], t[go], tx[go], ty[go]
            weight = _shares(tx, ty, qx[some[busy]], qy[some[busy]])[0]
            part = _shares(tx, ty, px[best], py[best])[0]
            ratio = np.where(part > 1e-12, np.maximum(weight, 0) / np.where(part > 1e-12, part, 1), np.inf)
            t[np.arange(len(busy)), ratio.argmin(axis=1)] = best
            tri[busy] = t
        if len(busy):
            raise ArithmeticError("triangles did not settle")
        corners[some] = np.where((tri < n).all(axis=1)[:, None], tri, -1)
    return corners


def _tile_values(points: pd.DataFrame, cells: pd.DataFrame, tile: float, rim: float) -> np.ndarray:
    """Value at each cell of one tile, NaN without an accepted triangle."""
    out = np.full(len(cells), np.nan)
    if len(points) < 3:
        return out
    points = points.sort_values(["_px", "_py"])
    wide = tile / 2 + rim
    mx, my = (cells["_tx"].iat[0] + 0.5) * tile, (cells["_ty"].iat[0] + 0.5) * tile
    gx, gy = points["_px"].to_numpy(float), points["_py"].to_numpy(float)
    px, py = (gx - mx) / wide, (gy - my) / wide
    qx, qy = (cells["x_m"].to_numpy(float) - mx) / wide, (cells["y_m"].to_numpy(float) - my) / wide
    tri = triangles_at(px, py, px * px + py * py + _TIE * _jitter(gx, gy), qx, qy)
    ok = np.flatnonzero(tri[:, 0] >= 0)
    if not len(ok):
        return out
    x, y = px[tri[ok]], py[tri[ok]]
    weight, area = _shares(x, y, qx[ok], qy[ok])
    bx, by, cx, cy = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], x[:, 2] - x[:, 0], y[:, 2] - y[:, 0]
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / (2 * area), (bx * c2 - cx * b2) / (2 * area)
    radius = np.hypot(ux, uy)
    inside = (np.abs(x[:, 0] + ux) + radius <= 1) & (np.abs(y[:, 0] + uy) + radius <= 1)
    value = (weight * points["_z"].to_numpy(float)[tri[ok]]).sum(axis=1)
    out[ok[inside]] = value[inside]
    return out


def linear_points(points: DataFrame, targets: DataFrame, *, tile: float, rim: float, value: str = "z",
                  order: str = "pid", name: str = "z_linear") -> DataFrame:
    """``targets(..., x_m, y_m)`` with the linear interpolation of ``points(x_m, y_m, value)``.

    NULL outside the hull of the points, and where the circle of the triangle leaves the square of a tile and its
    ``rim``, as in gaps wider than the rim.  Points at one place keep the first by ``order``; targets without a place
    come back with NULL.  Every tile is one group: its cells, and the points in it and its rim.
    """
    pts = points.filter(finite(F.col("x_m")) & finite(F.col("y_m")) & finite(F.col(value)))
    pts = stable_unique(pts.select("x_m", "y_m", F.col(order).alias("_o"), F.col(value).cast("double").alias("_z")),
                        ["x_m", "y_m"], ["_o"])

    def reached(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - rim) / tile), F.floor((F.col(c) + rim) / tile)))

    pts = (pts.select("_z", F.col("x_m").alias("_px"), F.col("y_m").alias("_py"))
           .withColumn("_tx", reached("_px")).withColumn("_ty", reached("_py")))
    placed = targets.withColumns({"_tx": F.floor(F.col("x_m") / tile), "_ty": F.floor(F.col("y_m") / tile)})
    there = finite(F.col("x_m")) & finite(F.col("y_m"))
    schema = StructType([*targets.schema.fields, StructField(name, DoubleType())])

    def fill(cells: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if len(cells):
            cells[name] = _tile_values(near, cells, tile, rim)
        else:
            cells[name] = pd.Series(dtype=float)
        return cells.drop(columns=["_tx", "_ty"])

    done = (placed.filter(there).groupBy("_tx", "_ty").cogroup(pts.groupBy("_tx", "_ty"))
            .applyInPandas(fill, schema))
    done = done.withColumn(name, F.nanvl(name, F.lit(None).cast("double")))
    lost = targets.filter(~F.coalesce(there, F.lit(False))).withColumn(name, F.lit(None).cast("double"))
    return done.unionByName(lost)

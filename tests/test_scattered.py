"""Linear interpolation between points and polygon spans, against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltgrid.operators import spatial as P
from meltgrid.operators.scanlines import cells_in_spans
from meltgrid.operators.triangles import linear_points


def grid(spark, nx, ny, step=100.0):
    return spark.range(nx * ny).select(F.col("id").alias("cell_id"), (F.col("id") % nx * step).alias("x_m"),
                                       (F.floor(F.col("id") / nx) * step).alias("y_m"))


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)],
                                 "pid long, x_m double, y_m double, z double")


def brute(rows, x, y):
    """Value on a triangle with an empty circle that holds the place; None outside the hull."""
    p = np.array(rows)
    for t in map(list, itertools.combinations(range(len(p)), 3)):
        a = np.c_[p[t, :2], np.ones(3)].T
        if abs(np.linalg.det(a)) < 1e-9:
            continue
        w = np.linalg.solve(a, [x, y, 1.0])
        if w.min() < -1e-12:
            continue
        m = np.c_[2 * p[t, :2], np.ones(3)]
        c = np.linalg.solve(m, (p[t, :2] ** 2).sum(axis=1))
        d = ((p[:, :2] - c[:2]) ** 2).sum(axis=1)
        if (d >= d[t[0]] * (1 - 1e-9)).all():
            return float(w @ p[t, 2])
    return None


def values(df):
    return {r["cell_id"]: r["z_linear"] for r in df.collect()}


def close(a, b, tol=1e-6):
    return (a is None) == (b is None) and (a is None or abs(a - b) < tol)


@pytest.mark.parametrize("seed", [1, 2])
def test_linear_values_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.uniform(0, 1000), rng.uniform(0, 1000), rng.uniform(-5, 5)) for _ in range(22)]
    cells = grid(spark, 11, 11)
    got = values(linear_points(frame(spark, rows), cells, tile=5e4, rim=2.5e4))
    want = {r["cell_id"]: brute(rows, r["x_m"], r["y_m"]) for r in cells.collect()}
    assert all(close(got[c], want[c]) for c in want) and None in want.values()


def test_tiles_agree_and_a_plane_is_met(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(0, 4000), rng.uniform(0, 4000)) for _ in range(900)]
    bumpy = frame(spark, [(x, y, rng.uniform(0, 9)) for x, y in rows])
    flat = frame(spark, [(x, y, 3 + x / 100 - y / 50) for x, y in rows])
    cells = grid(spark, 41, 41).repartition(5)
    one = values(linear_points(bumpy, cells, tile=1e4, rim=1500.0))
    many = values(linear_points(bumpy, cells, tile=700.0, rim=1500.0))
    assert sum(v is not None for v in many.values()) > 1400
    assert all(close(one[c], v) for c, v in many.items() if v is not None and one[c] is not None)
    out = linear_points(flat, cells, tile=900.0, rim=1500.0).filter("z_linear IS NOT NULL")
    assert out.filter("abs(z_linear - (3 + x_m / 100 - y_m / 50)) > 1e-6").count() == 0


def test_points_on_a_lattice_and_on_the_hull(spark):
    """Four points on each circle, cells on points, edges and the hull; equal places keep the first."""
    rows = [(x * 200.0, y * 200.0, 2.0 * x - y) for x in range(6) for y in range(6)]
    pts = frame(spark, rows + [(0.0, 0.0, 99.0)])
    cells = grid(spark, 12, 12)
    got = values(linear_points(pts, cells, tile=450.0, rim=600.0))
    for r in cells.collect():
        inside = r["x_m"] <= 1000 and r["y_m"] <= 1000
        assert close(got[r["cell_id"]], r["x_m"] / 100 - r["y_m"] / 200 if inside else None), r


def test_few_points_missing_places_and_extra_columns(spark):
    cells = grid(spark, 3, 3).withColumn("z", F.lit("own"))
    cells = cells.withColumn("x_m", F.when(F.col("cell_id") > 0, F.col("x_m")))
    for rows in ([], [(0, 0, 1), (100, 100, 1)], [(0, 0, 1), (100, 100, 1), (200, 200, 1)]):
        out = linear_points(frame(spark, rows), cells, tile=1e3, rim=1e3)
        assert out.columns == [*cells.columns, "z_linear"]
        assert out.count() == 9 and out.filter("z_linear IS NOT NULL").count() == 0
    assert linear_points(frame(spark, []), cells.limit(0), tile=1e3, rim=1e3).count() == 0


@pytest.mark.parametrize("rings", ["union", "parity"])
@pytest.mark.parametrize("tile", [130.0, 5e4])
def test_spans_equal_edge_tests(spark, rings, tile):
    rng = random.Random(7)
    rows = []
    for region, part in itertools.product("ab", range(3)):
        seq = 0
        for _ in range(2):
            for _ in range(rng.randint(3, 9)):
                rows.append((region, part, seq, 100.0 * rng.randint(-2, 22), 100.0 * rng.randint(-2, 22)))
                seq += 1
            rows.append((region, part, seq, None, None))
            seq += 1
    polygons = spark.createDataFrame(rows, "region string, part int, seq int, x_m double, y_m double")
    cells = grid(spark, 20, 20).unionByName(spark.createDataFrame([(900, None, 1.0), (901, 1.0, None)],
                                                                  "cell_id long, x_m double, y_m double"))
    got = cells_in_spans(cells, polygons, band=250.0, tile=tile, key=["cell_id"], rings=rings).collect()
    want = P.points_in_polygons(cells, polygons, 250.0, ["cell_id"], rings=rings).collect()
    assert sorted(got) == sorted(want) and len(got) > 50

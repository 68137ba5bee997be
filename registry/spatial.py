"""Polygons, scattered points, connected regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltgrid.functions.truth import truth_binary
from meltgrid.operators import components as C
from meltgrid.operators import spatial as P
from meltgrid.operators.scanlines import cells_in_spans
from meltgrid.operators.triangles import linear_points
from registry.base import query, r, rnd
from registry.frames import MASKED, STEP, quantile_sql, roi

CELLS = ("cells",)

def _rings(shape: str) -> str:
    """Cells inside or on a region: crossings are counted over the rings of one shape."""
    return f"""vx AS (SELECT *, sum(CASE WHEN x_m IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY region, part ORDER BY seq) AS ring FROM polygons),
edges AS (SELECT region, part, ring, x_m AS x1, y_m AS y1,
 coalesce(lead(x_m) OVER w, first_value(x_m) OVER w) AS x2, coalesce(lead(y_m) OVER w, first_value(y_m) OVER w) AS y2
 FROM vx WHERE x_m IS NOT NULL WINDOW w AS (PARTITION BY region, part, ring ORDER BY seq)),
inside AS (SELECT DISTINCT cell_id, region FROM (SELECT cell_id, region, {shape} FROM cells, edges GROUP BY cell_id, region, {shape}
 HAVING sum(CASE WHEN (y1 > y_m) <> (y2 > y_m) AND x_m < (x2 - x1) * (y_m - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1
 OR bool_or((x_m - x1) * (y2 - y1) - (y_m - y1) * (x2 - x1) = 0 AND x_m BETWEEN least(x1, x2) AND greatest(x1, x2)
  AND y_m BETWEEN least(y1, y2) AND greatest(y1, y2))))"""


@query("cells_in_polygons", "J5 T5", tables=("cells", "polygons"), ctes=_rings("part, ring"), sql="SELECT cell_id, region FROM inside")
def _(t):
    return P.points_in_polygons(t.cells, t.polygons, 500.0, ["cell_id"])


@query("cells_in_polygons_with_holes", "J5", tables=("cells", "polygons"), ctes=_rings("part"), sql="SELECT cell_id, region FROM inside")
def _(t):
    return P.points_in_polygons(t.cells, t.polygons, 500.0, ["cell_id"], rings="parity")


@query("cells_in_polygon_spans", "J5", tables=("cells", "polygons"), ctes=_rings("part, ring"), sql="SELECT cell_id, region FROM inside")
def _(t):
    return cells_in_spans(t.cells, t.polygons, band=500.0, tile=2000.0, key=["cell_id"])


@query("cells_in_polygon_spans_with_holes", "J5", tables=("cells", "polygons"), ctes=_rings("part"), sql="SELECT cell_id, region FROM inside")
def _(t):
    return cells_in_spans(t.cells, t.polygons, band=500.0, tile=2000.0, key=["cell_id"], rings="parity")


@query("polygon_region_columns", "J5 T7", tables=("cells", "polygons"), ctes=_rings("part"), sql="""
SELECT c.cell_id, coalesce(bool_or(region = 'ISPB'), false) AS in_ispb, coalesce(bool_or(region = 'OSPB'), false) AS in_ospb
FROM cells c LEFT JOIN inside i ON i.cell_id = c.cell_id GROUP BY c.cell_id""")
def _(t):
    cells = t.cells.select("cell_id", "x_m", "y_m")
    return P.region_columns(cells, t.polygons, ["ISPB", "OSPB"], 500.0, ["cell_id"], rings="parity").drop("x_m", "y_m")


@query("points_coverage", "J6", tables=("points",), sql=f"""
SELECT count(*) AS n, count(*) FILTER (x_m BETWEEN 2e3 AND 8e3 AND y_m BETWEEN 1e3 AND 9e3) AS n_in,
 {r('1e2 * count(*) FILTER (x_m BETWEEN 2e3 AND 8e3 AND y_m BETWEEN 1e3 AND 9e3) / count(*)')} AS pct_in FROM points""")
def _(t):
    return rnd(P.coverage(t.points, (2e3, 8e3, 1e3, 9e3)))


@query("points_interpolated", "J4", tables=("cells", "points"), sql=f"""
SELECT c.cell_id, {r('sum(z * wt) / sum(wt)')} AS z_interp, count(z) AS n_near FROM cells c LEFT JOIN (
 SELECT *, 1e0 / greatest(d2, 1e-6) AS wt FROM (SELECT ri, ci, z, d2, row_number() OVER (PARTITION BY ri, ci ORDER BY d2, pid) AS k
  FROM (SELECT g.ri, g.ci, z, pid, pow(g.x_m - p.x_m, 2) + pow(g.y_m - p.y_m, 2) AS d2 FROM
   (SELECT x_m, y_m, min(pid) AS pid, min_by(z, pid) AS z FROM points WHERE z IS NOT NULL GROUP BY x_m, y_m) p
   JOIN cells g ON g.ri BETWEEN cast(floor((p.y_m - 3e2) / 1e2) AS int) AND cast(ceil((p.y_m + 3e2) / 1e2) AS int)
    AND g.x_m BETWEEN p.x_m - 3e2 AND p.x_m + 3e2) WHERE d2 <= 9e4) WHERE k <= 4) b
ON b.ri = c.ri AND b.ci = c.ci GROUP BY c.cell_id""")
def _(t):
    out = P.interp_points(t.points, t.cells.select("cell_id", "ri", "ci"), step=STEP, radius=300.0, k=4)
    return rnd(out.select("cell_id", "z_interp", "n_near"))


@query("points_linear", "J4", tables=("cells", "raster"), sql=f"""
SELECT cell_id, CASE WHEN x_m <= 12250e0 AND y_m BETWEEN lo AND hi THEN {r('x_m / 1e2 - y_m / 5e1')} END AS z_linear
FROM cells, (SELECT min(y_m) AS lo, max(y_m) AS hi FROM (SELECT y_m FROM raster GROUP BY y_m HAVING count(*) = 50))""")
def _(t):
    """A plane over the full rows of the raster; other values, which SQL would need a triangulation for, are tested by
    brute force."""
    full = t.raster.groupBy("y_m").count().filter("count = 50").select("y_m")
    pts = t.raster.join(full, "y_m").select((F.col("iy") * 50 + F.col("ix")).alias("pid"), "x_m", "y_m",
                                            (F.col("x_m") / 100 - F.col("y_m") / 50).alias("z"))
    return rnd(linear_points(pts, t.cells.select("cell_id", "x_m", "y_m"), tile=4000.0, rim=800.0).select("cell_id", "z_linear"))


def _labels(min_size: int) -> str:
    """Smallest reachable cell per cell by repeated relaxation, then column-major numbering."""
    return f"""m AS (SELECT ri, ci, cast(ci AS bigint) * 1000000 + ri AS n FROM masked WHERE slow AND coalesce(sink, false)),
lab AS (WITH RECURSIVE l(n, lab, changed) USING KEY (n) AS (
  SELECT n, n, true FROM m
  UNION
  SELECT x.n, min(y.lab), true FROM recurring.l x JOIN m c ON c.n = x.n
   JOIN m d ON d.ri BETWEEN c.ri - 1 AND c.ri + 1 AND d.ci BETWEEN c.ci - 1 AND c.ci + 1
   JOIN l y ON y.n = d.n GROUP BY x.n, x.lab HAVING min(y.lab) < x.lab)
 SELECT n, lab FROM l),
sz AS (SELECT lab, count(*) AS cells FROM lab GROUP BY lab HAVING count(*) >= {min_size}),
comp AS (SELECT c.ri, c.ci, c.cell_id, (SELECT 0) AS z, dense_rank() OVER (ORDER BY l.lab) AS comp_id, c.q, c.ispb, c.ospb,
 CASE WHEN q > 2e-1 THEN 1 ELSE 0 END AS y FROM m JOIN lab l ON l.n = m.n JOIN sz ON sz.lab = l.lab
 JOIN masked c ON c.ri = m.ri AND c.ci = m.ci)"""


COMP = MASKED + ",\n" + _labels(5)


def members(t):
    """Regions of at least five scored cells, on the scored cells."""
    cells = roi(t).withColumn("y", truth_binary(F.col("q"), 0.2))
    comps = C.connected_components(cells.select("ri", "ci"), 8, 5)
    return C.members_of(cells, comps)


@query("connected_regions", "J8", tables=CELLS, ctes=COMP, sql="SELECT ri, ci, comp_id FROM comp")
def _(t):
    return C.connected_components(roi(t).select("ri", "ci"), 8, 5)


@query("region_membership", "J9", tables=CELLS, ctes=COMP, sql="SELECT cell_id, comp_id FROM comp")
def _(t):
    return members(t).select("cell_id", "comp_id")


@query("region_sizes", "A12", tables=CELLS, ctes=COMP + ", s AS (SELECT comp_id, count(*) AS cells FROM comp GROUP BY comp_id)", sql=f"""
SELECT n AS n_comp, {r('mn')} AS min, {r('q1')} AS q1, {r('med')} AS med, {r('q3')} AS q3, {r('p90')} AS p90, {r('p95')} AS p95,
 {r('mx')} AS max, n < 50 AS too_few
FROM ({quantile_sql('s', 'cells', {'mn': 0.0, 'q1': 0.25, 'med': 0.5, 'q3': 0.75, 'p90': 0.9, 'p95': 0.95, 'mx': 1.0})})""")
def _(t):
    return rnd(C.component_sizes(members(t)))


@query("region_wet_cells", "A13", tables=CELLS, ctes=COMP, sql="""
SELECT cell_id, comp_id, bool_or(y = 1) OVER (PARTITION BY comp_id) AS wet_comp FROM comp""")
def _(t):
    return C.component_wet(members(t)).select("cell_id", "comp_id", "wet_comp")


@query("region_records", "A14", tables=CELLS, ctes=COMP, sql=f"""
SELECT comp_id, round(avg(ci)) * 1e2 AS cx_m, round(avg(ri)) * 1e2 AS cy_m, bool_or(y = 1) AS is_wet,
 CASE WHEN bool_or(y = 1) THEN 'WET' ELSE 'DRY' END AS state, count(*) AS cells, {r('count(*) * 1e-2')} AS area_km2
FROM comp GROUP BY comp_id""")
def _(t):
    return rnd(C.component_records(members(t), STEP * STEP / 1e6, STEP))


AREAS = """, am AS (SELECT region, ri, ci, cast(ci AS bigint) * 1000000 + ri AS n, y FROM (
  SELECT 'ALL' AS region, * FROM comp UNION ALL SELECT 'ISPB', * FROM comp WHERE ispb UNION ALL SELECT 'OSPB', * FROM comp WHERE ospb)),
alab AS (WITH RECURSIVE l(region, n, lab, changed) USING KEY (region, n) AS (
  SELECT region, n, n, true FROM am
  UNION
  SELECT x.region, x.n, min(y.lab), true FROM recurring.l x JOIN am c ON c.n = x.n AND c.region = x.region
   JOIN am d ON d.region = c.region AND d.ri BETWEEN c.ri - 1 AND c.ri + 1 AND d.ci BETWEEN c.ci - 1 AND c.ci + 1
   JOIN l y ON y.n = d.n AND y.region = d.region GROUP BY x.region, x.n, x.lab HAVING min(y.lab) < x.lab)
 SELECT region, n, lab FROM l),
g AS (SELECT am.region, lab, count(*) AS n, bool_or(y = 1) AS wet FROM am JOIN alab ON alab.n = am.n AND alab.region = am.region GROUP BY am.region, lab)"""


@query("region_area_stats", "A15", tables=CELLS, ctes=COMP + AREAS, sql=f"""
SELECT region, cast(sum(n) AS bigint) AS cells, count(*) AS comps, {r('avg(n) * 1e-2')} AS mean_km2,
 {r('1e2 * avg(CASE WHEN wet THEN 1e0 ELSE 0e0 END)')} AS pct_wet, {r('1e2 - 1e2 * avg(CASE WHEN wet THEN 1e0 ELSE 0e0 END)')} AS pct_dry
FROM g GROUP BY region""")
def _(t):
    areas = {"ALL": F.lit(True), "ISPB": F.col("ispb"), "OSPB": F.col("ospb")}
    return rnd(C.region_stats(members(t), areas, STEP * STEP / 1e6))

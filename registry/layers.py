"""Sources, alignment, regridding, gradients, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltgrid.functions.nulls import clean
from meltgrid.functions.physics import lat_at_most, polar_radius
from meltgrid.operators import grid as G
from meltgrid.operators import masks as K
from meltgrid.operators.models import stable_unique
from meltgrid.operators.summaries import axis_in_metres, detect_axis_mode
from meltgrid.session import scratch_path
from meltgrid.sources import files as S
from registry.base import query, r, rnd
from registry.frames import CLEAN, NCOLS, STEP, clean_cells

CELLS = ("cells",)


@query("grid_generate", "S1", tables=CELLS, sql="""
SELECT rr * 125 + cc AS cell_id, cast(rr AS int) AS ri, cast(cc AS int) AS ci, 1e2 * cc AS x_m, 1e2 * rr AS y_m,
 c.h IS NOT NULL AS has_h
FROM (SELECT unnest(range(0, (SELECT max(ri) FROM cells) + 1)) AS rr) a, (SELECT unnest(range(0, 125)) AS cc) b
LEFT JOIN cells c ON c.ri = rr AND c.ci = cc""")
def _(t):
    e = G.extents(t.cells).first()
    full = G.cell_grid(t.spark, 0.0, 12400.0, 0.0, STEP * e["r1"], STEP)
    have = t.cells.select("ri", "ci", F.col("h").isNotNull().alias("has_h"))
    return full.join(have, ["ri", "ci"], "left").withColumn("has_h", F.coalesce("has_h", F.lit(False)))


@query("layers_stacked", "S2 S3 J1", tables=("cells", "model_cells"), ctes=CLEAN, sql="""
SELECT c.ri, c.ci, h, q, m.sigma, cast(NULL AS double) AS bounds FROM clean c
LEFT JOIN model_cells m ON m.cell_id = c.cell_id AND model = 'A'""")
def _(t):
    c = clean_cells(t)
    sig = t.model_cells.filter("model = 'A'").join(t.cells.select("cell_id", "ri", "ci"), "cell_id")
    return G.stack_layers({"h": c.select("ri", "ci", "h"), "q": c.select("ri", "ci", "q")},
                          optional={"sigma": sig.select("ri", "ci", "sigma"), "bounds": None})


@query("layer_extents", "S2", tables=CELLS, sql="""
SELECT 'h' AS layer, count(*) AS cells, min(ri) AS r0, max(ri) AS r1, min(ci) AS c0, max(ci) AS c1 FROM cells
UNION ALL SELECT 'slow', count(*), min(ri), max(ri), min(ci), max(ci) FROM cells WHERE icevel <= 10""")
def _(t):
    return G.layer_extents({"h": t.cells, "slow": t.cells.filter("icevel <= 10")})


@query("layer_transpose_align", "J1", tables=CELLS, sql=f"""
SELECT a.ri, a.ci, {r('a.h - b.h')} AS dh FROM cells a JOIN cells b ON a.ri = b.ci AND a.ci = b.ri""")
def _(t):
    a = t.cells.select("ri", "ci", "h")
    b = t.cells.select("ri", "ci", F.col("h").alias("h2"))
    return rnd(G.align(a, b, transposed=True).select("ri", "ci", (F.col("h") - F.col("h2")).alias("dh")))


@query("layers_stored_aligned", "J1 S2", tables=("cells", "model_cells"), sql=f"""
SELECT a.ri, a.ci, {r('a.h')} AS h, {r('m.g - a.q')} AS gq FROM cells a JOIN model_cells m ON m.cell_id = a.cell_id WHERE m.model = 'A'""")
def _(t):
    """Two layers stored by cell and joined bucket by bucket."""
    first = S.store_layer(t.cells.select("cell_id", "ri", "ci", "h", "q"), scratch_path(t.spark, "layer"), ["cell_id"], 8)
    second = S.store_layer(t.model_cells.filter("model = 'A'").select("cell_id", "g"), scratch_path(t.spark, "layer"), ["cell_id"], 8)
    return rnd(first.join(second, "cell_id").select("ri", "ci", "h", (F.col("g") - F.col("q")).alias("gq")))


@query("points_scanned", "S4 P2", tables=("points",), sql=f"""
SELECT source, count(*) AS n, {r('sum(x_m)')} AS sx, {r('sum(y_m)')} AS sy, {r('sum(z) * 1e3')} AS sz
FROM (SELECT *, 'survey' AS source FROM points) GROUP BY source""")
def _(t):
    path = scratch_path(t.spark, "points")
    km = t.points.select((F.col("x_m") / 1000).alias("x"), (F.col("y_m") / 1000).alias("y"), "z")
    km.write.csv(path, sep=" ")
    df = S.scan_points(t.spark, path, "x double, y double, z double", xy_unit="km", source="survey")
    from meltgrid.functions.physics import to_mw
    return rnd(df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
                                        F.sum(to_mw(F.col("z"), "W")).alias("sz")))


@query("raster_rows_to_cells", "S5", tables=("raster",), sql="""
SELECT cast(49 - ix AS int) AS ix, iy, 12250e0 - x_m AS x_m, y_m, z FROM raster""")
def _(t):
    rows = t.raster.groupBy(F.col("iy").alias("i")).agg(F.array_sort(F.collect_list(F.struct("ix", "z"))).alias("p"))
    rows = rows.select("i", F.col("p.z").alias("values"))
    x = t.raster.groupBy(F.col("ix").alias("i")).agg(F.max(12250.0 - F.col("x_m")).alias("x_m"))
    y = t.raster.groupBy(F.col("iy").alias("i")).agg(F.max("y_m").alias("y_m"))
    return G.raster_to_cells(rows, x, y)


@query("export_nodata", "S8", tables=CELLS, ctes=CLEAN, sql="""
SELECT cell_id, coalesce(q, -9999e0) AS q FROM clean""")
def _(t):
    return S.nodata_view(clean_cells(t).select("cell_id", "q"), ["q"])


@query("export_extent", "S8", tables=CELLS, sql="""
SELECT min(x_m) - 5e1 AS x_lo, max(x_m) + 5e1 AS x_hi, min(y_m) - 5e1 AS y_lo, max(y_m) + 5e1 AS y_hi,
 count(*) AS cells FROM cells""")
def _(t):
    return G.export_extent(t.cells, STEP)


@query("export_xyz_text", "S7", tables=CELLS, ctes=CLEAN, sql="""
SELECT count(*) AS lines, round(sum(cast(printf('%.5e', q) AS double)), 5) AS sq FROM clean WHERE q IS NOT NULL""")
def _(t):
    path = scratch_path(t.spark, "xyz")
    S.write_xyz(clean_cells(t), path, ("x_m", "y_m", "q"))
    back = t.spark.read.csv(path, schema="x double, y double, q double", sep=" ")
    return back.agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("q"), 5).alias("sq"))


@query("grid_downsampled", "S9", tables=CELLS, sql="""
SELECT cell_id, ri, ci, h FROM cells WHERE ri % 8 = 0 AND ci % 8 = 0""")
def _(t):
    return G.downsample(t.cells, 8).select("cell_id", "ri", "ci", "h")


@query("values_cleaned", "P1 P5 P6", tables=CELLS, sql="""
SELECT cell_id, CASE WHEN q > 0 AND q <> 9999e0 THEN q END AS q, cast(h AS float) AS h32, x_m / 1e3 AS x_km,
 y_m / 1e3 AS y_km FROM cells""")
def _(t):
    df = G.to_single(G.with_km(t.cells).withColumn("h32", F.col("h")), ["h32"])
    return df.select("cell_id", clean(F.col("q"), nonpositive=True).alias("q"), "h32", "x_km", "y_km")


@query("axis_units", "P3", tables=("raster",), sql="""
SELECT 'm' AS tag, max(x_m) AS max_x, max(y_m) AS max_y, 'meters' AS mode FROM raster
UNION ALL SELECT 'km', max(x_m) / 1e3, max(y_m) / 1e3, CASE WHEN max(x_m) / 1e3 <= 370 AND max(y_m) / 1e3 <= 95 THEN 'degrees'
 WHEN max(y_m) / 1e3 <= 180 THEN 'degrees' ELSE 'meters' END FROM raster
UNION ALL SELECT 'text', max(x_m) / 1e3, max(y_m) / 1e3, 'kilometers' FROM raster""")
def _(t):
    x = t.raster.groupBy(F.col("ix").alias("i")).agg(F.max("x_m").alias("v"))
    y = t.raster.groupBy(F.col("iy").alias("i")).agg(F.max("y_m").alias("v"))
    xk, yk = (a.withColumn("v", F.col("v") / 1000) for a in (x, y))
    parts = (("m", detect_axis_mode(x, y)), ("km", detect_axis_mode(xk, yk)),
             ("text", detect_axis_mode(xk, yk, {"x_units": "km"})))
    out = None
    for tag, p in parts:
        p = p.select(F.lit(tag).alias("tag"), "max_x", "max_y", "mode")
        out = p if out is None else out.unionByName(p)
    return out


@query("axes_in_metres", "P3", tables=("raster",), sql="""
SELECT 'named' AS tag, count(*) AS n, max(x_m) AS last FROM (SELECT DISTINCT ix, x_m FROM raster)
UNION ALL SELECT 'plain', count(*), max(x_m) FROM (SELECT DISTINCT ix, x_m FROM raster)""")
def _(t):
    x = t.raster.groupBy(F.col("ix").alias("i")).agg(F.max("x_m").alias("v"))
    y = t.raster.groupBy(F.col("iy").alias("i")).agg(F.max("y_m").alias("v"))
    xk, yk = (a.withColumn("v", F.col("v") / 1000) for a in (x, y))
    out = None
    for tag, ax, ay, attrs in (("named", xk, yk, {"x_units": "km"}), ("plain", x, y, None)):
        mode = detect_axis_mode(ax, ay, attrs).first()["mode"]
        part = axis_in_metres(ax, mode).agg(F.lit(tag).alias("tag"), F.count(F.lit(1)).alias("n"), F.max("v").alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


@query("rect_masks", "P22", tables=CELLS, sql="""
SELECT cell_id, (x_m BETWEEN 1e3 AND 3e3 AND y_m BETWEEN 0 AND 2e3) OR (x_m BETWEEN 5e3 AND 9e3 AND y_m BETWEEN 5e2 AND 4e3) AS inside,
 NOT (x_m BETWEEN 1e3 AND 3e3 AND y_m BETWEEN 0 AND 2e3) AS outside FROM cells""")
def _(t):
    x, y = F.col("x_m"), F.col("y_m")
    two = [(3e3, 1e3, 0.0, 2e3), (5e3, 9e3, 4e3, 5e2)]
    return t.cells.select("cell_id", K.rect_mask(x, y, two).alias("inside"),
                          K.rect_mask(x, y, two[:1], "exclude").alias("outside"))


@query("mask_crop_expand", "P23", tables=CELLS, sql="""
SELECT cell_id, coalesce(ispb, false) AS mask FROM cells""")
def _(t):
    box = K.mask_crop(t.cells, F.col("ispb")).first()
    crop = t.cells.filter("ispb").select((F.col("ri") - box["r0"]).alias("ri"), (F.col("ci") - box["c0"]).alias("ci"))
    return G.expand_mask(crop, t.cells.select("cell_id", "ri", "ci"), box["r0"], box["c0"]).select("cell_id", "mask")


@query("mask_resized", "P23", tables=CELLS, sql="""
SELECT g.cell_id, s.mask FROM (SELECT cell_id, ri, ci, max(ri) OVER () + 1 AS nr FROM cells) g LEFT JOIN (
 SELECT cast(floor(ri / 2) AS int) AS sr, cast(floor(ci / 2) AS int) AS sc, bool_or(sink) AS mask FROM cells GROUP BY 1, 2) s
ON s.sr = cast(floor((g.ri + 5e-1) * cast(floor((nr + 1) / 2) AS int) / nr) AS int) AND s.sc = cast(floor((g.ci + 5e-1) * 63e0 / 125e0) AS int)""")
def _(t):
    half = t.cells.groupBy(F.floor(F.col("ri") / 2).cast("int").alias("ri"), F.floor(F.col("ci") / 2).cast("int").alias("ci")).agg(
        F.bool_or("sink").alias("mask"))
    rows = G.extents(t.cells).first()["r1"] + 1
    return G.resize_nearest(half, t.cells.select("cell_id", "ri", "ci"), ((rows + 1) // 2, (NCOLS + 1) // 2),
                            (rows, NCOLS)).select("cell_id", "mask")


@query("layer_replaced", "P24 P4", tables=CELLS, sql=f"""
SELECT count(*) FILTER (hit) AS n_replaced, {r('count(*) FILTER (hit) * 1e4 / 1e6')} AS area_km2,
 {r('1e2 * count(*) FILTER (hit) / greatest(count(*) FILTER (h IS NOT NULL OR hit), 1)')} AS pct
FROM (SELECT *, sqrt(pow(x_m * 2e1, 2) + pow(y_m * 2e1, 2)) <= {polar_radius(-88.5)!r}e0 AND custkey % 3 = 0 AS hit FROM cells)""")
def _(t):
    near = lat_at_most(F.col("x_m") * 20.0, F.col("y_m") * 20.0, -88.5)
    alt = F.when(F.col("custkey") % 3 == 0, F.col("h") + 50.0)
    return rnd(K.replace_report(t.cells, F.col("h"), alt, near, STEP * STEP))


@query("layer_differences", "P25 P26", tables=CELLS, sql=f"""
SELECT cell_id, {r('CASE WHEN h IS NOT NULL THEN greatest(h - 4e3, 0e0) END')} AS thick, {r('h - 1e1 * mean_qty')} AS plain,
 {r('CASE WHEN mean_qty IS NOT NULL THEN greatest(2e2, 1e1 * mean_qty) - 1e1 * mean_qty END')} AS depth, coalesce(greatest(2e2, 1e1 * mean_qty) > 1e1 * mean_qty AND mean_qty IS NOT NULL, false) AS hollow
FROM cells""")
def _(t):
    head = 10.0 * F.col("mean_qty")
    depth, hollow = K.sink_depth(head, F.greatest(F.lit(200.0), head))
    return rnd(t.cells.select(
        "cell_id", K.layer_diff(F.col("h"), F.lit(4000.0), 0.0).alias("thick"),
        K.layer_diff(F.col("h"), head).alias("plain"), depth.alias("depth"), hollow.alias("hollow")))


@query("regrid_bilinear", "J2", tables=("cells", "raster"), sql=f"""
SELECT cell_id, {r('''CASE WHEN fx <= 49 AND fy <= ny - 1 THEN
 (a.z * (1e0 - (fx - i)) + b.z * (fx - i)) * (1e0 - (fy - j)) + (c.z * (1e0 - (fx - i)) + d.z * (fx - i)) * (fy - j) END''')} AS z_interp
FROM (SELECT *, cast(least(floor(fx), 48) AS int) AS i, cast(least(floor(fy), ny - 2) AS int) AS j FROM
 (SELECT cell_id, x_m / 25e1 AS fx, y_m / 3e2 AS fy, (SELECT max(iy) + 1 FROM raster) AS ny FROM cells)) t
LEFT JOIN raster a ON a.ix = i AND a.iy = j LEFT JOIN raster b ON b.ix = i + 1 AND b.iy = j
LEFT JOIN raster c ON c.ix = i AND c.iy = j + 1 LEFT JOIN raster d ON d.ix = i + 1 AND d.iy = j + 1""")
def _(t):
    ny = t.raster.agg(F.max("iy")).first()[0] + 1
    out = G.regrid_bilinear(t.raster, t.cells.select("cell_id", "x_m", "y_m"), x0=0.0, dx=250.0, nx=50, y0=0.0,
                            dy=300.0, ny=ny)
    return rnd(out.select("cell_id", "z_interp"))


@query("regrid_nearest", "J3", tables=("cells", "raster"), sql="""
SELECT cell_id, z AS z_nearest FROM cells t LEFT JOIN raster a ON a.ix = cast(round(t.x_m / 25e1) AS int)
AND a.iy = cast(round(t.y_m / 3e2) AS int)""")
def _(t):
    return G.regrid_nearest(t.raster, t.cells.select("cell_id", "x_m", "y_m"), x0=0.0, dx=250.0, y0=0.0, dy=300.0).select(
        "cell_id", "z_nearest")


@query("neighbour_pairs", "J7", tables=CELLS, sql="""
SELECT a.ri, a.ci, b.ri AS ri2, b.ci AS ci2 FROM (SELECT * FROM cells WHERE sink) a JOIN (SELECT * FROM cells WHERE sink) b
ON (b.ri = a.ri AND b.ci = a.ci + 1) OR (b.ri = a.ri + 1 AND b.ci BETWEEN a.ci - 1 AND a.ci + 1)""")
def _(t):
    return G.neighbours(t.cells.filter("sink"), 8)


GRAD = """grad AS (SELECT cell_id, ri, ci, h, q,
 CASE WHEN ci = 0 THEN (lead(h) OVER x - h) / 1e2 WHEN ci = 124 THEN (h - lag(h) OVER x) / 1e2
  ELSE (lead(h) OVER x - lag(h) OVER x) / 2e2 END AS dh_dx,
 CASE WHEN ri = 0 THEN (lead(h) OVER y - h) / 1e2 WHEN ri = mr THEN (h - lag(h) OVER y) / 1e2
  ELSE (lead(h) OVER y - lag(h) OVER y) / 2e2 END AS dh_dy,
 CASE WHEN ci = 0 THEN (lead(q) OVER x - q) / 1e2 WHEN ci = 124 THEN (q - lag(q) OVER x) / 1e2
  ELSE (lead(q) OVER x - lag(q) OVER x) / 2e2 END AS dq_dx
 FROM (SELECT g.rr AS ri, g.cc AS ci, c.cell_id, h, q, (SELECT max(ri) FROM cells) AS mr
  FROM (SELECT unnest(range(0, (SELECT max(ri) FROM cells) + 1)) AS rr) g0, (SELECT unnest(range(0, 125)) AS cc) g1,
  LATERAL (SELECT rr, cc) g LEFT JOIN clean c ON c.ri = g.rr AND c.ci = g.cc)
 WINDOW x AS (PARTITION BY ri ORDER BY ci), y AS (PARTITION BY ci ORDER BY ri))"""


@query("gradient_two_axes", "W1", tables=CELLS, ctes=CLEAN + ", " + GRAD, sql=f"""
SELECT cell_id, {r('dh_dx')} AS dh_dx, {r('dh_dy')} AS dh_dy, {r('dq_dx', 9)} AS dq_dx FROM grad WHERE cell_id IS NOT NULL""")
def _(t):
    df = G.gradient2d(clean_cells(t), ["h", "q"], STEP, STEP)
    return df.select("cell_id", F.round("dh_dx", 6).alias("dh_dx"), F.round("dh_dy", 6).alias("dh_dy"),
                     F.round("dq_dx", 9).alias("dq_dx"))


@query("points_first_per_place", "T6", tables=("points",), sql="""
SELECT x_m, y_m, pid, z FROM (SELECT *, row_number() OVER (PARTITION BY x_m, y_m ORDER BY pid) AS rn FROM points) WHERE rn = 1""")
def _(t):
    return stable_unique(t.points.select("x_m", "y_m", "pid", "z"), ["x_m", "y_m"], ["pid"])

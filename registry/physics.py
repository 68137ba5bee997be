"""Derived physical fields, distribution summaries and checks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meltgrid.functions import physics as X
from meltgrid.functions.names import with_name_parts
from meltgrid.operators import grid as G
from meltgrid.operators import ordered as O
from meltgrid.operators import summaries as U
from meltgrid.operators.models import last_meeting
from meltgrid.session import cut_lineage
from meltgrid.plans.dataset import with_advection, with_flow
from registry.base import query, r, rnd, sel
from registry.frames import (CLEAN, LABELLED, MASKED, NCOLS, STEP, clean_cells, erf_sql, gmin_sql, labelled, masked,
                             quantile_sql)

CELLS = ("cells",)
CM = ("cells", "model_cells")

E2 = X.WGS84_F * (2 - X.WGS84_F)
ECC = math.sqrt(E2)


def _t_sql(phi: str) -> str:
    return f"(tan(pi() / 4e0 - {phi} / 2e0) / pow((1e0 - {ECC!r} * sin({phi})) / (1e0 + {ECC!r} * sin({phi})), {ECC / 2!r}))"


_PC = "radians(71e0)"
_RHO = (f"(6378137e0 * (cos({_PC}) / sqrt(1e0 - pow({ECC!r} * sin({_PC}), 2))) / {_t_sql(_PC)} * "
        f"{_t_sql('radians(-lat)')})")


@query("polar_projection", "P4", tables=("points",), sql=f"""
SELECT pid, {r(f'{_RHO} * sin(radians(lon))', 3)} AS x_ps, {r(f'{_RHO} * cos(radians(lon))', 3)} AS y_ps,
 CASE WHEN lat > -9e1 THEN {r('lat')} END AS lat_back, lat <= -85 AS south FROM points""")
def _(t):
    x, y = X.to_polar_stereo(F.col("lon"), F.col("lat"))
    df = t.points.withColumns({"x_ps": x, "y_ps": y})
    _, lat = X.from_polar_stereo(F.col("x_ps"), F.col("y_ps"))
    return df.select("pid", F.round("x_ps", 3).alias("x_ps"), F.round("y_ps", 3).alias("y_ps"),
                     F.when(F.col("lat") > -90, F.round(lat, 6)).alias("lat_back"),
                     X.lat_at_most(F.col("x_ps"), F.col("y_ps"), -85.0 + 1e-9).alias("south"))


@query("unit_conversions", "P2", tables=CELLS, sql=f"""
SELECT cell_id, {r('q * 1e3')} AS mw, {r('h / 91e1')} AS ice, {r('mb / 12e0')} AS monthly FROM cells""")
def _(t):
    return rnd(t.cells.select("cell_id", X.to_mw(F.col("q"), "W").alias("mw"),
                              X.water_to_ice(F.col("h")).alias("ice"), X.monthly_rate(F.col("mb")).alias("monthly")))


@query("flow_directions", "P7", tables=CELLS, sql=f"""
SELECT cell_id, {r('sqrt(vx * vx + vy * vy)')} AS speed, {r('vx / greatest(sqrt(vx * vx + vy * vy), 1e-9)')} AS ex,
 {r('vy / greatest(sqrt(vx * vx + vy * vy), 1e-9)')} AS ey, {r('sin(radians(25e0))')} AS bx, {r('cos(radians(25e0))')} AS by
FROM cells""")
def _(t):
    speed, ex, ey = X.flow_dir(F.col("vx"), F.col("vy"))
    bx, by = X.bearing_dir(25.0)
    return rnd(t.cells.select("cell_id", speed.alias("speed"), ex.alias("ex"), ey.alias("ey"), bx.alias("bx"), by.alias("by")))


@query("margins_with_topography", "P9 P11", tables=CM, sql=f"""
SELECT model, c.cell_id, {r('g * (1e0 + (custkey % 7 - 3) / 1e2)')} AS g_topo, {r(f"g * (1e0 + (custkey % 7 - 3) / 1e2) - {gmin_sql()}")} AS gdiff,
 {r(f"g * (1e0 + (custkey % 7 - 3) / 1e2) - ({gmin_sql()} - (ri % 5))")} AS gdiff_adv
FROM cells c JOIN model_cells m ON m.cell_id = c.cell_id""")
def _(t):
    delta = (F.col("custkey") % 7 - 3) / 100.0
    df = t.cells.join(t.model_cells, "cell_id").withColumns({
        "g_topo": X.topo_correct(F.col("g"), delta), "gm": X.gmin(F.col("h"), F.col("ts"), F.col("mb"))})
    return rnd(df.select("model", "cell_id", "g_topo", X.gdiff(F.col("g_topo"), F.col("gm")).alias("gdiff"),
                         X.gdiff(F.col("g_topo"), F.col("gm"), F.col("ri") % 5).alias("gdiff_adv")))


@query("gmin_spread", "P15", tables=CELLS, sql=f"""
SELECT cell_id, {r(f'''sqrt(pow(({gmin_sql('h', '(ts + 1e0)', 'mb')} - {gmin_sql('h', '(ts - 1e0)', 'mb')}) / 2e0 * 15e-1, 2)
 + pow(({gmin_sql('h', 'ts', '(mb + 1e-3)')} - {gmin_sql('h', 'ts', '(mb - 1e-3)')}) / 2e-3 * 1e-2, 2)
 + pow(({gmin_sql('(h + 1e1)', 'ts', 'mb')} - {gmin_sql('(h - 1e1)', 'ts', 'mb')}) / 2e1 * 5e1, 2))''')} AS s_gmin FROM cells""")
def _(t):
    s = X.sigma_gmin(F.col("h"), F.col("ts"), F.col("mb"), s_ts=1.5, s_mb=0.01, s_h=50.0, d_ts=1.0, d_mb=0.001, d_h=10.0)
    return rnd(t.cells.select("cell_id", s.alias("s_gmin")))


# Advection -------------------------------------------------------------------------------------

def advected(t):
    """Cells with gradients, flow direction and the advected flux (both coefficients)."""
    df = t.cells.select("cell_id", "ri", "ci", "x_m", "y_m", "h", "ts", "mb", "vx", "vy", "custkey")
    df = with_flow(df, STEP)

    def flux(sign: float, k: float):
        d = [sign * F.col(c) for c in ("dts", "dh", "dmb")]
        return X.advection_flux(F.col("h"), F.col("ts"), F.col("mb"), F.col("speed"), *d, k=k)

    return df.withColumns({"dq": flux(1.0, 0.333), "dq_flip": flux(-1.0, 0.25), "dq_half": flux(1.0, 0.5)})


def _grad(col: str) -> str:
    return f"""CASE WHEN ci = 0 THEN (lead({col}) OVER x - {col}) / 1e2 WHEN ci = 124 THEN ({col} - lag({col}) OVER x) / 1e2
  ELSE (lead({col}) OVER x - lag({col}) OVER x) / 2e2 END * ex + CASE WHEN ri = 0 THEN (lead({col}) OVER y - {col}) / 1e2
  WHEN ri = mr THEN ({col} - lag({col}) OVER y) / 1e2 ELSE (lead({col}) OVER y - lag({col}) OVER y) / 2e2 END * ey"""


def _flux(sign: str, k: str) -> str:
    return (f"917e0 * (152.5e0 + 7.122e0 * ts) * (5e-1 * speed / 31556926e0) * (h * ({sign} * dts) + {k} * g0 * h * h * "
            f"(({sign} * dh) / greatest(h, 1e0) - ({sign} * dmb / 31556926e0) / greatest(mb / 31556926e0, 1e-12)))")


ADV = f"""bounds AS (SELECT max(ri) AS mr FROM cells),
flow AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed, vx / greatest(sqrt(vx * vx + vy * vy), 1e-9) AS ex,
 vy / greatest(sqrt(vx * vx + vy * vy), 1e-9) AS ey FROM cells, bounds),
slopes AS (SELECT cell_id, ri, ci, x_m, y_m, h, ts, mb, custkey, speed, ex, ey, {_grad('ts')} AS dts, {_grad('h')} AS dh, {_grad('mb')} AS dmb,
 greatest((273.15e0 - 7.42e-8 * 917e0 * 9.81e0 * h - ts) / greatest(h, 1e0), 0e0) AS g0
 FROM flow WINDOW x AS (PARTITION BY ri ORDER BY ci), y AS (PARTITION BY ci ORDER BY ri)),
adv AS (SELECT *, {_flux('1e0', '0.333e0')} AS dq, {_flux('-1e0', '25e-2')} AS dq_flip, {_flux('1e0', '5e-1')} AS dq_half FROM slopes)"""


@query("advection_flux", "P12 W1", tables=CELLS, ctes=ADV, sql=f"""
SELECT cell_id, {r('dq')} AS dq, {r('dq_flip')} AS dq_flip, {r('dts')} AS dts FROM adv""")
def _(t):
    return rnd(advected(t).select("cell_id", "dq", "dq_flip", "dts"))


@query("advection_built", "P12 A23", tables=CELLS, ctes=ADV + f""",
cut AS ({quantile_sql('adv', 'dq', {'lo': 0.025, 'hi': 0.975})})""", sql=f"""
SELECT cell_id, {r('CASE WHEN dq BETWEEN lo AND hi THEN 1e3 * dq END', 4)} AS adv FROM adv, cut""")
def _(t):
    """The dataset builder: flux in mW/m2 with its central share kept."""
    return rnd(with_advection(t.cells, STEP).select("cell_id", "adv"), 4)


@query("advection_trimmed", "A23", tables=CELLS, ctes=ADV + f""",
cut AS ({quantile_sql('adv', 'dq', {'lo': 0.025, 'hi': 0.975})})""", sql=f"""
SELECT cell_id, {r('CASE WHEN dq BETWEEN lo AND hi THEN dq END')} AS dq, coalesce(dq < lo OR dq > hi, false) AS trimmed FROM adv, cut""")
def _(t):
    return rnd(O.trim_central(cut_lineage(advected(t).select("cell_id", "dq")), "dq"))


@query("advection_summary", "A24", tables=CELLS, ctes=ADV + f""",
qq AS ({quantile_sql('adv', 'dq', {'p01': 0.01, 'p05': 0.05, 'p25': 0.25, 'p50': 0.5, 'p75': 0.75, 'p95': 0.95, 'p99': 0.99})}),
ag AS (SELECT min(dq) AS min, max(dq) AS max, avg(dq) AS mean, stddev_samp(dq) AS std FROM adv)""", sql=f"""
SELECT n, {sel('min', 'max', 'mean', 'std', 'p01', 'p05', 'p25', 'p50', 'p75', 'p95', 'p99')} FROM ag, qq""")
def _(t):
    return rnd(U.field_summary(cut_lineage(advected(t).select("cell_id", "dq")), "dq"))


@query("advection_sign_flip", "A24", tables=CELLS, ctes=ADV, sql=f"""
SELECT count(*) AS n, {r('corr(dq, -dq_flip)')} AS corr FROM adv WHERE dq IS NOT NULL AND dq_flip IS NOT NULL""")
def _(t):
    return rnd(U.field_corr(advected(t).withColumn("neg", -F.col("dq_flip")), "dq", "neg"))


def _sample(sign: str, tag: str) -> str:
    fx, fy = f"least(greatest((x_m {sign} 1e2 * ex) / 1e2, 0e0), 124e0)", f"least(greatest((y_m {sign} 1e2 * ey) / 1e2, 0e0), cast(mr AS double))"
    return f"""{tag} AS (SELECT p.cell_id, (a.ts * (1 - u) + b.ts * u) * (1 - v) + (c.ts * (1 - u) + d.ts * u) * v AS s FROM
 (SELECT cell_id, i, j, fx - i AS u, fy - j AS v FROM (SELECT *, cast(least(floor(fx), 123) AS int) AS i, cast(least(floor(fy), mr - 1) AS int) AS j
  FROM (SELECT cell_id, mr, {fx} AS fx, {fy} AS fy FROM adv, bounds))) p
 LEFT JOIN cells a ON a.ci = i AND a.ri = j LEFT JOIN cells b ON b.ci = i + 1 AND b.ri = j
 LEFT JOIN cells c ON c.ci = i AND c.ri = j + 1 LEFT JOIN cells d ON d.ci = i + 1 AND d.ri = j + 1)"""


@query("gradient_sampled_check", "A25 J2", tables=CELLS, ctes=ADV + ", " + _sample("+", "fw") + ", " + _sample("-", "bw") + """,
er AS (SELECT abs((fw.s - bw.s) / 2e2 - dts) AS err FROM adv JOIN fw ON fw.cell_id = adv.cell_id JOIN bw ON bw.cell_id = adv.cell_id)""",
       sql=f"SELECT n, {sel('p50', 'p95')} FROM ({quantile_sql('er', 'err', {'p50': 0.5, 'p95': 0.95})})")
def _(t):
    nrows = G.extents(t.cells).first()["r1"] + 1
    return rnd(U.gradient_check(advected(t), "ts", "dts", STEP, NCOLS, nrows))


@query("depth_integral_check", "A25", tables=CELLS, ctes=ADV + """,
er AS (SELECT abs(917e0 * (152.5e0 + 7.122e0 * ts) * 5e-1 * speed / 31556926e0 * h / 199e0 *
 (199e0 * dts + 5e-1 * g0 * (dh / h - dmb / 31556926e0 / greatest(mb / 31556926e0, 1e-12)) * h / 199e0 * (198e0 * 199e0 / 2e0 + 199e0 / 2e0)) - dq) AS err
 FROM adv WHERE dq IS NOT NULL AND h > 0)""", sql=f"SELECT n, {sel('p50', 'p95')} FROM ({quantile_sql('er', 'err', {'p50': 0.5, 'p95': 0.95})})")
def _(t):
    return rnd(U.depth_check(advected(t), "dq"))


# Summaries -------------------------------------------------------------------------------------

_LEVELS = {k: v for k, v in U.LEVELS.items()}


@query("specularity_summary", "A8", tables=CELLS, ctes=MASKED + f""",
tagged AS (SELECT 'ROI' AS mask, q FROM roi UNION ALL SELECT 'VIZ', q FROM masked WHERE slow UNION ALL SELECT 'REG', q FROM masked WHERE valid),
qq AS ({quantile_sql('tagged', 'q', _LEVELS, 'mask')}),
ag AS (SELECT mask, min(q) AS min, max(q) AS max, avg(q) AS mean, stddev_samp(q) AS std FROM tagged WHERE q IS NOT NULL GROUP BY mask)""",
       sql=f"SELECT ag.mask, n, {sel('min', 'max', 'mean', 'std', *_LEVELS)} FROM ag JOIN qq ON ag.mask = qq.mask")
def _(t):
    masks = {"ROI": F.col("roi"), "VIZ": F.col("viz"), "REG": F.col("valid")}
    return rnd(U.summarize(masked(t), "q", masks))


@query("quantiles_midpoint", "A20", tables=CELLS, ctes=CLEAN + """, v AS (SELECT custkey % 7 AS grp, h FROM clean)""",
       sql=f"SELECT grp, n, {sel('a', 'b', 'c', 'd')} FROM ({quantile_sql('v', 'h', {'a': 0.0, 'b': 0.1, 'c': 0.5, 'd': 0.999}, 'grp')})")
def _(t):
    df = clean_cells(t).select((F.col("custkey") % 7).alias("grp"), "h")
    return rnd(O.midpoint_quantile(df, "h", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999}, ["grp"]))


@query("logistic_calibration", "A21", tables=CELLS, ctes=MASKED + f""", a AS ({quantile_sql('roi', 'q', {'sc_low': 0.5, 'sc_high': 0.95})})""",
       sql=f"""SELECT {sel('sc_low', 'sc_high', 'k')}, {r('sc_low - ln(6e-1 / 4e-1) / k')} AS tmid FROM (
 SELECT *, (ln(95e-2 / 5e-2) - ln(6e-1 / 4e-1)) / greatest(sc_high - sc_low, 2.220446049250313e-16) AS k FROM a)""")
def _(t):
    return rnd(U.calibrate_logistic(masked(t).filter("roi"), "q"))


@query("coverage_shares", "A16", tables=CELLS, ctes=MASKED, sql=f"""
SELECT count(*) AS n_reg, count(*) FILTER (slow) AS n_viz, count(*) FILTER (slow AND coalesce(sink, false)) AS n_roi,
 {r('1e2 * count(*) FILTER (slow AND coalesce(sink, false)) / count(*)')} AS roi_pct,
 {r('1e2 * avg(CASE WHEN q IS NULL THEN 1e0 ELSE 0e0 END)')} AS pct_missing_q, 0e0 AS pct_missing_h, 0e0 AS pct_missing_icevel,
 {r('1e2 * avg(CASE WHEN slow AND coalesce(sink, false) THEN CASE WHEN q > 2e-1 THEN 1e0 ELSE 0e0 END END)')} AS base_rate_pct FROM masked""")
def _(t):
    from meltgrid.functions.truth import truth_binary
    return rnd(U.coverage_report(masked(t).withColumn("y", truth_binary(F.col("q"), 0.2))))


_BINS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@query("weight_diagnostics", "A17", tables=CELLS, ctes=LABELLED, sql="SELECT count(*) AS n, " + ", ".join([
    f"{r('avg(y)')} AS wet_share", f"{r('avg(w)')} AS mean_weight",
    *[f"{r(f'avg(CASE WHEN w >= {a}e0 AND w ' + ('<=' if i == 5 else '<') + f' {b}e0 THEN 1e0 ELSE 0e0 END)')} AS share_{i}"
      for i, (a, b) in enumerate(zip(_BINS, _BINS[1:]))],
    f"{r('avg(CASE WHEN (y = 1) <> (w > 5e-1) THEN 1e0 ELSE 0e0 END)')} AS disagree",
    f"{r('pow(sum(w), 2) / sum(w * w)')} AS ess_wet", f"{r('pow(sum(1 - w), 2) / sum((1 - w) * (1 - w))')} AS ess_dry",
    f"{r('avg(CASE WHEN w BETWEEN 25e-2 AND 75e-2 THEN 1e0 ELSE 0e0 END)')} AS ambiguous"]) + " FROM labelled")
def _(t):
    return rnd(U.weight_diagnostics(labelled(t)))


@query("correction_change", "A18", tables=CM, ctes=f"""ch AS (SELECT model, g * ((custkey % 61 - 30) / 1e2 + 5e-3) AS abs, 1e2 * ((custkey % 61 - 30) / 1e2 + 5e-3) AS pct
 FROM cells c JOIN model_cells m ON m.cell_id = c.cell_id WHERE g IS NOT NULL AND g <> 0),
qa AS ({quantile_sql('ch', 'abs', {'abs_p05': 0.05, 'abs_median': 0.5, 'abs_p95': 0.95}, 'model')}),
qp AS ({quantile_sql('ch', 'pct', {'pct_p05': 0.05, 'pct_median': 0.5, 'pct_p95': 0.95}, 'model')}),
ag AS (SELECT model, count(*) AS n, avg(abs) AS abs_mean, stddev_samp(abs) AS abs_std, avg(pct) AS pct_mean, stddev_samp(pct) AS pct_std,
 avg(CASE WHEN abs(pct) > 5 THEN 1e0 ELSE 0e0 END) AS frac_gt_05, avg(CASE WHEN abs(pct) > 10 THEN 1e0 ELSE 0e0 END) AS frac_gt_10,
 avg(CASE WHEN abs(pct) > 25 THEN 1e0 ELSE 0e0 END) AS frac_gt_25 FROM ch GROUP BY model)""", sql=f"""
SELECT ag.model, ag.n, {sel('abs_mean', 'abs_std', 'pct_mean', 'pct_std', 'frac_gt_05', 'frac_gt_10', 'frac_gt_25', 'abs_p05', 'abs_median', 'abs_p95', 'pct_p05', 'pct_median', 'pct_p95')}
FROM ag JOIN qa ON qa.model = ag.model JOIN qp ON qp.model = ag.model""")
def _(t):
    # Half-percent steps keep every change clear of the reported limits.
    df = t.cells.join(t.model_cells, "cell_id")
    df = df.withColumn("after", F.col("g") + F.col("g") * ((F.col("custkey") % 61 - 30) / 100.0 + 0.005))
    return rnd(U.change_stats(df, "g", "after", ["model"]))


@query("histogram_fixed", "A19", tables=CELLS, ctes=CLEAN + """, b AS (SELECT coalesce(ispb, false) AS inner_part, cast(CASE WHEN q >= 4e-1 THEN 4 ELSE floor(q / 1e-1 + 1e-9) END AS int) AS bin
 FROM clean WHERE q BETWEEN 0 AND 5e-1),
g AS (SELECT inner_part, bin FROM (SELECT DISTINCT inner_part FROM b), (SELECT unnest([0, 1, 2, 3, 4]) AS bin))""", sql=f"""
SELECT g.inner_part, g.bin, {r('g.bin * 1e-1')} AS lo, {r('(g.bin + 1) * 1e-1')} AS hi, count(b.bin) AS n,
 {r('count(b.bin) / sum(count(b.bin)) OVER (PARTITION BY g.inner_part) / 1e-1')} AS value
FROM g LEFT JOIN b ON b.bin = g.bin AND b.inner_part = g.inner_part GROUP BY g.inner_part, g.bin""")
def _(t):
    df = clean_cells(t).withColumn("inner_part", F.coalesce("ispb", F.lit(False)))
    edges = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]
    return rnd(O.histogram(df, "q", [e - 1e-10 if 0 < e < 0.5 else e for e in edges], "pdf", ["inner_part"]))


@query("histogram_percentile_edges", "A19 A20", tables=CELLS, ctes=f"""e AS ({quantile_sql('cells', 'h', {'lo': 0.005, 'hi': 0.995})}),
b AS (SELECT least(floor((h - lo) / ((hi - lo) / 60e0)), 59) AS bin FROM cells, e WHERE h BETWEEN lo AND hi)""",
       sql="SELECT cast(sum(n) AS bigint) AS n, cast(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS bigint) AS filled, cast(max(n) AS bigint) AS top FROM (SELECT count(*) AS n FROM b GROUP BY bin)")
def _(t):
    h = O.histogram(t.cells, "h", O.percentile_edges(t.cells, "h", 0.005, 0.995, 60), "count")
    return h.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("filled"), F.max("n").alias("top"))


@query("floor_cap_shares", "A22", tables=CM, sql=f"""
SELECT model, {r('min(v)')} AS min, {r('max(v)')} AS max, {r('avg(v)')} AS mean, {r('avg(CASE WHEN v <= 4e1 THEN 1e0 ELSE 0e0 END)')} AS f_floor,
 {r('avg(CASE WHEN v >= 6e1 THEN 1e0 ELSE 0e0 END)')} AS f_cap FROM (SELECT model, least(greatest(g, 4e1), 6e1) AS v FROM model_cells WHERE g IS NOT NULL) GROUP BY model""")
def _(t):
    from meltgrid.functions.mathx import clamp
    return rnd(U.clip_stats(t.model_cells.withColumn("v", clamp(F.col("g"), 40.0, 60.0)), "v", 40.0, 60.0, ["model"]))


@query("row_orientation", "A30", tables=CELLS, ctes=MASKED + f""", cut AS ({quantile_sql('roi', 'h', {'c': 0.8})})""", sql=f"""
SELECT n, {sel('as_is', 'flipped')}, flipped > as_is + 2e-2 AS suspect FROM (
 SELECT count(*) AS n, avg(CASE WHEN (a.h >= c) = (a.q > 2e-1) THEN 1e0 ELSE 0e0 END) AS as_is,
 avg(CASE WHEN coalesce(b.h >= c, false) = (a.q > 2e-1) THEN 1e0 ELSE 0e0 END) AS flipped
 FROM roi a LEFT JOIN cells b ON b.ci = a.ci AND b.ri = (SELECT min(ri) + max(ri) FROM cells) - a.ri, cut)""")
def _(t):
    from meltgrid.functions.truth import truth_binary
    df = masked(t).withColumn("y", truth_binary(F.col("q"), 0.2))
    return rnd(U.orientation_check(df, "h", "y", F.col("roi")))


# Radar roughness -------------------------------------------------------------------------------

def _curve(t):
    """Specularity over a roughness grid for one geometry per supplier."""
    geo = t.read("supplier").select("s_suppkey", (1500.0 + 15.0 * (F.col("s_suppkey") % 100)).alias("d"), F.lit(500.0).alias("h"))
    grid = geo.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(100)))).withColumn("rms", F.col("i") / 2.0)
    return grid.withColumn("sc", X.specularity(F.col("d"), F.col("h"), F.col("rms")))


_ROOT = math.sqrt(3.15)
CURVE = f"""geo AS (SELECT s_suppkey, 15e2 + 15e0 * (s_suppkey % 100) AS d, 5e2 AS h FROM supplier),
ang AS (SELECT *, 2e0 * atan(sqrt((2e0 * 299792458e0 / 6e7) * (h + d * {_ROOT!r})) / (2e0 * d)) AS pf,
 2e0 * atan(35e1 / (d * {_ROOT!r})) AS a1, 2e0 * atan(1e3 / (d * {_ROOT!r})) AS a2 FROM geo),
arg AS (SELECT *, i / 2e0 AS rms, 1e0 / (2e0 * (4e0 * pi() * (i / 2e2) * 6e7 * {_ROOT!r}) / 299792458e0) AS inv FROM ang, range(1, 101) AS g(i)),
en AS (SELECT *, {erf_sql('(a1 / pf * inv)')} * {erf_sql('inv')} AS e1, {erf_sql('(a2 / pf * inv)')} * {erf_sql('inv')} AS e2 FROM arg),
sp AS (SELECT *, (e2 - e1) / ((a2 - a1) / pi()) AS df FROM en),
curve AS (SELECT s_suppkey, d, rms, greatest(least((e1 - df * a1 / pi()) / (e1 - df * a1 / pi() + df), 1e0), 0e0) AS sc FROM sp)"""


@query("roughness_curve", "P31", ctes=CURVE, sql=f"SELECT s_suppkey, rms, {r('sc')} AS sc FROM curve")
def _(t):
    return rnd(_curve(t).select("s_suppkey", "rms", "sc"))


@query("roughness_limits", "W7", ctes=CURVE, sql="""
SELECT s_suppkey, max(CASE WHEN sc >= 2e-1 THEN rms END) AS "limit" FROM curve GROUP BY s_suppkey""")
def _(t):
    return last_meeting(_curve(t), "sc", 0.2, "rms", ["s_suppkey"])


@query("name_parts", "P32", ctes="""n AS (SELECT DISTINCT s_name AS model FROM supplier UNION SELECT DISTINCT 'Flat_' || (s_suppkey % 61 + 20) FROM supplier
 UNION SELECT DISTINCT n_name || ' 2-b ' FROM nation UNION SELECT DISTINCT s_suppkey || ' Model' FROM supplier)""", sql="""
SELECT model, starts_with(model, 'Flat_') AS is_flat, CASE WHEN starts_with(model, 'Flat_') THEN cast(regexp_extract(model, '^Flat_([0-9.]+)', 1) AS double) END AS flat_value,
 CASE WHEN regexp_matches(v, '^[A-Za-z]') THEN v ELSE 'x' || v END AS valid_name, lower(trim(model)) AS name_key
FROM (SELECT model, regexp_replace(array_to_string(list_transform(string_split_regex(model, '\\s+'), lambda w, i: CASE WHEN i > 1 THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END), ''), '[^A-Za-z0-9_]', '_', 'g') AS v FROM n)""")
def _(t):
    s, n = t.read("supplier"), t.read("nation")
    names = (s.select(F.col("s_name").alias("model"))
             .union(s.select(F.concat(F.lit("Flat_"), (F.col("s_suppkey") % 61 + 20).cast("string"))))
             .union(n.select(F.concat("n_name", F.lit(" 2-b "))))
             .union(s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(" Model"))))).distinct()
    return with_name_parts(names)

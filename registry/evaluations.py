"""Whole evaluations on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltgrid.plans import candidates as P
from meltgrid.plans import evaluation as E
from meltgrid.plans import report
from registry.base import query, r, rnd, sel
from registry.fields import PRIOR, SCORE, arena
from registry.physics import ADV
from registry.frames import (MASKED, STEP, MASS_COLS, REG_COLS, REGIONAL_SUMS, SCORE_COLS, SOFT, gmin_sql, phi_sql,
                             quantile_sql, regional_sql, score_sql)

CM = ("cells", "model_cells")


def config(**kw):
    return E.EvalConfig(margin_mode="auto_median", **kw)


EVAL = MASKED + f""",
an AS ({quantile_sql('roi', 'q', {'lo': 0.5, 'hi': 0.95})}),
cal AS (SELECT k, lo - ln(6e-1 / 4e-1) / k AS tmid FROM (SELECT *, (ln(95e-2 / 5e-2) - ln(6e-1 / 4e-1)) / (hi - lo) AS k FROM an)),
lb AS (SELECT *, CASE WHEN q > 2e-1 THEN 1 ELSE 0 END AS y, 1e0 / (1e0 + exp(-(k * (q - tmid)))) AS w, {gmin_sql()} AS gmin FROM roi, cal),
mr AS (SELECT lb.*, model, g - gmin AS gdiff, coalesce(sigma, abs(bmax - bmin) / 3.92e0, 0e0) AS s FROM lb JOIN model_cells m ON m.cell_id = lb.cell_id
 UNION ALL SELECT lb.*, 'Flat_' || v, v - gmin, 0e0 FROM lb, range(20, 81) AS f(v)),
sm AS ({quantile_sql('mr', 's', {'med': 0.5}, 'model')}),
mg AS (SELECT median(med) AS margin FROM sm WHERE model NOT LIKE 'Flat%'),
pr AS (SELECT *, coalesce(gdiff >= margin, false) AS pred, CASE WHEN s = 0 THEN CASE WHEN gdiff >= margin THEN 1e0 ELSE 0e0 END ELSE {phi_sql('(gdiff - margin) / sqrt(greatest(s * s, 2.220446049250313e-16))')} END AS pw FROM mr, mg)"""


@query("evaluation_expected", "A3 A4 A11 A21 P14", tables=CM, ctes=EVAL + f""",
c AS (SELECT model, count(*) AS n_roi, {SOFT.format(p='pw', y='w')}, {REGIONAL_SUMS.format(p='pw', y='w')} FROM pr WHERE pw IS NOT NULL GROUP BY model)""",
       sql=f"SELECT model, n_roi, {sel(*MASS_COLS, *SCORE_COLS, *REG_COLS)} FROM ({regional_sql('(' + score_sql('c') + ')')})")
def _(t):
    return rnd(E.evaluate(t.cells, t.model_cells, config())["expected"])


MOVED = EVAL.replace("SELECT lb.*, model, g - gmin AS gdiff", "SELECT lb.*, model, g * (1e0 + (custkey % 7 - 3) / 1e2) - (gmin - adv) AS gdiff").replace(
    "m.cell_id = lb.cell_id", "m.cell_id = lb.cell_id JOIN av ON av.cell_id = lb.cell_id").replace(
    "'Flat_' || v, v - gmin, 0e0 FROM lb,", "'Flat_' || v, v * (1e0 + (custkey % 7 - 3) / 1e2) - (gmin - adv), 0e0 FROM lb JOIN av ON av.cell_id = lb.cell_id,")


@query("evaluation_with_advection", "P9 P12 A23", tables=CM, ctes=ADV + f""",
cut AS ({quantile_sql('adv', 'dq', {'lo': 0.025, 'hi': 0.975})}),
av AS (SELECT cell_id, CASE WHEN dq BETWEEN cut.lo AND cut.hi THEN 1e3 * dq END AS adv FROM adv, cut),
""" + MOVED + f""",
c AS (SELECT model, count(*) AS n_roi, {SOFT.format(p='pw', y='w')}, {REGIONAL_SUMS.format(p='pw', y='w')} FROM pr WHERE pw IS NOT NULL GROUP BY model)""",
       sql=f"SELECT model, n_roi, {sel(*MASS_COLS, *SCORE_COLS, *REG_COLS)} FROM ({regional_sql('(' + score_sql('c') + ')')})")
def _(t):
    """Margins with the advected flux and a topographic factor."""
    cells = t.cells.withColumn("delta", (F.col("custkey") % 7 - 3) / 100.0)
    return rnd(E.evaluate(cells, t.model_cells, config(advection_step=STEP))["expected"])


@query("evaluation_weighted_points", "A6", tables=CM, ctes=EVAL + f""",
c AS (SELECT model, count(*) AS n_roi, {SOFT.format(p='(CASE WHEN pred THEN 1e0 ELSE 0e0 END)', y='w')}, {REGIONAL_SUMS.format(p='(CASE WHEN pred THEN 1e0 ELSE 0e0 END)', y='w')} FROM pr GROUP BY model)""",
       sql=f"SELECT model, n_roi, {sel(*MASS_COLS, *SCORE_COLS, *REG_COLS)} FROM ({regional_sql('(' + score_sql('c') + ')')})")
def _(t):
    return rnd(E.evaluate(t.cells, t.model_cells, config())["weighted"])


@query("evaluation_report_table", "A29 W5 B6 B7", tables=CM, ctes=EVAL + f""",
c AS (SELECT model, {SOFT.format(p='pw', y='y')} FROM pr WHERE pw IS NOT NULL GROUP BY model),
ce AS (SELECT model, median(g) AS center FROM masked k JOIN model_cells m ON m.cell_id = k.cell_id WHERE slow GROUP BY model UNION ALL SELECT 'Flat_' || v, v FROM range(20, 81) AS f(v))""",
       sql=f"SELECT c.model, {r('center')} AS center, {r('g_mean')} AS exp, c.model LIKE 'Flat%' AS is_flat, true AS good, true AS ordered FROM ({score_sql('c')}) c JOIN ce ON ce.model = c.model")
def _(t):
    """Report table; the bands come from the exact-count bootstrap, so only their order is checked."""
    out = E.evaluate(t.cells, t.model_cells, config(truth="binary"))
    table = report.metric_table(out["gstats"], out["centers"], "g_mean")
    ordered = (F.col("lo95") <= F.col("lo50")) & (F.col("lo50") <= F.col("hi50")) & (F.col("hi50") <= F.col("hi95"))
    return rnd(table.select("model", "center", "exp", "is_flat", "good", ordered.alias("ordered")))


@query("evaluation_threshold_runs", "B8 B3", tables=CM, ctes=MASKED.replace("WHERE slow AND coalesce(sink, false)", "WHERE slow") + f""",
mr AS (SELECT c.*, model, g - {gmin_sql()} AS gdiff, coalesce(sigma, abs(bmax - bmin) / 3.92e0, 0e0) AS s FROM roi c JOIN model_cells m ON m.cell_id = c.cell_id
 UNION ALL SELECT c.*, 'Flat_' || v, v - {gmin_sql()}, 0e0 FROM roi c, range(20, 81) AS f(v)),
pr AS (SELECT *, CASE WHEN s = 0 THEN CASE WHEN gdiff >= 0 THEN 1e0 ELSE 0e0 END ELSE {phi_sql('gdiff / sqrt(greatest(s * s, 2.220446049250313e-16))')} END AS pw FROM mr),
c AS (SELECT model, threshold, {SOFT.format(p='pw', y='(CASE WHEN q > threshold THEN 1e0 ELSE 0e0 END)')} FROM pr, (SELECT unnest([1e-1, 15e-2, 2e-1, 25e-2, 3e-1]) AS threshold) WHERE pw IS NOT NULL GROUP BY model, threshold)""",
       sql=f"SELECT model, threshold, {r('g_mean')} AS exp, true AS ordered FROM ({score_sql('c')})")
def _(t):
    t = t.written()
    out = E.sweep(t.cells, t.model_cells).filter("metric = 'g_mean'")
    ordered = (F.col("lo95") <= F.col("lo50")) & (F.col("lo50") <= F.col("hi50")) & (F.col("hi50") <= F.col("hi95"))
    return rnd(out.select("model", "threshold", "exp", ordered.alias("ordered")))


@query("candidate_search", "M1 M2 M3 M4 P30", tables=("cells", "candidates"), ctes=SCORE + f""",
px AS (SELECT f.mu, f.a, f.theta, sqrt(count(*) FILTER (q > 25e-2 AND g >= m) / greatest(count(*) FILTER (q > 25e-2), 1) * (count(*) FILTER (q <= 25e-2 AND g < m) / greatest(count(*) FILTER (q <= 25e-2), 1))) AS proxy
 FROM field f JOIN (SELECT mu, a, theta, median(g) AS m FROM field WHERE slow GROUP BY mu, a, theta) h ON h.mu = f.mu AND h.a = f.a AND h.theta = f.theta WHERE slow GROUP BY f.mu, f.a, f.theta),
po AS (SELECT sc.mu, sc.a, sc.theta, 6e0 * sqrt(rec * spec) {PRIOR.replace('mu)', 'sc.mu)').replace('abs(a)', 'abs(sc.a)')} AS posterior FROM sc JOIN px ON px.mu = sc.mu AND px.a = sc.a AND px.theta = sc.theta WHERE proxy >= 45e-2)""",
       sql=f"SELECT mu, a, theta, {r('posterior')} AS posterior, {r('exp(posterior) / sum(exp(posterior)) OVER ()')} AS prob FROM po")
def _(t):
    return rnd(P.search(arena(t), t.candidates, proxy_gate=0.45).select("mu", "a", "theta", "posterior", "prob"))

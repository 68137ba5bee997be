"""Candidate fields and posterior tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltgrid.functions.truth import wet_prob
from meltgrid.operators import fields as Y
from meltgrid.operators import posterior as Q
from registry.base import query, r, rnd, sel
from registry.frames import MASKED, clean_cells, gmin_sql, quantile_sql
from meltgrid.functions.physics import gmin
from meltgrid.functions.truth import truth_binary
from meltgrid.operators.masks import MaskConfig, with_masks

CELLS = ("cells",)
CC = ("cells", "candidates")


def arena(t):
    """All grid cells with the scored subset marked and both labels."""
    df = with_masks(clean_cells(t), MaskConfig(gate_sinks=False))
    return df.withColumns({
        "spec_valid": F.col("q").isNotNull(), "gmin": gmin(F.col("h"), F.col("ts"), F.col("mb")),
        "y": truth_binary(F.col("q"), 0.25), "w": wet_prob(F.col("q"), "linear_clip", sc0=0.15, sc1=0.4)})


def _field(mu: str = "mu", a: str = "a", theta: str = "theta", lo: str = "2e1", hi: str = "1e2") -> str:
    """Candidate field on every cell: ramp, limits, recentring, limits."""
    return f"""cen AS (SELECT *, x_m - avg(x_m) OVER () AS xc, y_m - avg(y_m) OVER () AS yc FROM masked),
proj AS (SELECT c.*, k.mu, k.a, k.theta, xc * cos(radians(theta)) + yc * sin(radians(theta)) AS p FROM cen c, candidates k),
ramp AS (SELECT *, 2e0 * (p - (min(p) OVER (PARTITION BY theta) + max(p) OVER (PARTITION BY theta)) / 2e0)
 / (max(p) OVER (PARTITION BY theta) - min(p) OVER (PARTITION BY theta)) AS u FROM proj),
raw AS (SELECT *, mu + a * u AS g0, avg(mu + a * u) OVER (PARTITION BY mu, a, theta) AS before FROM ramp),
field AS (SELECT *, least(greatest(least(greatest(g0, {lo}), {hi}) - before + mu, {lo}), {hi}) AS g FROM raw)"""


FIELD = MASKED.replace("roi AS (SELECT * FROM masked WHERE slow AND coalesce(sink, false))", "roi AS (SELECT * FROM masked WHERE slow)") + ",\n" + _field()


@query("gradient_field", "P27", tables=CELLS, ctes="""cen AS (SELECT cell_id, (x_m - avg(x_m) OVER ()) * cos(radians(-27.5e0 + 90)) + (y_m - avg(y_m) OVER ()) * sin(radians(-27.5e0 + 90)) AS p FROM cells)""",
       sql=f"SELECT cell_id, {r('44.5e0 + 2e1 * 2e0 * (p - (min(p) OVER () + max(p) OVER ()) / 2e0) / (max(p) OVER () - min(p) OVER ())')} AS g_syn FROM cen")
def _(t):
    # Angle given across the gradient; the negative amplitude turns the direction round.
    return rnd(Y.gradient_field(t.cells, 44.5, -20.0, -27.5, perpendicular=True).select("cell_id", "g_syn"))


@query("field_gated", "P28 P27", tables=CC, ctes=FIELD, sql=f"""
SELECT cell_id, {r('g')} AS g_syn FROM field WHERE mu = 40 AND a = 40 AND theta = 60""")
def _(t):
    df = Y.gradient_field(t.cells, 40.0, 40.0, 60.0)
    return rnd(Y.gate_field(df, "g_syn", 20.0, 100.0, 40.0).select("cell_id", "g_syn"))


@query("field_exact_mean", "P29", tables=CELLS, ctes="""k AS (SELECT unnest([2e1 - g, 45e0 - g]) AS b, unnest([1, -1]) AS dn FROM (SELECT ci * 5e-1 + custkey % 40 AS g FROM cells)),
steps AS (SELECT b, sum(dn) AS dn FROM k GROUP BY b),
walk AS (SELECT b, sum(dn) OVER (ORDER BY b) AS slope, lead(b) OVER (ORDER BY b) AS nb FROM steps),
area AS (SELECT b, nb, slope, coalesce(sum(slope * (nb - b)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM walk),
need AS (SELECT (33e0 - 2e1) * count(*) AS target FROM cells),
off AS (SELECT max(b + (target - before) / slope) AS b FROM area, need WHERE slope > 0 AND before < target AND target <= before + slope * (nb - b))""", sql=f"""
SELECT cell_id, {r('least(greatest(ci * 5e-1 + custkey % 40 + b, 2e1), 45e0)', 5)} AS g FROM cells, off""")
def _(t):
    df = t.cells.select("cell_id", (F.col("ci") * 0.5 + F.col("custkey") % 40).alias("g"))
    return rnd(Y.clamp_exact_mean(df, "g", 33.0, 20.0, 45.0), 5)


@query("candidate_priors", "P30", tables=("chain",), ctes="""wide AS (SELECT iter, 2 * mu - 40e0 AS mu, 15e-1 * a AS a, 3 * theta_deg AS theta FROM chain),
pr AS (SELECT iter,
 -(CASE WHEN mu < 20 THEN pow((20 - mu) / 3e0, 2) WHEN mu > 150 THEN pow((mu - 150) / 3e0, 2) ELSE 0e0 END)
 -(CASE WHEN a < -150 THEN pow((-150 - a) / 3e0, 2) WHEN a > 150 THEN pow((a - 150) / 3e0, 2) ELSE 0e0 END)
 -(CASE WHEN theta < -90 THEN pow((-90 - theta) / 3e0, 2) WHEN theta > 90 THEN pow((theta - 90) / 3e0, 2) ELSE 0e0 END)
 - pow(greatest(least(greatest(least((2e1 - mu) / greatest(abs(a), 2.220446049250313e-16), 1e0) + 1e0, 0e0) / 2e0, 1e0),
   least(greatest(1e0 - greatest((1e2 - mu) / greatest(abs(a), 2.220446049250313e-16), -1e0), 0e0) / 2e0, 1e0)), 2) / 15e-2 AS soft,
 -5e-1 * pow((mu - 85) / 65e0, 2) - 5e-1 * pow(a / 150e0, 2)
 - 5e-1 * pow((CASE WHEN theta > 180 THEN theta - 360 * ceil((theta - 180) / 360e0) WHEN theta < -180 THEN theta + 360 * ceil((-180 - theta) / 360e0) ELSE theta END) / 90e0, 2) AS gauss FROM wide)""",
       sql=f"SELECT iter, {r('soft', 4)} AS soft, {r('gauss')} AS gauss FROM pr")
def _(t):
    wide = t.chain.select("iter", (2.0 * F.col("mu") - 40.0).alias("mu"), (1.5 * F.col("a")).alias("a"),
                          (3.0 * F.col("theta_deg")).alias("theta"))
    out = Y.log_prior(wide, "softbox").withColumnRenamed("log_prior", "soft")
    out = Y.log_prior(out, "gaussian", clip_k=None).withColumnRenamed("log_prior", "gauss")
    return out.select("iter", F.round("soft", 4).alias("soft"), F.round("gauss", 6).alias("gauss"))


SCORE = FIELD + f""",
ev AS (SELECT mu, a, theta, g, q, slow, CASE WHEN q > 25e-2 THEN 1 ELSE 0 END AS y, greatest(least((q - 15e-2) / 25e-2, 1e0), 0e0) + q * 0 AS w,
 coalesce(g - {gmin_sql()} >= 0, false) AS wet FROM field),
sm AS (SELECT mu, a, theta, avg(g) AS mu_grid, median(g) FILTER (q IS NOT NULL) AS med_spec,
 sum(CASE WHEN slow AND wet THEN w ELSE 0e0 END) AS tp, sum(CASE WHEN slow AND NOT wet THEN w ELSE 0e0 END) AS fn,
 sum(CASE WHEN slow AND wet THEN 1 - w ELSE 0e0 END) AS fp, sum(CASE WHEN slow AND NOT wet THEN 1 - w ELSE 0e0 END) AS tn,
 sum(CASE WHEN slow AND wet THEN y ELSE 0 END) AS tpb, sum(CASE WHEN slow AND NOT wet THEN y ELSE 0 END) AS fnb,
 sum(CASE WHEN slow AND wet THEN 1 - y ELSE 0 END) AS fpb, sum(CASE WHEN slow AND NOT wet THEN 1 - y ELSE 0 END) AS tnb FROM ev GROUP BY mu, a, theta),
sc AS (SELECT mu, a, theta, mu_grid, med_spec, tp / (tp + fn) AS rec, tn / (tn + fp) AS spec, tpb / greatest(tpb + fnb, 1) AS recb, tnb / greatest(tnb + fpb, 1) AS specb FROM sm)"""


@query("candidate_scores", "M1 J15", tables=CC, ctes=SCORE, sql=f"""
SELECT mu, a, theta, {r('sqrt(rec * spec)')} AS g_mean, {sel('rec', 'spec', 'mu_grid', 'med_spec')} FROM sc""")
def _(t):
    return rnd(Y.score_candidates(arena(t), t.candidates))


@query("candidate_scores_hard", "M1", tables=CC, ctes=SCORE, sql=f"""
SELECT mu, a, theta, {r('sqrt(recb * specb)')} AS g_mean, {r('recb')} AS rec, {r('specb')} AS spec FROM sc""")
def _(t):
    return rnd(Y.score_candidates(arena(t), t.candidates, Y.FieldConfig(truth="binary")).drop("mu_grid", "med_spec"))


@query("candidate_scores_topographic", "M1 P9", tables=CC, ctes=FIELD.replace("mu + a * u AS g0, avg(mu + a * u)", "(mu + a * u) * (1 + (custkey % 7 - 3) / 1e2) AS g0, avg((mu + a * u) * (1 + (custkey % 7 - 3) / 1e2))") + f""",
ev AS (SELECT mu, a, theta, g, q, slow, greatest(least((q - 15e-2) / 25e-2, 1e0), 0e0) + q * 0 AS w, coalesce(g - {gmin_sql()} >= 0, false) AS wet FROM field)""", sql=f"""
SELECT mu, a, theta, {r('sum(CASE WHEN slow AND wet THEN w ELSE 0e0 END) / sum(CASE WHEN slow THEN w END)')} AS rec, {r('avg(g)')} AS mu_grid,
 {r('median(g) FILTER (q IS NOT NULL)')} AS med_spec FROM ev GROUP BY mu, a, theta""")
def _(t):
    cells = arena(t).withColumn("delta", (F.col("custkey") % 7 - 3) / 100.0)
    return rnd(Y.score_candidates(cells, t.candidates, delta="delta").select("mu", "a", "theta", "rec", "mu_grid", "med_spec"))


@query("candidate_proxy", "M2", tables=CC, ctes=FIELD + """,
thr AS (SELECT mu, a, theta, median(g) AS m FROM field WHERE slow GROUP BY mu, a, theta)""", sql=f"""
SELECT f.mu, f.a, f.theta, {r('''sqrt(count(*) FILTER (q > 25e-2 AND g >= m) / greatest(count(*) FILTER (q > 25e-2), 1) *
 (count(*) FILTER (q <= 25e-2 AND g < m) / greatest(count(*) FILTER (q <= 25e-2), 1)))''')} AS proxy
FROM field f JOIN thr ON thr.mu = f.mu AND thr.a = f.a AND thr.theta = f.theta WHERE slow GROUP BY f.mu, f.a, f.theta""")
def _(t):
    return rnd(Y.proxy_score(arena(t), t.candidates))


PRIOR = """ - pow(greatest(least(greatest(least((2e1 - mu) / greatest(abs(a), 2.220446049250313e-16), 1e0) + 1e0, 0e0) / 2e0, 1e0),
   least(greatest(1e0 - greatest((1e2 - mu) / greatest(abs(a), 2.220446049250313e-16), -1e0), 0e0) / 2e0, 1e0)), 2) / 15e-2"""


@query("candidate_posterior", "M3 P30", tables=CC, ctes=SCORE + f""", po AS (SELECT mu, a, theta, 6e0 * sqrt(rec * spec) {PRIOR} AS posterior FROM sc)""", sql=f"""
SELECT mu, a, theta, {r('posterior')} AS posterior, {r('exp(posterior - max(posterior) OVER ()) / sum(exp(posterior)) OVER () * exp(max(posterior) OVER ())')} AS prob FROM po""")
def _(t):
    scores = Y.log_prior(Y.score_candidates(arena(t), t.candidates), "softbox")
    return rnd(Y.posterior_grid(scores).select("mu", "a", "theta", "posterior", "prob"))


@query("candidates_collapsed", "M4", tables=("chain",), sql="""
SELECT round(mu / 25e-2) * 25e-2 + 0e0 AS mu, round(a / 5e-1) * 5e-1 + 0e0 AS a, round(theta_deg / 2e0) * 2e0 + 0e0 AS theta, count(*) AS n FROM chain GROUP BY 1, 2, 3""")
def _(t):
    return Y.dedupe_candidates(t.chain.withColumnRenamed("theta_deg", "theta"))


# Chains ----------------------------------------------------------------------------------------

CH = ("chain",)
KEEP = """kept AS (SELECT * FROM chain WHERE iter >= (SELECT round(25e-2 * count(*)) FROM chain) AND (iter - (SELECT cast(round(25e-2 * count(*)) AS bigint) FROM chain)) % 2 = 0)"""


def kept(t):
    return Q.keep_draws(t.chain, 0.25, 2)


@query("chain_kept", "W8 M5", tables=CH, ctes=KEEP, sql="SELECT iter, mu, a, theta_deg, gmean FROM kept")
def _(t):
    return kept(t).select("iter", "mu", "a", "theta_deg", "gmean")


@query("chain_full_table", "M5 P30", tables=CH, sql=f"""
SELECT iter, mu, a, theta_deg, gmean, accepted, log_prior, {r('6e0 * least(greatest(gmean, 0e0), 1e0) + log_prior')} AS posterior
FROM (SELECT *, {r(PRIOR.strip().lstrip('-') .join(['-(', ')']))} AS log_prior FROM chain)""")
def _(t):
    df = Q.chain_table(t.chain)
    wide = F.col("mu").between(20, 150) & F.col("a").between(-150, 150) & F.col("theta_deg").between(-90, 90)
    soft = Y.softbox(F.col("a"), -150.0, 150.0, 3.0)
    prior = F.round(F.when(wide, F.col("log_prior")).otherwise(F.col("log_prior") + soft), 6)
    shift = prior - F.col("log_prior")
    return df.select("iter", "mu", "a", "theta_deg", "gmean", "accepted", prior.alias("log_prior"),
                     F.round(F.col("posterior") + shift, 6).alias("posterior"))


@query("chain_acceptance_best", "A28", tables=CH, sql=f"""
SELECT {r('avg(CASE WHEN accepted THEN 1e0 ELSE 0e0 END)')} AS acceptance, count(*) AS n, max(gmean) AS gmean,
 arg_max(iter, (gmean, -iter)) AS iter FROM chain""")
def _(t):
    return rnd(Q.chain_summary(t.chain).select("acceptance", "n", "gmean", "iter"))


@query("chain_running_best", "W9", tables=CH, sql="SELECT iter, max(gmean) OVER (ORDER BY iter) AS best FROM chain")
def _(t):
    return Q.running_best(t.chain).select("iter", "best")


BATCH = KEEP + """,
nb AS (SELECT count(*) AS n, greatest(10, floor(sqrt(count(*)))) AS k FROM kept),
rk AS (SELECT gmean, row_number() OVER (ORDER BY iter) AS i FROM kept),
used AS (SELECT gmean, floor((i - 1) / floor(n / k)) AS b, k FROM rk, nb WHERE i <= floor(n / k) * k),
bm AS (SELECT b, max(k) AS k, avg(gmean) AS m FROM used GROUP BY b)"""


@query("chain_batch_error", "A26", tables=CH, ctes=BATCH, sql=f"""
SELECT {r('mcse')} AS mcse, {r('v / pow(mcse, 2)', 4)} AS ess FROM (SELECT stddev_pop(m) / sqrt(max(k)) AS mcse FROM bm), (SELECT var_pop(gmean) AS v FROM used)""")
def _(t):
    out = Q.mcse(kept(t), "gmean", "iter")
    return out.select(F.round("mcse", 6).alias("mcse"), F.round("ess", 4).alias("ess"))


HPD = KEEP + """,
srt AS (SELECT gmean AS x, row_number() OVER (ORDER BY gmean) AS i, count(*) OVER () AS n FROM kept),
sp AS (SELECT a.x AS lo, b.x AS hi, a.i FROM srt a JOIN srt b ON b.i = a.i + cast(floor(95e-2 * a.n) AS bigint))"""


@query("chain_density_interval", "A27", tables=CH, ctes=HPD, sql=f"""
SELECT {r('arg_min(lo, (hi - lo, i))')} AS lo, {r('arg_min(hi, (hi - lo, i))')} AS hi FROM sp""")
def _(t):
    return rnd(Q.hpd(kept(t), "gmean", 0.05))


DIST = KEEP + """,
best AS (SELECT arg_max(mu, (gmean, -iter)) AS bm, arg_max(a, (gmean, -iter)) AS ba, arg_max(theta_deg, (gmean, -iter)) AS bt FROM kept),
st AS (SELECT stddev_samp(mu) AS sm, stddev_samp(a) AS sa, stddev_samp(theta_deg) AS st FROM kept),
dist AS (SELECT kept.*, sqrt(pow((mu - bm) / sm, 2) + pow((a - ba) / sa, 2) + pow((theta_deg - bt) / st, 2)) AS d FROM kept, best, st)"""


@query("chain_nearest_draws", "J10 T2", tables=CH, ctes=DIST, sql=f"SELECT iter, {r('d')} AS dist FROM dist ORDER BY d, iter LIMIT 500")
def _(t):
    return rnd(Q.nearest_draws(kept(t), 500).select("iter", "dist"))


TOP = DIST + f""", cut AS ({quantile_sql('kept', 'gmean', {'c': 0.95})}),
top AS (SELECT dist.* FROM dist, cut WHERE gmean >= c OR iter = (SELECT arg_min(iter, (d, iter)) FROM dist))"""


@query("chain_top_fraction", "T1", tables=CH, ctes=TOP, sql="SELECT iter, gmean FROM top")
def _(t):
    return Q.top_fraction(kept(t), 0.05).select("iter", "gmean")


LONG = TOP + """, long AS (SELECT iter, unnest(['gmean', 'mu', 'a', 'theta_deg']) AS param, unnest([gmean, mu, a, theta_deg]) AS x FROM top)"""


@query("chain_best_region", "M6 A20", tables=CH, ctes=LONG + f""",
qs AS ({quantile_sql('long', 'x', {'median': 0.5, 'lo50': 0.25, 'hi50': 0.75, 'lo95': 0.025, 'hi95': 0.975}, 'param')}),
srt AS (SELECT param, x, row_number() OVER (PARTITION BY param ORDER BY x) AS i, count(*) OVER (PARTITION BY param) AS n FROM long),
hp AS (SELECT a.param, arg_min(a.x, (b.x - a.x, a.i)) AS hpd_lo, arg_min(b.x, (b.x - a.x, a.i)) AS hpd_hi FROM srt a JOIN srt b ON b.param = a.param AND b.i = a.i + cast(floor(95e-2 * a.n) AS bigint) GROUP BY a.param),
rk AS (SELECT param, x, row_number() OVER (PARTITION BY param ORDER BY iter) AS i, count(*) OVER (PARTITION BY param) AS n FROM long),
used AS (SELECT param, x, greatest(10, floor(sqrt(n))) AS k, floor((i - 1) / floor(n / greatest(10, floor(sqrt(n))))) AS b FROM rk
 WHERE floor(n / greatest(10, floor(sqrt(n)))) >= 2 AND i <= floor(n / greatest(10, floor(sqrt(n)))) * greatest(10, floor(sqrt(n)))),
bm AS (SELECT param, b, max(k) AS k, avg(x) AS m FROM used GROUP BY param, b),
me AS (SELECT param, stddev_pop(m) / sqrt(max(k)) AS mcse FROM bm GROUP BY param), va AS (SELECT param, var_pop(x) AS v FROM used GROUP BY param)""", sql=f"""
SELECT qs.param, qs.n, {sel('median', 'lo50', 'hi50', 'lo95', 'hi95', 'hpd_lo', 'hpd_hi', 'mcse')}, {r('v / pow(mcse, 2)', 4)} AS ess
FROM qs JOIN hp ON hp.param = qs.param LEFT JOIN me ON me.param = qs.param LEFT JOIN va ON va.param = qs.param""")
def _(t):
    out = Q.best_region(kept(t), mode="topfrac")
    return rnd(out.drop("ess")).join(out.select("param", F.round("ess", 4).alias("ess")), "param")


@query("cumulative_weights", "W6", tables=CH, ctes="w AS (SELECT theta_deg AS theta, count(*) AS wt FROM chain GROUP BY theta_deg)", sql="""
SELECT theta, wt, cast(sum(wt) OVER (ORDER BY theta) AS bigint) AS cum_w FROM w""")
def _(t):
    from meltgrid.operators.ordered import cum_weight
    w = t.chain.groupBy(F.col("theta_deg").alias("theta")).agg(F.count(F.lit(1)).alias("wt"))
    return cum_weight(w, "wt", "theta")

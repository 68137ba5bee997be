"""Two-sample tests, ranks, distribution functions and detector sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltgrid.operators import ordered as O
from meltgrid.operators import sweeps as W
from meltgrid.operators import twosample as T2
from registry.base import query, r, rnd, sel
from registry.frames import CLEAN, clean_cells, phi_sql, quantile_sql, uniform_sql

CELLS = ("cells",)


def observed(t):
    return clean_cells(t).withColumn("q", F.when(F.col("q") > 0, F.col("q")))


OBS = CLEAN + """, obs AS (SELECT cell_id, ri, ci, CASE WHEN q > 0 THEN q END AS q, coalesce(sink, false) AS m FROM clean),
v AS (SELECT * FROM obs WHERE q IS NOT NULL)"""


def _tests(src: str, tag: str = "") -> str:
    return f"""
rk{tag} AS (SELECT m, q, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2e0 AS rnk FROM {src}),
ti{tag} AS (SELECT sum(cast(t AS double) * t * t - t) AS ties FROM (SELECT count(*) AS t FROM {src} GROUP BY q)),
ws{tag} AS (SELECT count(*) FILTER (m) AS n1, count(*) FILTER (NOT m) AS n2, sum(rnk) FILTER (m) AS w, count(*) AS n FROM rk{tag}),
zs{tag} AS (SELECT *, (w - n1 * (n + 1e0) / 2e0 - 5e-1 * sign(w - n1 * (n + 1e0) / 2e0)) / sqrt(cast(n1 AS double) * n2 * (n + 1e0 - ties / (cast(n AS double) * (n - 1))) / 12e0) AS z,
 w - n1 * (n1 + 1e0) / 2e0 AS u FROM ws{tag}, ti{tag}),
rs{tag} AS (SELECT n1, n2, w, u, z, 2e0 * {phi_sql('-abs(z)')} AS p, u / (cast(n1 AS double) * n2) AS ps FROM zs{tag}),
kc{tag} AS (SELECT q, sum(sum(CASE WHEN m THEN 1e0 ELSE 0e0 END)) OVER (ORDER BY q) AS a, sum(sum(CASE WHEN m THEN 0e0 ELSE 1e0 END)) OVER (ORDER BY q) AS b FROM {src} GROUP BY q),
kd{tag} AS (SELECT max(abs(a / n1 - b / n2)) AS d, max(n1) AS n1, max(n2) AS n2 FROM kc{tag}, ws{tag}),
kl{tag} AS (SELECT *, (sqrt(n1 * cast(n2 AS double) / (n1 + n2)) + 12e-2 + 11e-2 / sqrt(n1 * cast(n2 AS double) / (n1 + n2))) * d AS lam FROM kd{tag}),
ks{tag} AS (SELECT d, n1, n2, least(greatest((SELECT sum((CASE WHEN j % 2 = 1 THEN 2e0 ELSE -2e0 END) * exp(-2e0 * lam * lam * j * j)) FROM range(1, 102) AS g(j)), 0e0), 1e0) AS p FROM kl{tag})"""


@query("ranksum_test", "B11", tables=CELLS, ctes=OBS + "," + _tests("v"), sql=f"SELECT n1, n2, {sel('w', 'u', 'z', 'p', 'ps')} FROM rs")
def _(t):
    return rnd(T2.ranksum(observed(t), "q", "sink"))


@query("ks_test", "B12", tables=CELLS, ctes=OBS + "," + _tests("v"), sql=f"SELECT n1, n2, {sel('d', 'p')} FROM ks")
def _(t):
    return rnd(T2.ks_2samp(observed(t), "q", "sink"))


@query("superiority_exact", "B13", tables=CELLS, ctes=OBS + "," + _tests("v"), sql=f"SELECT n1, n2, {r('ps')} AS ps FROM rs")
def _(t):
    return rnd(T2.prob_superiority(observed(t), "q", "sink"))


#: Pairs of the estimate, replicates, and pairs of a replicate.
N_PAIRS, N_REPS, N_EACH = 1_000_000, 30, 50_000
PAIRS = OBS + f""",
ix AS (SELECT m, q, row_number() OVER (PARTITION BY m ORDER BY ri, ci) - 1 AS i, count(*) OVER (PARTITION BY m) AS n FROM v),
dr AS (SELECT cast(CASE WHEN j < {N_PAIRS} THEN 0 ELSE (j - {N_PAIRS}) // {N_EACH} + 1 END AS bigint) AS rep, cast(CASE WHEN j < {N_PAIRS} THEN j ELSE (j - {N_PAIRS}) % {N_EACH} END AS bigint) AS draw
 FROM range(0, {N_PAIRS + N_REPS * N_EACH}) AS g(j)),
pk AS (SELECT rep, cast(floor({uniform_sql("'1|in|' || rep || '|' || draw")} * (SELECT max(n) FROM ix WHERE m)) AS bigint) AS a,
 cast(floor({uniform_sql("'1|out|' || rep || '|' || draw")} * (SELECT max(n) FROM ix WHERE NOT m)) AS bigint) AS b FROM dr),
rp AS (SELECT rep, avg(CASE WHEN x.q > y.q THEN 1e0 WHEN x.q = y.q THEN 5e-1 ELSE 0e0 END) AS ps FROM pk JOIN ix x ON x.m AND x.i = a JOIN ix y ON NOT y.m AND y.i = b GROUP BY rep)"""


@query("superiority_paired_draws", "B13", tables=CELLS, ctes=PAIRS + f", qq AS ({quantile_sql('(SELECT ps FROM rp WHERE rep > 0)', 'ps', {'lo95': 0.025, 'hi95': 0.975})})",
       sql=f"SELECT {r('(SELECT ps FROM rp WHERE rep = 0)')} AS ps, {sel('lo95', 'hi95')}, n AS n_boot FROM qq")
def _(t):
    return rnd(T2.prob_superiority_mc(observed(t), "q", "sink", N_PAIRS, N_REPS, N_EACH, draws="md5"))


@query("side_medians", "B15", tables=CELLS, ctes=OBS, sql=f"""
SELECT count(*) FILTER (m) AS n_in, count(*) FILTER (NOT m) AS n_out, {r('median(q) FILTER (m)')} AS med_in, {r('median(q) FILTER (NOT m)')} AS med_out,
 {r('avg(CASE WHEN q >= 2e-1 THEN 1e0 ELSE 0e0 END) FILTER (m)')} AS share_in, {r('avg(CASE WHEN q >= 2e-1 THEN 1e0 ELSE 0e0 END) FILTER (NOT m)')} AS share_out,
 {r('median(q) FILTER (m) - median(q) FILTER (NOT m)')} AS d_med FROM v""")
def _(t):
    return rnd(T2.group_shift(observed(t), "q", "sink", 0.2))


_LV = (10, 25, 50, 75, 90, 95, 99)


@query("side_quantile_shift", "B15", tables=CELLS, ctes=OBS + f", qq AS ({quantile_sql('v', 'q', {f'p{n}': n / 100 for n in _LV}, 'm')}), lg AS (" + " UNION ALL ".join(
    f"SELECT {n} AS level, m, p{n} AS x FROM qq" for n in _LV) + ")", sql=f"""
SELECT level, {r('max(x) FILTER (m)')} AS q_in, {r('max(x) FILTER (NOT m)')} AS q_out, {r('max(x) FILTER (m) - max(x) FILTER (NOT m)')} AS dq FROM lg GROUP BY level""")
def _(t):
    return rnd(T2.quantile_shift(observed(t), "q", "sink", _LV))


@query("stride_subsample_tests", "B14", tables=CELLS, ctes=OBS + ", sb AS (SELECT * FROM v WHERE ri % 2 = 0 AND ci % 2 = 0)," + _tests("sb"), sql=f"""
SELECT 2 AS stride, rs.n1 AS n_in, rs.n2 AS n_out, rs.n1 >= 1000 AND rs.n2 >= 1000 AS did_run, {r('CASE WHEN rs.n1 >= 1000 AND rs.n2 >= 1000 THEN rs.p END')} AS p_rank,
 {r('CASE WHEN rs.n1 >= 1000 AND rs.n2 >= 1000 THEN ks.p END')} AS p_ks, {r('CASE WHEN rs.n1 >= 1000 AND rs.n2 >= 1000 THEN d END')} AS d,
 {r('CASE WHEN rs.n1 >= 1000 AND rs.n2 >= 1000 THEN ps END')} AS ps FROM rs, ks""")
def _(t):
    return rnd(T2.robustness(observed(t), "q", "sink", 2))


@query("stride_share_tests", "B14", tables=CELLS, ctes=OBS + ", sb AS (SELECT * FROM v WHERE ri % 7 = 0 AND ci % 7 = 0)," + _tests("sb"), sql=f"""
SELECT 7 AS stride, n_in, n_out, ran AS did_run, {', '.join(r(f'CASE WHEN ran THEN {c} END') + f' AS {c}' for c in ('p_rank', 'p_ks', 'd', 'ps'))}
FROM (SELECT rs.n1 AS n_in, rs.n2 AS n_out, rs.n1 >= 10 AND rs.n2 >= 10 AS ran, rs.p AS p_rank, ks.p AS p_ks, d, ps FROM rs, ks)""")
def _(t):
    """The stride follows from the share; a low limit lets the tests run on small grids as well."""
    return rnd(T2.robustness(observed(t), "q", "sink", least=10))


@query("ranks_tie_averaged", "W3", tables=CELLS, ctes=OBS, sql="""
SELECT cell_id, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2e0 AS avg_rank FROM v""")
def _(t):
    return O.avg_rank(observed(t).select("cell_id", "q"), "q").select("cell_id", "avg_rank")


@query("distribution_function", "W4", tables=CELLS, ctes=OBS, sql=f"""
SELECT m AS inside, q, count(*) AS n, cast(sum(count(*)) OVER (PARTITION BY m ORDER BY q) AS bigint) AS cum_n,
 {r('sum(count(*)) OVER (PARTITION BY m ORDER BY q) / sum(count(*)) OVER (PARTITION BY m)')} AS f FROM v GROUP BY m, q""")
def _(t):
    df = observed(t).select(F.coalesce("sink", F.lit(False)).alias("inside"), "q")
    return O.ecdf(df, "q", ["inside"]).withColumn("f", F.round("f", 6))


# Detector --------------------------------------------------------------------------------------

_PS = {f"p{i}": 0.01 + i * (0.98 / 79) for i in range(80)}
DET = OBS + f""",
cuts AS (SELECT DISTINCT thr FROM (UNPIVOT (SELECT * EXCLUDE (n) FROM ({quantile_sql('v', 'q', _PS)})) ON * INTO NAME nm VALUE thr)),
cf AS (SELECT thr, count(*) FILTER (q >= thr AND m) AS tp, count(*) FILTER (q >= thr AND NOT m) AS fp, count(*) FILTER (q < thr AND m) AS fn, count(*) FILTER (q < thr AND NOT m) AS tn, count(*) AS n
 FROM v, cuts GROUP BY thr),
dm AS (SELECT thr, tp, fp, fn, tn, (tp + fp) / n AS wet_share, tp / greatest(tp + fn, 1) AS tpr, fp / greatest(fp + tn, 1) AS fpr, tp / greatest(tp + fp, 1) AS precision,
 tn / greatest(tn + fp, 1) AS specificity, 2e0 * tp / greatest(2 * tp + fp + fn, 1) AS f1,
 (cast(tp AS double) * tn - cast(fp AS double) * fn) / sqrt(greatest(cast(tp + fp AS double) * (tp + fn) * (tn + fp) * (tn + fn), 1e0)) AS mcc,
 ((tp + 5e-1) * (tn + 5e-1)) / ((fp + 5e-1) * (fn + 5e-1)) AS odds_ratio FROM cf WHERE (tp + fp) / n BETWEEN 5e-3 AND 995e-3),
dt AS (SELECT *, 5e-1 * (tpr + specificity) AS bal_acc, tpr - fpr AS youden FROM dm)"""
DCOLS = ("wet_share", "tpr", "fpr", "precision", "specificity", "f1", "mcc", "odds_ratio", "bal_acc", "youden")


def _sweep(t):
    df = observed(t)
    return W.detector_sweep(df, "q", "sink", W.detector_thresholds(df))


@query("detector_sweep", "B9 A7", tables=CELLS, ctes=DET, sql=f"SELECT {r('thr')} AS thr, tp, fp, fn, tn, {sel(*DCOLS)} FROM dt")
def _(t):
    return rnd(_sweep(t))


@query("detector_roc", "B9 A7", tables=CELLS, ctes=OBS, sql="""
SELECT a.q AS thr, b.n1 - a.b1 AS tp, b.n2 - a.b2 AS fp, a.b2 AS tn, a.b1 AS fn FROM (SELECT q, cast(coalesce(sum(c1) OVER w, 0) AS bigint) AS b1, cast(coalesce(sum(c2) OVER w, 0) AS bigint) AS b2
 FROM (SELECT q, count(*) FILTER (m) AS c1, count(*) FILTER (NOT m) AS c2 FROM v GROUP BY q) WINDOW w AS (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) a,
 (SELECT count(*) FILTER (m) AS n1, count(*) FILTER (NOT m) AS n2 FROM v) b""")
def _(t):
    return W.roc_curve(observed(t), "q", "sink")


@query("detector_best", "T3", tables=CELLS, ctes=DET, sql=f"""
SELECT 'mcc' AS criterion, {r('arg_max(thr, (mcc, -thr))')} AS thr, {r('max(mcc)')} AS score, {r('arg_max(wet_share, (mcc, -thr))')} AS wet_share FROM dt
UNION ALL SELECT 'youden', {r('arg_max(thr, (youden, -thr))')}, {r('max(youden)')}, {r('arg_max(wet_share, (youden, -thr))')} FROM dt""")
def _(t):
    return rnd(W.best_threshold(_sweep(t)))


@query("wet_cell_lists", "B10", tables=CELLS, ctes=OBS, sql="""
SELECT cast(i - 1 AS int) AS thr_no, i / 1e1 AS thr, cell_id FROM v, range(1, 5) AS g(i) WHERE q >= i / 1e1""")
def _(t):
    return W.wet_index(observed(t), "q", [0.1, 0.2, 0.3, 0.4])

"""Bootstrap replicates, bands and their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltgrid.operators import metrics as M
from meltgrid.operators import models as D
from meltgrid.operators import resample as R
from meltgrid.session import cut_lineage
from registry.base import query, r, rnd, sel
from registry.frames import (HARD, MASS_COLS, REG_COLS, REGIONAL_SUMS, SCORE_COLS, SCORED, SOFT, quantile_sql,
                             regional_sql, score_sql, scored, uniform_sql)
from registry.scores import PW
from registry.spatial import _labels, members
from meltgrid.operators.sweeps import threshold_sweep

CM = ("cells", "model_cells")
REPS = 5
#: Replicates behind bands; the limits of a 95 % band need many.
BAND_REPS = R.BootConfig().n_boot


def weighted_rows(t, label: str = "w"):
    """Scored rows with the wet probability; ``y`` is the label to resample."""
    df = M.with_p_wet(M.decide(scored(t), 1.0))
    return df.withColumns({"y": F.col(label), "s_total": M.margin_sigma(F.col("s_model"), F.col("s_gmin"))})


def _cfg(n_boot: int = REPS, **kw):
    return R.BootConfig(n_boot=n_boot, seed=42, draws="md5", **kw)


def _rep_sql(src: str) -> str:
    return f"""SELECT model, cast(rep AS int) AS rep, {sel(*MASS_COLS, *SCORE_COLS, *REG_COLS)} FROM ({regional_sql('(' + score_sql(src) + ')')})"""


def _agg(y: str) -> str:
    return f"{SOFT.format(p='wet', y=y)}, {REGIONAL_SUMS.format(p='wet', y=y)}"


def _cell_ctes(y: str, wet: str, balance: bool = False, reps: int = REPS) -> str:
    part = "model, s" if balance else "model"
    stratum = f"cast({y} AS int)" if balance else "-1"
    key = "'42|' || model || '|' || rep || '|' || s || '|' || idx" if balance else "'42|' || model || '|' || rep || '|' || idx"
    return PW + f""",
b AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ri, ci) - 1 AS idx, count(*) OVER (PARTITION BY {part}) AS n
 FROM (SELECT *, {stratum} AS s, sqrt(s_model * s_model + s_gmin * s_gmin) AS s_total FROM p WHERE pw IS NOT NULL)),
dr AS (SELECT model, s, rep, idx AS draw, {key} AS k, cast(floor({uniform_sql(key)} * n) AS bigint) AS pick FROM b, range(0, {reps}) AS g(rep)),
cp AS (SELECT dr.model, dr.rep, {wet} AS wet, b.y, b.w, b.ispb, b.ospb FROM dr JOIN b ON b.model = dr.model AND b.s = dr.s AND b.idx = dr.pick),
c AS (SELECT model, rep, {_agg(y)} FROM cp GROUP BY model, rep)"""


BERNOULLI = f"(CASE WHEN {uniform_sql('''dr.k || '|p' ''')} < b.pw THEN 1e0 ELSE 0e0 END)"
U1, U2 = uniform_sql("dr.k || '|u1'"), uniform_sql("dr.k || '|u2'")
NOISY = (f"(CASE WHEN b.gdiff + sqrt(greatest(b.s_total * b.s_total, 2.220446049250313e-16)) * "
         f"sqrt(-2e0 * ln(greatest({U1}, 1e0 / 9007199254740992e0))) * cos(2e0 * pi() * {U2}) >= 1e0 THEN 1e0 ELSE 0e0 END)")


@query("bootstrap_cells", "B1", tables=CM, ctes=_cell_ctes("w", BERNOULLI), sql=_rep_sql("c"))
def _(t):
    return rnd(R.bootstrap_cells(weighted_rows(t), _cfg()))


@query("bootstrap_cells_balanced", "B2", tables=CM, ctes=_cell_ctes("y", BERNOULLI, True), sql=_rep_sql("c"))
def _(t):
    return rnd(R.bootstrap_cells(weighted_rows(t, "y"), _cfg(balance=True)))


@query("bootstrap_cells_noisy", "B5", tables=CM, ctes=_cell_ctes("w", NOISY), sql=_rep_sql("c"))
def _(t):
    return rnd(R.bootstrap_cells(weighted_rows(t), _cfg(pred="noisy")))


MASSES = ("tp", "fp", "tn", "fn")


def _mass(wet: str, y: str) -> dict[str, str]:
    """What one drawn cell adds, given a wet (1) or dry (0) prediction."""
    return {"tp": f"{wet} * {y}", "fp": f"{wet} * (1e0 - {y})", "tn": f"(1e0 - {wet}) * (1e0 - {y})", "fn": f"(1e0 - {wet}) * {y}"}


def spread_check(reps, rows, label: str = "y"):
    """Replicates against the closed form of drawing N of N cells: the mean of every mass is its sum over the cells, its
    variance N times that of one draw; regional recalls stay near the expected ones."""
    y, pw = F.col(label).cast("double"), F.col("pw")
    parts = {"tp": (pw, y), "fp": (pw, 1.0 - y), "tn": (1.0 - pw, 1.0 - y), "fn": (1.0 - pw, y)}
    kept = rows.filter("pw IS NOT NULL")
    exact = kept.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[x for m, (p, v) in parts.items() for x in (
        F.sum(p * v).alias(f"{m}_mean"), (F.count(F.lit(1)) * (F.avg(p * v * v) - F.avg(p * v) * F.avg(p * v))).alias(f"{m}_var"))])
    exp = M.expected_metrics(kept).select("model", F.col("rec_in_wet").alias("in_e"), F.col("rec_out_dry").alias("out_e"))
    seen = reps.groupBy("model").agg(F.count(F.lit(1)).alias("n_rep"), *[x for m in MASSES for x in (
        F.avg(m).alias(f"{m}_m"), F.var_samp(m).alias(f"{m}_s"))],
        *[x for c, t in (("rec_in_wet", "in"), ("rec_out_dry", "out")) for x in (F.avg(c).alias(f"{t}_m"), F.stddev_samp(c).alias(f"{t}_s"))])
    both = exact.join(seen, "model").join(exp, "model")
    mean_ok = spread_ok = F.lit(True)
    for m in MASSES:
        mean_ok = mean_ok & (F.abs(F.col(f"{m}_m") - F.col(f"{m}_mean")) <= 6.0 * F.sqrt(F.col(f"{m}_var") / F.col("n_rep")) + 1e-6)
        spread_ok = spread_ok & (F.abs(F.col(f"{m}_s") - F.col(f"{m}_var")) <= 6.0 * F.sqrt(2.0 / (F.col("n_rep") - 1)) * F.col(f"{m}_var") + 1e-6)
    areas_ok = F.lit(True)
    for t in ("in", "out"):
        areas_ok = areas_ok & F.coalesce(F.abs(F.col(f"{t}_m") - F.col(f"{t}_e")) <= 6.0 * F.col(f"{t}_s") / F.sqrt("n_rep") + 0.02, F.lit(True))
    return rnd(both.select("model", "n", "n_rep", *[f"{m}_{k}" for m in MASSES for k in ("mean", "var")],
                           mean_ok.alias("mean_agrees"), spread_ok.alias("spread_agrees"), areas_ok.alias("areas_agree")), 4)


def _spread_sql(y: str, reps: int) -> str:
    one = _mass("pw", y)
    square = {m: f"{v} * {w}" for (m, v), w in zip(one.items(), (y, f"(1e0 - {y})", f"(1e0 - {y})", y))}
    cols = ", ".join(f"{r(f'sum({one[m]})', 4)} AS {m}_mean, {r(f'count(*) * (avg({square[m]}) - avg({one[m]}) * avg({one[m]}))', 4)} AS {m}_var"
                     for m in MASSES)
    return (f"SELECT model, count(*) AS n, cast({reps} AS bigint) AS n_rep, {cols}, true AS mean_agrees, true AS spread_agrees, "
            "true AS areas_agree FROM p WHERE pw IS NOT NULL GROUP BY model")


@query("bootstrap_cells_exact_counts", "B1", tables=CM, ctes=PW, sql=_spread_sql("y", 400))
def _(t):
    """Multinomial form for hard labels; its draws are its own, so mean and spread are checked."""
    rows = weighted_rows(t, "y")
    return spread_check(R.bootstrap_cells_hard(rows, R.BootConfig(n_boot=400)), rows)


@query("bootstrap_cells_blocked", "B1", tables=CM, ctes=PW, sql=_spread_sql("w", 400))
def _(t):
    """Block form for soft labels."""
    rows = weighted_rows(t)
    return spread_check(R.bootstrap_cells_blocked(rows, R.BootConfig(n_boot=400)), rows)


@query("bootstrap_cells_blocked_noisy", "B5", tables=CM, ctes=PW, sql=_spread_sql("w", 400))
def _(t):
    """Block form with jittered thresholds: a jitter of the margin's own spread is the wet probability."""
    rows = weighted_rows(t)
    return spread_check(R.bootstrap_cells_blocked(rows, R.BootConfig(n_boot=400, pred="noisy")), rows)


@query("bootstrap_cells_blocked_balanced", "B2", tables=CM, ctes=PW, sql=f"""
SELECT model, cast(200 AS bigint) AS n_rep, cast(count(*) FILTER (y = 1) AS double) AS wet_cells, cast(count(*) FILTER (y = 0) AS double) AS dry_cells,
 {r('sum(pw) FILTER (y = 1)', 4)} AS tp_mean, {r('sum(1e0 - pw) FILTER (y = 0)', 4)} AS tn_mean, true AS held, true AS mean_agrees, true AS spread_agrees
FROM p WHERE pw IS NOT NULL GROUP BY model""")
def _(t):
    """Each class is resampled within itself: its size never moves, and hits are spread as N draws of one class."""
    rows = weighted_rows(t, "y").filter("pw IS NOT NULL")
    reps = R.bootstrap_cells_blocked(rows, R.BootConfig(n_boot=200, balance=True))
    pw = F.col("pw")
    wet, dry = (F.when(F.col("y") == v, pw) for v in (1, 0))
    exact = rows.groupBy("model").agg(
        F.count(wet).cast("double").alias("wet_cells"), F.count(dry).cast("double").alias("dry_cells"), F.sum(wet).alias("tp_mean"),
        F.sum(1.0 - dry).alias("tn_mean"), (F.count(wet) * F.avg(wet) * (1.0 - F.avg(wet))).alias("_tv"),
        (F.count(dry) * F.avg(dry) * (1.0 - F.avg(dry))).alias("_nv"))
    both = exact.join(reps.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rep"), *[f(c).alias(f"{c}_{k}") for c in ("tp", "tn") for k, f in (("m", F.avg), ("s", F.var_samp))],
        F.min(F.col("tp") + F.col("fn")).alias("_w0"), F.max(F.col("tp") + F.col("fn")).alias("_w1")), "model")
    near = lambda m, e, v: F.abs(F.col(m) - F.col(e)) <= 6.0 * F.sqrt(F.col(v) / F.col("n_rep")) + 1e-6
    like = lambda s, v: F.abs(F.col(s) - F.col(v)) <= 6.0 * F.sqrt(2.0 / (F.col("n_rep") - 1)) * F.col(v) + 1e-6
    held = (F.abs(F.col("_w0") - F.col("wet_cells")) < 1e-6) & (F.abs(F.col("_w1") - F.col("wet_cells")) < 1e-6)
    return rnd(both.select("model", "n_rep", "wet_cells", "dry_cells", "tp_mean", "tn_mean", held.alias("held"),
                           (near("tp_m", "tp_mean", "_tv") & near("tn_m", "tn_mean", "_nv")).alias("mean_agrees"),
                           (like("tp_s", "_tv") & like("tn_s", "_nv")).alias("spread_agrees")), 4)


def _with_components(t, label="w"):
    rows = weighted_rows(t, label)
    comps = members(t).select("cell_id", "comp_id")
    return rows.join(comps, "cell_id", "left").withColumn("comp_id", F.coalesce("comp_id", F.lit(0)))


CMASK = PW + ",\n" + _labels(5) + """,
b AS (SELECT p.*, comp.comp_id FROM p JOIN comp ON comp.cell_id = p.cell_id WHERE pw IS NOT NULL),
cs AS (SELECT model, comp_id, count(*) AS cells FROM b GROUP BY model, comp_id),
ct AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY comp_id) - 1 AS idx, count(*) OVER (PARTITION BY model) AS nc,
 (sum(cells) OVER (PARTITION BY model ORDER BY comp_id) - cells) / sum(cells) OVER (PARTITION BY model) AS lo,
 sum(cells) OVER (PARTITION BY model ORDER BY comp_id) / sum(cells) OVER (PARTITION BY model) AS hi FROM cs),
sl AS (SELECT model, rep, idx AS draw, nc, '42|' || model || '|' || rep || '|' || idx AS k FROM ct, range(0, 5) AS g(rep) WHERE idx < greatest(1, round(7e-1 * nc)))"""


def _comp_ctes(pick: str) -> str:
    wet = f"""(CASE WHEN {uniform_sql("sl.k || '|' || b.cell_id || '|p'")} < b.pw THEN 1e0 ELSE 0e0 END)"""
    return CMASK + f""",
cp AS (SELECT sl.model, rep, {wet} AS wet, b.w, b.ispb, b.ospb FROM sl JOIN ct ON ct.model = sl.model AND {pick}
 JOIN b ON b.model = ct.model AND b.comp_id = ct.comp_id), c AS (SELECT model, rep, {_agg('w')} FROM cp GROUP BY model, rep)"""


@query("bootstrap_regions", "B3", tables=CM, ctes=_comp_ctes(f"ct.idx = cast(floor({uniform_sql('sl.k')} * sl.nc) AS bigint)"), sql=_rep_sql("c"))
def _(t):
    return rnd(R.bootstrap_components(_with_components(t), _cfg()))


@query("bootstrap_regions_by_size", "B4 J12", tables=CM, ctes=_comp_ctes(f"{uniform_sql('sl.k')} > ct.lo AND {uniform_sql('sl.k')} <= ct.hi"), sql=_rep_sql("c"))
def _(t):
    return rnd(R.bootstrap_components(_with_components(t), _cfg(by_size=True)))


@query("bootstrap_regions_blocked", "B3", tables=CM, ctes=_comp_ctes(f"ct.idx = cast(floor({uniform_sql('sl.k')} * sl.nc) AS bigint)") + """,
ce AS (SELECT sl.model, rep, sum(b.pw * b.w) AS tp_exp, sum(b.w * b.w * b.pw * (1e0 - b.pw)) AS tp_var FROM sl JOIN ct ON ct.model = sl.model
 AND ct.idx = cast(floor(UNIFORM * sl.nc) AS bigint) JOIN b ON b.model = ct.model AND b.comp_id = ct.comp_id GROUP BY sl.model, rep)""".replace("UNIFORM", uniform_sql("sl.k")), sql=f"""
SELECT c.model, cast(c.rep AS int) AS rep, {r('tp + fp + tn + fn')} AS cells, {r('tp + fn')} AS wet_mass, {r('tp_exp', 4)} AS tp_exp, true AS near
FROM c JOIN ce ON ce.model = c.model AND ce.rep = c.rep""")
def _(t):
    """Block form: the drawn regions, and so sizes and label mass, are those of the joined form; hits lie within the
    spread of their predictions."""
    base = cut_lineage(R._component_base(_with_components(t), _cfg(), "ri", ("ci",)))
    reps = R.bootstrap_components_blocked(base, _cfg())
    drawn, cells = R._drawn_components(base, cut_lineage(R.component_table(base)), _cfg())
    # Every copy of a region brings the same expected mass, so cells are summed by region before the copies meet them.
    keys = ["model", "comp_id", "_part"]
    mass = cells.groupBy(*keys).agg(
        F.sum(F.col("pw") * F.col("y")).alias("_e"), F.sum(F.col("y") * F.col("y") * F.col("pw") * (1.0 - F.col("pw"))).alias("_s"))
    exact = drawn.join(mass, keys).groupBy("model", "rep").agg(F.sum("_e").alias("tp_exp"), F.sum("_s").alias("_v"))
    near = F.abs(F.col("tp") - F.col("tp_exp")) <= 6.0 * F.sqrt("_v") + 1e-6
    return rnd(reps.join(exact, ["model", "rep"]).select(
        "model", "rep", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("cells"),
        (F.col("tp") + F.col("fn")).alias("wet_mass"), F.round("tp_exp", 4).alias("tp_exp"), near.alias("near")))


def _band_ctes(reps: int) -> str:
    return _cell_ctes("w", BERNOULLI, reps=reps) + f""",
lg AS (UNPIVOT (SELECT model, rep, {', '.join(R.METRICS)} FROM ({regional_sql('(' + score_sql('c') + ')')})) ON {', '.join(R.METRICS)} INTO NAME metric VALUE value),
bd AS ({quantile_sql('lg', 'value', {'lo95': 0.025, 'hi95': 0.975, 'lo50': 0.25, 'hi50': 0.75}, 'model, metric')}),
ec AS (SELECT model, {SOFT.format(p='pw', y='w')}, {REGIONAL_SUMS.format(p='pw', y='w')} FROM p WHERE pw IS NOT NULL GROUP BY model),
el AS (UNPIVOT (SELECT model, {', '.join(R.METRICS)} FROM ({regional_sql('(' + score_sql('ec') + ')')})) ON {', '.join(R.METRICS)} INTO NAME metric VALUE exp),
gs AS (SELECT el.model, el.metric, exp, lo95, hi95, lo50, hi50 FROM el LEFT JOIN bd ON bd.model = el.model AND bd.metric = el.metric)"""


BANDS = _band_ctes(REPS)


def cell_gstats(t, n_boot: int = REPS):
    rows = cut_lineage(weighted_rows(t).select("model", "ri", "ci", "pw", "y", "ispb", "ospb"))
    return R.gstats(M.expected_metrics(rows), R.bootstrap_cells(rows, _cfg(n_boot)))


@query("bootstrap_bands", "B6", tables=CM, ctes=_band_ctes(BAND_REPS), sql=f"SELECT model, metric, {sel('exp', 'lo95', 'hi95', 'lo50', 'hi50')} FROM gs")
def _(t):
    return rnd(cell_gstats(t, BAND_REPS))


_WIDE = ", ".join(f"{r(f'max(CASE WHEN metric = {m!r} THEN {c} END)')} AS {m}{s}" for m in R.METRICS for c, s in (("exp", ""), ("lo95", "_lo"), ("hi95", "_hi")))


@query("bootstrap_summary_wide", "B7", tables=CM, ctes=BANDS, sql=f"SELECT model, 'Model ' || model AS title, {_WIDE} FROM gs GROUP BY model")
def _(t):
    models = t.model_cells.select("model").distinct().withColumn("title", F.concat(F.lit("Model "), "model"))
    return rnd(R.ci_summary(cell_gstats(t), models))


CENTER = f"""ctr AS ({quantile_sql("(SELECT model, g FROM masked c JOIN model_cells m ON m.cell_id = c.cell_id WHERE slow)", 'g', {'center': 0.5}, 'model')})"""


@query("model_centers", "A9", tables=CM, ctes=SCORED + ", " + CENTER + """, al AS (SELECT model, n, center FROM ctr
 UNION ALL SELECT 'Flat_' || v, (SELECT count(*) FROM masked WHERE slow), v FROM range(20, 81) AS f(v))""", sql=f"SELECT model, n, {r('center')} AS center FROM al")
def _(t):
    from registry.frames import masked
    viz = masked(t).filter("viz").select("cell_id")
    rows = cut_lineage(viz.join(t.model_cells, "cell_id").select("model", "g"))
    flats = D.with_flat_fields(viz, 20, 80).select("model", "g")
    return rnd(D.model_center(rows.unionByName(flats)))


@query("metric_against_center", "A29 T4 J14", tables=CM, ctes=_band_ctes(BAND_REPS) + ", " + CENTER, sql=f"""
SELECT gs.model, {sel('center', 'exp', 'lo95', 'hi95', 'lo50', 'hi50')}, false AS is_flat, true AS good FROM gs JOIN ctr ON ctr.model = gs.model
WHERE metric = 'g_mean' AND gs.model <> 'B'""")
def _(t):
    from registry.frames import masked
    t = t.written()
    rows = cut_lineage(masked(t).filter("viz").select("cell_id").join(t.model_cells, "cell_id").select("model", "g"))
    return rnd(D.metric_vs_center(cell_gstats(t, BAND_REPS), D.model_center(rows, store=False), "g_mean", [" b "]))


P0 = SCORED + ", p AS (SELECT *, coalesce(gdiff >= 0, false) AS pred FROM scored)"
SWEEP = P0 + f""", th AS (SELECT unnest([1e-1, 15e-2, 2e-1, 25e-2, 3e-1]) AS threshold),
c AS (SELECT model, threshold, {HARD.replace('y <> 1', 'NOT coalesce(q > threshold, false)').replace('y = 1', 'coalesce(q > threshold, false)')} FROM p, th GROUP BY model, threshold)"""
THRESHOLDS = [0.10, 0.15, 0.20, 0.25, 0.30]


@query("threshold_sweep", "B8", tables=CM, ctes=SWEEP, sql=f"SELECT model, threshold, tp, fp, tn, fn, {sel(*SCORE_COLS)} FROM ({score_sql('c')})")
def _(t):
    return rnd(threshold_sweep(M.decide(scored(t), 0.0), THRESHOLDS))


@query("threshold_closest", "J11", tables=CM, ctes=SWEEP, sql=f"SELECT model, threshold, {r('g_mean')} AS g_mean FROM ({score_sql('c')}) WHERE threshold = 2e-1")
def _(t):
    sweep = threshold_sweep(M.decide(scored(t), 0.0), THRESHOLDS)
    return rnd(D.closest(sweep, "threshold", 0.21, ["model"]).select("model", "threshold", "g_mean"))


@query("rank_change", "W2", tables=CM, ctes=P0 + f"""
, hb AS (SELECT model, {HARD} FROM p GROUP BY model), sb AS (SELECT model, {SOFT.format(p='(CASE WHEN pred THEN 1e0 ELSE 0e0 END)', y='w')} FROM p GROUP BY model),
rb AS (SELECT model, g_prod AS g_binary, row_number() OVER (ORDER BY g_prod DESC, model) AS rank_binary FROM ({score_sql('hb')})),
rw AS (SELECT model, g_prod AS g_weighted, row_number() OVER (ORDER BY g_prod DESC, model) AS rank_weighted FROM ({score_sql('sb')}))""", sql=f"""
SELECT rb.model, {sel('g_binary', 'g_weighted')}, {r('g_weighted - g_binary')} AS d_g, cast(rank_binary AS int) AS rank_binary, cast(rank_weighted AS int) AS rank_weighted,
 cast(rank_weighted - rank_binary AS int) AS d_rank FROM rb JOIN rw ON rw.model = rb.model""")
def _(t):
    df = M.decide(scored(t), 0.0)
    return rnd(D.rank_compare(M.point_metrics(df), M.point_metrics(df, "w", soft=True)))

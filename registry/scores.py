"""Point, soft and expected metrics per model; spread and margins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.physics import gmin
from meltgrid.functions.truth import truth_binary, truth_weight, wet_prob
from meltgrid.operators import metrics as M
from meltgrid.operators.masks import MaskConfig
from meltgrid.operators.models import with_flat_fields
from meltgrid.operators.sweeps import flat_confusion
from meltgrid.session import cut_lineage
from registry.base import query, r, rnd, sel
from registry.frames import (HARD, LABELLED, MASKED, MASS_COLS, REG_COLS, REGIONAL_SUMS, SCORE_COLS, SCORED,
                             SOFT, clean_cells, gmin_sql, labelled, phi_sql, quantile_sql, regional_sql, score_sql,
                             scored)

CM = ("cells", "model_cells")
PRED0 = SCORED + ", p AS (SELECT *, coalesce(gdiff >= 0, false) AS pred FROM scored)"
PW = SCORED + f""", p AS (SELECT *, CASE WHEN s_model = 0 AND s_gmin = 0
  THEN CASE WHEN gdiff >= 1e0 THEN 1e0 ELSE 0e0 END
  ELSE {phi_sql('(gdiff - 1e0) / sqrt(greatest(s_model * s_model + s_gmin * s_gmin, 2.220446049250313e-16))')} END AS pw
  FROM scored)"""


@query("confusion_per_model", "P1 P10 P11 P16 P19 P21 A1 A5 J1", tables=CM, ctes=PRED0 + f"""
, c AS (SELECT model, {HARD} FROM p GROUP BY model)""", sql=f"""
SELECT model, tp, fp, tn, fn, {sel(*SCORE_COLS)} FROM ({score_sql('c')})""")
def _(t):
    return rnd(M.confusion(M.decide(scored(t), 0.0), ["model"]))


@query("confusion_count_ratios", "A1", tables=CM, ctes=PRED0 + f"""
, c AS (SELECT model, {HARD} FROM p GROUP BY model)""", sql=f"""
SELECT model, {r('tp / greatest(cast(fp AS double), 2.220446049250313e-16)')} AS tp_fp,
 {r('tn / greatest(cast(fn AS double), 2.220446049250313e-16)')} AS tn_fn FROM c""")
def _(t):
    return rnd(M.count_ratios(M.confusion(M.decide(scored(t), 0.0), ["model"])).select("model", "tp_fp", "tn_fn"))


@query("confusion_soft_truth", "A2 P17", tables=CM, ctes=PRED0 + f"""
, c AS (SELECT model, {SOFT.format(p='(CASE WHEN pred THEN 1e0 ELSE 0e0 END)', y='w')} FROM p GROUP BY model)""", sql=f"""
SELECT model, {sel(*MASS_COLS, *SCORE_COLS)} FROM ({score_sql('c')})""")
def _(t):
    return rnd(M.confusion_soft(M.decide(scored(t), 0.0), ["model"]))


@query("confusion_expected", "A3 P20", tables=CM, ctes=PW + f"""
, c AS (SELECT model, count(*) AS n, {SOFT.format(p='pw', y='y')} FROM p WHERE pw IS NOT NULL GROUP BY model)""", sql=f"""
SELECT model, n, {sel(*MASS_COLS, *SCORE_COLS)} FROM ({score_sql('c')})""")
def _(t):
    return rnd(M.confusion_expected(M.with_p_wet(M.decide(scored(t), 1.0)), ["model"]))


@query("regional_recall_hard", "A4", tables=CM, ctes=PRED0 + f"""
, c AS (SELECT model, {REGIONAL_SUMS.format(p='(CASE WHEN pred THEN 1e0 ELSE 0e0 END)', y='y')} FROM p GROUP BY model)""",
       sql=f"SELECT model, {sel(*REG_COLS)} FROM ({regional_sql('c')})")
def _(t):
    return rnd(M.regional_recall(M.decide(scored(t), 0.0), ["model"], "pred", "y"))


@query("regional_recall_expected", "A4", tables=CM, ctes=PW + f"""
, c AS (SELECT model, {REGIONAL_SUMS.format(p='pw', y='w')} FROM p GROUP BY model)""",
       sql=f"SELECT model, {sel(*REG_COLS)} FROM ({regional_sql('c')})")
def _(t):
    return rnd(M.regional_recall(M.with_p_wet(M.decide(scored(t), 1.0)), ["model"], "pw", "w"))


@query("point_metrics_hard", "A6", tables=CM, ctes=PRED0 + f"""
, c AS (SELECT model, count(*) AS n_roi, {HARD}, {REGIONAL_SUMS.format(p='(CASE WHEN pred THEN 1e0 ELSE 0e0 END)', y='y')}
  FROM p GROUP BY model)""",
       sql=f"SELECT model, n_roi, tp, fp, tn, fn, {sel(*SCORE_COLS, *REG_COLS)} FROM ({regional_sql('(' + score_sql('c') + ')')})")
def _(t):
    return rnd(M.point_metrics(M.decide(scored(t), 0.0)))


@query("point_metrics_soft", "A6", tables=CM, ctes=PRED0 + f"""
, c AS (SELECT model, count(*) AS n_roi, {SOFT.format(p='(CASE WHEN pred THEN 1e0 ELSE 0e0 END)', y='w')},
  {REGIONAL_SUMS.format(p='(CASE WHEN pred THEN 1e0 ELSE 0e0 END)', y='w')} FROM p GROUP BY model)""",
       sql=f"SELECT model, n_roi, {sel(*MASS_COLS, *SCORE_COLS, *REG_COLS)} FROM ({regional_sql('(' + score_sql('c') + ')')})")
def _(t):
    return rnd(M.point_metrics(M.decide(scored(t), 0.0), label="w", soft=True))


# Spread, margins -------------------------------------------------------------------------------

@query("sigma_resolution", "P13 P14 P15", tables=CM, ctes=SCORED,
       sql=f"""SELECT model, sigma_source, count(*) AS n, {r('avg(s_model)')} AS s_mean,
 {r('avg(sqrt(s_model * s_model + s_gmin * s_gmin))')} AS s_gd FROM scored GROUP BY model, sigma_source""")
def _(t):
    df = scored(t).withColumn("s", M.margin_sigma(F.col("s_model"), F.col("s_gmin")))
    return rnd(df.groupBy("model", "sigma_source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("s_model").alias("s_mean"), F.avg("s").alias("s_gd")))


SIGMA = SCORED + f""", sg AS (SELECT model, sqrt(s_model * s_model + s_gmin * s_gmin) AS s FROM scored),
sm AS (SELECT a.model, sigma_mean, sigma_median FROM (SELECT model, avg(s) AS sigma_mean FROM sg GROUP BY model) a
  JOIN ({quantile_sql('sg', 's', {'sigma_median': 0.5}, 'model')}) b ON a.model = b.model)"""


@query("sigma_summary", "A10", tables=CM, ctes=SIGMA, sql=f"SELECT model, {sel('sigma_mean', 'sigma_median')} FROM sm")
def _(t):
    return rnd(M.sigma_summary(scored(t)))


@query("suggested_margin", "A11", tables=CM, ctes=SIGMA, sql=f"""
SELECT {r('median(sigma_mean)')} AS suggested_mean, {r('median(sigma_median)')} AS suggested_median
FROM sm WHERE model NOT LIKE 'Flat_%'""")
def _(t):
    return rnd(M.suggested_margin(M.sigma_summary(scored(t))))


@query("suggested_margin_flat_only", "A11 P8", tables=("cells",), ctes=LABELLED, sql=f"""
SELECT {r('avg(s_gmin)')} AS suggested_mean, {r('median(s_gmin)')} AS suggested_median FROM labelled""")
def _(t):
    """Every model is flat: the median runs over these, and all have the same spread."""
    flats = M.with_sigma(with_flat_fields(labelled(t), 20, 80).withColumns({
        c: F.lit(None).cast("double") for c in ("bmin", "bmax")}))
    return rnd(M.suggested_margin(M.sigma_summary(flats)))


@query("sigma_scalar", "P14", tables=CM, ctes=LABELLED, sql=f"""
SELECT model, s_model, sigma_source, count(*) AS n FROM (
 SELECT model, {r('coalesce(sigma, abs(bmax - bmin) / 3.92e0, 4e0)')} AS s_model,
  CASE WHEN sigma IS NOT NULL THEN 'cell' WHEN bmax IS NOT NULL THEN 'bounds' ELSE 'scalar' END AS sigma_source
 FROM labelled l JOIN model_cells m ON m.cell_id = l.cell_id) GROUP BY ALL""")
def _(t):
    df = labelled(t).join(t.model_cells, "cell_id").withColumn("one_number", F.lit(4.0))
    return rnd(M.with_sigma(df, "one_number")).groupBy("model", "s_model", "sigma_source").agg(F.count(F.lit(1)).alias("n"))


@query("margin_modes", "P19", tables=CM, ctes=SIGMA + """
, m AS (SELECT 'fixed' AS mode, model, 2e0 AS margin FROM sm
 UNION ALL SELECT 'auto_mean', model, (SELECT median(sigma_mean) FROM sm) FROM sm
 UNION ALL SELECT 'auto_median', model, (SELECT median(sigma_median) FROM sm) FROM sm
 UNION ALL SELECT 'auto_per_model_mean', model, sigma_mean FROM sm
 UNION ALL SELECT 'auto_per_model_median', model, sigma_median FROM sm)""", sql=f"""
SELECT mode, s.model, count(*) AS n, count(*) FILTER (gdiff >= margin) AS n_wet, {r('max(margin)')} AS margin
FROM scored s JOIN m ON s.model = m.model GROUP BY mode, s.model""")
def _(t):
    """The scored rows are written once; all modes meet them in one pass."""
    df = cut_lineage(scored(t).select("model", "gdiff", "s_model", "s_gmin"))
    sigma = cut_lineage(M.sigma_summary(df))
    margins = reduce(DataFrame.unionByName, [
        M.margin_table(sigma, mode, 2.0).withColumn("mode", F.lit(mode)) for mode in M.MARGIN_MODES])
    return rnd(M.decide(df.select("model", "gdiff"), margins).groupBy("mode", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("pred").alias("n_wet"), F.max("margin").alias("margin"))
        .select("model", "n", "n_wet", "margin", "mode"))


@query("flat_family_confusion", "P8 A1", tables=("cells",), ctes=LABELLED + f"""
, p AS (SELECT 'Flat_' || v AS model, y, ispb, ospb, coalesce(v - gmin >= 0, false) AS pred
  FROM labelled, range(20, 81) AS f(v)), c AS (SELECT model, count(*) AS n_roi, {HARD} FROM p GROUP BY model)""",
       sql=f"SELECT model, tp, fp, tn, fn, {sel(*SCORE_COLS)} FROM ({score_sql('c')})")
def _(t):
    return rnd(flat_confusion(labelled(t), "y", lo=20, hi=80))


@query("flat_family_explode", "P8", tables=("cells",), ctes=LABELLED, sql=f"""
SELECT 'Flat_' || v AS model, count(*) AS n, count(*) FILTER (v - gmin >= 0) AS n_wet
FROM labelled, range(20, 81) AS f(v) GROUP BY v""")
def _(t):
    df = with_flat_fields(labelled(t), 20, 80)
    df = M.decide(df.withColumn("gdiff", F.col("g") - F.col("gmin")), 0.0)
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("pred").alias("n_wet"))


@query("truth_labels", "P16 P17 P18", tables=("cells",), ctes=MASKED, sql=f"""
SELECT cell_id, CASE WHEN q > 2e-1 THEN 1 ELSE 0 END AS y,
 {r('coalesce(greatest(least((q - 2e-1) / 8e-1, 1e0), 0e0) + q * 0, 0e0)')} AS w_ramp,
 {r('coalesce(1e0 / (1e0 + exp(-12e0 * (q - 6e-1))), 0e0)')} AS w_logistic,
 {r('coalesce(pow(greatest(least((q - 2e-1) / 8e-1, 1e0), 0e0), 2) + q * 0, 0e0)')} AS w_power,
 {r('greatest(least((q - 2e-1) / 4e-1, 1e0), 0e0) + q * 0')} AS p_clip,
 {r('1e0 / (1e0 + exp(-12e0 * (q - 2e-1)))')} AS p_logistic FROM clean""")
def _(t):
    q = F.col("q")
    return rnd(clean_cells(t).select(
        "cell_id", truth_binary(q, 0.2).alias("y"),
        truth_weight(q, "ramp", t0=0.2).alias("w_ramp"),
        truth_weight(q, "logistic", tmid=0.6, k=12.0).alias("w_logistic"),
        truth_weight(q, "power", t0=0.2, p=2.0).alias("w_power"),
        wet_prob(q, "linear_clip", sc0=0.2, sc1=0.6).alias("p_clip"),
        wet_prob(q, "logistic", sc0=0.2, k=12.0).alias("p_logistic")))


@query("mask_counts", "P21 T7", tables=("cells",), ctes=MASKED, sql="""
SELECT count(*) AS cells, count(*) FILTER (valid) AS valid, count(*) FILTER (slow) AS slow,
 count(*) FILTER (slow AND ispb) AS viz, count(*) FILTER (slow AND ispb AND sink AND x_m BETWEEN 1e3 AND 9e3) AS roi
FROM masked""")
def _(t):
    from meltgrid.operators.masks import combine, with_masks
    df = with_masks(clean_cells(t), MaskConfig(region="ISPB"))
    roi = combine([F.col("roi"), F.col("x_m").between(1e3, 9e3)])
    return df.agg(F.count(F.lit(1)).alias("cells"), F.count_if("valid").alias("valid"),
                  F.count_if("slow").alias("slow"), F.count_if("viz").alias("viz"), F.count_if(roi).alias("roi"))


@query("gmin_per_cell", "P10", tables=("cells",), sql=f"""
SELECT cell_id, {r(gmin_sql())} AS gmin FROM cells""")
def _(t):
    return rnd(t.cells.select("cell_id", gmin(F.col("h"), F.col("ts"), F.col("mb")).alias("gmin")))

"""Run tables, artifacts, model resolution and report ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltgrid.operators import metrics as M
from meltgrid.operators import models as D
from meltgrid.operators import resample as R
from meltgrid.operators.masks import combine, flag
from meltgrid.operators.sweeps import flat_confusion, threshold_sweep
from meltgrid.session import scratch_path
from meltgrid.sources import files as S
from registry.base import query, r, rnd, sel
from registry.frames import HARD, LABELLED, SCORE_COLS, SCORED, labelled, score_sql, scored
from registry.resampling import SWEEP, THRESHOLDS

CM = ("cells", "model_cells")
P0 = SCORED + ", p AS (SELECT *, coalesce(gdiff >= 0, false) AS pred FROM scored)"


@query("run_results_stored", "S6 T5", tables=CM, ctes=P0 + f", c AS (SELECT model, {HARD} FROM p GROUP BY model)", sql=f"""
SELECT run_id, model, tp, fp, tn, fn, {sel(*SCORE_COLS)} FROM ({score_sql('c')}), (SELECT unnest(['first', 'second']) AS run_id)""")
def _(t):
    base = scratch_path(t.spark, "results")
    table = rnd(M.confusion(M.decide(scored(t), 0.0), ["model"]))
    for run in ("first", "second", "first"):  # a run that is written again replaces itself
        path = S.write_results(table, base, "results_binary", run)
    return t.spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))


LIST = """ls AS (SELECT 'out/spec_0.' || lpad(cast(5 * (o_custkey % 7) AS varchar), 2, '0') || '/artifacts/run_' || o_orderkey || '.parquet' AS path, o_orderdate AS mtime FROM orders)"""


def listing(t):
    o = t.read("orders")
    path = F.concat(F.lit("out/spec_0."), F.lpad((5 * (F.col("o_custkey") % 7)).cast("string"), 2, "0"),
                    F.lit("/artifacts/run_"), F.col("o_orderkey").cast("string"), F.lit(".parquet"))
    return o.select(path.alias("path"), F.col("o_orderdate").alias("mtime"))


@query("newest_artifacts", "S10", ctes=LIST, sql="""
SELECT cast(regexp_extract(path, 'spec_([0-9]*\\.?[0-9]+)', 1) AS double) AS threshold, arg_max(path, (mtime, path)) AS path, count(*) AS n_files FROM ls GROUP BY 1""")
def _(t):
    return S.latest_runs(listing(t), "path", "mtime")


@query("artifact_files_listed", "S10", tables=CM, ctes=SWEEP, sql="SELECT threshold, count(*) AS models FROM c GROUP BY threshold")
def _(t):
    base = scratch_path(t.spark, "sweep")
    sweep = threshold_sweep(M.decide(scored(t), 0.0), THRESHOLDS)
    for thr in THRESHOLDS:
        sweep.filter(F.col("threshold") == thr).drop("threshold").coalesce(1).write.parquet(S.threshold_dir(base, thr))
    newest = S.latest_runs(S.list_files(t.spark, base, "*.parquet"))
    out = None
    for row in newest.collect():
        part = t.spark.read.parquet(row["path"]).agg(F.lit(row["threshold"]).alias("threshold"), F.count(F.lit(1)).alias("models"))
        out = part if out is None else D.union_runs([out, part])
    return out


@query("margins_cached", "S11 O2", tables=CM, ctes=SCORED, sql=f"SELECT model, cell_id, {r('gdiff')} AS gdiff FROM scored")
def _(t):
    path = scratch_path(t.spark, "gdiff")
    rows = scored(t).select("model", "cell_id", "gdiff")
    S.cache_gdiff(rows, path)
    # The second call finds the finished table and does not compute the margins again.
    return rnd(S.cache_gdiff(rows, path).select(F.col("model").cast("string").alias("model"), "cell_id", "gdiff"))


LONG = SWEEP + f""", fl AS (SELECT 'Flat_' || v AS model, 2e-1 AS threshold, {HARD} FROM (SELECT v, y, coalesce(v - gmin >= 0, false) AS pred FROM labelled, range(20, 81) AS f(v)) GROUP BY v)"""


@query("metric_across_thresholds", "S12 T4", tables=CM, ctes=SWEEP, sql=f"""
SELECT threshold, model, {r('g_mean')} AS exp, cast(NULL AS double) AS lo95, cast(NULL AS double) AS hi95, cast(NULL AS double) AS lo50, cast(NULL AS double) AS hi50 FROM ({score_sql('c')})""")
def _(t):
    sweep = threshold_sweep(M.decide(scored(t), 0.0), THRESHOLDS)
    flats = flat_confusion(labelled(t), "y").withColumn("threshold", F.lit(0.2))
    long = R.to_long(D.union_runs([sweep, flats]), ["threshold", "model"], ["g_mean", "rec", "spec"], "exp")
    for c in ("lo95", "hi95", "lo50", "hi50"):
        long = long.withColumn(c, F.lit(None).cast("double"))
    return rnd(D.metric_by_threshold(long, "g_mean"))


@query("flat_trend_smoothed", "W5", tables=("cells",), ctes=LABELLED + f"""
, c AS (SELECT 'Flat_' || v AS model, v, {HARD} FROM (SELECT v, y, coalesce(v - gmin >= 0, false) AS pred FROM labelled, range(20, 81) AS f(v)) GROUP BY v)""", sql=f"""
SELECT model, {r('v')} AS center, {r('g_mean')} AS g_mean, {r('median(g_mean) OVER (ORDER BY v ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)')} AS smooth FROM ({score_sql('c')})""")
def _(t):
    from meltgrid.functions.names import flat_value
    flats = flat_confusion(labelled(t), "y").withColumn("center", flat_value(F.col("model")))
    return rnd(D.moving_median(flats.select("model", "center", "g_mean"), "center", "g_mean"))


@query("models_resolved", "J13", ctes="""av AS (SELECT n_name AS model, n_nationkey AS ord FROM nation),
wt AS (SELECT n_name AS name FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT ' ' || n_name FROM nation UNION SELECT s_name FROM supplier)""", sql="""
SELECT name, coalesce(min(a.model), 'FRANCE') AS model, CASE WHEN min(a.model) IS NULL THEN 'fallback' WHEN bool_or(a.model = trim(name)) THEN 'exact' WHEN bool_or(lower(a.model) = name) THEN 'nocase' ELSE 'raw' END AS match
FROM wt LEFT JOIN av a ON lower(a.model) = lower(trim(name)) GROUP BY name""")
def _(t):
    n = t.read("nation")
    wanted = (n.select(F.col("n_name").alias("name")).union(n.select(F.lower("n_name"))).union(n.select(F.concat(F.lit(" "), "n_name")))
              .union(t.read("supplier").select("s_name"))).distinct()
    return D.resolve_models(wanted, n.select(F.col("n_name").alias("model"), F.col("n_nationkey").alias("ord")), "FRANCE")


@query("models_excluded", "J14", tables=CM, sql="""
SELECT model, count(*) AS n FROM model_cells WHERE model <> 'B' GROUP BY model""")
def _(t):
    listed = t.spark.createDataFrame([(" b",), ("zz",)], "model string")
    return D.exclude_table(t.model_cells, listed).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("mask_algebra", "T7", tables=("cells",), sql="""
SELECT cell_id, coalesce(ispb, false) AND coalesce(sink, false) AS both_in, coalesce(ispb, false) OR coalesce(ospb, false) AS any_in, NOT coalesce(sink, false) AS no_sink FROM cells""")
def _(t):
    return t.cells.select("cell_id", combine([F.col("ispb"), F.col("sink")]).alias("both_in"),
                          combine([F.col("ispb"), F.col("ospb")], "or").alias("any_in"), (~flag(F.col("sink"))).alias("no_sink"))


@query("report_sorted", "T4", tables=CM, ctes=SWEEP, sql=f"SELECT threshold, model, {r('rec')} AS rec FROM ({score_sql('c')})")
def _(t):
    sweep = threshold_sweep(M.decide(scored(t), 0.0), THRESHOLDS)
    return rnd(D.sorted_report(sweep.select("threshold", "model", "rec"), "threshold", "model"))

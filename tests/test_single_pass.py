"""What lies behind an operator that takes several passes is computed once."""

import pytest
from pyspark.sql import functions as F

import registry.evaluations  # noqa: F401
import registry.resampling as resampling
import registry.scores as scores
from meltgrid.operators import fields as Y
from meltgrid.operators import resample as R
from meltgrid.operators.labelled import PASSED, Labels
from meltgrid.operators.metrics import sigma_summary
from meltgrid.operators.ordered import midpoint_quantile
from meltgrid.operators.summaries import change_stats
from meltgrid.plans import candidates as P
from meltgrid.plans import evaluation as E
from meltgrid.session import sized
from registry.base import QUERIES
from registry.fixtures import MODEL_CELLS, Tables

N = 400


@pytest.fixture
def rows(spark):
    """Scored (model, cell) rows that count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(N).selectExpr(
        "if(id % 2 = 0, 'A', 'B') AS model", "id AS cell_id", "cast(id DIV 20 AS int) AS ri", "cast(id % 20 AS int) AS ci",
        "cast(id % 11 AS double) AS gdiff", "1e0 + id % 7 AS s_model", "1e0 * (id % 3) AS s_gmin", "(id % 10) / 1e1 AS w",
        "cast(id % 2 AS int) AS y", "id % 3 = 0 AS ispb", "id % 3 = 1 AS ospb", "1e0 + id % 5 AS g", "2e0 + id % 13 AS after")
    return df.mapInArrow(count, df.schema), made


@pytest.mark.parametrize("group_rows", [10, 10_000])
def test_quantile(rows, group_rows):
    df, made = rows
    got = {r["model"]: r["m"] for r in midpoint_quantile(df, "gdiff", {"m": 0.5}, ["model"], group_rows).collect()}
    assert got == {"A": 5.0, "B": 5.0} and made.value == N


def test_spread_and_changes(rows):
    df, made = rows
    assert sigma_summary(df).count() == 2 and made.value == N
    assert change_stats(df, "g", "after", ["model"]).count() == 2 and made.value == 2 * N


def test_margin_modes(spark, rows, monkeypatch):
    df, made = rows
    monkeypatch.setattr(scores, "scored", lambda t: df)
    out = QUERIES["margin_modes"](spark, "none").collect()
    assert made.value == N and len(out) == 10 and {r["n"] for r in out} == {N // 2}
    assert {r["n_wet"] for r in out if r["mode"] == "fixed"} == {sum(i % 11 >= 2 for i in range(m, N, 2)) for m in (0, 1)}


def test_cell_bands(spark, rows, monkeypatch):
    df, made = rows
    monkeypatch.setattr(resampling, "scored", lambda t: df)
    assert resampling.cell_gstats(None).count() == 2 * len(R.METRICS) and made.value == N


def test_region_bootstrap(spark, rows, monkeypatch):
    df, made = rows
    monkeypatch.setattr(resampling, "_with_components", lambda t: df.withColumns(
        {"pw": F.col("w"), "comp_id": F.col("cell_id") % 9 + 1}))
    out = QUERIES["bootstrap_regions_blocked"](spark, "none").collect()
    assert made.value == N and len(out) == 2 * resampling.REPS and all(r["near"] for r in out)


@pytest.mark.parametrize("delta", [None, "delta"])
def test_candidates(spark, rows, delta, monkeypatch):
    monkeypatch.setattr(Y, "RANK_ROWS", 4)
    monkeypatch.setattr(Y, "SORTED_ROWS", 40)
    df, made = rows
    cells = df.withColumns({"x_m": F.col("ci") * 100.0, "y_m": F.col("ri") * 100.0, "gmin": F.col("after") * 3.0, "delta": F.col("ci") / 1000.0,
                            "roi": F.col("ri") < 15, "spec_valid": F.col("ri") > 1}).drop("g")
    cands = spark.createDataFrame([(m, 20.0, t) for m in (30.0, 40.0, 50.0, 60.0) for t in (0.0, 60.0)], "mu double, a double, theta double")
    assert P.search(cells, cands, delta=delta, proxy_gate=0.01).count() and made.value == N


def test_model_rows(spark, tmp_path):
    """Rows of the models are those of the checked text, from one read of the cells."""
    cells = spark.range(300).selectExpr(
        "if(id % 50 = 0, NULL, id % 290) AS cell_id", "if(id % 40 = 0, NULL, id * 7) AS custkey",
        "cast(id % 125 AS int) AS ci", "if(id % 30 = 0, NULL, id / 3e0) AS mean_qty")
    t = Tables(spark, str(tmp_path))
    t._kept("cells", lambda: cells)
    made = t.model_cells
    cells.createOrReplaceTempView("cells")
    want = spark.sql(MODEL_CELLS)
    assert made.dtypes == want.dtypes and made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


@pytest.fixture
def grid(spark, tmp_path):
    """Folder whose cells count how often they are derived."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    cells = spark.range(N).selectExpr(
        "id AS cell_id", "cast(id DIV 20 AS int) AS ri", "cast(id % 20 AS int) AS ci", "1e2 * (id % 20) AS x_m",
        "1e2 * (id DIV 20) AS y_m", "2e3 + id AS h", "if(id % 31 = 0, 9999e0, (id % 10) / 2e1) AS q", "213e0 + id % 9 AS ts",
        "2e-2 + (id % 60) / 1e3 AS mb", "1e0 * (id % 21) AS icevel", "1e0 AS vx", "1e0 AS vy", "2e1 + id % 17 AS mean_qty",
        "id % 4 < 2 AS ispb", "id % 4 >= 2 AS ospb", "id % 20 < 12 AS sink", "id % 90 AS custkey")
    Tables(spark, str(tmp_path))._kept("cells", lambda: cells.mapInArrow(count, cells.schema))
    return str(tmp_path), made


def test_metric_against_center(spark, grid):
    path, made = grid
    out = {r["model"]: r for r in QUERIES["metric_against_center"](spark, path).collect()}
    seen = sorted(30.0 + 40.0 * (i % 20) / 124.0 for i in range(N) if i % 31 and i % 21 <= 10)
    middle = (seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2.0
    assert made.value == N and set(out) == {"A", "C"} and out["C"]["center"] == round(middle, 6)


def test_threshold_runs(spark, grid, monkeypatch):
    path, made = grid
    plans = []
    gstats = R.gstats
    monkeypatch.setattr(E.R, "gstats", lambda expected, reps, by: (
        plans.append(expected._jdf.queryExecution().optimizedPlan().toString()), gstats(expected, reps, by))[1])
    out = QUERIES["evaluation_threshold_runs"](spark, path).collect()
    assert made.value == N and len(out) == 5 * (3 + 61)
    assert len(plans) == 1 and "EXP(" not in plans[0]  # a stored probability is filtered, not its expression


def test_label_totals(spark):
    """Masses made of counts are those summed over rows."""
    labels = Labels((0.1, 0.3))
    df = spark.range(90).selectExpr(
        "cast(id % 2 AS string) AS model", f"cast(id % 3 AS int) AS {PASSED}", "(id % 8) / 8e0 AS pw",
        "if(id % 5 = 0, NULL, id % 4 = 0) AS ispb", "id % 7 = 0 AS ospb")
    want = df.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_roi"), *[F.sum(m).alias(f"a{j}") for j, m in enumerate(labels.masses())],
        *[F.sum(F.col("pw") * m).alias(f"b{j}") for j, m in enumerate(labels.masses())])
    got = labels.totals(df, ["model"], "pw")
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_sized_side_is_local(spark):
    df = spark.range(40).selectExpr("id", "cast(id AS int) AS i", "if(id = 3, NULL, id / 7e0) AS d", "if(id = 4, NULL, 'x') AS s",
                                    "if(id = 5, NULL, id > 7) AS b", "if(id = 6, cast('NaN' AS double), 0e0) AS n")
    side = sized(df)
    assert side.schema == df.schema and side.exceptAll(df).isEmpty() and df.exceptAll(side).isEmpty()
    assert "LocalRelation" in side._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in sized(df, 39)._jdf.queryExecution().optimizedPlan().toString()
    assert sized(df.select(F.array("id").alias("a"))).count() == 40 and sized(df.filter("id < 0")).isEmpty()

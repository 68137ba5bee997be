"""Bands rest on all replicates, whose draws meet the cells in tables as they do in the join."""

import hashlib

import numpy as np
import pytest

import registry.resampling as resampling
from meltgrid.functions.draws import NumberedKeys, numbered_spans
from meltgrid.operators import resample as R
from registry.base import QUERIES
from registry.fixtures import Tables

N = 260
NAN = "cast('NaN' AS double)"


@pytest.mark.parametrize("prefix", [b"42|A|3|", b"x" * 49 + b"|", b"y" * 131])
@pytest.mark.parametrize("tail", [b"", b"|p"])
def test_keyed_numbers(prefix, tail):
    got = [NumberedKeys(len(prefix), first, count, tail).uniform(prefix, count)
           for first, count in numbered_spans(1203, len(prefix) + len(tail), 500)]
    want = [int(hashlib.md5(prefix + b"%d" % i + tail).hexdigest()[:13], 16) / 2**52 for i in range(1203)]
    assert np.concatenate(got).tolist() == want


@pytest.fixture
def rows(spark):
    return spark.range(N).selectExpr(
        f"element_at(array('A', 'é | {'b' * 50}', 'C', NULL), cast(id % 4 AS int) + 1) AS model", "cast(id DIV 20 AS int) AS ri",
        "cast(id % 20 AS int) AS ci", f"CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN {NAN} ELSE (id % 10) / 9e0 END AS pw",
        "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 4 = 1 THEN (id % 7) / 6e0 - 1e-1 ELSE id DIV 4 % 2 END AS y",
        "if(id % 5 = 0, NULL, id % 3 = 0) AS ispb", "id % 3 = 1 AND id % 4 <> 2 AS ospb")


@pytest.mark.parametrize("balance", [False, True])
@pytest.mark.parametrize("table_rows,reps", [(4_000_000, 100), (23, 4)])
def test_tables_equal_the_join(spark, rows, balance, table_rows, reps, monkeypatch):
    cfg = R.BootConfig(n_boot=11, seed=42, draws="md5", balance=balance)
    made = []

    def tables(base, n, cfg):
        made.append(R._joined_replicates(base, n, cfg))
        return sums(base, n, cfg, table_rows, reps)

    sums = R._table_sums
    monkeypatch.setattr(R, "_table_sums", tables)
    got = R.bootstrap_cells(rows, cfg)
    assert got.dtypes == made[0].dtypes
    order = lambda df: df.toPandas().sort_values(["model", "rep"])
    a, b = order(got), order(made[0])
    assert len(a) == 33 and a[["model", "rep"]].values.tolist() == b[["model", "rep"]].values.tolist()
    assert np.allclose(a.iloc[:, 2:].astype(float), b.iloc[:, 2:].astype(float), rtol=0, atol=1e-9, equal_nan=True)
    assert not a["rec_out_dry"].notna()[a["model"] == "C"].any() and a["rec_out_dry"].notna().any()


def test_no_rows(spark, rows):
    assert R.bootstrap_cells(rows.limit(0), R.BootConfig(n_boot=3, draws="md5")).count() == 0


def test_no_row_for_a_draw(rows):
    plan = R.bootstrap_cells(rows, R.BootConfig(n_boot=300, draws="md5"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "299" not in plan


def bands_of(name, spark, rows, monkeypatch):
    """What a query of the bands returns for given rows, and the replicates that it makes for them."""
    seen, gstats = [], R.gstats
    monkeypatch.setattr(resampling, "weighted_rows", lambda t: rows.filter("model IN ('A', 'C')"))
    monkeypatch.setattr(R, "gstats", lambda expected, reps: (seen.append(reps), gstats(expected, reps))[1])
    return QUERIES[name], seen


def test_bands_rest_on_all_replicates(spark, rows, monkeypatch):
    query, seen = bands_of("bootstrap_bands", spark, rows, monkeypatch)
    got = {(r["model"], r["metric"]): r for r in query(spark, "none").collect()}
    reps = seen[0].toPandas()
    assert len(got) == 18 and sorted(reps["rep"]) == sorted([*range(1000)] * 2)
    for model, mine in reps.groupby("model"):
        v = np.sort(mine["rec"].to_numpy())
        assert got[model, "rec"]["lo95"] == round((v[24] + v[25]) / 2, 6) and got[model, "rec"]["hi50"] == round((v[749] + v[750]) / 2, 6)


def test_bands_against_center_rest_on_all_replicates(spark, rows, monkeypatch, tmp_path):
    query, seen = bands_of("metric_against_center", spark, rows, monkeypatch)
    cells = spark.range(N).selectExpr(
        "id AS cell_id", "cast(id DIV 20 AS int) AS ri", "cast(id % 20 AS int) AS ci", "1e2 * (id % 20) AS x_m",
        "1e2 * (id DIV 20) AS y_m", "2e3 + id AS h", "(id % 10) / 2e1 AS q", "213e0 AS ts", "2e-2 AS mb", "1e0 AS icevel",
        "1e0 AS vx", "1e0 AS vy", "2e1 + id % 17 AS mean_qty", "id % 4 < 2 AS ispb", "id % 4 >= 2 AS ospb", "true AS sink",
        "id % 90 AS custkey")
    Tables(spark, str(tmp_path))._kept("cells", lambda: cells)
    got = {r["model"]: r for r in query(spark, str(tmp_path)).collect()}
    reps = seen[0].toPandas()
    assert set(got) == {"A", "C"} and sorted(reps["rep"]) == sorted([*range(1000)] * 2)
    for model, mine in reps.groupby("model"):
        v = np.sort(mine["g_mean"].to_numpy())
        assert got[model]["lo95"] == round((v[24] + v[25]) / 2, 6) and got[model]["hi95"] == round((v[974] + v[975]) / 2, 6)

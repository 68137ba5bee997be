"""Families and thresholds without a row for each member, against one member at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltgrid.operators import components as C
from meltgrid.operators import flats as L
from meltgrid.operators import metrics as M
from meltgrid.operators import ordered as O
from meltgrid.operators import resample as R
from meltgrid.operators.labelled import Labels
from meltgrid.plans import dataset as D
from meltgrid.plans import evaluation as E

LO, HI, MARGIN = 35, 60, 1.5
TS = (0.1, 0.3, 0.775)


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        g = None if i % 41 == 0 else float(rng.integers(30, 66)) if i % 3 else float(rng.normal(48, 8))
        rows.append((i, i // 30, i % 30, g, float(rng.choice([0.0, -0.02, 0.25])), float(rng.choice([0.0, 1.5, 2.25])),
                     None if i % 37 == 0 else float(rng.random()), bool(rng.random() < 0.4), bool(rng.random() < 0.4), int(rng.integers(0, 25))))
    df = spark.createDataFrame(rows, "cell_id long, ri int, ci int, gmin double, delta double, adv double, q double, ispb boolean, "
                                     "ospb boolean, comp_id long").repartition(6)
    return df.withColumns({"y": F.coalesce((F.col("q") > 0.3).cast("int"), F.lit(0)), "w": F.coalesce("q", F.lit(0.0)),
                           "s_gmin": F.lit(0.0)}).cache()


def flat_rows(cells):
    """One row for each cell and flat."""
    rows = M.with_sigma(D.flat_rows(cells, cells, (LO, HI)).withColumns({c: F.lit(None).cast("double") for c in ("bmin", "bmax")}))
    return M.with_p_wet(M.decide(rows, MARGIN))


def table(df, *keys):
    return {tuple(r[k] for k in keys): {c: r[c] for c in sorted(df.columns) if c not in keys} for r in df.collect()}


def assert_tables(a, b, tol=1e-9):
    assert a.keys() == b.keys() and a
    for k, row in a.items():
        for c, v in row.items():
            assert v == b[k][c] if v is None or isinstance(v, str) else v == pytest.approx(b[k][c], abs=tol, rel=tol), (k, c)


@pytest.mark.parametrize("drop", [[], ["delta", "adv"]])
def test_flats_by_slot_equal_rows(cells, drop):
    plain = cells.drop(*drop)
    slots, rows = L.with_slots(plain, LO, HI, MARGIN), flat_rows(plain)
    assert_tables(table(L.flat_points(slots, LO, HI), "model"), table(M.point_metrics(rows), "model"))
    assert_tables(table(L.flat_expected(slots.withColumn("y", F.col("w")), LO, HI), "model"),
                  table(M.expected_metrics(rows.withColumn("y", F.col("w"))), "model"))


def test_thresholds_by_class_equal_one_at_a_time(cells):
    labels = Labels(TS)
    rows = labels.mark(flat_rows(cells))
    both = table(labels.expected(rows), "model", "threshold")
    slots = table(L.flat_expected(labels.mark(L.with_slots(cells, LO, HI, MARGIN)), LO, HI, labels), "model", "threshold")
    assert_tables(both, slots)
    for t in TS:
        one = table(M.expected_metrics(rows.withColumn("y", F.coalesce((F.col("q") > t).cast("int"), F.lit(0)))), "model")
        assert_tables({k: v for k, v in both.items() if k[1] == t}, {(*k, t): v for k, v in one.items()})


@pytest.mark.parametrize("kind", ["cells", "components", "flat cells", "flat hard", "flat components"])
def test_replicates_of_a_threshold_are_those_of_its_label(cells, kind):
    """Draws do not depend on labels, so the sums kept by class must give each threshold's own replicates."""
    ts = TS[1:]
    cfg, labels = R.BootConfig(n_boot=4), Labels(ts)
    rows = cells.withColumns({"model": F.lit("A"), "pw": F.col("w") * 0.5 + 0.25}).drop("w")
    rows = L.with_slots(rows, LO, HI, MARGIN)
    make = {"cells": lambda df, lab: R.bootstrap_cells_blocked(df, cfg, labels=lab, tile=200),
            "components": lambda df, lab: R.bootstrap_components_blocked(df, cfg, labels=lab, chunk=100, count_rows=60),
            "flat cells": lambda df, lab: L.bootstrap_flats_blocked(df, cfg, LO, HI, labels=lab, tile=200),
            "flat hard": lambda df, lab: L.bootstrap_flats_hard(df, cfg, LO, HI, lab),
            "flat components": lambda df, lab: L.bootstrap_flats_components(df, cfg, LO, HI, labels=lab)}[kind]
    both = table(make(labels.mark(rows), labels), "model", "rep", "threshold")
    if "hard" in kind:  # counts of other classes are other draws: every replicate keeps the number of cells
        assert {round(r["tp"] + r["fp"] + r["tn"] + r["fn"], 6) for r in both.values()} == {900.0}
        return
    for t in ts:
        one = make(rows.withColumn("y", F.coalesce((F.col("q") > t).cast("int"), F.lit(0))), Labels())
        assert_tables({k: v for k, v in both.items() if k[2] == t}, {(*k, t): v for k, v in table(one, "model", "rep").items()})


@pytest.mark.parametrize("form", ["cells", "hard", "balance", "components"])
def test_flat_replicates_have_the_mean_and_spread_of_rows(cells, form):
    """Against one model at a time: some flats as rows, resampled by the form for any model."""
    n, some = 400, [f"Flat_{v}" for v in (40, 48, 55)]
    slots, rows = L.with_slots(cells, LO, HI, MARGIN), flat_rows(cells).filter(F.col("model").isin(some))
    cfg = R.BootConfig(n_boot=n, balance=form == "balance")
    if form == "components":
        got, want = L.bootstrap_flats_components(slots, cfg, LO, HI), R.bootstrap_components_blocked(rows, cfg)
    elif form == "hard":
        got, want = L.bootstrap_flats_hard(slots, cfg, LO, HI), R.bootstrap_cells_hard(rows, cfg)
    else:
        label = F.col("y") if form == "balance" else F.col("w")
        got = L.bootstrap_flats_blocked(slots.withColumn("y", label), cfg, LO, HI, tile=250)
        want = R.bootstrap_cells_blocked(rows.withColumn("y", label), cfg, tile=250)
    got, want = got.filter(F.col("model").isin(some)).toPandas(), want.toPandas()
    for m in some:
        for c in ("tp", "fp", "tn", "fn", "rec_in_wet", "rec_out_dry"):
            x, y = got[got.model == m][c], want[want.model == m][c]
            assert abs(x.mean() - y.mean()) <= 5 * (x.std() + y.std()) / np.sqrt(n) + 1e-9
            assert x.std() < 1e-9 and y.std() < 1e-9 or 0.75 < x.std() / y.std() < 1.33


def test_no_row_for_cell_and_flat_is_shuffled(cells):
    """Below the groups that draw nothing multiplies the cells; flats appear above the sums only."""
    slots = L.with_slots(cells, LO, HI, MARGIN).withColumn("y", F.col("w"))
    plan = L.bootstrap_flats_blocked(slots, R.BootConfig(n_boot=2), LO, HI)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.rsplit("FlatMapGroupsInArrow", 1)
    assert "Generate" in above and "Generate" not in below and "Flat_" not in below


def test_sweep_equals_sweep_by_rows(cells, spark):
    """Expected metrics of the class form and of the form with rows for each threshold."""
    base = cells.withColumns({"x_m": F.col("ci") * 1000.0, "y_m": F.col("ri") * 1000.0, "h": F.lit(2000.0) + F.col("ri"),
                              "ts": F.lit(230.0) + F.col("ci") / 10.0, "mb": F.lit(0.1), "icevel": F.lit(1.0), "sink": F.col("ri") % 3 > 0})
    base = base.drop("gmin", "delta", "adv", "y", "w", "s_gmin", "comp_id")
    models = cells.select("cell_id", F.lit("A").alias("model"), F.lit(50.0).alias("g"), (F.col("cell_id") % 5 + 1.0).alias("sigma"),
                          F.lit(None).cast("double").alias("bmin"), F.lit(None).cast("double").alias("bmax"))
    cfg = E.EvalConfig(truth="binary", calibrate=False, boot=R.BootConfig(n_boot=3), flats=(LO, HI))
    want = {}
    for boot in (cfg.boot, R.BootConfig(n_boot=3, balance=True)):
        out = E.sweep(base, models, TS, E.replace(cfg, boot=boot))
        got = {(r["model"], r["threshold"], r["metric"]): r["exp"] for r in out.collect()}
        want = want or got
        assert got.keys() == want.keys() and len(got) == (HI - LO + 2) * 3 * 9
        assert all(v == pytest.approx(want[k]) for k, v in got.items())


def test_bundles_of_small_regions_are_bounded(spark):
    """20,000 regions of five cells and 1000 replicates: both sides of every group stay within their bounds."""
    df = spark.range(100_000).select(
        F.lit("A").alias("model"), F.col("id").alias("cell_id"), (F.col("id") / 5 + 1).cast("long").alias("comp_id"), F.lit(0.5).alias("pw"),
        F.lit(1.0).alias("y"), F.lit(True).alias("ispb"), F.lit(False).alias("ospb"))
    comps = R.component_table(df).cache()
    cells, counts = R.region_bundles(df, comps, R.BootConfig(n_boot=1000), chunk=25_000, count_rows=500_000)
    keys = ["model", "_bundle", "_reps"]
    most = [side.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first() for side in (cells, counts)]
    print("largest groups:", most[0][0], "cells,", most[1][0], "draw counts")
    assert most[0][0] <= 25_000 + 5 and most[1][0] <= 500_000
    assert most[0][1] == 100_000 * counts.select("_reps").distinct().count()


WIDE = [1.7e308, -1.7e308, 0.0, 1e-300, 5.0, 5.0, 5.0, -3.0, 1e308, -1e308, 2.0, 7.0]


@pytest.mark.parametrize("values, sample", [(WIDE, 20_000), (WIDE * 30, 60), ([5.0] * 400 + WIDE, 50), ([2.0**i for i in range(-500, 500)], 100)])
def test_quantiles_of_wide_and_tied_values_end(spark, monkeypatch, values, sample):
    monkeypatch.setattr(O, "SAMPLE_ROWS", sample)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    ps = {"a": 0.0, "b": 0.1, "m": 0.5, "y": 0.77, "z": 1.0}
    got = O.midpoint_quantile(df, "v", ps, group_rows=4, pairs=True).first()
    s = sorted(values)
    for name, p in ps.items():
        pos = min(max(len(s) * p + 0.5, 1.0), len(s))
        k = int(pos)
        assert (got[f"{name}_lo"], got[f"{name}_hi"]) == (s[k - 1], s[min(k, len(s) - 1)])


def test_running_totals_of_wide_values(spark):
    df = spark.createDataFrame([(v, 1) for v in sorted(set(WIDE + [2.0**i for i in range(-200, 200)]))], "v double, n int").repartition(3)
    got = [r["cum_n"] for r in O.prefix_sums(df, [], "v", ["n"], 10).orderBy("v").collect()]
    assert got == list(range(1, df.count() + 1))


@pytest.mark.parametrize("conn, tile", [(8, 4), (4, 7)])
def test_regions_do_not_depend_on_tiles(spark, conn, tile):
    rng = np.random.default_rng(5)
    mask = rng.random((45, 61)) < 0.5
    cells = spark.createDataFrame([(int(r) - 9, int(c) + 3) for r, c in zip(*np.nonzero(mask))] * 2, "ri int, ci int").repartition(5)
    whole, cut = ({(r["ri"], r["ci"]): r["comp_id"] for r in C.connected_components(cells, conn, 2, tile=t).collect()} for t in (512, tile))
    assert whole == cut and len(set(cut.values())) > 1


def test_edges_grow_with_tile_borders(spark):
    """A full square: no edge within a tile, two edges or so for each cell of a border."""
    cells = spark.range(64 * 64).select(F.lit(0).alias("area"), (F.col("id") / 64).cast("int").alias("ri"), (F.col("id") % 64).cast("int").alias("ci"),
                                        F.lit(False).alias("wet"))
    for tile, tiles in ((64, 1), (32, 4), (16, 16)):
        edges = C.border_edges(C.tile_regions(cells, 8, tile), 8, tile)
        assert edges.count() <= 4 * tiles and (edges.count() > 0) == (tiles > 1)

"""Properties the evaluation must keep, and tiny grids checked by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltgrid.functions import physics as X
from meltgrid.functions.mathx import erf, uniform
from meltgrid.functions.nulls import at_least, clean
from meltgrid.functions.truth import p_wet, truth_weight
from meltgrid.operators import fields as Y
from meltgrid.operators import grid as G
from meltgrid.operators import metrics as M
from meltgrid.operators import models as D
from meltgrid.operators import resample as R
from meltgrid.operators import spatial as P
from meltgrid.operators import sweeps as W
from meltgrid.operators.masks import with_masks
from meltgrid.plans import dataset
from meltgrid.sources import files as S


@pytest.fixture(scope="module")
def rows(spark):
    """Scored rows of two models with a lopsided area split."""
    rng = np.random.default_rng(0)
    data = []
    for m in ("A", "B"):
        for i in range(1500):
            data.append((m, i, i // 50, i % 50, float(rng.normal(2, 8)), int(rng.random() < 0.4), float(i % 5), i % 3 == 0, i % 3 == 1, i // 75))
    df = spark.createDataFrame(data, "model string, cell_id long, ri int, ci int, gdiff double, y int, s_model double, ispb boolean, ospb boolean, comp_id long")
    df = df.withColumns({"s_gmin": F.lit(0.0), "margin": F.lit(0.0), "q": F.col("cell_id") % 40 / 40})
    df = df.withColumn("pred", at_least(F.col("gdiff"), 0.0))
    return M.with_p_wet(df).withColumn("s_total", F.col("s_model")).cache()


def test_missing_margin_predicts_dry(spark):
    df = spark.createDataFrame([(float("nan"),), (9999.0,), (None,), (float("inf"),), (1.0,)], "v double")
    got = [r[0] for r in df.select(at_least(clean(F.col("v")), 0.0)).collect()]
    assert got == [False, False, False, False, True]


def test_erf_stays_within_its_bound(spark):
    xs = [i / 50 for i in range(-200, 201)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erf(F.col("x")).alias("e"))
    assert max(abs(r["e"] - math.erf(r["x"])) for r in df.collect()) < 1.5e-7


def test_counts_add_up_and_soft_equals_hard_for_hard_labels(rows):
    hard = {r["model"]: r for r in M.confusion(rows, ["model"]).collect()}
    soft = {r["model"]: r for r in M.confusion_soft(rows, ["model"], label="y").collect()}
    for m, h in hard.items():
        assert h["tp"] + h["fp"] + h["tn"] + h["fn"] == 1500
        for c in ("tp", "fp", "tn", "fn", "acc", "prec", "spec", "rec", "f1", "g_mean"):
            assert soft[m][c] == pytest.approx(h[c])


def test_expected_equals_hard_without_spread(rows):
    sure = M.with_p_wet(rows.withColumn("s_model", F.lit(0.0)))
    hard = {r["model"]: r for r in M.confusion(sure, ["model"]).collect()}
    for r in M.confusion_expected(sure, ["model"]).collect():
        assert [r[c] for c in ("tp", "fp", "tn", "fn")] == [hard[r["model"]][c] for c in ("tp", "fp", "tn", "fn")]


def test_empty_area_has_no_recall(rows):
    r = M.regional_recall(rows.withColumn("ispb", F.lit(False)), ["model"], "pred", "y").first()
    assert r["rec_in_wet"] is None and r["g_regional"] is None and r["rec_out_dry"] is not None


def test_step_probability_for_zero_sigma(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (None, 0.0), (None, 2.0)], "g double, s double")
    assert [r[0] for r in df.select(p_wet(F.col("g"), F.col("s"), F.lit(0.0), 0.0)).collect()] == [1.0, 0.0, 0.0, None]


def test_flat_family_equals_one_model_at_a_time(rows):
    cells = rows.filter("model = 'A'").withColumn("gmin", F.when(F.col("cell_id") % 11 != 0, 50.0 - F.col("gdiff")))
    fast = {r["model"]: r for r in W.flat_confusion(cells, "y", 35, 60, margin=1.5).collect()}
    slow = D.with_flat_fields(cells.drop("model"), 35, 60)
    slow = M.decide(slow.withColumn("gdiff", F.col("g") - F.col("gmin")), 1.5)
    for r in M.confusion(slow, ["model"]).collect():
        assert [fast[r["model"]][c] for c in ("tp", "fp", "tn", "fn")] == [r[c] for c in ("tp", "fp", "tn", "fn")]


def test_threshold_sweep_equals_separate_runs(rows):
    ts = [0.1, 0.3, 0.775, 2.0]
    fast = {(r["model"], r["threshold"]): r for r in W.threshold_sweep(rows, ts).collect()}
    for t in ts:
        for r in M.confusion(rows.withColumn("y", (F.col("q") > t).cast("int")), ["model"]).collect():
            assert [fast[r["model"], t][c] for c in ("tp", "fp", "tn", "fn")] == [r[c] for c in ("tp", "fp", "tn", "fn")]


def test_bootstrap_does_not_depend_on_partitioning(rows):
    cfg = R.BootConfig(n_boot=3)
    a, b = (sorted(map(repr, R.bootstrap_cells(rows.repartition(n), cfg).select("model", "rep", "tp", "rec_in_wet").collect()))
            for n in (1, 9))
    assert a == b and len(a) == 6
    a, b = (sorted(map(repr, R.bootstrap_components(rows.repartition(n), cfg).select("model", "rep", "tp").collect())) for n in (1, 9))
    assert a == b and len(a) == 6


def test_replicates_keep_the_sample_size(rows):
    for balance in (False, True):
        for r in R.bootstrap_cells(rows, R.BootConfig(n_boot=4, balance=balance)).collect():
            assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == 1500
    pos = rows.filter("model = 'A' AND y = 1").count()
    for r in R.bootstrap_cells(rows, R.BootConfig(n_boot=4, balance=True)).filter("model = 'A'").collect():
        assert r["tp"] + r["fn"] == pos


def test_exact_counts_agree_with_resampling(rows):
    """Mean and spread of the class counts of both forms."""
    n = 120
    a = R.bootstrap_cells(rows, R.BootConfig(n_boot=n)).toPandas()
    b = R.bootstrap_cells_hard(rows, R.BootConfig(n_boot=2000)).toPandas()
    for m in ("A", "B"):
        for c in ("tp", "fp", "tn", "fn", "rec_in_wet", "rec_out_dry"):
            x, y = a[a.model == m][c], b[b.model == m][c]
            assert abs(x.mean() - y.mean()) < 5 * y.std() / math.sqrt(n)
            assert 0.7 < x.std() / y.std() < 1.4


@pytest.mark.parametrize("kw", [{}, {"pred": "noisy"}, {"balance": True}])
def test_blocked_form_agrees_with_resampling(rows, kw):
    n = 120
    a = R.bootstrap_cells(rows, R.BootConfig(n_boot=n, **kw)).toPandas()
    b = R.bootstrap_cells_blocked(rows, R.BootConfig(n_boot=400, **kw)).toPandas()
    assert set(b.tp + b.fp + b.tn + b.fn) == {1500.0} and len(b) == 800
    for m in ("A", "B"):
        for c in ("tp", "fp", "tn", "fn", "rec_in_wet", "rec_out_dry"):
            x, y = a[a.model == m][c], b[b.model == m][c]
            assert abs(x.mean() - y.mean()) < 5 * y.std() / math.sqrt(n)
            assert 0.7 < x.std() / y.std() < 1.4


@pytest.mark.parametrize("kw", [{}, {"pred": "noisy"}, {"by_size": True}])
def test_blocked_regions_agree_with_joined_form(rows, kw, monkeypatch):
    monkeypatch.setattr(R, "REGION_CHUNK", 40)
    df = rows.withColumn("comp_id", F.when(F.col("comp_id") % 3 == 0, 0).otherwise(F.col("comp_id")))
    a = R.bootstrap_components(df, R.BootConfig(n_boot=120, **kw)).toPandas()
    b = R.bootstrap_components_blocked(df, R.BootConfig(n_boot=120, **kw)).toPandas()
    # The drawn regions are the same, so sizes agree replicate by replicate.
    size = [x.set_index(["model", "rep"]).sort_index() for x in (a, b)]
    total = [(x.tp + x.fp + x.tn + x.fn).round(6).tolist() for x in size]
    assert total[0] == total[1] and len(a) == 240
    for c in ("tp", "fp", "tn", "fn", "rec_in_wet", "rec_out_dry"):
        assert abs(size[0][c] - size[1][c]).mean() < 3 * size[1][c].std()
        assert abs(size[0][c].mean() - size[1][c].mean()) < 0.6 * size[1][c].std()


def test_blocked_form_does_not_depend_on_partitioning(rows):
    cfg = R.BootConfig(n_boot=3)
    a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in
                   R.bootstrap_cells_blocked(rows.repartition(n), cfg).select("model", "rep", "tp", "rec_in_wet").collect())
            for n in (1, 9))
    assert a == b and len(a) == 6


def test_models_without_regions_fall_back_to_cells(rows):
    df = rows.withColumn("comp_id", F.when(F.col("model") == "A", F.col("comp_id")).otherwise(0))
    cfg = R.BootConfig(n_boot=2)
    out = R.bootstrap_components(df, cfg).filter("model = 'B'").orderBy("rep").collect()
    want = R.bootstrap_cells(df.filter("model = 'B'"), cfg).orderBy("rep").collect()
    assert [r["tp"] for r in out] == [r["tp"] for r in want]


def test_large_regions_are_split_without_changing_draws(rows, monkeypatch):
    cfg = R.BootConfig(n_boot=3)
    want = sorted(map(repr, R.bootstrap_components(rows, cfg).select("model", "rep", "tp", "fn").collect()))
    monkeypatch.setattr(R, "REGION_CHUNK", 10)
    assert sorted(map(repr, R.bootstrap_components(rows, cfg).select("model", "rep", "tp", "fn").collect())) == want


def test_uniform_draws_are_uniform(spark):
    for kind in ("md5", "fast"):
        u = spark.range(20000).select(uniform(F.lit(1), F.col("id"), kind=kind).alias("u"))
        r = u.agg(F.avg("u"), F.min("u"), F.max("u"), F.stddev("u")).first()
        assert abs(r[0] - 0.5) < 0.01 and r[1] >= 0 and r[2] < 1 and abs(r[3] - 12 ** -0.5) < 0.01


def test_gradient_of_a_plane_and_of_a_hole(spark):
    g = G.cell_grid(spark, 0, 400, 0, 300, 100).withColumn("v", 2.0 * F.col("x_m") - 3.0 * F.col("y_m"))
    for r in G.gradient2d(g, ["v"], 100.0, 100.0).collect():
        assert (r["dv_dx"], r["dv_dy"]) == (pytest.approx(2.0), pytest.approx(-3.0))
    holed = g.withColumn("v", F.when((F.col("ri") != 1) | (F.col("ci") != 1), F.col("v")))
    got = {(r["ri"], r["ci"]): r for r in G.gradient2d(holed, ["v"], 100.0, 100.0).collect()}
    assert got[1, 0]["dv_dx"] is None and got[1, 2]["dv_dx"] is None and got[0, 1]["dv_dy"] is None
    assert got[1, 1]["dv_dx"] == pytest.approx(2.0)


def test_gradient_across_tile_edges(spark, monkeypatch):
    g = G.cell_grid(spark, 0, 2000, 0, 1500, 100).withColumn("v", F.col("x_m") * F.col("x_m") + F.col("y_m"))
    want = sorted(map(tuple, G.gradient2d(g, ["v"], 100.0, 100.0).select("ri", "ci", "dv_dx", "dv_dy").collect()))
    monkeypatch.setattr(G, "TILE", 4)
    assert sorted(map(tuple, G.gradient2d(g, ["v"], 100.0, 100.0).select("ri", "ci", "dv_dx", "dv_dy").collect())) == want
    assert len(want) == 21 * 16


def test_sizes_that_differ_are_an_error(spark):
    a = G.cell_grid(spark, 0, 300, 0, 300, 100).select("ri", "ci", F.lit(1.0).alias("a"))
    with pytest.raises(ValueError):
        G.stack_layers({"a": a, "b": a.filter("ri > 0")})


def test_points_on_edges_rings_and_parts(spark):
    square = [("R", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    square += [("R", 0, 4, None, None)] + [("R", 0, 5 + i, x, y) for i, (x, y) in enumerate([(10.0, 0.0), (12.0, 0.0), (11.0, 3.0)])]
    other = [("R", 1, i, x, y) for i, (x, y) in enumerate([(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)])]
    polys = spark.createDataFrame(square + other, "region string, part int, seq int, x_m double, y_m double")
    pts = [(0, 2.0, 2.0), (1, 4.0, 2.0), (2, 0.0, 0.0), (3, 3.5, 3.5), (4, 11.0, 1.0), (5, 8.0, 2.0), (6, 11.0, 3.0), (7, 5.0, 5.0), (8, -1.0, 0.0)]
    df = spark.createDataFrame(pts, "pid int, x_m double, y_m double")
    got = sorted(r["pid"] for r in P.points_in_polygons(df, polys, 1.0, ["pid"]).collect())
    assert got == [0, 1, 2, 3, 4, 6, 7]


def test_nearest_points_with_a_dense_cluster(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y), float(i % 9)) for i, (x, y) in enumerate(
        np.vstack([rng.uniform(0, 900, (60, 2)), rng.normal(450, 15, (400, 2))]))]
    pts += [(1000, pts[0][1], pts[0][2], 99.0)]
    df = spark.createDataFrame(pts, "pid int, x_m double, y_m double, z double")
    grid = G.cell_grid(spark, 0, 900, 0, 900, 100)
    got = {(r["ri"], r["ci"]): r["z_interp"] for r in P.interp_points(df, grid, step=100.0, radius=250.0, k=3).collect()}
    for (ri, ci), z in got.items():
        d = sorted(((p[1] - 100 * ci) ** 2 + (p[2] - 100 * ri) ** 2, p[0], p[3]) for p in pts[:-1])[:3]
        d = [(dd, zz) for dd, _, zz in d if dd <= 250.0**2]
        want = sum(zz / max(dd, 1e-6) for dd, zz in d) / sum(1 / max(dd, 1e-6) for dd, _ in d) if d else None
        assert z == (pytest.approx(want) if want is not None else None)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a in range(-170, 180, 35) for b in range(-89, -60, 4)], "lon double, lat double")
    x, y = X.to_polar_stereo(F.col("lon"), F.col("lat"))
    back = df.withColumns({"x": x, "y": y})
    lon, lat = X.from_polar_stereo(F.col("x"), F.col("y"))
    for r in back.select("lon", "lat", lon.alias("lo"), lat.alias("la")).collect():
        assert (r["lo"], r["la"]) == (pytest.approx(r["lon"], abs=1e-8), pytest.approx(r["lat"], abs=1e-8))


def test_exact_mean_after_limits(spark):
    df = spark.range(1000).select((F.col("id") % 90).cast("double").alias("g"))
    for mu in (25.0, 40.0, 55.5):
        out = Y.clamp_exact_mean(df, "g", mu, 20.0, 60.0)
        r = out.agg(F.avg("g"), F.min("g"), F.max("g")).first()
        assert r[0] == pytest.approx(mu, abs=1e-6) and r[1] >= 20 and r[2] <= 60
    assert Y.clamp_exact_mean(df, "g", 10.0, 20.0, 60.0).agg(F.max("g")).first()[0] == 20.0


def test_one_class_scores_zero(spark):
    cells = G.cell_grid(spark, 0, 900, 0, 900, 100).withColumns({
        "gmin": F.lit(40.0), "roi": F.lit(True), "spec_valid": F.lit(True), "y": F.lit(1), "w": F.lit(1.0)})
    cands = spark.createDataFrame([(50.0, 10.0, 30.0)], "mu double, a double, theta double")
    for truth in ("binary", "weighted"):
        r = Y.score_candidates(cells, cands, Y.FieldConfig(truth=truth)).first()
        assert (r["g_mean"], r["rec"], r["spec"]) == (0.0, 0.0, 0.0)


def test_candidates_in_several_chunks(spark, monkeypatch):
    cells = G.cell_grid(spark, 0, 900, 0, 900, 100).withColumns({
        "gmin": 40.0 + F.col("ci"), "roi": F.lit(True), "spec_valid": F.lit(True), "y": F.col("ri") % 2, "w": F.col("ri") / 9})
    cands = spark.createDataFrame([(40.0 + i, 5.0 * i, 10.0 * i) for i in range(7)], "mu double, a double, theta double")
    want = sorted(map(tuple, Y.score_candidates(cells, cands).collect()))
    monkeypatch.setattr(Y, "CHUNK", 2)
    monkeypatch.setattr(Y, "LATTICE", 2)
    got = sorted(map(tuple, Y.score_candidates(cells, cands).collect()))
    assert [pytest.approx(w, abs=1e-9) for w in want] == got and len(got) == 7


def test_sentinel_cells_are_missing_or_dry(spark):
    df = spark.createDataFrame([(9999.0,), (0.3,), (None,)], "q double").withColumns({
        c: F.lit(1.0) for c in ("h", "icevel", "x_m", "y_m")}).withColumn("sink", F.lit(True))
    valid = lambda **kw: [r["valid"] for r in with_masks(dataset.clean_layers(df, **kw)).collect()]
    assert valid() == [False, True, False]
    assert valid(sentinel_as_dry=True) == [True, True, False]
    kept = dataset.clean_layers(df, sentinel_as_dry=True).select(truth_weight(F.col("q"), "logistic"), "q").collect()
    assert kept[0][0] == 0.0 and kept[0]["q"] is None


def test_advection_of_level_ground_is_zero(spark):
    cells = G.cell_grid(spark, 0, 900, 0, 900, 100).withColumns({
        "h": F.lit(3000.0), "ts": F.lit(220.0), "mb": F.lit(0.05), "vx": F.lit(3.0), "vy": F.lit(4.0)})
    out = dataset.with_advection(cells, 100.0)
    assert out.count() == 100 and out.agg(F.max(F.abs("adv"))).first()[0] == 0.0


def test_result_runs_accumulate(spark, tmp_path):
    df = spark.range(3)
    for run in ("a", "b"):
        path = S.write_results(df, str(tmp_path), "table", run)
    assert spark.read.parquet(path).groupBy("run_id").count().count() == 2
    csv = S.write_results(df, str(tmp_path), "text", "a", "csv")
    assert spark.read.csv(csv, header=True).count() == 3


def test_cached_margins_are_not_rebuilt(spark, tmp_path):
    path = str(tmp_path / "g")
    one = spark.createDataFrame([("A", 1, 2.0)], "model string, cell_id int, gdiff double")
    S.cache_gdiff(one, path)
    assert S.cache_gdiff(one.withColumn("gdiff", F.lit(9.0)), path).first()["gdiff"] == 2.0


def test_cached_margins_follow_their_inputs(spark, tmp_path):
    """A file rewritten in place misses; a plan built again on a scratch table with the same rows hits."""
    from meltgrid.session import cut_lineage

    path, source = str(tmp_path / "g"), str(tmp_path / "in")
    rows = spark.createDataFrame([("A", i, float(i)) for i in range(40)], "model string, cell_id int, gdiff double")
    for add in (0.0, 5.0):
        rows.withColumn("gdiff", F.col("gdiff") + add).write.mode("overwrite").parquet(source)
        assert S.cache_gdiff(spark.read.parquet(source), path).agg(F.min("gdiff")).first()[0] == add
    again = lambda n: cut_lineage(rows.repartition(n)).withColumn("gdiff", F.col("gdiff") * 2)
    one = S.cache_gdiff(again(3), path).inputFiles()
    assert sorted(S.cache_gdiff(again(4), path).inputFiles()) == sorted(one)
    other = cut_lineage(rows.filter("cell_id > 0")).withColumn("gdiff", F.col("gdiff") * 2)
    assert sorted(S.cache_gdiff(other, path).inputFiles()) != sorted(one)


def test_two_writers_and_an_unfinished_table(spark, tmp_path):
    """The earliest manifest row of a key serves everybody; a table without one serves nobody."""
    import os

    path, other = str(tmp_path / "g"), str(tmp_path / "h")
    rows = spark.createDataFrame([("A", 1, 2.0)], "model string, cell_id int, gdiff double")
    first = S.cache_gdiff(rows, path).inputFiles()
    (row,) = os.listdir(f"{path}/manifest")
    key = row.split("-")[0]
    rows.withColumn("gdiff", F.lit(3.0)).write.partitionBy("model").parquet(f"{path}/tables/{key}-late")
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(f"{path}/tables/{key}-late").alias("place")).write.parquet(
        f"{path}/manifest/{key}-late")
    assert S.cache_gdiff(rows, path).inputFiles() == first
    rows.withColumn("gdiff", F.lit(3.0)).write.partitionBy("model").parquet(f"{other}/tables/{key}-torn")
    assert S.cache_gdiff(rows, other).first()["gdiff"] == 2.0 and len(os.listdir(f"{other}/tables")) == 2


def test_stored_layers_join_without_an_exchange(spark, tmp_path):
    cells = G.cell_grid(spark, 0, 2900, 0, 1900, 100)
    layers = {"a": cells.select("ri", "ci", (F.col("ri") * 0.5).alias("a")), "b": cells.select("ri", "ci", (F.col("ci") * 2.0).alias("b")).filter("ri > 3")}
    for name, df in layers.items():
        S.store_layer(df, str(tmp_path / name), buckets=5)
    stored = {name: S.stored_layer(spark, str(tmp_path / name)) for name in layers}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined, plain = G.align(stored["a"], stored["b"]), G.align(layers["a"], layers["b"])
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (joined, plain)]
        assert "Exchange" not in plans[0] and "Exchange" in plans[1]
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect())) and joined.count() == 480
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([f for f in stored["a"].inputFiles()]) == 5


def test_exact_mean_meets_a_plain_search(spark):
    rng = random.Random(3)
    for values in ([rng.choice([0.0, 10.0, 100.0]) for _ in range(50)], [rng.gauss(50, 40) for _ in range(80)] + [None], [7.0] * 5):
        df = spark.createDataFrame([(v,) for v in values], "g double")
        known = [v for v in values if v is not None]
        for mu in (21.0, 40.0, 59.5):
            got = [r["g"] for r in Y.clamp_exact_mean(df, "g", mu, 20.0, 60.0).collect()]
            assert sum(v for v in got if v is not None) / len(known) == pytest.approx(mu, abs=1e-9) and got.count(None) == values.count(None)


@pytest.mark.parametrize("kw", [{}, {"enforce_mean": False}, {"floor": None, "cap": None}, {"floor": 44.0, "cap": 47.0, "margin": 1.0, "truth": "binary"}])
def test_candidates_by_lattice_equal_one_value_per_cell(spark, kw):
    """A topographic factor of one takes the form with a row for each cell and candidate."""
    cells = G.cell_grid(spark, 0, 1900, 0, 1400, 100).withColumns({
        "gmin": F.when(F.col("cell_id") % 17 > 0, (30 + F.col("cell_id") % 29).cast("double")), "roi": F.col("ci") > 2, "spec_valid": F.col("ri") < 9,
        "y": (F.col("cell_id") % 3 == 0).cast("int"), "w": F.when(F.col("cell_id") % 13 > 0, F.col("ri") / 14), "delta": F.lit(0.0)})
    rows = [(float(mu), a, th) for mu in (20, 31, 40, 44, 45, 60, 101) for a, th in ((0.0, 0.0), (12.0, 30.0), (-25.0, 75.0), (60.0, 120.0))]
    cands = spark.createDataFrame(rows + [(47.5, 12.0, 30.0)], "mu double, a double, theta double")
    cfg = Y.FieldConfig(**kw)
    fast, slow = ({(r["mu"], r["a"], r["theta"]): r for r in Y.score_candidates(cells, cands, cfg, delta=d).collect()} for d in (None, "delta"))
    assert fast.keys() == slow.keys() and len(fast) == 29
    for k, r in fast.items():
        assert all(r[c] == pytest.approx(slow[k][c], abs=1e-9) for c in ("rec", "spec", "mu_grid", "med_spec")), k

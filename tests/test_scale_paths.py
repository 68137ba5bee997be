"""Paths taken by groups too large for one task, forced by tiny limits, and brute-force checks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltgrid.operators import components as C
from meltgrid.operators import ordered as O
from meltgrid.operators import posterior as Q
from meltgrid.operators import resample as R
from meltgrid.operators import twosample as T2
from meltgrid.session import sized


def midpoint(values, p):
    v = sorted(values)
    pos = min(max(len(v) * p + 0.5, 1.0), len(v))
    k = int(pos)
    a, b = v[k - 1], v[min(k, len(v) - 1)]
    return a + (pos - k) * (b - a)


@pytest.fixture(scope="module")
def values(spark):
    """One group holds most rows; values are tied, heavy tailed and negative."""
    rng = random.Random(5)
    rows = [("hot", round(rng.lognormvariate(0, 4), 3)) for _ in range(900)]
    rows += [("hot", 1.5)] * 400 + [("cold", -float(i % 7)) for i in range(60)] + [("one", 3.0)]
    return rows, spark.createDataFrame(rows, "grp string, v double").repartition(5).cache()


PS = {"a": 0.0, "b": 0.025, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}


@pytest.mark.parametrize("limit", [10, 100, 10_000])
def test_quantiles_do_not_depend_on_the_path(values, limit):
    rows, df = values
    got = {r["grp"]: r for r in O.midpoint_quantile(df, "v", PS, ["grp"], group_rows=limit).collect()}
    for g in ("hot", "cold", "one"):
        have = [v for k, v in rows if k == g]
        assert got[g]["n"] == len(have)
        for name, p in PS.items():
            assert got[g][name] == pytest.approx(midpoint(have, p), rel=1e-12)


def test_quantile_without_groups_by_ranges(values):
    rows, df = values
    got = O.midpoint_quantile(df, "v", {"m": 0.37}, group_rows=20).first()
    assert got["m"] == pytest.approx(midpoint([v for _, v in rows], 0.37))


@pytest.mark.parametrize("by", [[], ["grp"]])
def test_prefix_sums_by_ranges_equal_window(values, by):
    _, df = values
    counts = O.value_counts(df, by, "v")
    a, b = (sorted(map(tuple, O.prefix_sums(counts, by, "v", ["n"], lim).select(*by, "v", "cum_n").collect()))
            for lim in (10, 10_000))
    assert a == b and len(a) > 500


def test_distribution_function_and_ranks_by_ranges(values):
    _, df = values
    for fn in (lambda lim: O.ecdf(df, "v", ["grp"], lim), lambda lim: O.avg_rank(df, "v", ["grp"], group_rows=lim)):
        a, b = (sorted(map(tuple, fn(lim).select(*sorted(fn(lim).columns)).collect())) for lim in (10, 10_000))
        assert a == b


def test_two_sample_tests_by_ranges(values):
    _, df = values
    src = df.withColumn("m", F.col("grp") == "hot")
    for fn in (T2.ranksum, T2.ks_2samp):
        assert tuple(fn(src, "v", "m", 10).first()) == pytest.approx(tuple(fn(src, "v", "m").first()))


def test_rank_sum_by_hand(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (4.0, False)], "v double, m boolean")
    row = T2.ranksum(df, "v", "m").first()
    assert (row["w"], row["u"], row["ps"]) == (3.5, 0.5, 0.5 / 6)


def test_density_interval_and_running_best_by_ranges(spark):
    rng = random.Random(1)
    xs = [round(rng.gauss(0, 1), 2) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(xs)), "iter long, gmean double")
    s, m = sorted(xs), int(0.95 * 600)
    spans = [(s[i + m] - s[i], i) for i in range(600 - m)]
    i = min(spans, key=lambda t: (round(t[0], 9), t[1]))[1]
    for lim in (50, 10_000):
        row = Q.hpd(df, "gmean", 0.05, group_rows=lim).first()
        assert row["hi"] - row["lo"] == pytest.approx(s[i + m] - s[i])
        best = [r["best"] for r in Q.running_best(df, group_rows=lim).orderBy("iter").collect()]
        assert best == list(np.maximum.accumulate(xs))


def flood(mask, conn):
    """Labels in column-major order of the first cell."""
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    label, n = {}, 0
    for c in range(mask.shape[1]):
        for r in range(mask.shape[0]):
            if mask[r, c] and (r, c) not in label:
                n += 1
                todo = [(r, c)]
                label[r, c] = n
                while todo:
                    a, b = todo.pop()
                    for dr, dc in near:
                        q = (a + dr, b + dc)
                        if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and q not in label:
                            label[q] = n
                            todo.append(q)
    return label


@pytest.mark.parametrize("conn,share", [(8, 0.35), (4, 0.6), (8, 0.9)])
def test_regions_equal_flood_fill(spark, conn, share):
    rng = np.random.default_rng(3)
    mask = rng.random((40, 150)) < share
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "ri int, ci int").repartition(7)
    got = {(r["ri"], r["ci"]): r["comp_id"] for r in C.connected_components(cells, conn, 1, group_rows=5).collect()}
    assert got == flood(mask, conn)


def test_long_snake_is_one_region(spark):
    """A path through every line end: the hooking chain is as long as the grid."""
    cells = [(r, c) for r in range(0, 60, 2) for c in range(70)]
    cells += [(r, 69 if r % 4 == 1 else 0) for r in range(1, 59, 2)]
    df = spark.createDataFrame(cells, "ri int, ci int")
    got = C.connected_components(df, 4)
    assert got.count() == len(cells) and got.agg(F.countDistinct("comp_id")).first()[0] == 1


def test_regions_below_the_size_are_dropped_before_numbering(spark):
    df = spark.createDataFrame([(0, 0), (3, 1), (3, 2), (9, 9), (9, 10), (8, 11)], "ri int, ci int")
    got = C.connected_components(df, 8, 2).groupBy("comp_id").count().orderBy("comp_id").collect()
    assert [tuple(r) for r in got] == [(1, 2), (2, 3)]


def test_weighted_pick_equals_search(spark):
    sizes = [1] * 40 + [500] + [2] * 30
    edges = np.cumsum(sizes) / sum(sizes)
    cdf = spark.createDataFrame(
        [("m", i, float(edges[i - 1]) if i else 0.0, float(e), len(sizes)) for i, e in enumerate(edges)],
        "model string, item int, lo double, hi double, n int")
    us = [0.0, 1e-12, 0.999999] + [random.Random(i).random() for i in range(300)] + [float(e) for e in edges[:-1]]
    draws = spark.createDataFrame([("m", i, u) for i, u in enumerate(us)], "model string, draw int, u double")
    got = {r["draw"]: r["item"] for r in R.pick_by_weight(draws, cdf, ["model"]).collect()}
    assert got == {i: int(np.searchsorted(edges, u, side="left")) for i, u in enumerate(us)}


def test_sized_side_beyond_its_limit_is_left_alone(spark):
    df = spark.range(50)
    assert sized(df, 10) is df
    assert sized(df, 50).count() == 50


def test_positions_are_dense_across_blocks(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") % 13).alias("b"), "id")
    out = O.dense_index(df, "b", ["id"], ["g"], group_rows=3)
    got = out.orderBy("g", "b", "id").groupBy("g").agg(F.collect_list("idx").alias("i")).collect()
    assert all(r["i"] == list(range(250)) for r in got)


def test_region_draws_do_not_depend_on_the_part_size(spark):
    rows = [("A", i, i // 10, i % 10, 0.3 + 0.05 * (i % 9), float(i % 2), i % 3 == 0, i % 3 == 1, 1 + i // 40) for i in range(200)]
    df = spark.createDataFrame(rows, "model string, cell_id long, ri int, ci int, pw double, y double, ispb boolean, ospb boolean, comp_id long")
    cfg = R.BootConfig(n_boot=6)
    whole, cut = (sorted(map(tuple, R.bootstrap_components_blocked(df, cfg, chunk=c).collect())) for c in (100_000, 7))
    assert [[round(v, 9) if isinstance(v, float) else v for v in r] for r in whole] == \
        [[round(v, 9) if isinstance(v, float) else v for v in r] for r in cut]


def test_block_shares_add_up():
    import numpy as np

    sizes = [3, 1, 10, 7, 4]
    starts = np.cumsum([0, *sizes[:-1]])
    got = [sum(k for _, _, k in R._block_shares([1, 2], int(a), n, 25, 400)) for a, n in zip(starts, sizes)]
    assert (sum(got) == 25).all() and all(abs(g.mean() - n) < 1 for g, n in zip(got, sizes))


def test_density_interval_pairs_stay_linear(spark):

    n = 5000
    df = spark.range(n).select(F.col("id").alias("iter"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    assert Q.hpd(df, "x", 0.05).first().asDict() == {"lo": 0.0, "hi": float(n * 95 // 100)}
    # Ranks of one block: at most RANK_BLOCK starts meet as many ends.
    blocks = n // Q.RANK_BLOCK + 2
    assert blocks * Q.RANK_BLOCK**2 <= 2 * Q.RANK_BLOCK * n


def test_narrowed_quantiles_equal_sorted_ones(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 20_011 / 7.0).alias("v"))
    ps = {"a": 0.1, "m": 0.5, "z": 0.97}
    want = sorted(map(tuple, O.midpoint_quantile(df, "v", ps, ["k"]).collect()))
    for store in (True, False):
        assert sorted(map(tuple, O.midpoint_quantile(df, "v", ps, ["k"], 50, store=store).collect())) == want


def test_polygon_holes_and_parts(spark):
    from meltgrid.operators import spatial as P

    ring = lambda part, at, pts: [("R", part, at + i, x, y) for i, (x, y) in enumerate(pts)]
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = ring(0, 0, square(0.0, 10.0)) + [("R", 0, 4, None, None)] + ring(0, 5, square(4.0, 6.0)) + ring(1, 0, square(4.5, 5.5))
    poly = spark.createDataFrame(rows, "region string, part int, seq int, x_m double, y_m double")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 4.2, 5.0), (3, 4.0, 5.0), (4, 1.0, 1.0), (5, 11.0, 1.0)], "id int, x_m double, y_m double")
    found = {k: {r["id"] for r in P.points_in_polygons(pts, poly, 3.0, ["id"], rings=k).collect()} for k in ("union", "parity")}
    assert found == {"union": {1, 2, 3, 4}, "parity": {1, 3, 4}}


def test_region_cut_by_an_area_counts_twice(spark):

    cells = [(0, c, 1 if c == 0 else 0) for c in range(5)]
    df = spark.createDataFrame(cells, "ri int, ci int, y int").withColumn("comp_id", F.lit(1))
    out = {r["region"]: r for r in C.region_stats(df, {"ALL": F.lit(True), "ENDS": F.col("ci") != 2}, 1.0).collect()}
    assert (out["ALL"]["comps"], out["ENDS"]["comps"], out["ENDS"]["cells"]) == (1, 2, 4)
    assert out["ENDS"]["pct_wet"] == 50.0 and out["ALL"]["pct_wet"] == 100.0


def test_candidates_are_clamped_before_they_are_told_apart(spark):
    from meltgrid.operators import fields as Y

    cands = spark.createDataFrame([(50.0, -3.0, 0.0), (50.0, -1.0, 0.0), (50.0, 2.0, 0.0)], "mu double, a double, theta double")
    parts = [p for part in Y._chunks(cands, Y.FieldConfig(nonneg=True)) for p in part]
    assert sorted(parts) == [(50.0, 0.0, 0.0), (50.0, 2.0, 0.0)]
    prior = Y.log_prior(cands, nonneg=True, a_range=(0.0, 1.0)).where("a < 0").select("log_prior").distinct()
    assert prior.count() == 1


def test_settled_results_outlive_their_scratch_tables(spark):
    import glob

    from meltgrid.session import cut_lineage, scratch_path, settled

    root = scratch_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0]
    before = len(glob.glob(f"{root}/**/*.parquet", recursive=True))
    out = settled(spark, lambda: cut_lineage(cut_lineage(spark.range(9).repartition(1)).filter("id > 2")))
    assert out.count() == 6 and len(glob.glob(f"{root}/**/*.parquet", recursive=True)) == before + len(out.inputFiles())


def test_scratch_scope_removes_its_tables(spark, tmp_path):
    import os

    from meltgrid.session import cut_lineage, scratch_scope

    with scratch_scope(spark) as folder:
        df = cut_lineage(spark.range(10))
        local = folder.removeprefix("file:")
        assert df.count() == 10 and os.listdir(local)
        df.write.parquet(str(tmp_path / "kept"))
    assert not os.path.exists(local) and spark.read.parquet(str(tmp_path / "kept")).count() == 10
    assert cut_lineage(spark.range(3)).count() == 3

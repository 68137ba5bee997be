"""Near-duplicate components against brute force over all pairs."""

import random
import re
from functools import partial

import numpy as np
import pytest
from corpus import SF, empty, frame, same, stored
from pyspark.sql import functions as F

from meltgrid.llm import near_dedup as N
from meltgrid.operators import components as C
from meltgrid.session import spread


def families(seed=1, groups=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "日本", "Abc"]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, "A b"), (n + 3, "a B"), (n + 4, " \n ")]


@pytest.mark.parametrize("block", [150_000, 400, 60])
def test_components_equal_brute_force(spark, block):
    rows = families()
    got = N.near_links(frame(spark, rows), block=block).collect()
    assert same([(r["_doc"], r["_n"], r["_root"]) for r in got], [w[:3] for w in N.brute_components(rows)])


def test_other_parameters(spark):
    rows = families(2)
    got = N.near_duplicates(frame(spark, rows), n=5, percent=80).collect()
    assert same(got, N.brute_components(rows, 5, 80))


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, 40).astype(np.uint64)) for _ in range(60)]
    got = N.shared_counts(sets)
    for i in range(60):
        for j in range(60):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(3, text), (1, text), (1, text), (7, text + " more"), (None, "alone one two three four five"), (9, None)]
    out = N.drop_near_duplicates(frame(spark, rows).withColumn("_doc", F.lit("mine"))).where("_doc = 'mine'").drop("_doc").collect()
    assert same(out, [(1, text), (None, "alone one two three four five"), (9, None)])


def test_registered_query_and_empty_table(spark):
    assert same(N.op8_near_dedup(spark, SF).collect(), N.brute_components(stored()))
    assert N.near_duplicates(empty(spark)).count() == 0
    assert N.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [150_000, 400])
def test_no_table_of_documents_reaches_the_driver(spark, monkeypatch, block):
    """Only rows fetched within a limit are broadcast, however small the stored tables are."""
    plans, cut = [], N.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(N, "cut_lineage", kept)
    monkeypatch.setattr(C, "cut_lineage", kept)
    for module in (N, C):
        monkeypatch.setattr(module, "spread", partial(spread, max_rows=0))
    rows = families(4)
    out = N.near_links(frame(spark, rows), block=block)
    assert same([(r["_doc"], r["_n"], r["_root"]) for r in kept(out).collect()], [w[:3] for w in N.brute_components(rows)])
    leaves = [re.search(r"FileScan|Exchange|LocalTableScan|ExistingRDD", side)[0] for x in plans for side in x.split("BroadcastExchange")[1:]]
    assert len(plans) > 10 and set(leaves) <= {"LocalTableScan", "ExistingRDD"}

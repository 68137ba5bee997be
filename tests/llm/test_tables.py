"""Sharding, chat formatting and URL rules: SQL where there is some, else brute force."""

import itertools

import pytest
from corpus import SF, empty, frame, same
from pyspark.sql import functions as F

from check_queries import compare, connect
from meltgrid.llm import chat_format as C
from meltgrid.llm import decontamination as D
from meltgrid.llm import near_dedup as N
from meltgrid.llm import sharding as S
from meltgrid.llm import substring_dedup as W
from meltgrid.llm import suffix_dedup as X
from meltgrid.llm import url_filter as U
from meltgrid.llm.registry import load


@pytest.mark.parametrize("module, name", [(S, "op3_sharding"), (C, "op7_chat_format"), (D, "op2_decontamination"),
                                          (N, "op8_near_dedup"), (W, "op10_substring_dedup"), (X, "op5_suffix_dedup")])
def test_equal_to_sql(spark, module, name):
    for sf in (SF, SF.replace("0.001", "0.01")):
        assert compare(getattr(module, name)(spark, sf), connect(sf), module.ORACLE_SQL) == ""


def test_shards_fit_and_report_themselves(spark):
    rows = [(1, "x" * 100)] * 25 + [(i, "y" * (i % 40)) for i in range(200)] + [(None, None), (500, "z" * 900)]
    out = S.shard_rows(frame(spark, rows).withColumn("part", F.lit(1)), limit=300)
    groups = out.groupBy("shard", "part").agg(F.sum("_bytes").alias("b"), F.count("*").alias("n"),
                                              F.max("shard_bytes").alias("sb"), F.min("shard_rows").alias("sr")).collect()
    assert sum(g["n"] for g in groups) == len(rows)
    assert [g["b"] for g in groups if g["b"] > 300] == [900]
    assert all(g["b"] == g["sb"] and g["n"] == g["sr"] for g in groups)
    names = sorted({g["shard"] for g in groups})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert S.shard_rows(empty(spark)).count() == 0


def test_shards_are_written(spark, tmp_path):
    rows = [(i, "y" * (i % 40)) for i in range(200)]
    S.write_sharded(frame(spark, rows), str(tmp_path / "s"), limit=500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert same(back.select("doc_id", "text").collect(), rows) and back.select("shard").distinct().count() > 4


TURNS = "pair_id long, turn long, role string, text string"


def test_preferences(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "q"), (None, 0, None, None),
              (3, 0, "user", "a"), (4, 1, "assistant", "é")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "x"), (1, 3, "assistant", "y"),
                (2, 0, "user", "q"), (3, 0, "user", "b")]
    f = lambda rows: spark.createDataFrame(rows, TURNS)
    out = {r["pair_id"]: r for r in C.format_preferences(f(chosen), f(rejected)).collect()}
    assert out[1]["prompt"] == "<|user|>\nhi<|end|>\n" and out[1]["n_common"] == 1
    for side in ("chosen", "rejected"):
        trained = [out[1][side][s["start"]:s["end"]] for s in out[1][f"{side}_spans"]]
        assert trained == (["yo<|end|>"] if side == "chosen" else ["no<|end|>", "y<|end|>"])
    assert out[2]["chosen"] == out[2]["rejected"] == "" and out[3]["prompt"] == ""
    assert out[None]["chosen"] == "<||>\n<|end|>\n" and out[4]["rejected"] == ""
    assert C.format_preferences(f([]), f([])).count() == 0


def test_registered_names():
    queries, sql = load()
    assert sorted(int(q[2:].split("_")[0]) for q in queries) == list(range(1, 1 + len(queries))) and set(sql) < set(queries)


URLS = [(1, None), (2, "nohost"), (3, "http://A.Example.ORG/es/1?x#y"), (4, "x://org"), (5, "http://org/"),
        (6, "http://evilorg/"), (None, "http://a.com/de/?q"), (7, "http://É.Com/fr/"), (7, "http://É.Com/fr/")]


def test_listed_rules(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = U.filter_urls(spark.createDataFrame(URLS, "page_id long, url string"), none)
    got = out.select("page_id", "host", "path", "rule", "verdict").collect()
    assert same(got, [(1, "", "", None, "allow"), (2, "", "", None, "allow"),
                      (3, "a.example.org", "/es/1", "example.org/es/", "block"), (4, "org", "", None, "allow"),
                      (5, "org", "/", "org/", "allow"), (6, "evilorg", "/", None, "allow"),
                      (None, "a.com", "/de/", "com/de/", "block"), (7, "É.com", "/fr/", "com/fr/", "allow"),
                      (7, "É.com", "/fr/", "com/fr/", "allow")])


def test_mined_rules_equal_brute_force(spark):
    rows = [(["a", "b"], True)] * 6 + [(["a", "c"], False)] * 6 + [(["b", "c", "d"], True)] * 4 + [(["b"], False)] \
        + [([], True)]
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    bags = [(set(t), b) for t, b in rows if t]
    want = {}
    for size in range(1, 4):
        for s in itertools.combinations("abcd", size):
            n = sum(set(s) <= t for t, _ in bags)
            bad = sum(set(s) <= t and b for t, b in bags)
            if bad >= 3 and bad / n >= 0.8:
                want[s] = bad / n
    got = U.mine_rules(df, min_support=0.0, min_count=3, min_confidence=0.8).collect()
    assert {tuple(r["tokens"]): round(r["confidence"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    sets = df.select("tokens").where("size(tokens) > 0").distinct()
    hit = {tuple(r["tokens"]): r["mined"] for r in U.match_rules(sets, U.mine_rules(df, 0.0, 3, 0.8)).collect()}
    for t in {tuple(t) for t, _ in rows if t}:
        best = [(v, -len(k), " ".join(k)) for k, v in want.items() if set(k) <= set(t)]
        assert hit.get(t) == (max(best)[2] if best else None)


def test_registered_url_query(spark):
    out = U.op9_url_filter(spark, SF)
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    for r in rows:
        fits = [(len(h + p), h + p, v) for h, p, v in U.RULES
                if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert not fits or r["verdict"] == max(fits)[2]
    text = out._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text

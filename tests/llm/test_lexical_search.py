"""Ranked search against plain scoring of every document."""

import math
import re
from collections import Counter

import pytest
from corpus import SF, documents, empty, frame, same
from pyspark.sql import functions as F

from check_queries import compare, connect
from meltgrid.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, top):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in wanted.items():
        scored = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m))
                    for t in words if b[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return out


ITEMS = [(1, "w1 W2 w3 w3"), (1, "w9"), (2, "É 日本 nowhere"), (None, "w5 w6"), (3, None), (4, "--"), (5, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("top, item_rows", [(3, 1 << 16), (50, 40)])
def test_equal_to_plain_scoring(spark, top, item_rows):
    rows = documents(seed=7) + [(100 + i, "w1 w5 w9") for i in range(70)] + [(None, "W1 w5 w9")] * 3
    docs = frame(spark, rows).withColumns({c: F.lit(0) for c in ("score", "rank", "_bag", "item_id")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    out = L.rank_documents(docs, items, top, item_rows=item_rows)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert same(out.collect(), plain_ranking(rows, ITEMS, top))


def test_small_bounds_change_nothing(spark, monkeypatch):
    text = "ab Cd-éf  12\x00x " * 300
    whole = L.count_terms(text.encode())
    monkeypatch.setattr(L, "PIECE", 7)
    assert L.count_terms(text.encode()) == whole == Counter(t.encode() for t in terms(text))


def test_equal_documents_are_one_class(spark):
    """300 copies that differ in words outside the vocabulary only are scored once."""
    docs = frame(spark, [(i, f"w1 w2 x{i}") for i in range(300)] + [(999, "w1 w1")])
    found = L.bags(docs, {b"w1": 0, b"w2": 1})
    assert found.select("_bag", "_n").distinct().count() == 2
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert [r["doc_id"] for r in L.rank_documents(docs, items, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert L.rank_documents(empty(spark), items).count() == 0
    assert L.rank_documents(frame(spark, [(1, "w1")]), items.limit(0)).count() == 0
    assert L.rank_documents(frame(spark, [(1, None), (2, "")]), items).count() == 0


def test_registered_query(spark):
    sf = SF.replace("0.001", "0.01")
    assert compare(L.op11_lexical_search(spark, sf), connect(sf), L.ORACLE_SQL) == ""

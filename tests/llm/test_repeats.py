"""Substring and suffix dedup against brute force."""

import pytest
from corpus import SF, documents, empty, frame, same, stored
from pyspark.sql import functions as F

from meltgrid.llm import kernels as K
from meltgrid.llm import substring_dedup as words
from meltgrid.llm import suffix_dedup as strings


def word_digest(df):
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256)).collect()


def byte_digest(df):
    return df.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long"), F.sha2("kept", 256)).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows_equal_brute_force(spark, seed):
    rows = documents(seed)
    assert same(word_digest(words.dedup_windows(frame(spark, rows))), words.brute_windows(rows))


def test_word_windows_in_tiny_slices(spark, monkeypatch):
    """What a slice settles by itself does not change the result."""
    rows = documents(3, 80)
    monkeypatch.setattr(K.text_slices, "__defaults__", (300,))
    assert same(word_digest(words.dedup_windows(frame(spark, rows, parts=1))), words.brute_windows(rows))


def test_removed_spans_are_maximal(spark):
    rows = [(1, "x " * 3 + " ".join(f"p{i}" for i in range(20))), (2, " ".join(f"p{i}" for i in range(20)) + " y z")]
    out = {r["doc_id"]: r for r in words.dedup_windows(frame(spark, rows)).collect()}
    assert out[1]["removed"] == [] and out[2]["removed"] == [[0, 20]] and out[2]["text"] == "y z"


def test_documents_keep_their_columns(spark):
    rows = documents(4, 60)
    clash = {c: F.lit(c) for c in ("_doc", "_tv", "_spans", "n_words")}
    df = frame(spark, rows).withColumns(clash).withColumn("lang", F.lit(None).cast("string"))
    out = words.dedup_documents(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert out.select(*clash).distinct().collect() == [tuple(clash)]
    gone = {r[0]: r[2] for r in words.brute_windows(rows)}
    kept = [(r["doc_id"], r["text"]) for r in out.collect() if not gone[r["doc_id"]]]
    assert all(x in rows for x in kept)


@pytest.mark.parametrize("hot", [5000, 3, 1])
def test_byte_strings_equal_brute_force(spark, hot):
    rows = documents(5, 120)
    assert same(byte_digest(strings.dedup_strings(frame(spark, rows), hot=hot)), strings.brute_strings(rows))


def test_hot_collections_are_split_until_they_fit(spark):
    """One passage of 186 bytes among 60 different surroundings: no collection is left to hashes."""
    import random

    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, left, right = letters(190), [letters(12) for _ in range(9)], [letters(12) for _ in range(7)]
    rows = [(i, letters(60) + rng.choice(left) + passage + rng.choice(right) + letters(60)) for i in range(60)]
    want = strings.brute_strings(rows)
    assert any(0 < r[2] for r in want)
    for hot in (1, 4, 1000):
        assert same(byte_digest(strings.dedup_strings(frame(spark, rows), hot=hot)), want)


def test_halves_cover_every_string_once():
    text = bytes(range(97, 123)) * 2
    for k in range(4, 12):
        for anchor in range(0, 12 - k + 1):
            for n in range(12, 12 + anchor + 1):
                got = sorted(by + i for by, part, at, longer, _ in strings.halves(text[:n], anchor, k, 12)
                             for i in range(len(part) - 12 + 1)
                             if 0 <= at - i and at - i + longer <= 12)
                assert k == 12 or got == list(range(n - 12 + 1))


def test_construction_orders_all_suffixes():
    import numpy as np

    texts = [b"banana", b"bandana", b"ana", b"nab"]
    size = max(map(len, texts))
    symbols = np.full((4, size), 257, dtype=np.int16)
    for i, t in enumerate(texts):
        symbols[i, :len(t)] = np.frombuffer(t[::-1], dtype=np.uint8)
    c = strings.Columns(symbols, np.array([len(t) for t in texts]), np.zeros(4), np.ones(258, dtype=np.int64))
    for _ in range(size):
        c.insert()
    doc, length, common = c.read()
    suffixes = [texts[d][len(texts[d]) - n:] for d, n in zip(doc, length)]
    assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(t) + 1 for t in texts)
    for a, b, n in zip(suffixes, suffixes[1:], common[1:]):
        shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == shared
    c.close()


def test_registered_queries(spark):
    rows = stored()
    assert same(words.op10_substring_dedup(spark, SF).collect(), words.brute_windows(rows))
    assert same(strings.op5_suffix_dedup(spark, SF).collect(), strings.brute_strings(rows))


def test_empty_tables(spark):
    assert words.dedup_windows(empty(spark)).count() == 0
    assert strings.dedup_strings(empty(spark)).count() == 0

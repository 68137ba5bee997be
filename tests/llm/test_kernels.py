"""Hashes: equal for equal spans only, also for texts built to cancel in sums modulo a power of two."""

import random

import numpy as np
import pytest
from corpus import frame, same

from meltgrid.llm import binary_output as B
from meltgrid.llm import decontamination as D
from meltgrid.llm import kernels as K
from meltgrid.llm import near_dedup as N
from meltgrid.llm import substring_dedup as W
from meltgrid.llm import suffix_dedup as X
from meltgrid.llm.quality_rules import rule_counts

PRIME = (1 << 61) - 1


def parity_words(n):
    """Two strings of n letters that follow the parity of the bits of the position, one the other's complement."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_products_and_sums_modulo_the_prime():
    rng = random.Random(1)
    a = [rng.randrange(PRIME) for _ in range(2000)] + [0, 1, PRIME - 1, PRIME - 1]
    b = [rng.randrange(PRIME) for _ in range(2000)] + [PRIME - 1, PRIME - 1, PRIME - 1, 0]
    u = lambda x: np.array(x, dtype=np.uint64)
    assert K._times(u(a), u(b)).tolist() == [x * y % PRIME for x, y in zip(a, b)]
    for symbols in (a * 17, [x % (1 << 21) for x in a * 17]):
        total = [0]
        for i, x in enumerate(symbols):
            total.append((total[-1] + x * pow(K._BASE, i, PRIME)) % PRIME)
        assert K.prefix(u(symbols)).tolist() == total and len(symbols) > K._STRETCH


def test_equal_spans_have_equal_hashes():
    rng = random.Random(2)
    data = np.array([rng.choice(b"abc") for _ in range(3000)], dtype=np.uint8)
    start = np.array([rng.randrange(2990) for _ in range(4000)])
    end = start + np.array([rng.randrange(1, 10) for _ in range(4000)])
    got = K.span_hash(K.prefix(K.byte_symbols(data)), start, end).tolist()
    known = {}
    for h, a, z in zip(got, start.tolist(), end.tolist()):
        assert known.setdefault(data[a:z].tobytes(), h) == h
    assert len(set(known.values())) == len(known)


def test_pieces_have_the_hashes_of_spans():
    rng = np.random.default_rng(4)
    length = np.concatenate([rng.integers(1, 9, 9000), [K._LONG, K._LONG + 1, 3 * K._STRETCH, 2], rng.integers(1, 5000, 30)])
    data = rng.integers(0, 256, length.sum()).astype(np.uint8)
    end = np.cumsum(length)
    assert (K.piece_hash(data, length) == K.span_hash(K.prefix(K.byte_symbols(data)), end - length, end)).all()
    assert len(K.piece_hash(data[:0], length[:0])) == 0


@pytest.mark.parametrize("n", [8, 64, 256, 1024, 2048, 4096])
def test_cancelling_words_are_told_apart(n):
    a, b = (np.frombuffer(w.encode(), dtype=np.uint8) for w in parity_words(n))
    one, two = (K.span_hash(K.prefix(K.byte_symbols(x)), np.array([0]), np.array([n])) for x in (a, b))
    assert one[0] != two[0]
    # The same pattern over words.
    symbols = [np.where(x == 97, np.uint64(0x1234567890ABCDEF), np.uint64(0xFEDCBA0987654321)) for x in (a, b)]
    one, two = (K.span_hash(K.prefix(x), np.array([0]), np.array([n])) for x in symbols)
    assert one[0] != two[0]


@pytest.mark.parametrize("n", [1024])
def test_operators_tell_cancelling_words_apart(spark, n):
    a, b = parity_words(n)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} x {b} y"), (4, f"{a}\n{b}")]
    df = frame(spark, rows, parts=1)
    assert same(N.near_duplicates(df, n=13, percent=80).collect(), N.brute_components(rows, 13, 80))
    out = W.dedup_windows(df).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in out) == sorted(r[:3] for r in W.brute_windows(rows))
    items = spark.createDataFrame([(7, f"{a} {rest}")], "item_id long, text string")
    assert same([tuple(r)[:4] for r in D.contained_items(df, items).collect()], D.brute_contained(rows, [(7, f"{a} {rest}")]))
    out = X.dedup_strings(df).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"])) for r in out) == sorted(
        r[:4] for r in X.brute_strings(rows))
    coder = B.TokenCoder(B.default_tokenizer())
    for _, text in rows:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        ids, _ = coder.encode([text], raw, np.array([0, len(raw)]))
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    text = f"{a} p q {b} p q"
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    assert rule_counts(raw, np.array([0, len(raw)]))["n_repeat_words"][0] == 0

"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is contained in a document if at least ``percent`` of its distinct n-word shingles stand in the document,
together or scattered.  A whole long document and a short item have a Jaccard similarity near zero, so sketches of
whole documents would miss.  Items are therefore partitioned by size, [h, 2h), and for each partition the document's
shingles are cut into blocks of h.  Under each hash function every block and every item has a minimum, and they are
candidates if the minima are equal.  An item's smallest shingle stands in the document with probability of at least
``percent`` / 100; it is then the minimum of its block unless one of fewer than h other shingles is smaller, which
happens with a probability below one half.  So ``hashes`` functions miss a contained item with probability below
(1 - percent / 200) ** hashes: 8e-10 for 40 functions at 80 %.  Candidates are verified on all shingles of the
whole document, so nothing false is reported.

Items are taken from the driver in blocks of at most ``ITEM_SHINGLES`` shingles, one pass over the documents for each
block, so what is shipped to the tasks is bounded whatever the number of items.  Documents are not shuffled.

An item of fewer than ``n`` words is contained where its words stand consecutively: its hash is looked up among the
windows of its own length.

Defined results: null and blank texts have no shingles, match nothing and as items are never contained; repeated rows
answer for themselves; null ids come back null; empty tables give no rows; other columns are not read
(``drop_contaminated`` passes them through).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm import kernels as K
from meltgrid.llm.common import WORD_SQL, shingle_sql, table

WORDS = 5
PERCENT = 80
HASHES = 40
ITEM_SHINGLES = 1_000_000


def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2)
    return (rng.integers(0, 2**32, hashes, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 2**32, hashes, dtype=np.uint32))


def _scramble(short: np.ndarray, odd: np.uint32, add: np.uint32) -> np.ndarray:
    x = short * odd + add
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x


class ItemIndex:
    """Minima of a bounded block of items, by size partition and hash function; short items by their words."""

    def __init__(self, items: list[tuple[int | None, np.ndarray, int]], n: int, hashes: int):
        """``items`` have an id, their distinct shingle hashes and their number of words."""
        self.short: dict[int, list[tuple[int | None, np.uint64]]] = {}
        for i, s, words in items:
            if words < n:
                self.short.setdefault(words, []).append((i, s[0]))
        items = [(i, s) for i, s, words in items if words >= n]
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        self.odd, self.add = _functions(hashes)
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        level = np.array([len(s).bit_length() - 1 for s in self.sets])
        for part in np.unique(level):
            members = np.flatnonzero(level == part)
            short = [(self.sets[m] >> np.uint64(32)).astype(np.uint32) for m in members]
            of = []
            for odd, add in zip(self.odd, self.add):
                least = np.array([_scramble(s, odd, add).min() for s in short], dtype=np.uint32)
                order = np.argsort(least, kind="stable")
                seen = np.zeros(1 << 16, dtype=bool)
                seen[least & np.uint32(0xFFFF)] = True
                of.append((least[order], members[order], seen))
            self.parts[1 << int(part)] = of

    def short_hits(self, words: K.Words) -> set[tuple[int, int | None]]:
        """(row, item id) of the short items whose words stand in a row."""
        out: set[tuple[int, int | None]] = set()
        pre = K.prefix(words.hash) if self.short else None
        for length, known in self.short.items():
            at = K.window_starts(words.bounds, length)
            value = K.span_hash(pre, at, at + length)
            near = np.flatnonzero(np.isin(value, np.array([h for _, h in known], dtype=np.uint64)))
            row = (np.searchsorted(words.bounds, at[near], "right") - 1).tolist()
            of: dict[int, list[int | None]] = {}
            for i, h in known:
                of.setdefault(int(h), []).append(i)
            out.update((r, i) for r, h in zip(row, value[near].tolist()) for i in of[h])
        return out

    def candidates(self, value: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs with equal minima."""
        out: set[tuple[int, int]] = set()
        if not len(value):
            return out
        short = (value >> np.uint64(32)).astype(np.uint32)
        cuts = {}
        for size in self.parts:
            per_row = -(-np.diff(bounds) // size)
            row = np.repeat(np.arange(len(per_row)), per_row)
            start = bounds[row] + size * (np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row))
            cuts[size] = (start, row)
        for p, (odd, add) in enumerate(zip(self.odd, self.add)):
            x = _scramble(short, odd, add)
            for size, of in self.parts.items():
                start, row = cuts[size]
                least = np.minimum.reduceat(x, start)
                known, member, seen = of[p]
                near = np.flatnonzero(seen[least & np.uint32(0xFFFF)])
                if len(near):
                    lo = np.searchsorted(known, least[near], "left")
                    hi = np.searchsorted(known, least[near], "right")
                    for i in np.flatnonzero(hi > lo).tolist():
                        out.update((int(row[near[i]]), int(member[j])) for j in range(lo[i], hi[i]))
        return out


def _search(index: ItemIndex, n: int, percent: int):
    def hits(data, off):
        """(row, item id, shingles shared, shingles of the item)."""
        words = K.Words(data, off)
        value, row = K.shingles(words, n)
        bounds = np.searchsorted(row, np.arange(len(off)))
        for r, item in sorted(index.candidates(value, bounds)):
            both = int(np.isin(index.sets[item], value[bounds[r]:bounds[r + 1]]).sum())
            if 100 * both >= percent * len(index.sets[item]):
                yield r, index.ids[item], both, len(index.sets[item])
        for r, item in index.short_hits(words):
            yield r, item, 1, 1

    def run(batches):
        for rows, data, off in K.text_slices(batches, "_text"):
            found = list(hits(data, off))
            if found:
                r, item, both, size = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("_id").take(pa.array(r)), pa.array(item, pa.int64()), pa.array(both, pa.int64()),
                     pa.array(size, pa.int64())], names=["_id", "_item", "n_shared", "n_item"])

    def keep(text_col):
        def go(batches):
            for rows, data, off in K.text_slices(batches, text_col):
                clean = np.ones(rows.num_rows, dtype=bool)
                clean[[r for r, *_ in hits(data, off)]] = False
                if clean.any():
                    yield rows.filter(pa.array(clean))
        return go
    return run, keep


def item_blocks(items: DataFrame, n: int, hashes: int, item_col: str, text_col: str, most: int = ITEM_SHINGLES):
    """Indexes of consecutive items; each holds at most ``most`` shingles, or one larger item."""
    block, held = [], 0
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in rows.toLocalIterator():
        data = np.frombuffer((r["t"] or "").encode(), dtype=np.uint8)
        if not len(data):
            continue
        words = K.Words(data, np.array([0, len(data)]))
        value = np.unique(K.shingles(words, n)[0])
        if not len(value):
            continue
        if block and held + len(value) > most:
            yield ItemIndex(block, n, hashes)
            block, held = [], 0
        block.append((r["i"], value, len(words.start)))
        held += len(value)
    if block:
        yield ItemIndex(block, n, hashes)


def contained_items(docs: DataFrame, items: DataFrame, n: int = WORDS, percent: int = PERCENT, hashes: int = HASHES,
                    id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item id, n_shared, n_item, containment) for every item contained in a document."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = "_id long, _item long, n_shared long, n_item long"
    out = texts.sparkSession.createDataFrame([], schema)
    for index in item_blocks(items, n, hashes, item_col, text_col):
        out = out.unionByName(texts.mapInArrow(_search(index, n, percent)[0], schema))
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "n_shared", "n_item",
                      (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WORDS, percent: int = PERCENT,
                      hashes: int = HASHES, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item."""
    for index in item_blocks(items, n, hashes, item_col, text_col):
        docs = docs.mapInArrow(_search(index, n, percent)[1](text_col), docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against the whole documents table; one row per contained item and document."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = f"""
WITH iw AS (SELECT item_id, text, regexp_extract_all(coalesce(text, ''), {WORD_SQL}) AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD_SQL}) AS w FROM documents),
long AS (SELECT * FROM iw WHERE len(w) >= {WORDS}),
short AS (SELECT item_id, len(w) AS l, array_to_string(w, ' ') AS s FROM iw WHERE len(w) BETWEEN 1 AND {WORDS - 1}),
d AS ({shingle_sql('documents', 'doc_id', "coalesce(text, '')", WORDS)}),
b AS ({shingle_sql('long', 'item_id', "text", WORDS)}),
sized AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_item FROM b),
few AS (SELECT DISTINCT doc_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (
  SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM short) WHERE len(w) >= l))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM d JOIN sized ON d.s = sized.s GROUP BY doc_id, item_id HAVING 100 * count(*) >= {PERCENT} * any_value(n_item)
UNION ALL
SELECT doc_id, item_id, 1, 1, 1.0 FROM few JOIN short ON few.l = short.l AND few.s = short.s
"""


def brute_contained(docs, items, n: int = WORDS, percent: int = PERCENT):
    """Plain restatement for tests: (doc_id, item_id, shared, size)."""
    def windows(w, n):
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    words = lambda t: (t or "").encode().split()
    out = []
    for d, t in docs:
        have = words(t)
        for i, item in items:
            w = words(item)
            known = windows(w, min(n, len(w))) if w else set()
            both = len(known & windows(have, min(n, len(w)))) if known else 0
            if known and 100 * both >= percent * len(known):
                out.append((d, i, both, len(known)))
    return out

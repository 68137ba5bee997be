"""Quality rules: base limits, then an isolation forest on the rule statistics.

Rule statistics come from one pass over whole texts.  Random trees are grown on a bounded sample of labelled rows
that pass the base limits (``SAMPLE`` rows with the smallest id hashes); few random splits set an anomalous document
apart.  The score above which a document is rejected is calibrated on all labelled rows: scores are counted in 1000
cells by label, and the cell is taken that rejects most bad rows beyond its share of good ones, while at most
``CLEAN_LOSS`` of the good rows go.  Repeats enter as coarse steps: clean texts have a few as well, and the base
limits judge the many.

Defined results: a null text has no words and fails the base limits; without good and bad labelled rows nothing is
calibrated and only the base limits reject; several labels of one id count as their least; labels of null ids count
for nothing; repeated rows get the same verdict each; columns of other names pass through ``keep_quality``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm import kernels as K
from meltgrid.llm.common import table
from meltgrid.session import cut_lineage

SAMPLE = 20_000
TREES = 100
TREE_ROWS = 64
CELLS = 1000
CLEAN_LOSS = 0.005
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def rule_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each row of a slice, as the module's contract defines them."""
    words = K.Words(data, off)
    bounds = words.bounds

    def per_row(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[cut])
    dup_lines = np.zeros(len(off) - 1, dtype=np.int64)
    for i in range(len(off) - 1):
        lines = [x for x in data[off[i]:off[i + 1]].tobytes().split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))
    pre = K.prefix(words.hash)
    at = K.window_starts(bounds, 3)
    row = (np.searchsorted(bounds, at, "right") - 1).astype(np.uint64)
    key = K.mix(K.span_hash(pre, at, at + 3) + row * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    twice = np.zeros(len(key) + 1, dtype=bool)
    twice[1:-1] = key[1:] == key[:-1]
    hit = at[order[twice[:-1] | twice[1:]]] if len(key) else at
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_row(~K.WHITE[data] & ((data & 0xC0) != 0x80), off),
        "n_symbols": per_row(_SYMBOL[data], off),
        "n_dup_lines": dup_lines,
        "n_repeat_words": per_row(K.spans_to_mask(hit, hit + 3, int(bounds[-1])), bounds),
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios that do not grow with a text's length."""
    words = np.maximum(c["n_words"], 1).astype(float)
    return np.column_stack([c["word_chars"] / words, c["n_symbols"] / words, np.floor(20 * c["n_dup_lines"] / words),
                            np.floor(5 * c["n_repeat_words"] / words)])


class Forest:
    """Isolation trees as flat arrays; ``score`` is 2^(-mean path / expected path), larger is stranger."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.rows, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def expected(n: float) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        most = int(np.ceil(np.log2(max(len(x), 2))))
        column, split, child, path = [], [], [], []
        todo = [(x, 0, -1)]
        while todo:
            part, depth, parent = todo.pop()
            me = len(column)
            if parent >= 0:
                child[parent].append(me)
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            child.append([])
            if depth >= most or not len(wide):
                column.append(0)
                split.append(0.0)
                path.append(depth + self.expected(len(part)))
                continue
            c = int(rng.choice(wide))
            cut = rng.uniform(low[c], high[c])
            column.append(c)
            split.append(cut)
            path.append(-1.0)
            left = part[:, c] < cut
            todo += [(part[~left], depth + 1, me), (part[left], depth + 1, me)]  # the left one is grown first
        ways = np.array([w if w else [i, i] for i, w in enumerate(child)])
        return np.array(column), np.array(split), ways, np.array(path), most

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        i = np.arange(len(x))
        for column, split, ways, path, most in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(most):
                at = ways[at, (x[i, column[at]] >= split[at]).astype(np.int64)]
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.expected(self.rows), 1e-9))


def count_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule statistics) of every row."""
    def run(batches):
        for rows, data, off in K.text_slices(batches, "_text"):
            c = rule_counts(data, off)
            yield pa.RecordBatch.from_arrays([rows.column("_id")] + [pa.array(c[k]) for k in COUNTS],
                                             names=["_id", *COUNTS])
    return (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
            .mapInArrow(run, "_id long, " + ", ".join(f"{c} long" for c in COUNTS))
            .withColumnRenamed("_id", id_col))


def _scored(counts: DataFrame, forest: Forest, id_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            c = {k: b.column(k).to_numpy() for k in COUNTS}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base_failed(c)),
                                              pa.array(forest.score(features(c)))],
                                             names=[*b.schema.names, "base_failed", "score"])
    schema = f"{id_col} long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double"
    return counts.select(id_col, *COUNTS).mapInArrow(run, schema)


def fit(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality",
        sample: int = SAMPLE, clean_loss: float = CLEAN_LOSS) -> tuple[Forest | None, float]:
    """Forest on a sample of labelled rows, and the score from which rows are rejected."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.min(quality_col).alias("_good")))
    rows = cut_lineage(counts.join(known, id_col).where(
        (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))))
    # Hash values up to a bound keep a little more than the sample, so no task sends a whole sample.
    bound = min(1.0, 1.5 * sample / max(rows.count(), 1))
    near = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * bound) + 1)
    known = near.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(*COUNTS).collect()
    if not known:
        return None, 1.0
    forest = Forest(features({k: np.array([r[k] for r in known]) for k in COUNTS}))
    marked = _scored(rows, forest, id_col).join(rows.select(id_col, "_good").distinct(), id_col)
    table = marked.groupBy(F.floor(F.col("score") * CELLS).cast("int").alias("cell"),
                           (F.col("_good") > 0).alias("good")).count().collect()
    at = {True: np.zeros(CELLS + 2), False: np.zeros(CELLS + 2)}
    for r in table:
        at[r["good"]][r["cell"]] += r["count"]
    if not at[False].sum() or not at[True].sum():
        return forest, 1.0
    lost = {k: v[::-1].cumsum()[::-1] / v.sum() for k, v in at.items()}  # share at or above each cell
    gain = np.where(lost[True] <= clean_loss, lost[False] - lost[True], -1.0)
    best = int(gain.argmax())
    return forest, best / CELLS if gain[best] > 0 else 1.0


def judge(counts: DataFrame, forest: Forest | None, limit: float, id_col: str = "doc_id") -> DataFrame:
    """(id, statistics, base_failed, score, kept)."""
    if forest is None:
        failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        return counts.withColumns({"base_failed": failed, "score": F.lit(0.0), "kept": ~failed})
    return _scored(counts, forest, id_col).withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    forest, limit = fit(cut_lineage(count_rules(docs, id_col, text_col)), labels, id_col)

    def run(batches):
        for rows, data, off in K.text_slices(batches, text_col):
            c = rule_counts(data, off)
            keep = ~base_failed(c)
            if forest is not None:
                keep &= forest.score(features(c)) < limit
            if keep.any():
                yield rows.filter(pa.array(keep))
    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for the whole documents table, calibrated on the whole labels table."""
    counts = cut_lineage(count_rules(table(spark, sf_dir, "documents")))
    forest, limit = fit(counts, table(spark, sf_dir, "labels"))
    return judge(counts, forest, limit)

"""Substring dedup: repeated fixed-length word windows, merged into maximal removal intervals.

A word goes if a window of n consecutive words over it also starts in a document with a smaller id; windows are judged
on the input.  Rabin-Karp hashes are counted by Spark aggregates in two steps (``repeats``): windows that choose the
same anchor of k words are counted as one run, by the hash of the anchor and of the whole run; where runs of one
anchor differ, each of their windows is counted by its own hash.  Repeated windows merge into maximal intervals.

Defined results: a null text has no words; a document of fewer than n words loses nothing; rows with equal ids
never remove words from each other; a null id counts as the smallest and comes back null; empty tables give empty
results; ``dedup_windows`` reads the two named columns only, ``dedup_documents`` passes all others through.  One text
is held in memory by its task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm import kernels as K
from meltgrid.llm import repeats as R
from meltgrid.llm.common import WORD_SQL, id_or_least, keyed, null_again, spare, table
from meltgrid.session import cut_lineage

WINDOW = 13
ANCHOR = 5


def _ask_runs(n: int, k: int):
    def run(batches):
        for rows, data, off in K.text_slices(batches, "_text"):
            words = K.Words(data, off)
            key, whole, row, first, count = K.blocks(words.hash, words.bounds, n, k)
            if len(key):
                doc, tv = (rows.column(c).to_numpy()[row] for c in ("_doc", "_tv"))
                yield R.questions(key, whole, doc, tv, R.pack(first, count), "min")
    return run


def _ask_windows(n: int):
    """Every window of the open runs of each row, asked by its own hash."""
    def run(batches):
        for rows, data, off in K.text_slices(batches, "_text"):
            words = K.Words(data, off)
            spans = rows.column("_spans")
            at = spans.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(rows.num_rows), np.diff(spans.offsets.to_numpy()))
            first, count = R.unpack(at)
            row = np.repeat(row, count)
            start = np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = words.bounds[row] + start
            key = K.span_hash(K.prefix(words.hash), begin, begin + n)
            doc, tv = (rows.column(c).to_numpy()[row] for c in ("_doc", "_tv"))
            yield R.questions(key, key, doc, tv, R.pack(start, np.ones_like(start)), "min")
    return run


def repeated_windows(docs: DataFrame, n: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(_doc, _tv, _spans): packed runs of windows that a smaller id has too, for rows that have any."""
    texts = keyed(docs, id_col, text_col)
    found = cut_lineage(R.counted(texts.mapInArrow(_ask_runs(n, k), R.ROWS_SQL)))
    still = (found.where(F.col("_kind") != R.SETTLED).groupBy("_doc", "_tv")
             .agg(F.array_sort(F.collect_set("_at")).alias("_spans")))
    asked = texts.join(still, ["_doc", "_tv"]).select("_doc", "_tv", "_text", "_spans")
    finer = R.counted(asked.mapInArrow(_ask_windows(n), R.ROWS_SQL))
    every = found.unionByName(finer).where(F.col("_kind") == R.SETTLED)
    return every.groupBy("_doc", "_tv").agg(F.array_sort(F.collect_set("_at")).alias("_spans"))


def _apply(n: int):
    schema = pa.schema([("_doc", pa.int64()), ("_tv", pa.int64()), ("_kept", pa.string()), ("_words", pa.int64()),
                        ("_removed", pa.int64()), ("_cuts", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        for rows, data, off in K.text_slices(batches, "_text"):
            spans = rows.column("_spans").to_pylist()
            kept, total, gone, cuts = [], [], [], []
            for i, at in enumerate(spans):
                words = data[off[i]:off[i + 1]].tobytes().split()
                total.append(len(words))
                cut = []
                if at:
                    first, count = R.unpack(np.asarray(at, dtype=np.int64))
                    mask = K.spans_to_mask(first, first + count - 1 + n, len(words))
                    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                    cut = edge.reshape(-1, 2).tolist()
                    words = [w for w, m in zip(words, mask.tolist()) if not m]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
                cuts.append(cut)
            yield pa.RecordBatch.from_arrays(
                [rows.column("_doc"), rows.column("_tv"), pa.array(kept, pa.string()), pa.array(total, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(cuts, schema.field("_cuts").type)], schema=schema)
    return run


def dedup_windows(docs: DataFrame, n: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, kept text, n_words, n_removed, removed): kept words joined by single spaces, removed word spans."""
    texts = keyed(docs, id_col, text_col)
    spans = repeated_windows(docs, n, k, id_col, text_col)
    out = (texts.join(spans, ["_doc", "_tv"], "left").select("_doc", "_tv", "_text", "_spans")
           .mapInArrow(_apply(n), "_doc long, _tv long, _kept string, _words long, _removed long, "
                                  "_cuts array<array<long>>"))
    return out.select(null_again("_doc").alias(id_col), F.col("_kept").alias(text_col),
                      F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_cuts").alias("removed"))


def dedup_documents(docs: DataFrame, n: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows cut out of the texts; all columns, untouched rows byte for byte."""
    spans = repeated_windows(docs, n, k, id_col, text_col)
    cols, fields = docs.columns, docs.schema
    doc, tv, cut = spare(docs, "_doc", "_tv", "_spans")
    keyed_docs = docs.withColumns({doc: id_or_least(id_col), tv: F.coalesce(F.xxhash64(text_col), F.lit(0))})
    spans = spans.toDF(doc, tv, cut)
    joined = keyed_docs.join(spans, [doc, tv], "left").select(*cols, cut)
    place = cols.index(text_col)

    def run(batches):
        for rows, data, off in K.text_slices(batches, text_col):
            texts = rows.column(place).to_pylist()
            for i, at in enumerate(rows.column(len(cols)).to_pylist()):
                if at:
                    words = data[off[i]:off[i + 1]].tobytes().split()
                    first, count = R.unpack(np.asarray(at, dtype=np.int64))
                    mask = K.spans_to_mask(first, first + count - 1 + n, len(words))
                    texts[i] = b" ".join(w for w, m in zip(words, mask.tolist()) if not m).decode()
            columns = [rows.column(i) for i in range(len(cols))]
            columns[place] = pa.array(texts, rows.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=cols)
    return joined.mapInArrow(run, fields)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``dedup_windows`` over the whole documents table."""
    out = dedup_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD_SQL}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN least USING (s), (SELECT unnest(range({WINDOW})) AS k) WHERE first < doc_id),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) p
         ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def brute_windows(rows, n: int = WINDOW):
    """Plain restatement of the contract for tests: rows of (doc_id, text)."""
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    rank = lambda d: -(2**63) if d is None else d
    for d, w in split:
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            least[key] = min(least.get(key, rank(d)), rank(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i:i + n])] < rank(d):
                gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out

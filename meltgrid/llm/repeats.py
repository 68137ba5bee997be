"""Which windows of a fixed length occur more than once: exact search in two rounds of hashes.

Shuffling every window would move many times the text.  So windows are first cut into runs that choose the same
anchor (``kernels.blocks``): about one row per half window.  An anchor that occurs once makes all its windows
unique.  Runs that are equal as a whole are settled together.  Only runs that share an anchor and differ elsewhere
(the edges of a shared passage, the surroundings of an edit) stay open for a second, finer round.

Hot runs: each map task settles equal runs of its slice by itself and asks the others with one row per anchor, so
an anchor in a third of all documents sends a row per slice (some 600 documents), not per document.  Rows that are
settled already are dealt out evenly.  The judge streams over sorted rows and carries one row between batches.

Two rules.  ``min``: a run is repeated if a smaller id has it.  ``any``: if it starts anywhere else as well.

``judged`` answers ``any`` by streaming over sorted rows; ``counted`` answers ``min`` by Spark aggregates, where a hot
anchor is combined on the map side and its rows meet the answer in a join that Spark may split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltgrid.llm.kernels import mix, signed
from meltgrid.session import cut_lineage

SETTLED, OPEN, SETTLED_OPEN = 1, 2, 3
_ASK, _TWICE, _MANY = 0, 4, 8

ROWS = pa.schema([("_key", pa.int64()), ("_run", pa.int64()), ("_doc", pa.int64()), ("_tv", pa.int64()),
                  ("_at", pa.int64()), ("_kind", pa.int8())])
ROWS_SQL = "_key long, _run long, _doc long, _tv long, _at long, _kind byte"
FOUND = pa.schema([("_doc", pa.int64()), ("_tv", pa.int64()), ("_at", pa.int64()), ("_kind", pa.int8())])
FOUND_SQL = "_doc long, _tv long, _at long, _kind byte"
COUNT_BITS = 20


def pack(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window and number of windows of a run in one value."""
    return (first.astype(np.int64) << COUNT_BITS) | count


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> COUNT_BITS, at & ((1 << COUNT_BITS) - 1)


def questions(key, run, doc, tv, at, rule: str) -> pa.RecordBatch:
    """Rows of one slice for the judge, with what the slice can settle itself settled."""
    key, run = signed(key), signed(run)
    o = np.lexsort((at, doc, run, key))
    key, run, doc, tv, at = key[o], run[o], doc[o], tv[o], at[o]
    n = len(key)
    kind = np.zeros(n, dtype=np.int8)
    if n:
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_run = new_key | np.r_[True, run[1:] != run[:-1]]
        key_at, run_at = np.flatnonzero(new_key), np.flatnonzero(new_run)
        kid, rid = np.cumsum(new_key) - 1, np.cumsum(new_run) - 1
        many = (np.add.reduceat(new_run.astype(np.int64), key_at) > 1)[kid]
        if rule == "min":
            kind[:] = np.where(doc > doc[run_at][rid], SETTLED, np.where(new_run & many & ~new_key, OPEN, _ASK))
            kind[(kind == _ASK) & many] += _MANY
        else:
            twice = (np.diff(np.append(run_at, n)) > 1)[rid]
            kind[:] = np.where(twice, np.where(new_run & many, SETTLED_OPEN, SETTLED), np.where(many, OPEN, _ASK))
            ask = new_key & (many | twice)
            told = ask & (kind != SETTLED)
            kind[told] = _ASK + _MANY * many[told] + _TWICE * twice[told]
            extra = np.flatnonzero(ask & ~told)
            if len(extra):
                pick = np.concatenate([np.arange(n), extra])
                key, run, doc, tv, at, kind = (x[pick] for x in (key, run, doc, tv, at, kind))
                kind[n:] = _ASK + _TWICE + _MANY * many[extra]
    done = (kind > 0) & (kind < _TWICE)
    if done.any():
        spread = mix(doc[done].view(np.uint64) * np.uint64(31) + at[done].view(np.uint64))
        key, run = key.copy(), run.copy()
        key[done], run[done] = signed(spread), 0
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, run, doc, tv, at, kind)], schema=ROWS)


def _decide(x: dict, rule: str, last: bool):
    """Answers to sorted questions; the last run's first row is held back unless ``last``."""
    key, run, doc, kind = x["_key"], x["_run"], x["_doc"], x["_kind"]
    n = len(key)
    new_key = np.r_[True, key[1:] != key[:-1]]
    new_run = new_key | np.r_[True, run[1:] != run[:-1]]
    key_at, run_at = np.flatnonzero(new_key), np.flatnonzero(new_run)
    kid, rid = np.cumsum(new_key) - 1, np.cumsum(new_run) - 1
    many = (np.add.reduceat(new_run.astype(np.int64), key_at) > 1) | \
        np.logical_or.reduceat((kind & _MANY) > 0, key_at)
    weight = 1 + ((kind & _TWICE) > 0)
    twice = (np.add.reduceat(weight, run_at) > 1)[rid]
    m = many[kid]
    if rule == "min":
        out = np.where(doc > doc[run_at][rid], SETTLED, np.where(m | ~new_run, OPEN, 0))
    else:
        out = np.where(twice, np.where(new_run & m, SETTLED_OPEN, SETTLED), np.where(m, OPEN, 0))
    keep = out > 0
    held = None
    if not last:
        h = int(run_at[-1])
        keep[h] = False
        held = {c: v[h:h + 1].copy() for c, v in x.items()}
        held["_kind"][:] = _ASK + _MANY * bool(many[-1]) + _TWICE * bool(twice[h])
    return out[keep].astype(np.int8), keep, held


def judge_stream(rule: str):
    def judge(batches):
        held = None
        for batch in batches:
            x = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(ROWS.names)}
            done = (x["_kind"] > 0) & (x["_kind"] < _TWICE)
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[c][done]) for c in FOUND.names], schema=FOUND)
                x = {c: v[~done] for c, v in x.items()}
            if not len(x["_key"]):
                continue
            if held is not None:
                x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
            kind, keep, held = _decide(x, rule, last=False)
            if len(kind):
                yield pa.RecordBatch.from_arrays([pa.array(x[c][keep]) for c in FOUND.names[:3]] + [pa.array(kind)],
                                                 schema=FOUND)
        if held is not None:
            kind, keep, _ = _decide(held, rule, last=True)
            if len(kind):
                yield pa.RecordBatch.from_arrays([pa.array(held[c][keep]) for c in FOUND.names[:3]] +
                                                 [pa.array(kind)], schema=FOUND)
    return judge


def counted(asked: DataFrame) -> DataFrame:
    """(_doc, _tv, _at, _kind) of every run that a smaller id has too or that stays open, counted in Spark."""
    done = (F.col("_kind") > 0) & (F.col("_kind") < _TWICE)
    many = F.col("_kind").bitwiseAND(F.lit(_MANY).cast("byte")) > 0
    # Anchors that occur once drop out here; of the others the smallest id suffices where all runs are equal.
    keys = asked.where(~done).groupBy("_key").agg(
        F.min("_run").alias("_r0"), F.max("_run").alias("_r1"), F.min("_doc").alias("_least"), F.max("_doc").alias("_most"),
        F.bool_or(many).alias("_open"))
    differ = F.col("_open") | (F.col("_r0") != F.col("_r1"))
    keys = cut_lineage(keys.where(differ | (F.col("_least") < F.col("_most"))).select("_key", "_least", differ.alias("_differ")))
    met = cut_lineage(asked.join(keys, "_key", "left").where(done | F.col("_least").isNotNull()))
    told = met.where(done).select("_doc", "_tv", "_at", "_kind")
    equal = met.where(~done & ~F.col("_differ") & (F.col("_doc") > F.col("_least"))).select(
        "_doc", "_tv", "_at", F.lit(SETTLED).cast("byte").alias("_kind"))
    mixed = met.where(~done & F.col("_differ")).drop("_least")
    # Written first: with an aggregate below it Spark could not split a hot run in the join.
    first = cut_lineage(mixed.groupBy("_key", "_run").agg(F.min("_doc").alias("_least")))
    kind = F.when(F.col("_doc") > F.col("_least"), SETTLED).otherwise(OPEN).cast("byte")
    split = mixed.join(first, ["_key", "_run"]).select("_doc", "_tv", "_at", kind.alias("_kind"))
    return told.unionByName(equal).unionByName(split)


def judged(asked: DataFrame, rule: str) -> DataFrame:
    """(_doc, _tv, _at, _kind) of every run that is repeated or stays open."""
    return (asked.repartition("_key").sortWithinPartitions("_key", "_run", "_doc", "_at")
            .mapInArrow(judge_stream(rule), FOUND_SQL))

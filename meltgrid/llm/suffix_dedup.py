"""Suffix-array dedup of byte strings by column-wise construction of a multi-document index.

A byte goes if a string of ``size`` bytes over it also starts anywhere else, in its own document or another; strings
are judged on the input.  The construction inserts one symbol of every document each round, from the last symbol to
the first, and updates the order of all suffixes so far (the Burrows-Wheeler transform of the collection) and the
common prefixes of neighbours, reading the columns of the round before from a sequential file and writing those of
this round to another.  Two suffixes share ``size`` bytes if and only if neighbours in the final order do.

Over whole documents this takes as many rounds as the longest has bytes, each over everything, in one place.  So
Spark first cuts the suffixes into collections that cannot share a string with each other (``repeats``): runs of
windows under one 64-byte anchor, then, where those differ, under one 184-byte anchor.  Runs that are equal as a
whole and have no other run under their anchor share all their strings and nothing else, so their hash settles them;
the construction decides what the two rounds leave open, the surroundings of edits and the ends of passages.  The
documents of a collection are what is left of a run: at most 16 bytes, the anchor (one symbol that weighs 184 bytes),
at most 16 bytes; 33 rounds build it.  Many collections go through the rounds side by side.

Equal documents of a collection enter once, with their count: such a document shares its whole suffixes with its copy.
A collection of more than ``HOT`` different documents is split before it is built: the anchor grows by half of what
surrounds it, to the left for the strings that reach that far and to the right for the others, so each string goes to
one of two longer anchors.  Equal parts are counted again; after at most five splits a string is its own anchor.

Defined results: a null text is empty and stays empty; texts shorter than ``size`` lose nothing; repeated rows count
as two documents, whatever their ids; a null id comes back null; empty tables give no rows; other columns are not
read.  One text is held in memory by its task.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm import kernels as K
from meltgrid.llm import repeats as R
from meltgrid.llm.common import keyed, null_again, table
from meltgrid.session import cut_lineage

SIZE = 200
ANCHOR = 64
FINE_ANCHOR = 184
HOT = 1_000
BATCH = 20_000
_ANCHOR_SYMBOL, _END = 256, 257


class Columns:
    """Order of the suffixes of many collections and their common prefixes, one symbol longer each round."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, group: np.ndarray, weight: np.ndarray):
        """``symbols[i, l]`` is the l-th symbol of document i from its end; ``group`` ascends; ``weight`` by symbol."""
        self.symbols, self.lengths, self.group, self.weight = symbols, lengths, group.astype(np.int64), weight
        self.files = [tempfile.TemporaryFile(), tempfile.TemporaryFile()]
        # The empty suffixes, in document order within their collection, share nothing.
        doc = np.arange(len(lengths), dtype=np.int32)
        self._write(doc, np.zeros_like(doc), np.zeros_like(doc))

    def _write(self, *columns: np.ndarray) -> None:
        out = self.files[1]
        out.seek(0)
        out.truncate()
        for c in columns:
            out.write(c.astype(np.int32).tobytes())
        self.rows = len(columns[0])
        self.files.reverse()

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, length of the suffix, common prefix with the suffix before) in suffix order."""
        self.files[0].seek(0)
        raw = np.frombuffer(self.files[0].read(), dtype=np.int32)
        return raw[:self.rows], raw[self.rows:2 * self.rows], raw[2 * self.rows:]

    def insert(self) -> None:
        """One more symbol of every document: suffix (i, l) before symbol c becomes (i, l + 1) in c's pile."""
        doc, length, common = self.read()
        before = np.where(length < self.lengths[doc], self.symbols[doc, length], _END)  # the transform
        at = np.flatnonzero(before < _END)
        pile = self.group[doc[at]] * (_END + 1) + before[at] + 1
        order = np.argsort(pile, kind="stable")
        at, pile = at[order], pile[order]
        # Neighbours of one pile share the symbol and what all suffixes from one to the other shared before.
        shared = np.zeros(len(at), dtype=np.int64)
        same = np.flatnonzero(pile[1:] == pile[:-1])
        if len(same):
            span = np.stack([at[same] + 1, at[same + 1] + 1], axis=1).ravel()
            least = np.minimum.reduceat(np.append(common, 0), span)[::2]
            shared[same + 1] = self.weight[before[at[same]]] + least
        ends = np.arange(len(self.lengths))
        place = np.argsort(np.concatenate([self.group * (_END + 1), pile]), kind="stable")
        self._write(np.concatenate([ends, doc[at]])[place], np.concatenate([np.zeros_like(ends), length[at] + 1])[place],
                    np.concatenate([np.zeros_like(ends), shared])[place])

    def close(self) -> None:
        for f in self.files:
            f.close()


def shared_starts(strings: list[bytes], anchor: np.ndarray, group: np.ndarray, size: int, k: int,
                  copies: np.ndarray | None = None):
    """(document, offset) of every start from which ``size`` bytes also start in another string of the group.

    A document that stands for several ``copies`` has one of them as neighbour, which shares all of each suffix.
    """
    n = len(strings)
    left = anchor.astype(np.int64)
    right = np.array([len(s) for s in strings], dtype=np.int64) - left - k
    lengths = left + 1 + right
    symbols = np.full((n, int(lengths.max())), _END, dtype=np.int16)
    for i, s in enumerate(strings):
        a = int(left[i])
        head = np.frombuffer(s[a + k:][::-1], dtype=np.uint8)
        symbols[i, :len(head)] = head
        symbols[i, len(head)] = _ANCHOR_SYMBOL
        symbols[i, len(head) + 1:len(head) + 1 + a] = np.frombuffer(s[:a][::-1], dtype=np.uint8)
    weight = np.ones(_END + 1, dtype=np.int64)
    weight[_ANCHOR_SYMBOL] = k
    columns = Columns(symbols, lengths, group, weight)
    for _ in range(int(lengths.max())):
        columns.insert()
    doc, length, common = columns.read()
    columns.close()
    best = np.maximum(common, np.append(common[1:], 0))
    if copies is not None:
        best = np.where(copies[doc] > 1, length + np.where(length > right[doc], k - 1, 0), best)
    hit = np.flatnonzero(best >= size)
    return doc[hit], (lengths[doc[hit]] - length[hit])


def _ask_runs(size: int, k: int):
    def run(batches):
        for rows, data, off in K.text_slices(batches, "_text"):
            key, whole, row, first, count = K.blocks(K.byte_symbols(data), off, size, k)
            if len(key):
                doc, tv = (rows.column(c).to_numpy()[row] for c in ("_doc", "_tv"))
                yield R.questions(key, whole, doc, tv, R.pack(first, count), "any")
    return run


def _segments(size: int):
    """The bytes of the open runs of each row."""
    def run(batches):
        for rows, data, off in K.text_slices(batches, "_text"):
            out = []
            for i, spans in enumerate(rows.column("_spans").to_pylist()):
                first, count = R.unpack(np.asarray(spans, dtype=np.int64))
                out.append([data[off[i] + f:off[i] + f + c - 1 + size].tobytes()
                            for f, c in zip(first.tolist(), count.tolist())])
            yield pa.RecordBatch.from_arrays(
                [rows.column("_doc"), rows.column("_tv"), rows.column("_spans"), pa.array(out, pa.list_(pa.binary()))],
                names=["_doc", "_tv", "_spans", "_bytes"])
    return run


def _fine_runs(rows, size: int, k: int):
    """Runs under fine anchors within the segments of some rows: ``kernels.blocks`` and where they belong."""
    parts = rows.column("_bytes").to_pylist()
    flat = [b for p in parts for b in p]
    off = np.cumsum([0] + [len(b) for b in flat])
    data = np.frombuffer(b"".join(flat), dtype=np.uint8)
    symbols = K.byte_symbols(data)
    key, whole, seg, first, count = K.blocks(symbols, off, size, k)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[seg]
    base = R.unpack(np.array([a for p in rows.column("_spans").to_pylist() for a in p], dtype=np.int64))[0]
    return data, off, symbols, key, whole, seg, row, first, base[seg] + first if len(seg) else first, count


def _few(batches, rows: int = 200):
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _ask_fine(size: int, k: int):
    def run(batches):
        for rows in _few(batches):
            _, _, _, key, whole, _, row, _, at, count = _fine_runs(rows, size, k)
            if len(key):
                doc, tv = (rows.column(c).to_numpy()[row] for c in ("_doc", "_tv"))
                yield R.questions(key, whole, doc, tv, R.pack(at, count), "any")
    return run


def _strings(size: int, k: int):
    """(_key, _doc, _tv, _start, _anchor, _string) of the runs that are still open."""
    def run(batches):
        for rows in _few(batches):
            data, off, symbols, key, _, seg, row, first, at, count = _fine_runs(rows, size, k)
            if not len(key):
                continue
            still = rows.column("_still").to_pylist()
            packed = R.pack(at, count)
            known = [set(s) for s in still]
            keep = np.array([p in known[r] for p, r in zip(packed.tolist(), row.tolist())], dtype=bool)
            pre = K.prefix(symbols)
            out, anchor = [], []
            for i in np.flatnonzero(keep).tolist():
                lo = int(off[seg[i]] + first[i])
                hi = lo + int(count[i]) - 1 + size
                j = np.arange(lo, hi - k + 1)
                anchor.append(int(np.flatnonzero(K.span_hash(pre, j, j + k) == key[i])[0]))
                out.append(data[lo:hi].tobytes())
            doc, tv = (rows.column(c).to_numpy()[row[keep]] for c in ("_doc", "_tv"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(K.signed(key[keep])), pa.array(doc), pa.array(tv), pa.array(at[keep]),
                 pa.array(anchor, pa.int64()), pa.array(out, pa.binary())],
                names=["_key", "_doc", "_tv", "_start", "_anchor", "_string"])
    return run


def _construct(size: int):
    """(_piece, _at): shared starts of sorted pieces; whole collections are gathered up to about BATCH pieces."""
    def heads(t: pa.Table):
        key = t.column("_key").to_numpy()
        split = np.array(t.column("_split").to_pylist() + [None], dtype=object)[:-1]
        return np.r_[True, (key[1:] != key[:-1]) | (split[1:] != split[:-1])]

    def settle(t: pa.Table):
        group = np.cumsum(heads(t)) - 1
        length, anchor, copies, piece = (t.column(c).to_numpy() for c in ("_k", "_anchor", "_count", "_piece"))
        strings = t.column("_string").to_pylist()
        for k in np.unique(length).tolist():
            own = np.flatnonzero(length == k)
            doc, offset = shared_starts([strings[i] for i in own.tolist()], anchor[own], group[own], size, k, copies[own])
            yield pa.RecordBatch.from_arrays([pa.array(piece[own[doc]]), pa.array(offset, pa.int64())],
                                             names=["_piece", "_at"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BATCH:
                continue
            t = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(heads(t))[-1])
            if cut:
                yield from settle(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if rows:
            yield from settle(pa.Table.from_batches(held))
    return run


def halves(string: bytes, anchor: int, k: int, size: int):
    """(offset, part, anchor, its length, what it grew by) of the two parts of a document under longer anchors.

    A string of ``size`` bytes with ``middle`` bytes or more before its anchor lies in the first part, any other in
    the second; either may have none.
    """
    free = size - k
    middle = (free + 1) // 2
    last = len(string) - size
    if anchor >= middle:
        yield (0, string[:min(anchor - middle, last) + size], anchor - middle, k + middle,
               b"<" + string[anchor - middle:anchor])
    first = max(0, anchor - middle + 1)
    if first <= last:
        grow = free - middle + 1
        yield first, string[first:], anchor - first, k + grow, b">" + string[anchor + k:anchor + k + grow]


_PART = ["_key", "_split", "_k", "_anchor", "_string"]
_HALVES_SQL = "_from long, _by long, _key long, _split binary, _k int, _anchor long, _string binary, _count long"


def _split_pieces(size: int):
    def run(batches):
        names = ["_piece", *_PART, "_count"]
        for rows in _few(batches, 2000):
            out = [(piece, by, key, split + grown, longer, at, part, count)
                   for piece, key, split, k, anchor, string, count in zip(*(rows.column(c).to_pylist() for c in names))
                   for by, part, at, longer, grown in halves(string, anchor, k, size)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)],
                                             names=["_from", "_by", *_PART, "_count"])
    return run


def built_starts(strings: DataFrame, size: int, k: int, hot: int) -> DataFrame:
    """(_doc, _tv, _at, _kind) of the starts in ``strings`` that the construction finds shared."""
    number = F.monotonically_increasing_id()
    same = ["_key", "_anchor", "_string"]
    classes = cut_lineage(strings.groupBy(*same).agg(F.count("*").alias("_count")).withColumn("_class", number))
    pieces = classes.select(F.col("_class").alias("_piece"), "_key", F.expr("X''").alias("_split"),
                            F.lit(k).cast("int").alias("_k"), "_anchor", "_string", "_count")
    owners = classes.select(F.col("_class").alias("_piece"), "_class", F.lit(0).cast("long").alias("_off"))
    group, found = ["_key", "_split"], []
    while True:
        large = cut_lineage(pieces.groupBy(*group).agg(F.count("*").alias("_c")).where(F.col("_c") > hot).select(*group))
        built = (pieces.join(large, group, "left_anti").repartition(*group).sortWithinPartitions(*group)
                 .mapInArrow(_construct(size), "_piece long, _at long"))
        found.append(cut_lineage(built.join(owners, "_piece").select("_class", (F.col("_at") + F.col("_off")).alias("_at"))))
        if large.isEmpty():
            break
        parts = cut_lineage(pieces.join(large, group, "left_semi").mapInArrow(_split_pieces(size), _HALVES_SQL))
        pieces = cut_lineage(parts.groupBy(*_PART).agg(F.sum("_count").alias("_count")).withColumn("_piece", number))
        above = owners.select(F.col("_piece").alias("_from"), "_class", "_off")
        owners = cut_lineage(parts.drop("_count").join(pieces.drop("_count"), _PART).join(above, "_from")
                             .select("_piece", "_class", (F.col("_off") + F.col("_by")).alias("_off")))
    starts = found[0]
    for more in found[1:]:
        starts = starts.unionByName(more)
    at = F.shiftleft(F.col("_start") + F.col("_at"), R.COUNT_BITS).bitwiseOR(F.lit(1).cast("long"))
    return (strings.join(classes.drop("_count"), same).join(starts, "_class")
            .select("_doc", "_tv", at.alias("_at"), F.lit(R.SETTLED).cast("byte").alias("_kind")))


def repeated_strings(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, fine: int = FINE_ANCHOR,
                     hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_doc, _tv, _spans): packed runs of starts whose strings also start elsewhere, for rows that have any."""
    texts = keyed(docs, id_col, text_col)
    runs = cut_lineage(R.judged(texts.mapInArrow(_ask_runs(size, anchor), R.ROWS_SQL), "any"))
    per_row = lambda df, out: df.groupBy("_doc", "_tv").agg(F.array_sort(F.collect_set("_at")).alias(out))
    still = per_row(runs.where(F.col("_kind") != R.SETTLED), "_spans")
    segments = cut_lineage(
        texts.join(still, ["_doc", "_tv"]).select("_doc", "_tv", "_text", "_spans")
        .mapInArrow(_segments(size), "_doc long, _tv long, _spans array<long>, _bytes array<binary>"))
    finer = cut_lineage(R.judged(segments.mapInArrow(_ask_fine(size, fine), R.ROWS_SQL), "any"))
    left = per_row(finer.where(F.col("_kind") != R.SETTLED), "_still")
    strings = cut_lineage(segments.join(left, ["_doc", "_tv"]).select("_doc", "_tv", "_spans", "_bytes", "_still")
                          .mapInArrow(_strings(size, fine), "_key long, _doc long, _tv long, _start long, "
                                                            "_anchor long, _string binary"))
    every = (runs.unionByName(finer).where(F.col("_kind") != R.OPEN)
             .unionByName(built_starts(strings, size, fine, hot)))
    return per_row(every, "_spans")


def _cut_bytes(size: int):
    names = ["_doc", "_kept", "_n", "_removed", "_cuts"]

    def run(batches):
        for rows, data, off in K.text_slices(batches, "_text"):
            kept, gone, cuts = [], [], []
            for i, at in enumerate(rows.column("_spans").to_pylist()):
                part = data[off[i]:off[i + 1]]
                mask = np.zeros(len(part), dtype=bool)
                if at:
                    first, count = R.unpack(np.asarray(at, dtype=np.int64))
                    mask = K.spans_to_mask(first, first + count - 1 + size, len(part))
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                kept.append(part[~mask].tobytes())
                gone.append(int(mask.sum()))
                cuts.append(edge.reshape(-1, 2).tolist())
            yield pa.RecordBatch.from_arrays(
                [rows.column("_doc"), pa.array(kept, pa.binary()), pa.array(np.diff(off)), pa.array(gone, pa.int64()),
                 pa.array(cuts, pa.list_(pa.list_(pa.int64())))], names=names)
    return run


def dedup_strings(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, fine: int = FINE_ANCHOR, hot: int = HOT,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, removed, kept): removed byte spans and the remaining bytes of every row."""
    spans = repeated_strings(docs, size, anchor, fine, hot, id_col, text_col)
    out = (keyed(docs, id_col, text_col).join(spans, ["_doc", "_tv"], "left").select("_doc", "_text", "_spans")
           .mapInArrow(_cut_bytes(size), "_doc long, _kept binary, _n long, _removed long, _cuts array<array<long>>"))
    return out.select(null_again("_doc").alias(id_col), F.col("_n").alias("n_bytes"), F.col("_removed").alias("n_removed"),
                      F.col("_cuts").alias("removed"), F.col("_kept").alias("kept"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``dedup_strings`` over the whole documents table."""
    out = dedup_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, n, i, md5(b[i:i + {SIZE - 1}]) AS s
      FROM (SELECT doc_id, b, n, unnest(range(1, n - {SIZE - 2})) AS i FROM d WHERE n >= {SIZE})),
hit AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
mark AS (SELECT *, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {SIZE}, 0) THEN 1 ELSE 0 END AS head FROM hit),
run AS (SELECT doc_id, min(i) AS lo, max(i) + {SIZE} AS hi
        FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark) GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS lo, lo AS hi FROM run
        UNION ALL SELECT run.doc_id, max(hi), max(n) + 1 FROM run JOIN d ON d.doc_id = run.doc_id GROUP BY run.doc_id),
kept AS (SELECT gap.doc_id, string_agg(CASE WHEN gap.hi > gap.lo THEN hex(b[gap.lo:gap.hi - 1]) ELSE '' END, '' ORDER BY gap.lo) AS x
         FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id),
cut AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM run GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, cast(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       CASE WHEN spans IS NULL THEN sha256(b) ELSE sha256(from_hex(x)) END AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def brute_strings(rows, size: int = SIZE):
    """Plain restatement of the contract for tests: rows of (doc_id, text)."""
    seen: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        for i in range(len(b) - size + 1):
            seen[b[i:i + size]] = seen.get(b[i:i + size], 0) + 1
    out = []
    for d, b in raw:
        mask = np.zeros(len(b) + 2, dtype=bool)
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                mask[i + 1:i + 1 + size] = True
        keep = bytes(x for x, m in zip(b, mask[1:-1]) if not m)
        out.append((d, len(b), int(mask.sum()), int((mask[1:] & ~mask[:-1]).sum()), hashlib.sha256(keep).hexdigest()))
    return out

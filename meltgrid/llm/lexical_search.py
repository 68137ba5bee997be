"""Ranked lexical search by bag deduplication.

A document matters to a query set only by how often it has the queries' terms and by its length factor m.  So texts
are restricted to the items' vocabulary, and documents with the same counts and the same m form a class: classes are
dealt by a hash and compared on all their bytes.  A class is scored once for every item; the best classes of an item
are then expanded to their members by ascending id.  A class brings at least one document, so the 50 best documents of
an item stand in its 50 best classes, classes of equal score being ordered by their smallest id.

Items are taken in blocks of a bounded number of (item, term) rows, which each task holds as posting lists; a block is
a stated query set against all documents.  Scores are sums of integers below 2^53, held exactly in doubles.

Defined results: null texts have no terms; items without terms have no results; rows of one item id are one item with
the terms of all, and null is an item id of its own; null document ids come first among equal scores; repeated rows
are documents of their own; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meltgrid.llm.common import id_or_least, null_again, table
from meltgrid.session import cut_lineage, sized

TOP = 50
#: (item, term) rows of a block of items.
ITEM_ROWS = 1 << 16
#: Products of a class's counts with posting lists that a task expands at once, and scores it holds at once.
PRODUCTS, SCORES = 1 << 20, 1 << 21
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
SCALE = 1_000_000_000

#: A-Z in lower case; every byte that is not part of a term becomes a space.
_TERM = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
              for c in range(256))


def count_terms(text: bytes) -> Counter:
    """Terms of a text with their occurrences."""
    if len(text) <= PIECE:
        return Counter(text.translate(_TERM).split())
    out, at = Counter(), 0
    text = text.translate(_TERM)
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        out.update(text[at:end].split())
        at = end
    return out


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(_item, _term) of every distinct term of every item."""
    def run(batches):
        for b in batches:
            item, text = b.column(0).to_pylist(), b.column(1).to_pylist()
            pairs = [(i, w) for i, t in zip(item, text) for w in count_terms((t or "").encode())]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                              pa.array([p[1] for p in pairs], pa.binary())], names=["_item", "_term"])
    rows = items.select(id_or_least(id_col).alias("_item"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "_item long, _term binary").distinct()


class Postings:
    """Items of each term of a block, terms and items as numbers."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.terms = sorted({t for _, t in rows})
        self.items = np.array(sorted({i for i, _ in rows}), dtype=np.int64)
        self.number = {t: k for k, t in enumerate(self.terms)}
        item = np.searchsorted(self.items, np.array([i for i, _ in rows], dtype=np.int64))
        term = np.array([self.number[t] for _, t in rows], dtype=np.int64)
        order = np.lexsort((item, term))
        self.item = item[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``term``, item) of every item that has it."""
        count = self.start[term + 1] - self.start[term]
        at = np.repeat(np.arange(len(term)), count)
        within = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, self.item[self.start[term][at] + within]


def bags(docs: DataFrame, number: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_doc, _n: terms of the text, _bag: its (term number, occurrences) in the vocabulary, as pairs of 32 bits)."""
    def run(batches):
        for b in batches:
            ids, text = b.column(0), b.column(1)
            size, found = [], []
            for i in range(b.num_rows):
                t = text[i].as_buffer()
                c = count_terms(t.to_pybytes() if t is not None else b"")
                size.append(sum(c.values()))
                pairs = sorted((number[w], k) for w, k in c.items() if w in number)
                found.append(np.array(pairs, dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(found, pa.binary())],
                                             names=["_doc", "_n", "_bag"])
    rows = docs.select(id_or_least(id_col).alias("_doc"), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, "_doc long, _n long, _bag binary")


def _pairs(bag: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of every pair of a column of bags."""
    off = np.frombuffer(bag.buffers()[1], dtype=np.int32)[bag.offset:bag.offset + len(bag) + 1].astype(np.int64)
    data = np.frombuffer(bag.buffers()[2], dtype="<u4")[off[0] // 4:off[-1] // 4].reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(bag)), np.diff(off) // 8), data[:, 0], data[:, 1]


def document_counts(classes: DataFrame, terms: int) -> dict[int, int]:
    """Documents that hold each term of the vocabulary; tasks send a row for each term at most."""
    def run(batches):
        total = np.zeros(terms, dtype=np.int64)
        for b in batches:
            row, term, _ = _pairs(b.column(0))
            np.add.at(total, term, b.column(1).to_numpy()[row])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "df"])
    rows = classes.select("_bag", "_size").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}


def weights(df: dict[int, int], terms: int, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(terms)], dtype=np.int64)


def _first_classes(held: list[np.ndarray], top: int) -> list[np.ndarray]:
    """Of (item, score, smallest id, class) the ``top`` rows of each item by score and smallest id."""
    order = np.lexsort((held[3], held[2], -held[1], held[0]))
    item = held[0][order]
    order = order[np.arange(len(item)) - np.searchsorted(item, item) < top]
    return [x[order] for x in held]


def best_classes(classes: DataFrame, postings: Postings, weight: np.ndarray, top: int = TOP) -> DataFrame:
    """(_item, _score, _class) of the classes that can hold the ``top`` documents of each item."""
    width = len(postings.items)

    def run(batches):
        none = np.zeros(0, dtype=np.int64)
        held = [none, none, none, none]
        least = np.ones(width, dtype=np.int64)  # lower scores cannot enter an item's best classes
        for b in batches:
            first_id, key, m = (b.column(i).to_numpy() for i in (1, 2, 3))
            row, term, tf = _pairs(b.column(0))
            worth = weight[term] * (SCALE * tf // (1000 * tf + 20 * m[row]))
            load = np.cumsum(postings.start[term + 1] - postings.start[term])
            low = 0
            while low < b.num_rows:  # so many classes that products and scores stay within their bounds
                a = int(np.searchsorted(row, low))
                most = int(np.searchsorted(load, (load[a - 1] if a else 0) + PRODUCTS, "right"))
                high = int(row[most]) if most < len(row) else b.num_rows
                high = min(max(high, low + 1), low + max(1, SCORES // width), b.num_rows)
                z = int(np.searchsorted(row, high))
                at, item = postings.expand(term[a:z])
                score = np.bincount((row[a:z][at] - low) * width + item, weights=worth[a:z][at].astype(np.float64),
                                    minlength=(high - low) * width).astype(np.int64)
                hit = np.flatnonzero(score >= np.tile(least, high - low))
                part = [hit % width, score[hit], first_id[low + hit // width], key[low + hit // width]]
                held = [np.concatenate(x) for x in zip(held, part)]
                if len(held[0]) > 2 * top * width:
                    held = _first_classes(held, top)
                    last = np.flatnonzero(np.append(held[0][1:] != held[0][:-1], True))
                    full = last[np.bincount(held[0], minlength=width)[held[0][last]] == top]
                    least[held[0][full]] = held[1][full]
                low = high
        held = _first_classes(held, top)
        yield pa.RecordBatch.from_arrays([pa.array(postings.items[held[0]])] + [pa.array(x) for x in held[1:]],
                                         names=["_item", "_score", "_first", "_class"])

    found = classes.select("_bag", "_first", "_class", "_m").mapInArrow(
        run, "_item long, _score long, _first long, _class long")
    order = [F.desc("_score"), "_first", "_class"]
    for keys in (["_item", F.pmod(F.col("_class"), F.lit(64))], ["_item"]):  # parts first: no item meets all tasks' rows
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))) \
            .where(F.col("_r") <= top).drop("_r")
    return found.select("_item", "_score", "_class")


def _search(docs: DataFrame, rows: list[tuple[int, bytes]], top: int, id_col: str, text_col: str) -> DataFrame:
    """(_item, _doc, _score): the ``top`` documents of the items of one block, and at most as many for each class."""
    postings = Postings(rows)
    found = cut_lineage(bags(docs, postings.number, id_col, text_col))
    size = found.agg(F.sum((F.col("_n") > 0).cast("long")).alias("n"), F.sum("_n").alias("l")).first()
    n, total = size["n"] or 0, max(size["l"] or 0, 1)
    factor = F.lit(50).cast("long") + F.expr(f"(50L * _n * {n}L) div {total}L")
    member = found.where(F.length("_bag") > 0).select("_doc", "_bag", factor.alias("_m"))
    member = member.withColumn("_h", F.xxhash64("_bag", "_m"))
    classes = cut_lineage(member.groupBy("_h", "_m", "_bag").agg(F.count("*").alias("_size"), F.min("_doc").alias("_first"))
                          .withColumn("_class", F.monotonically_increasing_id()))
    weight = weights(document_counts(classes, len(postings.terms)), len(postings.terms), n)
    best = cut_lineage(best_classes(classes, postings, weight, top))
    # Members of the classes wanted: by hash, then verified on all bytes; of a class the smallest ids suffice.
    wanted = cut_lineage(classes.join(best.select("_class").distinct(), "_class", "left_semi"))
    same = ["_h", "_m", "_bag"]
    near = member.join(sized(wanted.select("_h").distinct()), "_h", "left_semi")
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("_doc"))
    members = near.withColumn("_k", nth).where(F.col("_k") <= top).join(wanted.select(*same, "_class"), same)
    return best.join(members.select("_class", "_doc"), "_class").select("_item", "_doc", "_score")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("_item"), F.lit(blocks))


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, doc_col: str = "doc_id", item_col: str = "item_id",
                   text_col: str = "text", item_rows: int = ITEM_ROWS) -> DataFrame:
    """(item id, rank, document id, score) of the ``top`` documents with a score above 0 of every item."""
    terms = cut_lineage(item_terms(items, item_col, text_col))
    count = cut_lineage(terms.groupBy("_item").agg(F.count("*").alias("_c")))
    bound, blocks = max(item_rows, count.agg(F.max("_c").alias("c")).first()["c"] or 0), 1
    while (count.groupBy(_block(blocks)).agg(F.sum("_c").alias("c")).agg(F.max("c").alias("c")).first()["c"] or 0) > bound:
        blocks *= 2
    out = docs.sparkSession.createDataFrame([], "_item long, _doc long, _score long")
    for i in range(blocks):
        rows = [(r["_item"], bytes(r["_term"])) for r in terms.where(_block(blocks) == i).collect()]
        if rows:
            out = out.unionByName(_search(docs, rows, top, doc_col, text_col))
    order = Window.partitionBy("_item").orderBy(F.desc("_score"), "_doc")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(null_again("_item").alias(item_col), "rank", null_again("_doc").alias(doc_col),
                         F.col("_score").alias("score"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
size AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * total.n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), total),
scored AS (
  SELECT item_id, tf.doc_id,
         CAST(sum(w * (({SCALE} * tf) // (1000 * tf + 20 * (50 + (50 * size.n * total.n) // total.l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (doc_id), total GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= {TOP}
"""

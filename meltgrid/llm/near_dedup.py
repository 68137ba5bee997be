"""MinHash near-dedup with min-max hashing.

Each of ``permutations`` hash functions keeps both the smallest and the largest value it gives to a document's
shingles: two nearly independent samples for one evaluation.  Bands of four such values are compared; a pair at
similarity 0.85 meets in none of 32 bands with probability 6e-11.  Every link is confirmed on full shingle sets.

Documents with equal sets form one class first.  Documents that share a band, directly or through others, form a
family; only its members can be linked.  A family of at most ``BLOCK`` shingles (``LEAST`` for a short one) is compared in one task: shared
shingles of all its pairs are counted at once, exactly, and the links leave the task as a spanning forest, not as
pairs.  In a larger family each member is first tested against its likeliest partner, which joins most of it to one
component; the rest is then compared in blocks of bounded size, with itself and with that component.  So no row is
made for each pair, no task holds more than two blocks, and every pair of a family is linked, joined, or refused on
full sets.

Defined results: null, empty or blank texts have an empty set and no links; fewer than ``n`` words make one shingle;
in ``near_duplicates`` rows with equal ids are one document whose links are joined, and a null id is a document that
stands before all others and comes back null; ``drop_near_duplicates`` works on rows, and only exact copies of one id
and text are one document; empty tables give empty results; only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm import kernels as K
from meltgrid.llm.common import id_or_least, keyed, null_again, shingle_sql, spare, table
from meltgrid.operators.components import graph_components
from meltgrid.session import cut_lineage, sized, spread

PERMUTATIONS = 64
BAND_ROWS = 4
BLOCK = 150_000
#: A document counts as this many shingles at least, so that a block of short ones stays a small matrix.
LEAST = 200
_RARE = 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def row_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row, A-Z lower-cased."""
    value, row = K.shingles(K.Words(_LOWER[data], off), n)
    cut = np.searchsorted(row, np.arange(len(off)))
    return [np.unique(value[cut[i]:cut[i + 1]]) for i in range(len(off) - 1)]


def min_max(values: np.ndarray, start: np.ndarray, permutations: int) -> np.ndarray:
    """Signature matrix: per set the minima, then the maxima, of all permutations."""
    rng = np.random.default_rng(8)
    odd = rng.integers(0, 2**32, permutations, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, permutations, dtype=np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2 * permutations, len(start)), dtype=np.uint64)
    for p in range(permutations):
        x = short * odd[p] + add[p]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[p] = np.minimum.reduceat(x, start)
        out[permutations + p] = np.maximum.reduceat(x, start)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    keys = []
    for b in range(signature.shape[0] // rows):
        h = np.full(signature.shape[1], b + 1, dtype=np.uint64)
        for r in range(rows):
            h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[b * rows + r])
        keys.append(h)
    return np.stack(keys, axis=1)


def _sketch(n: int, permutations: int):
    def run(batches):
        for rows, data, off in K.text_slices(batches, "_text"):
            sets = row_sets(data, off, n)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(size)
            keys = np.zeros((len(sets), 0), dtype=np.uint64)
            two = np.zeros((2, len(sets)), dtype=np.uint64)
            bands = [None] * len(sets)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                start = np.cumsum(size[full]) - size[full]
                two[0, full] = np.add.reduceat(K.mix(values), start)
                two[1, full] = np.bitwise_xor.reduceat(K.mix(values + np.uint64(77)), start)
                keys = K.signed(band_keys(min_max(values, start, permutations), BAND_ROWS))
                for i, x in zip(full.tolist(), keys):
                    bands[i] = x
            own = [c for c in rows.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*map(rows.column, own), pa.array(size), pa.array(K.signed(two[0])), pa.array(K.signed(two[1])),
                 pa.array(bands, pa.list_(pa.int64()))], names=[*own, "_n", "_h1", "_h2", "_bands"])
    return run


def _confirm(n: int, percent: int):
    """Linked pairs among (a, b, text of a, text of b); rows come sorted by b, so b's set is mostly at hand."""
    def one(text):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        return row_sets(data, np.array([0, len(data)]), n)[0]

    def run(batches):
        last, held = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "_ta", "_tb"))):
                if tb != last:
                    last, held = tb, one(tb)
                other = one(ta)
                both = len(np.intersect1d(other, held, assume_unique=True))
                if both and 100 * both >= percent * (len(other) + len(held) - both):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())],
                                             names=["a", "b"])
    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the number of values that every two sets share."""
    size = len(sets)
    value = np.concatenate(sets)
    row = np.repeat(np.arange(size), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    count = np.diff(np.append(head, len(value)))
    often = np.repeat(count > _RARE, count)
    out = np.zeros(size * size)
    rare_value, rare_row = value[~often], row[~often]
    for shift in range(1, _RARE):
        hit = np.flatnonzero(rare_value[shift:] == rare_value[:-shift])
        if not len(hit):
            break
        out += np.bincount(rare_row[hit] * size + rare_row[hit + shift], minlength=size * size)
    out = out.reshape(size, size)
    out += out.T
    column = np.repeat(np.cumsum(count > _RARE) - 1, count)[often]
    row = row[often]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        grid = np.zeros((size, 4096), dtype=np.float32)
        grid[row[lo:hi], column[lo:hi] - at] = 1
        out += grid @ grid.T
    return out


def _compare(n: int, percent: int):
    """A spanning forest of the links within each (_family, _lo, _hi) group of sorted rows (_doc, _text)."""
    def links(ids: list[int], texts: list[str]):
        raw = [(t or "").encode() for t in texts]
        off = np.cumsum([0] + [len(x) for x in raw])
        sets = row_sets(np.frombuffer(b"".join(raw), dtype=np.uint8), off, n)
        full = [i for i, x in enumerate(sets) if len(x)]
        if len(full) < 2:
            return
        both = shared_counts([sets[i] for i in full])
        size = np.array([len(sets[i]) for i in full], dtype=float)
        near = (both > 0) & (100 * both >= percent * (size[:, None] + size[None, :] - both))
        todo = np.ones(len(full), dtype=bool)
        for start in range(len(full)):
            if not todo[start]:
                continue
            todo[start] = False
            stack = [start]
            while stack:
                i = stack.pop()
                new = np.flatnonzero(near[i] & todo)
                todo[new] = False
                for j in new.tolist():
                    yield ids[full[i]], ids[full[j]]
                    stack.append(j)

    def run(batches):
        key, ids, texts = None, [], []
        for batch in batches:
            out = []
            for f, lo, hi, d, t in zip(*(batch.column(c).to_pylist()
                                         for c in ("_family", "_lo", "_hi", "_doc", "_text"))):
                if (f, lo, hi) != key:
                    out += links(ids, texts)
                    key, ids, texts = (f, lo, hi), [], []
                ids.append(d)
                texts.append(t)
            yield _edges(out)
        yield _edges(list(links(ids, texts)))
    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _roots(links: DataFrame) -> DataFrame:
    """(_doc, _root) of every end of a link."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return cut_lineage(graph_components(ends, links).select(F.col("node").alias("_doc"), F.col("root").alias("_root")))


def _rooted(df: DataFrame, links: DataFrame) -> DataFrame:
    return df.join(spread(_roots(links)), "_doc", "left").withColumn("_root", F.coalesce("_root", "_doc"))


def _likeliest(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of documents to the bucket heads with which they share most buckets."""
    shared = (members.where("_doc <> _head").groupBy(F.col("_doc").alias("a"), F.col("_head").alias("b"))
              .agg(F.count("*").alias("_c")))
    best = shared.groupBy("a").agg(F.min(F.struct((-F.col("_c")).alias("_c"), "b")).alias("_x")).select("a", "_x.b")
    ta = texts.select(F.col("_doc").alias("a"), F.col("_text").alias("_ta"))
    tb = texts.select(F.col("_doc").alias("b"), F.col("_text").alias("_tb"))
    return best.join(spread(ta), "a").join(spread(tb), "b").select("a", "b", "_ta", "_tb").mapInArrow(
        _confirm(n, percent), "a long, b long")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """(_family, _lo, _hi, _doc): block pairs to compare, of members (_family, _doc, _n, _main).

    Members of the main component are compared with the others only; the others with everybody.
    """
    part = lambda main: F.ceil(F.sum(F.when(F.col("_main") == main, F.col("_n"))) / block)
    many = members.groupBy("_family").agg(F.coalesce(part(False), F.lit(0)).alias("_s"),
                                          F.coalesce(part(True), F.lit(0)).alias("_g")).where("_s > 0")
    at = members.join(sized(many), "_family").withColumn(
        "_b", F.when(F.col("_main"), F.expr("_s + pmod(xxhash64(_doc), greatest(_g, 1))"))
        .otherwise(F.expr("pmod(xxhash64(_doc), _s)")))
    other = F.explode(F.expr("sequence(0L, if(_main, _s, _s + _g) - 1)")).alias("_p")
    return (at.select("_family", "_doc", "_b", "_s", "_g", other).where("_p <> _b OR _s + _g = 1")
            .select("_family", F.least("_b", "_p").alias("_lo"), F.greatest("_b", "_p").alias("_hi"), "_doc"))


def near_links(docs: DataFrame, n: int = 3, percent: int = 85, permutations: int = PERMUTATIONS,
               id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, by_row: bool = False) -> DataFrame:
    """(_doc, _n, _root): set size of every row and the smallest id its document reaches.

    With ``by_row`` each distinct (id, text hash) is a document of its own, (_id, _tv), and ``_doc`` its number in
    that order.
    """
    own = ["_id", "_tv"] if by_row else ["_doc"]
    texts = (keyed(docs, id_col, text_col).withColumnRenamed("_doc", "_id") if by_row else
             docs.select(id_or_least(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")))
    sketch = cut_lineage(texts.mapInArrow(
        _sketch(n, permutations), "".join(f"{c} long, " for c in own) + "_n long, _h1 long, _h2 long, _bands array<long>"))
    if by_row:
        number = cut_lineage(sketch.select(own).distinct().sort(own).withColumn("_doc", F.monotonically_increasing_id()))
        sketch = cut_lineage(sketch.join(spread(number), own))
    some = sketch.where("_n > 0")
    same = ["_n", "_h1", "_h2"]
    least = some.groupBy(*same).agg(F.min("_doc").alias("b"))
    copies = some.join(spread(least), same).where("_doc <> b").select(F.col("_doc").alias("a"), "b")
    # A class is looked up under its smallest id only.
    buckets = (some.join(spread(least), same).where("_doc = b")
               .select("_doc", F.explode(F.array_distinct("_bands")).alias("_bucket")))
    shared = (buckets.groupBy("_bucket").agg(F.min("_doc").alias("_head"), F.max("_doc").alias("_hi"))
              .where("_head < _hi").select("_bucket", "_head"))
    # Nothing above this join needs a bucket's rows together, so Spark may split a hot bucket.
    members = cut_lineage(buckets.join(spread(shared), "_bucket").select("_bucket", "_head", "_doc"))
    family = _roots(members.where("_doc <> _head").select(F.col("_doc").alias("a"), F.col("_head").alias("b")).distinct())
    sizes = some.groupBy("_doc").agg(F.greatest(F.max("_n"), F.lit(LEAST)).alias("_n"))
    family = cut_lineage(family.withColumnRenamed("_root", "_family").join(spread(sizes), "_doc"))
    # A large family takes over ``block`` shingles, so these and their tables are few beside documents.
    large = sized(family.groupBy("_family").agg(F.sum("_n").alias("_all")).where(F.col("_all") > block).select("_family"))
    wanted = number.join(spread(family.select("_doc")), "_doc") if by_row else family.select("_doc")
    # Few members are looked up where the texts are.
    texts = cut_lineage(texts.join(spread(wanted, family.count()), own).select("_doc", "_text"))
    large_docs = cut_lineage(family.join(large, "_family"))
    first = cut_lineage(_likeliest(members.join(spread(large_docs.select("_doc")), "_doc", "left_semi"),
                                   texts.join(spread(large_docs.select("_doc")), "_doc", "left_semi"), n, percent))
    rooted = cut_lineage(_rooted(large_docs, first))
    main = (rooted.groupBy("_family", "_root").agg(F.sum("_n").alias("_c")).groupBy("_family")
            .agg(F.max(F.struct("_c", "_root")).alias("_x")).select("_family", F.col("_x._root").alias("_m")))
    parted = rooted.join(sized(main), "_family").select("_family", "_doc", "_n", (F.col("_root") == F.col("_m")).alias("_main"))
    # A small family is one block of its own.
    alone = F.lit(0).cast("long")
    small = family.join(large, "_family", "left_anti").select("_family", alone.alias("_lo"), alone.alias("_hi"), "_doc")
    # Small families by their first id, large ones block by block; rows of one group follow each other.
    group = ["_family", "_lo", "_hi"]
    found = cut_lineage(_blocks(parted, block).unionByName(small).join(spread(texts), "_doc").repartition(*group)
                        .sortWithinPartitions(*group).select(*group, "_doc", "_text")
                        .mapInArrow(_compare(n, percent), "a long, b long"))
    ids = ["_doc", *own] if by_row else own
    return _rooted(sketch.select(*ids, "_n"), copies.unionByName(first).unionByName(found))


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85, permutations: int = PERMUTATIONS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    found = near_links(docs, n, percent, permutations, id_col, text_col)
    return found.select(null_again("_doc").alias(id_col), F.col("_n").alias("n_shingles"),
                        null_again("_root").alias("component_id"), (F.col("_doc") == F.col("_root")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, permutations: int = PERMUTATIONS,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked texts, the one with the smallest id; a row whose text is linked to
    no other stays whatever its id is, and of exact copies of one id and text one stays."""
    # Workers of a pipeline keep what earlier stages loaded, so blocks are smaller here.
    out = near_links(docs, n, percent, permutations, id_col, text_col, block=BLOCK // 2, by_row=True)
    key = spare(docs, "_doc", "_tv")
    rows = docs.withColumns(dict(zip(key, (id_or_least(id_col), F.coalesce(F.xxhash64(text_col), F.lit(0))))))
    out = out.where("_doc = _root").select("_id", "_tv").distinct().toDF(*key)
    return rows.join(spread(out), key, "left_semi").dropDuplicates(key).drop(*key)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` over the whole documents table: 3-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
sh AS ({shingle_sql('d', 'doc_id', 't', 3)}),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
meet AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM meet JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
l(doc_id, lab) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.x, min(o.lab) FROM e JOIN l o ON o.doc_id = e.y JOIN recurring.l m ON m.doc_id = e.x GROUP BY e.x, m.lab HAVING min(o.lab) < m.lab)
SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, lab AS component_id, l.doc_id = lab AS kept FROM l LEFT JOIN n ON n.doc_id = l.doc_id
"""


def brute_components(rows, n: int = 3, percent: int = 85):
    """Plain restatement for tests: rows of (doc_id, text) with distinct ids."""
    sets = {}
    for d, t in rows:
        raw = (t or "").encode().translate(bytes(_LOWER.tolist())).split()
        sets[d] = {tuple(raw[i:i + n]) for i in range(len(raw) - n + 1)} if len(raw) >= n else {tuple(raw)} - {()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]

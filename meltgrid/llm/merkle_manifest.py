"""Merkle manifest of a dataset by butterfly exchange.

A row's digest is a leaf; the leaves of a group, in order, form a tree of runs of ``FANOUT`` nodes; the groups' roots
form one tree above them in the same way.  Positions come from a range sort and a running total over its parts, so a
group may hold any share of the rows.  Aligned stretches of ``FANOUT ** INNER`` leaves hash their own subtree.  Then the
stretches swap subtree roots: in round r a stretch meets those that differ from it in base-``FANOUT`` digit r of the
stretch number only, at most ``FANOUT`` rows under one key.  All of them hash the same parent, and each notes its own
siblings, so after the last round every stretch holds its upper proof and the root and nothing is sent down the tree.
Where the last node of a level has fewer stretches than the others, these stand in for the missing ones.

Defined results: a null field is ``-`` in a leaf and differs from an empty text; null groups and null ids come first,
equal ids are ordered by leaf; repeated rows are a leaf each, and which of them has which place is of no consequence;
a group of one leaf has that leaf as root; empty tables give no rows; other columns of the input are not carried, and
names may clash with nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meltgrid.llm.common import table
from meltgrid.session import cut_lineage, sized

FANOUT = 8
#: Levels that a stretch hashes alone: it holds FANOUT ** INNER leaves.
INNER = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<before:string,after:string>"


def leaf(*fields: Column) -> Column:
    """Digest of the fields; each gives its UTF-8 length and value, so fields cannot run into each other."""
    part = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
            for s in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*part), 256)


def _digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _levels(nodes: list[str], rounds: int) -> list[list[str]]:
    """The nodes and what they hash to, level by level."""
    out = [nodes]
    for _ in range(rounds):
        low = out[-1]
        out.append([_digest(*low[i:i + FANOUT]) for i in range(0, len(low), FANOUT)])
    return out


def _inner_rounds(leaves: int, blocks: int, inner: int) -> int:
    """Levels hashed within a stretch: all of them, or as many as a whole group of one stretch needs."""
    if blocks > 1:
        return inner
    rounds = 0
    while leaves > 1:
        leaves, rounds = -(-leaves // FANOUT), rounds + 1
    return rounds


def _places(nodes: DataFrame) -> DataFrame:
    """``nodes`` (_g, _key, _leaf, _tie, ...) with their place ``_pos`` in the group and the group's size ``_n``."""
    order = ["_g", F.col("_key").asc_nulls_first(), "_leaf", "_tie"]

    def number(batches):
        group, here = None, 0
        for b in batches:
            out = []
            for g in b.column(b.schema.get_field_index("_g")).to_pylist():
                here = here + 1 if g == group else 0
                group = g
                out.append(here)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "_at"])

    fields = ", ".join(f"`{c}` {t}" for c, t in nodes.dtypes)
    parts = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    numbered = cut_lineage(parts.mapInArrow(number, f"{fields}, _part int, _at long"))
    share = numbered.groupBy("_g", "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    share = share.select("_g", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"),
                         F.sum("_c").over(Window.partitionBy("_g")).alias("_n"))
    return (numbered.join(sized(cut_lineage(share)), ["_g", "_part"])
            .withColumn("_pos", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first", "_tie"))


def _stretches(placed: DataFrame, inner: int) -> DataFrame:
    """One row for each aligned stretch: (_g, _block, _blocks, _rows: its leaves in order, _root: their root)."""
    row = F.struct("_pos", *[c for c in placed.columns if c not in ("_g", "_pos", "_n")])
    rows = (placed.groupBy("_g", F.floor(F.col("_pos") / FANOUT ** inner).cast("long").alias("_block"),
                           F.ceil(F.col("_n") / FANOUT ** inner).cast("long").alias("_blocks"))
            .agg(F.sort_array(F.collect_list(row)).alias("_rows")))

    def run(batches):
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            leaves, roots = b.column(at["_rows"]), []
            for i, blocks in enumerate(b.column(at["_blocks"]).to_pylist()):
                nodes = leaves[i].values.field("_leaf").to_pylist()
                roots.append(_levels(nodes, _inner_rounds(len(nodes), blocks, inner))[-1][0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())],
                                             names=[*b.schema.names, "_root"])
    kept = rows.schema["_rows"].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(run, f"_g string, _block long, _blocks long, _rows {kept}, _root string"))


def _swap(state: DataFrame, width: int) -> DataFrame:
    """One round: stretches of nodes ``width`` stretches wide learn their parents and their siblings."""
    node, lane = F.floor(F.col("_block") / width).cast("long"), F.col("_block") % width
    last = F.floor((F.col("_blocks") - 1) / width).cast("long")
    # The last node has fewer stretches; they serve the other lanes too, where that node has siblings.
    short = F.col("_blocks") - last * width
    serves = F.when((node == last) & (node % FANOUT > 0), F.sequence(lane, F.lit(width - 1).cast("long"), short)) \
        .otherwise(F.array(lane))
    sent = (state.withColumns({"_own": lane, "_node": node, "_lane": F.explode(serves)})
            .groupBy("_g", "_blocks", F.floor(F.col("_node") / FANOUT).cast("long").alias("_parent"), "_lane")
            .agg(F.sort_array(F.collect_list(F.struct("_node", "_root", "_block", "_proof",
                                                      (F.col("_own") == F.col("_lane")).alias("_real"))))
                 .alias("_run")))
    digests = F.transform("_run", lambda x: x["_root"])
    here = sent.select("_g", "_blocks", F.sha2(F.array_join(digests, ""), 256).alias("_root"),
                       digests.alias("_all"), F.posexplode("_run").alias("_i", "_me")).where("_me._real")
    step = F.struct(F.array_join(F.slice("_all", F.lit(1), F.col("_i")), "").alias("before"),
                    F.array_join(F.slice("_all", F.col("_i") + 2, F.lit(FANOUT)), "").alias("after"))
    return here.select("_g", F.col("_me._block").alias("_block"), "_blocks", "_root",
                       F.concat("_me._proof", F.array(step)).alias("_proof"))


def _upper(stretches: DataFrame) -> DataFrame:
    """(_g, _block, _root, _proof): the root of each stretch's group and the stretch's way to it."""
    state = stretches.select("_g", "_block", "_blocks", "_root", F.expr(f"cast(array() AS array<{_STEP}>)").alias("_proof"))
    most = state.agg(F.max("_blocks").alias("m")).first()["m"] or 1
    width, done = 1, state.where(F.col("_blocks") == 1)
    while width < most:
        state = cut_lineage(_swap(state.where(F.col("_blocks") > width), width))
        width *= FANOUT
        done = done.unionByName(state.where(F.col("_blocks") <= width))
    return done.drop("_blocks")


def _proofs(stretches: DataFrame, upper: DataFrame, inner: int) -> DataFrame:
    """Rows of the stretches with ``proof``, the steps from the row to the root, and ``_root``."""
    rows = stretches.schema["_rows"].dataType.elementType
    names = [f.name for f in rows.fields if f.name != "_pos"]

    def run(batches):
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                block = b.column(at["_rows"])[i].values
                above = b.column(at["_proof"])[i].as_py()
                low = block.field("_leaf").to_pylist()
                levels = _levels(low, _inner_rounds(len(low), b.column(at["_blocks"])[i].as_py(), inner))
                steps = []
                for j in range(len(low)):
                    own, k = [], j
                    for nodes in levels[:-1]:
                        first = k - k % FANOUT
                        own.append({"before": "".join(nodes[first:k]), "after": "".join(nodes[k + 1:first + FANOUT])})
                        k //= FANOUT
                    steps.append(own + above)
                same = [pa.repeat(b.column(at[c])[i], len(low)) for c in ("_g", "_root")]
                kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [*same, *[block.field(c) for c in names], pa.array(steps, kind)], names=["_g", "_root", *names, "proof"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.fields if f.name != "_pos")
    return stretches.drop("_root").join(upper, ["_g", "_block"]).select(
        "_g", "_root", "_blocks", "_rows", "_proof").mapInArrow(
        run, f"_g string, _root string, {schema}, proof array<{_STEP}>")


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof, from the leaf upwards, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             extra: dict[str, Column] | None = None, inner: int = INNER) -> DataFrame:
    """(id, leaf, subroot, root, proof) of every row, beside ``extra`` columns computed from the row.

    ``proof`` has a step for each level: the digests before and after the own one in its run.
    """
    extra = extra or {}
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    rows = docs.select(group.alias("_g"), F.col(id_col).cast("long").alias("_key"),
                       leaf(*[F.col(c) for c in fields]).alias("_leaf"), F.monotonically_increasing_id().alias("_tie"),
                       *[c.alias(f"_x{i}") for i, c in enumerate(extra.values())])
    leaves = _stretches(_places(cut_lineage(rows)), inner)
    upper = cut_lineage(_upper(leaves))
    low = cut_lineage(_proofs(leaves, upper, inner))
    subroots = upper.where("_block = 0").select(F.lit("").alias("_g"), F.lit(0).cast("long").alias("_key"),
                                                         F.col("_g").alias("_leaf"), F.col("_root").alias("_sub"))
    # Groups are ordered by name; the tree above them is made of their roots.
    named = _places(subroots.withColumn("_tie", F.lit(0).cast("long")))
    groups = _stretches(named.select("_g", F.col("_leaf").alias("_name"), F.col("_sub").alias("_leaf"), "_pos", "_n"),
                        inner)
    top = cut_lineage(_proofs(groups, _upper(groups), inner).select(F.col("_name").alias("_g"), F.col("_root").alias("root"),
                                 F.col("proof").alias("_rest")))
    return low.join(sized(top), "_g").select(
        F.col("_key").alias(id_col), F.col("_leaf").alias("leaf"), F.col("_root").alias("subroot"), "root",
        F.concat("proof", "_rest").alias("proof"), *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)])


def tampered(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Leaf of a row whose text lost its capitals, for the ids whose checksum 3 divides; others keep their leaf."""
    changed = {text_col: F.translate(F.col(text_col), UPPER, LOWER)}
    hit = F.crc32(F.col(id_col).cast("string")) % 3 == 0
    return F.when(hit, leaf(*[changed.get(c, F.col(c)) for c in FIELDS])).otherwise(leaf(*[F.col(c) for c in FIELDS]))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof digest of every row of the documents table, and the check of each, altered rows included."""
    rows = manifest(table(spark, sf_dir, "documents"), extra={"_now": tampered()})
    folded = fold(F.col("_now"), F.col("proof"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(text: str) -> str:
    part = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(part)})"


_LOW = f"translate(text, '{UPPER}', '{LOWER}')"
#: Bitwise CRC over the decimal digits of an id.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR x IN range(8)]),
                             lambda p, q: xor(p >> 1, (p & 1) * 3988292384))))"""

ORACLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_sql_leaf('text')} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_sql_leaf(_LOW)} ELSE {_sql_leaf('text')} END AS now FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY g) AS n FROM rows),
low AS (
  SELECT 0 AS lvl, g, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, g, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY lvl, g, pos // {FANOUT}, n),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subs
  UNION ALL
  SELECT lvl + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY lvl, pos // {FANOUT}, n),
climb AS (
  SELECT 0 AS lvl, doc_id, leaf, g, pos, n, pos AS start, now AS d, '' AS proof FROM placed
  UNION ALL
  SELECT c.lvl + 1, c.doc_id, c.leaf, c.g, c.pos // {FANOUT}, (c.n + {FANOUT - 1}) // {FANOUT}, c.start,
         sha256(string_agg(CASE WHEN l.pos = c.pos THEN c.d ELSE l.h END, '' ORDER BY l.pos)),
         c.proof || coalesce(string_agg(l.h, '' ORDER BY l.pos) FILTER (WHERE l.pos <> c.pos), '')
  FROM climb c JOIN low l ON l.lvl = c.lvl AND l.g = c.g AND l.pos // {FANOUT} = c.pos // {FANOUT}
  WHERE c.n > 1 GROUP BY c.lvl, c.doc_id, c.leaf, c.g, c.pos, c.n, c.start, c.d, c.proof),
over AS (
  SELECT 0 AS lvl, c.doc_id, c.leaf, c.g, c.start, s.subroot, s.pos, s.n, c.d, c.proof
  FROM climb c JOIN subs s ON s.g = c.g WHERE c.n = 1
  UNION ALL
  SELECT c.lvl + 1, c.doc_id, c.leaf, c.g, c.start, c.subroot, c.pos // {FANOUT}, (c.n + {FANOUT - 1}) // {FANOUT},
         sha256(string_agg(CASE WHEN l.pos = c.pos THEN c.d ELSE l.h END, '' ORDER BY l.pos)),
         c.proof || coalesce(string_agg(l.h, '' ORDER BY l.pos) FILTER (WHERE l.pos <> c.pos), '')
  FROM over c JOIN top l ON l.lvl = c.lvl AND l.pos // {FANOUT} = c.pos // {FANOUT}
  WHERE c.n > 1 GROUP BY c.lvl, c.doc_id, c.leaf, c.g, c.start, c.subroot, c.pos, c.n, c.d, c.proof)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = r.h AS verified
FROM over, (SELECT h FROM top WHERE n = 1) r WHERE n = 1
"""

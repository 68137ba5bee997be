"""Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from corpus import SF, same
from pyspark.sql import functions as F

from check_queries import compare, connect
from meltgrid.llm import merkle_manifest as M


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row):
    part = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return digest(*part)


def plain_tree(leaves):
    """(root, siblings of each leaf)."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % 8:k - k % 8 + 8]
            proofs[i].append((run[:k % 8], run[k % 8 + 1:]))
            at[i] = k // 8
        nodes = [digest(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    trees = []
    for _, part in sorted(groups.items()):
        part = sorted(part, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((part, *plain_tree([plain_leaf(r) for r in part])))
    root, above = plain_tree([t[1] for t in trees])
    out = []
    for (part, subroot, proofs), high in zip(trees, above):
        for r, proof in zip(part, proofs):
            now = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                now = plain_leaf((*r[:4], low))
            steps = proof + high
            for before, after in steps:
                now = digest(*before, now, *after)
            out.append((r[0], plain_leaf(r), subroot, root, digest(*[x for b, a in steps for x in b + a]), now, now == root))
    return out


def query(docs, inner):
    rows = M.manifest(docs, extra={"_now": M.tampered()}, inner=inner)
    folded = M.fold(F.col("_now"), F.col("proof"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(M.siblings(F.col("proof")), 256), folded,
                       folded == F.col("root"))


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("inner", [1])
def test_equal_to_plain_tree(spark, inner):
    rows = [(i, "s", "en", i, f"Text Ä {i}") for i in range(613)] + [(i, None, None, None, None) for i in (None, None, 3)]
    rows += [(7000 + i, "s", "b", 1, "X" * 3000) for i in range(65)] + [(8000, "", "É", 0, "")]
    rows += [(9000 + i, "s", lang, 1, "Lone") for i, lang in enumerate("acdfgh")] + rows[5:8] + [(5, "s", "en", 9, "Other")]
    docs = spark.createDataFrame(rows, FIELDS).repartition(5).withColumns({c: F.lit(1) for c in ("leaf", "_g", "root", "proof")})
    assert same(query(docs, inner).collect(), plain_manifest(rows))


def test_one_row_and_none(spark):
    one = [(3, None, "en", 1, "A")]
    assert same(query(spark.createDataFrame(one, FIELDS), 3).collect(), plain_manifest(one))
    assert M.manifest(spark.createDataFrame([], FIELDS)).count() == 0


def test_a_hot_group_is_dealt_to_bounded_rows(spark):
    """Most rows in one group, all of them equal: no row of the exchange holds more than FANOUT digests."""
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.lit("x").alias("text"))
    out = M.manifest(docs, fields=("doc_id", "lang", "text"), inner=1).withColumn("now", M.fold(F.col("leaf"), F.col("proof")))
    assert out.where("now = root AND root = subroot").count() == 3000
    assert out.agg(F.max(F.size("proof"))).first()[0] == 4
    widest = out.agg(F.max(F.expr("array_max(transform(proof, s -> length(s.before) + length(s.after)))"))).first()[0]
    assert widest == (M.FANOUT - 1) * 64


def test_registered_query(spark):
    sf = SF.replace("0.001", "0.01")
    assert compare(M.op12_merkle_manifest(spark, sf), connect(sf), M.ORACLE_SQL) == ""

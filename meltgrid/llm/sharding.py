"""Sharding by extendible hashing under a byte limit.

Rows are hashed to ``BITS`` bits.  A bucket is a prefix of these bits; one that exceeds the limit splits on the next
bit, others stay, so buckets have different depths and the directory maps every prefix to one of them.  The bytes of
all prefixes of a depth come from one aggregate over the deepest prefixes looked at (a few for each shard), not from
a pass for each bit; only rows of buckets that are still too large are looked at more deeply.

What bits cannot split: a single row over the limit is a shard of its own; rows that are equal in id and text have
equal bits, and a bucket of nothing else is dealt to numbered parts (``part`` > 0) that fit the limit.

Defined results: a null text has no bytes; null ids hash like an empty id; empty tables give no rows; repeated rows
are placed each; other columns pass through ``write_sharded``, which replaces columns named shard and part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meltgrid.llm.common import spare, table
from meltgrid.session import cut_lineage

BITS = 60
LIMIT = 1 << 20
_STEP = 8


def row_bits(id_col: str, text_col: str) -> Column:
    """The first 60 bits of a digest of id and text."""
    key = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                      F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column) -> Column:
    """The first ``depth`` of the bits in ``_h``."""
    return F.call_function("shiftright", F.col("_h"), (F.lit(BITS) - depth).cast("int"))


def _level(pending: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """(_cell, depth, prefix, bytes, rows) of the shallowest fitting bucket over each cell of ``depth`` bits."""
    cells = pending.groupBy(_prefix(F.lit(depth)).alias("_cell")).agg(
        F.sum("_bytes").alias("_b"), F.count("*").alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    path = cells.select("*", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth")).withColumn(
        "prefix", F.call_function("shiftright", F.col("_cell"), (F.lit(depth) - F.col("depth")).cast("int")))
    fits = (path.groupBy("depth", "prefix").agg(F.sum("_b").alias("bytes"), F.sum("_n").alias("rows"),
                                                F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
            .where((F.col("bytes") <= limit) | (F.col("_lo") == F.col("_hi"))).drop("_lo", "_hi"))
    bucket = F.min(F.struct("depth", "prefix", "bytes", "rows")).alias("_x")
    return path.select("_cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("_cell").agg(bucket) \
        .select("_cell", "_x.*")


def shard_rows(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, _bytes, shard, part, depth, shard_bytes, shard_rows) of every row."""
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("_id"), row_bits(id_col, text_col).alias("_h"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("_bytes")))
    total = rows.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("b")).first()["b"]
    above, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + 4)
    pending, placed = rows, None
    while True:
        cell = pending.withColumn("_cell", _prefix(F.lit(depth)))
        found = cut_lineage(_level(pending, above, depth, limit))
        here = cell.join(found, "_cell").drop("_cell")
        placed = here if placed is None else placed.unionByName(here)
        if depth == BITS:
            break
        pending = cut_lineage(cell.join(found, "_cell", "left_anti").drop("_cell"))
        if pending.isEmpty():
            break
        above, depth = depth + 1, min(BITS, depth + _STEP)
    over = (F.col("bytes") > limit) & (F.col("rows") > 1)  # equal rows only
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("_bytes", F.lit(1))))
    nth = F.row_number().over(Window.partitionBy("_h").orderBy("_id")) - 1
    equal = placed.where(over).withColumn("part", F.floor(nth / fit).cast("long"))
    first = F.least(fit, F.col("rows") - F.col("part") * fit)
    equal = equal.withColumns({"rows": first.cast("long"), "bytes": (first * F.col("_bytes")).cast("long")})
    every = placed.where(~over).withColumn("part", F.lit(0).cast("long")).unionByName(equal)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return every.select("_id", "_h", "_bytes", bits.alias("shard"), "part", F.col("depth").cast("long").alias("depth"),
                        F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))


def write_sharded(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                  text_col: str = "text") -> None:
    """Write ``docs`` as Parquet with one folder for each shard and part; a task writes whole shards."""
    h, parts = spare(docs, "_h", "_parts")
    where = shard_rows(docs, limit, id_col, text_col).groupBy(F.col("_h").alias(h)).agg(
        F.first("shard").alias("shard"), (F.max("part") + 1).alias(parts))
    keyed = docs.drop("shard", "part").withColumn(h, row_bits(id_col, text_col))
    nth = F.row_number().over(Window.partitionBy(h).orderBy(id_col)) - 1  # equal rows only share bits
    out = keyed.join(where, h).withColumns({"part": nth % F.col(parts), "shard": F.concat(F.lit("b"), "shard")})
    (out.drop(h, parts).repartition("shard", "part").write.partitionBy("shard", "part").mode("overwrite")
     .parquet(path))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every row of the documents table at one MiB a shard."""
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_bytes").alias("n_bytes"), "shard", "part", "depth",
                      "shard_bytes", "shard_rows")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15)
              AS BIGINT) AS h
  FROM documents),
nodes AS (
  SELECT l.depth, d.h >> ({BITS} - l.depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS n,
         min(h) = max(h) AS single
  FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range({BITS} + 1)) l GROUP BY 1, 2),
fits AS (
  SELECT d.doc_id, d.h, d.n_bytes, min(nodes.depth) AS depth
  FROM d JOIN nodes ON d.h >> ({BITS} - nodes.depth) = nodes.prefix
  WHERE bytes <= {LIMIT} OR single GROUP BY 1, 2, 3),
placed AS (
  SELECT f.*, CAST(nodes.bytes AS BIGINT) AS bytes, nodes.n,
         CASE WHEN f.depth = 0 THEN '' ELSE right(lpad(bin(nodes.prefix), 64, '0'), f.depth) END AS shard
  FROM fits f JOIN nodes ON nodes.depth = f.depth AND nodes.prefix = f.h >> ({BITS} - f.depth))
SELECT doc_id, n_bytes, shard, CAST(0 AS BIGINT) AS part, CAST(depth AS BIGINT) AS depth, bytes AS shard_bytes,
       n AS shard_rows
FROM placed
"""

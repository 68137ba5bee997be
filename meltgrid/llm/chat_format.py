"""Preference formatting: the shared turns of a chosen and a rejected conversation are rendered once as the prompt,
the rest as two completions whose trained characters are marked.

A conversation's turns stand in the order of (turn, role, text).  The prompt is the longest common prefix of turns
with equal roles and texts.  A turn is rendered as ``<|role|>``, a line break, its text, ``<|end|>``, a line break.
In a completion only what assistant turns say, end mark included, is trained: spans [start, end) in characters.

Defined results: a null role or text counts as empty; a null id is one conversation of its own; a pair whose sides
are equal has empty completions; one that shares nothing has an empty prompt; a side that is missing has no turns;
repeated rows are repeated turns; other columns are not read; empty tables give no rows.  A pair is one row of the
result, so its turns meet in one task; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm.common import NO_ID, id_or_least, null_again, table

HEAD, TAIL = "<|{}|>\n", "<|end|>\n"
TRAINED = "assistant"


def _turns(rows: DataFrame, id_col: str) -> DataFrame:
    """(_id, turn, role, text) with empty for null."""
    return rows.select(id_or_least(id_col).alias("_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("<|"), t.role, F.lit("|>\n"), t.text, F.lit(TAIL))), "")


def trained_spans(turns: Column) -> Column:
    """[start, end) of the trained characters of rendered turns."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def add(state, t):
        start = state.at + F.length(t.role) + len(HEAD.format(""))
        end = start + F.length(t.text) + len(TAIL.rstrip("\n"))
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"),
                        F.when(t.role == TRAINED, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))
    return F.aggregate(turns, zero, add, lambda s: s.spans)


def format_preferences(chosen: DataFrame, rejected: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans); sides have id, turn, role, text."""
    side = lambda df, good: _turns(df, id_col).withColumn("_good", F.lit(good))
    list_of = lambda good: F.array_sort(F.collect_list(F.when(
        F.col("_good") == good, F.struct("turn", "role", "text"))))
    pairs = side(chosen, True).unionByName(side(rejected, False)).groupBy("_id").agg(
        list_of(True).alias("c"), list_of(False).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False)))
    pairs = pairs.withColumn("_same", same).withColumn(
        "n_common", F.when(F.array_contains("_same", False), F.array_position("_same", False) - 1)
        .otherwise(F.size("_same")).cast("long"))
    rest = lambda c: F.slice(c, (F.col("n_common") + 1).cast("int"), F.greatest(F.size(c), F.lit(1)))
    return pairs.select(
        null_again("_id").alias(id_col), "n_common",
        render(F.slice("c", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
        render(rest("c")).alias("chosen"), render(rest("r")).alias("rejected"),
        trained_spans(rest("c")).alias("chosen_spans"), trained_spans(rest("r")).alias("rejected_spans"))


def swapped_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs made of a plain conversation table: each conversation is chosen as it stands, and rejected with its last
    assistant turn replaced by that of its neighbour (ids 2k and 2k + 1), or by nothing if there is none; the one
    without an id has no neighbour."""
    rows = conversations.select(id_or_least("conv_id").alias("_pair"), F.col("turn").cast("long").alias("turn"), "role", "text")
    answers = rows.where(F.col("role") == TRAINED).groupBy("_pair").agg(F.max(F.struct("turn", "text")).alias("_a"))
    other = answers.where(F.col("_pair") != NO_ID).select(
        F.col("_pair").bitwiseXOR(F.lit(1).cast("long")).alias("_pair"), F.col("_a.text").alias("_new"))
    rejected = (rows.join(answers.select("_pair", F.col("_a.turn").alias("_at")), "_pair", "left")
                .join(other.where(F.col("_pair") != NO_ID), "_pair", "left")
                .select("_pair", "turn", "role", F.when((F.col("role") == TRAINED) & F.col("turn").eqNullSafe(F.col("_at")),
                                                        F.coalesce("_new", F.lit(""))).otherwise(F.col("text")).alias("text")))
    return tuple(side.withColumn("pair_id", null_again("_pair")).drop("_pair") for side in (rows, rejected))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table against its rejected form; spans as text."""
    chosen, rejected = swapped_answers(table(spark, sf_dir, "conversations"))
    out = format_preferences(chosen, rejected)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))), ",")
    return out.select("pair_id", "n_common", "prompt", "chosen", "rejected", text("chosen_spans").alias("chosen_spans"),
                      text("rejected_spans").alias("rejected_spans"))


ORACLE_SQL = """
WITH c AS (
  SELECT coalesce(conv_id, -9223372036854775808) AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
last AS (
  SELECT pair_id, max(turn) AS at, arg_max(text, struct_pack(t := turn, x := text)) AS answer
  FROM c WHERE role = 'assistant' GROUP BY 1),
r AS (
  SELECT c.pair_id, c.pos, c.turn, c.role,
         CASE WHEN c.role = 'assistant' AND c.turn = last.at THEN coalesce(o.answer, '') ELSE c.text END AS text
  FROM c LEFT JOIN last USING (pair_id)
  LEFT JOIN last o ON o.pair_id = xor(c.pair_id, 1) AND -9223372036854775808 NOT IN (o.pair_id, c.pair_id)),
common AS (
  SELECT c.pair_id, coalesce(min(CASE WHEN c.text <> r.text THEN c.pos END) - 1, max(c.pos)) AS n_common
  FROM c JOIN r ON c.pair_id = r.pair_id AND c.pos = r.pos GROUP BY 1),
sides AS (SELECT 'c' AS side, pair_id, pos, role, text FROM c UNION ALL SELECT 'r', pair_id, pos, role, text FROM r),
shown AS (
  SELECT s.*, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
  FROM sides s JOIN common USING (pair_id)),
placed AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY side, pair_id, pos > n_common ORDER BY pos) AS stop FROM shown),
parts AS (
  SELECT side, pair_id, any_value(n_common) AS n_common,
         coalesce(string_agg(line, '' ORDER BY pos) FILTER (pos <= n_common), '') AS head,
         coalesce(string_agg(line, '' ORDER BY pos) FILTER (pos > n_common), '') AS tail,
         coalesce(string_agg(CAST(stop - length(text) - 8 AS BIGINT) || '-' || CAST(stop - 1 AS BIGINT), ',' ORDER BY pos)
                  FILTER (pos > n_common AND role = 'assistant'), '') AS spans
  FROM placed GROUP BY 1, 2)
SELECT nullif(a.pair_id, -9223372036854775808) AS pair_id, CAST(a.n_common AS BIGINT) AS n_common, a.head AS prompt, a.tail AS chosen, b.tail AS rejected,
       a.spans AS chosen_spans, b.spans AS rejected_spans
FROM parts a JOIN parts b ON a.pair_id = b.pair_id AND a.side = 'c' AND b.side = 'r'
"""

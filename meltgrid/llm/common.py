"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
#: A word in the SQL that checks queries.
WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def shingle_sql(source: str, id_col: str, text: str, n: int) -> str:
    """SELECT of the distinct n-word shingles ``s`` of each row; fewer words make one shingle."""
    return f"""SELECT DISTINCT {id_col}, array_to_string(w[i:i + {n - 1}], ' ') AS s FROM (
  SELECT {id_col}, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM (
    SELECT {id_col}, regexp_extract_all({text}, {WORD_SQL}) AS w FROM {source}) WHERE len(w) > 0)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_least(col: str) -> Column:
    """A null id stands before every other id."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def null_again(col: str) -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended until no column of ``df`` has them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _tv, _text): the id, a hash of the text that tells rows of one id apart, and the text."""
    return docs.select(id_or_least(id_col).alias("_doc"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_tv"),
                       F.col(text_col).cast("string").alias("_text"))

"""Query registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.fixtures import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None, tables: tuple[str, ...] = (), ctes: str = ""):
    """Register a query under ``name``.  ``covers`` lists the inventory ids it exercises;
    ``tables`` are the derived tables the SQL needs; ``ctes`` are further named queries."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        COVERS[name] = covers
        if sql is not None:
            head = with_tables(*tables) if tables else ""
            extra = ctes.strip().rstrip(",")
            if extra:
                head = f"{head},\n{extra}" if head else f"WITH {extra}"
            SQL[name] = f"{head}\n{sql.strip()}"
        return fn
    return wrap


def rnd(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    return df.select(*[
        F.round(c, digits).alias(c) if t in ("double", "float") and c not in keep else F.col(c)
        for c, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """The same in SQL; adding zero turns a negative zero into zero."""
    return f"(round({expr}, {digits}) + 0e0)"


def sel(*names: str, digits: int = 6) -> str:
    """``round(a) AS a, ...`` for plain columns."""
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)

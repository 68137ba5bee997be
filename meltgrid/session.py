"""Session helpers: sized broadcasts and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
_SCOPES: list[str] = []


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("meltgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder the session names; a local run may make its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="meltgrid-ckpt-")
    sc.setCheckpointDir(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder beside the session's checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    place = "/".join([spark.sparkContext.getCheckpointDir(), *_SCOPES])
    return f"{place}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Tables that lineage cuts write inside the scope are removed when it ends.

    Write or collect results before that: frames made inside read these tables.
    """
    from pyarrow.fs import FileSystem, FileType

    folder = scratch_path(spark, "scope")
    _SCOPES.append(folder.rsplit("/", 1)[1])
    try:
        yield folder
    finally:
        _SCOPES.pop()
        fs, path = FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        if fs.get_file_info(path).type == FileType.Directory:
            fs.delete_dir(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared scratch folder and read them from there.

    The rows outlive the executors that made them; later stages get column pruning, pushed
    filters and true sizes, and the optimizer no longer carries the expressions behind them.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written as a table; the tables that lineage cuts wrote on the way are removed."""
    path = scratch_path(spark, "table")
    with scratch_scope(spark):
        out = make()
        out.write.parquet(path)
        schema = out.schema
    return spark.read.schema(schema).parquet(path)


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Side of a join that is usually small.

    At most ``max_rows`` + 1 rows are fetched.  When all rows fit they come back as a local
    relation with a broadcast hint, so the size is proven before the hint is given; otherwise
    the frame is returned unhinted and Spark joins by shuffle with its skew handling.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(_local(df.sparkSession, rows, df.schema))


def spread(df: DataFrame, rows: int | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Side of a join with a row for each row of the input or so: joined by shuffle, whatever its files take.

    Spark judges a stored table by its compressed files and collects a small one in the driver, where its rows can take
    many times as much; several such sides stand in one plan.  Where ``rows`` are known to be no more than ``max_rows``,
    Spark may choose.
    """
    return df if rows is not None and rows <= max_rows else df.hint("merge")


#: Types that Arrow carries as they are.
PLAIN = (T.BooleanType, T.IntegerType, T.LongType, T.DoubleType, T.StringType)


def _local(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """Rows as a local relation; plain columns go as Arrow, which takes no Python worker to read them back."""
    if not rows or not all(isinstance(f.dataType, PLAIN) for f in schema.fields):
        return spark.createDataFrame(rows, schema)
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    columns = [pa.array(values, kind.type) for values, kind in zip(zip(*rows), kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kinds.names), schema)

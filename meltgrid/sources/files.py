"""Point files, result tables, text exports and run folders."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.functions.nulls import NODATA, finite
from meltgrid.session import ensure_checkpoint_dir


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or nothing where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def scan_points(spark: SparkSession, path: str, schema: str, sep: str = " ", xy_unit: str = "m",
                header: bool = False, source: str | None = None) -> DataFrame:
    """Text points with named columns; kilometre coordinates become metres.

    The schema is given, so the file is read once and nothing is inferred.
    """
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, ignoreLeadingWhiteSpace=True,
                        ignoreTrailingWhiteSpace=True)
    factor = {"m": 1.0, "km": 1000.0}[xy_unit]
    if factor != 1.0:
        df = df.withColumns({c: F.col(c) * factor for c in ("x", "y") if c in df.columns})
    return df.withColumn("source", F.lit(source)) if source else df


def write_results(df: DataFrame, base: str, kind: str, run_id: str, fmt: str = "parquet") -> str:
    """Write one run to the result table of its kind.  Runs are partitions; a run that is written
    again replaces itself and leaves the others."""
    path = f"{base}/{kind}"
    writer = (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("run_id"))
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_xyz(df: DataFrame, path: str, cols: Sequence[str] = ("x_m", "y_m", "z"),
              fmt: str = "%.3f %.3f %.5e") -> None:
    """Plain text with one finite ``x y z`` row per line, six significant digits."""
    keep = df
    for c in cols:
        keep = keep.filter(finite(F.col(c)))
    keep.select(F.format_string(fmt, *cols).alias("value")).write.mode("overwrite").text(path)


def nodata_view(df: DataFrame, cols: Sequence[str], nodata: float = NODATA) -> DataFrame:
    """Export form of a layer: every non-finite value carries the nodata number."""
    return df.withColumns({c: F.when(finite(F.col(c)), F.col(c)).otherwise(F.lit(nodata)) for c in cols})


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File listing as rows; contents are never read because the column is pruned."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length"))


THRESHOLD_PATTERN = r"spec_([0-9]*\.?[0-9]+)"


def latest_runs(listing: DataFrame, path: str = "path", mtime: str = "modificationTime") -> DataFrame:
    """Newest artifact per threshold folder ``spec_<t>``."""
    found = F.regexp_extract(F.col(path), THRESHOLD_PATTERN, 1)
    tagged = listing.withColumn("threshold", F.when(found != "", found.cast("double")))
    return (tagged.filter(F.col("threshold").isNotNull()).groupBy("threshold")
            .agg(F.max_by(path, F.struct(mtime, path)).alias("path"), F.count(F.lit(1)).alias("n_files"))
            .orderBy("threshold"))


def threshold_dir(base: str, threshold: float) -> str:
    return f"{base}/spec_{threshold:.2f}"


def input_fingerprint(df: DataFrame) -> list[str]:
    """What a plan reads: path, length and time of each file; of scratch tables, whose names and times are new in every
    run, the rows themselves (count, sum and exclusive or of row hashes, whatever their order)."""
    spark, files = df.sparkSession, df.inputFiles()
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().split(":", 1)[-1].rstrip("/")
    scratch = [f for f in files if f"{root}/" in f]
    out, given = [], sorted(set(files) - set(scratch))
    if given:
        seen = spark.read.format("binaryFile").load(given).select("path", "length", "modificationTime")
        out += [f"{r['path']}|{r['length']}|{r['modificationTime']}" for r in seen.collect()]
    for folder in sorted({f.rsplit("/", 1)[0] for f in scratch}):
        rows = spark.read.parquet(folder)
        h = F.xxhash64(*rows.columns)
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
        out.append(f"{rows.dtypes}|{r['n']}|{r['s']}|{r['x']}")
    return sorted(out)


def cache_gdiff(df: DataFrame, path: str, config: Mapping[str, object] | None = None, model: str = "model") -> DataFrame:
    """Per-model heat-flow margins, written once and reused while nothing they depend on has changed.

    The key is a digest of ``config``, the columns and ``input_fingerprint``, so a file that is rewritten in place
    misses and a plan built again on scratch tables with the same rows hits.  A table is written under a name of its
    own and then published by one manifest row; readers take the earliest row of a key, so of two writers one serves
    everybody and an unfinished table serves nobody.
    """
    spark = df.sparkSession
    what = json.dumps([dict(config or {}), df.dtypes, input_fingerprint(df)], sort_keys=True, default=str)
    key = hashlib.md5(what.encode()).hexdigest()

    def published() -> str | None:
        rows = table_or_none(spark, f"{path}/manifest/{key}-*")
        return None if rows is None else rows.agg(F.min(F.struct("at", "place")).alias("m")).first()["m"]["place"]

    place = published()
    if place is None:
        name = uuid.uuid4().hex[:12]
        df.write.partitionBy(model).parquet(f"{path}/tables/{key}-{name}")
        row = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(f"{path}/tables/{key}-{name}").alias("place"))
        row.write.parquet(f"{path}/manifest/{key}-{name}")
        place = published()
    return spark.read.parquet(place)


# Layers stored for joins --------------------------------------------------------------------------

def _layer_name(path: str) -> str:
    return f"meltgrid_layer_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def store_layer(df: DataFrame, path: str, keys: Sequence[str] = ("ri", "ci"), buckets: int = 64) -> DataFrame:
    """Write a layer bucketed and sorted by its cell, one file for each bucket, and return it.

    Layers stored with the same keys and number of buckets are joined on these keys without moving a row.  The layout
    is written last, beside the layer, so ``stored_layer`` finds finished layers only.
    """
    name = _layer_name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite")
     .format("parquet").saveAsTable(name))
    layout = [(df.schema.toDDL(), ", ".join(keys), buckets)]
    df.sparkSession.createDataFrame(layout, "fields string, keys string, buckets int").coalesce(1).write.mode("overwrite").parquet(
        f"{path}-layout")
    return stored_layer(df.sparkSession, path)


def stored_layer(spark: SparkSession, path: str) -> DataFrame:
    """A layer that ``store_layer`` has written, in this session or another."""
    layout = spark.read.parquet(f"{path}-layout").first()
    name, place = _layer_name(path), path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({layout['fields']}) USING parquet CLUSTERED BY ({layout['keys']}) "
              f"SORTED BY ({layout['keys']}) INTO {layout['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(name)

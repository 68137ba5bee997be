"""Model dimension: flat family, name resolution, centres, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meltgrid.functions.names import FLAT_PREFIX, flat_value, is_flat, name_key, valid_name
from meltgrid.operators.ordered import midpoint_quantile
from meltgrid.session import sized


def flat_names(lo: int, hi: int, step: int = 1) -> list[float]:
    return [float(v) for v in range(lo, hi + 1, step)]


def flat_models(spark: SparkSession, lo: int = 20, hi: int = 80, step: int = 1, first_ord: int = 0) -> DataFrame:
    """Dimension rows of the constant-field family."""
    v = (F.lit(lo) + F.lit(step) * F.col("id")).cast("double")
    name = F.concat(F.lit(FLAT_PREFIX), v.cast("int").cast("string"))
    return spark.range(len(flat_names(lo, hi, step))).select(
        name.alias("model"), name.alias("title"), F.lit(True).alias("is_flat"),
        v.alias("flat_value"), (F.col("id") + first_ord).cast("int").alias("ord"))


def with_flat_fields(cells: DataFrame, lo: int = 20, hi: int = 80, step: int = 1) -> DataFrame:
    """Cells repeated per flat model, with its constant value and zero sigma.

    Meant for small families; hard metrics of a whole family come from ``flat_confusion``, which
    reads each cell once.
    """
    v = F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step)))
    return (cells.withColumn("_v", v)
            .withColumns({"model": F.concat(F.lit(FLAT_PREFIX), F.col("_v").cast("string")),
                          "g": F.col("_v").cast("double"), "sigma": F.lit(0.0)}).drop("_v"))


def resolve_models(wanted: DataFrame, available: DataFrame, fallback: str | None = None) -> DataFrame:
    """Match requested names to stored ones: identifier form, then the same ignoring case, then
    the trimmed raw name ignoring case.  The best match wins, earlier stored models first.

    ``wanted(name)``, ``available(model, ord)``; result ``(name, model, match)``.
    """
    def keys(name: Column) -> Column:
        vn = valid_name(name)
        forms = (("exact", vn), ("nocase", F.lower(vn)), ("raw", name_key(name)))
        return F.explode(F.array(*[
            F.struct(F.lit(i).alias("rank"), F.lit(m).alias("match"), k.alias("key"))
            for i, (m, k) in enumerate(forms)]))

    left = wanted.select("name", keys(F.col("name")).alias("k")).select("name", "k.*")
    right = available.select("model", "ord", keys(F.col("model")).alias("k")).select(
        "model", "ord", F.col("k.rank").alias("rank"), F.col("k.key").alias("key"))
    best = F.min(F.struct("rank", "ord", "model", "match"))
    hit = left.join(right, ["rank", "key"]).groupBy("name").agg(best.alias("b"))
    out = wanted.select("name").join(hit, "name", "left")
    return out.select(
        "name", F.coalesce("b.model", F.lit(fallback)).alias("model"),
        F.coalesce("b.match", F.lit("fallback" if fallback else "missing")).alias("match"))


def exclude(df: DataFrame, names: Sequence[str], col: str = "model") -> DataFrame:
    """Drop listed names, ignoring case and surrounding blanks."""
    return df.filter(~name_key(F.col(col)).isin([n.strip().lower() for n in names])) if names else df


def exclude_table(df: DataFrame, listed: DataFrame, col: str = "model") -> DataFrame:
    """The same with the list in a table."""
    keys = listed.select(name_key(F.col(col)).alias("_k")).distinct()
    return df.withColumn("_k", name_key(F.col(col))).join(keys, "_k", "left_anti").drop("_k")


def model_center(df: DataFrame, value: str = "g", store: bool = True) -> DataFrame:
    """Median over the given cells; a flat model's name carries its value.  The rows are read for the medians and for
    the flats, so what makes them should be written before; ``store=False`` is right for such a table."""
    med = midpoint_quantile(df.filter(~is_flat(F.col("model"))), value, {"center": 0.5}, ["model"], store=store)
    flats = df.filter(is_flat(F.col("model"))).groupBy("model").agg(F.count(value).alias("n"))
    flats = flats.withColumn("center", flat_value(F.col("model")))
    return med.unionByName(flats).select("model", "n", "center")


def metric_vs_center(gstats: DataFrame, centers: DataFrame, metric: str, excluded: Sequence[str] = ()) -> DataFrame:
    """One metric with its bands against the model centre, ordered by centre."""
    rows = exclude(gstats.filter(F.col("metric") == metric), excluded)
    out = rows.join(centers.select("model", "center"), "model")
    good = F.col("center").isNotNull() & F.col("exp").isNotNull()
    return (out.withColumns({"is_flat": is_flat(F.col("model")), "good": good})
            .select("model", "center", "exp", "lo95", "hi95", "lo50", "hi50", "is_flat", "good")
            .orderBy("center", "model"))


def moving_median(df: DataFrame, order: str, col: str, width: int | None = None, name: str = "smooth") -> DataFrame:
    """Centred moving median with shrinking ends over a report table (one row per model).

    The default width grows gently with the number of rows; fewer than five stay as they are.
    An even width reaches one further back than forward.
    """
    if width is None:
        n = df.count()
        width = 1 if n < 5 else max(3, (2 * n + 8) // 16)
    back, ahead = (width // 2, (width - 1) // 2)
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(-back, ahead)
    near = F.array_sort(F.collect_list(F.when(~F.isnan(F.col(col)), F.col(col))).over(w))
    out = df.withColumn("_a", near).withColumn("_n", F.size("_a"))
    low, high = F.floor((F.col("_n") + 1) / 2).cast("int"), F.ceil((F.col("_n") + 1) / 2).cast("int")
    mid = (F.element_at("_a", low) + F.element_at("_a", high)) / 2.0
    return out.withColumn(name, F.when(F.col("_n") > 0, mid)).drop("_a", "_n")


def rank_compare(a: DataFrame, b: DataFrame, score: str = "g_prod") -> DataFrame:
    """Change of score and rank between two per-model tables (rank 1 is best)."""
    def ranked(df: DataFrame, tag: str) -> DataFrame:
        w = Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), "model")
        return df.select("model", F.col(score).alias(f"g_{tag}"), F.row_number().over(w).alias(f"rank_{tag}"))

    out = ranked(a, "binary").join(ranked(b, "weighted"), "model")
    return out.withColumns({"d_g": F.col("g_weighted") - F.col("g_binary"),
                            "d_rank": F.col("rank_weighted") - F.col("rank_binary")})


def metric_by_threshold(runs: DataFrame, metric: str) -> DataFrame:
    """One metric across threshold runs without the flat family, sorted for reading."""
    return (runs.filter((F.col("metric") == metric) & ~is_flat(F.col("model")))
            .select("threshold", "model", "exp", "lo95", "hi95", "lo50", "hi50")
            .orderBy("threshold", "model"))


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stable_unique(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key.  ``min`` over a struct combines on the map side, so a key that repeats
    very often never gathers its rows."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_f")
    return df.groupBy(*keys).agg(first).select(*keys, "_f.*").select(*df.columns)


def closest(df: DataFrame, col: str, value: float, by: Sequence[str] = ()) -> DataFrame:
    """The row of each group whose ``col`` lies nearest to a reference value (the smaller one on a
    tie)."""
    pick = F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(col) - value), F.col(col)))
    return df.groupBy(*by).agg(pick.alias("r")).select("r.*")


def last_meeting(df: DataFrame, value: str, target: float, at: str, by: Sequence[str]) -> DataFrame:
    """Largest ``at`` where ``value`` still reaches the target; NULL where it never does."""
    return df.groupBy(*by).agg(F.max(F.when(F.col(value) >= target, F.col(at))).alias("limit"))


def sorted_report(df: DataFrame, *cols: str) -> DataFrame:
    return df.orderBy(*cols)

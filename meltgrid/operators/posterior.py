"""Chain tables of a sampler run elsewhere: kept draws, intervals, best region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltgrid.functions.nulls import finite
from meltgrid.operators.fields import log_prior
from meltgrid.operators.ordered import GROUP_ROWS, _keyed, largest_group, midpoint_quantile, prefix_sums
from meltgrid.session import cut_lineage, sized

PARAMS = ("mu", "a", "theta_deg")
RANK_BLOCK = 64
#: Ranges that a long chain is cut into.
RANGES = 1024


def chain_table(chain: DataFrame, beta: float = 6.0) -> DataFrame:
    """Full chain with the prior and the posterior of each draw."""
    out = log_prior(chain, "softbox", theta="theta_deg")
    return out.withColumn("posterior", beta * F.least(F.greatest("gmean", F.lit(0.0)), F.lit(1.0)) + F.col("log_prior"))


def keep_draws(chain: DataFrame, burn: float = 0.25, thin: int = 1, order: str = "iter") -> DataFrame:
    """Drop the first share of the draws and keep every ``thin``-th of the rest.

    ``order`` numbers the draws without gaps from any start.
    """
    e = chain.agg(F.min(order).alias("lo"), F.count(F.lit(1)).alias("n")).first()
    first = e["lo"] + max(0, int(burn * e["n"] + 0.5))
    return chain.filter((F.col(order) >= first) & ((F.col(order) - first) % thin == 0))


def _best_key(order: str) -> Column:
    return F.struct(F.col("gmean"), -F.col(order))


def best_draw(chain: DataFrame, order: str = "iter") -> DataFrame:
    """The draw with the highest score, the first one on a tie."""
    return chain.agg(F.max_by(F.struct(*chain.columns), _best_key(order)).alias("b")).select("b.*")


def chain_summary(chain: DataFrame, order: str = "iter") -> DataFrame:
    """Acceptance rate, number of draws and the best draw."""
    out = chain.agg(F.avg(F.col("accepted").cast("double")).alias("acceptance"), F.count(F.lit(1)).alias("n"),
                    F.max_by(F.struct(order, *PARAMS, "gmean"), _best_key(order)).alias("b"))
    return out.select("acceptance", "n", "b.*")


def running_best(chain: DataFrame, order: str = "iter", col: str = "gmean", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Best score so far.  Long chains are cut into ranges of ``order``; each range adds the best
    of the ranges before it."""
    if largest_group(chain, []) <= group_rows:
        w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return chain.withColumn("best", F.max(col).over(w))
    e = chain.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = (e["hi"] - e["lo"]) // RANGES + 1
    df = chain.withColumn("_r", F.floor((F.col(order) - e["lo"]) / width))
    before = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy("_r").agg(F.max(col).alias("_t")).select("_r", F.max("_t").over(before).alias("_before"))
    w = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("best", F.max(col).over(w)).join(sized(cut_lineage(tops)), "_r")
    return out.withColumn("best", F.greatest("best", "_before")).drop("_r", "_before")


def with_distance(chain: DataFrame, best: dict[str, float] | None = None, params: Sequence[str] = PARAMS,
                  order: str = "iter") -> DataFrame:
    """Distance of each draw to the best one, each parameter in units of its own spread."""
    if best is None:
        best = best_draw(chain, order).first().asDict()
    spread = chain.agg(*[F.stddev_samp(p).alias(p) for p in params]).first()
    parts = [F.pow((F.col(p) - best[p]) / spread[p], F.lit(2.0)) for p in params if spread[p]]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return chain.withColumn("dist", F.sqrt(total))


def nearest_draws(chain: DataFrame, k: int = 500, best: dict[str, float] | None = None, order: str = "iter") -> DataFrame:
    """The ``k`` draws nearest to the best one; only ``k`` rows per task are ever compared."""
    return with_distance(chain, best, order=order).orderBy("dist", order).limit(k)


def top_fraction(chain: DataFrame, frac: float = 0.05, best: dict[str, float] | None = None, order: str = "iter") -> DataFrame:
    """Draws scoring in the top fraction, together with the draw nearest to the best one."""
    cut = midpoint_quantile(chain, "gmean", {"c": 1.0 - frac}).first()["c"]
    df = with_distance(chain, best, order=order)
    near = df.agg(F.min_by(order, F.struct("dist", order)).alias("i")).first()["i"]
    return df.filter((F.col("gmean") >= cut) | (F.col(order) == near))


def mcse(chain: DataFrame, col: str, order: str = "iter", by: Sequence[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Batch-means standard error and effective sample size of ``col``."""
    keyed, keys = _keyed(chain.filter(finite(F.col(col))), by)
    src = keyed.select(*keys, order, F.col(col).alias("_x"), F.lit(1).alias("one"))
    pos = prefix_sums(src, keys, order, ["one"], group_rows)
    n = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    batches = F.greatest(F.lit(10), F.floor(F.sqrt("_n")))
    df = pos.join(sized(cut_lineage(n)), keys).withColumn("_k", batches).withColumn("_b", F.floor(F.col("_n") / F.col("_k")))
    df = df.filter((F.col("_b") >= 2) & (F.col("cum_one") <= F.col("_b") * F.col("_k")))
    df = df.withColumn("_batch", F.floor((F.col("cum_one") - 1) / F.col("_b")))
    # Sums of one batch are enough for both the batch mean and the overall variance.
    part = df.groupBy(*keys, "_batch").agg(
        F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_c"), F.var_pop("_x").alias("_v"), F.max("_k").alias("_k"))
    out = part.groupBy(*keys).agg(
        F.stddev_pop("_m").alias("_sd"), F.max("_k").alias("_k"), F.avg("_v").alias("_within"), F.var_pop("_m").alias("_between"))
    out = out.withColumn("mcse", F.col("_sd") / F.sqrt("_k"))
    ess = (F.col("_within") + F.col("_between")) / F.nullif(F.col("mcse") * F.col("mcse"), F.lit(0.0))
    return out.select(*by, "mcse", ess.alias("ess"))


def hpd(chain: DataFrame, col: str, alpha: float = 0.05, by: Sequence[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Shortest interval holding ``1 - alpha`` of the draws.

    Works on distinct values with their rank ranges; start and end meet through blocks of
    ``RANK_BLOCK`` ranks, so the pairs grow with the draws and the sorted draws are never gathered.
    A long run of ties is looked up by its whole blocks, one row for each, like any other value.
    """
    keyed, keys = _keyed(chain.filter(finite(F.col(col))), by)
    counts = keyed.groupBy(*keys, F.col(col).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    runs = prefix_sums(counts, keys, "_x", ["n"], group_rows).join(sized(cut_lineage(total)), keys)
    runs = runs.withColumns({"_m": F.floor(F.col("_n") * (1.0 - alpha)), "_first": F.col("cum_n") - F.col("n") + 1,
                             "_size": F.lit(RANK_BLOCK)}).filter("_m >= 1")
    starts = runs.withColumn("_want", F.col("_first") + F.col("_m")).filter(F.col("_want") <= F.col("_n"))
    starts = starts.select(*keys, F.col("_x").alias("lo"), "_want", F.floor(F.col("_want") / F.col("_size")).alias("_blk"))
    blocks = F.explode(F.sequence(F.floor(F.col("_first") / F.col("_size")), F.floor(F.col("cum_n") / F.col("_size"))))
    ends = runs.select(*keys, F.col("_x").alias("hi"), "_first", "cum_n", blocks.alias("_blk"))
    spans = starts.join(ends, [*keys, "_blk"]).filter(F.col("_want").between(F.col("_first"), F.col("cum_n")))
    best = F.min_by(F.struct("lo", "hi"), F.struct((F.col("hi") - F.col("lo")), F.col("lo")))
    return spans.groupBy(*keys).agg(best.alias("b")).select(*by, "b.lo", "b.hi")


REGION_LEVELS = {"median": 0.5, "lo50": 0.25, "hi50": 0.75, "lo95": 0.025, "hi95": 0.975}


def best_region(chain: DataFrame, mode: str = "topfrac", frac: float = 0.05, k: int = 500,
                cols: Sequence[str] = ("gmean", *PARAMS), order: str = "iter") -> DataFrame:
    """One row per quantity: median, 50 % and 95 % bands, density interval, error, sample size."""
    region = {"topfrac": lambda: top_fraction(chain, frac, order=order),
              "knn": lambda: nearest_draws(chain, k, order=order)}[mode]()
    region = cut_lineage(region.select(order, *cols))
    pairs = ", ".join(f"'{c}', {c}" for c in cols)
    long = region.selectExpr(order, f"stack({len(cols)}, {pairs}) AS (param, x)")
    out = midpoint_quantile(long, "x", REGION_LEVELS, ["param"])
    inner = hpd(long, "x", 0.05, ["param"]).withColumnsRenamed({"lo": "hpd_lo", "hi": "hpd_hi"})
    return out.join(inner, "param", "left").join(mcse(long, "x", order, ["param"]), "param", "left")

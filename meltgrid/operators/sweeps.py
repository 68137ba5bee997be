"""Whole threshold and model families from one pass over the cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltgrid.functions.names import FLAT_PREFIX
from meltgrid.functions.nulls import finite
from meltgrid.operators.metrics import detector_metrics, with_scores
from meltgrid.operators.ordered import _keyed, constants, midpoint_quantile, prefix_sums, value_counts
from meltgrid.session import sized


def flat_confusion(cells: DataFrame, label: str, lo: int = 20, hi: int = 80, margin: float = 0.0,
                   adv: str | None = None, delta: str | None = None, by: Sequence[str] = (),
                   soft: bool = False) -> DataFrame:
    """Confusion of every flat model ``lo..hi`` without repeating the cells.

    A constant field ``v`` predicts wet exactly where ``v`` reaches a cell threshold, so cells
    are counted by the first flat value that does and the counts are accumulated over values.
    Cells without a melt minimum stay dry in every model.
    """
    need = F.col("gmin") + margin
    if adv:
        need = need - F.col(adv)
    if delta:
        need = need / (1.0 + F.col(delta))
    n_flat = hi - lo + 1
    first = F.least(F.greatest(F.ceil(need - lo), F.lit(0)), F.lit(n_flat)).cast("int")
    slot = F.when(finite(need), first).otherwise(F.lit(n_flat))
    keyed, keys = _keyed(cells, by)
    y = F.col(label)
    wet, dry = ((F.sum(y), F.sum(1.0 - y)) if soft else (F.count_if(y == 1), F.count_if(y != 1)))
    tab = keyed.groupBy(*keys, slot.alias("_slot")).agg(wet.alias("_wet"), dry.alias("_dry"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_flat))).alias("_slot")
    frame = tab.select(*keys).distinct().select(*keys, every)
    full = frame.join(tab, [*keys, "_slot"], "left").fillna(0, ["_wet", "_dry"])
    w = Window.partitionBy(*keys)
    run = w.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    out = full.withColumns({"tp": F.sum("_wet").over(run), "fp": F.sum("_dry").over(run),
                            "_tw": F.sum("_wet").over(w), "_td": F.sum("_dry").over(w)})
    out = out.filter(F.col("_slot") < n_flat).select(
        *by, F.concat(F.lit(FLAT_PREFIX), (F.col("_slot") + lo).cast("string")).alias("model"),
        "tp", "fp", (F.col("_td") - F.col("fp")).alias("tn"), (F.col("_tw") - F.col("tp")).alias("fn"))
    return with_scores(out)


def _passed(col: str, op: str, ts: Sequence[float]) -> Column:
    """How many of the sorted thresholds a value passes; none when it is missing."""
    return F.expr("coalesce(" + " + ".join(f"cast(`{col}` {op} {t!r}D AS int)" for t in ts) + ", 0)")


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("model",),
                    pred: str = "pred", q: str = "q") -> DataFrame:
    """Hard confusion for every truth threshold ``q > t`` in one pass.

    Each row is counted under the number of thresholds its observation exceeds; running totals
    over that number give all thresholds.  The prediction does not depend on the threshold, so
    nothing else is recomputed.
    """
    ts = sorted(float(t) for t in thresholds)
    above = _passed(q, ">", ts)
    p = F.col(pred)
    tab = df.groupBy(*by, above.alias("_k")).agg(
        F.count_if(p).alias("_p"), F.count_if(~p).alias("_np"))
    # Row k of the count table is wet for the first k thresholds.
    hit = F.explode(constants([{"i": i, "threshold": t} for i, t in enumerate(ts)]))
    spread = tab.select(*by, "_k", "_p", "_np", hit.alias("s"))
    wet = F.col("_k") > F.col("s.i")

    def total(c: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(c)).otherwise(0))

    out = spread.groupBy(*by, F.col("s.threshold").alias("threshold")).agg(
        total("_p", wet).alias("tp"), total("_p", ~wet).alias("fp"),
        total("_np", ~wet).alias("tn"), total("_np", wet).alias("fn"))
    return with_scores(out)


def detector_thresholds(df: DataFrame, q: str = "q", n: int = 80, lo: float = 0.01, hi: float = 0.99,
                        min_share: float = 0.005) -> list[float]:
    """Distinct quantile-spaced thresholds whose wet share keeps clear of 0 and 1."""
    step = (hi - lo) / (n - 1)
    ps = {f"p{i}": lo + i * step for i in range(n)}
    row = midpoint_quantile(df, q, ps).first()
    cuts = sorted({row[k] for k in ps})
    reached = _passed(q, ">=", cuts)
    tab = df.filter(finite(F.col(q))).groupBy(reached.alias("k")).count().collect()
    total = sum(r["count"] for r in tab)
    share = [sum(r["count"] for r in tab if r["k"] > i) / total for i in range(len(cuts))]
    return [c for c, s in zip(cuts, share) if min_share <= s <= 1 - min_share]


def detector_sweep(df: DataFrame, q: str, mask: str, thresholds: Sequence[float]) -> DataFrame:
    """Detector ``q >= t`` against a mask, for all thresholds from one count table."""
    ts = sorted(float(t) for t in thresholds)
    src = df.filter(finite(F.col(q)))
    reached = _passed(q, ">=", ts)
    m = F.coalesce(F.col(mask), F.lit(False))
    tab = src.groupBy(reached.alias("_k")).agg(F.count_if(m).alias("_in"), F.count_if(~m).alias("_out"))
    hit = F.explode(constants([{"i": i, "thr": t} for i, t in enumerate(ts)]))
    spread = tab.select("_k", "_in", "_out", hit.alias("s"))
    wet = F.col("_k") > F.col("s.i")
    out = spread.groupBy(F.col("s.thr").alias("thr")).agg(
        F.sum(F.when(wet, F.col("_in")).otherwise(0)).alias("tp"),
        F.sum(F.when(wet, F.col("_out")).otherwise(0)).alias("fp"),
        F.sum(F.when(wet, 0).otherwise(F.col("_in"))).alias("fn"),
        F.sum(F.when(wet, 0).otherwise(F.col("_out"))).alias("tn"))
    out = out.withColumn("wet_share", (F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))
    return detector_metrics(out)


def roc_curve(df: DataFrame, q: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts at every distinct value taken as threshold ``q >= value``."""
    m = F.coalesce(F.col(mask), F.lit(False))
    src = df.filter(finite(F.col(q)))
    counts = value_counts(src, by, q, {"n_in": m.cast("long"), "n_out": (~m).cast("long")})
    run = prefix_sums(counts, by, q, ["n_in", "n_out"])
    keyed, keys = _keyed(run, by)
    tot = _keyed(counts, by)[0].groupBy(*keys).agg(F.sum("n_in").alias("_ti"), F.sum("n_out").alias("_to"))
    out = keyed.join(sized(tot), keys)
    fn, tn = F.col("cum_n_in") - F.col("n_in"), F.col("cum_n_out") - F.col("n_out")
    return out.select(*by, F.col(q).alias("thr"), (F.col("_ti") - fn).alias("tp"), (F.col("_to") - tn).alias("fp"),
                      tn.alias("tn"), fn.alias("fn"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Best row by MCC and by Youden's J; the lowest threshold wins a tie."""
    def best(score: str, label: str) -> DataFrame:
        r = F.max_by(F.struct("thr", F.col(score).alias("score"), "wet_share"),
                     F.struct(F.col(score), -F.col("thr")))
        return sweep.agg(r.alias("r")).select(F.lit(label).alias("criterion"), "r.*")

    return best("mcc", "mcc").unionByName(best("youden", "youden"))


def wet_index(df: DataFrame, q: str, thresholds: Sequence[float], key: str = "cell_id") -> DataFrame:
    """Cells reaching each threshold, one row per (threshold number, cell)."""
    ts = [float(t) for t in thresholds]
    hits = F.array_compact(F.array(*[
        F.when(F.col(q) >= t, F.struct(F.lit(i).alias("thr_no"), F.lit(t).alias("thr"))) for i, t in enumerate(ts)]))
    return df.filter(finite(F.col(q))).select(key, F.explode(hits).alias("h")).select("h.thr_no", "h.thr", key)

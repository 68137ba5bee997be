"""Order statistics over groups of any size.

A plain window puts a whole group into one task, which is right for reports and wrong for a
group that holds a third of a large table.  Every operator here first counts the rows per group
(one aggregate with map-side combine).  Groups up to ``GROUP_ROWS`` use the window; larger ones
are cut by splitters that a sample suggests, so that parts are of nearly equal rank however the
values are spread.  Running totals combine range totals; quantiles count the rows around their
splitters, which proves the rank range before anything is sorted.  No arithmetic is done on values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltgrid.functions.nulls import finite
from meltgrid.session import cut_lineage, sized

GROUP_ROWS = 4_000_000
#: Sampled rows from which splitters of a large group are taken.
SAMPLE_ROWS = 20_000
_ONE = "_all"


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Grouping keys, or one constant key for an ungrouped call."""
    return (df, list(by)) if by else (df.withColumn(_ONE, F.lit(0)), [_ONE])


def constants(rows: Sequence[Mapping[str, int | float]]) -> Column:
    """Constant array of structs, written as one expression rather than call by call."""
    def text(v: int | float) -> str:
        return f"{v!r}D" if isinstance(v, float) else str(v)

    return F.expr("array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{k}', {text(v)}" for k, v in row.items()) + ")" for row in rows) + ")")


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    keyed, keys = _keyed(df, by)
    top = keyed.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return top or 0


def value_counts(df: DataFrame, by: Sequence[str], value: str,
                 sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (group, value); ties collapse before anything is sorted."""
    sums = sums or {"n": F.lit(1)}
    return df.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def prefix_sums(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str],
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """Running totals ``cum_<col>`` in ascending ``order`` within each group.

    ``df`` holds one row per (group, order) value; ``order`` is numeric.
    """
    keyed, keys = _keyed(df, by)
    if largest_group(df, by) <= group_rows:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = keyed.withColumns({f"cum_{c}": F.sum(c).over(w) for c in cols})
    else:
        out = _ranged_prefix_sums(cut_lineage(keyed), keys, order, cols, group_rows)
    return out if by else out.drop(_ONE)


def _ranged_prefix_sums(df: DataFrame, keys: list[str], order: str, cols: Sequence[str], group_rows: int) -> DataFrame:
    """Ranges of rows from sampled splitters; a window per range plus the totals of earlier ranges."""
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.count() // group_rows)
    df = cut_lineage(df.repartitionByRange(ranges, *keys, order).withColumn("_part", F.spark_partition_id()))
    inside = [*keys, "_part"]
    totals = df.groupBy(*inside).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(totals.select(
        *inside, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in cols]))
    run = Window.partitionBy(*inside).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"cum_{c}": F.sum(c).over(run) for c in cols}).join(sized(offsets), inside)
    out = out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_b_{c}") for c in cols})
    return out.drop("_part", *[f"_b_{c}" for c in cols])


def dense_index(df: DataFrame, block: str, order: Sequence[str], by: Sequence[str] = (), name: str = "idx",
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """0-based position of each row in (block, order) within its group, built from per-block
    counts so that no task sees more than one block (a grid row, for instance)."""
    per_block = df.groupBy(*by, block).agg(F.count(F.lit(1)).alias("_n"))
    run = prefix_sums(per_block, by, block, ["_n"], group_rows)
    starts = run.select(*by, block, (F.col("cum__n") - F.col("_n")).alias("_start"))
    w = Window.partitionBy(*by, block).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(w))
            .join(sized(cut_lineage(starts)), [*by, block])
            .withColumn(name, F.col("_start") + F.col("_rn") - 1)
            .drop("_start", "_rn"))


def midpoint_quantile(df: DataFrame, col: str, ps: Mapping[str, float], by: Sequence[str] = (),
                      group_rows: int = GROUP_ROWS, pairs: bool = False, store: bool = True) -> DataFrame:
    """Quantiles at midpoint positions ``n p + 0.5``, clamped to the ends.

    ``ps`` maps output names to probabilities.  Returns one row per group with ``n`` and the
    named quantiles, with ``pairs`` also the two order statistics ``<name>_lo, <name>_hi`` around
    each.  Built-in percentiles use ``(n - 1) p + 1`` and keep every distinct value of
    a group in one hash map, hence this form.

    Several passes run over keys and values (one counts the groups), so these are written once before the first: what
    lies behind them, a bootstrap say, is computed once.  ``store=False`` reads them again in every pass instead: right
    for a stored table, and for rows that a map task multiplies, where only counts should leave the task.
    """
    keyed, keys = _keyed(df, by)
    src = keyed.select(*keys, F.col(col).cast("double").alias("_v")).filter(finite(F.col("_v")))
    src = cut_lineage(src) if store else src
    groups = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    hot = groups.filter(F.col("n") > group_rows).collect()
    if not hot:
        return _interpolated(_window_quantile(src, keys, ps), keys, ps, pairs)
    hot_df = src.sparkSession.createDataFrame(hot, groups.schema)
    done = _bracket_quantile(src, keys, ps, hot, group_rows)
    cold = src.join(F.broadcast(hot_df.select(*keys)), keys, "left_anti")
    return _interpolated(_window_quantile(cold, keys, ps).unionByName(done), keys, ps, pairs)


def _interpolated(stats: DataFrame, keys: list[str], ps: Mapping[str, float], pairs: bool) -> DataFrame:
    cols = []
    for m in ps:
        cols.append(f"`_a_{m}` + `_f_{m}` * (`_b_{m}` - `_a_{m}`) AS `{m}`")
        if pairs:
            cols += [f"`_a_{m}` AS `{m}_lo`", f"`_b_{m}` AS `{m}_hi`"]
    return stats.selectExpr(*keys, "n", *cols).drop(_ONE)


def _window_quantile(src: DataFrame, keys: list[str], ps: Mapping[str, float]) -> DataFrame:
    counts = value_counts(src, keys, "_v")
    w = Window.partitionBy(*keys)
    run = counts.withColumns({
        "_cum": F.sum("n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)),
        "_all_n": F.sum("n").over(w),
    })
    # Few rows hold a wanted rank; each is kept once per probability it serves.
    probs = constants([{"i": i, "p": float(p)} for i, p in enumerate(ps.values())])
    run = run.withColumn("_p", F.explode(probs)).withColumn("_pos", _position(F.col("_all_n"), F.col("_p.p")))
    k0 = F.floor("_pos")
    k1 = F.least(k0 + 1, F.col("_all_n"))
    prev, cum = F.col("_cum") - F.col("n"), F.col("_cum")
    hits = run.filter((prev < k1) & (cum >= k0)).groupBy(*keys, F.col("_p.i").alias("i")).agg(
        F.max("_all_n").alias("n"), F.max(F.when(prev < k0, F.col("_v"))).alias("a"),
        F.max(F.when(cum >= k1, F.col("_v"))).alias("b"), F.max(F.col("_pos") - k0).alias("f"))
    packed = hits.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "a", "b", "f"))).alias("_h"))
    return packed.selectExpr(*keys, "n", *[f"_h[{i}].{c} AS `_{c}_{m}`" for i, m in enumerate(ps) for c in ("a", "b", "f")])


def _position(n: Column, p: Column) -> Column:
    return F.least(F.greatest(n * p + 0.5, F.lit(1.0)), n.cast("double"))


def _bracket_quantile(src: DataFrame, keys: list[str], ps: Mapping[str, float], hot: list,
                      group_rows: int) -> DataFrame:
    """Exact order statistics of large groups.

    A wanted rank starts with its whole group as an open interval of values.  A round samples the rows of the interval
    and takes two splitters a few standard errors around the rank, then counts the rows below, at, between and at the
    other splitter.  These counts settle the rank on a splitter or prove the narrower open interval it stands in,
    which always excludes at least one value; ties at splitters never enter again.  Intervals of at most
    ``group_rows`` rows are sorted.  One row for each wanted rank reaches the driver.
    """
    spark = src.sparkSession
    wanted, found, todo = {}, {}, []
    for gi, row in enumerate(hot):
        n = row["n"]
        for name, p in ps.items():
            pos = min(max(n * p + 0.5, 1.0), float(n))
            k0 = int(math.floor(pos))
            wanted[gi, name] = (k0, min(k0 + 1, n), pos - k0)
        for k in sorted({k for (g, _), (a, b, _f) in wanted.items() if g == gi for k in (a, b)}):
            todo.append((gi, k, None, None, 0, n))
    range_schema = T.StructType([
        *[src.schema[k] for k in keys], T.StructField("_id", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ("_lo", "_hi", "_a", "_b", "_share")]])
    v = F.col("_v")

    def inside(lo: str, hi: str) -> Column:
        return (F.col(lo).isNull() | (v > F.col(lo))) & (F.col(hi).isNull() | (v < F.col(hi)))

    def ranged(rows: list[tuple]) -> DataFrame:
        """Rows of the open intervals (group, lo, hi, a, b, share), with the interval's number."""
        side = [(*[hot[g][k] for k in keys], i, *rest) for i, (g, *rest) in enumerate(rows)]
        return src.join(F.broadcast(spark.createDataFrame(side, range_schema)), keys).filter(inside("_lo", "_hi"))

    def numbered(ranks: list[tuple]) -> tuple[list[tuple], list[int]]:
        """Distinct intervals of some ranks, and which one each rank has."""
        where = {}
        at = [where.setdefault((g, lo, hi), len(where)) for g, _, lo, hi, _, _ in ranks]
        return list(where), at

    seed, small = 0, []
    while True:
        small += [r for r in todo if r[5] <= group_rows]
        todo = [r for r in todo if r[5] > group_rows]
        if not todo:
            break
        seed += 1
        spans, at = numbered(todo)
        share = {i: min(1.0, SAMPLE_ROWS / r[5]) for r, i in zip(todo, at)}
        sample = (ranged([(*s, None, None, share[i]) for i, s in enumerate(spans)])
                  .filter(F.rand(seed) < F.col("_share")).select("_id", "_v"))
        w = Window.partitionBy("_id")
        placed = sample.withColumns({"_r": F.row_number().over(w.orderBy("_v")), "_s": F.count(F.lit(1)).over(w)})
        asked = spark.createDataFrame([(i, j, (r[1] - r[4]) / r[5], share[i] == 1.0) for j, (r, i) in enumerate(zip(todo, at))],
                                      "_id int, _j int, _x double, _whole boolean")
        q = F.col("_x") * F.col("_s")
        # A sample of all rows has the wanted one itself as both splitters.
        width = F.when(F.col("_whole"), -0.5).otherwise(
            4.0 * F.sqrt(F.greatest(q * (1.0 - F.col("_x")), F.lit(0.0))) + 4.0)
        around = placed.join(F.broadcast(asked), "_id").groupBy("_j").agg(
            F.max(F.when(F.col("_r") <= q - width, v)).alias("a"), F.min(F.when(F.col("_r") >= q + width, v)).alias("b"),
            F.min(v).alias("least"))
        cuts = {r["_j"]: (r["a"], r["b"], r["least"]) for r in around.collect()}
        # Without a splitter on either side (a sample too small) the least sampled value still divides the interval.
        cuts = {j: (a, b) if a is not None or b is not None else (least, None) for j, (a, b, least) in cuts.items()}
        tried = [(j, todo[j]) for j in sorted(cuts)]
        counts = (ranged([(g, lo, hi, *cuts[j], None) for j, (g, _, lo, hi, _, _) in tried]).groupBy("_id").agg(
            F.count_if(v < F.col("_a")).alias("below"), F.count_if(v == F.col("_a")).alias("at_a"),
            F.count_if(inside("_a", "_b")).alias("mid"),
            F.count_if((v == F.col("_b")) & ~v.eqNullSafe(F.col("_a"))).alias("at_b"), F.count(F.lit(1)).alias("all")))
        counts = {r["_id"]: r for r in counts.collect()}
        nxt = [r for j, r in enumerate(todo) if j not in cuts]  # an empty sample: another one
        for i, (j, (g, k, lo, hi, before, _)) in enumerate(tried):
            c, (a, b) = counts[i], cuts[j]
            rest = k - before
            edges = [(c["below"], lo, a), (c["at_a"], a, a), (c["mid"], a if a is not None else lo, b if b is not None else hi),
                     (c["at_b"], b, b), (c["all"] - c["below"] - c["at_a"] - c["mid"] - c["at_b"], b, hi)]
            done = 0
            for step, (rows, low, high) in enumerate(edges):
                if rest <= done + rows:
                    if step in (1, 3):
                        found[g, k] = low
                    else:
                        nxt.append((g, k, low, high, before + done, rows))
                    break
                done += rows
        todo = nxt
    if small:
        spans, at = numbered(small)
        run = Window.partitionBy("_id").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        runs = value_counts(ranged([(*s, None, None, None) for s in spans]), ["_id"], "_v").withColumn("_cum", F.sum("n").over(run))
        ask = spark.createDataFrame([(i, r[1] - r[4], j) for j, (r, i) in enumerate(zip(small, at))],
                                    "_id int, _rank long, _j int")
        hits = (runs.join(F.broadcast(ask), "_id")
                .filter((F.col("_rank") <= F.col("_cum")) & (F.col("_rank") > F.col("_cum") - F.col("n"))))
        for h in hits.select("_j", "_v").collect():
            found[small[h["_j"]][:2]] = h["_v"]
    rows = []
    for gi, row in enumerate(hot):
        vals = []
        for name in ps:
            k0, k1, frac = wanted[gi, name]
            vals += [found[gi, k0], found[gi, k1], frac]
        rows.append((*[row[k] for k in keys], row["n"], *vals))
    schema = T.StructType([*[src.schema[k] for k in keys], T.StructField("n", T.LongType()),
                           *[T.StructField(f"_{s}_{m}", T.DoubleType()) for m in ps for s in ("a", "b", "f")]])
    return spark.createDataFrame(rows, schema)


def ecdf(df: DataFrame, col: str, by: Sequence[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Empirical distribution function: one row per (group, value)."""
    keyed, keys = _keyed(df, by)
    counts = value_counts(keyed.filter(finite(F.col(col))), keys, col)
    run = prefix_sums(counts, keys, col, ["n"], group_rows)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return (run.join(sized(cut_lineage(total)), keys)
            .withColumn("f", F.col("cum_n") / F.col("total"))
            .select(*by, col, "n", "cum_n", "f"))


def avg_rank(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "avg_rank",
             group_rows: int = GROUP_ROWS) -> DataFrame:
    """Tie-averaged 1-based rank on every row; missing values have none."""
    src = df.filter(finite(F.col(col)))
    run = prefix_sums(value_counts(src, by, col), by, col, ["n"], group_rows)
    ranks = run.select(*by, col, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias(name))
    return src.join(sized(cut_lineage(ranks)), [*by, col])


def cum_weight(df: DataFrame, weight: str, order: str, by: Sequence[str] = (), name: str = "cum_w",
               group_rows: int = GROUP_ROWS) -> DataFrame:
    """Running weight in ``order`` (unique per group)."""
    out = prefix_sums(df, by, order, [weight], group_rows)
    return out.withColumnRenamed(f"cum_{weight}", name)


def trim_central(df: DataFrame, col: str, keep: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Drop values outside the central share to NULL; ``trimmed`` marks them."""
    tail = round((1.0 - keep) / 2.0, 12)
    cuts = midpoint_quantile(df, col, {"_lo": tail, "_hi": 1.0 - tail}, by).drop("n")
    keyed, keys = _keyed(df, by)
    keyed_cuts, _ = _keyed(cuts, by)
    out = keyed.join(sized(cut_lineage(keyed_cuts)), keys, "left")
    outside = (F.col(col) < F.col("_lo")) | (F.col(col) > F.col("_hi"))
    return (out.withColumn("trimmed", F.coalesce(outside, F.lit(False)))
            .withColumn(col, F.when(~F.col("trimmed"), F.col(col)))
            .drop("_lo", "_hi", _ONE))


def histogram(df: DataFrame, col: str, edges: Sequence[float], norm: str = "count",
              by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin; bins are half open, the last one is closed.  Empty bins are kept."""
    keyed, keys = _keyed(df, by)
    v = F.col(col)
    last = len(edges) - 2
    # The edge list is a report parameter of fixed length, so the bin is one flat sum of tests.
    bin_no = sum(((v >= float(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    inside = keyed.filter(finite(v) & (v >= float(edges[0])) & (v <= float(edges[-1])))
    tab = inside.groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bin")
    frame = tab.select(*keys).distinct().select(*keys, bins)
    full = frame.join(tab, [*keys, "bin"], "left").fillna(0, ["n"])
    lo = F.element_at(F.array(*[F.lit(float(e)) for e in edges[:-1]]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(float(e)) for e in edges[1:]]), F.col("bin") + 1)
    total = F.sum("n").over(Window.partitionBy(*keys))
    value = {"count": F.col("n").cast("double"), "probability": F.col("n") / total,
             "pdf": F.col("n") / total / (hi - lo)}[norm]
    return full.select(*by, "bin", lo.alias("lo"), hi.alias("hi"), "n", value.alias("value"))


def percentile_edges(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> list[float]:
    """Equally spaced edges between two percentiles; two numbers reach the driver."""
    row = midpoint_quantile(df, col, {"a": lo, "b": hi}).first()
    step = (row["b"] - row["a"]) / bins
    return [row["a"] + i * step for i in range(bins)] + [row["b"]]

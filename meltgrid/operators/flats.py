"""The flat family without a row per (cell, flat).

A constant field predicts wet where its value reaches a cell's own threshold.  So a cell has a slot, the first flat
value that does, and running totals over slots serve every flat.  That holds for points, for expected metrics and for
replicates: flats have no spread of their own, and one set of drawn cells or regions serves the whole family.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltgrid.functions.names import FLAT_PREFIX
from meltgrid.functions.nulls import at_least, finite
from meltgrid.functions.physics import gdiff, topo_correct
from meltgrid.operators import resample as R
from meltgrid.operators.labelled import Labels
from meltgrid.operators.masks import flag
from meltgrid.operators.metrics import sigma_summary
from meltgrid.session import cut_lineage

#: Key of the draws that all flats share.
SHARED = "Flat"


def flat_name(value: Column) -> Column:
    return F.concat(F.lit(FLAT_PREFIX), value.cast("int").cast("string"))


def with_slots(cells: DataFrame, lo: int, hi: int, margin: Column | float, topo_applied: bool = False) -> DataFrame:
    """Add ``slot``: position of the first flat value of lo..hi that predicts wet, or their number if none does.

    The position is estimated by a division and then settled by the same comparison that rows of flats would make.
    A topographic factor ``1 + delta`` must be positive; cells without one, or without a minimum, are dry for all.
    """
    n, margin = hi - lo + 1, margin if isinstance(margin, Column) else F.lit(float(margin))
    adv = F.col("adv") if "adv" in cells.columns else None
    factor = 1.0 + F.col("delta") if "delta" in cells.columns and not topo_applied else F.lit(1.0)

    def wet(slot: Column) -> Column:
        g = (slot + lo).cast("double")
        if "delta" in cells.columns:
            g = topo_correct(g, F.col("delta"), topo_applied)
        return at_least(gdiff(g, F.col("gmin"), adv), margin)

    need = margin + (F.col("gmin") if adv is None else F.col("gmin") - adv)
    near = F.ceil(need / factor - lo)
    guess = F.when(finite(need / factor), F.least(F.greatest(near, F.lit(0)), F.lit(n)))
    s = F.col("slot")
    out = cells.withColumn("slot", guess.cast("int"))
    return out.withColumn("slot", F.when(s.isNull(), F.lit(n)).when((s > 0) & wet(s - 1), s - 1)
                          .when((s < n) & ~wet(s), s + 1).otherwise(s).cast("int"))


def _running(sums: DataFrame, keys: Sequence[str], lo: int, hi: int, labels: Labels, extra: Sequence[str] = ()) -> DataFrame:
    """Sums per (keys, slot) to sums per (keys, flat): ``a`` over all cells, ``b`` over those wet for the flat."""
    n = hi - lo + 1
    cols = [*labels.sums("a"), *extra]
    every = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("slot")
    frame = sums.select(*keys).distinct().select(*keys, every) if keys else sums.sparkSession.range(1).select(every)
    full = frame.join(sums, [*keys, "slot"], "left").fillna(0, cols)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = w.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    out = full.select(*keys, "slot", *[F.sum(c).over(w).alias(c) for c in cols],
                      *[F.sum(f"a{j}").over(run).alias(f"b{j}") for j in range(labels.width)])
    return out.filter(F.col("slot") < n).withColumn("model", flat_name(F.col("slot") + lo)).drop("slot")


def flat_expected(cells: DataFrame, lo: int, hi: int, labels: Labels = Labels()) -> DataFrame:
    """Confusion, scores and regional recalls of every flat for soft labels, each cell read once.

    For a family without spread these are the expected metrics as well as those of its predictions.
    """
    kept = cells.filter(F.col(labels.column).isNotNull())
    made = _running(labels.totals(kept, ["slot"]), [], lo, hi, labels, ["n_roi"]).filter(F.col("n_roi") > 0)
    return labels.scores(made, ["model", "n_roi"])


def flat_points(cells: DataFrame, lo: int, hi: int, label: str = "y") -> DataFrame:
    """Hard confusion of every flat with scores and regional recalls; any label but 1 is dry."""
    y = F.col(label)
    wet, inner, outer = (y == 1), flag(F.col("ispb")), flag(F.col("ospb"))
    value = F.coalesce(wet, F.lit(False)).cast("double")
    labels = Labels()
    sums = cells.groupBy("slot").agg(F.count(F.lit(1)).alias("n_roi"), *[
        F.sum(m).alias(f"a{j}") for j, m in enumerate(labels.masses(value, inner, outer))])
    made = labels.scores(_running(sums, [], lo, hi, labels, ["n_roi"]).filter(F.col("n_roi") > 0), ["model", "n_roi"])
    return made.withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "tn", "fn")})


def flat_sigma(cells: DataFrame, lo: int, hi: int) -> DataFrame:
    """Spread of the margin per flat: that of the melt minimum alone, one summary for all."""
    one = sigma_summary(cells.withColumns({"model": F.lit(SHARED), "s_model": F.lit(0.0)}))
    names = F.explode(F.array(*[F.lit(f"{FLAT_PREFIX}{v}") for v in range(lo, hi + 1)])).alias("model")
    return one.drop("model").select(names, *[c for c in one.columns if c != "model"])


def _replicates(parts: DataFrame, lo: int, hi: int, labels: Labels) -> DataFrame:
    sums = parts.groupBy("rep", "slot").agg(*[F.sum(c).alias(c) for c in labels.sums("a")])
    return labels.scores(_running(sums, ["rep"], lo, hi, labels), ["model", "rep"])


def bootstrap_flats_blocked(cells: DataFrame, cfg: R.BootConfig, lo: int, hi: int, block: str = "ri",
                            order: Sequence[str] = ("ci",), labels: Labels = Labels(), tile: int = R.TILE) -> DataFrame:
    """N-of-N resampling of cells, drawn once for all flats; sums per (tile, replicate, slot) leave a task."""
    base = cells.filter(F.col(labels.column).isNotNull()).withColumn("model", F.lit(SHARED))
    keys = ["model", "_s"]
    base = R.with_strata(base, cfg, labels).select(
        *keys, F.col(block).cast("long").alias("_b"), *order, "slot", F.col(labels.column).alias("_label"),
        flag(F.col("ispb")).alias("_in"), flag(F.col("ospb")).alias("_out"))
    base = R.with_tiles(cut_lineage(base), keys, tile)
    n_slots, n_boot, seed, width = hi - lo + 2, cfg.n_boot, cfg.seed, labels.width

    def draw(key, table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in ("slot", "_b", *order)])
        got = {c: table.column(c).to_numpy() for c in ("slot", "_label", "_in", "_out", "_first", "_total")}
        masses, slot = labels.matrix(got["_label"], got["_in"], got["_out"]), got["slot"]
        out = np.zeros((n_boot, n_slots, width))

        def add(at, drawn, wet, low, high):
            here = slot[low:high]
            head = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            for j in range(width):
                out[at:at + len(drawn), here[head], j] += np.add.reduceat(drawn * masses[low:high, j], head, axis=1)

        s = key[1].as_py()
        seeds = [seed, zlib.crc32(SHARED.encode()), int(s) + 1]
        R.draw_tile(seeds, int(got["_first"].min()), len(slot), int(got["_total"][0]), n_boot, None, add)
        rep, k = np.meshgrid(np.arange(n_boot), np.arange(n_slots), indexing="ij")
        flat = out.reshape(-1, width)
        return pa.table({"rep": rep.ravel().astype("int32"), "slot": k.ravel().astype("int32"),
                         **{f"a{j}": flat[:, j] for j in range(width)}})

    schema = "rep int, slot int, " + ", ".join(f"{c} double" for c in labels.sums("a"))
    return _replicates(base.groupBy(*keys, "_tile").applyInArrow(draw, schema), lo, hi, labels)


def bootstrap_flats_hard(cells: DataFrame, cfg: R.BootConfig, lo: int, hi: int, labels: Labels = Labels()) -> DataFrame:
    """The same for labels of few values: a draw falls on (slot, label, area) with that class's share, so the counts of
    a replicate are multinomial over a table of report size and no cell is drawn."""
    inner, outer = flag(F.col("ispb")), flag(F.col("ospb"))
    classes = cells.filter(F.col(labels.column).isNotNull()).groupBy(
        "slot", F.col(labels.column).cast("int").alias("label"), inner.alias("inner"), outer.alias("outer")).count()
    rows = classes.orderBy("slot", "label", "inner", "outer").collect()
    n_boot, seed, width, n_slots = cfg.n_boot, cfg.seed, labels.width, hi - lo + 2
    schema = "rep int, slot int, " + ", ".join(f"{c} double" for c in labels.sums("a"))
    if not rows:
        return _replicates(cells.sparkSession.createDataFrame([], schema), lo, hi, labels)
    table = [[r[c] for r in rows] for c in ("slot", "label", "inner", "outer", "count")]

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        slot, label, inside, outside, count = (np.array(x) for x in table)
        masses = labels.matrix(label, inside, outside)
        for b in batches:
            reps = b.column(0).to_numpy()
            out = np.zeros((len(reps), n_slots, width))
            for i, rep in enumerate(reps):
                rng = np.random.default_rng([seed, zlib.crc32(SHARED.encode()), int(rep)])
                got = rng.multinomial(int(count.sum()), count / count.sum())
                np.add.at(out[i], slot, got[:, None] * masses)
            flat = out.reshape(-1, width)
            yield pa.RecordBatch.from_pydict({
                "rep": np.repeat(reps, n_slots).astype("int32"), "slot": np.tile(np.arange(n_slots), len(reps)).astype("int32"),
                **{f"a{j}": flat[:, j] for j in range(width)}})
    return _replicates(cells.sparkSession.range(n_boot).mapInArrow(draw, schema), lo, hi, labels)


def bootstrap_flats_components(cells: DataFrame, cfg: R.BootConfig, lo: int, hi: int, block: str = "ri",
                               order: Sequence[str] = ("ci",), labels: Labels = Labels()) -> DataFrame:
    """Resampling of regions, drawn once for all flats: a region adds its slot sums as often as it is drawn."""
    base = cells.filter(F.col(labels.column).isNotNull()).withColumn("model", F.lit(SHARED))
    comps = cut_lineage(R.component_table(base))
    if comps.isEmpty():
        return replicate_flats(cells, cfg, lo, hi, "cells", block, order, labels)
    times = R.drawn_regions(comps, cfg).groupBy("rep", "comp_id").agg(F.count(F.lit(1)).alias("_k"))
    masses = base.filter("comp_id > 0").groupBy("comp_id", "slot").agg(
        *[F.sum(m).alias(f"a{j}") for j, m in enumerate(labels.masses())])
    parts = times.join(masses, "comp_id").select(
        "rep", "slot", *[(F.col("_k") * F.col(c)).alias(c) for c in labels.sums("a")])
    return _replicates(parts, lo, hi, labels)


def replicate_flats(cells: DataFrame, cfg: R.BootConfig, lo: int, hi: int, mode: str = "cells", block: str = "ri",
                    order: Sequence[str] = ("ci",), labels: Labels = Labels(), hard: bool = False) -> DataFrame:
    """Replicates of the family by the cheapest form that is exact for the labels and the mode."""
    if mode == "components":
        return bootstrap_flats_components(cells, cfg, lo, hi, block, order, labels)
    if (hard or labels.thresholds) and not cfg.balance:
        return bootstrap_flats_hard(cells, cfg, lo, hi, labels)
    return bootstrap_flats_blocked(cells, cfg, lo, hi, block, order, labels)

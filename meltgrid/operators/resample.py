"""Bootstrap of cells and of connected regions, bands and summaries.

Rows: ``model, cell_id, pw, y, ispb, ospb`` (+ ``comp_id`` for regions; ``gdiff, margin,
s_total`` for jittered thresholds).  Every draw is a hash of (seed, model, replicate, draw), so a
replicate does not depend on partitioning, retries or lost executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.draws import NumberedKeys, numbered_spans
from meltgrid.functions.mathx import EPS, normal_draw, uniform
from meltgrid.operators.labelled import PASSED, Labels
from meltgrid.operators.masks import flag
from meltgrid.operators.metrics import regional_sums, soft_counts, with_regional, with_scores
from meltgrid.operators.ordered import dense_index, midpoint_quantile, prefix_sums
from meltgrid.session import cut_lineage, sized

METRICS = ("spec", "rec", "prec", "acc", "f1", "g_mean", "rec_in_wet", "rec_out_dry", "g_regional")
REGION_CHUNK = 100_000
#: Cells of a tile, cells x replicates that a task draws at once, and draw counts that meet a bundle of regions.
TILE, DRAWS, COUNT_ROWS = 50_000, 1_000_000, 1_000_000
#: Cells that a task looks up draws in, replicates it makes, and keys it hashes at once.
TABLE_ROWS, TABLE_REPS, KEYS = 4_000_000, 100, 32_768


@dataclass(frozen=True)
class BootConfig:
    """``pred`` is ``bernoulli`` or ``noisy``; ``draws`` is the uniform kind (md5 or fast);
    ``joined`` asks for the forms that make a row of every drawn copy, whatever the kind."""

    n_boot: int = 1000
    seed: int = 42
    balance: bool = False
    mfrac: float = 0.7
    by_size: bool = False
    pred: str = "bernoulli"
    noise: float = 1.0
    draws: str = "fast"
    joined: bool = False


def usable(df: DataFrame, label: str = "y") -> DataFrame:
    return df.filter(F.col("pw").isNotNull() & F.col(label).isNotNull())


def _cell_uniform(key: Sequence[int], ids, copy: int, which: int = 0):
    """Uniform number of each cell id for one drawn copy; a cell's number depends on nothing else
    that shares its task."""
    import numpy as np

    k = int(np.random.SeedSequence([*key, copy, which]).generate_state(1, np.uint64)[0])
    x = ids.astype(np.uint64) ^ np.uint64(k)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 9007199254740992.0


def _wet(cfg: BootConfig, *key: Column | str) -> Column:
    """Predicted wet state of one drawn copy."""
    if cfg.pred == "noisy":
        jitter = normal_draw(F.lit(cfg.seed), *key, kind=cfg.draws)
        spread = F.sqrt(F.greatest(F.col("s_total") * F.col("s_total"), F.lit(EPS)))
        return (F.col("gdiff") + cfg.noise * spread * jitter >= F.col("margin")).cast("double")
    return (uniform(F.lit(cfg.seed), *key, "p", kind=cfg.draws) < F.col("pw")).cast("double")


def _replicate_table(copies: DataFrame, wet: Column) -> DataFrame:
    """Scores per (model, replicate) from drawn copies, in one aggregate."""
    y = F.col("y").cast("double")
    src = copies.withColumn("_w", wet)
    aggs = [*soft_counts(F.col("_w"), y), *regional_sums(F.col("_w"), y, flag(F.col("ispb")), flag(F.col("ospb")))]
    return with_regional(with_scores(src.groupBy("model", "rep").agg(*aggs)))


def _needed(df: DataFrame, cfg: BootConfig) -> list[str]:
    extra = ["gdiff", "margin", "s_total"] if cfg.pred == "noisy" else []
    return [c for c in ("pw", "y", PASSED, "ispb", "ospb", *extra) if c in df.columns]


def bootstrap_cells(df: DataFrame, cfg: BootConfig, block: str = "ri", order: Sequence[str] = ("ci",)) -> DataFrame:
    """N-of-N resampling of cells per model.

    Each cell row also serves as one draw slot, so the draws are spread as the data are and no
    list of draws is ever built.  With ``balance`` and both hard classes present, each class is
    resampled within itself.  Plain md5 draws are made beside the cells (``_table_sums``) and meet
    them without a row of their own.
    """
    base = usable(df)
    if cfg.balance:
        kinds = base.groupBy("model").agg(F.count_if(F.col("y") == 1).alias("_p"), F.count_if(F.col("y") == 0).alias("_q"),
                                          F.count(F.lit(1)).alias("_n"))
        split = (F.col("_p") > 0) & (F.col("_q") > 0) & (F.col("_p") + F.col("_q") == F.col("_n"))
        base = base.join(sized(cut_lineage(kinds.select("model", split.alias("_split")))), "model")
        base = base.withColumn("_s", F.when(F.col("_split"), F.col("y").cast("int")).otherwise(-1)).drop("_split")
    else:
        base = base.withColumn("_s", F.lit(-1))
    keys = ["model", "_s"]
    # The rows are read several times below; upstream joins run once.
    base = cut_lineage(base.select(*keys, block, *[c for c in order if c != block], *_needed(base, cfg)))
    # Counts, slots and drawn cells read the same ranks, so these are written as well.
    base = cut_lineage(dense_index(base, block, order, keys))
    n = sized(cut_lineage(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))))
    if cfg.pred == "bernoulli" and cfg.draws == "md5":
        return with_regional(with_scores(_table_sums(base, n, cfg)))
    return _joined_replicates(base, n, cfg)


def _joined_replicates(base: DataFrame, n: DataFrame, cfg: BootConfig) -> DataFrame:
    """Replicates with a row for every draw, which is joined to its cell."""
    keys = ["model", "_s"]
    slots = base.select(*keys, F.col("idx").alias("draw")).join(n, keys)
    slots = slots.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_boot - 1))))
    stratum = [F.col("_s")] if cfg.balance else []
    u = uniform(F.lit(cfg.seed), F.col("model"), F.col("rep"), *stratum, F.col("draw"), kind=cfg.draws)
    picks = slots.select(*keys, "rep", "draw", F.least(F.floor(u * F.col("_n")), F.col("_n") - 1).alias("idx"))
    copies = picks.join(base, [*keys, "idx"])
    return _replicate_table(copies, _wet(cfg, F.col("model"), F.col("rep"), *stratum, F.col("draw")))


def _table_sums(base: DataFrame, n: DataFrame, cfg: BootConfig, rows: int = TABLE_ROWS, reps: int = TABLE_REPS) -> DataFrame:
    """Confusion sums per (model, rep) of the draws of ``_joined_replicates``, without a row for a draw.

    A task holds up to ``rows`` cells of a group as a table, makes the draws of ``reps`` replicates and looks up those
    that fall on its cells.  Cells are shuffled once for every ``reps`` replicates; only sums leave a task.  The draws of
    a group of more cells are made again beside each of its tables.
    """
    keys = ["model", "_s", "_tile", "_reps"]
    blocks = -(-cfg.n_boot // reps)
    y = F.col("y").cast("double")
    cells = base.join(n, ["model", "_s"]).select(
        "model", "_s", F.floor(F.col("idx") / rows).cast("int").alias("_tile"), "_n", "idx", F.col("pw").cast("double").alias("pw"),
        y.alias("_raw"), F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)).alias("y"), flag(F.col("ispb")).alias("_in"),
        flag(F.col("ospb")).alias("_out"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_reps"))
    tasks = blocks * (n.agg(F.sum(F.ceil(F.col("_n") / rows))).first()[0] or 1)
    seed, n_boot, balance = cfg.seed, cfg.n_boot, cfg.balance
    sums = ["tp", "fp", "tn", "fn", "_wn", "_wd", "_dn", "_dd"]

    def draw(key, cells):
        import numpy as np
        import pyarrow as pa

        model, s, tile, at = (k.as_py() for k in key)
        got = {c: cells.column(c).to_numpy() for c in ("idx", "_n", "pw", "_raw", "y", "_in", "_out")}
        total, low, size = int(got["_n"][0]), tile * rows, len(cells)
        table = np.empty((size, 5))
        # Spark holds NaN for larger than any number.
        table[got["idx"] - low] = np.stack([
            np.where(np.isnan(got["pw"]), np.inf, got["pw"]), got["y"], 1.0 - got["y"], np.where(got["_in"], got["_raw"], 0.0),
            np.where(got["_out"], 1.0 - got["_raw"], 0.0)], axis=1)
        numbers = range(at * reps, min(n_boot, (at + 1) * reps))
        heads = [f"{seed}|{model}|{rep}|{f'{s}|' if balance else ''}".encode() for rep in numbers]
        wet, dry = np.zeros((len(heads), 4)), np.zeros((len(heads), 4))
        for length in sorted({len(h) for h in heads}):
            for first, count in numbered_spans(total, length + 2, KEYS):
                picks, states = NumberedKeys(length, first, count), NumberedKeys(length, first, count, b"|p")
                for i, head in ((i, h) for i, h in enumerate(heads) if len(h) == length):
                    pick = np.minimum(np.floor(picks.uniform(head, count) * total).astype("int64"), total - 1) - low
                    mine, own = states, count
                    if size < total:
                        here = np.flatnonzero((pick >= 0) & (pick < size))
                        pick, mine, own = pick[here], states.kept(here), len(here)
                    cell = table.take(pick, axis=0)
                    hit = mine.uniform(head, own) < cell[:, 0]
                    wet[i] += hit.astype("float64") @ cell[:, 1:]
                    dry[i] += (~hit).astype("float64") @ cell[:, 1:]
        out = [wet[:, 0], wet[:, 1], dry[:, 1], dry[:, 0], wet[:, 2], wet[:, 2] + dry[:, 2], dry[:, 3], wet[:, 3] + dry[:, 3]]
        return pa.table({"model": pa.repeat(model, len(heads)), "rep": np.array(numbers, dtype="int32"), **dict(zip(sums, out))})

    parts = cells.repartition(tasks, *keys).groupBy(*keys).applyInArrow(
        draw, "model string, rep int, " + ", ".join(f"{c} double" for c in sums))
    return parts.groupBy("model", "rep").agg(*[F.sum(c).alias(c) for c in sums])


def _block_shares(key: Sequence[int], start: int, size: int, total: int, n_boot: int) -> Iterator:
    """Rank ranges ``(lo, hi)`` that make up one block, with the draws every replicate puts there.

    ``total`` draws of a replicate fall on ``total`` ranks.  A binary tree over the ranks halves
    them: each node gives its left half a binomial share, keyed by the node, so every block finds
    its own share by walking the few nodes its ends cut, and no list of blocks exists anywhere.
    """
    import numpy as np

    width = 1 << max(0, (total - 1).bit_length())
    todo = [(0, width, np.full(n_boot, total, dtype="int64"))]
    while todo:
        lo, hi, k = todo.pop()
        end = min(hi, total)
        if lo >= start + size or end <= start:
            continue
        if start <= lo and end <= start + size:
            yield lo, end, k
            continue
        mid = (lo + hi) // 2
        left = np.random.default_rng([*key, lo, hi, 0]).binomial(k, (min(mid, end) - lo) / (end - lo))
        todo += [(lo, mid, left), (mid, hi, k - left)]


def with_strata(base: DataFrame, cfg: BootConfig, labels: Labels = Labels()) -> DataFrame:
    """Add ``_s``: with ``balance`` and both hard classes present the class, else -1 for all rows of a model."""
    if not cfg.balance:
        return base.withColumn("_s", F.lit(-1))
    if labels.thresholds:
        raise ValueError("balanced draws need one label a cell")
    hard = (F.col("y") == 0) | (F.col("y") == 1)
    kinds = base.groupBy("model").agg(
        ((F.count_if(F.col("y") == 1) > 0) & (F.count_if(F.col("y") == 0) > 0) & F.every(hard)).alias("_split"))
    return base.join(sized(cut_lineage(kinds)), "model").withColumn(
        "_s", F.when(F.col("_split"), F.col("y").cast("int")).otherwise(-1)).drop("_split")


def with_tiles(base: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Add ``_tile``, ``_first`` (first rank of the row's block) and ``_total`` (rows of its key).

    Consecutive blocks ``_b`` form tiles of about ``tile`` rows, so a task gets neither a handful of cells nor a
    number that grows with the grid.
    """
    sizes = cut_lineage(base.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.groupBy(*keys).agg(F.sum("n").alias("_total"))
    run = prefix_sums(sizes, list(keys), "_b", ["n"])
    place = run.join(total, list(keys)).select(*keys, "_b", (F.col("cum_n") - F.col("n")).alias("_first"), "_total")
    place = place.withColumn("_tile", F.floor(F.col("_first") / tile).cast("long"))
    return base.join(sized(cut_lineage(place)), [*keys, "_b"])


def draw_tile(seeds: Sequence[int], start: int, size: int, total: int, n_boot: int, wet, add) -> None:
    """Draw the share of every replicate that falls on ranks start..start + size - 1.

    ``wet(rng, cells)`` says which draws of these cells are predicted wet (None: not asked).  ``add(first replicate,
    draws, wet draws, low, high)`` takes the counts, replicates by cells low..high - 1 of the tile, for a bounded
    number of cells and replicates at a time.
    """
    import numpy as np

    for lo, hi, k in _block_shares(seeds, start, size, total, n_boot):
        rng = np.random.default_rng([*seeds, lo, hi, 1])
        n, low = hi - lo, lo - start
        step = max(1, DRAWS // n)
        for at in range(0, n_boot, step):
            times = k[at:at + step]
            rep = np.repeat(np.arange(len(times)), times)
            i = rng.integers(0, n, len(rep))
            place, cells = rep * n + i, (len(times), n)
            drawn = np.bincount(place, minlength=len(times) * n).reshape(cells).astype("float64")
            hit = None
            if wet is not None:
                hit = np.bincount(place[wet(rng, low + i)], minlength=len(times) * n).reshape(cells).astype("float64")
            add(at, drawn, hit, low, low + n)


def bootstrap_cells_blocked(df: DataFrame, cfg: BootConfig, block: str = "ri", order: Sequence[str] = ("ci",),
                            labels: Labels = Labels(), tile: int = TILE) -> DataFrame:
    """N-of-N resampling that never moves a draw.

    Cells are ranked by block (a grid row, say) and place.  The draws of a replicate are uniform
    over ranks, so a tile of blocks knows from its first rank, its size and the total how many fall
    on it (``_block_shares``) and draws from its own cells.  A cell's copies meet its label masses
    as one product.  Cells are shuffled once by tile; only sums per (model, tile, replicate) leave it.
    """
    noisy, seed, noise, n_boot = cfg.pred == "noisy", cfg.seed, cfg.noise, cfg.n_boot
    keys = ["model", "_s"]
    base = with_strata(usable(df, labels.column), cfg, labels)
    extra = ["gdiff", "margin", "s_total"] if noisy else ["pw"]
    base = cut_lineage(base.select(*keys, F.col(block).cast("long").alias("_b"), *order, F.col(labels.column).alias("_label"),
                                   flag(F.col("ispb")).alias("_in"), flag(F.col("ospb")).alias("_out"), *extra))
    sums = [*labels.sums("a"), *labels.sums("b")]

    def draw(key, cells):
        import numpy as np
        import pyarrow as pa

        model, s, _ = (k.as_py() for k in key)
        cells = cells.sort_by([(c, "ascending") for c in ("_b", *order)])
        got = {c: cells.column(c).to_numpy() for c in ("_label", "_in", "_out", "_first", "_total", *extra)}
        masses = labels.matrix(got["_label"], got["_in"], got["_out"])
        if noisy:
            gap = got["margin"].astype("float64") - got["gdiff"].astype("float64")
            spread = noise * np.sqrt(np.maximum(got["s_total"].astype("float64") ** 2, EPS))
        else:
            pw = got["pw"].astype("float64")
        out = np.zeros((n_boot, 2, labels.width))

        def wet(rng, i):
            return spread[i] * rng.standard_normal(len(i)) >= gap[i] if noisy else rng.random(len(i)) < pw[i]

        def add(at, drawn, hit, low, high):
            out[at:at + len(drawn), 0] += drawn @ masses[low:high]
            out[at:at + len(drawn), 1] += hit @ masses[low:high]

        draw_tile([seed, zlib.crc32(model.encode()), int(s) + 1], int(got["_first"].min()), len(masses),
                  int(got["_total"][0]), n_boot, wet, add)
        flat = out.reshape(n_boot, -1)
        return pa.table({"model": pa.repeat(model, n_boot), "rep": np.arange(n_boot, dtype="int32"),
                         **{c: flat[:, j] for j, c in enumerate(sums)}})

    parts = with_tiles(base, keys, tile).groupBy(*keys, "_tile").applyInArrow(
        draw, "model string, rep int, " + ", ".join(f"{c} double" for c in sums))
    return labels.scores(parts.groupBy("model", "rep").agg(*[F.sum(c).alias(c) for c in sums]), ["model", "rep"])


def pick_by_weight(draws: DataFrame, cdf: DataFrame, by: Sequence[str], u: str = "u") -> DataFrame:
    """First entry whose cumulative share reaches ``u``: ``cdf(by..., item, lo, hi, n)`` holds
    intervals (lo, hi].  Intervals meet draws through as many equal cells as there are entries,
    so a draw sees about two entries whatever the weights."""
    cells = F.explode(F.sequence(F.floor(F.col("lo") * F.col("n")), F.floor(F.col("hi") * F.col("n"))))
    spread = cdf.withColumn("_cell", cells)
    sizes = cdf.groupBy(*by).agg(F.max("n").alias("_k"))
    out = draws.join(sized(sizes), list(by)).withColumn("_cell", F.floor(F.col(u) * F.col("_k"))).drop("_k")
    hit = (F.col(u) <= F.col("hi")) & ((F.col(u) > F.col("lo")) | (F.col("lo") == 0) & (F.col(u) == 0))
    return out.join(spread, [*by, "_cell"]).filter(hit).drop("_cell", "lo", "hi", "n")


def component_table(base: DataFrame) -> DataFrame:
    """Regions of each model with size, 0-based position, cells before them and cumulative size share."""
    sizes = base.filter("comp_id > 0").groupBy("model", "comp_id").agg(F.count(F.lit(1)).alias("cells"))
    run = prefix_sums(sizes.withColumn("one", F.lit(1)), ["model"], "comp_id", ["one", "cells"])
    tot = sizes.groupBy("model").agg(F.count(F.lit(1)).alias("n_comp"), F.sum("cells").alias("_all"))
    out = run.join(sized(cut_lineage(tot)), "model")
    return out.select("model", "comp_id", "cells", "n_comp", (F.col("cum_one") - 1).alias("idx"),
                      (F.col("cum_cells") - F.col("cells")).alias("before"),
                      ((F.col("cum_cells") - F.col("cells")) / F.col("_all")).alias("lo"),
                      (F.col("cum_cells") / F.col("_all")).alias("hi"))


def drawn_regions(comps: DataFrame, cfg: BootConfig) -> DataFrame:
    """Drawn regions ``(model, rep, draw, comp_id, cells)``."""
    take = F.greatest(F.lit(1), F.round(F.lit(cfg.mfrac) * F.col("n_comp")))
    slots = comps.filter(F.col("idx") < take).select(
        "model", "n_comp", F.col("idx").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(cfg.n_boot - 1))).alias("rep"))
    slots = slots.withColumn("u", uniform(F.lit(cfg.seed), F.col("model"), F.col("rep"), F.col("draw"), kind=cfg.draws))
    if cfg.by_size:
        cdf = comps.select("model", "comp_id", "cells", "lo", "hi", F.col("n_comp").alias("n"))
        drawn = pick_by_weight(slots, cdf, ["model"])
    else:
        pick = slots.withColumn("idx", F.least(F.floor(F.col("u") * F.col("n_comp")), F.col("n_comp") - 1))
        drawn = pick.drop("n_comp").join(comps.select("model", "idx", "comp_id", "cells"), ["model", "idx"])
    return drawn.select("model", "rep", "draw", "comp_id", "cells")


def _parts(chunk: int) -> Column:
    """Parts of at most about ``chunk`` cells that a region is cut into."""
    return F.ceil(F.col("cells") / chunk).cast("int")


def _drawn_components(base: DataFrame, comps: DataFrame, cfg: BootConfig,
                      chunk: int = REGION_CHUNK) -> tuple[DataFrame, DataFrame]:
    """Drawn regions ``(model, rep, draw, comp_id, _part)`` and the cells ``(..., _part)`` they
    bring.  A region larger than ``chunk`` cells is cut into parts, so no join key or group
    holds more than that."""
    drawn = drawn_regions(comps, cfg).select(
        "model", "rep", "draw", "comp_id", F.explode(F.sequence(F.lit(0), _parts(chunk) - 1)).alias("_part"))
    members = base.filter("comp_id > 0").join(
        sized(comps.select("model", "comp_id", _parts(chunk).alias("_parts"))), ["model", "comp_id"])
    members = members.withColumn("_part", F.pmod(F.xxhash64("cell_id"), F.col("_parts")).cast("int"))
    return drawn, members.select("model", "comp_id", "_part", "cell_id", F.xxhash64("cell_id").alias("_id"), *_needed(base, cfg))


def _component_base(df: DataFrame, cfg: BootConfig, block: str, order: Sequence[str], label: str = "y") -> DataFrame:
    place = [c for c in (block, *order) if c in df.columns]
    base = usable(df, label)
    return base.select("model", "comp_id", "cell_id", *dict.fromkeys(place), *_needed(base, cfg))


def bootstrap_components(df: DataFrame, cfg: BootConfig, block: str = "ri", order: Sequence[str] = ("ci",)) -> DataFrame:
    """Resample ``round(mfrac nC)`` regions with replacement; all cells of a drawn region enter,
    each copy with its own prediction draw.  Models without any region fall back to cells."""
    base = cut_lineage(_component_base(df, cfg, block, order))
    comps = cut_lineage(component_table(base))
    drawn, members = _drawn_components(base, comps, cfg)
    copies = drawn.join(members, ["model", "comp_id", "_part"])
    out = _replicate_table(copies, _wet(cfg, F.col("model"), F.col("rep"), F.col("draw"), F.col("cell_id")))
    bare = base.join(comps.select("model").distinct(), "model", "left_anti")
    return out if bare.isEmpty() else out.unionByName(bootstrap_cells(bare, cfg, block, order))


def region_bundles(base: DataFrame, comps: DataFrame, cfg: BootConfig, chunk: int = REGION_CHUNK,
                   count_rows: int = COUNT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Cells and draw counts of bundles of region parts, both keyed by (model, _bundle, _reps).

    A bundle takes about ``chunk`` cells of consecutive regions.  Small regions bring many draw counts, so replicates
    come in blocks ``_reps``, as many as keep the counts of a bundle within ``count_rows``; the cells enter once for
    each block.
    """
    part = F.explode(F.sequence(F.lit(0), _parts(chunk) - 1)).alias("_part")
    bundle = F.floor((F.col("before") + F.col("_part") * chunk) / chunk).cast("long").alias("_bundle")
    parts = cut_lineage(comps.select("model", "comp_id", "before", "cells", part)
                        .select("model", "comp_id", "_part", bundle, _parts(chunk).alias("_parts")))
    most = parts.groupBy("model", "_bundle").count().agg(F.max("count").alias("n")).first()["n"] or 1
    size = min(cfg.n_boot, max(1, count_rows // most))
    blocks = -(-cfg.n_boot // size)
    drawn, _ = _drawn_components(base, comps, cfg, chunk)
    counts = (drawn.groupBy("model", "comp_id", "_part", "rep").agg(F.count(F.lit(1)).cast("int").alias("k"))
              .join(parts, ["model", "comp_id", "_part"])
              .select("model", "_bundle", F.floor(F.col("rep") / size).cast("int").alias("_reps"), "comp_id", "_part", "rep", "k"))
    regions = sized(cut_lineage(comps.select("model", "comp_id", "before", _parts(chunk).alias("_parts"))))
    cells = base.filter("comp_id > 0").join(regions, ["model", "comp_id"])
    cells = cells.withColumn("_part", F.pmod(F.xxhash64("cell_id"), F.col("_parts")).cast("int"))
    cells = cells.select("model", bundle, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_reps"), "comp_id", "_part",
                         F.xxhash64("cell_id").alias("_id"), *_needed(base, cfg))
    return cells, counts


def bootstrap_components_blocked(df: DataFrame, cfg: BootConfig, block: str = "ri", order: Sequence[str] = ("ci",),
                                 chunk: int = REGION_CHUNK, labels: Labels = Labels(),
                                 count_rows: int = COUNT_ROWS, store: bool = True) -> DataFrame:
    """The same resampling without a row per drawn copy.

    A region drawn ``k`` times gives every one of its cells ``k`` independent predictions.  Bundles
    of region parts meet the draw counts of a block of replicates (``region_bundles``) and only sums
    per (model, bundle, replicate) leave them.  A prediction is a hash of (seed, model, replicate,
    copy, cell), so it does not depend on parts, bundles or blocks.  The rows are written before the first of several
    passes; ``store=False`` reads them as they are: right for a stored table.
    """
    base = _component_base(df, cfg, block, order, labels.column)
    base = cut_lineage(base) if store else base
    comps = cut_lineage(component_table(base))
    cells, counts = region_bundles(base, comps, cfg, chunk, count_rows)
    cells = cells.withColumns({"ispb": flag(F.col("ispb")), "ospb": flag(F.col("ospb"))})
    keys = ["model", "_bundle", "_reps"]
    noisy, seed, noise = cfg.pred == "noisy", cfg.seed, cfg.noise
    sums = [*labels.sums("a"), *labels.sums("b")]

    def draw(key, cells, times):
        import numpy as np
        import pyarrow as pa

        model = key[0].as_py()
        kind = pa.schema([("model", pa.string()), ("rep", pa.int32()), *[(c, pa.float64()) for c in sums]])
        if not len(cells) or not len(times):
            return kind.empty_table()
        got = {c: cells.column(c).to_numpy() for c in cells.column_names if c != "model"}
        drawn = {c: times.column(c).to_numpy() for c in ("comp_id", "_part", "rep", "k")}
        masses, ids = labels.matrix(got[labels.column], got["ispb"], got["ospb"]), got["_id"].view("uint64")
        if noisy:
            spread = noise * np.sqrt(np.maximum(got["s_total"].astype("float64") ** 2, EPS))
            gap = got["margin"].astype("float64") - got["gdiff"].astype("float64")
        else:
            pw = got["pw"].astype("float64")
        comp, part = (np.concatenate([got[c], drawn[c]]).astype("int64") for c in ("comp_id", "_part"))
        _, comp = np.unique(comp, return_inverse=True)
        _, code = np.unique(comp * (int(part.max()) + 1) + part, return_inverse=True)
        mine, theirs = code[:len(ids)], code[len(ids):]
        k = np.zeros(int(code.max()) + 1, dtype="int64")
        order = np.argsort(drawn["rep"], kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(drawn["rep"][order]) != 0))
        reps, a, b = [], [], []
        for at in np.split(order, head[1:]):
            rep = int(drawn["rep"][at[0]])
            k[:] = 0
            k[theirs[at]] = drawn["k"][at]
            times_of = k[mine]
            live, seeds, wet = np.flatnonzero(times_of), [seed, zlib.crc32(model.encode()), rep], np.zeros(len(ids))
            for copy in range(int(times_of.max(initial=0))):
                live = live[times_of[live] > copy]
                u = _cell_uniform(seeds, ids[live], copy)
                if noisy:
                    radius = np.sqrt(-2.0 * np.log(np.maximum(u, 2.0**-53)))
                    jitter = radius * np.cos(2.0 * np.pi * _cell_uniform(seeds, ids[live], copy, 1))
                    wet[live] += spread[live] * jitter >= gap[live]
                else:
                    wet[live] += u < pw[live]
            reps.append(rep)
            a.append(times_of @ masses)
            b.append(wet @ masses)
        values = np.concatenate([np.array(a), np.array(b)], axis=1)
        return pa.Table.from_arrays([pa.repeat(model, len(reps)), pa.array(reps, pa.int32()),
                                     *[pa.array(values[:, j]) for j in range(len(sums))]], schema=kind)

    parts = cells.groupBy(*keys).cogroup(counts.groupBy(*keys)).applyInArrow(
        draw, "model string, rep int, " + ", ".join(f"{c} double" for c in sums))
    out = labels.scores(parts.groupBy("model", "rep").agg(*[F.sum(c).alias(c) for c in sums]), ["model", "rep"])
    bare = base.join(comps.select("model").distinct(), "model", "left_anti")
    return out if bare.isEmpty() else out.unionByName(bootstrap_cells_blocked(bare, cfg, block, order, labels))


def bootstrap_cells_hard(df: DataFrame, cfg: BootConfig, labels: Labels = Labels()) -> DataFrame:
    """The cell bootstrap for hard labels (or thresholds) without resampling a cell.

    With labels of few values a draw lands in (prediction, label, area) with probability equal to the mean
    expected mass of that class, so the counts of a replicate are exactly multinomial.  One
    aggregate over the cells is enough; replicates are then drawn from a few class masses.
    """
    base = usable(df, labels.column)
    area = flag(F.col("ispb")).cast("int") + 2 * flag(F.col("ospb")).cast("int")
    mass = base.groupBy("model", F.col(labels.column).cast("int").alias("y"), area.alias("area")).agg(
        F.sum("pw").alias("wet"), F.sum(1.0 - F.col("pw")).alias("dry"), F.count(F.lit(1)).alias("n"))
    classes = mass.groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct("y", "area", "wet", "dry"))).alias("classes"), F.sum("n").alias("n"))
    slots = classes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_boot - 1))))
    seed = cfg.seed

    def draw(frames: Iterator) -> Iterator:
        import numpy as np

        for pdf in frames:
            rows = []
            for model, cls, n, rep in zip(pdf["model"], pdf["classes"], pdf["n"], pdf["rep"]):
                masses = np.array([[max(c["wet"], 0.0), max(c["dry"], 0.0)] for c in cls]).ravel()
                rng = np.random.default_rng([seed, zlib.crc32(model.encode()), int(rep)])
                got = rng.multinomial(int(n), masses / masses.sum()).reshape(-1, 2)
                rows += [(model, int(rep), int(c["y"]), int(c["area"]), int(k[0]), int(k[1])) for c, k in zip(cls, got)]
            yield type(pdf)(rows, columns=["model", "rep", "y", "area", "wet", "dry"])

    counts = slots.select("model", "classes", "n", "rep").mapInPandas(
        draw, "model string, rep int, y int, area int, wet long, dry long")
    masses = labels.masses(F.col("y"), F.col("area") % 2 == 1, F.col("area") >= 2)
    sums = counts.groupBy("model", "rep").agg(
        *[F.sum((F.col("wet") + F.col("dry")) * m).alias(f"a{j}") for j, m in enumerate(masses)],
        *[F.sum(F.col("wet") * m).alias(f"b{j}") for j, m in enumerate(masses)])
    return labels.scores(sums, ["model", "rep"])


# Bands -----------------------------------------------------------------------------------------

def to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS, value: str = "value") -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    return df.selectExpr(*keys, f"stack({len(metrics)}, {pairs}) AS (metric, {value})")


def bands(reps: DataFrame, main: float = 0.95, inner: float = 0.50, by: Sequence[str] = ("model",),
          metrics: Sequence[str] = METRICS) -> DataFrame:
    """Percentile bands per (model, metric); replicates without a value are left out."""
    long = to_long(reps, [*by, "rep"], metrics)
    outer, middle = round((1 - main) / 2, 12), round((1 - inner) / 2, 12)
    ps = {"lo95": outer, "hi95": 1 - outer, "lo50": middle, "hi50": 1 - middle}
    return midpoint_quantile(long, "value", ps, [*by, "metric"]).withColumnRenamed("n", "n_rep")


def gstats(expected: DataFrame, reps: DataFrame, by: Sequence[str] = ("model",), main: float = 0.95,
           inner: float = 0.50, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Expected metrics with their bands: ``(model, metric, exp, lo95, hi95, lo50, hi50)``."""
    exp = to_long(expected, by, metrics, "exp")
    out = exp.join(bands(reps, main, inner, by, metrics), [*by, "metric"], "left")
    return out.select(*by, "metric", "exp", "lo95", "hi95", "lo50", "hi50")


def ci_summary(stats: DataFrame, models: DataFrame | None = None, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Wide table: every metric with its 95 % limits, one row per model."""
    cells = []
    for m in metrics:
        here = F.col("metric") == m
        cells += [F.max(F.when(here, F.col("exp"))).alias(m), F.max(F.when(here, F.col("lo95"))).alias(f"{m}_lo"),
                  F.max(F.when(here, F.col("hi95"))).alias(f"{m}_hi")]
    out = stats.groupBy("model").agg(*cells)
    return out if models is None else out.join(sized(models.select("model", "title")), "model", "left")

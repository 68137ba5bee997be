"""Weighted evaluation of models with uncertainty, and the same swept over truth thresholds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.names import FLAT_PREFIX
from meltgrid.functions.truth import truth_binary, truth_weight
from meltgrid.operators import flats as L
from meltgrid.operators import metrics as M
from meltgrid.operators import resample as R
from meltgrid.operators.components import connected_components
from meltgrid.operators.labelled import Labels
from meltgrid.operators.masks import MaskConfig, with_masks
from meltgrid.operators.models import flat_models, model_center, rank_compare, union_runs
from meltgrid.operators.summaries import calibrate_logistic, coverage_report, summarize, weight_diagnostics
from meltgrid.plans.dataset import clean_layers, flat_rows, listed_rows, with_advection, with_minimum
from meltgrid.session import cut_lineage


@dataclass(frozen=True)
class EvalConfig:
    """Defaults follow the cell-mode evaluation; ``truth`` is ``weighted`` or ``binary``."""

    truth: str = "weighted"
    threshold: float = 0.2
    weight_mode: str = "logistic"
    calibrate: bool = True
    q_low: float = 0.5
    q_high: float = 0.95
    w_low: float = 0.60
    w_high: float = 0.95
    t0: float = 0.2
    tmid: float = 0.6
    k: float = 12.0
    p: float = 2.0
    margin_mode: str = "fixed"
    margin: float = 0.0
    flats: tuple[int, int] | None = (20, 80)
    mode: str = "cells"
    conn: int = 8
    min_size: int = 5
    masks: MaskConfig = field(default_factory=MaskConfig)
    boot: R.BootConfig = field(default_factory=R.BootConfig)
    spread: dict | None = None
    sentinel_as_dry: bool = False
    advection_step: float | None = None


def static_cells(cells: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Cleaned, masked cells with the melt minimum; independent of thresholds and labels.  With a
    grid spacing in ``advection_step`` the advected flux of the cells enters the margins."""
    clean = clean_layers(cells, cfg.sentinel_as_dry)
    if cfg.advection_step is not None:
        clean = with_advection(clean, cfg.advection_step)
    return with_minimum(with_masks(clean, cfg.masks), cfg.spread)


def label_cells(cells: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Hard label ``y`` and soft label ``w``; the logistic is calibrated on the scored cells."""
    tmid, k = cfg.tmid, cfg.k
    if cfg.calibrate:
        cal = calibrate_logistic(cells.filter("roi"), "q", cfg.q_low, cfg.q_high, cfg.w_low, cfg.w_high).first()
        if cal is not None:
            tmid, k = cal["tmid"], cal["k"]
    mode = "logistic" if cfg.calibrate else cfg.weight_mode
    return cells.withColumns({"y": truth_binary(F.col("q"), cfg.threshold),
                              "w": truth_weight(F.col("q"), mode, t0=cfg.t0, tmid=tmid, k=k, p=cfg.p)})


CELL_COLUMNS = ("cell_id", "ri", "ci", "q", "ispb", "ospb", "sink", "comp_id", "y", "w", "gmin", "s_gmin", "delta", "adv")
USED_COLUMNS = ("model", "cell_id", "ri", "ci", "comp_id", "y", "passed", "pw", "ispb", "ospb", "gdiff", "margin", "s_total")
ROW_COLUMNS = ("model", "cell_id", "ri", "ci", "q", "ispb", "ospb", "sink", "comp_id", "y", "w", "gdiff", "s_model", "s_gmin")


def scored_cells(cells: DataFrame) -> DataFrame:
    """Narrow cells of the scored area, written once because every later stage reads them."""
    return cut_lineage(cells.filter("roi").select(*[c for c in CELL_COLUMNS if c in cells.columns]))


def _narrow(rows: DataFrame) -> DataFrame:
    rows = M.with_sigma(rows)
    return rows.select(*[c for c in ROW_COLUMNS if c in rows.columns])


def scored_rows(scored: DataFrame, models: DataFrame) -> DataFrame:
    """Narrow (cell, model) rows of stored models, written once."""
    return cut_lineage(_narrow(listed_rows(scored, models)))


def used_rows(used: DataFrame) -> DataFrame:
    """Rows with their wet probability, written once: expected metrics and replicates filter by it, and a filter of an
    expression is computed apart from its column."""
    return cut_lineage(used.select(*[c for c in USED_COLUMNS if c in used.columns]))


def flats_by_rows(scored: DataFrame, cfg: EvalConfig) -> bool:
    """Flats need rows of their own for the joined bootstrap, where input spreads blur their predictions, and where a
    topographic factor is not positive, so that a larger flat can predict dry where a smaller one predicts wet."""
    if cfg.flats is None:
        return False
    turned = "delta" in scored.columns and not scored.filter(F.col("delta") <= -1).isEmpty()
    return bool(cfg.spread) or cfg.boot.joined or turned


def with_regions(rows: DataFrame, cells: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Region numbers on the cells, before these are multiplied by the models."""
    comps = connected_components(cells.filter(F.coalesce("sink", F.lit(False))).select("ri", "ci"), cfg.conn, cfg.min_size)
    return rows.join(comps, ["ri", "ci"], "left").withColumn("comp_id", F.coalesce("comp_id", F.lit(0)))


def replicates(rows: DataFrame, cfg: EvalConfig, labels: Labels = Labels(), store: bool = True) -> DataFrame:
    """Bootstrap by the cheapest form that is exact for the labels and the mode in use, or by the
    joined form that any SQL engine can repeat where ``cfg.boot.joined`` asks for it.  ``store=False``
    is right for rows of a stored table."""
    if cfg.mode == "components":
        if cfg.boot.joined:
            return R.bootstrap_components(rows, cfg.boot)
        return R.bootstrap_components_blocked(rows, cfg.boot, labels=labels, store=store)
    if cfg.boot.joined:
        return R.bootstrap_cells(rows, cfg.boot)
    if cfg.truth == "binary" and cfg.boot.pred == "bernoulli" and not cfg.boot.balance:
        return R.bootstrap_cells_hard(rows, cfg.boot, labels)
    return R.bootstrap_cells_blocked(rows, cfg.boot, labels=labels)


class Results(Mapping):
    """Result tables by name; a table is planned when it is first asked for, and tables that build
    on each other share their parts."""

    def __init__(self, plans: dict[str, Callable[["Results"], DataFrame]]):
        self._plans, self._made = plans, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._plans[name](self)
        return self._made[name]

    def __iter__(self):
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


def _centers(cells: DataFrame, base: DataFrame, models: DataFrame, cfg: EvalConfig) -> DataFrame:
    viz = base.filter("viz").select("cell_id").join(models.select("cell_id", "model", "g"), "cell_id")
    centers = model_center(cut_lineage(viz.select("model", "g")), store=False)
    if cfg.flats is None:
        return centers
    flats = flat_models(cells.sparkSession, *cfg.flats)
    return centers.unionByName(flats.select("model", F.lit(0).cast("long").alias("n"), F.col("flat_value").alias("center")))


def evaluate(cells: DataFrame, models: DataFrame, cfg: EvalConfig = EvalConfig()) -> Results:
    """All result tables of one evaluation, keyed by name.

    The label calibration, the margins and the shared rows are computed at once; every other table
    only when it is asked for, the replicates among them.
    """
    base = label_cells(static_cells(cells, cfg), cfg)
    if cfg.mode == "components":
        base = with_regions(base, base, cfg)
    scored = scored_cells(base)
    rows = scored_rows(scored, models)
    sigma = M.sigma_summary(rows)
    if cfg.flats is not None:
        sigma = cut_lineage(sigma.unionByName(L.flat_sigma(scored, *cfg.flats)))
    margins = M.margin_table(sigma, cfg.margin_mode, cfg.margin)
    labelled = {"y": F.col("w") if cfg.truth == "weighted" else F.col("y").cast("double")}

    def decide(rows: DataFrame) -> DataFrame:
        return M.decide(rows, margins)

    def with_used(decided: DataFrame) -> DataFrame:
        return M.with_p_wet(decided).withColumns({**labelled, "s_total": M.margin_sigma(F.col("s_model"), F.col("s_gmin"))})

    decided, slots = decide(rows), None
    by_rows = flats_by_rows(scored, cfg)
    if by_rows:
        decided = decided.unionByName(decide(_narrow(flat_rows(scored, models, cfg.flats))))
    elif cfg.flats is not None:
        slots = flat_slots(scored, margins, cfg)

    @cache
    def used() -> DataFrame:
        # Rows of flats are made inside the tasks that read the cells and are not worth a table.
        return with_used(decided) if by_rows else used_rows(with_used(decided))

    def with_flats(listed: DataFrame, made: Callable[[DataFrame], DataFrame], **columns: Column) -> DataFrame:
        return listed if slots is None else listed.unionByName(made(slots.withColumns(columns)))

    return Results({
        "spec_stats": lambda r: summarize(base, "q", {
            "ROI": F.col("roi"), "VIZ": F.col("viz"), "REG": F.col("reg") & F.col("valid")}),
        "coverage": lambda r: coverage_report(base),
        "sigma": lambda r: sigma,
        "suggested_margin": lambda r: M.suggested_margin(sigma),
        "binary": lambda r: with_flats(M.point_metrics(decided, "y"), lambda c: L.flat_points(c, *cfg.flats)),
        "weighted": lambda r: with_flats(M.point_metrics(decided, "w", soft=True),
                                         lambda c: L.flat_expected(c, *cfg.flats), y=F.col("w")),
        "expected": lambda r: with_flats(M.expected_metrics(used()), lambda c: L.flat_expected(c, *cfg.flats), **labelled),
        "replicates": lambda r: with_flats(replicates(used(), cfg, store=by_rows), lambda c: L.replicate_flats(
            c, cfg.boot, *cfg.flats, cfg.mode, hard=cfg.truth == "binary"), **labelled),
        "gstats": lambda r: R.gstats(r["expected"], r["replicates"]),
        "ci_summary": lambda r: R.ci_summary(r["gstats"]),
        "centers": lambda r: _centers(cells, base, models, cfg),
        "weights": lambda r: weight_diagnostics(base.filter("roi")),
        "rank_compare": lambda r: rank_compare(r["binary"], r["weighted"]),
    })


def flat_slots(scored: DataFrame, margins: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Scored cells with their flat slot, written once; all flats have one spread and so one margin."""
    known = margins.filter(F.col("model") == f"{FLAT_PREFIX}{cfg.flats[0]}").first()
    return cut_lineage(L.with_slots(scored, *cfg.flats, cfg.margin if known is None else known["margin"]))


def sweep(cells: DataFrame, models: DataFrame, thresholds: Sequence[float] = (0.10, 0.15, 0.20, 0.25, 0.30),
          cfg: EvalConfig | None = None) -> DataFrame:
    """``gstats`` for every truth threshold from one set of rows and draws.

    A row's labels are the number of thresholds its observation exceeds; sums are kept under that number.  Balanced
    and joined draws depend on the label, so there each threshold has rows of its own.
    """
    if cfg is None:
        cfg = EvalConfig(truth="binary", mode="components", calibrate=False, masks=MaskConfig(gate_sinks=False),
                         boot=R.BootConfig(n_boot=10))
    cfg = replace(cfg, truth="binary", calibrate=False)
    base = label_cells(static_cells(cells, cfg), cfg)
    if cfg.mode == "components":
        base = with_regions(base, base, cfg)
    labels = Labels(tuple(sorted({float(t) for t in thresholds})))
    scored = labels.mark(scored_cells(base))
    rows = labels.mark(scored_rows(scored, models))
    sigma = M.sigma_summary(rows)
    if cfg.flats is not None:
        sigma = cut_lineage(sigma.unionByName(L.flat_sigma(scored, *cfg.flats)))
    margins = M.margin_table(sigma, cfg.margin_mode, cfg.margin)

    def with_used(rows: DataFrame) -> DataFrame:
        used = M.with_p_wet(M.decide(rows, margins))
        return used.withColumn("s_total", M.margin_sigma(F.col("s_model"), F.col("s_gmin")))

    used = with_used(rows)
    by_label = cfg.boot.joined or cfg.boot.balance
    by_rows = cfg.flats is not None and (by_label or flats_by_rows(scored, cfg))
    if by_rows:
        used = used.unionByName(with_used(labels.mark(_narrow(flat_rows(scored, models, cfg.flats)))))
    if by_label:
        return _sweep_by_rows(used, labels.thresholds, cfg)
    used = used if by_rows else used_rows(used)
    expected, reps = labels.expected(used), replicates(used, cfg, labels, store=by_rows)
    if cfg.flats is not None and not by_rows:
        slots = flat_slots(scored, margins, cfg)
        expected = expected.unionByName(L.flat_expected(slots, *cfg.flats, labels))
        reps = reps.unionByName(L.replicate_flats(slots, cfg.boot, *cfg.flats, cfg.mode, labels=labels))
    return R.gstats(expected, reps, ["model", "threshold"])


def _sweep_by_rows(used: DataFrame, thresholds: Sequence[float], cfg: EvalConfig) -> DataFrame:
    runs = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    used = used.withColumn("threshold", runs).withColumns({
        "y": truth_binary(F.col("q"), F.col("threshold")),
        "model": F.concat_ws("@", F.col("threshold").cast("string"), "model")})
    stats = R.gstats(M.expected_metrics(used), replicates(used, cfg))
    return stats.withColumns({"threshold": F.split("model", "@", 2)[0].cast("double"),
                              "model": F.split("model", "@", 2)[1]})

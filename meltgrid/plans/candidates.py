"""Search over candidate fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltgrid.operators import fields as Y
from meltgrid.session import cut_lineage


def search(cells: DataFrame, cands: DataFrame, cfg: Y.FieldConfig = Y.FieldConfig(), *, rounding=(0.25, 0.5, 2.0),
           proxy_gate: float = 0.0, prior: str = "softbox", delta: str | None = None) -> DataFrame:
    """Collapse candidates, drop those below the proxy gate, score the rest, weigh by the prior."""
    unique = Y.dedupe_candidates(cands, rounding, cfg.nonneg).select("mu", "a", "theta")
    cells = Y.field_cells(cells, delta)
    if proxy_gate > 0:
        gate = Y.proxy_score(cells, unique, cfg, delta, store=False).filter(F.col("proxy") >= proxy_gate)
        unique = cut_lineage(gate.select("mu", "a", "theta"))
    scores = Y.score_candidates(cells, unique, cfg, delta, store=False)
    return Y.posterior_grid(Y.log_prior(scores, prior, floor=cfg.floor, cap=cfg.cap, nonneg=cfg.nonneg), cfg.beta)

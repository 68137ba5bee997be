"""Metric-against-centre tables behind the figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from meltgrid.operators.models import metric_vs_center


def metric_table(gstats: DataFrame, centers: DataFrame, metric: str, excluded: Sequence[str] = ()) -> DataFrame:
    return metric_vs_center(gstats, centers, metric, excluded)

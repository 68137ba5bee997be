"""What a cell's label adds to confusion sums, for a soft label or for many truth thresholds at once.

A soft label gives four masses: wet, dry, wet in the inner area, dry in the outer one.  Under a list of truth
thresholds all labels of a cell are one number, how many thresholds its observation exceeds; its mass is kept under
that number, and totals from a number upwards or downwards give every threshold.  So no row is repeated for a
threshold.  Sums are named ``a<j>`` over all cells and ``b<j>`` over those predicted wet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.mathx import clamp
from meltgrid.operators.masks import flag
from meltgrid.operators.metrics import with_regional, with_scores
from meltgrid.operators.ordered import constants

#: Column that holds how many thresholds a cell exceeds.
PASSED = "passed"
SUMS = ("tp", "fp", "tn", "fn", "_wn", "_wd", "_dn", "_dd")


@dataclass(frozen=True)
class Labels:
    """Labels in column ``y`` (0 to 1), or those of ascending ``thresholds`` in column ``passed``."""

    thresholds: tuple[float, ...] = ()

    @property
    def column(self) -> str:
        return PASSED if self.thresholds else "y"

    @property
    def width(self) -> int:
        return 3 * (len(self.thresholds) + 1) if self.thresholds else 4

    @property
    def keys(self) -> list[str]:
        return ["threshold"] if self.thresholds else []

    def mark(self, df: DataFrame, q: str = "q") -> DataFrame:
        """Add the number of thresholds exceeded; none for a missing observation."""
        above = [F.coalesce((F.col(q) > t).cast("int"), F.lit(0)) for t in self.thresholds]
        return df.withColumn(PASSED, sum(above[1:], above[0]))

    def masses(self, label: Column | None = None, inner: Column | None = None, outer: Column | None = None) -> list[Column]:
        """Masses of a row; a missing area flag counts as outside."""
        label = F.col(self.column) if label is None else label
        inner, outer = (flag(F.col(c)) if given is None else given for c, given in (("ispb", inner), ("ospb", outer)))
        if not self.thresholds:
            y = clamp(label.cast("double"), 0.0, 1.0)
            return [y, 1.0 - y, F.when(inner, y).otherwise(0.0), F.when(outer, 1.0 - y).otherwise(0.0)]
        out = []
        for k in range(len(self.thresholds) + 1):
            out += [(label == k).cast("double"), ((label == k) & inner).cast("double"), ((label == k) & outer).cast("double")]
        return out

    def matrix(self, label, inner, outer):
        """The same masses of many cells as an array of rows."""
        import numpy as np

        if not self.thresholds:
            y = np.clip(label.astype("float64"), 0.0, 1.0)
            return np.stack([y, 1.0 - y, y * inner, (1.0 - y) * outer], axis=1)
        out = np.zeros((len(label), self.width))
        at = 3 * label.astype("int64")
        row = np.arange(len(label))
        out[row, at] = 1.0
        out[row, at + 1] = inner
        out[row, at + 2] = outer
        return out

    def sums(self, side: str) -> list[str]:
        return [f"{side}{j}" for j in range(self.width)]

    def scores(self, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Confusion, scores and regional recalls per ``keys`` (and threshold) from the sums."""
        if not self.thresholds:
            wet, dry, into, out = ((F.col(f"a{j}"), F.col(f"b{j}")) for j in range(4))
            made = sums.select(*keys, wet[1].alias("tp"), dry[1].alias("fp"), (dry[0] - dry[1]).alias("tn"),
                               (wet[0] - wet[1]).alias("fn"), into[1].alias("_wn"), into[0].alias("_wd"),
                               (out[0] - out[1]).alias("_dn"), out[0].alias("_dd"))
            return with_regional(with_scores(made))
        n = len(self.thresholds)
        packed = sums.select(*keys, *[F.array(*[F.col(f"{s}{3 * k + part}") for k in range(n + 1)]).alias(f"_{s}{part}")
                                      for s in "ab" for part in range(3)],
                             F.explode(constants([{"i": i, "t": float(t)} for i, t in enumerate(self.thresholds)])).alias("_t"))
        i = F.col("_t.i")

        def above(c: str) -> Column:
            return F.aggregate(F.slice(c, i + 2, F.lit(n + 1)), F.lit(0.0), lambda x, v: x + v)

        def below(c: str) -> Column:
            return F.aggregate(F.slice(c, F.lit(1), i + 1), F.lit(0.0), lambda x, v: x + v)

        made = packed.select(*keys, F.col("_t.t").alias("threshold"), above("_b0").alias("tp"), below("_b0").alias("fp"),
                             (below("_a0") - below("_b0")).alias("tn"), (above("_a0") - above("_b0")).alias("fn"),
                             above("_b1").alias("_wn"), above("_a1").alias("_wd"),
                             (below("_a2") - below("_b2")).alias("_dn"), below("_a2").alias("_dd"))
        return with_regional(with_scores(made))

    def expected(self, rows: DataFrame, by: Sequence[str] = ("model",), pw: str = "pw") -> DataFrame:
        """Expected metrics under the wet probability; rows without one are left out."""
        kept = rows.filter(F.col(pw).isNotNull() & F.col(self.column).isNotNull())
        return self.scores(self.totals(kept, by, pw), [*by, "n_roi"])

    def totals(self, rows: DataFrame, by: Sequence[str], pw: str | None = None) -> DataFrame:
        """Number of rows ``n_roi`` and the sums ``a`` per ``by``, with a wet probability also the sums ``b``.

        Labels of thresholds are few, so their rows are counted by label and area, and masses are made of the counts.
        """
        if not self.thresholds:
            wet, one, masses = None if pw is None else F.col(pw), F.lit(1.0), self.masses()
            number = F.count(F.lit(1))
        else:
            inner, outer = (flag(F.col(c)) for c in ("ispb", "ospb"))
            rows = rows.groupBy(*by, F.col(self.column).alias("_k"), inner.alias("_in"), outer.alias("_out")).agg(
                F.count(F.lit(1)).alias("_n"), *([] if pw is None else [F.sum(pw).alias("_p")]))
            wet, one, masses = None if pw is None else F.col("_p"), F.col("_n"), self.masses(F.col("_k"), F.col("_in"), F.col("_out"))
            number = F.sum("_n")
        return rows.groupBy(*by).agg(number.alias("n_roi"), *[F.sum(one * m).alias(f"a{j}") for j, m in enumerate(masses)],
                                     *([] if wet is None else [F.sum(wet * m).alias(f"b{j}") for j, m in enumerate(masses)]))

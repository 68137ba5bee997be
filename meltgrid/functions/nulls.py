"""Missing-value rule.

Arrays in the source domain mark missing cells by NaN or a sentinel.  Here every missing value
becomes NULL at ingest, because Spark orders NaN above all numbers (``NaN >= 0`` is true) while
``greatest`` / ``least`` / ``avg`` skip NULL, which is the behaviour the metrics rely on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = 9999.0
NODATA = -9999.0


def finite(c: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite; never NULL.

    One comparison is enough because NaN sorts above infinity.
    """
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def clean(c: Column, sentinels: Sequence[float] = (SENTINEL,), nonpositive: bool = False) -> Column:
    """NULL for non-finite values, listed sentinels and, on request, values <= 0."""
    keep = finite(c)
    if sentinels:
        keep = keep & ~c.isin([float(s) for s in sentinels])
    if nonpositive:
        keep = keep & (c > 0)
    return F.when(keep, c)


def at_least(c: Column, threshold: Column | float) -> Column:
    """``c >= threshold`` with missing values counted as not reaching it."""
    return F.coalesce(c >= threshold, F.lit(False))

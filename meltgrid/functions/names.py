"""Model-name handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT_PREFIX = "Flat_"


def is_flat(name: Column) -> Column:
    return name.startswith(FLAT_PREFIX)


def flat_value(name: Column) -> Column:
    """Number carried by a ``Flat_<v>`` name, else NULL."""
    digits = F.regexp_extract(name, rf"^{FLAT_PREFIX}([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(digits != "", digits.cast("double"))


def valid_name(name: Column) -> Column:
    """Identifier form of a name: words joined with a capital, odd characters to ``_``, a letter
    first."""
    words = F.split(name, r"\s+")
    joined = F.array_join(F.transform(words, lambda w, i: F.when(
        i > 0, F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)), "")
    safe = F.regexp_replace(joined, r"[^A-Za-z0-9_]", "_")
    return F.when(safe.rlike("^[A-Za-z]"), safe).otherwise(F.concat(F.lit("x"), safe))


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def with_name_parts(df, col: str = "model"):
    c = F.col(col)
    return df.withColumns({
        "is_flat": is_flat(c), "flat_value": flat_value(c),
        "valid_name": valid_name(c), "name_key": name_key(c),
    })

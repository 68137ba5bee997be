"""Frames shared by several queries, each with the text of its checking counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.mathx import ERF_A, ERF_P
from meltgrid.functions.nulls import clean
from meltgrid.functions.physics import gdiff, gmin
from meltgrid.functions.truth import truth_binary, truth_weight
from meltgrid.operators.masks import MaskConfig, with_masks
from meltgrid.operators.metrics import with_sigma
from registry.fixtures import Tables

# Grid of the derived cells: 125 columns, 100 m spacing.
NCOLS = 125
STEP = 100.0


def clean_cells(t: Tables) -> DataFrame:
    return t.cells.withColumn("q", clean(F.col("q")))


def masked(t: Tables, cfg: MaskConfig = MaskConfig()) -> DataFrame:
    return with_masks(clean_cells(t), cfg)


def roi(t: Tables, cfg: MaskConfig = MaskConfig()) -> DataFrame:
    return masked(t, cfg).filter("roi")


def labelled(t: Tables, cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """Scored cells with both labels, the melt minimum and its spread."""
    return roi(t, cfg).withColumns({
        "y": truth_binary(F.col("q"), 0.2), "w": truth_weight(F.col("q"), "logistic", tmid=0.25, k=20.0),
        "gmin": gmin(F.col("h"), F.col("ts"), F.col("mb")),
        "s_gmin": F.when(F.col("custkey") % 5 == 0, 0.0).otherwise(3.0 + 20.0 * F.col("mb"))})


def scored(t: Tables, cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """Scored (cell, model) rows with the heat-flow margin and the model spread."""
    df = labelled(t, cfg).join(t.model_cells, "cell_id")
    return with_sigma(df.withColumn("gdiff", gdiff(F.col("g"), F.col("gmin"))))


CLEAN = """clean AS (SELECT * EXCLUDE (q), CASE WHEN q <> 9999e0 THEN q END AS q FROM cells)"""

MASKED = CLEAN + """,
masked AS (SELECT *, q IS NOT NULL AND h IS NOT NULL AND icevel IS NOT NULL AS valid,
  q IS NOT NULL AND h IS NOT NULL AND icevel IS NOT NULL AND icevel <= 10 AS slow FROM clean),
roi AS (SELECT * FROM masked WHERE slow AND coalesce(sink, false))"""


def gmin_sql(h: str = "h", ts: str = "ts", mb: str = "mb") -> str:
    def lam(i: str) -> str:
        z = f"(1e0 - 5e-2 * ({i}))"
        return f"((pow({z}, 6) - 1e0) / 4e0 / 6e0 - 5e0 * (pow({z}, 2) - 1e0) / 2e0 / 4e0 + {z} - 1e0)"

    terms = (f"list_sum(list_transform(range(1, 21), lambda i: 5e-2 * exp(5e-1 * ({lam('i')} + {lam('i - 1')})"
             f" * {h} * {mb} * (910e0 * 2009e0 / (2.1e0 * 31556926e0)))))")
    den = f"({h} * {terms})"
    return (f"CASE WHEN abs({den}) >= 1e-8 THEN 2.1e0 * 31556926e0 * (273.15e0 - 8.7e-4 * {h} - {ts}) / {den}"
            f" / 31556926e0 * 1e3 END")


LABELLED = MASKED + f""",
labelled AS (SELECT *, CASE WHEN q > 2e-1 THEN 1 ELSE 0 END AS y,
  CASE WHEN q IS NULL THEN 0e0 ELSE 1e0 / (1e0 + exp(-(2e1 * (q - 25e-2)))) END AS w,
  {gmin_sql()} AS gmin,
  CASE WHEN custkey % 5 = 0 THEN 0e0 ELSE 3e0 + 2e1 * mb END AS s_gmin FROM roi)"""

SCORED = LABELLED + """,
scored AS (SELECT l.*, model, g, sigma, bmin, bmax, g - gmin AS gdiff,
  coalesce(sigma, abs(bmax - bmin) / (2e0 * 1.96e0), 0e0) AS s_model,
  CASE WHEN sigma IS NOT NULL THEN 'cell' WHEN bmax IS NOT NULL THEN 'bounds' ELSE 'none' END AS sigma_source
  FROM labelled l JOIN model_cells m ON l.cell_id = m.cell_id)"""


def erf_sql(x: str) -> str:
    t = f"(1e0 / (1e0 + {ERF_P}e0 * abs({x})))"
    poly = f"({ERF_A[0]}e0 * {t}" + "".join(
        f" + {a}e0 * pow({t}, {i + 2})" for i, a in enumerate(ERF_A[1:])) + ")"
    return f"(sign({x}) * (1e0 - {poly} * exp(-pow({x}, 2))))"


def phi_sql(z: str) -> str:
    return f"(5e-1 * (1e0 + {erf_sql(f'(({z}) / sqrt(2e0))')}))"


def uniform_sql(key: str) -> str:
    return f"(cast(cast('0x' || substring(md5({key}), 1, 13) AS bigint) AS double) / 4503599627370496e0)"


def quantile_sql(src: str, col: str, ps: dict[str, float], by: str = "") -> str:
    """Midpoint quantiles of ``col`` over ``src`` by sorting."""
    part = f"PARTITION BY {by}" if by else ""
    cols = []
    for name, p in ps.items():
        pos = f"least(greatest(n * {p!r}e0 + 5e-1, 1e0), n)" if "e" not in repr(p) else f"least(greatest(n * {p!r} + 5e-1, 1e0), n)"
        lo, hi = f"floor({pos})", f"least(floor({pos}) + 1, n)"
        a = f"max(CASE WHEN rn = {lo} THEN v END)"
        b = f"max(CASE WHEN rn = {hi} THEN v END)"
        cols.append(f"{a} + max({pos} - {lo}) * ({b} - {a}) AS {name}")
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return (f"SELECT {keys}cast(max(n) AS bigint) AS n, {', '.join(cols)} FROM (SELECT {keys}{col} AS v, "
            f"row_number() OVER ({part} ORDER BY {col}) AS rn, count(*) OVER ({part}) AS n FROM {src} "
            f"WHERE {col} IS NOT NULL) {group}")


def score_sql(src: str = "c") -> str:
    """Score columns from tp, fp, tn, fn of ``src`` as a full SELECT list."""
    eps = "2.220446049250313e-16"
    return (f"SELECT *, 2e0 * prec * rec / greatest(prec + rec, {eps}) AS f1, "
            f"sqrt(greatest(rec, 0e0) * greatest(spec, 0e0)) AS g_mean, rec * spec AS g_prod FROM ("
            f"SELECT *, (tp + tn) / greatest(tp + fp + tn + fn, {eps}) AS acc, "
            f"tp / greatest(tp + fp, {eps}) AS prec, tn / greatest(tn + fp, {eps}) AS spec, "
            f"tp / greatest(tp + fn, {eps}) AS rec FROM {src})")


REGIONAL_SUMS = """sum(CASE WHEN ispb THEN {p} * {y} END) AS wn, sum(CASE WHEN ispb THEN {y} END) AS wd,
  sum(CASE WHEN ospb THEN (1e0 - {p}) * (1e0 - {y}) END) AS dn, sum(CASE WHEN ospb THEN 1e0 - {y} END) AS dd"""


def regional_sql(src: str) -> str:
    return (f"SELECT * EXCLUDE (wn, wd, dn, dd), sqrt(rec_in_wet * rec_out_dry) AS g_regional FROM ("
            f"SELECT *, CASE WHEN wd > 0 THEN wn / wd END AS rec_in_wet, "
            f"CASE WHEN dd > 0 THEN dn / dd END AS rec_out_dry FROM {src})")


HARD = """cast(count(*) FILTER (pred AND y = 1) AS bigint) AS tp, cast(count(*) FILTER (pred AND y <> 1) AS bigint) AS fp,
  cast(count(*) FILTER (NOT pred AND y <> 1) AS bigint) AS tn, cast(count(*) FILTER (NOT pred AND y = 1) AS bigint) AS fn"""

SOFT = """sum({p} * {y}) AS tp, sum({p} * (1e0 - {y})) AS fp,
  sum((1e0 - {p}) * (1e0 - {y})) AS tn, sum((1e0 - {p}) * {y}) AS fn"""
SCORE_COLS = ("acc", "prec", "spec", "rec", "f1", "g_mean", "g_prod")
MASS_COLS = ("tp", "fp", "tn", "fn")
REG_COLS = ("rec_in_wet", "rec_out_dry", "g_regional")

"""Synthetic candidate fields: construction, gating, scoring, priors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltgrid.functions.mathx import EPS, clamp
from meltgrid.functions.nulls import at_least, finite
from meltgrid.operators.masks import flag
from meltgrid.operators.ordered import constants, midpoint_quantile, prefix_sums, value_counts
from meltgrid.session import cut_lineage

#: Candidates of one pass: as rows of every cell, and as positions in a lattice.
CHUNK, LATTICE = 1000, 50_000
#: Means of one amplitude and azimuth, on average, from which a search replaces a row for each.
MEANS = 4
#: Rows of one candidate, and of all in a pass, that are sorted for a median.
RANK_ROWS, SORTED_ROWS = 4096, 4_096_000


@dataclass(frozen=True)
class FieldConfig:
    """Gating and scoring of candidate fields."""

    floor: float | None = 20.0
    cap: float | None = 100.0
    enforce_mean: bool = True
    margin: float = 0.0
    truth: str = "weighted"
    beta: float = 6.0
    nonneg: bool = False


@dataclass(frozen=True)
class Ramp:
    """Constants of the unit ramp along one azimuth over one set of cells."""

    nx: float
    ny: float
    xm: float
    ym: float
    mid: float
    span: float
    mean_factor: float
    mean_ramp: float

    def column(self) -> Column:
        if self.span == 0.0:
            return F.lit(0.0)
        p = (F.col("x_m") - self.xm) * self.nx + (F.col("y_m") - self.ym) * self.ny
        return 2.0 * (p - self.mid) / self.span


def azimuth(theta_deg: float, a: float, perpendicular: bool = False) -> tuple[float, float]:
    """Azimuth and half-range with the sign of the amplitude turned into direction."""
    phi = theta_deg - 90.0 if perpendicular else theta_deg
    return (phi + 180.0, -a) if a < 0 else (phi, a)


def ramp_constants(cells: DataFrame, thetas: Sequence[float], delta: str | None = None) -> dict[float, Ramp]:
    """Ramp constants for many azimuths from one pass over the cells.

    On one grid line the projection is largest or smallest at the line's ends, so each line is
    reduced to its ends and sums first; azimuths only meet those few rows.
    """
    x, y = F.col("x_m"), F.col("y_m")
    factor = 1.0 + F.col(delta) if delta else F.lit(1.0)
    known = F.when(factor.isNotNull(), 1.0)
    lines = cells.groupBy("y_m").agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"),
        F.sum(known).alias("nf"), F.sum(factor).alias("sf"), F.sum(x * factor).alias("sxf"))
    angle = F.explode(constants([
        {"theta": float(th), "nx": math.cos(math.radians(th)), "ny": math.sin(math.radians(th))} for th in thetas]))
    wide = lines.withColumn("a", angle)
    ends = [F.col(e) * F.col("a.nx") + y * F.col("a.ny") for e in ("x0", "x1")]
    rows = wide.groupBy("a.theta", "a.nx", "a.ny").agg(
        F.min(F.least(*ends)).alias("p0"), F.max(F.greatest(*ends)).alias("p1"), F.sum("n").alias("n"),
        F.sum("sx").alias("sx"), F.sum(y * F.col("n")).alias("sy"), F.sum("nf").alias("nf"),
        F.sum("sf").alias("sf"), F.sum("sxf").alias("sxf"), F.sum(y * F.col("sf")).alias("syf")).collect()
    out = {}
    for r in rows:
        xm, ym = r["sx"] / r["n"], r["sy"] / r["n"]
        centre = xm * r["nx"] + ym * r["ny"]
        p0, p1 = r["p0"] - centre, r["p1"] - centre
        mid, span = (p0 + p1) / 2.0, p1 - p0
        mean_factor = r["sf"] / r["nf"] if r["nf"] else 1.0
        proj = ((r["sxf"] - xm * r["sf"]) * r["nx"] + (r["syf"] - ym * r["sf"]) * r["ny"] - mid * r["sf"])
        mean_ramp = 0.0 if span == 0.0 or not r["nf"] else 2.0 * proj / span / r["nf"]
        out[r["theta"]] = Ramp(r["nx"], r["ny"], xm, ym, mid, span, mean_factor, mean_ramp)
    return out


def gradient_field(cells: DataFrame, mu: float, a: float, theta_deg: float, name: str = "g_syn",
                   perpendicular: bool = False) -> DataFrame:
    """Field ``mu + a U`` with ``U`` in [-1, 1] along an azimuth."""
    phi, half = azimuth(theta_deg, a, perpendicular)
    return cells.withColumn(name, mu + half * ramp_constants(cells, [phi])[phi].column())


def gate_field(df: DataFrame, col: str, lo: float | None, hi: float | None, mu: float | None) -> DataFrame:
    """Limit to [lo, hi]; with a target mean, move by its distance from the mean before limiting
    and limit once more."""
    gated = clamp(F.col(col), lo, hi)
    if mu is not None:
        before = df.agg(F.avg(col)).first()[0]
        gated = clamp(gated - before + mu, lo, hi)
    return df.withColumn(col, gated)


def clamp_exact_mean(df: DataFrame, col: str, mu: float, lo: float, hi: float) -> DataFrame:
    """Limit to [lo, hi] after adding the offset that makes the mean equal ``mu``.

    The sum of limited values is piecewise linear in the offset: a value starts to rise at ``lo - v`` and stops at
    ``hi - v``.  Running totals over these breaks give slope and height at every break, so the offset follows from the
    last break below the target, in a fixed number of passes.  Equal breaks collapse before they are sorted.
    """
    if mu <= lo or mu >= hi:
        edge = lo if mu <= lo else hi
        return df.withColumn(col, F.when(F.col(col).isNotNull(), F.lit(float(edge))))
    known = df.filter(F.col(col).isNotNull())
    e = known.agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mid")).first()
    if not e["n"]:
        return df
    # Breaks are counted from the offset that would move the plain mean, which keeps the sums small.
    base = mu - e["mid"]
    breaks = F.explode(F.array(F.struct((lo - F.col(col) - base).alias("b"), F.lit(1).alias("d")),
                               F.struct((hi - F.col(col) - base).alias("b"), F.lit(-1).alias("d"))))
    steps = value_counts(known.select(breaks.alias("s")).select("s.b", "s.d"), [], "b", {"d": F.col("d")})
    run = prefix_sums(steps.withColumn("m", F.col("d") * F.col("b")), [], "b", ["d", "m"])
    height = F.col("b") * F.col("cum_d") - F.col("cum_m")
    last = (run.withColumn("h", height).filter(F.col("h") <= (mu - lo) * e["n"])
            .agg(F.max(F.struct("b", "h", "cum_d")).alias("x")).first()["x"])
    offset = base + last["b"] + (((mu - lo) * e["n"] - last["h"]) / last["cum_d"] if last["cum_d"] else 0.0)
    return df.withColumn(col, clamp(F.col(col) + offset, lo, hi))


# Candidate tables ------------------------------------------------------------------------------

def dedupe_candidates(cands: DataFrame, steps: tuple[float, float, float] = (0.25, 0.5, 2.0),
                      nonneg: bool = False) -> DataFrame:
    """Collapse candidates that fall on one rounding key; the key itself is the candidate."""
    a = F.greatest("a", F.lit(0.0)) if nonneg else F.col("a")
    keys = [(F.round(c / s) * s + 0.0).alias(n) for c, s, n in zip((F.col("mu"), a, F.col("theta")), steps, ("mu", "a", "theta"))]
    return cands.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def softbox(x: Column, lo: float, hi: float, k: float) -> Column:
    return F.when(x < lo, F.pow((lo - x) / k, F.lit(2.0))).when(x > hi, F.pow((x - hi) / k, F.lit(2.0))).otherwise(0.0)


def wrap_angle(x: Column, centre: float) -> Column:
    """Angle moved by whole turns to within half a turn of ``centre``."""
    up, down = F.ceil((x - centre - 180.0) / 360.0), F.ceil((centre - 180.0 - x) / 360.0)
    return F.when(x > centre + 180.0, x - 360.0 * up).when(x < centre - 180.0, x + 360.0 * down).otherwise(x)


def clip_fraction(mu: Column, a: Column, floor: float | None, cap: float | None) -> Column:
    """Approximate share of the ramp outside the physical limits."""
    half = F.greatest(F.abs(a), F.lit(EPS))
    parts = [F.lit(0.0)]
    if floor is not None:
        parts.append(F.least(F.greatest(F.least(F.lit(1.0), (floor - mu) / half) + 1.0, F.lit(0.0)) / 2.0, F.lit(1.0)))
    if cap is not None:
        parts.append(F.least(F.greatest(1.0 - F.greatest(F.lit(-1.0), (cap - mu) / half), F.lit(0.0)) / 2.0, F.lit(1.0)))
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def log_prior(df: DataFrame, kind: str = "softbox", *, mu_range=(20.0, 150.0), a_range=(-150.0, 150.0),
              theta_range=(-90.0, 90.0), soft_k: float = 3.0, floor: float | None = 20.0,
              cap: float | None = 100.0, clip_k: float | None = 0.15, theta: str = "theta",
              nonneg: bool = False) -> DataFrame:
    """Add ``log_prior`` to a table of ``mu, a, theta``; ``clip_k=None`` drops the clip penalty.
    ``nonneg`` judges a negative amplitude as zero, in the prior and in the clipped share."""
    a = F.greatest("a", F.lit(0.0)) if nonneg else F.col("a")
    cols = ((F.col("mu"), mu_range), (a, a_range), (F.col(theta), theta_range))
    if kind == "softbox":
        lp = -reduce(lambda p, q: p + q, [softbox(c, *rg, soft_k) for c, rg in cols])
    elif kind == "gaussian":
        def term(c: Column, rg) -> Column:
            return -0.5 * F.pow((c - (rg[0] + rg[1]) / 2.0) / ((rg[1] - rg[0]) / 2.0), F.lit(2.0))
        turned = wrap_angle(F.col(theta), (theta_range[0] + theta_range[1]) / 2.0)
        lp = term(cols[0][0], mu_range) + term(cols[1][0], a_range) + term(turned, theta_range)
    else:
        raise ValueError(f"unknown prior: {kind}")
    if clip_k is not None:
        share = clip_fraction(F.col("mu"), a, floor, cap)
        lp = lp - share * share / max(1e-6, clip_k)
    return df.withColumn("log_prior", lp)


# Scoring ---------------------------------------------------------------------------------------

def _chunks(cands: DataFrame, cfg: FieldConfig, size: int | None = None) -> Iterator[list[tuple[float, float, float]]]:
    """Distinct candidates, those of one amplitude and azimuth together, in chunks of bounded size."""
    a = F.greatest("a", F.lit(0.0)) if cfg.nonneg else F.col("a")
    rows = cands.select("mu", a.alias("a"), "theta").distinct().orderBy("theta", "a", "mu").toLocalIterator()
    while part := [tuple(r) for r in islice(rows, size or CHUNK)]:
        yield part


def _passes(cands: DataFrame, cfg: FieldConfig, delta: str | None) -> Iterator[tuple[list[tuple[float, float, float]], bool]]:
    """Candidates of one pass, and whether their means form lattices that repay a search."""
    for part in _chunks(cands, cfg, LATTICE):
        if delta is None and len(part) >= MEANS * len({p[1:] for p in part}):
            yield part, True
        else:
            yield from ((part[i:i + CHUNK], False) for i in range(0, len(part), CHUNK))


def _add_ramps(known: dict[float, Ramp], cells: DataFrame, part, delta: str | None) -> None:
    """Constants of the azimuths that no earlier chunk had."""
    fresh = sorted({p[2] for p in part} - known.keys())
    if fresh:
        known.update(ramp_constants(cells, fresh, delta))


def _gated(mu, a, u, shift, cfg: FieldConfig, factor: Column | None):
    """Field value as a column; the same arithmetic serves single numbers in ``_gated_value``."""
    raw = mu + a * u
    if factor is not None:
        raw = raw * factor
    g = clamp(raw, cfg.floor, cfg.cap)
    return clamp(g - shift + mu, cfg.floor, cfg.cap) if cfg.enforce_mean else g


def _gated_value(mu: float, a: float, u: float, shift: float, cfg: FieldConfig) -> float:
    def lim(v: float) -> float:
        v = v if cfg.floor is None else max(v, cfg.floor)
        return v if cfg.cap is None else min(v, cfg.cap)

    g = lim(mu + a * u)
    return lim(g - shift + mu) if cfg.enforce_mean else g


def _candidate_structs(part, ramps: dict[float, Ramp], extra: dict | None = None) -> Column:
    """Constant array of candidates with their ramp constants; no table is joined."""
    items = []
    for i, (mu, a, th) in enumerate(part):
        r = ramps[th]
        shift = mu * r.mean_factor + a * r.mean_ramp
        fields = {"id": i, "mu": mu, "a": a, "nx": r.nx, "ny": r.ny, "mid": r.mid,
                  "span": r.span if r.span else 1.0, "on": 0.0 if r.span == 0.0 else 2.0, "shift": shift}
        fields.update({k: v[i] for k, v in (extra or {}).items()})
        items.append({k: v if k == "id" else float(v) for k, v in fields.items()})
    return constants(items)


def _field_rows(cells: DataFrame, part, ramps, cfg: FieldConfig, keep: Sequence[str], delta: str | None,
                extra: dict | None = None) -> DataFrame:
    """(cell, candidate) rows with the gated field; they exist only inside a map task and are
    summed there per candidate before anything is shuffled."""
    r0 = next(iter(ramps.values()))
    dx, dy = F.col("x_m") - r0.xm, F.col("y_m") - r0.ym
    c = F.col("c")
    rows = cells.select(dx.alias("_dx"), dy.alias("_dy"), *keep, *([delta] if delta else []),
                        F.explode(_candidate_structs(part, ramps, extra)).alias("c"))
    u = c["on"] * (F.col("_dx") * c["nx"] + F.col("_dy") * c["ny"] - c["mid"]) / c["span"]
    factor = 1.0 + F.col(delta) if delta else None
    return rows.withColumn("g", _gated(c["mu"], c["a"], u, c["shift"], cfg, factor))


def _rank_rows(groups: int) -> int:
    """Rows of a group that may be sorted: few groups may have more, which saves rounds over all cells."""
    return max(RANK_ROWS, SORTED_ROWS // groups)


def field_cells(cells: DataFrame, delta: str | None = None) -> DataFrame:
    """What candidate fields need of the cells, written once: every pass over the candidates reads it."""
    names = ("x_m", "y_m", "gmin", "roi", "spec_valid", "y", "w", delta)
    return cut_lineage(cells.select(*[c for c in dict.fromkeys(names) if c in cells.columns]))


def _middle_ramps(cells: DataFrame, ramps: dict[float, Ramp]) -> dict[float, tuple[int, float, float]]:
    """Per azimuth: number of cells and the two middle projections.

    Without a topographic factor the gated field is monotone in the projection, so the median
    over cells follows from these for every mean and amplitude at once.
    """
    r0 = next(iter(ramps.values()))
    dirs = F.explode(constants([{"theta": float(th), "nx": r.nx, "ny": r.ny} for th, r in ramps.items()]))
    rows = cells.select((F.col("x_m") - r0.xm).alias("_dx"), (F.col("y_m") - r0.ym).alias("_dy"), dirs.alias("d"))
    rows = rows.select(F.col("d.theta").alias("theta"),
                       (F.col("_dx") * F.col("d.nx") + F.col("_dy") * F.col("d.ny")).alias("p"))
    mid = midpoint_quantile(rows, "p", {"m": 0.5}, ["theta"], _rank_rows(len(ramps)), pairs=True, store=False).collect()
    return {r["theta"]: (r["n"], r["m_lo"], r["m_hi"] if r["n"] % 2 == 0 else r["m_lo"]) for r in mid}


def _medians(cells: DataFrame, part, ramps, cfg: FieldConfig, delta: str | None,
             middle: dict[float, tuple[int, float, float]]) -> list[float | None]:
    """Median of each candidate's field over the given cells.

    Values exist in map tasks only: ranks are narrowed by counts, and the passes compute the field
    again.  ``middle`` keeps the azimuths that an earlier chunk has looked up.
    """
    if delta is not None:
        rows = _field_rows(cells, part, ramps, cfg, [], delta).select(F.col("c.id").alias("id"), "g")
        found = {r["id"]: r["m"] for r in midpoint_quantile(rows, "g", {"m": 0.5}, ["id"], _rank_rows(len(part)), store=False).collect()}
        return [found.get(i) for i in range(len(part))]
    fresh = {th: ramps[th] for th in {p[2] for p in part} if th not in middle}
    if fresh:
        middle.update(_middle_ramps(cells, fresh))
    out = []
    for mu, a, th in part:
        if th not in middle:
            out.append(None)
            continue
        r = ramps[th]
        shift = mu * r.mean_factor + a * r.mean_ramp
        on, span = (0.0, 1.0) if r.span == 0.0 else (2.0, r.span)
        lo, hi = (_gated_value(mu, a, on * (p - r.mid) / span, shift, cfg) for p in middle[th][1:])
        out.append(lo if lo == hi else lo + 0.5 * (hi - lo))
    return out


def _lattice(part, ramps: dict[float, Ramp], cfg: FieldConfig) -> list[dict]:
    """Candidates by (amplitude, azimuth): ascending means, their positions in ``part``, and the ramp's constants."""
    by: dict[tuple[float, float], list[tuple[float, int]]] = {}
    for i, (mu, a, th) in enumerate(part):
        by.setdefault((a, th), []).append((mu, i))
    out = []
    for (a, th), means in by.items():
        r, means = ramps[th], sorted(means)
        moved = a * r.mean_ramp if cfg.enforce_mean else 0.0
        floor, cap = -math.inf if cfg.floor is None else cfg.floor, math.inf if cfg.cap is None else cfg.cap
        # Both limits and the move between them are one limit of mu + a u - moved.
        low = min(max(floor - moved, floor), cap)
        out.append({"a": a, "nx": r.nx, "ny": r.ny, "mid": r.mid, "span": r.span or 1.0, "on": 0.0 if r.span == 0.0 else 2.0,
                    "mu": [m for m, _ in means], "id": [i for _, i in means], "moved": moved, "low": low,
                    "high": max(min(cap - moved, cap), low), "shift": [m * r.mean_factor + a * r.mean_ramp for m, _ in means]})
    return out


def _lattice_sums(cells: DataFrame, part, ramps: dict[float, Ramp], cfg: FieldConfig, label: str) -> DataFrame:
    """(id, tp, fn, fp, tn, total, n): confusion masses, field sum and cells of every candidate without topography.

    For one amplitude and azimuth a cell's field rises with the mean.  So the cell is wet from one mean of the lattice
    on, found by a search and settled by the field's own arithmetic, and at its limits up to one mean and from another
    on.  Counts under these positions, summed up along the lattice, give all means: a task does a few searches for
    each (cell, amplitude, azimuth), whatever the number of means.
    """
    r0, lattice, size = next(iter(ramps.values())), _lattice(part, ramps, cfg), len(part)
    floor, cap, margin, move = cfg.floor, cfg.cap, cfg.margin, cfg.enforce_mean

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def lim(v):
            v = v if floor is None else np.maximum(v, floor)
            return v if cap is None else np.minimum(v, cap)

        sums = np.zeros((6, size))
        for b in batches:
            got = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)}
            dx, dy, used = got["x_m"] - r0.xm, got["y_m"] - r0.ym, got["used"]
            gmin, y = got["gmin"][used], got["y"][used]
            for d in lattice:
                mu, shift, n, at = np.array(d["mu"]), np.array(d["shift"]), len(d["mu"]), d["id"]
                u = d["on"] * (dx * d["nx"] + dy * d["ny"] - d["mid"]) / d["span"]
                au = d["a"] * u
                mine = au[used]

                def wet(j):
                    g = lim(mu[j] + mine)
                    return (lim(g - shift[j] + mu[j]) if move else g) - gmin >= margin

                need = gmin + margin
                from_mean = np.where(need <= d["low"], -np.inf, np.where(need > d["high"], np.inf, need + d["moved"] - mine))
                j = np.searchsorted(mu, from_mean)
                for _ in range(2):  # rounding moves a cell by a step at most
                    j = np.where((j > 0) & wet(np.maximum(j - 1, 0)), j - 1, j)
                    j = np.where((j < n) & ~wet(np.minimum(j, n - 1)), j + 1, j)
                w, v = (np.bincount(j, x, n + 1) for x in (y, 1.0 - y))
                hit, false = np.cumsum(w)[:n], np.cumsum(v)[:n]
                sums[0, at] += hit
                sums[1, at] += w.sum() - hit
                sums[2, at] += false
                sums[3, at] += v.sum() - false
                rest = au - d["moved"]
                rises, stops = np.searchsorted(mu, d["low"] - rest), np.searchsorted(mu, d["high"] - rest, "right")
                begun, ended = (np.cumsum(np.bincount(x, minlength=n + 1))[:n] for x in (rises, stops))
                free = np.cumsum(np.bincount(rises, rest, n + 1) - np.bincount(stops, rest, n + 1))[:n]
                low, high = (x if np.isfinite(x) else 0.0 for x in (d["low"], d["high"]))
                sums[4, at] += (len(au) - begun) * low + ended * high + (begun - ended) * mu + free
                sums[5, at] += len(au)
        yield pa.RecordBatch.from_pydict({"id": np.arange(size, dtype="int32"),
                                          **dict(zip(("tp", "fn", "fp", "tn", "total", "n"), sums))})

    used = flag(F.col("roi")) & finite(F.col("gmin")) & F.col(label).isNotNull()
    rows = cells.filter(F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).select(
        F.col("x_m").cast("double").alias("x_m"), F.col("y_m").cast("double").alias("y_m"), used.alias("used"),
        F.coalesce(F.col("gmin").cast("double"), F.lit(0.0)).alias("gmin"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"))
    names = ("tp", "fn", "fp", "tn", "total", "n")
    parts = rows.mapInArrow(run, "id int, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])


def _row_sums(cells: DataFrame, part, ramps: dict[float, Ramp], cfg: FieldConfig, label: str, delta: str | None) -> DataFrame:
    """The same from one value for each (cell, candidate); with topography a field may fall while its mean rises."""
    rows = _field_rows(cells, part, ramps, cfg, ["gmin", "roi", label], delta)
    used = flag(F.col("roi")) & F.col("g").isNotNull() & finite(F.col("gmin")) & F.col(label).isNotNull()
    wet = at_least(F.col("g") - F.col("gmin"), cfg.margin)
    y = F.col(label).cast("double")
    mass = {"tp": (wet, y), "fn": (~wet, y), "fp": (wet, 1.0 - y), "tn": (~wet, 1.0 - y)}
    return rows.groupBy(F.col("c.id").alias("id")).agg(
        F.sum("g").alias("total"), F.count("g").cast("double").alias("n"),
        *[F.coalesce(F.sum(F.when(used & k, v)), F.lit(0.0)).alias(n) for n, (k, v) in mass.items()])


def score_candidates(cells: DataFrame, cands: DataFrame, cfg: FieldConfig = FieldConfig(),
                     delta: str | None = None, store: bool = True) -> DataFrame:
    """Recall, specificity and geometric mean of every candidate field.

    ``cells``: ``x_m, y_m, gmin, roi, spec_valid`` and the label ``y`` (binary) or ``w``
    (weighted).  Candidates are parameters: they travel as constants in chunks of bounded size,
    and their ramp constants come from one small aggregate.  Without a topographic factor a lattice
    of means at one amplitude and azimuth is served by one search per cell.  ``store=False`` is for cells that are a
    stored table already.
    """
    cells = field_cells(cells, delta) if store else cells
    label = {"binary": "y", "weighted": "w"}[cfg.truth]
    out, ramps, middle = None, {}, {}
    for part, lattice in _passes(cands, cfg, delta):
        _add_ramps(ramps, cells, part, delta)
        med = _medians(cells.filter(flag(F.col("spec_valid"))), part, ramps, cfg, delta, middle)
        sums = (_lattice_sums(cells, part, ramps, cfg, label) if lattice
                else _row_sums(cells, part, ramps, cfg, label, delta))
        names = [(i, *p, m) for i, (p, m) in enumerate(zip(part, med))]
        side = cells.sparkSession.createDataFrame(names, "id int, mu double, a double, theta double, med_spec double")
        scored = sums.join(F.broadcast(side), "id").drop("id")
        out = scored if out is None else out.unionByName(scored)
    floor = 1.0 if cfg.truth == "binary" else EPS
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    live = (pos > 0) & (neg > 0)
    out = out.withColumns({
        "mu_grid": F.col("total") / F.nullif(F.col("n"), F.lit(0.0)),
        "rec": F.when(live, F.col("tp") / F.greatest(pos, F.lit(floor))).otherwise(0.0),
        "spec": F.when(live, F.col("tn") / F.greatest(neg, F.lit(floor))).otherwise(0.0)})
    return out.withColumn("g_mean", F.sqrt(F.col("rec") * F.col("spec"))).select(
        "mu", "a", "theta", "g_mean", "rec", "spec", "mu_grid", "med_spec")


def proxy_score(cells: DataFrame, cands: DataFrame, cfg: FieldConfig = FieldConfig(),
                delta: str | None = None, store: bool = True) -> DataFrame:
    """Cheap gate: each field is split at its own median over the scored cells and compared with
    the hard label, ignoring the melt minimum."""
    cells = field_cells(cells, delta) if store else cells
    roi = cells.filter(flag(F.col("roi")))
    out, ramps, middle = None, {}, {}
    for part in _chunks(cands, cfg):
        _add_ramps(ramps, cells, part, delta)
        med = [1e300 if m is None else m for m in _medians(roi, part, ramps, cfg, delta, middle)]
        rows = _field_rows(roi, part, ramps, cfg, ["y"], delta, {"thr": med})
        wet, y = at_least(F.col("g"), F.col("c.thr")), F.col("y") == 1
        sums = rows.groupBy(F.col("c.mu").alias("mu"), F.col("c.a").alias("a"), F.col("c.id").alias("id")).agg(
            F.count_if(wet & y).alias("tp"), F.count_if(~wet & y).alias("fn"),
            F.count_if(wet & ~y).alias("fp"), F.count_if(~wet & ~y).alias("tn"))
        angles = [(i, p[2]) for i, p in enumerate(part)]
        side = cells.sparkSession.createDataFrame(angles, "id int, theta double")
        sums = sums.join(F.broadcast(side), "id").drop("id")
        out = sums if out is None else out.unionByName(sums)
    one = F.lit(1)
    rec = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    spec = F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), one)
    return out.select("mu", "a", "theta", F.sqrt(rec * spec).alias("proxy"))


def posterior_grid(scores: DataFrame, beta: float = 6.0) -> DataFrame:
    """Posterior weight over a candidate lattice: ``beta clamp01(G) + log prior``, normalised.
    The scores are written, as top and total read them before the result does."""
    post = cut_lineage(scores.withColumn("posterior", beta * clamp(F.col("g_mean"), 0.0, 1.0) + F.col("log_prior")))
    top = post.agg(F.max("posterior")).first()[0]
    weight = F.exp(F.col("posterior") - F.lit(top))
    total = post.agg(F.sum(weight)).first()[0]
    return post.withColumn("prob", weight / F.lit(total))

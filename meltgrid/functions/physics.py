"""Ice and radar physics as Column expressions.

Numeric constants are fixed values: they must equal the published ones for the results to agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from meltgrid.functions.mathx import clamp, erf
from meltgrid.functions.nulls import finite

# Vertical temperature profile.
T_MELT = 273.15
ICE_HEAT_CAPACITY = 2009.0
ICE_DENSITY = 910.0
GLEN_N = 3
MELT_SLOPE = 8.7e-4
SECONDS_PER_YEAR = 31556926.0
CONDUCTIVITY = 2.1
PROFILE_STEPS = 20

# Longitudinal advection.
ADV_DENSITY = 917.0
GRAVITY = 9.81
CLAUSIUS = -7.42e-8
HEAT_CAPACITY_0 = 152.5
HEAT_CAPACITY_T = 7.122

# WGS 84 ellipsoid and the standard parallel of EPSG:3031.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
STANDARD_PARALLEL = -71.0

# Radar.
LIGHT_SPEED = 299792458.0


def to_mw(c: Column, unit: str) -> Column:
    """Heat flow to mW/m2.  The unit is always stated by the caller."""
    factors = {"mw": 1.0, "w": 1000.0}
    return c * factors[unit.lower()]


def water_to_ice(c: Column) -> Column:
    """Accumulation kg/m2 (mm of water) to metres of ice."""
    return c / ICE_DENSITY


def monthly_rate(c: Column) -> Column:
    return c / 12.0


def _profile_coefficients() -> list[float]:
    n = GLEN_N
    step = 1.0 / PROFILE_STEPS

    def shape(z: float) -> float:
        return (z ** (n + 3) - 1) / (n + 1) / (n + 3) - (n + 2) * (z**2 - 1) / 2 / (n + 1) + z - 1

    k_year = CONDUCTIVITY * SECONDS_PER_YEAR
    scale = ICE_DENSITY * ICE_HEAT_CAPACITY / k_year
    depths = [1.0 - i * step for i in range(PROFILE_STEPS + 1)]
    return [0.5 * (shape(a) + shape(b)) * scale for a, b in zip(depths, depths[1:])]


def gmin(h: Column, ts: Column, mb: Column) -> Column:
    """Least heat flow (mW/m2) that brings the bed to the melting point.

    The vertical quadrature has a fixed number of steps, so its weights are folded here and one
    flat sum of exponentials reaches the executors.
    """
    hm = h * mb
    total = None
    for c in _profile_coefficients():
        term = F.exp(F.lit(c) * hm)
        total = term if total is None else total + term
    den = h * (total * (1.0 / PROFILE_STEPS))
    k_year = CONDUCTIVITY * SECONDS_PER_YEAR
    warm = k_year * (T_MELT - MELT_SLOPE * h - ts)
    return F.when(F.abs(den) >= 1e-8, warm / den / SECONDS_PER_YEAR * 1000.0)


def topo_correct(g: Column, delta: Column, already_applied: bool = False) -> Column:
    """Topographic factor ``G (1 + delta)``; applied once, as the flag makes explicit."""
    return g if already_applied else g * (1.0 + delta)


def gdiff(g: Column, gm: Column, adv: Column | None = None) -> Column:
    """Model heat flow above the melt minimum, optionally with the advected minimum."""
    return g - gm if adv is None else g - (gm - adv)


def sigma_gmin(h: Column, ts: Column, mb: Column, *, s_ts: float, s_mb: float, s_h: float,
               d_ts: float, d_mb: float, d_h: float) -> Column:
    """Spread of ``gmin`` by central differences in each input."""
    def part(plus: Column, minus: Column, d: float, s: float) -> Column:
        slope = (plus - minus) / (2.0 * d)
        return F.pow(slope * s, F.lit(2.0))

    total = (
        part(gmin(h, ts + d_ts, mb), gmin(h, ts - d_ts, mb), d_ts, s_ts)
        + part(gmin(h, ts, mb + d_mb), gmin(h, ts, mb - d_mb), d_mb, s_mb)
        + part(gmin(h + d_h, ts, mb), gmin(h - d_h, ts, mb), d_h, s_h)
    )
    return F.sqrt(total)


def flow_dir(vx: Column, vy: Column) -> tuple[Column, Column, Column]:
    """Speed and the unit flow vector; the divisor is floored so still ice has a zero vector."""
    speed = F.hypot(vx, vy)
    floor = F.greatest(speed, F.lit(1e-9))
    return speed, vx / floor, vy / floor


def bearing_dir(degrees_from_north: float) -> tuple[Column, Column]:
    rad = math.radians(degrees_from_north)
    return F.lit(math.sin(rad)), F.lit(math.cos(rad))


def basal_gradient(h: Column, ts: Column) -> Column:
    """First-pass vertical temperature gradient, never negative."""
    melt = T_MELT + CLAUSIUS * ADV_DENSITY * GRAVITY * h
    raw = (melt - ts) / F.greatest(h, F.lit(1.0))
    return F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0))


def heat_capacity(ts: Column) -> Column:
    return HEAT_CAPACITY_0 + HEAT_CAPACITY_T * ts


def advection_flux(h: Column, ts: Column, rate_yr: Column, speed_yr: Column, dts: Column,
                   dh: Column, drate_yr: Column, f: float = 0.5, k: float = 0.333) -> Column:
    """Basal flux (W/m2) equivalent to heat carried along the flow; missing where inputs are bad."""
    rate = rate_yr / SECONDS_PER_YEAR
    u_bar = f * (speed_yr / SECONDS_PER_YEAR)
    drate = drate_yr / SECONDS_PER_YEAR
    shape = dh / F.greatest(h, F.lit(1.0)) - drate / F.greatest(rate, F.lit(1e-12))
    g0 = basal_gradient(h, ts)
    flux = ADV_DENSITY * heat_capacity(ts) * u_bar * (h * dts + k * g0 * h * h * shape)
    good = finite(flux) & finite(dts) & finite(u_bar) & finite(rate) & (h > 0)
    return F.when(good, flux)


def to_polar_stereo(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Geographic degrees to EPSG:3031 metres."""
    e = math.sqrt(WGS84_F * (2.0 - WGS84_F))
    phi_c = math.radians(-STANDARD_PARALLEL)
    s_c = math.sin(phi_c)
    t_c = math.tan(math.pi / 4 - phi_c / 2) / ((1 - e * s_c) / (1 + e * s_c)) ** (e / 2)
    m_c = math.cos(phi_c) / math.sqrt(1 - (e * s_c) ** 2)
    phi = F.radians(-lat)
    s = F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    rho = WGS84_A * m_c / t_c * t
    lam = F.radians(lon)
    return rho * F.sin(lam), rho * F.cos(lam)


def polar_radius(lat: float) -> float:
    """Distance from the pole, in EPSG:3031 metres, of a southern parallel."""
    e = math.sqrt(WGS84_F * (2.0 - WGS84_F))

    def t_of(phi: float) -> float:
        s = math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    phi_c = math.radians(-STANDARD_PARALLEL)
    m_c = math.cos(phi_c) / math.sqrt(1 - (e * math.sin(phi_c)) ** 2)
    return WGS84_A * m_c / t_of(phi_c) * t_of(math.radians(-lat))


def from_polar_stereo(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3031 metres to geographic degrees (series for the conformal latitude)."""
    e2 = WGS84_F * (2.0 - WGS84_F)
    e = math.sqrt(e2)
    phi_c = math.radians(-STANDARD_PARALLEL)
    s_c = math.sin(phi_c)
    t_c = math.tan(math.pi / 4 - phi_c / 2) / ((1 - e * s_c) / (1 + e * s_c)) ** (e / 2)
    m_c = math.cos(phi_c) / math.sqrt(1 - (e * s_c) ** 2)
    chi = math.pi / 2 - 2 * F.atan(F.hypot(x, y) * (t_c / (WGS84_A * m_c)))
    phi = (
        chi
        + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) * F.sin(2 * chi)
        + (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) * F.sin(4 * chi)
        + (7 * e2**3 / 120 + 81 * e2**4 / 1120) * F.sin(6 * chi)
        + (4279 * e2**4 / 161280) * F.sin(8 * chi)
    )
    return F.degrees(F.atan2(x, y)), -F.degrees(phi)


def lat_at_most(x: Column, y: Column, lat: float) -> Column:
    """Southern-latitude test without inverse projection: compare the polar distance."""
    return F.hypot(x, y) <= F.lit(polar_radius(lat))


def sigma_from_bounds(lo: Column, hi: Column) -> Column:
    """Half width of a 95 % interval as one standard deviation."""
    return F.abs(hi - lo) / (2.0 * 1.96)


def specularity(d: Column, h: Column, rms_cm: Column, *, freq: float = 60e6, eps_r: float = 3.15,
                l1: float = 700.0, l2: float = 2000.0, path: str = "iceonly") -> Column:
    """Specularity content of an interface with the given roughness, for one radar geometry."""
    root = math.sqrt(eps_r)
    fresnel = F.sqrt((2 * LIGHT_SPEED / freq) * (h + d * root))
    phi_f = 2 * F.atan(fresnel / (2 * d))
    reach = {"iceonly": d * root, "optical": h + d * root}[path]
    a1 = 2 * F.atan(F.lit(l1 / 2) / reach)
    a2 = 2 * F.atan(F.lit(l2 / 2) / reach)
    g = rms_cm / 100.0 * (4 * math.pi * freq * root / LIGHT_SPEED)
    inv = 1.0 / (2.0 * g)
    e1 = erf(a1 / phi_f * inv) * erf(inv)
    e2 = erf(a2 / phi_f * inv) * erf(inv)
    diffuse = (e2 - e1) / ((a2 - a1) / math.pi)
    spec = e1 - diffuse * (a1 / math.pi)
    return clamp(spec / (spec + diffuse), 0.0, 1.0)

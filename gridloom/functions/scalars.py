"""Scalar column expressions: conversions, weights, ramps, losses, projection."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MM_PER_INCH = 25.4
FILL_SOURCE_QUALITY = {"direct": 0.75, "linear": 0.35, "nearest": 0.15}
FILL_SOURCE_QUALITY_OTHER = 0.25
SPECIFIC_YIELD_BY_CLASS = {-3: 0.08, -2: 0.11, -1: 0.14, 1: 0.18, 2: 0.22, 3: 0.26}
SPECIFIC_YIELD_DEFAULT = 0.18
TRUE_WORDS = ("true", "1", "yes")


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    # least/greatest skip NULLs, a missing value must stay missing
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def inch_to_mm(x: Column) -> Column:
    return x * F.lit(MM_PER_INCH)


def volume_per_km2_to_mm(x: Column) -> Column:
    """m3 spread over 1 km2, as millimetres of water."""
    return x / F.lit(1000.0)


def log1p_nonneg(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def standardize(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def unstandardize(z: Column, mean: Column, std: Column) -> Column:
    return z * F.when(std == 0, F.lit(1.0)).otherwise(std) + mean


def split_by_ord(
    ordinal: Column, train_end: int, validation: tuple[int, int], test: tuple[int, int]
) -> Column:
    """Label a month ordinal by five bounds; months in no window give NULL."""
    return (
        F.when(ordinal <= train_end, F.lit("train"))
        .when(ordinal.between(*validation), F.lit("validation"))
        .when(ordinal.between(*test), F.lit("test"))
    )


def split_space_time(grid_split: Column, time_split: Column) -> tuple[Column, Column]:
    """Cell split x year split -> (sample split, evaluation case)."""
    train_cell = grid_split == "train_grid"
    test_cell = grid_split == "test_grid"
    years = {k: time_split == k for k in ("train_years", "validation_years", "test_years")}
    split = (
        F.when(train_cell & years["train_years"], F.lit("train"))
        .when(train_cell & years["validation_years"], F.lit("validation"))
        .when(train_cell & years["test_years"], F.lit("test_temporal"))
        .when(test_cell & years["train_years"], F.lit("test_spatial"))
    )
    case = (
        F.when(grid_split.isNull() | time_split.isNull(), F.lit(None).cast("string"))
        .when(split == "test_temporal", F.lit("temporal_generalization"))
        .when(split == "test_spatial", F.lit("spatial_generalization"))
        .when(split.isNotNull(), split)
        .otherwise(F.lit("held_out_unused"))
    )
    return split, case


def step_weight(x: Column, thresholds: Sequence[float], weights: Sequence[float]) -> Column:
    """Step function: the weight of the last threshold not above ``x``."""
    if len(weights) != len(thresholds) + 1:
        raise ValueError("step_weight needs one more weight than thresholds")
    out = F.lit(float(weights[0]))
    for t, w in zip(thresholds, weights[1:]):
        out = F.when(x >= t, F.lit(float(w))).otherwise(out)
    return out


def observation_quality(n_days: Column, n_sites: Column) -> Column:
    return F.greatest(n_days / F.greatest(n_sites, F.lit(1)), F.lit(1.0))


def baseline_quality(fill_source: Column, n_points: Column) -> Column:
    base = F.lit(FILL_SOURCE_QUALITY_OTHER)
    for name, q in FILL_SOURCE_QUALITY.items():
        base = F.when(fill_source == name, F.lit(q)).otherwise(base)
    bonus = clip(F.log1p(F.coalesce(n_points, F.lit(0.0))) / F.lit(math.log(6.0)), 0.0, 1.0)
    return clip(base + F.lit(0.10) * bonus, 0.05, 1.0)


def soft_anchor_alpha(
    n_obs: Column, mismatch: Column, ref: float = 100.0, lo: float = 0.10, hi: float = 0.80, scale: float = 3.0
) -> Column:
    base = clip(n_obs / F.lit(max(ref, 1.0)), lo, hi)
    return clip(base / (F.lit(1.0) + F.abs(mismatch) / F.lit(max(scale, 1e-6))), 0.02, 1.0)


def bridge_alpha(
    q_left: Column, q_right: Column, gap: Column, lo: float = 0.35, hi: float = 0.80, gap_scale: float = 12.0
) -> Column:
    score = clip(F.lit(0.5) * (q_left + q_right) / F.lit(5.0), 0.0, 1.0)
    penalty = F.lit(1.0) + F.greatest(gap - 1, F.lit(0)) / F.lit(max(gap_scale, 1.0))
    return clip((F.lit(lo) + F.lit(hi - lo) * score) / penalty, 0.05, 0.95)


def single_obs_alpha(q: Column, mismatch: Column, scale: float = 5.0, hi: float = 0.20) -> Column:
    base = F.lit(0.05) + F.lit(0.15) * clip(q / F.lit(5.0), 0.0, 1.0)
    return clip(base / (F.lit(1.0) + F.abs(mismatch) / F.lit(max(scale, 1e-6))), 0.02, hi)


def smoothstep(z: Column) -> Column:
    z = clip(z, 0.0, 1.0)
    return F.lit(3.0) * z * z - F.lit(2.0) * z * z * z


def cubic_ramp(k: Column, gap: Column) -> Column:
    frac = k / gap
    return frac * frac * frac


def map_class(cls: Column, values: Mapping[int, float], default: float) -> Column:
    """Small class->value lookup as a literal map (no join)."""
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(lookup, cls.cast("int")), F.lit(float(default)))


def specific_yield(cls: Column) -> Column:
    return map_class(cls, SPECIFIC_YIELD_BY_CLASS, SPECIFIC_YIELD_DEFAULT)


def flag_true(x: Column) -> Column:
    return x.isNotNull() & F.lower(x.cast("string")).isin(*TRUE_WORDS)


def guarded_ratio(a: Column, b: Column, valid: Column) -> Column:
    return F.when(valid, F.try_divide(a, b))


def pow10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


# --- pointwise losses -------------------------------------------------------

def loss(name: str, pred: Column, true: Column, delta: float = 1.0) -> Column:
    e = pred - true
    a = F.abs(e)
    if name == "mse":
        return e * e
    if name == "mae":
        return a
    if name == "huber":
        return F.when(a <= delta, F.lit(0.5) * e * e).otherwise(F.lit(delta) * (a - F.lit(0.5 * delta)))
    if name == "smooth_l1":
        return F.when(a < delta, F.lit(0.5) * e * e / F.lit(delta)).otherwise(a - F.lit(0.5 * delta))
    if name == "log_cosh":
        # log(cosh e) written so that exp cannot overflow
        return a + F.log1p(F.exp(F.lit(-2.0) * a)) - F.lit(math.log(2.0))
    raise ValueError(f"unknown loss {name!r}")


# --- equal-area conic projection, inverse ----------------------------------

class AlbersConic:
    """Ellipsoidal Albers equal-area conic (defaults: EPSG:5070 on GRS80)."""

    def __init__(
        self,
        lat_1: float = 29.5,
        lat_2: float = 45.5,
        lat_0: float = 23.0,
        lon_0: float = -96.0,
        semi_major: float = 6378137.0,
        inv_flattening: float = 298.257222101,
    ):
        f = 1.0 / inv_flattening
        self.a, self.e2, self.lon_0 = semi_major, f * (2.0 - f), lon_0
        self.e = math.sqrt(self.e2)
        p1, p2, p0 = map(math.radians, (lat_1, lat_2, lat_0))
        m1, m2 = self._m(p1), self._m(p2)
        q1, q2, q0 = self._q(p1), self._q(p2), self._q(p0)
        self.n = (m1 * m1 - m2 * m2) / (q2 - q1)
        self.c = m1 * m1 + self.n * q1
        self.rho0 = self.a * math.sqrt(self.c - self.n * q0) / self.n

    def _m(self, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1.0 - self.e2 * math.sin(phi) ** 2)

    def _q(self, phi: float) -> float:
        s = math.sin(phi)
        es = self.e * s
        return (1.0 - self.e2) * (s / (1.0 - es * es) - math.log((1.0 - es) / (1.0 + es)) / (2.0 * self.e))

    def inverse(self, x: Column, y: Column, rounds: int = 5) -> tuple[Column, Column]:
        """Projected metres to (lon, lat) degrees with a fixed iteration count."""
        dy = F.lit(self.rho0) - y
        rho2 = x * x + dy * dy
        q = (F.lit(self.c) - rho2 * F.lit(self.n * self.n / (self.a * self.a))) / F.lit(self.n)
        lon = F.lit(self.lon_0) + F.degrees(F.atan2(x, dy) / F.lit(self.n))
        phi = F.asin(q / F.lit(2.0))
        for _ in range(rounds):
            phi = F.transform(F.array(phi), lambda p: self._newton(p, q))[0]
        return lon, F.degrees(phi)

    def _newton(self, phi: Column, q: Column) -> Column:
        s = F.sin(phi)
        es2 = F.lit(1.0) - F.lit(self.e2) * s * s
        part = (
            q / F.lit(1.0 - self.e2)
            - s / es2
            + F.log((F.lit(1.0) - F.lit(self.e) * s) / (F.lit(1.0) + F.lit(self.e) * s)) / F.lit(2.0 * self.e)
        )
        return phi + es2 * es2 / (F.lit(2.0) * F.cos(phi)) * part

"""Numeric functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def nan_to_null(value: Column) -> Column:
    """Aggregates skip NULL but not NaN."""
    return F.nanvl(value, F.lit(None).cast("double"))


def integer_or_zero(value: Column) -> Column:
    """Text or number as a 64-bit integer; anything unreadable or too large becomes 0."""
    return F.coalesce(nan_to_null(value.try_cast("double")).try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL when the denominator is zero or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(safe_ratio(numerator, denominator), F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def bin_edges(n_bins: int) -> list[float]:
    """Interior edges of equal-width bins over [0, 1], as k times the step."""
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    step = 1.0 / n_bins
    return [k * step for k in range(1, n_bins)]


def bin_index(value: Column, edges: list[float], edge_goes_up: bool = True) -> Column:
    """0-based bin; a value on an edge goes to the upper or the lower bin."""
    index = F.lit(0)
    for edge in edges:
        reached = value >= F.lit(edge) if edge_goes_up else value > F.lit(edge)
        index = index + reached.cast("int")
    return index


def differing_keys(expected: Column, actual: Column) -> Column:
    """Sorted keys whose values differ between two string maps, or that one map lacks."""
    same = F.map_zip_with(expected, actual, lambda key, left, right: left.eqNullSafe(right))
    return F.array_sort(F.map_keys(F.map_filter(same, lambda key, equal: ~equal)))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population standard deviation; constant columns become 0."""
    moments = df.agg(
        *[F.avg(nan_to_null(F.col(c))).alias(f"{c}__avg") for c in columns],
        *[F.stddev_pop(nan_to_null(F.col(c))).alias(f"{c}__std") for c in columns],
    )
    stats = moments.select(F.struct(*moments.columns)).scalar()

    def z_score(column: str) -> Column:
        spread = stats[f"{column}__std"]
        scale = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
        return (F.col(column) - stats[f"{column}__avg"]) / scale

    return df.withColumns({c: z_score(c) for c in columns})


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, value = 1e-300, 1.0
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"incomplete beta function does not converge at {a}, {b}, {x}")


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


# From here on the normal tail with two correction terms is exact to some 1e-12.
LARGE_DF = 1e4


def _nearly_normal_tail(t: float, df: float) -> float:
    """Two-sided tail for many degrees of freedom, expanded around the normal one.

    Differences of log-gamma values of the size of `df` would cancel there.
    """
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    first = t * (t**2 + 1) / (4 * df)
    second = t * (3 * t**6 - 7 * t**4 - 5 * t**2 - 3) / (96 * df**2)
    return min(1.0, max(0.0, math.erfc(t / math.sqrt(2)) + 2 * density * (first + second)))


def two_sided_t(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with df degrees of freedom."""
    if not (math.isfinite(t) and math.isfinite(df)) or df <= 0:
        return 0.0 if math.isinf(t) else math.nan
    if df > LARGE_DF:
        return _nearly_normal_tail(abs(t), df)
    return _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def student_t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value; runs on one aggregated row per tested feature."""
    return pd.Series(
        [
            None if pd.isna(a) or pd.isna(b) else two_sided_t(float(a), float(b))
            for a, b in zip(t, df)
        ],
        dtype="float64",
    )

"""Column expressions shared by the operators; all stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLION = 1_000_000


def clean(value: Column) -> Column:
    """NaN becomes NULL, so that sums, means and ranks skip it."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def millionths(value: Column) -> Column:
    """Integer millionths. The odd half keeps exact halves such as 1/128 on one side."""
    return F.floor(value * MILLION + 0.5001).cast("bigint")


def rounded(value: Column, decimals: int = 6) -> Column:
    """``value`` to so many decimals, by the same rule as :func:`millionths`."""
    scale = 10**decimals
    return F.floor(value * scale + 0.5001) / float(scale)


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson power transform of ``x`` with exponent ``lam``."""
    grown = F.when(lam == 0.0, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    mirror = 2.0 - lam
    shrunk = F.when(lam == 2.0, -F.log1p(-x)).otherwise(
        -(F.pow(1.0 - x, mirror) - 1.0) / mirror
    )
    return F.when(x >= 0.0, grown).otherwise(shrunk)


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a constant column scales to 0."""
    return F.when(value.isNull(), None).when(high > low, (value - low) / (high - low)).otherwise(0.0)


BUCKETS_PER_E = 4096
_SHIFT = 800 * BUCKETS_PER_E  # ln of the smallest double is above -800
LOWEST_BUCKET = -2 * _SHIFT - 1


def order_bucket(value: Column) -> Column:
    """A coarse number that never falls as ``value`` rises.

    Buckets are equal steps of ln|value|, so they need no look at the data and
    come out the same when a lost task runs again.
    """
    size = F.least(F.floor(F.ln(F.abs(value.cast("double"))) * BUCKETS_PER_E), F.lit(_SHIFT))
    return (
        F.when(value > 0, size + _SHIFT).when(value < 0, -size - _SHIFT).when(value == 0, F.lit(0))
    ).cast("bigint")

"""Numeric helpers that keep results independent of partitioning and of row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog import fixed_values as V


def mean_of(total: Column, count: Column) -> Column:
    """Mean from a sum and a count; 0 on nothing."""
    return F.when(count > 0, total.cast("double") / count).otherwise(F.lit(0.0))


def exact_square(value: Column) -> Column:
    wide = value.cast("decimal(19,0)")
    return wide * wide


def sample_sd(total: Column, squares: Column, count: Column) -> Column:
    """Sample standard deviation of whole numbers from exact sums; 0 for fewer than two.

    Integer sums do not depend on the order of addition, so neither does the result, and
    an anomaly cannot appear or vanish because Spark merged partitions differently.
    """
    n = count.cast("decimal(19,0)")
    wide = total.cast("decimal(19,0)")
    spread = (n * squares - wide * wide).cast("double")
    pairs = (count * (count - 1)).cast("double")
    return F.when(count > 1, F.sqrt(spread / pairs)).otherwise(F.lit(0.0))


def safe_z(observed: Column, mean: Column, sd: Column) -> Column:
    """Standard score; a constant baseline gives a fixed large score instead of infinity."""
    flat = F.when(observed > mean, F.lit(V.MAX_Z_SCORE)).otherwise(F.lit(0.0))
    return F.when(sd <= 0, flat).otherwise((observed - mean) / sd)


def round_half_up(value: Column) -> Column:
    """Nearest whole number, ties towards positive infinity."""
    return F.floor(value + 0.5)


def _scaled(value: Column, digits: int) -> Column:
    """``value * 10**digits`` rounded to a whole number, judged on the exact binary value.

    The product is split into its rounded part and its rounding error (Dekker), so that a
    tie in the rounded product is decided by which side the exact product lies on.
    """
    factor = float(10**digits)
    spread = value * 134217729.0
    high = spread - (spread - value)
    low = value - high
    product = value * factor
    error = (high * factor - product) + low * factor
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & (error >= 0))
    return (whole + F.when(up, 1).otherwise(0)).cast("long")


def fixed_text(value: Column, digits: int) -> Column:
    """A non-negative number with exactly ``digits`` decimals."""
    scaled = _scaled(value.cast("double"), digits)
    if digits == 0:
        return scaled.cast("string")
    unit = 10**digits
    whole = ((scaled - scaled % unit) / unit).cast("long")
    fraction = F.lpad((scaled % unit).cast("string"), digits, "0")
    return F.concat(whole.cast("string"), F.lit("."), fraction)


def plain_text(value: Column, digits: int) -> Column:
    """Like :func:`fixed_text` but without trailing zeros, as a bare number prints."""
    return F.regexp_replace(fixed_text(value, digits), r"\.?0+$", "") if digits else fixed_text(value, 0)

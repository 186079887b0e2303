"""Column helpers: guarded ratios and rounding half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """num / den * scale; 0 where den is not positive."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (num, den))
    return F.when(d > 0, n / d * scale).otherwise(F.lit(0.0))


def at_least(x: Column | str, low: float) -> Column:
    """x, but no less than low."""
    return F.greatest(F.col(x) if isinstance(x, str) else x, F.lit(low))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half up (not away from zero) to so many digits."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)

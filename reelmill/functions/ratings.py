"""Column expressions over vote sums and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_avg(total: Column, count: Column) -> Column:
    """total / count, NULL without votes."""
    return F.coalesce(total, F.lit(0)).cast("double") / F.nullif(count.cast("double"), F.lit(0.0))


def avg_or_zero(total: Column, count: Column) -> Column:
    return F.coalesce(safe_avg(total, count), F.lit(0.0))


def bayesian(total: Column, count: Column, mean: Column, min_votes: int) -> Column:
    """Vote average drawn towards ``mean`` with the weight of ``min_votes`` votes; 0 without votes."""
    v = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("double")
    m = F.lit(float(max(min_votes, 0)))
    own = v / (v + m) * (total.cast("double") / v)
    return F.when(v > 0, own + m / (v + m) * mean).otherwise(F.lit(0.0))


def log1p_positive(x: Column) -> Column:
    return F.when(x > 0, F.log1p(x)).otherwise(F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))

"""Aggregations of features over pods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column | str) -> Column:
    """A number with NaN as null."""
    return F.nanvl(c, F.lit(None).cast("double"))


def safe_float(c: Column) -> Column:
    """A string as a number; what cannot be read, and NaN, is null."""
    return known(c.try_cast("double"))


def weighted(rate: str, volume: str) -> Column:
    """Mean of rates by volume. A missing rate counts as zero with its volume; without any volume it is the plain mean."""
    total = F.sum(volume)
    return F.when(total == 0, F.avg(known(rate))).otherwise(F.sum(F.coalesce(known(rate), F.lit(0.0)) * F.col(volume)) / total)


def p99(value: str) -> Column:
    return F.percentile(known(value), F.lit(0.99))


def variation(value: str) -> Column:
    """Population deviation over mean; 0 where the mean is not positive."""
    mean = F.avg(known(value))
    return F.when(mean <= 0, 0.0).otherwise(F.stddev_pop(known(value)) / mean)


def utilisation(used: str, limit: str) -> Column:
    """The largest ratio of use to a positive limit."""
    return F.max(F.when(F.col(limit) > 0, F.col(used) / F.col(limit)))

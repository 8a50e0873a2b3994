"""Figures of run reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def success_rate(good: Column, total: Column) -> Column:
    """Per cent, 0 of nothing."""
    return F.coalesce(F.try_divide(good.cast("double") * 100, total.cast("double")), F.lit(0.0))


def per_minute(count: Column, seconds: Column) -> Column:
    """Items a minute, 0 in no time."""
    return F.coalesce(F.try_divide(count.cast("double") * 60, seconds.cast("double")), F.lit(0.0))


def duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with two digits."""
    two = lambda x: F.format_string("%.2f", x)
    return (
        F.when(seconds < 60, F.concat(two(seconds.cast("double")), F.lit(" seconds")))
        .when(seconds < 3600, F.concat(two(seconds / 60), F.lit(" minutes")))
        .otherwise(F.concat(two(seconds / 3600), F.lit(" hours")))
    )

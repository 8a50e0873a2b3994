"""Date arithmetic that mined queries call, as expressions and as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def add_days(d: Column, n: Column) -> Column:
    return d.cast("timestamp_ntz") + F.make_dt_interval(days=n)


def add_months(d: Column, n: Column) -> Column:
    return d.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), n)


def add_years(d: Column, n: Column) -> Column:
    return d.cast("timestamp_ntz") + F.make_ym_interval(n)


def install(spark: SparkSession) -> None:
    """``add_days`` and ``add_years`` as SQL functions; ``add_months`` is built in and gives a date."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION add_days(d TIMESTAMP_NTZ, n INT) RETURNS TIMESTAMP_NTZ RETURN d + make_dt_interval(n)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION add_years(d TIMESTAMP_NTZ, n INT) RETURNS TIMESTAMP_NTZ RETURN d + make_ym_interval(n)")

"""Month arithmetic on Columns: month windows and month labels.

The original computes, per reported month, four dates in Python (first day,
last day, first and last day of the previous calendar month). Here they are
Column expressions over a month-start column, so any number of months is
handled inside one plan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import ReportParams


def month_start(d: Column) -> Column:
    """First day of the month of ``d`` (a DATE)."""
    return F.trunc(d, "month")


def month_label(d: Column) -> Column:
    """``'YYYY-MM'`` label of a date."""
    return F.date_format(d, "yyyy-MM")


def window_columns(m: Column) -> dict[str, Column]:
    """The four dates of a reported month ``m`` (a month start)."""
    return {
        "from_date": m,
        "to_date": F.last_day(m),
        "from_date_lm": F.add_months(m, -1),
        "to_date_lm": F.date_sub(m, 1),
    }


def with_month_windows(df: DataFrame, month_col: str = "m") -> DataFrame:
    m = F.col(month_col)
    return df.select("*", month_label(m).alias("Month"),
                     *[c.alias(n) for n, c in window_columns(m).items()])


def report_months_df(spark: SparkSession, params: ReportParams) -> DataFrame:
    """One row per reported month (newest first) with its window dates."""
    anchor = F.lit(params.anchor).cast("date")
    months = spark.range(params.n_months).select(
        F.col("id").cast("int").alias("i"),
        F.add_months(anchor, -F.col("id").cast("int")).alias("m"))
    return with_month_windows(months).drop("i")


def date_lit(d: dt.date) -> Column:
    return F.lit(d).cast("date")

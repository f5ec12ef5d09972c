"""Comparison windows: tag order lines as P0 or P1."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.params import Params

MONTH_PARTITION = "order_month"


def _within(day: str, start: date, end: date) -> Column:
    return F.col(day).between(F.lit(start), F.lit(end))


def period_tag(params: Params, day: str = "order_date") -> Column:
    """'P0', 'P1' or NULL; a day inside both windows counts as P0."""
    return F.when(_within(day, params.p0_start, params.p0_end), "P0").when(_within(day, params.p1_start, params.p1_end), "P1")


def _between_days(fact: DataFrame, start: date, end: date) -> DataFrame:
    lines = fact.filter(_within("order_date", start, end))
    if MONTH_PARTITION in fact.columns:
        # A stored fact is partitioned by month: repeat the range on that column so that only matching folders are listed.
        lines = lines.filter(F.col(MONTH_PARTITION).between(F.lit(f"{start:%Y-%m}"), F.lit(f"{end:%Y-%m}"))).drop(MONTH_PARTITION)
    return lines


def sales_period(fact: DataFrame, params: Params) -> DataFrame:
    """Lines from the start of P0 to the end of P1 with their period; days between the windows keep a NULL period."""
    return _between_days(fact, params.p0_start, params.p1_end).withColumn("period", period_tag(params))


def p1_lines(fact: DataFrame, params: Params) -> DataFrame:
    """The P1 part of ``sales_period``, with the P1 range itself as the scan predicate."""
    start = max(params.p0_start, params.p1_start)
    return _between_days(fact, start, params.p1_end).filter(period_tag(params) == "P1")


def month_range(params: Params) -> tuple[date, date]:
    """First and last day of the months that monthly reports show."""
    first, last = (date.fromisoformat(f"{month}-01") for month in params.month_range)
    return first, (last.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)


def reported_months(fact: DataFrame, params: Params) -> DataFrame:
    """Lines of the months that monthly reports show, the range being a predicate of the scan."""
    return _between_days(fact, *month_range(params))


def tagged(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("period").isNotNull())

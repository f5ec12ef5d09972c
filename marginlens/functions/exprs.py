"""Small Column builders shared by the operators.

Money is summed as DECIMAL, rounded as DECIMAL or cast to DOUBLE once, and only then divided. Sums are therefore exact
and independent of how rows are partitioned.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,4)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def dec(value: Decimal) -> Column:
    """A literal of exactly the precision and scale that ``value`` is written with."""
    digits = value.as_tuple()
    scale = max(0, -digits.exponent)
    precision = max(len(digits.digits), scale + 1)
    return F.lit(value).cast(f"decimal({precision},{scale})")


def whole(c: str | Column) -> Column:
    """A decimal sum rounded to whole currency units, half away from zero."""
    return F.round(col(c), 0).cast("double")


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Double division that gives NULL on a zero divisor."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def pct(num: str | Column, den: str | Column, digits: int | None = None) -> Column:
    share = F.lit(100.0) * dbl(num) / F.nullif(dbl(den), F.lit(0.0))
    return share if digits is None else F.round(share, digits)


def sums(*names: str) -> list[Column]:
    """``sum_<name>`` for every measure; private names keep a sum from shadowing its input column."""
    return [F.sum(n).alias(f"sum_{n}") for n in names]


def sum_if(condition: Column, c: str | Column) -> Column:
    return F.sum(F.when(condition, col(c)))


def rows_from(*rows: dict[str, Column]) -> Column:
    """Turn literal-sized lists of named columns into rows of the same record (``select(rows_from(...))``)."""
    return F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]))

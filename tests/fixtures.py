"""Small hand-made inputs shared by the tests."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from marginlens.params import Params

PVM_WINDOWS = {"P0_START": "2020-01-01", "P0_END": "2020-12-31", "P1_START": "2021-01-01", "P1_END": "2021-12-31"}
LINE_SCHEMA = (
    "sku string, channel string, order_date date, quantity int, gross_amount decimal(19,4), discount_amount decimal(19,4),"
    " net_sales decimal(19,4), cogs decimal(19,4)"
)
# Two units that go on (100 pieces before, 120 after), one new and one discontinued; every effect of the bridge is non-zero.
PVM_ROWS = [
    ("A", "X", "2020-03-14", 40, 800, 0, 800, 480),
    ("A", "X", "2021-09-02", 50, 1100, 55, 1045, 650),
    ("B", "X", "2020-11-20", 60, 600, 30, 570, 360),
    ("B", "X", "2021-02-11", 70, 630, 0, 630, 490),
    ("C", "X", "2021-04-05", 30, 240, 0, 240, 150),
    ("D", "X", "2020-08-30", 25, 500, 0, 500, 420),
]


def money(value) -> Decimal:
    return Decimal(str(value)).quantize(Decimal("0.0001"))


def sales_lines(spark, rows):
    """Lines in LINE_SCHEMA from plain tuples."""
    typed = [
        (sku, channel, date.fromisoformat(day), quantity, *[money(a) for a in amounts])
        for sku, channel, day, quantity, *amounts in rows
    ]
    return spark.createDataFrame(typed, LINE_SCHEMA)


def pvm_params(**changes) -> Params:
    return Params.from_windows(PVM_WINDOWS).with_(**changes)


def rows_of(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def one(df) -> dict:
    rows = rows_of(df)
    assert len(rows) == 1, rows
    return rows[0]

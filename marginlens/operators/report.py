"""Data behind the report's figures: bar positions, curve points, pivots and single-row picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginlens.functions.exprs import pct, rows_from
from marginlens.params import Params

_CHANNEL_STEPS = ("margin_p0", "volume", "mix", "price", "discounts", "cost", "new_products", "discontinued", "margin_p1")


def _bars(steps: DataFrame, *by: str) -> DataFrame:
    """Bar ends: totals start at zero, each effect floats on the running sum of what came before it."""
    value, is_total = F.col("value"), F.col("ord").isin(0, 8)
    before = F.sum("value").over(W.partitionBy(*by).orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    base = F.when(is_total, F.lit(0.0)).otherwise(F.coalesce(before, F.lit(0.0)))
    return steps.withColumn("base", base).select(
        *by,
        "step",
        "ord",
        "value",
        F.least("base", F.col("base") + value).alias("bar_low"),
        F.greatest("base", F.col("base") + value).alias("bar_high"),
        F.when(is_total, "total").when(value >= 0, "gain").otherwise("loss").alias("kind"),
    )


def waterfall_steps(bridge: DataFrame) -> DataFrame:
    """Nine bars of the overall bridge (the input has exactly nine rows)."""
    return _bars(bridge)


def waterfall_steps_by_channel(by_channel: DataFrame, params: Params) -> DataFrame:
    rows = [
        {"step": F.lit(label), "ord": F.lit(ord_), "value": F.col(name)}
        for ord_, (label, name) in enumerate(zip(params.bridge_steps, _CHANNEL_STEPS))
    ]
    return _bars(by_channel.select("channel", rows_from(*rows)), "channel")


def subcategory_pivot_top(by_subcategory: DataFrame, params: Params, n: int = 10) -> DataFrame:
    """Margin by subcategory with one column per channel: the n largest in absolute terms, worst reseller margin first."""
    b2b, b2c = (
        F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("gross_margin"))), F.lit(0.0)) for c in params.channels
    )
    side_by_side = by_subcategory.groupBy("subcategory").agg(b2b.alias("resellers_margin"), b2c.alias("internet_margin"))
    size = F.abs("resellers_margin") + F.abs("internet_margin")
    return (
        side_by_side.orderBy(size.desc(), "subcategory").limit(n).orderBy("resellers_margin", "subcategory")
    )


def monthly_window(monthly: DataFrame, params: Params) -> DataFrame:
    """Monthly figures inside the plotted month range, with the margin rate held above the axis floor."""
    first, last = params.month_range
    return monthly.filter(F.col("year_month").between(first, last)).withColumn(
        "margin_pct_plotted", F.greatest(F.col("margin_pct"), F.lit(params.margin_floor_pct))
    )


def worst_month(monthly: DataFrame, params: Params) -> DataFrame:
    """Month of the plotted range with the lowest reseller margin rate; the earliest one on ties."""
    first, last = params.month_range
    of_b2b = monthly.filter(F.col("year_month").between(first, last) & (F.col("channel") == params.b2b))
    return of_b2b.orderBy(F.col("margin_pct").asc_nulls_last(), "year_month").limit(1)


def promo_top(by_promotion: DataFrame, n: int = 6) -> DataFrame:
    top = by_promotion.orderBy(F.col("discounts").desc(), "promotion_type", "promotion_name").limit(n)
    return top.select(
        "promotion_name", "discounts", "gross_amount", pct("discounts", "gross_amount").alias("rate_pct"), "margin_before", "margin_after"
    )


def worst_cost_increase(top_cost_increases: DataFrame) -> DataFrame:
    """The row of the cost table with the steepest unit-cost increase."""
    rank = (F.col("unit_cost_increase_pct").desc(), "cost_effect", "product_name", "channel")
    return top_cost_increases.orderBy(*rank).limit(1)


def note_lookups(
    by_subcategory: DataFrame,
    abc_skus: DataFrame,
    abc_resellers: DataFrame,
    coverage: DataFrame,
    params: Params,
) -> DataFrame:
    """Single figures quoted in the note, as (figure, value) rows gathered from the report tables."""

    def where(condition: Column, value: str) -> Column:
        return F.max(F.when(condition, F.col(value)))

    def picks(table: DataFrame, figures: dict[str, Column]) -> DataFrame:
        one_row = table.agg(*[value.cast("double").alias(name) for name, value in figures.items()])
        return one_row.select(rows_from(*[{"figure": F.lit(name), "value": F.col(name)} for name in figures]))

    focus = (F.col("subcategory") == params.focus_subcategory) & (F.col("channel") == params.b2b)
    in_a, in_d = F.col("abc_class") == "A", F.col("abc_class") == "D"
    last_order = where(F.col("channel") == params.b2b, "last_order")
    parts = [
        picks(
            by_subcategory,
            {
                "focus_subcategory_margin": F.sum(F.when(focus, F.col("gross_margin"))),
                "focus_subcategory_net_sales": F.sum(F.when(focus, F.col("net_sales"))),
            },
        ),
        picks(abc_skus, {"class_a_skus": where(in_a, "skus"), "class_d_skus": where(in_d, "skus"), "all_skus": F.sum("skus")}),
        picks(
            abc_resellers,
            {
                "class_d_resellers": where(in_d, "resellers"),
                "class_d_margin": where(in_d, "gross_margin"),
                "all_resellers": F.sum("resellers"),
            },
        ),
        picks(coverage, {"last_b2b_order": F.date_format(last_order, "yyyyMMdd")}),
    ]
    return reduce(DataFrame.unionByName, parts)


def fact_preview(fact: DataFrame, n: int = 5) -> DataFrame:
    """First lines by id."""
    shown = (
        "sales_line_id", "channel", "order_date", "sku", "quantity", "unit_price", "discount_amount", "net_sales", "cogs",
        "gross_margin", "is_below_cost",
    )
    return fact.select(*shown).orderBy("sales_line_id", *[c for c in shown[1:]]).limit(n)

"""Key figures by period, channel, category, territory, buyer type and calendar.

Every look-up of a descriptive attribute happens after the lines are summed per key, so joins move one row per key instead
of one per order line, and a key with very many lines is already collapsed map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlens.functions.exprs import dbl, pct, sum_if, sums, whole
from marginlens.operators.period import tagged
from marginlens.params import Params

_MONEY = ("net_sales", "cogs", "gross_margin", "gross_amount", "discount_amount")


def _sales_and_margin() -> list[Column]:
    return [
        whole("sum_net_sales").alias("net_sales"),
        whole("sum_gross_margin").alias("gross_margin"),
        pct("sum_gross_margin", "sum_net_sales", 2).alias("margin_pct"),
    ]


def _resum(*names: str) -> list[Column]:
    """Sum already-summed measures again, keeping their names."""
    return [F.sum(f"sum_{n}").alias(f"sum_{n}") for n in names]


_ADDITIVE = (*(f"sum_{m}" for m in _MONEY), "sum_quantity", "lines", "known_lines", "below_cost_lines", "below_cost_margin")


def _additive(lines: DataFrame, *keys: str) -> DataFrame:
    below = F.col("is_below_cost")
    return tagged(lines).groupBy(*keys).agg(
        *sums(*_MONEY, "quantity"),
        F.count(F.lit(1)).alias("lines"),
        F.count("is_below_cost").alias("known_lines"),
        F.count_if(below).alias("below_cost_lines"),
        sum_if(below, "gross_margin").alias("below_cost_margin"),
    )


def _with_totals(per_channel: DataFrame, *more: str) -> DataFrame:
    """Rows per (period, channel) and per period, from additive rows per (period, channel)."""
    period, channel = F.col("period"), F.col("channel")
    return per_channel.groupingSets([[period, channel], [period]], period, channel).agg(
        (F.grouping("channel") == 1).alias("is_total"), *[F.sum(a).alias(a) for a in (*_ADDITIVE, *more)]
    )


def _figures(totals: DataFrame, *orders: Column) -> DataFrame:
    return totals.select(
        "period",
        "channel",
        "is_total",
        whole("sum_net_sales").alias("net_sales"),
        whole("sum_cogs").alias("cogs"),
        whole("sum_gross_margin").alias("gross_margin"),
        pct("sum_gross_margin", "sum_net_sales", 2).alias("margin_pct"),
        whole("sum_gross_amount").alias("gross_amount"),
        whole("sum_discount_amount").alias("discounts"),
        pct("sum_discount_amount", "sum_gross_amount", 2).alias("discount_pct_of_gross"),
        F.col("sum_quantity").alias("units"),
        *orders,
        "lines",
        pct("below_cost_lines", "known_lines", 1).alias("pct_lines_below_cost"),
        whole("below_cost_margin").alias("loss_on_below_cost_lines"),
    ).orderBy("period", F.col("channel").asc_nulls_first(), F.col("is_total").desc())


def kpi_summary(lines: DataFrame) -> DataFrame:
    """Figures per (period, channel) and per period; ``channel`` is NULL and ``is_total`` true on a period's total.

    One pass over the lines: they are summed to one state per period, channel and order, and these states give sums and order
    counts alike. An order that occurs in several channels counts in each of them and once in the total, where the first of
    its states stands for it. Two grouping sets instead of a roll-up: the grand total over both periods is never computed.
    """
    per_order = _additive(lines, "period", "channel", "order_number")
    leads = F.row_number().over(Window.partitionBy("period", "order_number").orderBy("channel")) == 1
    numbered = F.col("order_number").isNotNull()
    per_channel = per_order.withColumn("leads", leads).groupBy("period", "channel").agg(
        *[F.sum(a).alias(a) for a in _ADDITIVE],
        F.count_if(numbered).alias("in_channel"),
        F.count_if(numbered & F.col("leads")).alias("led"),
    )
    orders = F.when(F.col("is_total"), F.col("led")).otherwise(F.col("in_channel")).alias("orders")
    return _figures(_with_totals(per_channel, "in_channel", "led"), orders)


def kpi_amounts(lines: DataFrame) -> DataFrame:
    """``kpi_summary`` without the number of orders: lines collapse map-side to one row per period and channel."""
    return _figures(_with_totals(_additive(lines, "period", "channel")))


def kpi_by_category(lines: DataFrame, skus: DataFrame) -> DataFrame:
    per_sku = lines.groupBy("sku", "period", "channel").agg(*sums("net_sales", "gross_margin", "quantity"))
    return (
        per_sku.join(skus.select("sku", "category"), "sku")
        .groupBy("period", "category", "channel")
        .agg(*_resum("net_sales", "gross_margin", "quantity"))
        .select("period", "category", "channel", *_sales_and_margin(), F.col("sum_quantity").alias("units"))
        .orderBy("period", "category", "channel")
    )


def kpi_by_subcategory(p1: DataFrame, skus: DataFrame) -> DataFrame:
    per_sku = p1.groupBy("sku", "channel").agg(*sums("net_sales", "gross_margin", "quantity"))
    return (
        per_sku.join(skus.select("sku", "category", "subcategory"), "sku")
        .groupBy("category", "subcategory", "channel")
        .agg(*_resum("net_sales", "gross_margin", "quantity"))
        .select("category", "subcategory", "channel", *_sales_and_margin(), F.col("sum_quantity").alias("units"))
        .orderBy("gross_margin", "category", "subcategory", "channel")
    )


def kpi_by_territory(p1: DataFrame, territories: DataFrame) -> DataFrame:
    place = ("territory_group", "country", "region")
    per_key = p1.groupBy("territory_key", "channel").agg(*sums("net_sales", "gross_margin"))
    return (
        per_key.join(territories, "territory_key")
        .groupBy(*place, "channel")
        .agg(*_resum("net_sales", "gross_margin"))
        .select(*place, "channel", *_sales_and_margin())
        .orderBy("gross_margin", *place, "channel")
    )


def kpi_by_reseller_type(p1: DataFrame, resellers: DataFrame) -> DataFrame:
    measures = ("net_sales", "gross_margin", "discount_amount", "gross_amount")
    per_reseller = p1.filter(F.col("reseller_key").isNotNull()).groupBy("reseller_key").agg(*sums(*measures))
    return (
        per_reseller.join(resellers.select("reseller_key", "business_type"), "reseller_key")
        .groupBy("business_type")
        .agg(F.count_distinct("reseller_key").alias("resellers"), *_resum(*measures))
        .select(
            "business_type",
            "resellers",
            *_sales_and_margin(),
            pct("sum_discount_amount", "sum_gross_amount", 2).alias("discount_pct_of_gross"),
        )
        .orderBy(F.col("net_sales").desc(), "business_type")
    )


def _per_day(fact: DataFrame) -> DataFrame:
    return fact.groupBy("date_key", "channel").agg(*sums("net_sales", "gross_margin"))


def kpi_monthly(fact: DataFrame, dates: DataFrame) -> DataFrame:
    return (
        _per_day(fact)
        .join(dates.select("date_key", "year_month"), "date_key")
        .groupBy("year_month", "channel")
        .agg(*_resum("net_sales", "gross_margin"))
        .select("year_month", "channel", *_sales_and_margin())
        .orderBy("year_month", "channel")
    )


def kpi_by_calendar_year(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Calendar years with the number of months that have sales; fewer than twelve marks the year as partial."""
    months = F.col("months_with_sales")
    return (
        _per_day(fact)
        .join(dates.select("date_key", "year", "month"), "date_key")
        .groupBy("year", "channel")
        .agg(*_resum("net_sales", "gross_margin"), F.count_distinct("month").alias("months_with_sales"))
        .select("year", "channel", *_sales_and_margin(), months, (months < 12).alias("partial"))
        .orderBy("year", "channel")
    )


def kpi_price_structure(p1: DataFrame, skus: DataFrame, params: Params) -> DataFrame:
    """Price gap between the channels on skus that both sell, weighted by the units resellers bought.

    One aggregation per sku holds both channels side by side. ``category`` is NULL and ``is_total`` true on the overall row.
    """
    b2b, b2c = F.col("channel") == params.b2b, F.col("channel") == params.b2c
    per_sku = p1.filter(F.col("channel").isin(*params.channels)).groupBy("sku").agg(
        F.count_if(b2b).alias("b2b_lines"),
        F.count_if(b2c).alias("b2c_lines"),
        sum_if(b2b, "quantity").alias("b2b_units"),
        sum_if(b2c, "quantity").alias("b2c_units"),
        sum_if(b2b, "net_sales").alias("b2b_net"),
        sum_if(b2c, "net_sales").alias("b2c_net"),
        sum_if(b2b, "cogs").alias("b2b_cogs"),
    )
    in_both = per_sku.filter((F.col("b2b_lines") > 0) & (F.col("b2c_lines") > 0))
    at_b2c_price = dbl("b2c_net") / F.nullif(dbl("b2c_units"), F.lit(0.0)) * dbl("b2b_units")
    priced = in_both.join(skus.select("sku", "category"), "sku").withColumn("at_b2c_price", at_b2c_price)
    return (
        priced.rollup("category")
        .agg(
            (F.grouping("category") == 1).alias("is_total"),
            F.count(F.lit(1)).alias("skus"),
            F.sum("b2b_net").alias("b2b_net"),
            F.sum("b2b_cogs").alias("b2b_cogs"),
            F.sum("at_b2c_price").alias("at_b2c_price"),
        )
        .select(
            "category",
            "is_total",
            "skus",
            pct("b2b_net", "at_b2c_price", 1).alias("reseller_price_pct_of_internet"),
            pct("b2b_cogs", "b2b_net", 1).alias("cogs_pct_of_reseller_price"),
        )
        .orderBy(F.col("category").asc_nulls_last(), "is_total")
    )

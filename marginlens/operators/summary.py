"""Consolidated figures. They combine the rounded rows of the published tables, so that every derived figure can be
recomputed by hand from the figures it is shown next to. All inputs here are report tables: a few rows per period, channel
or category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.exprs import dbl, pct
from marginlens.operators.bridge import free_effects
from marginlens.params import Params

TOTAL = "Total"


def kpi_matrix(summary: DataFrame) -> DataFrame:
    """``kpi_summary`` addressed by period and channel, the subtotal under the name 'Total'."""
    channel = F.when(F.col("is_total"), TOTAL).otherwise(F.col("channel"))
    return summary.withColumn("channel", channel).drop("is_total")


def _pick(value: str, period: str, channel: str) -> Column:
    return F.max(F.when((F.col("period") == period) & (F.col("channel") == channel), F.col(value)))


def growth(matrix: DataFrame, params: Params) -> DataFrame:
    picks = matrix.agg(
        _pick("net_sales", "P0", TOTAL).alias("sales0"),
        _pick("net_sales", "P1", TOTAL).alias("sales1"),
        _pick("gross_margin", "P0", TOTAL).alias("margin0"),
        _pick("gross_margin", "P1", TOTAL).alias("margin1"),
        _pick("net_sales", "P1", params.b2c).alias("b2c_sales"),
        _pick("gross_margin", "P1", params.b2c).alias("b2c_margin"),
    )
    return picks.select(
        _growth_pct("sales1", "sales0").alias("net_sales_pct"),
        (F.col("margin1") - F.col("margin0")).alias("margin_delta"),
        pct("b2c_sales", "sales1").alias("internet_share_of_sales_pct"),
        pct("b2c_margin", "margin1").alias("internet_share_of_margin_pct"),
    )


def _growth_pct(after: str, before: str) -> Column:
    return F.lit(100.0) * (F.col(after) / F.nullif(F.col(before), F.lit(0.0)) - 1.0)


def channel_evolution(matrix: DataFrame) -> DataFrame:
    """Sales growth and both margin rates per channel and in total."""
    by_channel = matrix.groupBy("channel").agg(
        *[
            F.max(F.when(F.col("period") == period, F.col(value))).alias(f"{value}_{period.lower()}")
            for period in ("P0", "P1")
            for value in ("net_sales", "margin_pct")
        ]
    )
    return by_channel.select(
        "channel",
        _growth_pct("net_sales_p1", "net_sales_p0").alias("net_sales_growth_pct"),
        "margin_pct_p0",
        "margin_pct_p1",
    )


def internet_plus10_margin(matrix: DataFrame, params: Params) -> DataFrame:
    picks = matrix.agg(
        _pick("net_sales", "P1", params.b2c).alias("sales"), _pick("margin_pct", "P1", params.b2c).alias("rate")
    )
    return picks.select((F.lit(0.10) * F.col("sales") * F.col("rate") / 100.0).alias("internet_plus10_margin"))


def b2b_share_of_sales(matrix: DataFrame, params: Params) -> DataFrame:
    picks = matrix.agg(
        _pick("net_sales", "P1", params.b2b).alias("b2b"), _pick("net_sales", "P1", TOTAL).alias("total")
    )
    return picks.select(pct("b2b", "total").alias("b2b_share_of_sales_pct"))


def categories_p1(by_category: DataFrame) -> DataFrame:
    return by_category.filter(F.col("period") == "P1").drop("period")


def price_structure_labelled(structure: DataFrame) -> DataFrame:
    category = F.when(F.col("is_total"), TOTAL).otherwise(F.col("category"))
    return structure.withColumn("category", category).drop("is_total")


def loss_making_summary(p1: DataFrame, skus: DataFrame, params: Params) -> DataFrame:
    """Size of the loss-making (sku, channel) set, its share of all sales and the focus category's share of the loss.

    One aggregation per (sku, channel) feeds both the set and the total it is compared with.
    """
    pairs = p1.groupBy("sku", "channel").agg(
        F.sum("net_sales").alias("net"), F.sum("cogs").alias("cost"), F.sum("gross_margin").alias("gm")
    )
    known = skus.select("sku", "category", F.lit(True).alias("known"))
    rows = pairs.join(known, "sku", "left")
    losing = F.col("known") & (F.col("gm") < 0)
    focus = losing & (F.col("category") == params.focus_category)
    totals = rows.agg(
        F.count_if(losing).alias("n"),
        F.sum(F.when(losing, F.col("net"))).alias("revenue"),
        F.sum(F.when(losing, F.col("cost"))).alias("cogs"),
        F.sum(F.when(losing, F.col("gm"))).alias("margin"),
        F.coalesce(F.sum(F.when(focus, F.col("gm"))), F.lit(0)).alias("focus_margin"),
        F.round(F.sum("net"), 0).alias("all_sales"),
    )
    return totals.select(
        "n",
        dbl("revenue").alias("revenue"),
        dbl("cogs").alias("cogs"),
        dbl("margin").alias("margin"),
        pct("revenue", "all_sales").alias("share_of_total_revenue_pct"),
        dbl("focus_margin").alias("focus_category_margin"),
        pct("focus_margin", "margin").alias("focus_category_share_of_loss_pct"),
    )


def loss_by_category(losses: DataFrame) -> DataFrame:
    return losses.groupBy("category").agg(
        F.count("sku").alias("n"), dbl(F.sum("gross_margin")).alias("margin"), dbl(F.sum("net_sales")).alias("revenue")
    )


def loss_top(losses: DataFrame, n: int = 8) -> DataFrame:
    return (
        losses.orderBy("gross_margin", "sku", "channel")
        .limit(n)
        .select("sku", "product_name", "channel", "units", "net_sales", "gross_margin", "margin_pct")
    )


def pricing_vs_cost(compared: DataFrame, params: Params) -> DataFrame:
    """Price effect against cost effect, per channel and overall, from one pass over the compared (sku, channel) units."""
    effects = free_effects()
    per_channel = compared.groupBy("channel").agg(
        F.sum(effects["price_effect"]).alias("price"), F.sum(effects["cost_effect"]).alias("cost"), F.sum("net1").alias("sales")
    )

    def at(channel: str, value: str) -> Column:
        return F.round(F.max(F.when(F.col("channel") == channel, F.col(value))), 0)

    row = per_channel.agg(
        at(params.b2b, "price").alias("resellers_price"),
        at(params.b2b, "cost").alias("resellers_cost"),
        at(params.b2b, "sales").alias("resellers_sales"),
        at(params.b2c, "price").alias("internet_price"),
        at(params.b2c, "cost").alias("internet_cost"),
        F.round(F.sum("price"), 0).alias("bridge_price"),
        F.round(F.sum("cost"), 0).alias("bridge_cost"),
    )
    gap = F.col("resellers_price") + F.col("resellers_cost")
    return row.select(
        "resellers_price",
        "resellers_cost",
        gap.alias("resellers_gap"),
        pct(gap, "resellers_sales").alias("resellers_gap_pct_of_sales"),
        "internet_price",
        "internet_cost",
        (F.col("internet_price") + F.col("internet_cost")).alias("internet_gap"),
        "bridge_price",
        "bridge_cost",
    )

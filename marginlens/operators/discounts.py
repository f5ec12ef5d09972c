"""What discounts cost and where they are given (P1)."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.exprs import dbl, pct, sum_if, sums, whole
from marginlens.params import Params

_MEASURES = ("gross_amount", "discount_amount", "net_sales", "margin_before_discount", "gross_margin")


#: The promotion dimension, or what names promotion keys without one: it adds promotion_type and promotion_name to a frame.
Promotions = DataFrame | Callable[[DataFrame], DataFrame]


def _named(per_key: DataFrame, promotions: Promotions, how: str) -> DataFrame:
    if not isinstance(promotions, DataFrame):
        return promotions(per_key)
    return per_key.join(promotions.select("promotion_key", "promotion_type", "promotion_name"), "promotion_key", how)


def disc_by_promotion(p1: DataFrame, promotions: Promotions, params: Params) -> DataFrame:
    """Promotions other than "no promotion", largest discount first."""
    measures = (*_MEASURES, "quantity")
    per_key = (
        p1.filter(F.col("promotion_key") != params.no_promotion_key)
        .groupBy("promotion_key")
        .agg(F.count(F.lit(1)).alias("n"), *sums(*measures))
    )
    named = _named(per_key, promotions, "inner")
    return (
        named.groupBy("promotion_type", "promotion_name")
        .agg(F.sum("n").alias("lines"), *[F.sum(f"sum_{m}").alias(f"sum_{m}") for m in measures])
        .select(
            "promotion_type",
            "promotion_name",
            "lines",
            F.col("sum_quantity").alias("units"),
            whole("sum_gross_amount").alias("gross_amount"),
            whole("sum_discount_amount").alias("discounts"),
            pct("sum_discount_amount", "sum_gross_amount", 1).alias("discount_pct_of_gross"),
            whole("sum_margin_before_discount").alias("margin_before"),
            whole("sum_gross_margin").alias("margin_after"),
            pct("sum_gross_margin", "sum_net_sales", 1).alias("margin_pct_after"),
        )
        .orderBy(F.col("discounts").desc(), "promotion_type", "promotion_name")
    )


def _percent_text(rate: Decimal) -> str:
    points = (rate * 100).normalize()
    return f"{points:f}"


def depth_labels(cuts: tuple[Decimal, ...]) -> list[str]:
    """'0 %', then one label per half-open range up to each cut, then everything above the last cut."""
    ends = [_percent_text(c) for c in cuts]
    return ["0 %"] + [f"{low}-{high} %" for low, high in zip(["0", *ends], ends)] + [f"> {ends[-1]} %"]


def _depth(cuts: tuple[Decimal, ...]) -> Column:
    labels = depth_labels(cuts)
    rate = F.col("discount_pct")
    depth = F.when(rate == 0, labels[0])
    for cut, label in zip(cuts, labels[1:]):
        depth = depth.when(rate <= float(cut), label)
    return depth.otherwise(labels[-1])


def disc_depth_buckets(p1: DataFrame, params: Params, cuts: tuple[Decimal, ...] | None = None) -> DataFrame:
    """Reseller lines by depth of discount, shallowest first; each range includes its upper end."""
    depth = _depth(cuts or params.depth_cuts)
    return (
        p1.filter(F.col("channel") == params.b2b)
        .groupBy(depth.alias("depth"))
        .agg(F.count(F.lit(1)).alias("lines"), F.min("discount_pct").alias("shallowest"), *sums(*_MEASURES, "quantity"))
        .orderBy("shallowest")
        .select(
            "depth",
            "lines",
            F.round(dbl("sum_quantity") / dbl("lines"), 1).alias("avg_units_per_line"),
            whole("sum_discount_amount").alias("discounts"),
            whole("sum_margin_before_discount").alias("margin_before"),
            whole("sum_gross_margin").alias("margin_after"),
            pct("sum_gross_margin", "sum_net_sales", 1).alias("margin_pct_after"),
        )
    )


def disc_turning_lines_negative(p1: DataFrame, params: Params) -> DataFrame:
    """Discounted lines by what the discount did to them: made the loss, deepened one, or left a profit."""
    made, deepened, kept = params.populations
    before, after = F.col("margin_before_discount"), F.col("gross_margin")
    population = F.when(before < 0, deepened).when(after < 0, made).otherwise(kept)
    return (
        p1.filter(F.col("discount_amount") > 0)
        .groupBy(population.alias("population"))
        .agg(F.count(F.lit(1)).alias("lines"), *sums("discount_amount", "gross_margin"))
        .select(
            "population",
            "lines",
            whole("sum_discount_amount").alias("discounts"),
            whole("sum_gross_margin").alias("margin_after"),
        )
        .orderBy("population")
    )


def disc_summary(p1: DataFrame, params: Params) -> DataFrame:
    on_b2b = F.col("channel") == params.b2b
    totals = p1.agg(
        *sums("discount_amount", "gross_amount"),
        sum_if(on_b2b, "margin_before_discount").alias("b2b_before"),
        sum_if(on_b2b, "gross_margin").alias("b2b_after"),
        sum_if(on_b2b, "gross_amount").alias("b2b_gross"),
    )
    return totals.select(
        whole("sum_discount_amount").alias("discounts"),
        whole("sum_gross_amount").alias("gross_amount"),
        pct("sum_discount_amount", "sum_gross_amount", 2).alias("discount_pct_of_gross"),
        whole("b2b_before").alias("resellers_margin_before"),
        whole("b2b_after").alias("resellers_margin_after"),
        pct("b2b_before", "b2b_gross", 2).alias("resellers_margin_pct_before_discount"),
    )


def disc_lines_p1(p1: DataFrame, params: Params) -> DataFrame:
    """Discounted reseller lines, the input of the discount-rule simulations."""
    return p1.filter((F.col("channel") == params.b2b) & (F.col("discount_amount") > 0)).select(
        "sales_line_id", "sku", "promotion_key", "quantity", "gross_amount", "discount_amount", "discount_pct",
        "net_sales", "cogs", "margin_before_discount", "gross_margin",
    )


def new_product_promos(p1: DataFrame, promotions: Promotions, params: Params) -> DataFrame:
    """Discounts of the new-product promotions and their share of all P1 discounts.

    The share divides the rounded figures of the promotion table and the summary. Both come from one aggregation: lines per
    promotion key, left-joined so that lines without a promotion row still count in the total.
    """
    per_key = p1.groupBy("promotion_key").agg(*sums("discount_amount", "margin_before_discount", "gross_margin"))
    per_promotion = (
        _named(per_key, promotions, "left")
        .withColumn(
            "is_new",
            (F.col("promotion_key") != params.no_promotion_key) & (F.col("promotion_type") == params.new_product_type),
        )
        .groupBy("is_new", F.when(F.col("is_new"), F.col("promotion_name")).alias("name"))
        .agg(*[F.sum(f"sum_{m}").alias(m) for m in ("discount_amount", "margin_before_discount", "gross_margin")])
    )
    new = F.col("is_new")

    def rounded_sum(measure: str) -> Column:
        return F.coalesce(sum_if(new, F.round(measure, 0)), F.lit(0))

    totals = per_promotion.agg(
        dbl(rounded_sum("discount_amount")).alias("new_product_promos"),
        dbl(F.round(F.sum("discount_amount"), 0)).alias("all_discounts"),
        dbl(rounded_sum("margin_before_discount")).alias("new_product_promos_margin_before"),
        dbl(rounded_sum("gross_margin")).alias("new_product_promos_margin_after"),
    )
    return totals.select(
        "new_product_promos",
        pct("new_product_promos", "all_discounts").alias("new_product_promos_pct"),
        "new_product_promos_margin_before",
        "new_product_promos_margin_after",
    )


def already_below_cost(p1: DataFrame, params: Params) -> DataFrame:
    """Discounts given on lines that lost money before any discount, and their share of all P1 discounts."""
    below = (F.col("discount_amount") > 0) & (F.col("margin_before_discount") < 0)
    totals = p1.agg(
        F.round(sum_if(below, "discount_amount"), 0).alias("below"),
        F.round(F.sum("discount_amount"), 0).alias("total"),
        F.count_if(below).alias("lines"),
    )
    return totals.select(
        dbl("below").alias("already_below_cost_discounts"),
        pct("below", "total").alias("already_below_cost_pct"),
        F.col("lines").alias("already_below_cost_lines"),
    )

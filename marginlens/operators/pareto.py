"""Margin concentration: ranking, cumulative shares and ABC classes.

Classes follow the cumulated *positive* margin before an item: A below 80 %, B below 95 %, C after that; an item with a
negative margin is D. The item that crosses a threshold keeps the class it started in.

A ranking over all items has no natural partition key, and a window without one would sort everything in a single task.
``rank_items`` therefore range-partitions the items by (margin descending, key), fixes that partitioning by writing it,
ranks and cumulates inside each range, and adds to each range the totals of the ranges before it: a frame with one row per
range. Sums are DECIMAL, so the result equals the single-window form exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginlens.functions.exprs import dec, pct, sum_if, sums, whole
from marginlens.functions.staged import stage
from marginlens.params import Params

_SUM = "decimal(38,4)"
_RANKING = ("margin_pct", "rank_margin", "n_items", "pct_of_items", "cum_margin_pct_of_net", "cum_margin_pct_of_positive", "abc_class")


def _positive(margin: str) -> Column:
    return F.greatest(F.col(margin), F.lit(0)).cast(_SUM)


def rank_items(items: DataFrame, key: str, margin: str = "gross_margin", ranges: int | None = None) -> DataFrame:
    """Add rank_margin, n_items, cum_margin, cum_before, total_margin and total_positive to one-row-per-item ``items``."""
    order = [F.col(margin).desc(), F.col(key)]
    by_range = items.repartitionByRange(ranges, *order) if ranges else items.repartitionByRange(*order)
    placed = stage(by_range.withColumn("range_id", F.spark_partition_id()), "ranked-items")

    earlier = W.orderBy("range_id").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    every = W.partitionBy()
    per_range = placed.groupBy("range_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(margin).cast(_SUM).alias("margin_sum"),
        F.sum(_positive(margin)).cast(_SUM).alias("positive_sum"),
    )
    offsets = per_range.select(
        "range_id",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("margin_sum").over(earlier), F.lit(0)).cast(_SUM).alias("margin_before"),
        F.coalesce(F.sum("positive_sum").over(earlier), F.lit(0)).cast(_SUM).alias("positive_before"),
        F.sum("n").over(every).alias("n_items"),
        F.sum("margin_sum").over(every).cast(_SUM).alias("total_margin"),
        F.sum("positive_sum").over(every).cast(_SUM).alias("total_positive"),
    )

    in_range = W.partitionBy("range_id").orderBy(*order)
    upto, before = in_range.rowsBetween(W.unboundedPreceding, W.currentRow), in_range.rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.select(
        "*",
        F.row_number().over(in_range).alias("rank_in_range"),
        F.sum(margin).over(upto).cast(_SUM).alias("margin_in_range"),
        F.coalesce(F.sum(_positive(margin)).over(before), F.lit(0)).cast(_SUM).alias("positive_in_range"),
    )
    # The offsets have as many rows as there are ranges, which the shuffle partition setting bounds.
    return ranked.join(F.broadcast(offsets), "range_id").select(
        *items.columns,
        (F.col("n_before") + F.col("rank_in_range")).alias("rank_margin"),
        "n_items",
        (F.col("margin_before") + F.col("margin_in_range")).cast(_SUM).alias("cum_margin"),
        (F.col("positive_before") + F.col("positive_in_range")).cast(_SUM).alias("cum_before"),
        "total_margin",
        "total_positive",
    )


def abc_class(params: Params, margin: str = "gross_margin") -> Column:
    before, total = F.col("cum_before"), F.col("total_positive")
    return (
        F.when(F.col(margin) < 0, "D")
        .when(before < dec(params.class_a_share) * total, "A")
        .when(before < dec(params.class_b_share) * total, "B")
        .otherwise("C")
    )


def with_shares(ranked: DataFrame, params: Params) -> DataFrame:
    """Shares and class of every ranked item. The share of the net margin is undefined unless that total is positive."""
    return ranked.withColumns(
        {
            "margin_pct": pct("gross_margin", "net_sales"),
            "pct_of_items": pct("rank_margin", "n_items"),
            "cum_margin_pct_of_net": F.when(F.col("total_margin") > 0, pct("cum_margin", "total_margin")),
            "cum_margin_pct_of_positive": pct("cum_margin", "total_positive"),
            "abc_class": abc_class(params),
        }
    )


def sku_margins(p1: DataFrame, skus: DataFrame, params: Params) -> DataFrame:
    """P1 per sku. The sum is keyed by sku alone, so it is already partitioned for the join with the sku attributes."""

    def of(channel: str) -> Column:
        return F.sum(F.when(F.col("channel") == channel, F.col("gross_margin")).otherwise(F.lit(0).cast("decimal(19,4)")))

    per_sku = p1.groupBy("sku").agg(
        F.sum("quantity").alias("units"),
        F.sum("net_sales").alias("net_sales"),
        F.sum("gross_margin").alias("gross_margin"),
        of(params.b2b).alias("margin_resellers"),
        of(params.b2c).alias("margin_internet"),
    )
    return per_sku.join(skus.select("sku", "product_name", "category", "subcategory"), "sku")


def reseller_margins(p1: DataFrame, resellers: DataFrame, params: Params) -> DataFrame:
    per_reseller = (
        p1.filter((F.col("channel") == params.b2b) & F.col("reseller_key").isNotNull())
        .groupBy("reseller_key")
        .agg(
            F.count_distinct("order_number").alias("orders"),
            F.sum("net_sales").alias("net_sales"),
            F.sum("gross_margin").alias("gross_margin"),
            F.sum("discount_amount").alias("discounts"),
        )
    )
    attributes = resellers.select("reseller_key", "reseller_name", "business_type", "country")
    return per_reseller.join(attributes, "reseller_key")


def pareto_sku(p1: DataFrame, skus: DataFrame, params: Params) -> DataFrame:
    shared = with_shares(rank_items(sku_margins(p1, skus, params), "sku"), params)
    return shared.select(
        "sku", "product_name", "category", "subcategory", "units",
        "net_sales", "gross_margin", "margin_resellers", "margin_internet",
        *_RANKING,
    )


def pareto_reseller(p1: DataFrame, resellers: DataFrame, params: Params) -> DataFrame:
    shared = with_shares(rank_items(reseller_margins(p1, resellers, params), "reseller_key"), params)
    return shared.select(
        "reseller_key", "reseller_name", "business_type", "country", "orders",
        "net_sales", "gross_margin", "discounts",
        *_RANKING,
    )


def abc_summary(pareto: DataFrame, counted: str) -> DataFrame:
    """Items, share of items and sums per class; ``counted`` names the item columns ('skus', 'resellers')."""
    n = F.count(F.lit(1))
    return (
        pareto.groupBy("abc_class")
        .agg(
            n.alias(counted),
            pct(n, F.max("n_items"), 1).alias(f"pct_of_{counted}"),
            whole(F.sum("net_sales")).alias("net_sales"),
            whole(F.sum("gross_margin")).alias("gross_margin"),
        )
        .orderBy("abc_class")
    )


def loss_making_sku_channel(p1: DataFrame, skus: DataFrame) -> DataFrame:
    """(sku, channel) pairs that lose money in P1."""
    losing = (
        p1.groupBy("sku", "channel")
        .agg(*sums("quantity", "net_sales", "cogs", "gross_margin"))
        .filter(F.col("sum_gross_margin") < 0)
    )
    attributes = skus.select("sku", "product_name", "category", "subcategory")
    return losing.join(attributes, "sku").select(
        "sku", "product_name", "category", "subcategory", "channel",
        F.col("sum_quantity").alias("units"),
        F.col("sum_net_sales").alias("net_sales"),
        F.col("sum_cogs").alias("cogs"),
        F.col("sum_gross_margin").alias("gross_margin"),
        pct("sum_gross_margin", "sum_net_sales").alias("margin_pct"),
    ).orderBy("gross_margin", "sku", "channel")


def pareto_peak(pareto: DataFrame) -> DataFrame:
    return pareto.agg(
        F.count(F.lit(1)).alias("n_skus"),
        F.max("cum_margin_pct_of_net").alias("peak_cum_margin_pct"),
        pct(F.count_if(F.col("abc_class") == "A"), F.count(F.lit(1))).alias("class_a_pct_of_skus"),
    )


def pareto_argmax(pareto: DataFrame) -> DataFrame:
    """Where the cumulated share of the net margin peaks; the first such item on ties."""
    height = F.struct(F.col("cum_margin_pct_of_net").alias("peak"), (-F.col("rank_margin")).alias("first"))
    known = pareto.filter(F.col("cum_margin_pct_of_net").isNotNull())
    return known.agg(
        F.max_by("pct_of_items", height).alias("pct_of_items_at_peak"),
        F.max("cum_margin_pct_of_net").alias("peak_cum_margin_pct"),
    )


def worst_items(pareto: DataFrame, n: int = 10) -> DataFrame:
    return (
        pareto.orderBy("gross_margin", "sku")
        .limit(n)
        .select("sku", "product_name", "category", "net_sales", "gross_margin", "margin_resellers", "margin_internet")
    )


def hidden_losses(p1: DataFrame, skus: DataFrame) -> DataFrame:
    """Loss-making (sku, channel) pairs whose sku earns money overall.

    Both levels come from one aggregation per (sku, channel), summed again per sku.
    """
    per_pair = p1.groupBy("sku", "channel").agg(F.sum("gross_margin").alias("margin"))
    per_sku = per_pair.groupBy("sku").agg(F.sum("margin").alias("margin"), F.count_if(F.col("margin") < 0).alias("losing"))
    profitable = per_sku.filter((F.col("margin") > 0) & (F.col("losing") > 0)).join(skus.select("sku"), "sku")
    return profitable.agg(F.coalesce(F.sum("losing"), F.lit(0)).cast("bigint").alias("hidden_loss_pairs"))


def pareto_audit(ranked: DataFrame, params: Params) -> DataFrame:
    """Violations of the ranking's invariants, from the columns of ``rank_items``; all must be zero.

    Neighbours are compared by an equi-join on the rank, which stays distributed where a lag over all items would not.
    """
    margin = F.col("gross_margin")
    shared = with_shares(ranked, params)
    after = ranked.select((F.col("rank_margin") - 1).alias("rank_margin"), F.col("gross_margin").alias("next_margin"))
    rows = shared.join(after, "rank_margin", "left")
    positive = F.greatest(margin, F.lit(0))
    limit_a, limit_b = dec(params.class_a_share) * F.col("total_positive"), dec(params.class_b_share) * F.col("total_positive")
    cls, before = F.col("abc_class"), F.col("cum_before")
    n = F.count(F.lit(1))
    last = F.col("rank_margin") == F.col("n_items")
    turns = (margin >= 0) & (F.col("next_margin") < 0)
    return rows.agg(
        n.alias("items"),
        (n - F.count_distinct("rank_margin")).alias("repeated_ranks"),
        F.count_if((F.col("rank_margin") < 1) | (F.col("rank_margin") > F.col("n_items"))).alias("ranks_out_of_range"),
        F.count_if(F.col("next_margin") > margin).alias("order_breaks"),
        F.count_if((cls == "D") != (margin < 0)).alias("class_d_errors"),
        F.count_if(last & (F.col("cum_margin") != F.col("total_margin"))).alias("last_not_total"),
        F.count_if(turns & (F.col("cum_margin") != F.col("total_positive"))).alias("peak_not_total_positive"),
        F.count_if(
            ((cls == "A") & (before >= limit_a))
            | ((cls == "B") & ((before < limit_a) | (before >= limit_b)))
            | ((cls == "C") & (before < limit_b))
        ).alias("threshold_errors"),
        F.count_if((F.col("total_margin") > 0) != F.col("cum_margin_pct_of_net").isNotNull()).alias("net_base_errors"),
        sum_if(cls == "A", positive).cast("double").alias("class_a_margin"),
    )


def abc_points_by_class(pareto: DataFrame) -> DataFrame:
    """Curve points with the size and share of their class, for labelling the curve."""
    per_class = pareto.groupBy("abc_class").agg(F.count(F.lit(1)).alias("class_items"))
    # at most four classes
    return pareto.join(F.broadcast(per_class), "abc_class").select(
        "sku",
        "abc_class",
        "pct_of_items",
        "cum_margin_pct_of_net",
        "class_items",
        pct("class_items", "n_items").alias("class_pct_of_items"),
    )


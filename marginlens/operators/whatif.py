"""What-if simulations on segments and discounted lines.

A segment is a row with ``revenue``, ``cogs`` and ``margin``; every simulation is an expression over such rows, so one or
many segments are simulated alike. Scenarios are literal lists expanded in place, without a join. These are scenarios, not
forecasts: elasticity and avoidable cost share are assumptions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.exprs import dbl, dec, rows_from, safe_div

RULES = ("no_discount_below_cost", "cap")
CURVE_POINTS = 81
CURVE_START, CURVE_STEP = 0.6, 0.005


def _num(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def segment(losses: DataFrame, *by: str) -> DataFrame:
    """Sum lines into one segment, or one per value of ``by``."""
    grouped = losses.groupBy(*by).agg(F.sum("net_sales").alias("r"), F.sum("cogs").alias("c"))
    return grouped.select(*by, dbl("r").alias("revenue"), dbl("c").alias("cogs"), dbl(F.col("r") - F.col("c")).alias("margin"))


def loss_segment_direct(p1: DataFrame) -> DataFrame:
    """The loss-making segment straight from the lines: sum per (sku, channel), keep the losses, sum again."""
    pairs = p1.groupBy("sku", "channel").agg(
        F.sum("net_sales").alias("net"), F.sum("cogs").alias("cost"), F.sum("gross_margin").alias("gm")
    )
    return pairs.filter(F.col("gm") < 0).agg(
        dbl(F.sum("net")).alias("revenue"), dbl(F.sum("cost")).alias("cogs"), dbl(F.sum("gm")).alias("margin")
    )


def price_change(x: float | Column, elasticity: float | Column, variable_share: float | Column = 1.0) -> Column:
    """Margin change after raising prices by ``x``: volume follows the elasticity down to zero, and only the variable share
    of the cost is saved on the volume that is lost."""
    x, e, v = _num(x), _num(elasticity), _num(variable_share)
    volume = F.greatest(F.lit(0.0), e * x + 1.0)
    return F.col("revenue") * (volume * (x + 1.0) - 1.0) - v * F.col("cogs") * (volume - 1.0)


def break_even_elasticity(x: float | Column, variable_share: float | Column = 1.0) -> Column:
    """The most negative elasticity at which raising prices by ``x`` still costs no margin; NULL when there is no limit."""
    x, v = _num(x), _num(variable_share)
    kept = F.col("revenue") * (x + 1.0) - v * F.col("cogs")
    limit = F.when(kept > 0, -F.col("revenue") / F.nullif(kept, F.lit(0.0)))
    return F.when(limit * x >= -1.0, limit)


def stop_selling(variable_share: float | Column) -> Column:
    """Margin change when the segment is no longer sold: the revenue goes, the variable share of the cost is saved."""
    return _num(variable_share) * F.col("cogs") - F.col("revenue")


def break_even_variable_share() -> Column:
    return safe_div("revenue", "cogs")


def price_grid(
    segments: DataFrame, steps: Iterable[float], elasticities: Iterable[float], variable_share: float = 1.0, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per segment, price step and elasticity."""
    spread = segments.withColumn("x", F.explode(F.lit(list(steps)))).withColumn("elasticity", F.explode(F.lit(list(elasticities))))
    return spread.select(*by, "x", "elasticity", price_change(F.col("x"), F.col("elasticity"), variable_share).alias("margin_delta"))


def price_table(
    segments: DataFrame, steps: Iterable[float], elasticities: Iterable[float], variable_share: float = 1.0
) -> DataFrame:
    """The price grid with one row per step and one column per elasticity, named ``e=<elasticity>``."""
    spread = segments.withColumn("x", F.explode(F.lit(list(steps))))
    return spread.select("x", *[price_change(F.col("x"), e, variable_share).alias(f"e={e:g}") for e in elasticities])


def break_even_by_step(segments: DataFrame, steps: Iterable[float], variable_share: float = 1.0) -> DataFrame:
    spread = segments.withColumn("x", F.explode(F.lit(list(steps))))
    return spread.select("x", break_even_elasticity(F.col("x"), variable_share).alias("break_even_elasticity"))


def price_sensitivity(segments: DataFrame, x: float, elasticity: float, variable_share: float) -> DataFrame:
    return segments.select(
        F.lit(x).alias("x"),
        F.lit(elasticity).alias("elasticity"),
        F.lit(variable_share).alias("variable_share"),
        price_change(x, elasticity, variable_share).alias("margin_delta"),
    )


def stop_selling_by_share(segments: DataFrame, shares: Iterable[float]) -> DataFrame:
    spread = segments.withColumn("variable_share", F.explode(F.lit(list(shares))))
    return spread.select("variable_share", stop_selling(F.col("variable_share")).alias("margin_delta"))


def stop_selling_curve(segments: DataFrame) -> DataFrame:
    point = F.explode(F.sequence(F.lit(0), F.lit(CURVE_POINTS - 1)))
    curve = segments.withColumn("point", point).withColumn("variable_share", F.col("point") * CURVE_STEP + CURVE_START)
    return curve.select("point", "variable_share", stop_selling(F.col("variable_share")).alias("margin_delta"))


def break_even_share(segments: DataFrame) -> DataFrame:
    return segments.select(break_even_variable_share().alias("break_even_share"))


def price_change_line_level(lines: DataFrame, x: float, elasticity: float, variable_share: float = 1.0) -> DataFrame:
    """The price simulation line by line: new price, new volume and new cost of each line against today's.

    ``lines`` has net_sales, cogs and quantity > 0. The formula is linear in revenue and cost, so the sum over lines equals
    the simulation of their segment.
    """
    quantity = dbl("quantity")
    price, unit_cost = dbl("net_sales") / quantity, dbl("cogs") / quantity
    sold = quantity * F.greatest(F.lit(0.0), F.lit(1.0 + elasticity * x))
    after = sold * price * (1.0 + x) - (quantity * unit_cost - F.lit(variable_share) * (quantity - sold) * unit_cost)
    today = quantity * price - quantity * unit_cost
    return lines.agg(F.sum(after - today).alias("margin_delta"))


@dataclass(frozen=True)
class DiscountRule:
    """``no_discount_below_cost`` takes the whole discount off lines that lose money before it; ``cap`` limits every
    discount to a share of the gross amount. ``lost_volume_share`` of the touched volume is lost."""

    rule: str
    cap: Decimal | None = None
    lost_volume_share: float = 0.0

    def __post_init__(self) -> None:
        if self.rule not in RULES:
            raise ValueError(f"unknown discount rule: {self.rule}")
        if self.rule == "cap" and self.cap is None:
            raise ValueError("rule 'cap' needs a cap")

    def removed(self) -> Column:
        """Discount taken off a line; NULL or zero where the rule does not touch it."""
        discount = F.col("discount_amount")
        if self.rule == "no_discount_below_cost":
            return F.when(F.col("margin_before_discount") < 0, discount)
        return F.greatest(discount - dec(self.cap) * F.col("gross_amount"), F.lit(0))


def discount_rules(lines: DataFrame, rules: Iterable[DiscountRule]) -> DataFrame:
    """One row per rule: rule, cap, lines, discount_removed, margin_delta, lost_volume_share.

    All rules are conditional sums of a single aggregation over the lines. Amounts are DECIMAL, so a discount exactly at the
    cap counts as untouched.
    """
    rules = list(rules)
    measures = []
    for i, rule in enumerate(rules):
        removed = rule.removed()
        touched = (F.col("discount_amount") > 0) & (removed > 0)
        measures += [
            F.count_if(touched).alias(f"lines{i}"),
            F.sum(F.when(touched, removed)).alias(f"removed{i}"),
            F.sum(F.when(touched, F.col("gross_margin"))).alias(f"margin{i}"),
        ]
    rows = []
    for i, rule in enumerate(rules):
        removed, margin = F.coalesce(dbl(f"removed{i}"), F.lit(0.0)), F.coalesce(dbl(f"margin{i}"), F.lit(0.0))
        rows.append(
            {
                "rule": F.lit(rule.rule),
                "cap": F.lit(None if rule.cap is None else float(rule.cap)).cast("double"),
                "lines": F.col(f"lines{i}"),
                "discount_removed": removed,
                "margin_delta": F.lit(1.0 - rule.lost_volume_share) * (margin + removed) - margin,
                "lost_volume_share": F.lit(float(rule.lost_volume_share)),
            }
        )
    return lines.agg(*measures).select(rows_from(*rows))

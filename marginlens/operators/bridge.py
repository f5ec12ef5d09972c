"""Price / volume / mix bridge between the margins of P0 and P1.

The unit of analysis is a (sku, channel). With q, gross, disc, cogs and m (margin) of each period, ``growth`` = q1/q0 of the
unit and ``r`` = total units P1 / total units P0 over units sold in both periods ("continuing"):

    volume = m0 (r - 1)                 mix  = m0 (growth - r)
    price  = gross1 - gross0 growth     discount = disc0 growth - disc1     cost = cogs0 growth - cogs1
    new    = m1 where q0 = 0            discontinued = -m0 where q1 = 0

and m1 - m0 is the sum of the seven. Volume and mix are linear in ``r``, so every summed form of the bridge is one
aggregation of r-free pieces with ``r`` applied to the few resulting rows; only the line-level table needs ``r`` per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginlens.functions.exprs import dbl, rows_from
from marginlens.functions.staged import stage
from marginlens.operators.period import tagged
from marginlens.params import Params

EFFECTS = (
    "volume_effect",
    "mix_effect",
    "price_effect",
    "discount_effect",
    "cost_effect",
    "new_effect",
    "discontinued_effect",
)
LINE_COLUMNS = (
    "sku", "channel", "q0", "q1", "net0", "net1", "margin0", "margin1", "delta_margin", "unit_cogs0", "unit_cogs1", *EFFECTS,
)
_INPUTS = {"q": "quantity", "gross": "gross_amount", "disc": "discount_amount", "net": "net_sales", "cogs": "cogs"}
_BY_GROUP = ("margin_p0", "volume", "mix", "price", "discounts", "cost", "new_products", "discontinued", "margin_p1")


def continuing() -> Column:
    return (F.col("q0") > 0) & (F.col("q1") > 0)


def _with_margins(units: DataFrame) -> DataFrame:
    return units.withColumns({"margin0": F.col("net0") - F.col("cogs0"), "margin1": F.col("net1") - F.col("cogs1")})


def compare_periods(lines: DataFrame) -> DataFrame:
    """One row per (sku, channel) with both periods side by side, in one aggregation and one shuffle.

    A unit without a sku or channel keeps its periods apart, as an equality join of the two periods would.
    """
    is_p0, is_p1 = F.col("period") == "P0", F.col("period") == "P1"
    unmatched = F.when(F.col("sku").isNull() | F.col("channel").isNull(), F.col("period"))

    def of(condition: Column, measure: str) -> Column:
        return dbl(F.coalesce(F.sum(F.when(condition, F.col(measure))), F.lit(0)))

    both = [of(is_p0, raw).alias(f"{name}0") for name, raw in _INPUTS.items()]
    both += [of(is_p1, raw).alias(f"{name}1") for name, raw in _INPUTS.items()]
    compared = tagged(lines).groupBy("sku", "channel", unmatched.alias("unmatched")).agg(*both)
    return _with_margins(compared.drop("unmatched"))


def compare_periods_by_join(lines: DataFrame) -> DataFrame:
    """The same rows from two per-period aggregates and a full outer join; kept to cross-check the aggregation form."""

    def one(period: str, suffix: str) -> DataFrame:
        return (
            lines.filter(F.col("period") == period)
            .groupBy("sku", "channel")
            .agg(*[dbl(F.sum(raw)).alias(f"{name}{suffix}") for name, raw in _INPUTS.items()])
        )

    joined = one("P0", "0").join(one("P1", "1"), ["sku", "channel"], "full")
    return _with_margins(joined.na.fill(0.0, [f"{name}{suffix}" for name in _INPUTS for suffix in "01"]))


def _growth() -> Column:
    return F.col("q1") / F.nullif(F.col("q0"), F.lit(0.0))


def free_effects() -> dict[str, Column]:
    """Effects that do not depend on the overall unit growth ``r``."""
    growth, live = _growth(), continuing()

    def on_continuing(effect: Column) -> Column:
        return F.when(live, effect).otherwise(F.lit(0.0))

    return {
        "price_effect": on_continuing(F.col("gross1") - F.col("gross0") * growth),
        "discount_effect": on_continuing(F.col("disc0") * growth - F.col("disc1")),
        "cost_effect": on_continuing(F.col("cogs0") * growth - F.col("cogs1")),
        "new_effect": F.when(F.col("q0") == 0, F.col("margin1")).otherwise(F.lit(0.0)),
        "discontinued_effect": F.when(F.col("q1") == 0, -F.col("margin0")).otherwise(F.lit(0.0)),
    }


def unit_growth(compared: DataFrame) -> DataFrame:
    """One row ``r``: growth of total units over continuing units; NULL when there are none."""
    return compared.filter(continuing()).agg((F.sum("q1") / F.sum("q0")).alias("r"))


def pvm_lines(compared: DataFrame, staged: bool = True) -> DataFrame:
    """All effects per (sku, channel).

    ``r`` is a total over the same rows it is then applied to. The compared units are staged first, so that the order lines
    are read once and the total reads two columns of the staged table; ``r`` itself enters as a scalar subquery.
    """
    units = stage(compared, "bridge-units") if staged else compared
    r = unit_growth(units).scalar()
    live, m0 = continuing(), F.col("margin0")
    with_r = units.withColumn("r", r)
    return with_r.withColumns(
        {
            "delta_margin": F.col("margin1") - m0,
            "unit_cogs0": F.when(F.col("q0") > 0, F.col("cogs0") / F.col("q0")),
            "unit_cogs1": F.when(F.col("q1") > 0, F.col("cogs1") / F.col("q1")),
            "volume_effect": F.when(live, m0 * (F.col("r") - 1)).otherwise(F.lit(0.0)),
            "mix_effect": F.when(live, m0 * (_growth() - F.col("r"))).otherwise(F.lit(0.0)),
            **free_effects(),
        }
    ).select(*LINE_COLUMNS)


# ---- summed forms ------------------------------------------------------------------------------------------------


def _pieces() -> list[Column]:
    """Sums from which every effect follows once ``r`` is known."""
    live, m0 = continuing(), F.col("margin0")
    return [
        F.sum("margin0").alias("margin0"),
        F.sum("margin1").alias("margin1"),
        F.sum(F.when(live, F.col("q0"))).alias("q0c"),
        F.sum(F.when(live, F.col("q1"))).alias("q1c"),
        F.coalesce(F.sum(F.when(live, m0)), F.lit(0.0)).alias("m0c"),
        F.coalesce(F.sum(F.when(live, m0 * _growth())), F.lit(0.0)).alias("m0c_growth"),
        *[F.sum(effect).alias(name) for name, effect in free_effects().items()],
    ]


def _apply_growth(pieces: DataFrame, r: Column) -> DataFrame:
    """Volume and mix of each row of pieces. Without continuing units ``r`` is NULL and both are zero."""
    rate = F.coalesce(r, F.lit(1.0))
    return pieces.withColumn("r", rate).withColumns(
        {
            "volume_effect": F.col("m0c") * (F.col("r") - 1),
            "mix_effect": F.col("m0c_growth") - F.col("m0c") * F.col("r"),
        }
    )


def bridge_totals(compared: DataFrame) -> DataFrame:
    """One row: the seven effects and both margins."""
    totals = _apply_growth(compared.agg(*_pieces()), F.col("q1c") / F.col("q0c"))
    return totals.select(*EFFECTS, "margin0", "margin1")


def identity_gap(compared: DataFrame) -> DataFrame:
    total = sum((F.col(e) for e in EFFECTS[1:]), F.col(EFFECTS[0]))
    return bridge_totals(compared).select(F.abs(F.col("margin1") - F.col("margin0") - total).alias("gap"))


def pvm_bridge(compared: DataFrame, params: Params) -> DataFrame:
    """Nine ordered steps from the margin of P0 to the margin of P1, in whole currency units."""
    values = ("margin0", *EFFECTS, "margin1")
    steps = [
        {"step": F.lit(label), "ord": F.lit(ord_), "value": F.round(F.col(value), 0)}
        for ord_, (label, value) in enumerate(zip(params.bridge_steps, values))
    ]
    return bridge_totals(compared).select(rows_from(*steps)).orderBy("ord")


def _grouped(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Effects per group; ``pieces`` has one row per group, so the total units are a window over the groups."""
    all_groups = W.partitionBy()
    r = F.sum("q1c").over(all_groups) / F.nullif(F.sum("q0c").over(all_groups), F.lit(0.0))
    values = ("margin0", *EFFECTS, "margin1")
    return _apply_growth(pieces, r).select(*keys, *[F.round(F.col(v), 0).alias(name) for name, v in zip(_BY_GROUP, values)])


def pvm_by_channel(compared: DataFrame) -> DataFrame:
    return _grouped(compared.groupBy("channel").agg(*_pieces()), ["channel"]).orderBy("channel")


def pvm_by_category(compared: DataFrame, skus: DataFrame) -> DataFrame:
    """Effects per category. Units of an unknown sku still count in the total growth but belong to no category."""
    known = skus.select("sku", "category", F.lit(True).alias("known"))
    pieces = compared.join(known, "sku", "left").groupBy("known", "category").agg(*_pieces())
    return _grouped(pieces, ["known", "category"]).filter("known").drop("known").orderBy("category")


def pvm_top_cost_increases(compared: DataFrame, skus: DataFrame, n: int = 10) -> DataFrame:
    """Continuing units whose higher unit cost took most margin."""
    unit0, unit1 = F.col("cogs0") / F.col("q0"), F.col("cogs1") / F.col("q1")
    return (
        compared.filter(continuing())
        .withColumn("effect", free_effects()["cost_effect"])
        .join(skus.select("sku", "product_name"), "sku")
        .orderBy("effect", "sku", "channel")
        .limit(n)
        .select(
            "product_name",
            "channel",
            F.col("q1").alias("units_p1"),
            F.round("effect", 0).alias("cost_effect"),
            F.round(F.lit(100.0) * (unit1 / F.nullif(unit0, F.lit(0.0)) - 1), 1).alias("unit_cost_increase_pct"),
        )
    )


def partition_audit(lines: DataFrame) -> DataFrame:
    """Counts over the line-level bridge; everything but the class sizes must be zero (gap: at most rounding)."""
    live, new, gone = continuing(), F.col("q0") == 0, F.col("q1") == 0
    classes = live.cast("int") + new.cast("int") + gone.cast("int")
    on_continuing = EFFECTS[:5]
    stray = F.lit(False)
    for effect in on_continuing:
        stray = stray | (F.col(effect) != 0)
    total = sum((F.col(e) for e in EFFECTS[1:]), F.col(EFFECTS[0]))
    return lines.agg(
        F.count_if(live).alias("continuing"),
        F.count_if(new).alias("new"),
        F.count_if(gone).alias("discontinued"),
        F.count_if(classes != 1).alias("not_in_one_class"),
        F.count_if(~live & stray).alias("stray_continuing_effects"),
        F.count_if(~new & (F.col("new_effect") != 0)).alias("stray_new_effects"),
        F.count_if(~gone & (F.col("discontinued_effect") != 0)).alias("stray_discontinued_effects"),
        F.count_if(F.abs(F.col("delta_margin") - total) >= 0.01).alias("lines_off_identity"),
    )

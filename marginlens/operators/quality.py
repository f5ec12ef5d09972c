"""Data-quality rules. Each rule yields one row ``violations``; zero means clean.

Orphan rules count the fact per key first and then look for keys without a dimension row, so the join never carries
order lines and a key that owns a large share of the fact is one row by the time it is shuffled.

What a set of lines contributes to the report is a state: totals and rule counts, lines per key, lines and distinct ids.
States of disjoint sets are merged by adding, so a stored fact keeps one per month and an added month is audited alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.exprs import dbl, dec, rows_from
from marginlens.functions.staged import stage
from marginlens.operators.period import tagged
from marginlens.params import Params

# The names of the rules.
CHECKS = (
    "chk_fact_rows_equal_staging",
    "chk_fact_grain_unique",
    "chk_net_sales_reconcile_staging",
    "chk_cogs_reconcile_staging",
    "chk_orphan_products",
    "chk_orphan_sku_category",
    "chk_orphan_dates",
    "chk_orphan_territories",
    "chk_orphan_promotions",
    "chk_channel_keys",
    "chk_orphan_resellers_customers",
    "chk_gross_amount_identity",
    "chk_net_identity",
    "chk_cogs_identity",
    "chk_discount_identity",
    "chk_positive_quantities_and_costs",
    "chk_sku_has_unique_category",
)


class QualityError(RuntimeError):
    """Raised by the gate; the message lists every failing rule."""


# ---- rules that one line alone can break -------------------------------------------------------------------------


def line_rules(params: Params) -> dict[str, Column]:
    """Rule name to a predicate that is true on a violating line. A line without channel breaks the rule of channel keys."""
    tolerance = dec(params.identity_tolerance)
    channel, reseller, customer = F.col("channel"), F.col("reseller_key"), F.col("customer_key")

    def off(actual: str, expected: Column) -> Column:
        return F.abs(F.col(actual) - expected) > tolerance

    return {
        "chk_orphan_products": F.col("sku").isNull(),
        "chk_channel_keys": channel.isNull()
        | ((channel == params.b2b) & (reseller.isNull() | customer.isNotNull()))
        | ((channel == params.b2c) & (customer.isNull() | reseller.isNotNull())),
        "chk_gross_amount_identity": off("gross_amount", F.col("quantity") * F.col("unit_price")),
        "chk_net_identity": off("net_sales", F.col("gross_amount") - F.col("discount_amount")),
        "chk_cogs_identity": off("cogs", F.col("quantity") * F.col("unit_cogs")),
        "chk_discount_identity": off("discount_amount", F.col("gross_amount") * F.col("discount_pct")),
        "chk_positive_quantities_and_costs": (F.col("quantity") <= 0) | (F.col("unit_cogs") <= 0) | (F.col("unit_price") <= 0),
    }


def line_rule(fact: DataFrame, rule: str, params: Params) -> DataFrame:
    return fact.agg(F.count_if(line_rules(params)[rule]).alias("violations"))


def margin_discount_identity(fact: DataFrame, params: Params) -> DataFrame:
    """Margin before minus margin after must be the discount."""
    gap = F.col("margin_before_discount") - F.col("gross_margin") - F.col("discount_amount")
    return fact.agg(F.count_if(F.abs(gap) > dec(params.identity_tolerance)).alias("violations"))


# ---- reconciliation with staging ---------------------------------------------------------------------------------


_TOTALS = ("rows", "net_sales", "cogs")


def _total(name: str) -> Column:
    return F.count(F.lit(1)).alias(name) if name == "rows" else F.sum(name).cast("decimal(38,4)").alias(name)


def reconciles(fact: DataFrame, source_totals: DataFrame, total: str) -> DataFrame:
    """Absolute difference of one total of the fact to the source's; the union holds one row per side."""
    signed = fact.agg(_total(total)).unionByName(source_totals.select((-F.col(total)).alias(total)))
    gap = F.abs(F.coalesce(F.sum(total), F.lit(0)))
    return signed.agg((gap if total == "rows" else dbl(gap)).alias("violations"))


def grain_unique(fact: DataFrame) -> DataFrame:
    return fact.agg((F.count(F.lit(1)) - F.count_distinct("sales_line_id")).alias("violations"))


# ---- orphan keys -------------------------------------------------------------------------------------------------


def _usage(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"))


def _lines_total(usage: DataFrame) -> DataFrame:
    return usage.agg(F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("violations"))


def _without_match(usage: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return usage.join(dim.select(key), key, "left_anti")


def orphan_keys(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return _lines_total(_without_match(_usage(fact, key), dim, key))


def _without_category(usage: DataFrame, skus: DataFrame) -> DataFrame:
    """Lines of an unknown sku and lines of a known sku that has no category."""
    return usage.join(skus.select("sku", "category"), "sku", "left").filter(F.col("category").isNull())


def orphan_sku_category(fact: DataFrame, skus: DataFrame) -> DataFrame:
    return _lines_total(_without_category(_usage(fact, "sku"), skus))


def orphan_parties(fact: DataFrame, resellers: DataFrame, customers: DataFrame, params: Params) -> DataFrame:
    b2b = _usage(fact.filter(F.col("channel") == params.b2b), "reseller_key")
    b2c = _usage(fact.filter(F.col("channel") == params.b2c), "customer_key")
    lost_b2b = _without_match(b2b, resellers, "reseller_key").select("lines")
    lost_b2c = _without_match(b2c, customers, "customer_key").select("lines")
    return _lines_total(lost_b2b.unionByName(lost_b2c))


def sku_has_unique_category(products: DataFrame) -> DataFrame:
    per_sku = products.groupBy("sku").agg(F.count_distinct("category").alias("categories"))
    return per_sku.agg(F.count_if(F.col("categories") > 1).alias("violations"))


_RULE_COLUMNS = (
    "sales_line_id", "channel", "sku", "date_key", "reseller_key", "customer_key", "territory_key", "promotion_key", "quantity",
    "unit_price", "gross_amount", "discount_pct", "discount_amount", "net_sales", "unit_cogs", "cogs",
)


# ---- all rules together ------------------------------------------------------------------------------------------

_USAGE_SETS = (
    ("sku",),
    ("date_key",),
    ("territory_key",),
    ("promotion_key",),
    ("channel", "reseller_key"),
    ("channel", "customer_key"),
)


def usage_state(lines: DataFrame, *by: str) -> DataFrame:
    """Lines per key for six groupings in one pass, with the index of the grouping each row belongs to, per ``by``."""
    columns = [*by, *dict.fromkeys(c for keys in _USAGE_SETS for c in keys)]
    counted = lines.groupingSets([[F.col(k) for k in (*by, *keys)] for keys in _USAGE_SETS], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("lines")
    )
    which = F.lit(None).cast("int")
    for index, keys in enumerate(_USAGE_SETS):
        # grouping_id has a 1 bit for every column that a set leaves out, first column in the highest bit
        gid = sum((c not in (*by, *keys)) << (len(columns) - 1 - i) for i, c in enumerate(columns))
        which = F.when(F.col("gid") == gid, index).otherwise(which)
    return counted.withColumn("usage_set", which).drop("gid")


def rule_state(lines: DataFrame, params: Params, *by: str) -> DataFrame:
    """Totals and violations of every line rule, per ``by``. States of disjoint lines add up."""
    rules = line_rules(params)
    return lines.groupBy(*by).agg(*map(_total, _TOTALS), *[F.count_if(broken).alias(rule) for rule, broken in rules.items()])


def grain_state(lines: DataFrame, month: str) -> DataFrame:
    """(month, lines, ids): lines and distinct line ids of each month."""
    return lines.groupBy(month).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("sales_line_id").alias("ids"))


def grain_over_months(states: DataFrame, lines: DataFrame, month: str) -> DataFrame:
    """``grain_unique`` from the states of the months: repeats inside months, and ids that stand in several months.

    An id can only stand in several months if its order does, so ids are looked at for such orders alone; nearly always there
    are none, and what is read of the lines is the order number. Such orders are written down: the join with a table that is seen
    to be small does not shuffle the lines, which it would if both sides were computed at the same time.
    """
    in_month = F.coalesce(F.col(month), F.lit(""))
    orders = lines.groupBy("order_number").agg(F.min(in_month).alias("first"), F.max(in_month).alias("last"))
    spread = stage(orders.filter("first <> last AND order_number IS NOT NULL").select("order_number"), "orders-of-several-months")
    ids = lines.join(spread, "order_number", "left_semi").filter("sales_line_id IS NOT NULL")
    again = ids.groupBy("sales_line_id").agg((F.count_distinct(in_month) - 1).alias("n"))
    both = states.select((F.col("lines") - F.col("ids")).alias("n")).unionByName(again.select("n"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations"))


def _with_gaps(of_fact: DataFrame, source_totals: DataFrame, params: Params) -> DataFrame:
    """One row: violations of every line rule and the absolute differences to the source's totals, from states of the fact."""
    rules = line_rules(params)
    kept = of_fact.select(*_TOTALS, *rules)
    sides = kept.unionByName(source_totals.select(*[(-F.col(n)).alias(n) for n in _TOTALS]), allowMissingColumns=True)
    gaps = [F.abs(F.coalesce(F.sum(n), F.lit(0))).alias(n) for n in _TOTALS]
    return sides.agg(*gaps, *[F.coalesce(F.sum(rule), F.lit(0)).alias(rule) for rule in rules])


def quality_report(fact: DataFrame, source_totals: DataFrame, dims: dict[str, DataFrame], products: DataFrame, params: Params) -> DataFrame:
    """One row per rule: ``check``, ``violations`` (double). ``source_totals`` has rows, net_sales and cogs.

    The fact is joined once and written with the columns that rules read; every pass is over that.
    """
    lines = stage(fact.select(*_RULE_COLUMNS), "audited-lines")
    usage = stage(usage_state(lines), "key-usage")
    return report_from_states(rule_state(lines, params), usage, grain_unique(lines), source_totals, dims, products, params)


def report_from_states(
    rules_of: DataFrame, usage: DataFrame, grain: DataFrame, source_totals: DataFrame, dims: dict[str, DataFrame],
    products: DataFrame, params: Params,
) -> DataFrame:
    """``quality_report`` from the states of one or more disjoint sets of lines and the violations of the grain."""
    rules = line_rules(params)
    local = _with_gaps(rules_of, source_totals, params)

    def used(index: int) -> DataFrame:
        return usage.filter(F.col("usage_set") == index)

    parties = (
        _without_match(used(4).filter(F.col("channel") == params.b2b), dims["reseller"], "reseller_key")
        .select("lines")
        .unionByName(
            _without_match(used(5).filter(F.col("channel") == params.b2c), dims["customer"], "customer_key").select("lines")
        )
    )

    def named(rule: str, violations: Column) -> dict[str, Column]:
        return {"check": F.lit(rule), "violations": dbl(violations)}

    def single(rule: str, result: DataFrame) -> DataFrame:
        return result.select(F.lit(rule).alias("check"), dbl("violations").alias("violations"))

    parts = [
        local.select(
            rows_from(
                *[named(rule, F.col(rule)) for rule in rules],
                named("chk_fact_rows_equal_staging", F.col("rows")),
                named("chk_net_sales_reconcile_staging", F.col("net_sales")),
                named("chk_cogs_reconcile_staging", F.col("cogs")),
            )
        ),
        single("chk_fact_grain_unique", grain),
        single("chk_orphan_sku_category", _lines_total(_without_category(used(0), dims["sku"]))),
        single("chk_orphan_dates", _lines_total(_without_match(used(1), dims["date"], "date_key"))),
        single("chk_orphan_territories", _lines_total(_without_match(used(2), dims["territory"], "territory_key"))),
        single("chk_orphan_promotions", _lines_total(_without_match(used(3), dims["promotion"], "promotion_key"))),
        single("chk_orphan_resellers_customers", _lines_total(parties)),
        single("chk_sku_has_unique_category", sku_has_unique_category(products)),
    ]
    return reduce(DataFrame.unionByName, parts)


def quality_gate(report: DataFrame, params: Params, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Return ``report`` when every rule holds, otherwise raise. Only the failing rows (one per rule) reach the driver."""
    bad = report.filter((F.col("violations") > params.gate_tolerance) & ~F.col("check").isin(*ignore)).orderBy("check").collect()
    if bad:
        raise QualityError("; ".join(f"{row['check']}: {row['violations']:g}" for row in bad))
    return report


# ---- information and coverage ------------------------------------------------------------------------------------


def period_coverage(fact: DataFrame) -> DataFrame:
    return fact.groupBy("channel").agg(
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"), F.count(F.lit(1)).alias("lines")
    ).orderBy("channel")


def _month() -> Column:
    return F.date_format("order_date", "yyyy-MM")


def period_month_coverage(lines: DataFrame) -> DataFrame:
    return lines.groupBy("period").agg(
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"),
        F.count_distinct(_month()).alias("months"),
    ).orderBy("period")


def months_missing_a_channel(lines: DataFrame) -> DataFrame:
    """(period, month) pairs in which fewer than two channels sold anything."""
    per_month = lines.groupBy("period", _month().alias("month")).agg(F.count_distinct("channel").alias("channels"))
    return per_month.filter(F.col("channels") < 2)


def product_version_count(products: DataFrame) -> DataFrame:
    return products.agg(F.count(F.lit(1)).alias("product_keys"), F.count_distinct("sku").alias("skus"))


def channel_discount_total(fact: DataFrame, channel: str) -> DataFrame:
    of_channel = fact.filter(F.col("channel") == channel)
    return of_channel.agg(dbl(F.coalesce(F.sum("discount_amount"), F.lit(0))).alias("discounts"))


def last_order_of_channel(fact: DataFrame, channel: str, params: Params) -> DataFrame:
    """Newest order of a channel, and whether it lies no later than the end of P1."""
    newest = F.max("order_date")
    return fact.filter(F.col("channel") == channel).agg(
        newest.alias("last_order"), (newest <= F.lit(params.p1_end)).alias("inside_p1")
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# Name fragments that mark a personal column.
PERSONAL_FRAGMENTS = (
    "email", "phone", "first", "last_name", "birth", "address", "yearlyincome", "name_style",
)
# Column names that contain one of the fragments and hold no personal data.
NOT_PERSONAL = ("first_order",)


def personal_columns(tables: dict[str, DataFrame]) -> list[str]:
    """``table.column`` of every column whose name looks personal; reads schemas only."""
    return [
        f"{name}.{column}"
        for name, df in tables.items()
        for column in df.columns
        if column.lower() not in NOT_PERSONAL and any(fragment in column.lower() for fragment in PERSONAL_FRAGMENTS)
    ]


def coverage_by_period(lines: DataFrame, params: Params) -> DataFrame:
    """Window bounds and labels of each period next to what the data holds for it."""
    known = tagged(lines).groupBy("period").agg(F.count(F.lit(1)).alias("lines"))
    is_p0 = F.col("period") == "P0"
    return known.select(
        "period",
        F.when(is_p0, params.p0_label).otherwise(params.p1_label).alias("label"),
        F.when(is_p0, F.lit(params.p0_start)).otherwise(F.lit(params.p1_start)).alias("start_date"),
        F.when(is_p0, F.lit(params.p0_end)).otherwise(F.lit(params.p1_end)).alias("end_date"),
        "lines",
    )

"""Named queries over a sales model."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from marginlens.operators import bridge, discounts, kpi, model, pareto, quality, report, summary, whatif
from marginlens.plans import files, stored
from marginlens.plans.model import SalesModel

Query = Callable[[SalesModel], DataFrame]

FINE_CUTS = (Decimal("0.02"), Decimal("0.05"), Decimal("0.08"))
LINE_LEVEL = (0.08, -2.0, 0.9)



def _cents(df: DataFrame) -> DataFrame:
    """Sums of doubles to two decimals: the digits that do not depend on the order of summation."""
    return df.select(*[F.round(c, 2).alias(c) for c in df.columns])


_MODEL: dict[str, Query] = {
    "dim_date": lambda m: m.dim_date,
    "dim_product": lambda m: m.dim_product,
    "dim_sku": lambda m: m.dim_sku,
    "dim_territory": lambda m: m.dim_territory,
    "dim_geography": lambda m: m.dim_geography,
    "dim_customer": lambda m: m.dim_customer,
    "dim_reseller": lambda m: m.dim_reseller,
    "dim_promotion": lambda m: m.dim_promotion,
    "dim_channel": lambda m: model.channel_usage(m.bare_lines(), m.dim_channel),
    "fact_sales": lambda m: m.fact(),
    "fact_preview": lambda m: report.fact_preview(m.fact()),
    "sales_period": lambda m: m.sales_period,
    "period_labels": lambda m: quality.coverage_by_period(m.bare_period, m.params),
}


def _line_rule(rule: str) -> Query:
    return lambda m: quality.line_rule(m.fact(), rule, m.params)


_QUALITY: dict[str, Query] = {
    "chk_fact_rows_equal_staging": lambda m: quality.reconciles(m.fact(), m.source_totals("rows"), "rows"),
    "chk_fact_grain_unique": lambda m: m.grain(),
    "chk_net_sales_reconcile_staging": lambda m: quality.reconciles(m.fact(), m.source_totals("net_sales"), "net_sales"),
    "chk_cogs_reconcile_staging": lambda m: quality.reconciles(m.fact(), m.source_totals("cogs"), "cogs"),
    "chk_orphan_products": _line_rule("chk_orphan_products"),
    "chk_orphan_sku_category": lambda m: quality.orphan_sku_category(m.fact(), m.skus("category")),
    "chk_orphan_dates": lambda m: quality.orphan_keys(m.fact(), m.dim_date, "date_key"),
    "chk_orphan_territories": lambda m: quality.orphan_keys(m.fact(), m.dim_territory, "territory_key"),
    "chk_orphan_promotions": lambda m: quality.orphan_keys(m.fact(), m.dim_promotion, "promotion_key"),
    "chk_channel_keys": lambda m: quality.line_rule(m.bare_lines(), "chk_channel_keys", m.params),
    "chk_orphan_resellers_customers": lambda m: quality.orphan_parties(m.fact(), m.dim_reseller, m.dim_customer, m.params),
    "chk_gross_amount_identity": _line_rule("chk_gross_amount_identity"),
    "chk_net_identity": _line_rule("chk_net_identity"),
    "chk_cogs_identity": _line_rule("chk_cogs_identity"),
    "chk_discount_identity": _line_rule("chk_discount_identity"),
    "chk_positive_quantities_and_costs": _line_rule("chk_positive_quantities_and_costs"),
    "chk_sku_has_unique_category": lambda m: quality.sku_has_unique_category(m.dim_product),
    "info_period_coverage": lambda m: quality.period_coverage(m.bare_lines()),
    "quality_report": lambda m: m.quality_report(),
    "fact_margin_discount_identity": lambda m: quality.margin_discount_identity(m.fact(), m.params),
    "period_month_coverage": lambda m: quality.period_month_coverage(m.bare_period),
    "months_missing_a_channel": lambda m: quality.months_missing_a_channel(m.bare_period),
    "product_version_count": lambda m: quality.product_version_count(m.dim_product),
    "channel_discount_total": lambda m: quality.channel_discount_total(m.bare_lines(), m.params.b2c),
    "last_order_of_channel": lambda m: quality.last_order_of_channel(m.bare_lines(), m.params.b2b, m.params),
    "staging_row_counts": lambda m: quality.row_counts(m.staging_tables()),
}

_KPI: dict[str, Query] = {
    "kpi_summary": lambda m: kpi.kpi_summary(m.sales_period),
    "kpi_by_category": lambda m: kpi.kpi_by_category(m.sales_period, m.skus("category")),
    "kpi_by_subcategory": lambda m: kpi.kpi_by_subcategory(m.p1, m.skus("category", "subcategory")),
    "kpi_by_territory": lambda m: kpi.kpi_by_territory(m.p1, m.dim_territory),
    "kpi_by_reseller_type": lambda m: kpi.kpi_by_reseller_type(m.p1, m.dim_reseller),
    "kpi_monthly": lambda m: kpi.kpi_monthly(m.fact(), m.dim_date),
    "kpi_by_calendar_year": lambda m: kpi.kpi_by_calendar_year(m.fact(), m.dim_date),
    "kpi_price_structure": lambda m: kpi.kpi_price_structure(m.p1, m.skus("category"), m.params),
}

_BRIDGE: dict[str, Query] = {
    "pvm_lines": lambda m: m.pvm_lines,
    "pvm_lines_outer": lambda m: bridge.pvm_lines(bridge.compare_periods_by_join(m.sales_period)),
    "pvm_bridge": lambda m: bridge.pvm_bridge(m.compared, m.params),
    "pvm_by_channel": lambda m: bridge.pvm_by_channel(m.compared),
    "pvm_by_category": lambda m: bridge.pvm_by_category(m.compared, m.skus("category")),
    "pvm_top_cost_increases": lambda m: bridge.pvm_top_cost_increases(m.compared, m.skus("product_name")),
    "pvm_bridge_totals": lambda m: _cents(bridge.bridge_totals(m.compared)),
    "pvm_identity_gap": lambda m: _cents(bridge.identity_gap(m.compared)),
    "pvm_partition_audit": lambda m: bridge.partition_audit(m.pvm_lines),
}


def _losses(m: SalesModel) -> DataFrame:
    return pareto.loss_making_sku_channel(m.p1, m.skus("product_name", "category", "subcategory"))


_PARETO: dict[str, Query] = {
    "pareto_sku": lambda m: m.pareto_sku,
    "pareto_reseller": lambda m: m.pareto_reseller,
    "abc_sku_summary": lambda m: pareto.abc_summary(m.pareto_sku, "skus"),
    "abc_reseller_summary": lambda m: pareto.abc_summary(m.pareto_reseller, "resellers"),
    "loss_making_sku_channel": _losses,
    "pareto_peak": lambda m: pareto.pareto_peak(m.pareto_sku),
    "pareto_argmax": lambda m: pareto.pareto_argmax(m.pareto_sku),
    "worst_skus": lambda m: pareto.worst_items(pareto.sku_margins(m.p1, m.skus("product_name", "category", "subcategory"), m.params)),
    "hidden_loss_skus": lambda m: pareto.hidden_losses(m.p1, m.skus("category")),
    "pareto_audit_sku": lambda m: pareto.pareto_audit(
        pareto.rank_items(pareto.sku_margins(m.p1, m.skus("product_name", "category", "subcategory"), m.params), "sku"), m.params
    ),
    "pareto_audit_reseller": lambda m: pareto.pareto_audit(
        pareto.rank_items(pareto.reseller_margins(m.p1, m.dim_reseller, m.params), "reseller_key"), m.params
    ),
    "abc_points_by_class": lambda m: pareto.abc_points_by_class(m.pareto_sku),
}

_DISCOUNTS: dict[str, Query] = {
    "disc_by_promotion": lambda m: discounts.disc_by_promotion(m.p1, m.promotion_names, m.params),
    "disc_depth_buckets": lambda m: discounts.disc_depth_buckets(m.p1, m.params),
    "disc_depth_buckets_fine": lambda m: discounts.disc_depth_buckets(m.p1, m.params, FINE_CUTS),
    "disc_turning_lines_negative": lambda m: discounts.disc_turning_lines_negative(m.p1, m.params),
    "disc_summary": lambda m: discounts.disc_summary(m.p1, m.params),
    "disc_lines_p1": lambda m: discounts.disc_lines_p1(m.p1, m.params),
    "new_product_promos": lambda m: discounts.new_product_promos(m.p1, m.promotion_names, m.params),
    "already_below_cost": lambda m: discounts.already_below_cost(m.p1, m.params),
}


def _segment(m: SalesModel) -> DataFrame:
    return whatif.segment(_losses(m))


_WHATIF: dict[str, Query] = {
    "segment": _segment,
    "segment_by_category": lambda m: whatif.segment(_losses(m), "category"),
    "loss_segment_direct": lambda m: whatif.loss_segment_direct(m.p1),
    "price_grid": lambda m: whatif.price_grid(_segment(m), m.params.price_steps, m.params.elasticities),
    "price_grid_by_category": lambda m: whatif.price_grid(
        whatif.segment(_losses(m), "category"), m.params.price_steps, m.params.elasticities, by=("category",)
    ),
    "price_table": lambda m: whatif.price_table(_segment(m), m.params.price_steps, m.params.elasticities),
    "price_change": lambda m: whatif.price_sensitivity(_segment(m), m.params.price_steps[-1], m.params.elasticities[1], 1.0),
    "price_sensitivity": lambda m: whatif.price_sensitivity(_segment(m), *m.params.sensitivity),
    "break_even_elasticity": lambda m: whatif.break_even_by_step(_segment(m), m.params.price_steps),
    "break_even_elasticity_all_sales": lambda m: whatif.break_even_by_step(whatif.segment(m.p1), m.params.price_steps),
    "stop_selling": lambda m: whatif.stop_selling_by_share(_segment(m), m.params.variable_shares),
    "stop_selling_curve": lambda m: whatif.stop_selling_curve(_segment(m)),
    "break_even_variable_share": lambda m: whatif.break_even_share(_segment(m)),
    "discount_rule_no_discount_below_cost": lambda m: whatif.discount_rules(
        discounts.disc_lines_p1(m.p1, m.params), [whatif.DiscountRule("no_discount_below_cost")]
    ),
    "discount_rule_cap": lambda m: whatif.discount_rules(
        discounts.disc_lines_p1(m.p1, m.params), [whatif.DiscountRule("cap", cap) for cap in m.params.discount_caps]
    ),
    "price_change_line_level": lambda m: _cents(whatif.price_change_line_level(m.p1, *LINE_LEVEL)),
}

_SUMMARY: dict[str, Query] = {
    "kpi_matrix": lambda m: summary.kpi_matrix(kpi.kpi_summary(m.sales_period)),
    "growth": lambda m: summary.growth(summary.kpi_matrix(kpi.kpi_amounts(m.sales_period)), m.params),
    "channel_evolution": lambda m: summary.channel_evolution(summary.kpi_matrix(kpi.kpi_amounts(m.sales_period))),
    "internet_plus10_margin": lambda m: summary.internet_plus10_margin(
        summary.kpi_matrix(kpi.kpi_amounts(m.sales_period)), m.params
    ),
    "b2b_share_of_sales": lambda m: summary.b2b_share_of_sales(summary.kpi_matrix(kpi.kpi_amounts(m.sales_period)), m.params),
    "categories_p1": lambda m: summary.categories_p1(kpi.kpi_by_category(m.sales_period, m.skus("category"))),
    "price_structure_labelled": lambda m: summary.price_structure_labelled(kpi.kpi_price_structure(m.p1, m.skus("category"), m.params)),
    "loss_making_summary": lambda m: summary.loss_making_summary(m.p1, m.skus("category"), m.params),
    "loss_by_category": lambda m: summary.loss_by_category(_losses(m)),
    "loss_top8": lambda m: summary.loss_top(_losses(m)),
    "pricing_vs_cost": lambda m: summary.pricing_vs_cost(m.compared, m.params),
}

_REPORT: dict[str, Query] = {
    "waterfall_steps": lambda m: report.waterfall_steps(bridge.pvm_bridge(m.compared, m.params)),
    "waterfall_steps_by_channel": lambda m: report.waterfall_steps_by_channel(bridge.pvm_by_channel(m.compared), m.params),
    "subcategory_pivot_top10": lambda m: report.subcategory_pivot_top(kpi.kpi_by_subcategory(m.p1, m.skus("category", "subcategory")), m.params),
    "monthly_window": lambda m: report.monthly_window(kpi.kpi_monthly(m.reported_months, m.dim_date), m.params),
    "worst_month": lambda m: report.worst_month(kpi.kpi_monthly(m.reported_months, m.dim_date), m.params),
    "promo_top6": lambda m: report.promo_top(discounts.disc_by_promotion(m.p1, m.promotion_names, m.params)),
    "worst_cost_increase": lambda m: report.worst_cost_increase(bridge.pvm_top_cost_increases(m.compared, m.skus("product_name"))),
    "note_lookups": lambda m: report.note_lookups(
        kpi.kpi_by_subcategory(m.p1, m.skus("category", "subcategory")),
        pareto.abc_summary(m.pareto_sku, "skus"),
        pareto.abc_summary(m.pareto_reseller, "resellers"),
        quality.period_coverage(m.bare_lines()),
        m.params,
    ),
}

# Through files: the delimited source layouts, the CSV export and the JSON results, on whole tables.
_FILES: dict[str, Query] = {
    "files_fact_sales": lambda m: files.delimited_copy(m, files.SALES_FILES).fact(),
    "files_dim_product": lambda m: files.delimited_copy(m, files.PRODUCT_FILES).dim_product,
    "files_dim_customer": lambda m: files.delimited_copy(m, files.CUSTOMER_FILES).dim_customer,
    "files_dim_reseller": lambda m: files.delimited_copy(m, files.RESELLER_FILES).dim_reseller,
    "files_dim_territory": lambda m: files.delimited_copy(m, ("DimSalesTerritory",)).dim_territory,
    "files_dim_promotion": lambda m: files.delimited_copy(m, ("DimPromotion",)).dim_promotion,
    "files_dim_date": lambda m: files.delimited_copy(m, ("DimDate",)).dim_date,
    "files_kpi_summary": lambda m: kpi.kpi_summary(files.delimited_copy(m, files.SALES_FILES).sales_period),
    "files_row_counts": lambda m: quality.row_counts(files.delimited_copy(m).staging_tables()),
    "export_reconcile": files.export_reconcile,
    "results_json_bridge": lambda m: files.json_round_trip(m, "pvm_bridge", bridge.pvm_bridge(m.compared, m.params)),
}

# The exported tables that have a query of their own, and the queries that are answered from the stored model too.
EXPORTED = (
    "dim_date", "dim_product", "dim_sku", "dim_territory", "dim_customer", "dim_reseller", "dim_promotion", "fact_sales",
    "pvm_lines", "pareto_sku", "pareto_reseller", "kpi_monthly", "pvm_bridge", "kpi_by_calendar_year",
)
STORED = ("fact_sales", "dim_sku", "kpi_summary", "kpi_monthly", "pvm_bridge", "pvm_by_category", "pareto_sku", "quality_report")

_OF_MODEL = {**_MODEL, **_QUALITY, **_KPI, **_BRIDGE, **_PARETO, **_DISCOUNTS, **_WHATIF, **_SUMMARY, **_REPORT}


def _exported(name: str) -> Query:
    return lambda m: files.csv_round_trip(m, name, _OF_MODEL[name](m))


def _stored(name: str) -> Query:
    return lambda m: stored.over_stored(m, name)


_FILES["results_json"] = stored.every_result
_FILES |= {f"export_{name}": _exported(name) for name in EXPORTED}
_STORED: dict[str, Query] = {f"stored_{name}": _stored(name) for name in STORED}

CATALOG: dict[str, Query] = {
    **_FILES, **_STORED, **_MODEL, **_QUALITY, **_KPI, **_BRIDGE, **_PARETO, **_DISCOUNTS, **_WHATIF, **_SUMMARY, **_REPORT,
}


def query(m: SalesModel, name: str) -> DataFrame:
    if name not in CATALOG:
        raise KeyError(f"unknown query: {name}")
    return CATALOG[name](m)


def as_doubles(df: DataFrame) -> DataFrame:
    """DECIMAL columns as DOUBLE, for readers that compare across engines."""
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name) for f in df.schema]
    )

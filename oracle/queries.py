"""Oracle statement of every catalog query."""

from __future__ import annotations

from marginlens.operators.discounts import depth_labels
from marginlens.operators.quality import CHECKS
from marginlens.plans.catalog import FINE_CUTS, LINE_LEVEL
from oracle.base import P, compose, dbl, pct, whole

ORACLES: dict[str, str] = {}

_MONEY_FACT = (
    "unit_price", "gross_amount", "discount_amount", "net_sales", "unit_cogs", "cogs", "gross_margin", "margin_before_discount",
)


def doubles(*names: str) -> str:
    return ", ".join(f"{dbl(n)} AS {n}" for n in names)


# ---- model -------------------------------------------------------------------------------------------------------

_FACT = f"""sales_line_id, channel, order_number, order_line, order_date, date_key, product_key, sku, reseller_key,
    customer_key, territory_key, promotion_key, quantity, discount_pct, is_below_cost, {doubles(*_MONEY_FACT)}"""

ORACLES["dim_date"] = compose(
    "SELECT date_key, date, CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter, CAST(month AS INTEGER) AS month,"
    " month_name, month_name_fr, year_month FROM days", "days")
ORACLES["dim_product"] = compose(
    f"SELECT * EXCLUDE (standard_cost, list_price, dealer_price), {doubles('standard_cost', 'list_price', 'dealer_price')}"
    " FROM products", "products")
ORACLES["dim_sku"] = compose("SELECT * FROM skus", "skus")
ORACLES["dim_territory"] = compose("SELECT * FROM territories", "territories")
ORACLES["dim_geography"] = compose("SELECT * FROM places", "places")
ORACLES["dim_customer"] = compose("SELECT * FROM consumers", "consumers")
ORACLES["dim_reseller"] = compose("SELECT * FROM resellers", "resellers")
ORACLES["dim_promotion"] = compose("SELECT * FROM promotions", "promotions")
ORACLES["dim_channel"] = compose(
    f"""SELECT CAST(channel_key AS INTEGER) AS channel_key, channel,
               (SELECT count(*) FROM fact WHERE fact.channel = c.channel) AS lines
        FROM (VALUES (1, '{P.b2b}'), (2, '{P.b2c}')) AS c(channel_key, channel)""", "fact")
ORACLES["fact_sales"] = compose(f"SELECT {_FACT} FROM fact", "fact")
ORACLES["fact_preview"] = compose(
    f"""SELECT sales_line_id, channel, order_date, sku, quantity, is_below_cost,
               {doubles('unit_price', 'discount_amount', 'net_sales', 'cogs', 'gross_margin')}
        FROM (SELECT * FROM fact ORDER BY sales_line_id, channel, order_date, sku, quantity, unit_price, discount_amount LIMIT 5)""",
    "fact")
ORACLES["sales_period"] = compose(f"SELECT {_FACT}, period FROM period_lines", "period_lines")
ORACLES["period_labels"] = compose(
    f"""SELECT period, if(period = 'P0', '{P.p0_label}', '{P.p1_label}') AS label,
               if(period = 'P0', DATE '{P.p0_start}', DATE '{P.p1_start}') AS start_date,
               if(period = 'P0', DATE '{P.p0_end}', DATE '{P.p1_end}') AS end_date, count(*) AS lines
        FROM period_lines WHERE period IS NOT NULL GROUP BY period""", "period_lines")

# ---- quality -----------------------------------------------------------------------------------------------------

_TOL = P.identity_tolerance


def _violating(condition: str) -> str:
    return f"SELECT count(*) FILTER ({condition}) AS violations FROM fact"


def _orphans(dim: str, key: str) -> str:
    return f"SELECT count(*) AS violations FROM fact WHERE NOT EXISTS (FROM {dim} WHERE {dim}.{key} = fact.{key})"


_CHECKS = {
    "chk_fact_rows_equal_staging": (
        "SELECT abs((SELECT count(*) FROM fact) - (SELECT count(*) FROM lineitem)) AS violations", ("fact",)),
    "chk_fact_grain_unique": (
        "SELECT CAST(sum(n - 1) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM fact GROUP BY sales_line_id)", ("fact",)),
    "chk_net_sales_reconcile_staging": (
        f"SELECT {dbl('abs((SELECT sum(net_sales) FROM fact) - (SELECT sum(gross - CAST(gross * rate AS DECIMAL(19,4))) FROM raw))')} AS violations", ("fact", "raw")),
    "chk_cogs_reconcile_staging": (
        f"SELECT {dbl('abs((SELECT sum(cogs) FROM fact) - (SELECT sum(cogs) FROM lines))')} AS violations", ("fact",)),
    "chk_orphan_products": (_violating("sku IS NULL"), ("fact",)),
    "chk_orphan_sku_category": (
        "SELECT count(*) AS violations FROM fact"
        " WHERE NOT EXISTS (FROM skus WHERE skus.sku = fact.sku AND category IS NOT NULL)", ("fact", "skus")),
    "chk_orphan_dates": (_orphans("days", "date_key"), ("fact", "days")),
    "chk_orphan_territories": (_orphans("territories", "territory_key"), ("fact", "territories")),
    "chk_orphan_promotions": (_orphans("promotions", "promotion_key"), ("fact", "promotions")),
    "chk_channel_keys": (
        _violating(f"CASE channel WHEN '{P.b2b}' THEN NOT (reseller_key IS NOT NULL AND customer_key IS NULL)"
                   f" WHEN '{P.b2c}' THEN NOT (customer_key IS NOT NULL AND reseller_key IS NULL) ELSE channel IS NULL END"), ("fact",)),
    "chk_orphan_resellers_customers": (
        f"""SELECT count(*) AS violations FROM fact
            WHERE (channel = '{P.b2b}' AND NOT EXISTS (FROM resellers WHERE resellers.reseller_key = fact.reseller_key))
               OR (channel = '{P.b2c}' AND NOT EXISTS (FROM consumers WHERE consumers.customer_key = fact.customer_key))""",
        ("fact", "resellers", "consumers")),
    "chk_gross_amount_identity": (_violating(f"abs(quantity * unit_price - gross_amount) > {_TOL}"), ("fact",)),
    "chk_net_identity": (_violating(f"abs(net_sales + discount_amount - gross_amount) > {_TOL}"), ("fact",)),
    "chk_cogs_identity": (_violating(f"abs(quantity * unit_cogs - cogs) > {_TOL}"), ("fact",)),
    "chk_discount_identity": (_violating(f"abs(discount_pct * gross_amount - discount_amount) > {_TOL}"), ("fact",)),
    "chk_positive_quantities_and_costs": (
        _violating("NOT (quantity > 0 AND unit_cogs > 0 AND unit_price > 0)"), ("fact",)),
    "chk_sku_has_unique_category": (
        "SELECT count(*) AS violations FROM (SELECT sku FROM products GROUP BY sku HAVING min(category) <> max(category))",
        ("products",)),
}
for _name, (_body, _blocks) in _CHECKS.items():
    ORACLES[_name] = compose(_body, *_blocks)

ORACLES["quality_report"] = compose(
    "\nUNION ALL ".join(
        f"""SELECT '{name}' AS "check", {dbl('violations')} AS violations FROM ({_CHECKS[name][0]})""" for name in CHECKS),
    *dict.fromkeys(block for name in CHECKS for block in _CHECKS[name][1]))
ORACLES["info_period_coverage"] = compose(
    "SELECT channel, min(order_date) AS first_order, max(order_date) AS last_order, count(*) AS lines FROM fact GROUP BY channel",
    "fact")
ORACLES["fact_margin_discount_identity"] = compose(
    _violating(f"abs(discount_amount - margin_before_discount + gross_margin) > {_TOL}"), "fact")
ORACLES["period_month_coverage"] = compose(
    """SELECT period, min(order_date) AS first_order, max(order_date) AS last_order,
              count(DISTINCT date_trunc('month', order_date)) AS months FROM period_lines GROUP BY period""", "period_lines")
ORACLES["months_missing_a_channel"] = compose(
    """SELECT period, strftime(order_date, '%Y-%m') AS month, count(DISTINCT channel) AS channels
       FROM period_lines GROUP BY ALL HAVING channels < 2""", "period_lines")
ORACLES["product_version_count"] = compose(
    "SELECT count(*) AS product_keys, count(DISTINCT sku) AS skus FROM products", "products")
ORACLES["channel_discount_total"] = compose(
    f"SELECT {dbl('coalesce(sum(discount_amount), 0)')} AS discounts FROM fact WHERE channel = '{P.b2c}'", "fact")
ORACLES["last_order_of_channel"] = compose(
    f"""SELECT max(order_date) AS last_order, max(order_date) <= DATE '{P.p1_end}' AS inside_p1
        FROM fact WHERE channel = '{P.b2b}'""", "fact")
ORACLES["staging_row_counts"] = compose(
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows FROM ({source})"
        for name, source in {
            "products": "FROM part",
            "subcategories": "SELECT DISTINCT p_type, p_brand FROM part",
            "categories": "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL",
            "dates": "FROM days",
            "resellers": "FROM resellers",
            "customers": "FROM consumers",
            "geographies": "FROM places",
            "territories": "FROM territories",
            "promotions": "FROM promotions",
            "sales_lines": "FROM lines",
        }.items()),
    "days", "resellers", "consumers", "places", "territories", "promotions", "lines")

# ---- key figures -------------------------------------------------------------------------------------------------

_SALES_MARGIN = f"""{whole('sum(net_sales)')} AS net_sales, {whole('sum(gross_margin)')} AS gross_margin,
    {pct('sum(gross_margin)', 'sum(net_sales)', 2)} AS margin_pct"""
_UNITS = "CAST(sum(quantity) AS BIGINT) AS units"

_SUMMARY_BODY = f"""
    SELECT period, channel, is_total, {_SALES_MARGIN}, {whole('sum(cogs)')} AS cogs,
           {whole('sum(gross_amount)')} AS gross_amount, {whole('sum(discount_amount)')} AS discounts,
           {pct('sum(discount_amount)', 'sum(gross_amount)', 2)} AS discount_pct_of_gross, {_UNITS},
           count(DISTINCT order_number) AS orders, count(*) AS lines,
           {pct('count(*) FILTER (is_below_cost)', 'count(is_below_cost)', 1)} AS pct_lines_below_cost,
           {whole('sum(gross_margin) FILTER (is_below_cost)')} AS loss_on_below_cost_lines
    FROM (SELECT *, FALSE AS is_total FROM period_lines
          UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS channel), TRUE AS is_total FROM period_lines)
    WHERE period IS NOT NULL GROUP BY period, channel, is_total"""
ORACLES["kpi_summary"] = compose(_SUMMARY_BODY, "period_lines")

_BY_CATEGORY = f"SELECT period, category, channel, {_SALES_MARGIN}, {_UNITS} FROM period_lines JOIN skus USING (sku) GROUP BY ALL"
ORACLES["kpi_by_category"] = compose(_BY_CATEGORY, "period_lines", "skus")
_BY_SUBCATEGORY = f"SELECT category, subcategory, channel, {_SALES_MARGIN}, {_UNITS} FROM p1 JOIN skus USING (sku) GROUP BY ALL"
ORACLES["kpi_by_subcategory"] = compose(_BY_SUBCATEGORY, "p1", "skus")
ORACLES["kpi_by_territory"] = compose(
    f"""SELECT territory_group, country, region, channel, {_SALES_MARGIN}
        FROM p1 JOIN territories USING (territory_key) GROUP BY ALL""", "p1", "territories")
ORACLES["kpi_by_reseller_type"] = compose(
    f"""SELECT business_type, count(DISTINCT reseller_key) AS resellers, {_SALES_MARGIN},
               {pct('sum(discount_amount)', 'sum(gross_amount)', 2)} AS discount_pct_of_gross
        FROM p1 JOIN resellers USING (reseller_key) GROUP BY business_type""", "p1", "resellers")
_MONTHLY = f"SELECT year_month, channel, {_SALES_MARGIN} FROM fact JOIN days USING (date_key) GROUP BY ALL"
ORACLES["kpi_monthly"] = compose(_MONTHLY, "fact", "days")
ORACLES["kpi_by_calendar_year"] = compose(
    f"""SELECT CAST(year(order_date) AS INTEGER) AS year, channel, {_SALES_MARGIN},
               count(DISTINCT month(order_date)) AS months_with_sales, count(DISTINCT month(order_date)) < 12 AS partial
        FROM fact GROUP BY ALL""", "fact")
_PRICE_PAIRS = f"""
    SELECT category, b2b.q AS q, b2b.net AS net, b2b.cost AS cost, b2c.net / b2c.q * b2b.q AS at_b2c
    FROM (SELECT sku, {dbl('sum(quantity)')} AS q, {dbl('sum(net_sales)')} AS net, {dbl('sum(cogs)')} AS cost
          FROM p1 WHERE channel = '{P.b2b}' GROUP BY sku) AS b2b
    JOIN (SELECT sku, {dbl('sum(quantity)')} AS q, {dbl('sum(net_sales)')} AS net
          FROM p1 WHERE channel = '{P.b2c}' GROUP BY sku) AS b2c USING (sku)
    JOIN skus USING (sku)"""
_PRICE_STRUCTURE = f"""
    SELECT category, is_total, count(*) AS skus, {pct('sum(net)', 'sum(at_b2c)', 1)} AS reseller_price_pct_of_internet,
           {pct('sum(cost)', 'sum(net)', 1)} AS cogs_pct_of_reseller_price
    FROM (SELECT *, FALSE AS is_total FROM pairs
          UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS category), TRUE AS is_total FROM pairs)
    GROUP BY category, is_total"""
ORACLES["kpi_price_structure"] = compose(_PRICE_STRUCTURE, "p1", "skus", pairs=_PRICE_PAIRS)

# ---- bridge ------------------------------------------------------------------------------------------------------

_EFFECTS = ("volume_effect", "mix_effect", "price_effect", "discount_effect", "cost_effect", "new_effect", "discontinued_effect")
_GROUP_NAMES = ("margin_p0", "volume", "mix", "price", "discounts", "cost", "new_products", "discontinued", "margin_p1")
_VALUES = ("margin0", *_EFFECTS, "margin1")
_GROUP_SUMS = ", ".join(f"round(sum({v}), 0) AS {n}" for n, v in zip(_GROUP_NAMES, _VALUES))
_ALL_EFFECTS = " + ".join(_EFFECTS)

ORACLES["pvm_lines"] = ORACLES["pvm_lines_outer"] = compose("SELECT * FROM effects", "effects")
_BRIDGE = "\nUNION ALL ".join(
    f"SELECT '{label}' AS step, {i} AS ord, round(sum({v}), 0) AS value FROM effects"
    for i, (label, v) in enumerate(zip(P.bridge_steps, _VALUES)))
ORACLES["pvm_bridge"] = compose(_BRIDGE, "effects")
_BY_CHANNEL = f"SELECT channel, {_GROUP_SUMS} FROM effects GROUP BY channel"
ORACLES["pvm_by_channel"] = compose(_BY_CHANNEL, "effects")
ORACLES["pvm_by_category"] = compose(
    f"SELECT category, {_GROUP_SUMS} FROM effects JOIN skus USING (sku) GROUP BY category", "effects", "skus")
_TOP_COST = """
    SELECT product_name, channel, q1 AS units_p1, round(cost_effect, 0) AS cost_effect,
           round(100.0 * (unit_cogs1 / unit_cogs0 - 1), 1) AS unit_cost_increase_pct
    FROM (SELECT * FROM effects JOIN skus USING (sku) WHERE q0 > 0 AND q1 > 0 ORDER BY cost_effect, sku, channel LIMIT 10)"""
ORACLES["pvm_top_cost_increases"] = compose(_TOP_COST, "effects", "skus")
ORACLES["pvm_bridge_totals"] = compose(
    f"SELECT {', '.join(f'round(sum({v}), 2) AS {v}' for v in _VALUES)} FROM effects", "effects")
ORACLES["pvm_identity_gap"] = compose(
    f"SELECT round(abs(sum(margin1 - margin0) - sum({_ALL_EFFECTS})), 2) AS gap FROM effects", "effects")
ORACLES["pvm_partition_audit"] = compose(
    f"""SELECT count(*) FILTER (q0 > 0 AND q1 > 0) AS continuing, count(*) FILTER (q0 = 0) AS new,
               count(*) FILTER (q1 = 0) AS discontinued,
               count(*) FILTER ((q0 > 0 AND q1 > 0)::INT + (q0 = 0)::INT + (q1 = 0)::INT <> 1) AS not_in_one_class,
               count(*) FILTER (NOT (q0 > 0 AND q1 > 0) AND greatest(abs(volume_effect), abs(mix_effect), abs(price_effect),
                                abs(discount_effect), abs(cost_effect)) > 0) AS stray_continuing_effects,
               count(*) FILTER (q0 <> 0 AND new_effect <> 0) AS stray_new_effects,
               count(*) FILTER (q1 <> 0 AND discontinued_effect <> 0) AS stray_discontinued_effects,
               count(*) FILTER (abs(delta_margin - ({_ALL_EFFECTS})) >= 0.01) AS lines_off_identity
        FROM effects""", "effects")

# ---- pareto ------------------------------------------------------------------------------------------------------

_RANKING = "margin_pct, rank_margin, n_items, pct_of_items, cum_margin_pct_of_net, cum_margin_pct_of_positive, abc_class"
ORACLES["pareto_sku"] = compose(
    f"""SELECT sku, product_name, category, subcategory, units,
               {doubles('net_sales', 'gross_margin', 'margin_resellers', 'margin_internet')}, {_RANKING} FROM sku_pareto""",
    "sku_pareto")
ORACLES["pareto_reseller"] = compose(
    f"""SELECT reseller_key, reseller_name, business_type, country, orders,
               {doubles('net_sales', 'gross_margin', 'discounts')}, {_RANKING} FROM reseller_pareto""", "reseller_pareto")


def _abc(table: str, counted: str) -> str:
    return f"""SELECT abc_class, count(*) AS {counted}, {pct('count(*)', 'any_value(n_items)', 1)} AS pct_of_{counted},
                      {whole('sum(net_sales)')} AS net_sales, {whole('sum(gross_margin)')} AS gross_margin
               FROM {table} GROUP BY abc_class"""


ORACLES["abc_sku_summary"] = compose(_abc("sku_pareto", "skus"), "sku_pareto")
ORACLES["abc_reseller_summary"] = compose(_abc("reseller_pareto", "resellers"), "reseller_pareto")
_LOSSES = f"""
    SELECT sku, product_name, category, subcategory, channel, {_UNITS}, sum(net_sales) AS net_sales, sum(cogs) AS cogs,
           sum(gross_margin) AS gross_margin, {pct('sum(gross_margin)', 'sum(net_sales)')} AS margin_pct
    FROM p1 JOIN skus USING (sku) GROUP BY sku, product_name, category, subcategory, channel HAVING sum(gross_margin) < 0"""
_LOSS_BLOCKS = ("p1", "skus")
ORACLES["loss_making_sku_channel"] = compose(
    f"SELECT * REPLACE ({doubles('net_sales', 'cogs', 'gross_margin')}) FROM losses", *_LOSS_BLOCKS, losses=_LOSSES)
ORACLES["pareto_peak"] = compose(
    f"""SELECT count(*) AS n_skus, max(cum_margin_pct_of_net) AS peak_cum_margin_pct,
               {pct("count(*) FILTER (abc_class = 'A')", "count(*)")} AS class_a_pct_of_skus FROM sku_pareto""", "sku_pareto")
ORACLES["pareto_argmax"] = compose(
    """SELECT pct_of_items AS pct_of_items_at_peak, cum_margin_pct_of_net AS peak_cum_margin_pct FROM sku_pareto
       WHERE cum_margin_pct_of_net IS NOT NULL ORDER BY cum_margin_pct_of_net DESC, rank_margin LIMIT 1""", "sku_pareto")
ORACLES["worst_skus"] = compose(
    f"""SELECT sku, product_name, category, {doubles('net_sales', 'gross_margin', 'margin_resellers', 'margin_internet')}
        FROM (SELECT * FROM sku_items ORDER BY gross_margin, sku LIMIT 10)""", "sku_items")
ORACLES["hidden_loss_skus"] = compose(
    """SELECT count(*) AS hidden_loss_pairs
       FROM (SELECT sku FROM p1 GROUP BY sku, channel HAVING sum(gross_margin) < 0) JOIN sku_items USING (sku)
       WHERE gross_margin > 0""", "sku_items")
for _side in ("sku", "reseller"):
    _t = f"{_side}_pareto"
    ORACLES[f"pareto_audit_{_side}"] = compose(
        f"""SELECT count(*) AS items, count(*) - count(DISTINCT rank_margin) AS repeated_ranks,
                   count(*) FILTER (rank_margin NOT BETWEEN 1 AND n_items) AS ranks_out_of_range,
                   count(*) FILTER (next_margin > gross_margin) AS order_breaks,
                   count(*) FILTER ((abc_class = 'D') <> (gross_margin < 0)) AS class_d_errors,
                   count(*) FILTER (rank_margin = n_items AND cum_margin <> total_margin) AS last_not_total,
                   count(*) FILTER (gross_margin >= 0 AND next_margin < 0 AND cum_margin <> total_positive) AS peak_not_total_positive,
                   count(*) FILTER (CASE abc_class WHEN 'A' THEN cum_before >= {P.class_a_share} * total_positive
                       WHEN 'B' THEN cum_before < {P.class_a_share} * total_positive OR cum_before >= {P.class_b_share} * total_positive
                       WHEN 'C' THEN cum_before < {P.class_b_share} * total_positive ELSE FALSE END) AS threshold_errors,
                   count(*) FILTER ((total_margin > 0) <> (cum_margin_pct_of_net IS NOT NULL)) AS net_base_errors,
                   {dbl("sum(gross_margin) FILTER (abc_class = 'A')")} AS class_a_margin
            FROM (SELECT *, lead(gross_margin) OVER (ORDER BY rank_margin) AS next_margin FROM {_t})""", _t)
ORACLES["abc_points_by_class"] = compose(
    f"""SELECT sku, abc_class, pct_of_items, cum_margin_pct_of_net, count(*) OVER (PARTITION BY abc_class) AS class_items,
               {pct('count(*) OVER (PARTITION BY abc_class)', 'n_items')} AS class_pct_of_items FROM sku_pareto""", "sku_pareto")

# ---- discounts ---------------------------------------------------------------------------------------------------

_BY_PROMOTION = f"""
    SELECT promotion_type, promotion_name, count(*) AS lines, {_UNITS}, {whole('sum(gross_amount)')} AS gross_amount,
           {whole('sum(discount_amount)')} AS discounts,
           {pct('sum(discount_amount)', 'sum(gross_amount)', 1)} AS discount_pct_of_gross,
           {whole('sum(margin_before_discount)')} AS margin_before, {whole('sum(gross_margin)')} AS margin_after,
           {pct('sum(gross_margin)', 'sum(net_sales)', 1)} AS margin_pct_after
    FROM p1 JOIN promotions USING (promotion_key) WHERE promotion_key <> {P.no_promotion_key}
    GROUP BY promotion_type, promotion_name"""
ORACLES["disc_by_promotion"] = compose(_BY_PROMOTION, "p1", "promotions")


def _depth_sql(cuts) -> str:
    labels = depth_labels(cuts)
    ranges = [(None, labels[0], "discount_pct = 0")]
    low = 0
    for cut, label in zip(cuts, labels[1:]):
        ranges.append((low, label, f"discount_pct > {dbl(str(low))} AND discount_pct <= {dbl(str(cut))}"))
        low = cut
    ranges.append((low, labels[-1], f"discount_pct > {dbl(str(low))}"))
    cases = " ".join(f"WHEN {condition} THEN '{label}'" for _, label, condition in ranges)
    return f"""SELECT CASE {cases} END AS depth, count(*) AS lines,
                      round({dbl('sum(quantity)')} / {dbl('count(*)')}, 1) AS avg_units_per_line,
                      {whole('sum(discount_amount)')} AS discounts, {whole('sum(margin_before_discount)')} AS margin_before,
                      {whole('sum(gross_margin)')} AS margin_after,
                      {pct('sum(gross_margin)', 'sum(net_sales)', 1)} AS margin_pct_after
               FROM p1 WHERE channel = '{P.b2b}' GROUP BY 1"""


ORACLES["disc_depth_buckets"] = compose(_depth_sql(P.depth_cuts), "p1")
ORACLES["disc_depth_buckets_fine"] = compose(_depth_sql(FINE_CUTS), "p1")
_MADE, _DEEPENED, _KEPT = (p.replace("'", "''") for p in P.populations)
ORACLES["disc_turning_lines_negative"] = compose(
    f"""SELECT CASE WHEN gross_margin >= 0 THEN '{_KEPT}' WHEN margin_before_discount >= 0 THEN '{_MADE}'
                    ELSE '{_DEEPENED}' END AS population, count(*) AS lines, {whole('sum(discount_amount)')} AS discounts,
               {whole('sum(gross_margin)')} AS margin_after
        FROM p1 WHERE discount_amount > 0 GROUP BY population""", "p1")
_B2B = f"FILTER (channel = '{P.b2b}')"
ORACLES["disc_summary"] = compose(
    f"""SELECT {whole('sum(discount_amount)')} AS discounts, {whole('sum(gross_amount)')} AS gross_amount,
               {pct('sum(discount_amount)', 'sum(gross_amount)', 2)} AS discount_pct_of_gross,
               {whole(f'sum(margin_before_discount) {_B2B}')} AS resellers_margin_before,
               {whole(f'sum(gross_margin) {_B2B}')} AS resellers_margin_after,
               {pct(f'sum(margin_before_discount) {_B2B}', f'sum(gross_amount) {_B2B}', 2)} AS resellers_margin_pct_before_discount
        FROM p1""", "p1")
_DISC_LINES = f"SELECT * FROM p1 WHERE channel = '{P.b2b}' AND discount_amount > 0"
ORACLES["disc_lines_p1"] = compose(
    f"""SELECT sales_line_id, sku, promotion_key, quantity, discount_pct,
               {doubles('gross_amount', 'discount_amount', 'net_sales', 'cogs', 'margin_before_discount', 'gross_margin')}
        FROM discounted""", "p1", discounted=_DISC_LINES)
ORACLES["new_product_promos"] = compose(
    f"""SELECT sum(discounts) AS new_product_promos,
               {pct('sum(discounts)', '(SELECT round(sum(discount_amount), 0) FROM p1)')} AS new_product_promos_pct,
               sum(margin_before) AS new_product_promos_margin_before, sum(margin_after) AS new_product_promos_margin_after
        FROM by_promotion WHERE promotion_type = '{P.new_product_type}'""", "p1", "promotions", by_promotion=_BY_PROMOTION)
ORACLES["already_below_cost"] = compose(
    f"""SELECT {whole('sum(discount_amount)')} AS already_below_cost_discounts,
               {pct('round(sum(discount_amount), 0)', '(SELECT round(sum(discount_amount), 0) FROM p1)')} AS already_below_cost_pct,
               count(*) AS already_below_cost_lines
        FROM p1 WHERE discount_amount > 0 AND margin_before_discount < 0""", "p1")

# ---- what-if -----------------------------------------------------------------------------------------------------

_SEGMENT = f"""SELECT {dbl('sum(net_sales)')} AS revenue, {dbl('sum(cogs)')} AS cogs, {dbl('sum(net_sales) - sum(cogs)')} AS margin
               FROM losses"""
_SEGMENT_BY = _SEGMENT.replace("SELECT", "SELECT category,", 1) + " GROUP BY category"
_LISTS = {
    "x": ", ".join(f"({x}::DOUBLE)" for x in P.price_steps),
    "e": ", ".join(f"({e}::DOUBLE)" for e in P.elasticities),
    "v": ", ".join(f"({v}::DOUBLE)" for v in P.variable_shares),
}


def _price(x: str, e: str, v: str) -> str:
    volume = f"greatest(0.0::DOUBLE, {e} * {x} + 1.0::DOUBLE)"
    return f"revenue * ({volume} * ({x} + 1.0::DOUBLE) - 1.0::DOUBLE) - {v} * cogs * ({volume} - 1.0::DOUBLE)"


def _on_segment(body: str, source: str = _SEGMENT) -> str:
    return compose(body, *_LOSS_BLOCKS, losses=_LOSSES, seg=source)


def _num(value: float) -> str:
    return f"({value}::DOUBLE)"


ORACLES["segment"] = _on_segment("SELECT * FROM seg")
ORACLES["segment_by_category"] = _on_segment("SELECT * FROM seg", _SEGMENT_BY)
ORACLES["loss_segment_direct"] = compose(
    f"""SELECT {dbl('sum(r)')} AS revenue, {dbl('sum(c)')} AS cogs, {dbl('sum(m)')} AS margin
        FROM (SELECT sum(net_sales) AS r, sum(cogs) AS c, sum(gross_margin) AS m FROM p1 GROUP BY sku, channel) WHERE m < 0""", "p1")
_GRID_FROM = f"FROM seg, (VALUES {_LISTS['x']}) AS xs(x), (VALUES {_LISTS['e']}) AS es(elasticity)"
ORACLES["price_grid"] = _on_segment(f"SELECT x, elasticity, {_price('x', 'elasticity', '1.0::DOUBLE')} AS margin_delta {_GRID_FROM}")
ORACLES["price_grid_by_category"] = _on_segment(
    f"SELECT category, x, elasticity, {_price('x', 'elasticity', '1.0::DOUBLE')} AS margin_delta {_GRID_FROM}", _SEGMENT_BY)
ORACLES["price_table"] = _on_segment(
    "SELECT x, " + ", ".join(f"""{_price('x', f'({e}::DOUBLE)', '1.0::DOUBLE')} AS "e={e:g}" """ for e in P.elasticities)
    + f"FROM seg, (VALUES {_LISTS['x']}) AS xs(x)")
for _name, (_x, _e, _v) in {
    "price_change": (P.price_steps[-1], P.elasticities[1], 1.0),
    "price_sensitivity": P.sensitivity,
}.items():
    ORACLES[_name] = _on_segment(
        f"""SELECT {_num(_x)} AS x, {_num(_e)} AS elasticity, {_num(_v)} AS variable_share,
                   {_price(_num(_x), _num(_e), _num(_v))} AS margin_delta FROM seg""")
ORACLES["break_even_elasticity"] = _on_segment(
    f"""SELECT x, CASE WHEN kept > 0 AND -revenue / kept * x >= -1 THEN -revenue / kept END AS break_even_elasticity
        FROM (SELECT *, revenue * (x + 1.0::DOUBLE) - 1.0::DOUBLE * cogs AS kept FROM seg, (VALUES {_LISTS['x']}) AS xs(x))""")
ORACLES["break_even_elasticity_all_sales"] = compose(
    f"""SELECT x, CASE WHEN kept > 0 AND -revenue / kept * x >= -1 THEN -revenue / kept END AS break_even_elasticity
        FROM (SELECT *, revenue * (x + 1.0::DOUBLE) - 1.0::DOUBLE * cogs AS kept
              FROM (SELECT {dbl('sum(net_sales)')} AS revenue, {dbl('sum(cogs)')} AS cogs FROM p1), (VALUES {_LISTS['x']}) AS xs(x))""",
    "p1")
ORACLES["stop_selling"] = _on_segment(
    f"SELECT variable_share, variable_share * cogs - revenue AS margin_delta FROM seg, (VALUES {_LISTS['v']}) AS vs(variable_share)")
ORACLES["stop_selling_curve"] = _on_segment(
    """SELECT CAST(point AS INTEGER) AS point, point * 0.005::DOUBLE + 0.6::DOUBLE AS variable_share,
              (point * 0.005::DOUBLE + 0.6::DOUBLE) * cogs - revenue AS margin_delta
       FROM seg, range(81) AS points(point)""")
ORACLES["break_even_variable_share"] = _on_segment("SELECT revenue / nullif(cogs, 0) AS break_even_share FROM seg")
_RULE_COLUMNS = "count(*) AS lines, coalesce(" + dbl("sum(removed)") + ", 0) AS discount_removed"
_RULE_DELTA = f"coalesce({dbl('sum(gross_margin)')} + {dbl('sum(removed)')} - {dbl('sum(gross_margin)')}, 0) AS margin_delta"
ORACLES["discount_rule_no_discount_below_cost"] = compose(
    f"""SELECT 'no_discount_below_cost' AS rule, CAST(NULL AS DOUBLE) AS cap, {_RULE_COLUMNS}, {_RULE_DELTA},
               0.0::DOUBLE AS lost_volume_share
        FROM (SELECT *, discount_amount AS removed FROM discounted WHERE margin_before_discount < 0)""",
    "p1", discounted=_DISC_LINES)
ORACLES["discount_rule_cap"] = compose(
    "\nUNION ALL ".join(
        f"""SELECT 'cap' AS rule, {cap}::DOUBLE AS cap, {_RULE_COLUMNS}, {_RULE_DELTA}, 0.0::DOUBLE AS lost_volume_share
            FROM (SELECT *, discount_amount - {cap} * gross_amount AS removed FROM discounted) WHERE removed > 0"""
        for cap in P.discount_caps),
    "p1", discounted=_DISC_LINES)
_LX, _LE, _LV = LINE_LEVEL
ORACLES["price_change_line_level"] = compose(
    f"""SELECT round({_price(_num(_LX), _num(_LE), _num(_LV))}, 2) AS margin_delta
        FROM (SELECT {dbl('sum(net_sales)')} AS revenue, {dbl('sum(cogs)')} AS cogs FROM p1)""", "p1")

# ---- consolidated figures ----------------------------------------------------------------------------------------

_S = {"summary": _SUMMARY_BODY}


def _one(column: str, period: str, channel: str | None) -> str:
    return f"(SELECT {column} FROM summary WHERE period = '{period}' AND {'is_total' if channel is None else f'''channel = '{channel}' '''})"


ORACLES["kpi_matrix"] = compose(
    "SELECT * EXCLUDE (is_total) REPLACE (if(is_total, 'Total', channel) AS channel) FROM summary", "period_lines", **_S)
ORACLES["growth"] = compose(
    f"""SELECT 100.0::DOUBLE * ({_one('net_sales', 'P1', None)} / {_one('net_sales', 'P0', None)} - 1.0::DOUBLE) AS net_sales_pct,
               {_one('gross_margin', 'P1', None)} - {_one('gross_margin', 'P0', None)} AS margin_delta,
               {pct(_one('net_sales', 'P1', P.b2c), _one('net_sales', 'P1', None))} AS internet_share_of_sales_pct,
               {pct(_one('gross_margin', 'P1', P.b2c), _one('gross_margin', 'P1', None))} AS internet_share_of_margin_pct""",
    "period_lines", **_S)
ORACLES["channel_evolution"] = compose(
    """SELECT if(a.is_total, 'Total', a.channel) AS channel,
              100.0::DOUBLE * (b.net_sales / a.net_sales - 1.0::DOUBLE) AS net_sales_growth_pct,
              a.margin_pct AS margin_pct_p0, b.margin_pct AS margin_pct_p1
       FROM summary AS a JOIN summary AS b
         ON a.period = 'P0' AND b.period = 'P1' AND a.channel IS NOT DISTINCT FROM b.channel AND a.is_total = b.is_total""",
    "period_lines", **_S)
ORACLES["internet_plus10_margin"] = compose(
    f"SELECT 0.1::DOUBLE * {_one('net_sales', 'P1', P.b2c)} * {_one('margin_pct', 'P1', P.b2c)} / 100.0::DOUBLE AS internet_plus10_margin",
    "period_lines", **_S)
ORACLES["b2b_share_of_sales"] = compose(
    f"SELECT {pct(_one('net_sales', 'P1', P.b2b), _one('net_sales', 'P1', None))} AS b2b_share_of_sales_pct", "period_lines", **_S)
ORACLES["categories_p1"] = compose(
    f"SELECT category, channel, {_SALES_MARGIN}, {_UNITS} FROM p1 JOIN skus USING (sku) GROUP BY ALL", "p1", "skus")
ORACLES["price_structure_labelled"] = compose(
    "SELECT * EXCLUDE (is_total) REPLACE (if(is_total, 'Total', category) AS category) FROM structure",
    "p1", "skus", pairs=_PRICE_PAIRS, structure=_PRICE_STRUCTURE)
_FOCUS = f"(SELECT coalesce(sum(gross_margin), 0) FROM losses WHERE category = '{P.focus_category}')"
ORACLES["loss_making_summary"] = compose(
    f"""SELECT count(*) AS n, {dbl('sum(net_sales)')} AS revenue, {dbl('sum(cogs)')} AS cogs, {dbl('sum(gross_margin)')} AS margin,
               {pct('sum(net_sales)', '(SELECT round(sum(net_sales), 0) FROM p1)')} AS share_of_total_revenue_pct,
               {dbl(_FOCUS)} AS focus_category_margin, {pct(_FOCUS, 'sum(gross_margin)')} AS focus_category_share_of_loss_pct
        FROM losses""", *_LOSS_BLOCKS, losses=_LOSSES)
ORACLES["loss_by_category"] = compose(
    f"""SELECT category, count(*) AS n, {dbl('sum(gross_margin)')} AS margin, {dbl('sum(net_sales)')} AS revenue
        FROM losses GROUP BY category""", *_LOSS_BLOCKS, losses=_LOSSES)
ORACLES["loss_top8"] = compose(
    f"""SELECT sku, product_name, channel, units, {doubles('net_sales', 'gross_margin')}, margin_pct
        FROM (SELECT * FROM losses ORDER BY gross_margin, sku, channel LIMIT 8)""", *_LOSS_BLOCKS, losses=_LOSSES)


def _chan(column: str, channel: str) -> str:
    return f"(SELECT {column} FROM by_channel WHERE channel = '{channel}')"


_B2B_GAP = f"({_chan('price', P.b2b)} + {_chan('cost', P.b2b)})"
ORACLES["pricing_vs_cost"] = compose(
    f"""SELECT {_chan('price', P.b2b)} AS resellers_price, {_chan('cost', P.b2b)} AS resellers_cost, {_B2B_GAP} AS resellers_gap,
               {pct(_B2B_GAP, f"(SELECT round(sum(net_sales), 0) FROM p1 WHERE channel = '{P.b2b}')")} AS resellers_gap_pct_of_sales,
               {_chan('price', P.b2c)} AS internet_price, {_chan('cost', P.b2c)} AS internet_cost,
               {_chan('price', P.b2c)} + {_chan('cost', P.b2c)} AS internet_gap,
               (SELECT round(sum(price_effect), 0) FROM effects) AS bridge_price,
               (SELECT round(sum(cost_effect), 0) FROM effects) AS bridge_cost""",
    "effects", "p1", by_channel=_BY_CHANNEL)

# ---- report data -------------------------------------------------------------------------------------------------


def _bars(steps: str, by: str = "") -> str:
    keys, over = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""SELECT {keys}step, ord, value, least(base, base + value) AS bar_low, greatest(base, base + value) AS bar_high,
                      CASE WHEN ord IN (0, 8) THEN 'total' WHEN value < 0 THEN 'loss' ELSE 'gain' END AS kind
               FROM (SELECT *, if(ord IN (0, 8), 0, sum(value) OVER ({over}ORDER BY ord) - value) AS base FROM {steps})"""


ORACLES["waterfall_steps"] = compose(_bars("bridge"), "effects", bridge=_BRIDGE)
_CHANNEL_STEPS = "\nUNION ALL ".join(
    f"SELECT channel, '{label}' AS step, {i} AS ord, {name} AS value FROM by_channel"
    for i, (label, name) in enumerate(zip(P.bridge_steps, _GROUP_NAMES)))
ORACLES["waterfall_steps_by_channel"] = compose(
    _bars("channel_steps", "channel"), "effects", by_channel=_BY_CHANNEL, channel_steps=_CHANNEL_STEPS)
ORACLES["subcategory_pivot_top10"] = compose(
    f"""SELECT subcategory, coalesce(sum(gross_margin) FILTER (channel = '{P.b2b}'), 0) AS resellers_margin,
               coalesce(sum(gross_margin) FILTER (channel = '{P.b2c}'), 0) AS internet_margin
        FROM by_subcategory GROUP BY subcategory ORDER BY abs(resellers_margin) + abs(internet_margin) DESC, subcategory LIMIT 10""",
    "p1", "skus", by_subcategory=_BY_SUBCATEGORY)
_RANGE = f"year_month >= '{P.month_range[0]}' AND year_month <= '{P.month_range[1]}'"
ORACLES["monthly_window"] = compose(
    f"SELECT *, greatest(margin_pct, {P.margin_floor_pct}::DOUBLE) AS margin_pct_plotted FROM monthly WHERE {_RANGE}",
    "fact", "days", monthly=_MONTHLY)
ORACLES["worst_month"] = compose(
    f"SELECT * FROM monthly WHERE {_RANGE} AND channel = '{P.b2b}' ORDER BY margin_pct NULLS LAST, year_month LIMIT 1",
    "fact", "days", monthly=_MONTHLY)
ORACLES["promo_top6"] = compose(
    f"""SELECT promotion_name, discounts, gross_amount, {pct('discounts', 'gross_amount')} AS rate_pct, margin_before, margin_after
        FROM by_promotion ORDER BY discounts DESC, promotion_type, promotion_name LIMIT 6""",
    "p1", "promotions", by_promotion=_BY_PROMOTION)
ORACLES["worst_cost_increase"] = compose(
    "SELECT * FROM top_cost ORDER BY unit_cost_increase_pct DESC, cost_effect, product_name, channel LIMIT 1",
    "effects", "skus", top_cost=_TOP_COST)
_SUB_FOCUS = f"subcategory = '{P.focus_subcategory}' AND channel = '{P.b2b}'"
_FIGURES = {
    "focus_subcategory_margin": f"sum(gross_margin) FROM by_subcategory WHERE {_SUB_FOCUS}",
    "focus_subcategory_net_sales": f"sum(net_sales) FROM by_subcategory WHERE {_SUB_FOCUS}",
    "class_a_skus": "any_value(skus) FROM abc_skus WHERE abc_class = 'A'",
    "class_d_skus": "any_value(skus) FROM abc_skus WHERE abc_class = 'D'",
    "all_skus": "count(*) FROM sku_items",
    "class_d_resellers": "any_value(resellers) FROM abc_resellers WHERE abc_class = 'D'",
    "class_d_margin": "any_value(gross_margin) FROM abc_resellers WHERE abc_class = 'D'",
    "all_resellers": "count(*) FROM reseller_items",
    "last_b2b_order": f"strftime(max(order_date), '%Y%m%d') FROM fact WHERE channel = '{P.b2b}'",
}
ORACLES["note_lookups"] = compose(
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS figure, CAST({sql.split(' FROM ', 1)[0]} AS DOUBLE) AS value FROM {sql.split(' FROM ', 1)[1]}"
        for name, sql in _FIGURES.items()),
    "sku_pareto", "reseller_pareto", "skus", by_subcategory=_BY_SUBCATEGORY, abc_skus=_abc("sku_pareto", "skus"),
    abc_resellers=_abc("reseller_pareto", "resellers"))

# ---- through files: the same answers ------------------------------------------------------------------------------

ORACLES["files_fact_sales"] = ORACLES["fact_sales"]
ORACLES["files_dim_product"] = ORACLES["dim_product"]
for _name in ("dim_customer", "dim_reseller", "dim_territory", "dim_promotion", "dim_date"):
    ORACLES[f"files_{_name}"] = ORACLES[_name]
ORACLES["files_kpi_summary"] = ORACLES["kpi_summary"]
ORACLES["files_row_counts"] = compose(
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows FROM ({source})"
        for name, source in {
            "FactResellerSales": f"FROM lines WHERE channel = '{P.b2b}'",
            "FactInternetSales": f"FROM lines WHERE channel = '{P.b2c}'",
            "DimProduct": "FROM part",
            "DimProductSubcategory": "SELECT DISTINCT p_type, p_brand FROM part",
            "DimProductCategory": "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL",
            "DimDate": "FROM days",
            "DimReseller": "FROM resellers",
            "DimCustomer": "FROM consumers",
            "DimGeography": "FROM places",
            "DimSalesTerritory": "FROM territories",
            "DimPromotion": "FROM promotions",
            "DimCurrency": "FROM region",
        }.items()),
    "lines", "days", "resellers", "consumers", "places", "territories", "promotions")
ORACLES["export_reconcile"] = compose(
    f"""SELECT side, count(*) AS rows, {dbl('sum(net_sales)')} AS net_sales, {dbl('sum(cogs)')} AS cogs
        FROM fact, (VALUES ('export'), ('model')) AS sides(side) GROUP BY side""", "fact")
ORACLES["results_json_bridge"] = compose(
    "SELECT step, ord, value FROM bridge", "effects", bridge=_BRIDGE)

# ---- through an exported file, and from the stored model: the same answers -----------------------------------------

for _name in (
    "dim_date", "dim_product", "dim_sku", "dim_territory", "dim_customer", "dim_reseller", "dim_promotion", "fact_sales",
    "pvm_lines", "pareto_sku", "pareto_reseller", "kpi_monthly", "pvm_bridge", "kpi_by_calendar_year",
):
    ORACLES[f"export_{_name}"] = ORACLES[_name]
for _name in ("fact_sales", "dim_sku", "kpi_summary", "kpi_monthly", "pvm_bridge", "pvm_by_category", "pareto_sku", "quality_report"):
    ORACLES[f"stored_{_name}"] = ORACLES[_name]

# ---- every field of every JSON result, as number or text -----------------------------------------------------------

RESULTS = (
    "info_period_coverage", "kpi_matrix", "growth", "pvm_bridge", "pvm_by_channel", "pvm_by_category", "pvm_top_cost_increases",
    "categories_p1", "kpi_by_subcategory", "kpi_by_territory", "kpi_by_reseller_type", "kpi_by_calendar_year",
    "price_structure_labelled", "abc_sku_summary", "abc_reseller_summary", "pareto_peak", "worst_skus", "loss_making_summary",
    "loss_by_category", "loss_top8", "disc_summary", "disc_by_promotion", "disc_depth_buckets", "disc_turning_lines_negative",
    "new_product_promos", "already_below_cost", "segment", "price_grid", "price_sensitivity", "break_even_elasticity",
    "stop_selling", "break_even_variable_share", "discount_rule_no_discount_below_cost", "discount_rule_cap",
    "internet_plus10_margin", "pricing_vs_cost", "period_labels",
)
ORACLES["results_json"] = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS result, field, TRY_CAST(value AS DOUBLE) AS number, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS text
        FROM (SELECT COLUMNS(*)::VARCHAR FROM ({ORACLES[name]})) UNPIVOT INCLUDE NULLS (value FOR field IN (COLUMNS(*)))"""
    for name in RESULTS)

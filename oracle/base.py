"""Named building blocks that the oracle statements are composed of."""

from __future__ import annotations

from marginlens.sources.order_tables import default_params

P = default_params()

# Fixed values of the mapping, stated here once more: the statements take no rule from the library.
B2B_SEGMENTS = ("BUILDING", "FURNITURE", "MACHINERY")
FRENCH_MONTHS = (
    "janvier", "février", "mars", "avril", "mai", "juin",
    "juillet", "août", "septembre", "octobre", "novembre", "décembre",
)


def text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_IN_P0 = f"order_date BETWEEN DATE '{P.p0_start}' AND DATE '{P.p0_end}'"
_IN_P1 = f"order_date BETWEEN DATE '{P.p1_start}' AND DATE '{P.p1_end}'"

# name: (blocks it needs, body)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "bought": ((), f"""
        SELECT CASE WHEN c_mktsegment IN ({text_list(B2B_SEGMENTS)}) THEN '{P.b2b}'
                    WHEN c_mktsegment NOT IN ({text_list(B2B_SEGMENTS)}) THEN '{P.b2c}' END AS channel,
               l_orderkey, o_custkey, c_nationkey, l_linenumber, l_partkey, l_discount,
               CAST(o_orderdate AS DATE) AS order_date, CAST(l_quantity AS INTEGER) AS quantity,
               CAST(l_extendedprice AS DECIMAL(19,4)) AS gross_amount,
               CAST(p_retailprice AS DECIMAL(19,4)) AS retail
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
             LEFT JOIN part ON l_partkey = p_partkey"""),
    "raw": ((), """
        SELECT CAST(l_extendedprice AS DECIMAL(19,4)) AS gross, CAST(l_discount AS DECIMAL(9,6)) AS rate FROM lineitem"""),
    "priced": (("bought",), """
        SELECT *, CAST(gross_amount * CAST(l_discount AS DECIMAL(9,6)) AS DECIMAL(19,4)) AS discount_amount,
               CAST(CAST(CAST(gross_amount * 10000 AS BIGINT) // quantity AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(19,4)) AS unit_price,
               CAST(retail * (CAST(100 + 5 * (year(order_date) - 1995) AS DECIMAL(5,0)) * 0.01) AS DECIMAL(19,4)) AS unit_cogs
        FROM bought"""),
    "lines": (("priced",), f"""
        SELECT channel, 'SO' || l_orderkey AS order_number, CAST(l_linenumber AS INTEGER) AS order_line,
               CAST(l_partkey AS BIGINT) AS product_key,
               CASE WHEN channel = '{P.b2b}' THEN CAST(o_custkey AS BIGINT) END AS reseller_key,
               CASE WHEN channel = '{P.b2c}' THEN CAST(o_custkey AS BIGINT) END AS customer_key,
               CAST(c_nationkey AS INTEGER) AS territory_key, CAST(round(l_discount * 1000000) AS INTEGER) + 1 AS promotion_key,
               order_date, quantity, unit_price, gross_amount, l_discount AS discount_pct, discount_amount, unit_cogs,
               CAST(unit_cogs * quantity AS DECIMAL(19,4)) AS cogs,
               CAST(gross_amount - discount_amount AS DECIMAL(19,4)) AS net_sales
        FROM priced"""),
    "products": ((), f"""
        SELECT CAST(p_partkey AS BIGINT) AS product_key, p_brand || ':' || p_name AS sku, p_name AS product_name,
               p_name AS model_name, p_type AS category, p_brand AS subcategory,
               split_part(p_name, ' ', 1) AS color, left(p_type, 1) AS product_line,
               CASE WHEN p_size < 16 THEN 'L' WHEN p_size < 36 THEN 'M' WHEN p_size < 50 THEN 'H' END AS class,
               CAST(p_retailprice AS DECIMAL(19,4)) AS standard_cost,
               CASE WHEN p_size <> 50 THEN CAST(CAST(p_retailprice AS DECIMAL(19,4)) * 2 AS DECIMAL(19,4)) END AS list_price,
               CASE WHEN p_size > 1 THEN CAST(CAST(p_retailprice AS DECIMAL(19,4)) + 100 AS DECIMAL(19,4)) END AS dealer_price,
               CASE WHEN p_size % 7 > 0 THEN TRUE END AS is_current_version
        FROM part"""),
    "skus": (("products",), """
        SELECT DISTINCT ON (sku) sku, product_name, model_name, category, subcategory, color, product_line, class
        FROM products ORDER BY sku, product_key DESC"""),
    "days": ((), f"""
        SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, day AS date, year(day) AS year, quarter(day) AS quarter,
               month(day) AS month, monthname(day) AS month_name, ([{text_list(FRENCH_MONTHS)}])[month(day)] AS month_name_fr,
               strftime(day, '%Y-%m') AS year_month
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"""),
    "territories": ((), """
        SELECT n_nationkey AS territory_key, n_name AS region, n_name AS country, r_name AS territory_group
        FROM nation JOIN region ON r_regionkey = n_regionkey"""),
    "places": ((), """
        SELECT n_nationkey AS geography_key, 'Capital of ' || n_name AS city, r_name AS state_province, n_name AS country,
               n_nationkey AS territory_key
        FROM nation JOIN region ON r_regionkey = n_regionkey"""),
    "consumers": (("places",), f"""
        SELECT CAST(c_custkey AS BIGINT) AS customer_key, city, state_province, country
        FROM customer LEFT JOIN places ON geography_key = c_nationkey
        WHERE c_mktsegment NOT IN ({text_list(B2B_SEGMENTS)})"""),
    "resellers": (("places",), f"""
        SELECT CAST(c_custkey AS BIGINT) AS reseller_key, c_name AS reseller_name, c_mktsegment AS business_type,
               left(c_mktsegment, 1) AS product_line,
               CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey % 90 + 10 AS INTEGER) END AS number_employees,
               CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'Q' END AS order_frequency,
               CASE WHEN c_custkey % 13 > 0 THEN CAST(1960 + c_custkey % 40 AS INTEGER) END AS year_opened,
               city, state_province, country
        FROM customer LEFT JOIN places ON geography_key = c_nationkey
        WHERE c_mktsegment IN ({text_list(B2B_SEGMENTS)})"""),
    "promotions": ((), f"""
        SELECT CAST(rate * 1000000 AS INTEGER) + 1 AS promotion_key, printf('Offer %g %%', CAST(rate * 100 AS DOUBLE)) AS promotion_name,
               round(CAST(rate AS DOUBLE), 4) AS discount_pct,
               CASE WHEN rate = 0 THEN 'No Discount' WHEN rate <= 0.05 THEN 'Volume Discount'
                    WHEN rate <= 0.08 THEN 'Seasonal Discount' ELSE '{P.new_product_type}' END AS promotion_type,
               CASE WHEN rate = 0 THEN 'No Discount' ELSE 'Reseller' END AS promotion_category,
               CAST(rate * 1000 AS INTEGER) AS min_qty, CASE WHEN rate <= 0.05 THEN 60 END AS max_qty
        FROM (SELECT DISTINCT CAST(l_discount AS DECIMAL(9,6)) AS rate FROM lineitem WHERE l_discount IS NOT NULL)"""),
    "fact": (("lines", "products"), """
        SELECT coalesce(lines.channel, '') || '|' || order_number || '|' || order_line AS sales_line_id, lines.*,
               CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS date_key, products.sku,
               net_sales - cogs AS gross_margin, gross_amount - cogs AS margin_before_discount, cogs > net_sales AS is_below_cost
        FROM lines LEFT JOIN products USING (product_key)"""),
    "period_lines": (("fact",), f"""
        SELECT *, CASE WHEN {_IN_P0} THEN 'P0' WHEN {_IN_P1} THEN 'P1' END AS period
        FROM fact WHERE order_date >= DATE '{P.p0_start}' AND order_date <= DATE '{P.p1_end}'"""),
    "p1": (("period_lines",), "SELECT * FROM period_lines WHERE period = 'P1'"),
    # price / volume / mix: periods joined, then per-unit effects
    "half": (("period_lines",), """
        SELECT sku, channel, period, CAST(sum(quantity) AS DOUBLE) AS q, CAST(sum(gross_amount) AS DOUBLE) AS gross,
               CAST(sum(discount_amount) AS DOUBLE) AS disc, CAST(sum(net_sales) AS DOUBLE) AS net, CAST(sum(cogs) AS DOUBLE) AS cogs
        FROM period_lines GROUP BY ALL"""),
    "units": (("half",), """
        SELECT sku, channel, ifnull(before.q, 0) AS q0, ifnull(after.q, 0) AS q1, ifnull(before.gross, 0) AS gross0,
               ifnull(after.gross, 0) AS gross1, ifnull(before.disc, 0) AS disc0, ifnull(after.disc, 0) AS disc1,
               ifnull(before.net, 0) AS net0, ifnull(after.net, 0) AS net1, ifnull(before.cogs, 0) AS cogs0,
               ifnull(after.cogs, 0) AS cogs1, ifnull(before.net - before.cogs, 0) AS margin0,
               ifnull(after.net - after.cogs, 0) AS margin1, q0 > 0 AND q1 > 0 AS live, q1 / nullif(q0, 0) AS growth
        FROM (FROM half WHERE period = 'P0') AS before FULL JOIN (FROM half WHERE period = 'P1') AS after USING (sku, channel)"""),
    "effects": (("units",), """
        SELECT sku, channel, q0, q1, net0, net1, margin0, margin1, margin1 - margin0 AS delta_margin,
               CASE WHEN q0 > 0 THEN cogs0 / q0 END AS unit_cogs0, CASE WHEN q1 > 0 THEN cogs1 / q1 END AS unit_cogs1,
               if(live, margin0 * (r - 1), 0) AS volume_effect, if(live, margin0 * (growth - r), 0) AS mix_effect,
               if(live, gross1 - gross0 * growth, 0) AS price_effect, if(live, disc0 * growth - disc1, 0) AS discount_effect,
               if(live, cogs0 * growth - cogs1, 0) AS cost_effect, if(q0 = 0, margin1, 0) AS new_effect,
               if(q1 = 0, -margin0, 0) AS discontinued_effect
        FROM units, (SELECT sum(q1) / sum(q0) AS r FROM units WHERE live)"""),
    # pareto with plain windows over all items
    "sku_items": (("p1", "skus"), f"""
        SELECT sku, product_name, category, subcategory, CAST(sum(quantity) AS BIGINT) AS units, sum(net_sales) AS net_sales,
               sum(gross_margin) AS gross_margin,
               coalesce(sum(gross_margin) FILTER (channel = '{P.b2b}'), 0) AS margin_resellers,
               coalesce(sum(gross_margin) FILTER (channel = '{P.b2c}'), 0) AS margin_internet
        FROM p1 JOIN skus USING (sku) GROUP BY ALL"""),
    "reseller_items": (("p1", "resellers"), f"""
        SELECT reseller_key, reseller_name, business_type, country, count(DISTINCT order_number) AS orders,
               sum(net_sales) AS net_sales, sum(gross_margin) AS gross_margin, sum(discount_amount) AS discounts
        FROM p1 JOIN resellers USING (reseller_key) WHERE channel = '{P.b2b}' GROUP BY ALL"""),
}

for _items, _key in (("sku_items", "sku"), ("reseller_items", "reseller_key")):
    _ranked, _pareto = _items.replace("items", "ranked"), _items.replace("items", "pareto")
    BLOCKS[_ranked] = ((_items,), f"""
        SELECT *, row_number() OVER w AS rank_margin, count(*) OVER () AS n_items, sum(gross_margin) OVER w AS cum_margin,
               sum(greatest(gross_margin, 0)) OVER w - greatest(gross_margin, 0) AS cum_before,
               sum(gross_margin) OVER () AS total_margin, sum(greatest(gross_margin, 0)) OVER () AS total_positive
        FROM {_items} WINDOW w AS (ORDER BY gross_margin DESC, {_key} ROWS UNBOUNDED PRECEDING)""")
    BLOCKS[_pareto] = ((_ranked,), f"""
        SELECT *, 100.0 * CAST(gross_margin AS DOUBLE) / nullif(CAST(net_sales AS DOUBLE), 0) AS margin_pct,
               100.0 * CAST(rank_margin AS DOUBLE) / CAST(n_items AS DOUBLE) AS pct_of_items,
               CASE WHEN total_margin > 0
                    THEN 100.0 * CAST(cum_margin AS DOUBLE) / CAST(total_margin AS DOUBLE) END AS cum_margin_pct_of_net,
               100.0 * CAST(cum_margin AS DOUBLE) / nullif(CAST(total_positive AS DOUBLE), 0) AS cum_margin_pct_of_positive,
               CASE WHEN gross_margin < 0 THEN 'D' WHEN cum_before >= {P.class_b_share} * total_positive THEN 'C'
                    WHEN cum_before >= {P.class_a_share} * total_positive THEN 'B' ELSE 'A' END AS abc_class
        FROM {_ranked}""")


def compose(body: str, *blocks: str, **local: str) -> str:
    """``WITH`` every needed block (dependencies first), then the ``local`` ones, then ``body``."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in ordered:
            needs, sql = BLOCKS[name]
            for need in needs:
                add(need)
            ordered[name] = sql

    for block in blocks:
        add(block)
    ordered.update(local)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ordered.items()) + "\n" + body


def pct(num: str, den: str, digits: int | None = None) -> str:
    share = f"100.0 * CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0)"
    return share if digits is None else f"round({share}, {digits})"


def whole(amount: str) -> str:
    return f"CAST(round({amount}, 0) AS DOUBLE)"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"

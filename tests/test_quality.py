from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marginlens.operators import quality
from marginlens.operators.quality import CHECKS, QualityError, quality_gate, quality_report
from tests.fixtures import one, rows_of

FIRST = "Internet|SO5|1"
FIRST_B2B = "Revendeurs|SO1|1"


@pytest.fixture(scope="module")
def clean(file_model):
    """The fact as a stored table, so that corrupting it is a cheap rewrite."""
    from marginlens.functions.staged import stage

    return stage(file_model.fact(), "clean-fact")


def report(file_model, fact):
    totals = file_model.source_totals("rows", "net_sales", "cogs")
    return quality_report(fact, totals, file_model.dims, file_model.dim_product, file_model.params)


def violations(file_model, fact):
    return {r["check"]: r["violations"] for r in rows_of(report(file_model, fact))}


def set_on(fact, line, **columns):
    hit = F.col("sales_line_id") == line
    changed = {c: F.when(hit, F.lit(v) if not hasattr(v, "cast") else v).otherwise(F.col(c)).cast(fact.schema[c].dataType) for c, v in columns.items()}
    return fact.withColumns(changed)


def test_clean_data_has_no_violations(file_model, clean):
    found = violations(file_model, clean)
    assert set(found) == set(CHECKS) and not any(found.values())
    quality_gate(report(file_model, clean), file_model.params)


CORRUPTIONS = {
    "net + 5": (lambda f: set_on(f, FIRST, net_sales=F.col("net_sales") + 5), "chk_net_identity"),
    "net + 5, gross + 5": (
        lambda f: set_on(f, FIRST, net_sales=F.col("net_sales") + 5, gross_amount=F.col("gross_amount") + 5),
        "chk_net_sales_reconcile_staging",
    ),
    "deleted row": (lambda f: f.filter(F.col("sales_line_id") != FIRST), "chk_fact_rows_equal_staging"),
    "duplicated row": (lambda f: f.unionByName(f.filter(F.col("sales_line_id") == FIRST)), "chk_fact_grain_unique"),
    "no sku": (lambda f: set_on(f, FIRST, sku=None), "chk_orphan_products"),
    "unknown sku": (lambda f: set_on(f, FIRST, sku="?"), "chk_orphan_sku_category"),
    "cost doubled": (lambda f: set_on(f, FIRST, cogs=F.col("cogs") * 2), "chk_cogs_identity"),
    "cost doubled vs staging": (lambda f: set_on(f, FIRST, cogs=F.col("cogs") * 2), "chk_cogs_reconcile_staging"),
    "discount + 3": (lambda f: set_on(f, FIRST, discount_amount=F.col("discount_amount") + 3), "chk_discount_identity"),
    "gross tripled": (lambda f: set_on(f, FIRST, gross_amount=F.col("gross_amount") * 3), "chk_gross_amount_identity"),
    "territory 999": (lambda f: set_on(f, FIRST, territory_key=999), "chk_orphan_territories"),
    "day outside the calendar": (lambda f: set_on(f, FIRST, date_key=19000101), "chk_orphan_dates"),
    "promotion 77": (lambda f: set_on(f, FIRST, promotion_key=77), "chk_orphan_promotions"),
    "customer on a reseller line": (lambda f: set_on(f, FIRST_B2B, customer_key=1), "chk_channel_keys"),
    "unknown customer": (lambda f: set_on(f, FIRST, customer_key=5), "chk_orphan_resellers_customers"),
    "unknown reseller": (lambda f: set_on(f, FIRST_B2B, reseller_key=5), "chk_orphan_resellers_customers"),
    "negative quantity": (lambda f: set_on(f, FIRST, quantity=-1), "chk_positive_quantities_and_costs"),
}


@pytest.mark.parametrize("label", CORRUPTIONS)
def test_each_corruption_is_detected(file_model, clean, label):
    corrupt, check = CORRUPTIONS[label]
    broken = report(file_model, corrupt(clean))
    assert {r["check"]: r["violations"] for r in rows_of(broken)}[check] > 0.005
    with pytest.raises(QualityError, match=check):
        quality_gate(broken, file_model.params)


def test_report_equals_the_single_checks(small):
    from marginlens.plans.catalog import CATALOG

    fused = {r["check"]: r["violations"] for r in rows_of(CATALOG["quality_report"](small))}
    single = {c: float(one(CATALOG[c](small))["violations"]) for c in CHECKS}
    assert fused == single


def test_sku_with_two_categories(file_model):
    products = file_model.dim_product.withColumn("category", F.when(F.col("product_key") == 1, "Other").otherwise(F.col("category")))
    assert one(quality.sku_has_unique_category(products))["violations"] == 1
    gone = file_model.dim_product.withColumn("category", F.when(F.col("product_key") == 1, F.col("category")))
    assert one(quality.sku_has_unique_category(gone))["violations"] == 0


def test_tolerance_edges(clean, file_model):
    exact = set_on(clean, FIRST, cogs=F.col("cogs") + Decimal("0.0100"))
    over = set_on(clean, FIRST, cogs=F.col("cogs") + Decimal("0.0101"))
    assert one(quality.line_rule(exact, "chk_cogs_identity", file_model.params))["violations"] == 0
    assert one(quality.line_rule(over, "chk_cogs_identity", file_model.params))["violations"] == 1


def test_coverage(small):
    for row in rows_of(quality.period_month_coverage(small.sales_period)):
        assert row["months"] == 12
    assert one(quality.channel_discount_total(small.fact(), "no such channel"))["discounts"] == 0.0
    assert one(quality.last_order_of_channel(small.fact(), small.params.b2b, small.params))["last_order"] is not None


def test_lines_without_their_order_customer_or_part_stay_and_are_reported(spark, tmp_path):
    """Every raw line is in the fact; the rules say how many lack a product, a date or a party."""
    from marginlens.operators import quality
    from marginlens.plans.catalog import query
    from marginlens.plans.model import OrderModel

    source = "/root/testdata/sf0.001"
    tables = {t: spark.read.parquet(f"{source}/{t}.parquet") for t in ("orders", "part", "customer", "lineitem", "nation", "region")}
    lost = {"orders": "o_orderkey % 10 = 0", "part": "p_partkey % 10 = 0", "customer": "c_custkey % 10 = 0"}
    for name, table in tables.items():
        (table.filter(f"NOT ({lost[name]})") if name in lost else table).write.parquet(f"{tmp_path}/{name}.parquet")
    m = OrderModel(spark, str(tmp_path))
    placed = tables["lineitem"].join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left")
    raw = tables["lineitem"].count()
    assert m.fact().count() == raw
    expected = {
        "chk_fact_rows_equal_staging": 0, "chk_net_sales_reconcile_staging": 0, "chk_cogs_reconcile_staging": 0,
        "chk_orphan_products": tables["lineitem"].filter("l_partkey % 10 = 0").count(),
        "chk_orphan_dates": tables["lineitem"].filter("l_orderkey % 10 = 0").count(),
        "chk_channel_keys": placed.filter("l_orderkey % 10 = 0 OR o_custkey % 10 = 0").count(),  # no known buyer, no channel
        "chk_orphan_resellers_customers": 0,
    }
    report = {r["check"]: r["violations"] for r in query(m, "quality_report").collect()}
    for name, violations in expected.items():
        assert report[name] == violations and query(m, name).first()["violations"] == violations, name

    short = m.fact().filter("order_line <> 1")
    missing = tables["lineitem"].filter("l_linenumber = 1")
    assert quality.reconciles(short, m.source_totals("rows"), "rows").first()["violations"] == missing.count()
    assert quality.reconciles(short, m.source_totals("net_sales"), "net_sales").first()["violations"] > 0
    assert quality.reconciles(short, m.source_totals("cogs"), "cogs").first()["violations"] > 0


def test_a_dimension_key_that_occurs_twice_is_seen_in_rows_sales_and_cost(spark, tmp_path):
    from marginlens.plans.catalog import query
    from marginlens.plans.model import OrderModel

    source = "/root/testdata/sf0.001"
    for name in ("orders", "part", "customer", "lineitem", "nation", "region"):
        table = spark.read.parquet(f"{source}/{name}.parquet")
        (table.unionByName(table.filter("p_partkey <= 3")) if name == "part" else table).write.parquet(f"{tmp_path}/{name}.parquet")
    m = OrderModel(spark, str(tmp_path))
    twice = m.fact().filter("product_key <= 3")
    report = {r["check"]: r["violations"] for r in query(m, "quality_report").collect()}
    assert report["chk_fact_rows_equal_staging"] == twice.count() / 2 > 0
    for name, measure in (("chk_net_sales_reconcile_staging", "net_sales"), ("chk_cogs_reconcile_staging", "cogs")):
        over = float(twice.agg(F.sum(measure)).first()[0]) / 2
        assert report[name] == pytest.approx(over) and query(m, name).first()["violations"] == pytest.approx(over)


def test_control_totals_by_month_equal_the_fact(small, file_model):
    for m in (small, file_model):
        month = F.date_format("order_date", "yyyy-MM").alias("month")
        of_fact = m.fact().groupBy(month).agg(F.count(F.lit(1)).alias("rows"), F.sum("net_sales").alias("net_sales"), F.sum("cogs").alias("cogs"))
        assert {tuple(r) for r in of_fact.collect()} == {tuple(r) for r in m.control_totals().collect()}

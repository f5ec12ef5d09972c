"""The order tables' mapping on data that the given tables don't hold: unknown buyers, many brands, new types, fractions."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marginlens.functions.dictionary import numbered
from marginlens.plans.catalog import CATALOG
from marginlens.plans.files import delimited_copy
from marginlens.plans.model import OrderModel
from tests.conftest import TESTDATA
from tests.fixtures import rows_of

SMALL = f"{TESTDATA}/sf0.001"
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")


@pytest.fixture
def changed(spark, tmp_path):
    """A model over the smallest tables with some of them replaced."""

    def make(**tables):
        for name in TABLES:
            tables.get(name, spark.read.parquet(f"{SMALL}/{name}.parquet")).write.parquet(f"{tmp_path}/{name}.parquet")
        return OrderModel(spark, str(tmp_path))

    return make


def test_a_buyer_of_unknown_segment_has_no_channel(spark, changed, small):
    customers = spark.read.parquet(f"{SMALL}/customer.parquet")
    model = changed(customer=customers.filter("c_custkey % 4 > 0 OR c_custkey IS NULL"))

    def sales(m):
        return {r["channel"]: r["s"] for r in rows_of(m.fact().groupBy("channel").agg(F.sum("net_sales").alias("s")))}

    before, after = sales(small), sales(model)
    lost = {c: before[c] - after[c] for c in before}
    assert after[None] > 0 and all(v > 0 for v in lost.values()) and sum(lost.values()) == after[None]
    unknown = model.fact().filter("channel IS NULL")
    assert unknown.filter("reseller_key IS NOT NULL OR customer_key IS NOT NULL").count() == 0
    assert CATALOG["chk_channel_keys"](model).first()["violations"] == unknown.count() > 0
    repeated = CATALOG["chk_fact_grain_unique"]
    assert repeated(model).first()["violations"] == repeated(small).first()["violations"]  # such lines keep an id of their own


def test_every_part_keeps_one_row_and_its_own_path(spark, changed):
    parts = spark.read.parquet(f"{SMALL}/part.parquet").limit(1)
    paths = [("ECONOMY", f"Brand#{n}") for n in range(1, 202)] + [("MEDIUM", "Brand#1"), ("NOVELTY", "Brand#1"), (None, "Brand#7"), ("PROMO", None)]
    rows = spark.createDataFrame([(i, *path) for i, path in enumerate(paths, 1)], "p_partkey long, p_type string, p_brand string")
    model = changed(part=parts.drop("p_partkey", "p_type", "p_brand").join(rows).select(parts.columns))
    for products in (model.dim_product, delimited_copy(model, ("DimProduct", "DimProductSubcategory", "DimProductCategory")).dim_product):
        found = Counter((r["product_key"], r["category"], r["subcategory"]) for r in rows_of(products))
        assert found == Counter((i, *path) for i, path in enumerate(paths, 1))


def test_rates_are_not_rounded_and_have_a_promotion_each(spark, changed):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    rate = F.when(F.col("l_linenumber") == 1, 0.075).when(F.col("l_linenumber") == 2, 0.08).otherwise(F.col("l_discount"))
    model = changed(lineitem=lines.withColumn("l_discount", rate))
    promotions = {r["promotion_key"]: (r["promotion_name"], r["discount_pct"], r["min_qty"]) for r in rows_of(model.dim_promotion)}
    assert promotions[75001] == ("Offer 7.5 %", 0.075, 75) and promotions[80001] == ("Offer 8 %", 0.08, 80)
    assert model.dim_promotion.count() == len(promotions)
    line = model.fact().filter("order_line = 1").first()
    assert line["promotion_key"] == 75001 and abs(line["discount_amount"] - line["gross_amount"] * Decimal("0.075")) <= Decimal("0.0001")
    assert CATALOG["chk_discount_identity"](model).first()["violations"] == 0
    assert CATALOG["chk_orphan_promotions"](model).first()["violations"] == 0


def test_a_quantity_that_is_not_whole_is_refused(spark, changed):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    model = changed(lineitem=lines.withColumn("l_quantity", F.when(F.col("l_linenumber") == 3, 1.5).otherwise(F.col("l_quantity").cast("double"))))
    with pytest.raises(Exception, match="l_quantity is not a whole number: 1.5"):
        model.fact().agg(F.sum("quantity")).collect()


def test_numbers_follow_the_order_of_the_keys(spark):
    keys = [(i * 7919 % 1000, "b" if i % 2 else None) for i in range(1000)] + [(None, None), (None, "a"), (5, "b")]
    found = rows_of(numbered(spark.createDataFrame(keys, "k int, t string"), ["k", "t"], "n", ranges=7))
    expected = sorted({k for k in keys if k != (None, None)}, key=lambda k: (k[0] is not None, k[0] or 0, k[1] is not None, k[1] or ""))
    assert [(r["k"], r["t"]) for r in sorted(found, key=lambda r: r["n"])] == expected
    assert sorted(r["n"] for r in found) == list(range(1, len(expected) + 1))

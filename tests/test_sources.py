from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marginlens.operators import kpi, model, quality
from marginlens.operators.period import sales_period
from marginlens.params import Params
from marginlens.sources.delimited import rejects, scan_delimited, staging, unambiguous
from marginlens.sources.schemas import FILES, layout
from tests.fixtures import one, rows_of
from tests.source_files import INTERNET_SALES, RESELLER_SALES

SCAN_SCHEMA = "k int, name string, amount decimal(19,4)"


def test_layouts_have_the_declared_width(spark):
    widths = {name: len(layout(name).names) for name in FILES}
    assert widths == {
        "FactResellerSales": 27, "FactInternetSales": 26, "DimProduct": 36, "DimProductSubcategory": 6,
        "DimProductCategory": 5, "DimDate": 19, "DimReseller": 20, "DimCustomer": 29, "DimGeography": 11,
        "DimSalesTerritory": 6, "DimPromotion": 16, "DimCurrency": 3,
    }
    with pytest.raises(KeyError):
        layout("Unknown")


def test_scan_keeps_text_as_it_is(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('1|a "quoted" b|1.5\n2||\n3|  spaced  |2.25\n4|back\\slash|3\n5|"open|4\n', encoding="utf-8")
    rows = [tuple(r) for r in scan_delimited(spark, str(path), SCAN_SCHEMA).orderBy("k").collect()]
    assert rows == [
        (1, 'a "quoted" b', Decimal("1.5000")),
        (2, None, None),
        (3, "  spaced  ", Decimal("2.2500")),
        (4, "back\\slash", Decimal("3.0000")),
        (5, '"open', Decimal("4.0000")),
    ]


BAD_LINES = {
    "1|name": "2 fields instead of 3", "1|name|1.0|more": "4 fields instead of 3", "x|name|1.0": "k is not int: x",
    "1|name|ten": "amount is not decimal", "": None,
}


@pytest.mark.parametrize("bad", [line for line, reason in BAD_LINES.items() if reason])
@pytest.mark.parametrize("use", ["collect", "count", "one column", "sum", "empty filter"])
def test_scan_fails_on_a_line_that_does_not_fit_whatever_is_read(spark, tmp_path, bad, use):
    path = tmp_path / "t.csv"
    path.write_text("1|fine|1.0\n" + bad + "\n", encoding="utf-8")
    scan = scan_delimited(spark, str(path), SCAN_SCHEMA)
    uses = {
        "collect": scan.collect, "count": scan.count, "one column": scan.select("name").collect,
        "sum": scan.agg(F.sum("k")).collect, "empty filter": scan.filter("k = 1").count,
    }
    with pytest.raises(Exception, match="(?s)Malformed line.*t.csv: " + BAD_LINES[bad]):
        uses[use]()


def test_a_line_is_split_once_for_its_check_and_all_its_fields(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1|fine|1.0\n", encoding="utf-8")
    scan = scan_delimited(spark, str(path), SCAN_SCHEMA).filter("k > 0 AND name IS NOT NULL")
    assert scan._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_rejects_name_file_reason_and_line(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1|fine|1.0\n" + "\n".join(BAD_LINES) + "\n", encoding="utf-8")
    found = {r["line"]: r for r in rows_of(rejects(spark, str(path), SCAN_SCHEMA))}
    assert set(found) == {line for line, reason in BAD_LINES.items() if reason}
    assert all(found[line]["reason"].startswith(BAD_LINES[line]) and found[line]["file"].endswith("t.csv") for line in found)


def test_text_that_the_format_cannot_hold_is_refused(spark):
    texts = spark.createDataFrame([("a b",), (None,), ('"q"',)], "t string")
    assert {r[0] for r in texts.select(unambiguous(F.col("t"), "t")).collect()} == {"a b", None, '"q"'}
    for bad in ("a|b", "a\nb", "a\rb"):
        with pytest.raises(Exception, match="holds a separator"):
            spark.createDataFrame([(bad,)], "t string").select(unambiguous(F.col("t"), "t")).collect()


def test_missing_files_raise_before_any_work(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        staging(spark, str(tmp_path))


def test_parameters_are_checked():
    windows = {"P0_START": "2020-01-01", "P0_END": "2020-12-31", "P1_START": "2021-01-01", "P1_END": "2021-12-31"}
    with pytest.raises(KeyError):
        Params.from_windows({**windows, "UNKNOWN": "2020-01-01"})
    with pytest.raises(KeyError):
        Params.from_windows({k: v for k, v in windows.items() if k != "P1_END"})
    with pytest.raises(ValueError):
        Params.from_windows({**windows, "P1_END": "not a date"})
    with pytest.raises(ValueError):
        Params.from_windows({**windows, "P1_END": "2020-06-01"})
    with pytest.raises(KeyError):
        Params().with_(no_such_parameter=1)


def test_published_defaults():
    p = Params()
    assert (str(p.p0_start), str(p.p0_end), str(p.p1_start), str(p.p1_end)) == ("2011-12-01", "2012-11-30", "2012-12-01", "2013-11-30")
    assert p.channels == ("Revendeurs", "Internet") and p.no_promotion_key == 1
    assert p.price_steps == (0.03, 0.05, 0.08, 0.10) and p.elasticities == (0.0, -1.0, -2.0, -3.0)
    assert p.variable_shares == (1.0, 0.95, 0.90, 0.80) and p.sensitivity == (0.05, -3.0, 0.8)
    assert p.discount_caps == (Decimal("0.10"), Decimal("0.05")) and p.gate_tolerance == 0.005
    assert (p.class_a_share, p.class_b_share) == (Decimal("0.80"), Decimal("0.95"))
    assert p.depth_cuts == (Decimal("0.05"), Decimal("0.10"), Decimal("0.20"))


def test_channel_dimension(spark):
    rows = sorted(map(tuple, model.dim_channel(spark, Params()).collect()))
    assert rows == [(1, "Revendeurs"), (2, "Internet")]


def test_model_from_files(file_model):
    products = {r["product_key"]: r for r in rows_of(file_model.dim_product)}
    assert products[2]["category"] == "Bikes" and products[2]["list_price"] is None and products[2]["is_current_version"]
    assert products[1]["is_current_version"] is None and products[3]["dealer_price"] is None
    assert products[3]["product_name"] == 'Helmet 26" "M"'
    skus = {r["sku"]: r for r in rows_of(file_model.dim_sku)}
    assert len(skus) == 2 and skus["BK-1"]["product_name"] == "Road bike v2"
    resellers = {r["reseller_key"]: r for r in rows_of(file_model.dim_reseller)}
    assert resellers[1]["number_employees"] == 25 and resellers[2]["number_employees"] is None
    assert resellers[2]["reseller_name"] == " Hill Bikes " and resellers[2]["city"] == "Lyon"
    customers = {r["customer_key"]: r for r in rows_of(file_model.dim_customer)}
    assert customers[102] == {"customer_key": 102, "city": None, "state_province": None, "country": None}
    assert file_model.dim_date.filter("date = '2020-12-31'").select("date_key", "year_month").first() == (20201231, "2020-12")


def test_fact_unites_both_channels(file_model):
    fact = {r["sales_line_id"]: r for r in rows_of(file_model.fact())}
    assert len(fact) == len(RESELLER_SALES) + len(INTERNET_SALES)
    b2b, b2c = fact["Revendeurs|SO1|2"], fact["Internet|SO6|2"]
    assert (b2b["reseller_key"], b2b["customer_key"], b2b["sku"], b2b["date_key"]) == (1, None, "HL-1", 20200310)
    assert (b2c["reseller_key"], b2c["customer_key"], b2c["sku"]) == (None, 102, "BK-1")
    assert b2b["discount_amount"] == 12 and b2b["net_sales"] == 228 and b2b["gross_margin"] == 108
    assert b2b["margin_before_discount"] == 120 and not b2b["is_below_cost"]
    assert fact["Revendeurs|SO4|1"]["is_below_cost"]
    assert tuple(file_model.fact().columns) == model.FACT_COLUMNS


def test_unknown_product_keeps_its_line(file_model):
    nobody = file_model.dim_product.filter("product_key = 1").select("product_key", "sku")
    fact = model.fact_sales(model.with_sku(file_model.staged_lines(), nobody))
    assert fact.count() == len(RESELLER_SALES) + len(INTERNET_SALES)
    assert fact.filter(F.col("sku").isNull()).count() == 5


def test_one_pass_lines_equal_the_union_of_channel_files(small):
    """The order tables give both channels in one pass; split into channel files they unite to the same fact."""
    lines = small.source.sales_lines()
    raw = {"order_number": "SalesOrderNumber", "order_line": "SalesOrderLineNumber", "product_key": "ProductKey",
           "territory_key": "SalesTerritoryKey", "promotion_key": "PromotionKey", "order_date": "OrderDate",
           "reseller_key": "ResellerKey", "customer_key": "CustomerKey", **model.LINE_MEASURES}
    staged = lines.withColumnsRenamed(raw).drop("sku")
    b2b, b2c = (staged.filter(F.col("channel") == c).drop("channel") for c in small.params.channels)
    united = model.fact_sales(model.with_sku(model.unified_lines(b2b, b2c, small.params), small.dim_product))
    fact = small.fact()
    assert united.exceptAll(fact).count() == 0 and fact.exceptAll(united).count() == 0


def test_no_personal_columns_in_the_model(file_model, small):
    for m in (file_model, small):
        assert quality.personal_columns({**m.dims, "fact": m.fact()}) == []
        assert m.dim_customer.columns == ["customer_key", "city", "state_province", "country"]
    assert quality.personal_columns({"raw": file_model.staging["DimCustomer"]})


def test_kpis_over_files(file_model):
    summary = {(r["period"], r["channel"]): r for r in rows_of(kpi.kpi_summary(sales_period(file_model.fact(), file_model.params)))}
    assert summary[("P0", None)]["orders"] == 3 and summary[("P0", "Revendeurs")]["orders"] == 2
    assert summary[("P1", None)]["lines"] == 4 and summary[("P1", "Internet")]["units"] == 3
    assert one(quality.product_version_count(file_model.dim_product)) == {"product_keys": 3, "skus": 2}

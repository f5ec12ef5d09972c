"""Staging frames derived from the order-processing tables (lineitem, orders, customer, part, nation, region).

The two sales channels are customer market segments, a product version is a part and its sku is the brand with the part
name, and standard cost drifts with the order year. A part type is a category and a brand within it a subcategory. The star model above this layer is the same for every source.
"""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginlens.functions.dictionary import numbered
from marginlens.functions.exprs import MONEY, dec, money
from marginlens.params import Params

# Fixed values of this mapping.
B2B_SEGMENTS = ("BUILDING", "MACHINERY", "FURNITURE")
FRENCH_MONTHS = (
    "janvier", "février", "mars", "avril", "mai", "juin",
    "juillet", "août", "septembre", "octobre", "novembre", "décembre",
)
COST_BASE_YEAR = 1995
WINDOWS = {
    "P0_START": "1999-08-01",
    "P0_END": "2000-07-31",
    "P1_START": "2000-08-01",
    "P1_END": "2001-07-31",
}


def default_params() -> Params:
    return Params.from_windows(
        WINDOWS,
        p0_label="12 mois à juil. 2000",
        p1_label="12 mois à juil. 2001",
        focus_category="ECONOMY",
        focus_subcategory="Brand#1",
        month_range=("1998-01", "2001-07"),
        margin_floor_pct=15.0,
    )


#: Discount rates keep six decimals.
RATE = "decimal(9,6)"


def _whole(column: str) -> Column:
    """A whole number as INT; a fraction or a number beyond INT fails the job instead of being cut."""
    number = F.col(column)
    text = F.concat(F.lit(f"{column} is not a whole number: "), number.cast("string"))
    return F.when(number.isNull() | (number == number.try_cast("int")), number.try_cast("int")).otherwise(F.raise_error(text))


def _rate() -> Column:
    return F.col("l_discount").cast(RATE)


def _promotion_key(rate: Column) -> Column:
    """One key per rate: millionths, from 1."""
    return (rate * F.lit(1_000_000)).cast("int") + 1


def _net_sales() -> Column:
    """Net sales of a raw line: gross less the discount, which is rounded as money."""
    gross = money("l_extendedprice")
    return (gross - money(gross * _rate())).cast(MONEY)


def _cost_drift(year: Column) -> Column:
    drift_pct = F.lit(100) + 5 * (year - COST_BASE_YEAR)
    return drift_pct.cast("decimal(5,0)") * dec(Decimal("0.01"))


class OrderTables:
    """Lazy staging frames over ``<base>/<table>.parquet``. Every frame selects only the columns it needs."""

    def __init__(self, spark: SparkSession, base: str, params: Params | None = None):
        self.spark = spark
        self.base = base.rstrip("/")
        self.params = params or default_params()
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """Scan of one table. Its files are listed and its schema read once, however often a query uses it."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.base}/{name}.parquet")
        return self._tables[name]

    def _is_b2b(self) -> Column:
        return F.col("c_mktsegment").isin(*B2B_SEGMENTS)

    def _sku(self) -> Column:
        return F.concat("p_brand", F.lit(":"), "p_name")

    def sales_lines(self, between: tuple[date, date] | None = None, products: bool = True, rebalanced: bool = False) -> DataFrame:
        """Order lines of both channels in the unified layout with their sku, in one pass over lineitem.

        ``between`` (inclusive) is applied to the raw order timestamp so that it reaches the orders scan. Without ``products``
        parts are not joined, and sku and cost are left out. ``rebalanced`` brings the lines of a month together, as they come out
        of the joins, and sorts them by month, as a writer of month folders needs them, and by order, which stores in less room:
        what is computed from a line is computed after that and neither shuffled nor sorted.
        """
        p = self.params
        orders = self.table("orders")
        if between is not None:
            after_end = between[1] + timedelta(days=1)
            orders = orders.filter(
                (F.col("o_orderdate") >= F.lit(str(between[0])).cast("timestamp_ntz"))
                & (F.col("o_orderdate") < F.lit(str(after_end)).cast("timestamp_ntz"))
            )
        # Lines carry an order's day and whether its buyer is a business through every shuffle: a few bytes each, unlike a
        # timestamp and the name of a segment.
        orders = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"))
        buyers = self.table("customer").select("c_custkey", "c_nationkey", self._is_b2b().alias("is_b2b"))
        placed = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
        items = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_quantity", "l_linenumber"
        )
        # Cost and sku come from one look-up: two joins on the same key would share a stage, and adaptive execution does not
        # split a hot part there because the second join relies on the partitioning of the first.
        # As money a price takes three times the room in a row, so lines that are shuffled once more carry it as it is.
        retail = F.col("p_retailprice") if rebalanced else money("p_retailprice")
        parts = self.table("part").select("p_partkey", retail.alias("retail"), self._sku().alias("sku"))
        # A line without its order, customer or part stays, with NULL in what it lacks; it is the quality rules that report it.
        # A buyer whose segment is unknown has no channel. Only a date range, which a line without an order cannot be in, leaves
        # lines out.
        lines = items.join(placed, F.col("l_orderkey") == F.col("o_orderkey"), "left" if between is None else "inner")
        if products:
            lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        if rebalanced:
            # What repeats side by side takes the least room in a shuffle, and lines come out of the last join by part.
            lines = lines.select(
                "l_partkey", "retail", "sku", "l_orderkey", "o_custkey", "c_nationkey", "is_b2b", "order_date",
                F.trunc("order_date", "MM").alias("first_of_month"), "l_discount", "l_quantity", "l_linenumber", "l_extendedprice",
            )
            by_month = F.date_format("order_date", "yyyy-MM")
            lines = lines.hint("rebalance", "first_of_month").sortWithinPartitions(by_month, "l_orderkey", "l_linenumber")

        gross, quantity = F.col("gross_amount"), F.col("quantity")
        ten_thousandths = (gross * F.lit(10000)).cast("bigint")
        on_b2b = F.col("channel") == p.b2b
        return (
            lines.withColumns(
                {
                    "channel": F.when(F.col("is_b2b"), p.b2b).when(F.col("is_b2b").isNotNull(), p.b2c),
                    "quantity": _whole("l_quantity"),
                    "gross_amount": money("l_extendedprice"),
                    "discount_rate": _rate(),
                    **({"unit_cogs": money(money("retail") * _cost_drift(F.year("order_date")))} if products else {}),
                }
            )
            .withColumns(
                {
                    "discount_amount": money(gross * F.col("discount_rate")),
                    # Unit price truncated to the fourth decimal with integer arithmetic.
                    "unit_price": money(F.call_function("div", ten_thousandths, quantity).cast("decimal(19,0)") * dec(Decimal("0.0001"))),
                }
            )
            .select(
                "channel",
                F.concat(F.lit("SO"), F.col("l_orderkey").cast("string")).alias("order_number"),
                F.col("l_linenumber").cast("int").alias("order_line"),
                F.col("l_partkey").cast("bigint").alias("product_key"),
                *(["sku"] if products else []),
                F.when(on_b2b, F.col("o_custkey")).cast("bigint").alias("reseller_key"),
                F.when(~on_b2b, F.col("o_custkey")).cast("bigint").alias("customer_key"),
                F.col("c_nationkey").cast("int").alias("territory_key"),
                _promotion_key(F.col("discount_rate")).alias("promotion_key"),
                "order_date",
                "quantity",
                "unit_price",
                "gross_amount",
                F.col("l_discount").alias("discount_pct"),
                "discount_amount",
                *(["unit_cogs", money(F.col("unit_cogs") * quantity).alias("cogs")] if products else []),
                (gross - F.col("discount_amount")).cast(MONEY).alias("net_sales"),
            )
        )

    def raw_totals(self) -> DataFrame:
        """Rows and net sales of the raw order lines, from the lines alone: one row that the model must account for."""
        lines = self.table("lineitem").select(_net_sales().alias("net_sales"))
        return lines.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("net_sales"), F.lit(0)).cast("decimal(38,4)").alias("net_sales"))

    def control_totals(self) -> DataFrame:
        """(month, rows, net_sales, cogs) of the raw lines. Look-ups have one row per key.

        Lines go through one shuffle by order and, if parts are many, one by part, and take nothing along but keys and the numbers
        that they are priced by: sums per part and month would be about as many rows, and wider ones.
        """
        orders = self.table("orders").groupBy("o_orderkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("day"))
        parts = self.table("part").groupBy("p_partkey").agg(F.min(money("p_retailprice")).alias("retail"))
        items = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_extendedprice", "l_discount", F.col("l_quantity").cast("bigint").alias("quantity")
        )
        dated = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
            "l_partkey", F.trunc("day", "MM").alias("first_of_month"), "l_extendedprice", "l_discount", "quantity"
        )
        priced = dated.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        cogs = (money(F.col("retail") * _cost_drift(F.year("first_of_month"))) * F.col("quantity")).cast("decimal(38,4)")
        month = F.date_format("first_of_month", "yyyy-MM").alias("month")
        return priced.groupBy(month).agg(F.count(F.lit(1)).alias("rows"), F.sum(_net_sales()).alias("net_sales"), F.sum(cogs).alias("cogs"))

    def products(self) -> DataFrame:
        retail = money("p_retailprice")
        size = F.col("p_size")
        paths = self._subcategories.select(F.col("p_type").alias("of_type"), F.col("p_brand").alias("of_brand"), "subcategory_key")
        same = F.col("p_type").eqNullSafe(F.col("of_type")) & F.col("p_brand").eqNullSafe(F.col("of_brand"))
        return self.table("part").join(paths, same, "left").select(
            F.col("p_partkey").cast("string").alias("ProductKey"),
            self._sku().alias("ProductAlternateKey"),
            F.col("subcategory_key").cast("string").alias("ProductSubcategoryKey"),
            F.col("p_name").alias("EnglishProductName"),
            F.col("p_name").alias("ModelName"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("Color"),
            F.substring("p_type", 1, 1).alias("ProductLine"),
            F.when(size <= 15, "L").when(size <= 35, "M").when(size <= 49, "H").alias("Class"),
            retail.cast("string").alias("StandardCost"),
            F.when(size == 50, "n/a").otherwise((retail * 2).cast(MONEY).cast("string")).alias("ListPrice"),
            F.when(size > 1, (retail + 100).cast(MONEY).cast("string")).alias("DealerPrice"),
            F.when(size % 7 > 0, "Current").alias("Status"),
        )

    @cached_property
    def _categories(self) -> DataFrame:
        return numbered(self.table("part"), ["p_type"], "category_key")

    @cached_property
    def _subcategories(self) -> DataFrame:
        return numbered(self.table("part"), ["p_type", "p_brand"], "subcategory_key")

    def subcategories(self) -> DataFrame:
        return self._subcategories.join(self._categories, "p_type", "left").select(
            F.col("subcategory_key").alias("ProductSubcategoryKey"),
            F.col("p_brand").alias("EnglishProductSubcategoryName"),
            F.col("category_key").alias("ProductCategoryKey"),
        )

    def categories(self) -> DataFrame:
        return self._categories.select(
            F.col("category_key").alias("ProductCategoryKey"), F.col("p_type").alias("EnglishProductCategoryName")
        )

    def dates(self) -> DataFrame:
        day = F.col("day")
        days = self.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
        return days.select(
            (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).alias("DateKey"),
            day.alias("FullDateAlternateKey"),
            F.date_format(day, "MMMM").alias("EnglishMonthName"),
            F.element_at(F.lit(list(FRENCH_MONTHS)), F.month(day)).alias("FrenchMonthName"),
            F.month(day).alias("MonthNumberOfYear"),
            F.quarter(day).alias("CalendarQuarter"),
            F.year(day).alias("CalendarYear"),
        )

    def _nations(self) -> DataFrame:
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def geographies(self) -> DataFrame:
        return self._nations().select(
            F.col("n_nationkey").cast("string").alias("GeographyKey"),
            F.concat(F.lit("Capital of "), F.col("n_name")).alias("City"),
            F.col("r_name").alias("StateProvinceName"),
            F.col("n_name").alias("EnglishCountryRegionName"),
            F.col("n_nationkey").cast("string").alias("SalesTerritoryKey"),
        )

    def territories(self) -> DataFrame:
        return self._nations().select(
            F.col("n_nationkey").cast("string").alias("SalesTerritoryKey"),
            F.col("n_name").alias("SalesTerritoryRegion"),
            F.col("n_name").alias("SalesTerritoryCountry"),
            F.col("r_name").alias("SalesTerritoryGroup"),
        )

    def resellers(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .filter(self._is_b2b())
            .select(
                key.cast("string").alias("ResellerKey"),
                F.col("c_nationkey").cast("string").alias("GeographyKey"),
                F.col("c_name").alias("ResellerName"),
                F.col("c_mktsegment").alias("BusinessType"),
                F.substring("c_mktsegment", 1, 1).alias("ProductLine"),
                F.when(key % 11 > 0, (key % 90 + 10).cast("string")).otherwise("unknown").alias("NumberEmployees"),
                F.when(key % 2 == 0, "A").otherwise("Q").alias("OrderFrequency"),
                F.when(key % 13 > 0, (F.lit(1960) + key % 40).cast("string")).alias("YearOpened"),
            )
        )

    def customers(self) -> DataFrame:
        return (
            self.table("customer")
            .filter(~self._is_b2b())
            .select(
                F.col("c_custkey").cast("string").alias("CustomerKey"),
                F.col("c_nationkey").cast("string").alias("GeographyKey"),
                F.col("c_name").alias("LastName"),
            )
        )

    def promotions(self) -> DataFrame:
        rates = self.table("lineitem").select(_rate().alias("rate")).filter("rate IS NOT NULL").distinct()
        rate = F.col("rate")
        return rates.select(
            _promotion_key(rate).cast("string").alias("PromotionKey"),
            self._promotion_name(rate).alias("EnglishPromotionName"),
            rate.cast("string").alias("DiscountPct"),
            self._promotion_type(rate).alias("EnglishPromotionType"),
            F.when(rate == 0, "No Discount").otherwise("Reseller").alias("EnglishPromotionCategory"),
            (rate * 1000).cast("int").cast("string").alias("MinQty"),
            F.when(rate > dec(Decimal("0.05")), "open").otherwise("60").alias("MaxQty"),
        )

    def name_promotions(self, keyed: DataFrame) -> DataFrame:
        """Adds type and name to promotion keys. Both follow from the rate in the key, so order lines are not read for them."""
        rate = ((F.col("promotion_key") - 1).cast("decimal(10,0)") * dec(Decimal("0.000001"))).cast(RATE)
        return keyed.withColumns({"promotion_type": self._promotion_type(rate), "promotion_name": self._promotion_name(rate)})

    def _promotion_type(self, rate: Column) -> Column:
        return (
            F.when(rate == 0, "No Discount")
            .when(rate <= dec(Decimal("0.05")), "Volume Discount")
            .when(rate <= dec(Decimal("0.08")), "Seasonal Discount")
            .when(rate.isNotNull(), self.params.new_product_type)
        )

    @staticmethod
    def _promotion_name(rate: Column) -> Column:
        points = F.regexp_replace((rate * 100).cast("decimal(9,4)").cast("string"), r"\.?0+$", "")
        return F.concat(F.lit("Offer "), points, F.lit(" %"))

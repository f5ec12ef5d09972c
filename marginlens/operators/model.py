"""Star model: staging frames in, dimensions and the one-row-per-order-line fact out.

Dimension look-ups are plain equi-joins. Whether a side is broadcast is left to its measured size
(``spark.sql.autoBroadcastJoinThreshold`` and the runtime statistics of adaptive execution), and a product that holds a
large share of the lines is split by adaptive skew-join handling, so none of them relies on a dimension staying small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginlens.functions.exprs import MONEY
from marginlens.params import Params

SKU_ATTRIBUTES = ("product_name", "model_name", "category", "subcategory", "color", "product_line", "class")

FACT_COLUMNS = (
    "sales_line_id", "channel", "order_number", "order_line", "order_date", "date_key", "product_key", "sku",
    "reseller_key", "customer_key", "territory_key", "promotion_key", "quantity", "unit_price", "gross_amount",
    "discount_pct", "discount_amount", "net_sales", "unit_cogs", "cogs", "gross_margin", "margin_before_discount",
    "is_below_cost",
)


def dim_date(stg_date: DataFrame) -> DataFrame:
    return stg_date.select(
        F.col("DateKey").alias("date_key"),
        F.col("FullDateAlternateKey").alias("date"),
        F.col("CalendarYear").alias("year"),
        F.col("CalendarQuarter").alias("quarter"),
        F.col("MonthNumberOfYear").alias("month"),
        F.col("EnglishMonthName").alias("month_name"),
        F.col("FrenchMonthName").alias("month_name_fr"),
        F.date_format("FullDateAlternateKey", "yyyy-MM").alias("year_month"),
    )


def product_keys(stg_product: DataFrame) -> DataFrame:
    """Surrogate key to stable sku: all that the fact needs from the product dimension."""
    return stg_product.select(
        F.col("ProductKey").cast("bigint").alias("product_key"), F.col("ProductAlternateKey").alias("sku")
    )


def dim_product(stg_product: DataFrame, stg_subcategory: DataFrame, stg_category: DataFrame) -> DataFrame:
    """One row per product version with its category path."""
    subcategory = stg_subcategory.select(
        F.col("ProductSubcategoryKey").alias("_sub"),
        F.col("ProductCategoryKey").alias("_sub_cat"),
        F.col("EnglishProductSubcategoryName").alias("subcategory"),
    )
    category = stg_category.select(
        F.col("ProductCategoryKey").alias("_cat"), F.col("EnglishProductCategoryName").alias("category")
    )
    versions = stg_product.withColumn("_product_sub", F.col("ProductSubcategoryKey").try_cast("int"))
    return (
        versions.join(subcategory, F.col("_product_sub") == F.col("_sub"), "left")
        .join(category, F.col("_sub_cat") == F.col("_cat"), "left")
        .select(
            F.col("ProductKey").cast("bigint").alias("product_key"),
            F.col("ProductAlternateKey").alias("sku"),
            F.col("EnglishProductName").alias("product_name"),
            F.col("ModelName").alias("model_name"),
            "category",
            "subcategory",
            F.col("Color").alias("color"),
            F.col("ProductLine").alias("product_line"),
            F.col("Class").alias("class"),
            F.col("StandardCost").try_cast(MONEY).alias("standard_cost"),
            F.col("ListPrice").try_cast(MONEY).alias("list_price"),
            F.col("DealerPrice").try_cast(MONEY).alias("dealer_price"),
            (F.col("Status") == "Current").alias("is_current_version"),
        )
    )


def dim_sku(products: DataFrame, attributes: tuple[str, ...] = SKU_ATTRIBUTES) -> DataFrame:
    """Attributes of the newest version of each sku.

    ``max_by`` over a struct combines map-side, so no task ever holds all versions of a sku; the struct keeps attributes that
    are NULL in the newest version. Callers name the attributes they use, because an aggregated struct cannot be pruned later.
    """
    newest = F.max_by(F.struct(*attributes), "product_key").alias("newest")
    return products.groupBy("sku").agg(newest).select("sku", *[F.col(f"newest.{a}").alias(a) for a in attributes])


def dim_territory(stg_territory: DataFrame) -> DataFrame:
    return stg_territory.select(
        F.col("SalesTerritoryKey").cast("int").alias("territory_key"),
        F.col("SalesTerritoryRegion").alias("region"),
        F.col("SalesTerritoryCountry").alias("country"),
        F.col("SalesTerritoryGroup").alias("territory_group"),
    )


def dim_geography(stg_geography: DataFrame) -> DataFrame:
    return stg_geography.select(
        F.col("GeographyKey").cast("int").alias("geography_key"),
        F.col("City").alias("city"),
        F.col("StateProvinceName").alias("state_province"),
        F.col("EnglishCountryRegionName").alias("country"),
        F.col("SalesTerritoryKey").cast("int").alias("territory_key"),
    )


def _located(parties: DataFrame, geography: DataFrame) -> DataFrame:
    places = geography.select("geography_key", "city", "state_province", "country")
    return parties.withColumn("_geo", F.col("GeographyKey").try_cast("int")).join(
        places, F.col("_geo") == F.col("geography_key"), "left"
    )


def dim_customer(stg_customer: DataFrame, geography: DataFrame) -> DataFrame:
    """Consumers by place only: personal columns are landed in staging and never selected here."""
    return _located(stg_customer, geography).select(
        F.col("CustomerKey").cast("bigint").alias("customer_key"), "city", "state_province", "country"
    )


def dim_reseller(stg_reseller: DataFrame, geography: DataFrame) -> DataFrame:
    return _located(stg_reseller, geography).select(
        F.col("ResellerKey").cast("bigint").alias("reseller_key"),
        F.col("ResellerName").alias("reseller_name"),
        F.col("BusinessType").alias("business_type"),
        F.col("ProductLine").alias("product_line"),
        F.col("NumberEmployees").try_cast("int").alias("number_employees"),
        F.col("OrderFrequency").alias("order_frequency"),
        F.col("YearOpened").try_cast("int").alias("year_opened"),
        "city",
        "state_province",
        "country",
    )


def dim_promotion(stg_promotion: DataFrame) -> DataFrame:
    return stg_promotion.select(
        F.col("PromotionKey").cast("int").alias("promotion_key"),
        F.col("EnglishPromotionName").alias("promotion_name"),
        F.round(F.col("DiscountPct").cast("double"), 4).alias("discount_pct"),
        F.col("EnglishPromotionType").alias("promotion_type"),
        F.col("EnglishPromotionCategory").alias("promotion_category"),
        F.col("MinQty").try_cast("int").alias("min_qty"),
        F.col("MaxQty").try_cast("int").alias("max_qty"),
    )


def dim_channel(spark: SparkSession, params: Params) -> DataFrame:
    return spark.createDataFrame(list(enumerate(params.channels, start=1)), "channel_key int, channel string")


def channel_usage(fact: DataFrame, channels: DataFrame) -> DataFrame:
    """Every declared channel with the number of lines it has in the fact."""
    lines = fact.groupBy("channel").agg(F.count(F.lit(1)).alias("lines"))
    return channels.join(lines, "channel", "left").select(
        "channel_key", "channel", F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines")
    )


# Staging name of each measure of a sales line, the same in both channel files.
LINE_MEASURES = {
    "quantity": "OrderQuantity",
    "unit_price": "UnitPrice",
    "gross_amount": "ExtendedAmount",
    "discount_pct": "UnitPriceDiscountPct",
    "discount_amount": "DiscountAmount",
    "unit_cogs": "ProductStandardCost",
    "cogs": "TotalProductCost",
    "net_sales": "SalesAmount",
}


def channel_lines(stg_sales: DataFrame, channel: str, party: str) -> DataFrame:
    """Order lines of one channel file in the unified layout; ``party`` is the staging key of whoever buys there."""
    own_key = F.col(party).cast("bigint")
    no_key = F.lit(None).cast("bigint")
    return stg_sales.select(
        F.lit(channel).alias("channel"),
        F.col("SalesOrderNumber").alias("order_number"),
        F.col("SalesOrderLineNumber").alias("order_line"),
        F.col("ProductKey").cast("bigint").alias("product_key"),
        (own_key if party == "ResellerKey" else no_key).alias("reseller_key"),
        (own_key if party == "CustomerKey" else no_key).alias("customer_key"),
        F.col("SalesTerritoryKey").alias("territory_key"),
        F.col("PromotionKey").alias("promotion_key"),
        F.col("OrderDate").cast("date").alias("order_date"),
        *[F.col(raw).alias(name) for name, raw in LINE_MEASURES.items()],
    )


def unified_lines(stg_reseller_sales: DataFrame, stg_internet_sales: DataFrame, params: Params) -> DataFrame:
    b2b = channel_lines(stg_reseller_sales, params.b2b, "ResellerKey")
    b2c = channel_lines(stg_internet_sales, params.b2c, "CustomerKey")
    return b2b.unionByName(b2c)


def with_sku(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Unified lines with the stable sku of their product version; NULL for an unknown product."""
    return lines.join(products.select("product_key", "sku"), "product_key", "left")


def identified(lines: DataFrame) -> DataFrame:
    """Lines with their id and date key."""
    return lines.withColumns(
        {
            "sales_line_id": F.concat(F.coalesce("channel", F.lit("")), F.lit("|"), "order_number", F.lit("|"), F.col("order_line").cast("string")),
            "date_key": F.year("order_date") * 10000 + F.month("order_date") * 100 + F.dayofmonth("order_date"),
        }
    )


def fact_sales(lines: DataFrame) -> DataFrame:
    """Fact at order-line grain from unified lines that carry their sku."""
    return identified(lines).withColumns(
        {
            "gross_margin": F.col("net_sales") - F.col("cogs"),
            "margin_before_discount": F.col("gross_amount") - F.col("cogs"),
            "is_below_cost": F.col("net_sales") < F.col("cogs"),
        }
    ).select(*FACT_COLUMNS)

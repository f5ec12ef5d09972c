"""A sales model: the tables that operators work on, built lazily from a source."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginlens.operators import bridge, discounts, model, pareto, period, quality
from marginlens.params import Params
from marginlens.sources.order_tables import OrderTables


def summed_control(by_month: DataFrame, *names: str) -> DataFrame:
    sums = {"rows": "bigint", "net_sales": "decimal(38,4)", "cogs": "decimal(38,4)"}
    return by_month.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast(sums[n]).alias(n) for n in names])


class SalesModel:
    """Base: every attribute is a lazy DataFrame; sources override how staging and fact come about."""

    spark: SparkSession
    params: Params

    # ---- supplied by the source

    def fact(self, between: tuple[date, date] | None = None) -> DataFrame:
        """The fact, optionally restricted to order dates of an inclusive range at the scan."""
        raise NotImplementedError

    def rebalanced_fact(self) -> DataFrame:
        """The fact with the lines of a month together, in one part or, if they are many, a few."""
        return self.fact().withColumn(period.MONTH_PARTITION, F.date_format("order_date", "yyyy-MM")).hint("rebalance", period.MONTH_PARTITION)

    def bare_lines(self, between: tuple[date, date] | None = None) -> DataFrame:
        """The fact's lines without what needs a look-up of their product: no sku, cost or margin."""
        return self.fact(between)

    def control_totals(self) -> DataFrame:
        """(month, rows, net_sales, cogs) of the source, one row per month, that the fact must account for.

        They don't come from the fact's own joins: an attribute is looked up in frames with one row per key, so a key that
        occurs twice in a dimension multiplies lines of the fact and not these.
        """
        raise NotImplementedError

    def source_totals(self, *names: str) -> DataFrame:
        """One row with the named control totals over all months."""
        return summed_control(self.control_totals(), *names)

    # ---- shared

    def grain(self) -> DataFrame:
        """Lines whose id occurs before."""
        return quality.grain_unique(self.fact())

    def quality_report(self) -> DataFrame:
        totals = self.source_totals("rows", "net_sales", "cogs")
        return quality.quality_report(self.fact(), totals, self.dims, self.dim_product, self.params)

    def create_views(self, prefix: str = "") -> list[str]:
        """Register the tables of the model as temporary views for ad-hoc SQL; returns their names.

        Views are lazy: a query on one reads what it needs and nothing is computed here, except that the derived tables of a
        model that is not stored are staged.
        """
        tables = {f"dim_{name}": df for name, df in self.dims.items()}
        tables |= {"fact_sales": self.fact(), "sales_period": self.sales_period, "pvm_lines": self.pvm_lines}
        tables |= {"pareto_sku": self.pareto_sku, "pareto_reseller": self.pareto_reseller}
        for name, df in tables.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in tables]

    @property
    def sales_period(self) -> DataFrame:
        p = self.params
        return period.sales_period(self.fact((p.p0_start, p.p1_end)), p)

    @property
    def bare_period(self) -> DataFrame:
        """``sales_period`` over bare lines."""
        p = self.params
        return period.sales_period(self.bare_lines((p.p0_start, p.p1_end)), p)

    @property
    def reported_months(self) -> DataFrame:
        return period.reported_months(self.fact(period.month_range(self.params)), self.params)

    @property
    def p1(self) -> DataFrame:
        p = self.params
        return period.p1_lines(self.fact((p.p1_start, p.p1_end)), p)

    @property
    def compared(self) -> DataFrame:
        """Both periods side by side per (sku, channel)."""
        return bridge.compare_periods(self.sales_period)

    @property
    def pvm_lines(self) -> DataFrame:
        return bridge.pvm_lines(self.compared)

    @property
    def pareto_sku(self) -> DataFrame:
        return pareto.pareto_sku(self.p1, self.skus("product_name", "category", "subcategory"), self.params)

    @property
    def pareto_reseller(self) -> DataFrame:
        return pareto.pareto_reseller(self.p1, self.dim_reseller, self.params)

    def skus(self, *attributes: str) -> DataFrame:
        """The sku dimension with only the named attributes."""
        return model.dim_sku(self.dim_product, attributes)

    @property
    def dims(self) -> dict[str, DataFrame]:
        return {
            "date": self.dim_date,
            "product": self.dim_product,
            "sku": self.dim_sku,
            "territory": self.dim_territory,
            "geography": self.dim_geography,
            "customer": self.dim_customer,
            "reseller": self.dim_reseller,
            "promotion": self.dim_promotion,
            "channel": self.dim_channel,
        }

    @property
    def promotion_names(self) -> discounts.Promotions:
        """What names the promotions of lines."""
        return self.dim_promotion

    @cached_property
    def dim_sku(self) -> DataFrame:
        return model.dim_sku(self.dim_product)

    @cached_property
    def dim_channel(self) -> DataFrame:
        return model.dim_channel(self.spark, self.params)


class FileModel(SalesModel):
    """Model over the twelve delimited source files."""

    def __init__(self, spark: SparkSession, staging: dict[str, DataFrame], params: Params):
        self.spark, self.staging, self.params = spark, staging, params

    def control_totals(self) -> DataFrame:
        month = F.date_format("order_date", "yyyy-MM").alias("month")
        return self.staged_lines().groupBy(month).agg(F.count(F.lit(1)).alias("rows"), F.sum("net_sales").alias("net_sales"), F.sum("cogs").alias("cogs"))

    def staged_lines(self) -> DataFrame:
        return model.unified_lines(self.staging["FactResellerSales"], self.staging["FactInternetSales"], self.params)

    def fact(self, between: tuple[date, date] | None = None) -> DataFrame:
        return model.fact_sales(model.with_sku(self.staged_lines(), model.product_keys(self.staging["DimProduct"])))

    def bare_lines(self, between: tuple[date, date] | None = None) -> DataFrame:
        return model.identified(self.staged_lines())

    @cached_property
    def dim_date(self) -> DataFrame:
        return model.dim_date(self.staging["DimDate"])

    @cached_property
    def dim_product(self) -> DataFrame:
        return model.dim_product(
            self.staging["DimProduct"], self.staging["DimProductSubcategory"], self.staging["DimProductCategory"]
        )

    @cached_property
    def dim_territory(self) -> DataFrame:
        return model.dim_territory(self.staging["DimSalesTerritory"])

    @cached_property
    def dim_geography(self) -> DataFrame:
        return model.dim_geography(self.staging["DimGeography"])

    @cached_property
    def dim_customer(self) -> DataFrame:
        return model.dim_customer(self.staging["DimCustomer"], self.dim_geography)

    @cached_property
    def dim_reseller(self) -> DataFrame:
        return model.dim_reseller(self.staging["DimReseller"], self.dim_geography)

    @cached_property
    def dim_promotion(self) -> DataFrame:
        return model.dim_promotion(self.staging["DimPromotion"])

    def staging_tables(self) -> dict[str, DataFrame]:
        return dict(self.staging)


class OrderModel(SalesModel):
    """Model over the order-processing tables."""

    def __init__(self, spark: SparkSession, base: str, params: Params | None = None):
        self.spark = spark
        self.source = OrderTables(spark, base, params)
        self.params = self.source.params

    def control_totals(self) -> DataFrame:
        return self.source.control_totals()

    def source_totals(self, *names: str) -> DataFrame:
        # without cost, the lines alone are enough
        return super().source_totals(*names) if "cogs" in names else self.source.raw_totals().select(*names)

    def fact(self, between: tuple[date, date] | None = None) -> DataFrame:
        return model.fact_sales(self.source.sales_lines(between))

    def rebalanced_fact(self) -> DataFrame:
        return model.fact_sales(self.source.sales_lines(rebalanced=True))

    def bare_lines(self, between: tuple[date, date] | None = None) -> DataFrame:
        return model.identified(self.source.sales_lines(between, products=False))

    @cached_property
    def dim_date(self) -> DataFrame:
        return model.dim_date(self.source.dates())

    @cached_property
    def dim_product(self) -> DataFrame:
        return model.dim_product(self.source.products(), self.source.subcategories(), self.source.categories())

    @cached_property
    def dim_territory(self) -> DataFrame:
        return model.dim_territory(self.source.territories())

    @cached_property
    def dim_geography(self) -> DataFrame:
        return model.dim_geography(self.source.geographies())

    @cached_property
    def dim_customer(self) -> DataFrame:
        return model.dim_customer(self.source.customers(), self.dim_geography)

    @cached_property
    def dim_reseller(self) -> DataFrame:
        return model.dim_reseller(self.source.resellers(), self.dim_geography)

    @cached_property
    def dim_promotion(self) -> DataFrame:
        return model.dim_promotion(self.source.promotions())

    @property
    def promotion_names(self) -> discounts.Promotions:
        return self.source.name_promotions

    def staging_tables(self) -> dict[str, DataFrame]:
        s = self.source
        return {
            "products": s.products(),
            "subcategories": s.subcategories(),
            "categories": s.categories(),
            "dates": s.dates(),
            "resellers": s.resellers(),
            "customers": s.customers(),
            "geographies": s.geographies(),
            "territories": s.territories(),
            "promotions": s.promotions(),
            "sales_lines": s.sales_lines(),
        }

"""Round trips through files: tables of a model are written to the shared folder and read back by the library's own scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlens.functions.staged import shared_dir
from marginlens.operators import model
from marginlens.plans.model import FileModel, OrderModel, SalesModel
from marginlens.sources import exports
from marginlens.sources.delimited import staging, unambiguous
from marginlens.sources.schemas import FILES, layout


def _fresh_folder(m: SalesModel, label: str) -> str:
    return f"{shared_dir(m.spark)}/marginlens/{m.spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _in_layout(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns of a source file; what it lacks is NULL."""
    columns = []
    for field in layout(name):
        value = (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType)
        columns.append((unambiguous(value, field.name) if field.dataType.simpleString() == "string" else value).alias(field.name))
    return df.select(*columns)


def _channel_file(lines: DataFrame, channel: str, party_column: str, party: str) -> DataFrame:
    names = {
        "order_number": "SalesOrderNumber", "order_line": "SalesOrderLineNumber", "product_key": "ProductKey",
        "territory_key": "SalesTerritoryKey", "promotion_key": "PromotionKey", "order_date": "OrderDate", party_column: party,
    }
    return lines.filter(F.col("channel") == channel).withColumnsRenamed({**names, **model.LINE_MEASURES})


SALES_FILES = ("FactResellerSales", "FactInternetSales", "DimProduct")
PRODUCT_FILES = ("DimProduct", "DimProductSubcategory", "DimProductCategory")
CUSTOMER_FILES = ("DimCustomer", "DimGeography")
RESELLER_FILES = ("DimReseller", "DimGeography")


def delimited_copy(m: OrderModel, names: tuple[str, ...] = FILES) -> FileModel:
    """The same sales as delimited source files (all, or the named ones), scanned with their declared layouts."""
    lines, source, p = m.source.sales_lines(), m.source, m.params
    frames = {
        "FactResellerSales": _channel_file(lines, p.b2b, "reseller_key", "ResellerKey"),
        "FactInternetSales": _channel_file(lines, p.b2c, "customer_key", "CustomerKey"),
        "DimDate": source.dates(),
        "DimReseller": source.resellers(),
        "DimCustomer": source.customers(),
        "DimGeography": source.geographies(),
        "DimSalesTerritory": source.territories(),
        "DimPromotion": source.promotions(),
        "DimCurrency": source.table("region").select(F.col("r_regionkey").alias("CurrencyKey"), F.col("r_name").alias("CurrencyName")),
    }
    # the product files number their paths by a dictionary of its own, which is made only if they are asked for
    numbered = {"DimProduct": source.products, "DimProductSubcategory": source.subcategories, "DimProductCategory": source.categories}
    frames |= {name: numbered[name]() for name in names if name in numbered}
    folder = _fresh_folder(m, "raw")
    for name in names:
        writer = _in_layout(frames[name], name).write.option("sep", "|").option("quote", "").option("nullValue", "").option("emptyValue", "")
        writer.option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/{name}.csv")
    return FileModel(m.spark, staging(m.spark, folder, names), p)


def export_reconcile(m: SalesModel) -> DataFrame:
    """Export the fact as CSV, read it back and compare counts and sums with the model."""
    folder = _fresh_folder(m, "export")
    exports.write_csv(m.fact(), f"{folder}/fact_sales")
    return exports.reconcile_export(exports.read_back_csv(m.spark, f"{folder}/fact_sales"), m.fact())


def csv_round_trip(m: SalesModel, name: str, table: DataFrame) -> DataFrame:
    """Export one table as CSV and read it back."""
    folder = f"{_fresh_folder(m, 'export')}/{name}"
    exports.write_csv(table, folder)
    return exports.read_back_csv(m.spark, folder)


def json_round_trip(m: SalesModel, name: str, result: DataFrame) -> DataFrame:
    """Write one result as JSON lines and read it back."""
    folder = _fresh_folder(m, "results")
    exports.write_results({name: result}, folder)
    return exports.read_results(m.spark, folder, name)

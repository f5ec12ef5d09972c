"""Sinks: the star model and analysis tables as CSV, report results as JSON, and reading an export back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from marginlens.functions.exprs import money
from marginlens.functions.textfile import read_text, write_text

# The tables and pre-aggregated figures that an export consists of.
TABLES = (
    "dim_date", "dim_product", "dim_sku", "dim_territory", "dim_customer", "dim_reseller", "dim_promotion", "dim_channel",
    "fact_sales", "pvm_lines", "pareto_sku", "pareto_reseller",
)
AGGREGATES = ("kpi_monthly", "pvm_bridge", "kpi_by_calendar_year")


#: Name of the schema file in the folder of an export; Spark's readers pass over names with an underscore.
SCHEMA_FILE = "_schema.json"
_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# How text is written. No field holds a line break, so a file can be read in parts; NULL is an empty field.
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"))
EMPTY_TEXT = "\\e"


def _is_text(field: StructField) -> bool:
    return isinstance(field.dataType, StringType)


def _escaped(name: str) -> Column:
    text = F.col(name)
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return F.when(text == "", EMPTY_TEXT).otherwise(text).alias(name)


def _unescaped(name: str) -> Column:
    """Doubled backslashes are set apart first, so that what follows one is not taken for an escape."""

    def plain(part: Column) -> Column:
        for text, written in ESCAPES[1:]:
            part = F.replace(part, F.lit(written), F.lit(text))
        return part

    parts = F.split(F.col(name), r"\\\\", -1)
    text = F.array_join(F.transform(parts, plain), "\\")
    return F.when(F.col(name) == EMPTY_TEXT, "").otherwise(text).alias(name)


def write_csv(df: DataFrame, path: str) -> int:
    """Write ``df`` as CSV files with a header and return its row count, measured during the same pass.

    Backslashes and line breaks in text are escaped (``ESCAPES``), an empty text is ``EMPTY_TEXT`` and NULL an empty field. The
    schema is written next to the data, last.
    """
    seen = Observation("written")
    columns = [_escaped(f.name) if _is_text(f) else F.col(f.name) for f in df.schema]
    written = df.observe(seen, F.count(F.lit(1)).alias("rows")).select(*columns)
    written.write.mode("overwrite").options(**_CSV).csv(path)
    write_text(df.sparkSession, f"{path}/{SCHEMA_FILE}", df.schema.json())
    return seen.get["rows"]


def export_tables(tables: dict[str, DataFrame], out_dir: str) -> dict[str, int]:
    """Export every table into its own folder; returns rows per table. A missing table raises before anything is written."""
    missing = [name for name in TABLES if name not in tables]
    if missing:
        raise KeyError(f"tables to export are missing: {missing}")
    return {name: write_csv(tables[name], f"{out_dir}/{name}") for name in TABLES}


def export_aggregates(results: dict[str, DataFrame], out_dir: str) -> dict[str, int]:
    """Export the small pre-aggregated tables, one file each (they have a row per month, step or year)."""
    return {name: write_csv(results[name].coalesce(1), f"{out_dir}/{name}") for name in AGGREGATES}


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL, since JSON has no NaN."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floating else F.col(c) for c in df.columns])


def write_results(results: dict[str, DataFrame], out_dir: str) -> None:
    """Every result as JSON lines ``{"result": name, "row": {...}}``, one folder per result under ``out_dir``.

    NULL fields are written as null and dates in ISO form. Rows go straight from the executors to the files; the schema of the
    rows lies next to them.
    """
    for name, df in results.items():
        row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        line = F.concat(F.lit(f'{{"result":"{name}","row":'), row, F.lit("}"))
        folder = f"{out_dir.rstrip('/')}/result={name}"
        without_nan(df).select(line.alias("value")).write.mode("overwrite").text(folder)
        write_text(df.sparkSession, f"{folder}/{SCHEMA_FILE}", df.schema.json())


def read_results(spark: SparkSession, out_dir: str, result: str) -> DataFrame:
    """One result of ``write_results`` as it was; reads only that result's folder, once."""
    folder = f"{out_dir.rstrip('/')}/result={result}"
    row = StructType.fromJson(json.loads(read_text(spark, f"{folder}/{SCHEMA_FILE}")))
    lines = StructType([StructField("result", StringType()), StructField("row", row)])
    return spark.read.schema(lines).option("mode", "FAILFAST").json(folder).select("row.*")


def read_back_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported table as it was: the schema comes from its file, text is unescaped, and large files are read in parts.

    A field that does not fit the schema fails the job.
    """
    schema = StructType.fromJson(json.loads(read_text(spark, f"{path}/{SCHEMA_FILE}")))
    read = spark.read.schema(schema).options(**_CSV, mode="FAILFAST", enforceSchema="false").csv(path)
    return read.select(*[_unescaped(f.name) if _is_text(f) else F.col(f.name) for f in schema])


def reconcile_export(exported: DataFrame, fact: DataFrame) -> DataFrame:
    """Row count and money sums of both sides in one row per side."""

    def side(name: str, df: DataFrame) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(money("net_sales")).cast("double").alias("net_sales"),
            F.sum(money("cogs")).cast("double").alias("cogs"),
        ).select(F.lit(name).alias("side"), "rows", "net_sales", "cogs")

    return side("export", exported).unionByName(side("model", fact))

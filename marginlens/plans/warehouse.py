"""A stored sales model: the star tables and the derived analysis tables as Parquet, in numbered snapshots.

Building is the expensive part (source joins, one pass to write the fact). Queries then read few columns and, for the
comparison windows, few month folders of the stored fact. Building again or adding months writes new folders and then one
manifest; whoever reads meanwhile, or after a build that broke off, sees the snapshot before it.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marginlens.functions.staged import freed_shuffles
from marginlens.operators import bridge, pareto, quality
from marginlens.operators.model import FACT_COLUMNS
from marginlens.operators.period import MONTH_PARTITION
from marginlens.params import Params
from marginlens.plans import catalog
from marginlens.plans.model import SalesModel, summed_control
from marginlens.plans.snapshots import FACT, MONTH_FOLDER, MONTHLY, Manifest, SnapshotStore, month_folder, table_folder
from marginlens.sources import exports

DIMENSIONS = ("date", "product", "sku", "territory", "geography", "customer", "reseller", "promotion", "channel")
REPORTS = (
    "info_period_coverage", "kpi_matrix", "growth", "pvm_bridge", "pvm_by_channel", "pvm_by_category",
    "pvm_top_cost_increases", "categories_p1", "kpi_by_subcategory", "kpi_by_territory", "kpi_by_reseller_type",
    "kpi_by_calendar_year", "price_structure_labelled", "abc_sku_summary", "abc_reseller_summary", "pareto_peak",
    "worst_skus", "loss_making_summary", "loss_by_category", "loss_top8", "disc_summary", "disc_by_promotion",
    "disc_depth_buckets", "disc_turning_lines_negative", "new_product_promos", "already_below_cost", "segment", "price_grid",
    "price_sensitivity", "break_even_elasticity", "stop_selling", "break_even_variable_share",
    "discount_rule_no_discount_below_cost", "discount_rule_cap", "internet_plus10_margin", "pricing_vs_cost", "period_labels",
)


#: What the source had in a month, counted before the model's joins.
CONTROL = ("rows", "net_sales", "cogs")
#: Small tables that are written at the same time.
WRITERS = 8
#: Of the stored tables: it takes about half the disk that Spark's default takes, as order numbers and line ids are sorted.
CODEC = "zstd"
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


class Warehouse(SalesModel):
    """Open with ``Warehouse(spark, path, params)`` or create with ``Warehouse.build``."""

    def __init__(
        self, spark: SparkSession, path: str, params: Params, source: SalesModel | None = None, manifest: Manifest | None = None
    ):
        self.spark, self.path, self.params, self.source = spark, path.rstrip("/"), params, source
        self.manifest = manifest or SnapshotStore(spark, path).read()
        self._tables: dict[str, DataFrame] = {}
        for name in DIMENSIONS:
            setattr(self, f"dim_{name}", self.table(f"dim_{name}"))

    @classmethod
    def build(cls, source: SalesModel, path: str) -> "Warehouse":
        """Write fact, dimensions and derived tables of ``source`` as the next snapshot under ``path``."""
        return cls._write(source, path, {}, {})

    @classmethod
    def add_months(cls, source: SalesModel, path: str) -> "Warehouse":
        """The next snapshot, in which the months that ``source`` has lines of are its lines and the other months stay.

        Only those months of the fact are written. Dimensions are taken from ``source``, whole; the derived tables are computed
        again, from the two comparison windows of the stored fact.
        """
        current = SnapshotStore(source.spark, path).read()
        return cls._write(source, path, current.months, current.control)

    @classmethod
    def _write(cls, source: SalesModel, path: str, months: dict[str, int], control: dict[str, dict[str, str]]) -> "Warehouse":
        """The fact is partitioned by month. Its rows are rebalanced on the month first, which gives every month a few
        right-sized files and splits months that are larger than the advisory partition size.
        """
        with freed_shuffles(source.spark):
            return cls._write_tables(source, path.rstrip("/"), months, control)

    @classmethod
    def _write_tables(cls, source: SalesModel, path: str, months: dict[str, int], control: dict[str, dict[str, str]]) -> "Warehouse":
        store = SnapshotStore(source.spark, path)
        number = store.next_number()
        manifest = Manifest(number)

        def write(name: str, df: DataFrame, *partitions: str) -> None:
            manifest.tables[name] = table_folder(name, number)
            manifest.schemas[name] = df.drop(*partitions).schema.json()
            df.write.mode("errorifexists").option("compression", CODEC).partitionBy(*partitions).parquet(f"{path}/{manifest.tables[name]}")

        def write_all(tables: dict[str, DataFrame], *partitions: str) -> None:
            """Small tables side by side: a job of few tasks leaves most of a cluster idle."""
            with ThreadPoolExecutor(WRITERS) as pool:
                for done in [pool.submit(write, name, df, *partitions) for name, df in tables.items()]:
                    done.result()

        counted = {r["month"] or NO_MONTH: {n: str(r[n] or 0) for n in CONTROL} for r in source.control_totals().collect()}
        lines = source.rebalanced_fact().withColumn(MONTH_PARTITION, F.date_format("order_date", "yyyy-MM"))
        write(FACT, lines, MONTH_PARTITION)
        written = [n.removeprefix(MONTH_FOLDER) for n in store.folders(*table_folder(FACT, number).split("/")) if n.startswith(MONTH_FOLDER)]
        manifest.months = months | {month: number for month in written}
        manifest.control = control | counted
        month_lines = source.spark.read.schema(StructType([*lines.schema])).parquet(f"{path}/{manifest.tables[FACT]}")
        states = {
            "audit_rules": quality.rule_state(month_lines, source.params, MONTH_PARTITION),
            "audit_usage": quality.usage_state(month_lines, MONTH_PARTITION),
            "audit_grain": quality.grain_state(month_lines, MONTH_PARTITION),
        }
        write_all(states, MONTH_PARTITION)
        write_all({f"dim_{name}": dimension for name, dimension in source.dims.items()})
        stored = cls(source.spark, path, source.params, source, manifest)
        write("bridge_units", bridge.compare_periods(stored.sales_period))
        skus = stored.skus("product_name", "category", "subcategory")
        write_all({
            "pvm_lines": bridge.pvm_lines(stored.compared, staged=False),
            "pareto_sku": pareto.pareto_sku(stored.p1, skus, stored.params),
            "pareto_reseller": pareto.pareto_reseller(stored.p1, stored.dim_reseller, stored.params),
        })
        store.publish(manifest)
        return stored

    def table(self, name: str) -> DataFrame:
        """Scan of a stored table. The files are listed once per warehouse, not once per query."""
        if name not in self._tables:
            schema = StructType.fromJson(json.loads(self.manifest.schemas[name]))
            if name in MONTHLY:
                self._tables[name] = self._months(name, schema)
            else:
                self._tables[name] = self.spark.read.schema(schema).parquet(f"{self.path}/{self.manifest.tables[name]}")
        return self._tables[name]

    def _months(self, name: str, schema: StructType) -> DataFrame:
        """The month folders that the manifest names, of whichever snapshots wrote them."""
        folders = [f"{self.path}/{month_folder(name, month, number)}" for month, number in sorted(self.manifest.months.items())]
        with_month = StructType([*schema, StructField(MONTH_PARTITION, StringType())])
        if not folders:
            return self.spark.createDataFrame([], with_month)
        return self.spark.read.schema(with_month).option("basePath", f"{self.path}/tables/{name}").parquet(*folders)

    # ---- SalesModel

    def fact(self, between: tuple[date, date] | None = None) -> DataFrame:
        # Month folders stay visible so that the window filters can prune them; full reads drop the extra column.
        stored = self.table(FACT)
        return stored.select(*FACT_COLUMNS) if between is None else stored.select(*FACT_COLUMNS, MONTH_PARTITION)

    def control_totals(self) -> DataFrame:
        """Rows, net sales and cost of the source by month, as its lines were counted when they were written."""
        rows = [
            (None if month == NO_MONTH else month, int(c["rows"]), Decimal(c["net_sales"]), Decimal(c["cogs"]))
            for month, c in sorted(self.manifest.control.items())
        ]
        return self.spark.createDataFrame(rows, "month string, rows bigint, net_sales decimal(38,4), cogs decimal(38,4)")

    def source_totals(self, *names: str) -> DataFrame:
        return summed_control(self.control_totals(), *names)

    def grain(self) -> DataFrame:
        return quality.grain_over_months(self.table("audit_grain"), self.table(FACT), MONTH_PARTITION)

    def quality_report(self) -> DataFrame:
        """From the states of the months, which were counted when each was written."""
        return quality.report_from_states(
            self.table("audit_rules"), self.table("audit_usage"), self.grain(), self.source_totals("rows", "net_sales", "cogs"),
            self.dims, self.dim_product, self.params,
        )

    def staging_tables(self) -> dict[str, DataFrame]:
        if self.source is None:
            raise RuntimeError("staging tables belong to the source this warehouse was built from")
        return self.source.staging_tables()

    @property
    def compared(self) -> DataFrame:
        return self.table("bridge_units")

    @property
    def pvm_lines(self) -> DataFrame:
        return self.table("pvm_lines")

    @property
    def pareto_sku(self) -> DataFrame:
        return self.table("pareto_sku")

    @property
    def pareto_reseller(self) -> DataFrame:
        return self.table("pareto_reseller")

    def skus(self, *attributes: str) -> DataFrame:
        return self.dim_sku.select("sku", *attributes)

    # ---- queries

    def query(self, name: str) -> DataFrame:
        return catalog.query(self, name)

    def checks(self) -> DataFrame:
        return self.query("quality_report")

    def gate(self, ignore: tuple[str, ...] = ()) -> DataFrame:
        return quality.quality_gate(self.checks(), self.params, ignore)

    def export(self, out_dir: str) -> dict[str, int]:
        """All tables and the pre-aggregated figures as CSV; returns rows per table."""
        tables = {f"dim_{name}": self.dims[name] for name in DIMENSIONS}
        tables |= {"fact_sales": self.fact(), "pvm_lines": self.pvm_lines}
        tables |= {"pareto_sku": self.pareto_sku, "pareto_reseller": self.pareto_reseller}
        counts = exports.export_tables(tables, out_dir)
        exports.export_aggregates({name: self.query(name) for name in exports.AGGREGATES}, out_dir)
        return counts

    def write_results(self, out_dir: str) -> None:
        """Every report table as one JSON-lines dataset."""
        exports.write_results({name: self.query(name) for name in REPORTS}, out_dir)


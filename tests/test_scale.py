"""Properties of the plans that decide whether a query survives large and skewed data."""

from __future__ import annotations

import time
from contextlib import contextmanager
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marginlens.functions.staged import freed_shuffles, shared_dir, stage
from marginlens.operators import quality
from marginlens.plans.catalog import CATALOG, as_doubles
from marginlens.plans.model import OrderModel
from marginlens.plans.warehouse import Warehouse
from tests.conftest import TESTDATA

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Windows over all rows are allowed only where the rows are report rows: effects per channel or category, bridge steps,
# and the one-row-per-range offsets of a ranking.
REPORT_ROW_WINDOWS = {
    "pvm_by_channel", "pvm_by_category", "waterfall_steps", "waterfall_steps_by_channel", "pareto_sku", "pareto_reseller",
    "abc_sku_summary", "abc_reseller_summary", "pareto_peak", "pareto_argmax", "abc_points_by_class", "pareto_audit_sku",
    "pareto_audit_reseller", "note_lookups",
}


@pytest.mark.parametrize("name", CATALOG)
def test_no_nested_loops_and_no_window_over_everything(spark, small, name):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__autoBroadcastJoinThreshold=-1):
        plan = plan_of(CATALOG[name](small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line and any("Exchange SinglePartition" in below for below in lines[i + 1 : i + 4]):
            assert name.removeprefix("stored_") in REPORT_ROW_WINDOWS, line


def test_window_bounds_reach_the_orders_scan(small):
    plan = plan_of(CATALOG["disc_summary"](small))
    orders = next(line for line in plan.splitlines() if "FileScan" in line and "o_orderdate" in line)
    assert "GreaterThanOrEqual(o_orderdate,2000-08-01" in orders and "LessThan(o_orderdate,2001-08-01" in orders


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Driver tables in which one part has 40 % of the lines and one customer 40 % of the orders."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    for table in TABLES:
        df = spark.read.parquet(f"{TESTDATA}/sf0.01/{table}.parquet")
        if table == "lineitem":
            df = df.withColumn("l_partkey", F.when(F.col("l_orderkey") % 5 < 2, 7).otherwise(F.col("l_partkey")).cast("bigint"))
        if table == "orders":
            df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 < 2, 3).otherwise(F.col("o_custkey")).cast("bigint"))
        # several files per table: a hot key is split along the map tasks that produced its rows
        df.repartition(8).write.parquet(f"{folder}/{table}.parquet")
    return folder


SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": -1,
    "spark__sql__adaptive__autoBroadcastJoinThreshold": -1,
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": 2,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "2KB",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "4KB",
}


@pytest.mark.parametrize("name", ["pvm_bridge", "kpi_summary", "pareto_sku", "pareto_reseller", "disc_turning_lines_negative", "kpi_by_category"])
def test_hot_keys_change_no_result(spark, skewed, name):
    plain = as_doubles(CATALOG[name](OrderModel(spark, skewed))).toPandas()
    with settings(spark, **SKEW):
        split = as_doubles(CATALOG[name](OrderModel(spark, skewed))).toPandas()
    order = list(plain.columns)
    plain, split = (df.sort_values(order).reset_index(drop=True) for df in (plain, split))
    assert plain.equals(split)


def test_a_hot_part_and_a_hot_customer_are_split(spark, skewed):
    with settings(spark, **SKEW):
        lines = OrderModel(spark, skewed).fact().groupBy("channel").agg(F.sum("net_sales"), F.max("sku"))
        lines.collect()
        plan = plan_of(lines)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    split = [line for line in joins if "skew=true" in line]
    assert any("l_partkey" in line for line in split), joins
    assert any("o_custkey" in line for line in split), joins


def test_hot_sku_collapses_before_the_shuffle(small):
    """Partial aggregation sits below the first exchange on the sku, so a hot sku sends one row per task."""
    plan = plan_of(CATALOG["pvm_bridge"](small)).splitlines()
    exchange = next(i for i, line in enumerate(plan) if "hashpartitioning(sku" in line)
    assert "partial_sum" in plan[exchange + 1]


def test_order_lines_are_read_once_per_bridge(small):
    for name in ("pvm_bridge", "pvm_by_channel", "pricing_vs_cost", "pvm_top_cost_increases"):
        plan = plan_of(CATALOG[name](small))
        assert len([line for line in plan.splitlines() if "FileScan" in line and "l_quantity" in line]) == 1, name


def scans(df, table):
    return [line for line in plan_of(df).splitlines() if "FileScan" in line and f"/{table}.parquet" in line]


def test_key_figures_are_one_pass_over_the_lines(small):
    for name in ("kpi_summary", "growth", "channel_evolution", "internet_plus10_margin", "b2b_share_of_sales", "kpi_matrix",
                 "disc_by_promotion", "new_product_promos", "promo_top6"):
        assert len(scans(CATALOG[name](small), "lineitem")) == 1, name


def test_what_needs_no_product_does_not_join_products(small):
    for name in ("dim_channel", "chk_channel_keys", "info_period_coverage", "period_month_coverage", "months_missing_a_channel",
                 "channel_discount_total", "last_order_of_channel", "period_labels"):
        assert not scans(CATALOG[name](small), "part"), name


def test_reported_months_reach_the_orders_scan(small):
    for name in ("monthly_window", "worst_month"):
        lines = [line for line in scans(CATALOG[name](small), "orders") if "o_custkey" in line]
        assert lines and all("GreaterThanOrEqual(o_orderdate,1998-01-01" in s and "LessThan(o_orderdate,2001-08-01" in s for s in lines)


def test_an_order_in_two_channels_counts_once_in_the_total(spark):
    from marginlens.operators import kpi

    rows = [("P0", "a", "o1", 1), ("P0", "b", "o1", 2), ("P0", "a", "o2", 3), ("P0", None, "o2", 4), ("P0", "b", None, 5), ("P0", "b", None, 6), (None, "a", "o3", 7)]
    lines = spark.createDataFrame(rows, "period string, channel string, order_number string, quantity int")
    money = ("net_sales", "cogs", "gross_margin", "gross_amount", "discount_amount")
    lines = lines.withColumns({m: F.col("quantity").cast("decimal(19,4)") for m in money} | {"is_below_cost": F.lit(False)})
    found = {(r["channel"], r["is_total"]): (r["orders"], r["lines"], r["units"]) for r in kpi.kpi_summary(lines).collect()}
    assert found == {(None, True): (2, 6, 21), ("a", False): (2, 2, 4), ("b", False): (1, 3, 13), (None, False): (1, 1, 4)}
    amounts = {(r["channel"], r["is_total"]): (r["lines"], r["units"]) for r in kpi.kpi_amounts(lines).collect()}
    assert amounts == {k: v[1:] for k, v in found.items()}


def test_staged_tables_go_to_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(3), "probe")
    assert staged.inputFiles()[0].startswith("file://" + shared_dir(spark)) and staged.count() == 3


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_the_fact_is_spread_by_month_before_its_columns_are_computed(small):
    spread = small.rebalanced_fact()
    below = spread._jdf.queryExecution().optimizedPlan().toString().split("RebalancePartitions", 1)[1]
    assert not [c for c in ("sales_line_id", "discount_amount", "gross_margin", "unit_cogs") if c in below]
    assert spread.exceptAll(small.fact()).isEmpty() and spread.count() == small.fact().count()


def test_lines_are_sorted_by_month_and_order_before_their_columns_are_computed(small):
    plan = small.rebalanced_fact()._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [date_format" in plan
    below = plan.split("Sort [date_format", 1)[1]
    assert not [c for c in ("sales_line_id", "discount_amount", "gross_margin", "unit_cogs") if c in below]


def test_stored_lines_lie_by_order_and_are_compressed(small, tmp_path):
    Warehouse.build(small, str(tmp_path / "store"))
    files = [pq.ParquetFile(p) for p in Path(tmp_path, "store", "tables", "fact_sales").rglob("*.parquet")]
    for file in files:
        table = file.read(["order_number", "order_line"]).to_pydict()
        lines = [(int(o.removeprefix("SO")), n) for o, n in zip(table["order_number"], table["order_line"], strict=True)]
        assert lines == sorted(lines)
        assert {file.metadata.row_group(0).column(i).compression for i in range(file.metadata.num_columns)} == {"ZSTD"}
    assert sum(file.metadata.num_rows for file in files) == small.source.table("lineitem").count()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while files.hasNext():
        names.add(files.next().getName())
    return {name for name in names if name.startswith("shuffle_")}


def test_shuffle_files_go_when_their_query_ends(spark, tmp_path):
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    rows = spark.range(1000).repartition(4, "id")
    with freed_shuffles(spark):
        rows.write.parquet(f"{tmp_path}/freed")
    for _ in range(50):  # files are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.read.parquet(f"{tmp_path}/freed").count() == 1000
    assert spark.conf.get(setting, None) == was
    with pytest.raises(ValueError), freed_shuffles(spark):
        raise ValueError
    assert spark.conf.get(setting, None) == was


def test_a_build_frees_its_shuffles(spark, small, tmp_path, monkeypatch):
    seen = []
    totals = small.control_totals
    monkeypatch.setattr(small, "control_totals", lambda: seen.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) or totals())
    Warehouse.build(small, str(tmp_path / "store"))
    assert seen == ["true"]


def test_control_totals_shuffle_lines_by_order_and_by_part_only(spark, small):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__autoBroadcastJoinThreshold=-1):
        plan = plan_of(small.control_totals())
    of_lines = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_" in line]
    assert len(of_lines) == 2 and all(line.split("hashpartitioning(")[1].count("#") == 1 for line in of_lines), of_lines


def test_control_totals_price_each_line_by_one_row_per_key(spark, tmp_path):
    """Orders and parts that come twice, lines without an order, part, number or day: one look-up a line, and no line is lost."""
    day = F.to_timestamp_ntz(F.col("o_orderdate"))
    orders = [(1, "1995-03-31 10:00:00"), (1, "1996-01-01 00:00:00"), (2, "1996-01-31 23:59:59"), (3, None), (None, "1996-01-05 00:00:00")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate string").withColumn("o_orderdate", day).write.parquet(f"{tmp_path}/orders.parquet")
    parts = [(1, 10.0), (1, 8.0), (2, 1.2345), (3, None)]
    spark.createDataFrame(parts, "p_partkey bigint, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [
        (1, 1, 2.0, 100.0, 0.1), (1, 2, 3.0, 50.0, 0.0), (2, 2, 10.0, 12.3456, 0.05), (2, 9, 1.0, 5.0, 0.0), (9, 1, 1.0, 7.0, 0.0),
        (3, 1, 1.0, 9.0, 0.0), (None, None, None, None, None), (2, 3, 4.0, None, 0.0),
    ]
    schema = "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["month"]: (r["rows"], *(None if r[c] is None else float(r[c]) for c in ("net_sales", "cogs"))) for r in OrderModel(spark, str(tmp_path)).control_totals().collect()}
    # net: 90 + 50; cost: 2 * 8 + 3 * 1.2345 in the first year, 10 * 1.2345 * 1.05 (1.2962) in the second
    assert found == {"1995-03": (2, 140.0, 19.7035), "1996-01": (3, 16.7283, 12.962), None: (3, 16.0, None)}


def test_lines_are_not_shuffled_when_no_order_is_in_two_months(spark):
    lines = spark.range(5000).selectExpr("concat('SO', id div 4) AS order_number", "concat('a|SO', id div 4, '|', id) AS sales_line_id", "concat('m', (id div 4) % 3) AS month")
    lines = stage(lines, "lines-of-one-month")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="8KB", spark__sql__adaptive__autoBroadcastJoinThreshold="8KB"):
        found = quality.grain_over_months(quality.grain_state(lines, "month"), lines, "month")
        plan = plan_of(found)
    assert "BroadcastHashJoin [order_number" in plan and "SortMergeJoin" not in plan
    assert found.first()["violations"] == 0

from __future__ import annotations

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginlens.operators import quality
from marginlens.operators.quality import QualityError
from marginlens.plans.catalog import CATALOG, as_doubles
from marginlens.plans.model import OrderModel
from marginlens.plans.snapshots import MONTHLY, Manifest, SnapshotStore
from marginlens.plans.warehouse import REPORTS, Warehouse
from marginlens.sources import exports
from tests.fixtures import one, rows_of


@pytest.fixture(scope="module")
def store(small, tmp_path_factory):
    return Warehouse.build(small, str(tmp_path_factory.mktemp("store")))


@pytest.fixture(scope="module")
def exported(store, tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    return folder, store.export(str(folder))


def sorted_rows(df):
    ordered = as_doubles(df.select(*sorted(df.columns)))
    return sorted(map(tuple, ordered.collect()), key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize(
    "name",
    ["fact_sales", "sales_period", "dim_sku", "kpi_summary", "kpi_monthly", "kpi_price_structure", "pvm_lines", "pvm_bridge",
     "pvm_by_category", "pareto_sku", "pareto_reseller", "abc_sku_summary", "loss_making_sku_channel", "disc_by_promotion",
     "disc_lines_p1", "discount_rule_cap", "pricing_vs_cost", "quality_report"],
)
def test_stored_model_answers_like_the_lazy_one(store, small, name):
    assert sorted_rows(store.query(name)) == sorted_rows(CATALOG[name](small))


def test_window_queries_read_only_their_months(store):
    plan = store.p1.groupBy("channel").count()._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    partition_filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "order_month" in partition_filters and "2000-08" in partition_filters and "2001-07" in partition_filters
    assert "order_date" in scan.split("PushedFilters: [")[1].split("]")[0]


def test_scans_read_only_the_columns_in_use(store):
    plan = store.query("info_period_coverage")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {field.split(":")[0] for field in schema.split(",")} == {"channel", "order_date"}


def test_gate(store, small):
    # the driver tables repeat (order, line) pairs and some skus change category, which two rules report by design
    known = ("chk_fact_grain_unique", "chk_sku_has_unique_category")
    failing = {r["check"] for r in rows_of(store.checks().filter(F.col("violations") > small.params.gate_tolerance))}
    assert failing <= set(known)
    store.gate(ignore=known)
    with pytest.raises(QualityError):
        store.gate(ignore=("chk_fact_grain_unique",)) if "chk_sku_has_unique_category" in failing else store.gate()


def test_views_answer_sql(spark, store):
    names = store.create_views("w_")
    assert {"w_fact_sales", "w_sales_period", "w_pvm_lines", "w_pareto_sku", "w_pareto_reseller", "w_dim_sku"} <= set(names)
    worst = spark.sql("SELECT sku FROM w_pareto_sku JOIN w_dim_sku USING (sku) WHERE gross_margin < 0 ORDER BY gross_margin, sku")
    expected = store.pareto_sku.filter("gross_margin < 0").orderBy("gross_margin", "sku").select("sku")
    assert worst.collect() == expected.collect()
    assert spark.sql("SELECT count(*) FROM w_sales_period WHERE period = 'P1'").first()[0] == store.p1.count()


def test_a_reopened_warehouse_reconciles_without_its_source(spark, store, small):
    reopened = Warehouse(spark, store.path, store.params)
    assert one(reopened.query("product_version_count")) == one(store.query("product_version_count"))
    for rule in ("chk_fact_rows_equal_staging", "chk_net_sales_reconcile_staging", "chk_cogs_reconcile_staging"):
        assert reopened.query(rule).first()["violations"] == 0
    assert sorted_rows(reopened.query("quality_report")) == sorted_rows(CATALOG["quality_report"](small))
    lost = quality.reconciles(reopened.fact().filter("order_line <> 1"), reopened.source_totals("cogs"), "cogs")
    assert lost.first()["violations"] > 0
    with pytest.raises(RuntimeError, match="source"):
        reopened.query("staging_row_counts")


class Broken(OrderModel):
    """A source whose second dimension can't be computed."""

    @property
    def dims(self):
        return {**super().dims, "product": super().dim_product.select(F.raise_error(F.lit("lost")).alias("product_key"))}


def stored_files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_build_that_breaks_off_leaves_the_snapshot_before_it(spark, small, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        Warehouse(spark, path, small.params)
    first = Warehouse.build(small, path)
    expected, files = sorted_rows(first.query("kpi_summary")), stored_files(path)
    with pytest.raises(Exception, match="lost"):
        Warehouse.build(Broken(spark, small.source.base), path)
    after = Warehouse(spark, path, small.params)
    assert after.manifest == first.manifest and sorted_rows(after.query("kpi_summary")) == expected
    assert stored_files(path).items() >= files.items()
    second = Warehouse.build(small, path)
    assert second.manifest.number > first.manifest.number + 1  # the broken build's folders are not written to again
    assert sorted_rows(first.query("kpi_summary")) == sorted_rows(second.query("kpi_summary")) == expected
    SnapshotStore(spark, path).prune()
    assert sorted_rows(Warehouse(spark, path, small.params).query("kpi_summary")) == expected
    assert {p.parent.name for p in Path(path, "tables", "dim_sku").glob("*/*.parquet")} == {f"snapshot={second.manifest.number}"}


def test_two_writers_of_one_number_do_not_overwrite_each_other(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.publish(Manifest(1, tables={"t": "tables/t/snapshot=1"}))
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish(Manifest(1, tables={"t": "elsewhere"}))
    assert store.read().tables == {"t": "tables/t/snapshot=1"}


def test_adding_a_month_writes_that_month_only(spark, small, tmp_path):
    path, month = str(tmp_path / "store"), "2000-10"
    for name in ("region", "nation", "customer", "part", "lineitem", "orders"):
        table = spark.read.parquet(f"{small.source.base}/{name}.parquet")
        if name == "orders":
            table = table.filter(F.date_format("o_orderdate", "yyyy-MM") == month)
        elif name == "lineitem":
            of_month = small.source.table("orders").filter(F.date_format("o_orderdate", "yyyy-MM") == month).select("o_orderkey")
            # half of the month's lines, as a correction would have it
            table = table.join(of_month, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").filter("l_linenumber % 2 = 1")
        table.write.parquet(f"{tmp_path}/month/{name}.parquet")
    first = Warehouse.build(small, path)
    before = {table: stored_files(f"{path}/tables/{table}") for table in MONTHLY}
    second = Warehouse.add_months(OrderModel(spark, f"{tmp_path}/month"), path)
    for table, files in before.items():
        after = stored_files(f"{path}/tables/{table}")
        added = after.keys() - files.keys()
        assert added and all(p.parent.name == f"order_month={month}" for p in added), table
        assert {p: t for p, t in after.items() if p in files} == files
    in_month = F.date_format("order_date", "yyyy-MM") == month
    expected = first.fact().filter(~in_month | (F.col("order_line") % 2 == 1))
    reopened = Warehouse(spark, path, small.params)
    assert reopened.fact().exceptAll(expected).count() == 0 and expected.exceptAll(reopened.fact()).count() == 0
    assert second.manifest.months[month] == second.manifest.number and set(second.manifest.months.values()) == {1, 2}
    for rule in ("chk_fact_rows_equal_staging", "chk_net_sales_reconcile_staging", "chk_cogs_reconcile_staging"):
        assert reopened.query(rule).first()["violations"] == 0
    m, totals = reopened, reopened.source_totals("rows", "net_sales", "cogs")
    assert sorted_rows(m.quality_report()) == sorted_rows(quality.quality_report(m.fact(), totals, m.dims, m.dim_product, m.params))
    lines = expected.count()
    SnapshotStore(spark, path).prune()
    assert reopened.fact().count() == lines
    assert not list(Path(path, "tables", "fact_sales").glob(f"snapshot=1/order_month={month}/*.parquet"))


def test_export_counts_and_files(spark, store, exported):
    folder, counts = exported
    assert set(counts) == set(exports.TABLES)
    assert counts["fact_sales"] == store.fact().count() and counts["dim_sku"] == store.dim_sku.count()
    for name in (*exports.TABLES, *exports.AGGREGATES):
        assert list(Path(folder, name).glob("*.csv")), name
    back = {name: exports.read_back_csv(spark, f"{folder}/{name}") for name in (*exports.TABLES, *exports.AGGREGATES)}
    assert quality.personal_columns(back) == []
    for name, table in back.items():
        stored = store.query(name) if name in exports.AGGREGATES else store.fact() if name == "fact_sales" else store.table(name)
        assert table.dtypes == stored.dtypes and sorted_rows(table) == sorted_rows(stored), name
    assert not Path(folder, "dim_geography").exists()


def test_exported_fact_reconciles(spark, store, exported):
    folder, _ = exported
    sides = {r.pop("side"): r for r in rows_of(exports.reconcile_export(exports.read_back_csv(spark, f"{folder}/fact_sales"), store.fact()))}
    assert sides["export"] == sides["model"] and sides["model"]["rows"] > 0


def test_exported_text_survives(spark, tmp_path):
    rows = [("a,b", 'c "d"', None), ("x|y", "line", "é")]
    frame = spark.createDataFrame(rows, "p string, q string, r string")
    assert exports.write_csv(frame, str(tmp_path / "t")) == 2
    back = exports.read_back_csv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_export_needs_every_table(spark, tmp_path):
    with pytest.raises(KeyError, match="fact_sales"):
        exports.export_tables({"dim_date": spark.range(1)}, str(tmp_path))


def test_results_as_json(spark, store, tmp_path):
    store.write_results(str(tmp_path / "results"))
    written = {p.name.split("=")[1] for p in (tmp_path / "results").iterdir() if p.is_dir()}
    assert written == set(REPORTS)
    for name in REPORTS:
        columns = set(store.query(name).columns)
        for file in Path(tmp_path, "results", f"result={name}").glob("*.txt"):
            for line in file.read_text(encoding="utf-8").splitlines():
                document = json.loads(line)
                assert document["result"] == name and set(document["row"]) == columns
        back, result = exports.read_results(spark, str(tmp_path / "results"), name), exports.without_nan(store.query(name))
        assert back.dtypes == result.dtypes and sorted_rows(back) == sorted_rows(result), name


def test_json_has_null_for_nan_and_iso_dates(spark, tmp_path):
    frame = spark.sql("SELECT double('NaN') AS x, CAST(NULL AS INT) AS y, DATE'2020-01-31' AS d, CAST('1.50' AS DECIMAL(5,2)) AS m")
    exports.write_results({"t": frame}, str(tmp_path / "r"))
    line = next(Path(tmp_path, "r", "result=t").glob("*.txt")).read_text()
    assert json.loads(line)["row"] == {"x": None, "y": None, "d": "2020-01-31", "m": 1.5}


ODD_TEXTS = [
    "  spaced  ", 'a "quoted" word', "a,b", "two\nlines", "\r\n", "back\\slash", "\\n", "\\\\n", "\\\n\\", "\\e", "\\\\e", "\\", "", None, " ", '"', '""', "é\u2028x",
]


def test_exported_text_comes_back_as_it_was(spark, tmp_path):
    table = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "k int, t string")
    exports.write_csv(table, f"{tmp_path}/texts")
    back = exports.read_back_csv(spark, f"{tmp_path}/texts")
    assert sorted(map(tuple, back.collect())) == list(enumerate(ODD_TEXTS)) and back.dtypes == table.dtypes
    written = [line for p in Path(tmp_path, "texts").glob("*.csv") for line in p.read_text(encoding="utf-8").split("\n")[1:-1]]
    assert len(written) == len(ODD_TEXTS)  # one line a row


def test_large_exports_are_read_in_parts_and_without_a_pass_for_types(spark, tmp_path):
    exports.write_csv(spark.range(60_000).selectExpr("id", "repeat('x,', 20) AS t").coalesce(1), f"{tmp_path}/large")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        back = exports.read_back_csv(spark, f"{tmp_path}/large")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
        assert back.rdd.getNumPartitions() > 4 and back.filter("length(t) = 40").count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_grain_over_months_counts_what_one_pass_counts(spark):
    ids = [("a1", "a", "m1"), ("a1", "a", "m1"), ("a2", "a", "m1"), ("a2", "a", "m2"), ("a2", "a", None), ("b1", "b", "m2"),
           (None, None, "m1"), (None, None, "m3"), ("c1", "c", None), ("c1", "c", "m3"), ("c2", "c", "m3")]
    lines = spark.createDataFrame(ids, "sales_line_id string, order_number string, month string")
    expected = quality.grain_unique(lines).first()["violations"]
    assert quality.grain_over_months(quality.grain_state(lines, "month"), lines, "month").first()["violations"] == expected == 6
    none = lines.limit(0)
    assert quality.grain_over_months(quality.grain_state(none, "month"), none, "month").first()["violations"] == 0


def test_the_stored_report_reads_no_measures(store):
    plan = store.quality_report()._jdf.queryExecution().executedPlan().toString()
    scans = [line.partition("ReadSchema: ")[2] for line in plan.splitlines() if "FileScan" in line and "/tables/fact_sales" in line]
    assert scans and all(set(re.findall(r"(\w+):", scan)) <= {"sales_line_id", "order_number"} for scan in scans)

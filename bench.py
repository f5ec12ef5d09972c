"""Times the headline queries and prints one JSON line.

``from_source_*`` run on the raw tables, joins included. ``build_warehouse`` stores the star model; the other queries run
on the stored model, as the reports do. Every timing is the better of two runs (the build runs once).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marginlens.plans.catalog import query  # noqa: E402
from marginlens.plans.model import OrderModel  # noqa: E402
from marginlens.plans.warehouse import Warehouse  # noqa: E402

FROM_SOURCE = ("fact_sales", "kpi_summary", "pvm_bridge", "pareto_sku", "kpi_monthly", "quality_report")
STORED = (
    "kpi_summary", "kpi_by_category", "kpi_by_territory", "kpi_by_reseller_type", "kpi_monthly", "kpi_by_calendar_year",
    "kpi_price_structure", "pvm_bridge", "pvm_by_category", "pvm_top_cost_increases", "abc_sku_summary",
    "loss_making_sku_channel", "disc_by_promotion", "disc_depth_buckets", "disc_turning_lines_negative", "disc_summary",
    "price_grid", "stop_selling_curve", "discount_rule_cap", "loss_making_summary", "growth", "pricing_vs_cost",
    "chk_fact_grain_unique", "chk_orphan_resellers_customers",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best_of(times: int, action) -> float:
    seconds = []
    for _ in range(times):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="marginlens-bench-")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marginlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        # files of the stored fact: the default of 64 MB would leave most local cores idle at this scale
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16MB")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    source = OrderModel(spark, sf_dir)
    run(query(source, "dim_sku"))  # start-up of the session, not timed

    timings: dict[str, float] = {}
    for name in FROM_SOURCE:
        timings[f"from_source_{name}"] = best_of(2, lambda: run(query(source, name)))
    start = time.perf_counter()
    warehouse = Warehouse.build(source, f"{scratch}/warehouse")
    timings["build_warehouse"] = round(time.perf_counter() - start, 3)
    for name in STORED:
        timings[name] = best_of(2, lambda: run(warehouse.query(name)))
    spark.stop()

    total = round(sum(timings.values()), 3)
    result = {"metric": "margin_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(result))


if __name__ == "__main__":
    main()

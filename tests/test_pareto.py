from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginlens.operators import pareto
from marginlens.params import Params
from tests.fixtures import one, rows_of

PARAMS = Params()
ITEM_SCHEMA = "sku string, net_sales decimal(19,4), gross_margin decimal(19,4)"


def items(spark, margins):
    rows = [(f"S{i:05d}", Decimal(1000), Decimal(str(m))) for i, m in enumerate(margins)]
    return spark.createDataFrame(rows, ITEM_SCHEMA)


def brute_force(margins):
    """Rank, cumulative sums and class of every item, in plain Python."""
    ordered = sorted(((Decimal(str(m)), f"S{i:05d}") for i, m in enumerate(margins)), key=lambda p: (-p[0], p[1]))
    positive = sum(max(m, Decimal(0)) for m, _ in ordered)
    out, cum, before = {}, Decimal(0), Decimal(0)
    for rank, (m, sku) in enumerate(ordered, start=1):
        cum += m
        cls = "D" if m < 0 else "A" if before < Decimal("0.80") * positive else "B" if before < Decimal("0.95") * positive else "C"
        out[sku] = (rank, cum, before, cls)
        before += max(m, Decimal(0))
    return out


CASES = {
    "mixed": [100, 50, 30, 0, -20, -70, 10, 5],
    "ties": [10] * 50 + [-1] * 10 + [0] * 5,
    "negative total": [5, 3, -100, -40, 0],
    "crosses exactly 80 %": [50, 30, 15, 5],
    "one item": [7],
    "one hot margin": [1] * 400 + [1000000],
    "many": [((i * 7919) % 1009) - 300 for i in range(3000)],
}


@pytest.mark.parametrize("ranges", [None, 1, 7])
@pytest.mark.parametrize("case", CASES)
def test_ranking_equals_brute_force(spark, case, ranges):
    margins = CASES[case]
    ranked = pareto.with_shares(pareto.rank_items(items(spark, margins), "sku", ranges=ranges), PARAMS)
    found = {r["sku"]: (r["rank_margin"], r["cum_margin"], r["cum_before"], r["abc_class"]) for r in ranked.collect()}
    assert found == brute_force(margins)


def test_ranges_are_really_used(spark):
    """Seven ranges give several range ids, so the case above does exercise the offsets."""
    frame = items(spark, CASES["many"]).repartitionByRange(7, F.col("gross_margin").desc(), "sku")
    assert frame.select(F.spark_partition_id().alias("p")).distinct().count() > 3


def test_exact_threshold_starts_the_next_class(spark):
    ranked = pareto.with_shares(pareto.rank_items(items(spark, [50, 30, 15, 5]), "sku"), PARAMS)
    assert [r["abc_class"] for r in ranked.orderBy("rank_margin").collect()] == ["A", "A", "B", "C"]


def test_negative_total_has_no_net_base(spark):
    ranked = pareto.with_shares(pareto.rank_items(items(spark, CASES["negative total"]), "sku"), PARAMS)
    rows = ranked.orderBy("rank_margin").collect()
    assert all(r["cum_margin_pct_of_net"] is None for r in rows)
    assert [r["cum_margin_pct_of_positive"] for r in rows] == pytest.approx([62.5, 100, 100, -400, -1650])
    assert one(pareto.pareto_argmax(ranked))["pct_of_items_at_peak"] is None


def test_nothing_positive(spark):
    rows = pareto.with_shares(pareto.rank_items(items(spark, [-1, -2]), "sku"), PARAMS).collect()
    assert {r["abc_class"] for r in rows} == {"D"} and all(r["cum_margin_pct_of_positive"] is None for r in rows)


def test_ranking_equals_a_single_window_on_real_items(small):
    source = pareto.sku_margins(small.p1, small.skus("product_name", "category", "subcategory"), small.params)
    everything = W.orderBy(F.col("gross_margin").desc(), "sku")
    plain = source.select("sku", F.row_number().over(everything).alias("rank_margin"),
                          F.sum("gross_margin").over(everything.rowsBetween(W.unboundedPreceding, 0)).alias("cum_margin"))
    ranged = pareto.rank_items(source, "sku", ranges=5).select("sku", "rank_margin", "cum_margin")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))


@pytest.mark.parametrize("side", ["sku", "reseller"])
def test_audit_is_clean(small, side):
    from marginlens.plans.catalog import CATALOG

    audit = one(CATALOG[f"pareto_audit_{side}"](small))
    assert audit.pop("items") > 0 and audit.pop("class_a_margin") > 0
    assert not any(audit.values()), audit


def test_audit_sees_a_wrong_ranking(spark):
    ranked = pareto.rank_items(items(spark, CASES["mixed"]), "sku")
    swapped = ranked.withColumn("rank_margin", F.when(F.col("rank_margin") == 1, 2).when(F.col("rank_margin") == 2, 1).otherwise(F.col("rank_margin")))
    assert one(pareto.pareto_audit(swapped, PARAMS))["order_breaks"] > 0
    assert one(pareto.pareto_audit(ranked.withColumn("cum_margin", F.col("cum_margin") + 1), PARAMS))["last_not_total"] == 1


def test_summaries_add_up(small):
    rows = rows_of(pareto.abc_summary(small.pareto_sku, "skus"))
    assert sum(r["skus"] for r in rows) == small.pareto_sku.count()
    total = small.p1.agg(F.sum("gross_margin").cast("double")).first()[0]
    assert sum(r["gross_margin"] for r in rows) == pytest.approx(total, abs=4)
    resellers = rows_of(pareto.abc_summary(small.pareto_reseller, "resellers"))
    selling = small.p1.filter(F.col("channel") == small.params.b2b).select("reseller_key").distinct().count()
    assert sum(r["resellers"] for r in resellers) == selling


def test_losses_hidden_by_the_sku_view(small):
    losses = pareto.loss_making_sku_channel(small.p1, small.skus("product_name", "category", "subcategory"))
    rows = rows_of(losses)
    assert rows and all(r["gross_margin"] < 0 and r["gross_margin"] == r["net_sales"] - r["cogs"] for r in rows)
    profitable = small.pareto_sku.filter("gross_margin > 0").select("sku")
    expected = losses.join(profitable, "sku").count()
    assert one(pareto.hidden_losses(small.p1, small.skus("category")))["hidden_loss_pairs"] == expected

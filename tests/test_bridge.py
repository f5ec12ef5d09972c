from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from marginlens.operators import bridge
from marginlens.operators.period import sales_period
from tests.fixtures import PVM_ROWS, one, pvm_params, rows_of, sales_lines

PARAMS = pvm_params()


def compared(spark, rows, params=PARAMS):
    return bridge.compare_periods(sales_period(sales_lines(spark, rows), params))


def test_hand_worked_bridge(spark):
    totals = one(bridge.bridge_totals(compared(spark, PVM_ROWS)))
    expected = {
        "margin0": 320 + 210 + 80, "margin1": 395 + 140 + 90,
        "volume_effect": (320 + 210) * 0.2,  # 20 % more pieces at the old margins
        "mix_effect": (50 - 48) * 8 + (70 - 72) * 3.5,  # pieces beyond those 20 %, at the old margin of a piece
        "price_effect": 50 * (22 - 20) + 70 * (9 - 10), "discount_effect": -55 + 70 * 0.5,
        "cost_effect": -50 * (13 - 12) - 70 * (7 - 6), "new_effect": 90, "discontinued_effect": -80,
    }
    assert {k: pytest.approx(v) for k, v in expected.items()} == totals


def test_hand_worked_lines_and_steps(spark):
    units = compared(spark, PVM_ROWS)
    lines = {r["sku"]: r for r in rows_of(bridge.pvm_lines(units))}
    assert sum(r["volume_effect"] for r in lines.values()) == pytest.approx(106)
    assert sum(r["mix_effect"] for r in lines.values()) == pytest.approx(9)
    assert lines["A"]["unit_cogs0"] == 12.0 and lines["C"]["unit_cogs0"] is None and lines["D"]["unit_cogs1"] is None
    assert lines["C"]["new_effect"] == 90 and lines["D"]["discontinued_effect"] == -80
    steps = rows_of(bridge.pvm_bridge(units, PARAMS))
    assert [r["value"] for r in steps] == pytest.approx([610, 106, 9, 30, -20, -120, 90, -80, 625])
    assert [r["step"] for r in steps] == list(PARAMS.bridge_steps)


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for sku in range(rng.randint(3, 11)):
        for channel in ("X", "Y"):
            for year in (2020, 2021):
                if rng.random() < 0.8:
                    q, price, cost = rng.randint(1, 199), rng.uniform(5, 100), rng.uniform(3, 110)
                    off = rng.uniform(0, 0.3) * price if rng.random() < 0.3 else 0
                    gross, disc = round(q * price, 4), round(q * off, 4)
                    rows.append((f"S{sku}", channel, f"{year}-05-01", q, gross, disc, round(gross - disc, 4), round(q * cost, 4)))
    return rows


def brute_force(rows):
    """The bridge from its definition, unit by unit, with plain numbers."""
    units = {}
    for sku, channel, day, *values in rows:
        sums = units.setdefault((sku, channel), [[0.0] * 5, [0.0] * 5])[int(day[3])]
        for i, value in enumerate(values):
            sums[i] += float(value)
    live = [(a, b) for a, b in units.values() if a[0] > 0 and b[0] > 0]
    r = sum(b[0] for _, b in live) / sum(a[0] for a, _ in live) if live else None
    out = dict.fromkeys(bridge.EFFECTS, 0.0)
    for (q0, g0, d0, n0, c0), (q1, g1, d1, n1, c1) in units.values():
        m0, m1 = n0 - c0, n1 - c1
        if q0 > 0 and q1 > 0:
            unit_margin = m0 / q0
            out["volume_effect"] += (r - 1) * q0 * unit_margin
            out["mix_effect"] += (q1 - q0 * r) * unit_margin
            out["price_effect"] += q1 * (g1 / q1 - g0 / q0)
            out["discount_effect"] -= q1 * (d1 / q1 - d0 / q0)
            out["cost_effect"] -= q1 * (c1 / q1 - c0 / q0)
        elif q0 == 0:
            out["new_effect"] += m1
        else:
            out["discontinued_effect"] -= m0
    return out


@pytest.mark.parametrize("seed", range(25))
def test_identity_and_definition_on_random_lines(spark, seed):
    rows = random_rows(seed)
    totals = one(bridge.bridge_totals(compared(spark, rows)))
    assert abs(totals["margin1"] - totals["margin0"] - sum(totals[e] for e in bridge.EFFECTS)) < 1e-6
    for effect, value in brute_force(rows).items():
        assert totals[effect] == pytest.approx(value, abs=1e-6), effect


def test_join_form_equals_aggregation_form(small):
    lines = small.sales_period
    by_aggregation = {(r["sku"], r["channel"]): r for r in rows_of(bridge.pvm_lines(bridge.compare_periods(lines)))}
    by_join = {(r["sku"], r["channel"]): r for r in rows_of(bridge.pvm_lines(bridge.compare_periods_by_join(lines)))}
    assert by_aggregation == by_join


def test_missing_sku_keeps_periods_apart(spark):
    rows = [(None, "X", "2020-06-01", 5, 50, 0, 50, 20), (None, "X", "2021-06-01", 5, 60, 0, 60, 20), *PVM_ROWS]
    lines = sales_period(sales_lines(spark, rows), PARAMS)
    key = ["channel", "q0", "q1", "margin0", "margin1"]
    for form in (bridge.compare_periods, bridge.compare_periods_by_join):
        lost = form(lines).filter(F.col("sku").isNull()).select(*key).orderBy("q0").collect()
        assert [tuple(r) for r in lost] == [("X", 0.0, 5.0, 0.0, 40.0), ("X", 5.0, 0.0, 30.0, 0.0)]


def test_no_continuing_units(spark):
    rows = [("A", "X", "2020-06-01", 5, 50, 0, 50, 20), ("B", "X", "2021-06-01", 5, 60, 0, 60, 20)]
    units = compared(spark, rows)
    assert one(bridge.unit_growth(units))["r"] is None
    lines = rows_of(bridge.pvm_lines(units))
    assert len(lines) == 2 and all(r["volume_effect"] == 0 and r["mix_effect"] == 0 for r in lines)
    totals = one(bridge.bridge_totals(units))
    assert totals["volume_effect"] == totals["mix_effect"] == 0
    assert totals["margin1"] - totals["margin0"] == pytest.approx(totals["new_effect"] + totals["discontinued_effect"])
    assert [r["volume"] for r in rows_of(bridge.pvm_by_channel(units))] == [0.0]


def test_days_between_the_windows_belong_to_no_period(spark):
    params = pvm_params(p0_end=date(2020, 11, 30))
    rows = [*PVM_ROWS, ("E", "X", "2020-12-15", 7, 70, 0, 70, 30)]
    assert compared(spark, rows, params).filter("sku = 'E'").count() == 0
    assert sales_period(sales_lines(spark, rows), params).filter("period IS NULL").count() == 1


def test_groups_add_up_to_the_bridge(small):
    total = one(bridge.bridge_totals(small.compared))
    names = dict(zip(("margin_p0", "volume", "mix", "price", "discounts", "cost", "new_products", "discontinued", "margin_p1"),
                     ("margin0", *bridge.EFFECTS, "margin1")))
    for grouped in (bridge.pvm_by_channel(small.compared), bridge.pvm_by_category(small.compared, small.skus("category"))):
        sums = one(grouped.agg(*[F.sum(n).alias(n) for n in names]))
        for group_name, total_name in names.items():
            assert sums[group_name] == pytest.approx(total[total_name], abs=4), group_name


def test_units_outside_the_dimension_still_count_in_growth(spark):
    units = compared(spark, PVM_ROWS)
    skus = spark.createDataFrame([("A", "Cat"), ("C", "Cat"), ("D", "Cat")], "sku string, category string")
    row = one(bridge.pvm_by_category(units, skus))
    # growth over A and B together is 120 / 100, applied to A's margin of 320
    assert row["volume"] == pytest.approx(round(320 * 0.2))


def test_audit_is_clean(small):
    audit = one(bridge.partition_audit(small.pvm_lines))
    sizes = {k: audit.pop(k) for k in ("continuing", "new", "discontinued")}
    assert sum(sizes.values()) == small.pvm_lines.count()
    assert not any(audit.values()), audit

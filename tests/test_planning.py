import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from promoloom.operators import planning as L


def naive_greedy(rows, budget, slots, kmax):
    best = {}
    for r in rows:
        if r["d"] > 0 and r["net"] > 0:
            key = (-r["net"], r["spend"], r["d"])
            if r["sku"] not in best or key < best[r["sku"]][0]:
                best[r["sku"]] = (key, r)
    plan, spent, groups = [], 0.0, {}
    for r in sorted((b[1] for b in best.values()), key=lambda r: (-r["net"], r["sku"])):
        if len(plan) >= slots or spent + r["spend"] > budget or groups.get(r["group"], 0) >= kmax:
            continue
        plan.append(r)
        spent += r["spend"]
        groups[r["group"]] = groups.get(r["group"], 0) + 1
    return {(r["sku"], r["d"]) for r in plan}


@pytest.fixture(scope="module")
def cand(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        group = "hot" if i % 3 == 0 else f"g{i % 17}"
        for d in (0, 10, 20, 30):
            rows.append((f"S{i:03d}", "c", group, float(d), float(rng.normal(5, 10)) if d else 0.0,
                         float(rng.normal(1, 10)), 0.0, float(rng.uniform(1, 40)) if d else 0.0))
    return spark.createDataFrame(rows, "sku string, cat string, group string, d double, net double, "
                                       "net_robust double, rev double, spend double").cache()


@pytest.mark.parametrize("budget,slots,kmax,ahead", [(1e9, 200, 3, 1000), (300.0, 200, 3, 1000), (300.0, 200, 50, 7),
                                                     (150.0, 9, 2, 5), (1e9, 12, 300, 5), (0.0, 200, 3, 10)])
def test_greedy_equals_a_sequential_walk(cand, budget, slots, kmax, ahead):
    plan = L.greedy_plan(cand, budget, slots, kmax, look_ahead=ahead).collect()
    assert {(r.sku, r.d) for r in plan} == naive_greedy([r.asDict() for r in cand.collect()], budget, slots, kmax)


def test_robust_plan_uses_the_lower_effect(cand):
    got = L.best_per_sku(cand, robust=True).collect()
    assert got and all(r.obj == r.net_robust > 0 for r in got)


@pytest.mark.parametrize("budget,slots,kmax", [(300.0, 200, 3), (60.0, 5, 2), (1e9, 200, 3)])
def test_priced_plan_is_feasible_and_below_its_bound(cand, budget, slots, kmax):
    plan, report = L.lagrangian_plan(cand, budget, slots, kmax)
    rows, rep = plan.collect(), report.first()
    assert len({r.sku for r in rows}) == len(rows) <= slots
    assert sum(r.spend for r in rows) <= budget
    groups = {}
    for r in rows:
        groups[r.group] = groups.get(r.group, 0) + 1
    assert max(groups.values()) <= kmax
    assert rep.value == pytest.approx(sum(r.net for r in rows)) and rep.value <= rep.bound + 1e-9
    greedy = sum(r.net for r in L.greedy_plan(cand, budget, slots, kmax).collect())
    assert rep.bound >= greedy - 1e-9 and rep.value >= 0.9 * greedy


def test_no_profitable_discount(spark, cand):
    losing = cand.withColumn("net", -F.abs("net") - 1)
    past = spark.createDataFrame([(10.0, 5.0)], "hist_spend double, hist_net double")
    plan = L.greedy_plan(losing, 100.0)
    report = L.plan_report(plan, past).first()
    assert (report.skus, report.plan_net, report.outcome) == (0, 0.0, "no profitable discount")
    plan, report = L.lagrangian_plan(losing, 100.0)
    assert plan.count() == 0 and report.first().value == 0.0


@pytest.mark.parametrize("seed", range(5))
def test_selection_is_near_the_best_plan(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"S{i}", "c", f"g{i % 3}", float(d), float(rng.uniform(1, 20)), 0.0, 0.0, float(rng.uniform(1, 20)))
            for i in range(8) for d in (10, 20)]
    budget, slots, kmax = float(rng.uniform(15, 60)), 5, 2
    best = 0.0

    def walk(i, value, spend, n, groups):
        nonlocal best
        best = max(best, value)
        for j in range(i, 8):
            for r in rows[2 * j:2 * j + 2]:
                if spend + r[7] <= budget and n < slots and groups.get(r[2], 0) < kmax:
                    walk(j + 1, value + r[4], spend + r[7], n + 1, {**groups, r[2]: groups.get(r[2], 0) + 1})

    walk(0, 0.0, 0.0, 0, {})
    cand = spark.createDataFrame(rows, "sku string, cat string, group string, d double, net double, net_robust double, rev double, spend double")
    plan, report = L.selection_plan(cand, budget, slots, kmax)
    got, rep = plan.collect(), report.first()
    assert 0.99 * best <= rep.value <= best + 1e-9 <= rep.bound + 2e-9
    assert rep.value == pytest.approx(sum(r.net for r in got)) and sum(r.spend for r in got) <= budget + 1e-9
    assert len({r.sku for r in got}) == len(got) <= slots


@pytest.mark.parametrize("budget,slots,kmax", [(300.0, 200, 3), (60.0, 5, 2), (1e9, 200, 3), (0.0, 5, 2)])
def test_selection_is_no_worse_than_fixed_prices(cand, budget, slots, kmax):
    plan, report = L.selection_plan(cand, budget, slots, kmax)
    mine, fixed = report.first(), L.lagrangian_plan(cand, budget, slots, kmax)[1].first()
    assert mine.value >= fixed.value - 1e-9 and mine.gap <= fixed.gap + 1e-9
    assert mine.gap <= max(0.01 * mine.bound, 1e-9) or slots == 5
    groups = plan.groupBy("group").count().collect()
    assert plan.count() <= slots and all(r["count"] <= kmax for r in groups) and mine.spend <= budget + 1e-9


def test_baseline_candidates_and_history(spark):
    panel = spark.createDataFrame([
        ("1", "A", "2023-02-01", 10.0, "late", 0.0), ("1", "B", "2023-01-01", 20.0, "early", 0.0),
        ("1", "A", "2023-03-01", 90.0, "late", 20.0), ("1", "B", "2023-03-01", 90.0, "late", 10.0),
        ("2", "A", "2023-01-01", 0.0, "x", 0.0), ("3", "A", "2023-01-01", 5.0, "x", 0.0),
        ("4", "A", "2023-01-01", 5.0, "x", 0.0)],
        "sku string, client string, month string, qty double, category string, own_disc double")
    prices = spark.createDataFrame([("1", 100.0, "G1"), ("2", 50.0, "G1"), ("3", None, "G2")],
                                   "sku string, entry_piece double, grp string")
    priced = L.attach_prices(panel, prices)
    assert {r.sku: r.group for r in priced.collect()} == {"1": "G1", "2": "G1", "3": "G2", "4": "—"}
    base = L.baseline_table(priced).collect()
    # No sales, no price: only SKU 1 stays.
    assert [(r.sku, r.base_qty, r.cat, r.group, r.price_unit) for r in base] == [("1", 15.0, "early", "G1", 100.0)]
    base = spark.createDataFrame(base)
    overall = spark.createDataFrame([(0.03, 0.01)], "theta double, lo double")
    none = spark.createDataFrame([], "category string, theta double, lo double, hi double")
    got = {r.d: r for r in L.candidates(base, none, overall, (0, 10), 0.3).collect()}
    nq = 15 * math.exp(0.3)
    assert got[0.0].net == 0.0 and got[10.0].net == pytest.approx(nq * 60 - 15 * 70)
    # An unknown category has no lower bound of its own.
    assert got[10.0].net_robust == pytest.approx(got[10.0].net)
    known = spark.createDataFrame([("early", 0.05, 0.02, 0.08)], "category string, theta double, lo double, hi double")
    got = {r.d: r for r in L.candidates(base, known, overall, (10,), 0.3).collect()}
    assert got[10.0].net == pytest.approx(15 * math.exp(0.5) * 60 - 15 * 70)
    assert got[10.0].net_robust == pytest.approx(15 * math.exp(0.2) * 60 - 15 * 70)
    past = L.past_policy(priced, base, none, overall, 0.3).first()
    nq = 15 * math.exp(0.03 * 15)
    assert past.hist_spend == pytest.approx(nq * 100 * 0.15)
    assert past.hist_net == pytest.approx(max(nq * (85 - 30) - 15 * 70, 0))

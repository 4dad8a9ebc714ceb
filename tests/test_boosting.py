"""Boosted trees of all models in shared passes, against trees grown one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from promoloom.operators import boosting, causal
from promoloom.operators.nuisance import Nuisance


def one_model(x, y, train, rounds, levels, leaf_rows, rate, bins):
    """Predictions of every row by trees fitted to the rows of ``train``."""
    f = np.full(len(y), y[train].mean())
    for _ in range(rounds):
        node, value = np.zeros(len(y), int), None
        for level in range(levels):
            new, values = np.zeros(len(y), int), np.zeros(2 << level)
            for k in range(1 << level):
                rows = train & (node == k)
                left = y - f
                whole = left[rows].sum() ** 2 / max(rows.sum(), 1)
                best = (1e-12 * max(1.0, abs(left[rows].sum())), None)
                for j in range(x.shape[1]):
                    for b in range(bins):
                        side = x[:, j] <= b
                        n, m = (rows & side).sum(), (rows & ~side).sum()
                        if n >= leaf_rows and m >= leaf_rows:
                            gain = left[rows & side].sum() ** 2 / n + left[rows & ~side].sum() ** 2 / m - whole
                            if gain > best[0] + 1e-9:
                                best = (gain, (j, b))
                side = x[:, best[1][0]] <= best[1][1] if best[1] else np.ones(len(y), bool)
                new[node == k] = 2 * k + ~side[node == k]
                for s, part in ((0, rows & side), (1, rows & ~side)):
                    values[2 * k + s] = left[part].mean() if part.any() else 0.0
                if not best[1]:
                    values[2 * k + 1] = values[2 * k]
            node, value = new, values
        f = f + rate * value[node]
    return f


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    n = 260
    a, b = rng.integers(0, 6, n).astype(float), rng.normal(size=n).round(1)
    a[::17] = np.nan
    label = rng.integers(0, 3, n)
    y = np.nan_to_num(a) + np.where(b > 0, 2.0, -1.0) + label + rng.normal(0, 0.2, n)
    t = b * 2 + rng.normal(0, 0.5, n)
    return [(int(i), float(a[i]) if not np.isnan(a[i]) else None, float(b[i]), f"L{label[i]}", f"G{i % 2}", int(i * 7 % 3), float(y[i]), float(t[i]))
            for i in range(n)]


@pytest.mark.parametrize("by,models", [([], boosting.MODELS), (["g"], boosting.MODELS), (["g"], 1)])
def test_shared_passes_equal_single_models(spark, rows, monkeypatch, by, models):
    monkeypatch.setattr(boosting, "MODELS", models)
    options = {"rounds": 4, "levels": 2, "leaf_rows": 5, "rate": 0.3, "bins": 8}
    df = spark.createDataFrame(rows, "i int, a double, b double, l string, g string, fold int, y double, t double").repartition(3)
    got = {r.i: (r.y_r, r.t_r) for r in boosting.tree_residuals(df, ["y", "t"], ["a", "b"], ["l"], by, **options).collect()}
    values = np.array([[np.nan if r[1] is None else r[1], r[2], int(r[3][1])] for r in rows], float)
    order = spark.createDataFrame([(float(v[0]) if not np.isnan(v[0]) else None, float(v[1]), float(v[2])) for v in values], "a double, b double, l double")
    x = boosting.binned(values, boosting.bin_borders(order, ["a", "b", "l"], 8)).astype(int)
    group, fold = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    for at, target in ((0, np.array([r[6] for r in rows])), (1, np.array([r[7] for r in rows]))):
        for f in range(3):
            for g in (sorted(set(group)) if by else [None]):
                inside = group == g if by else np.ones(len(rows), bool)
                want = target - one_model(x, target, inside & (fold != f), bins=8, **{k: v for k, v in options.items() if k != "bins"})
                own = np.flatnonzero(inside & (fold == f))
                assert np.allclose([got[i][at] for i in own], want[own], atol=1e-8)


def test_rows_without_a_target_have_no_residual(spark, rows):
    df = spark.createDataFrame([(*r[:6], None if r[0] % 50 == 0 else r[6], r[7]) for r in rows],
                               "i int, a double, b double, l string, g string, fold int, y double, t double")
    got = boosting.tree_residuals(df, ["y"], ["a", "b"], ["l"], rounds=2, only_fold=1).collect()
    assert {r.fold for r in got} == {1} and len(got) == sum(r[5] == 1 for r in rows)
    assert all((r.y_r is None) == (r.i % 50 == 0) for r in got)


def test_effects_by_category_with_trees(spark, made_panel):
    feats = made_panel.withColumns({"y": F.log1p("qty"), "m_sin": F.sin(2 * np.pi * F.month("month") / 12), "m_cos": F.cos(2 * np.pi * F.month("month") / 12)})
    trees = Nuisance("gbt", controls=("m_sin", "m_cos"), max_iter=8)
    got = causal.effect_by_category(causal.design(feats, trees), trees, min_rows=100, min_treated=10).collect()
    assert {r.category for r in got} == {"C0", "C1", "C2"} and all(abs(r.theta - 0.03) < 0.006 for r in got)


OPTIONS = {"rounds": 4, "levels": 3, "leaf_rows": 5, "rate": 0.3, "bins": 8}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_models_in_tasks_of_their_own_equal_shared_passes(spark, rows, monkeypatch, by):
    df = spark.createDataFrame(rows, "i int, a double, b double, l string, g string, fold int, y double, t double").repartition(3)
    found = {}
    for most in (boosting.WHOLE_BYTES, 0):
        monkeypatch.setattr(boosting, "WHOLE_BYTES", most)
        found[most] = {r.i: (r.y_r, r.t_r) for r in boosting.tree_residuals(df, ["y", "t"], ["a", "b"], ["l"], by, **OPTIONS).collect()}
    one, other = found.values()
    assert one.keys() == other.keys() and all(one[i] == pytest.approx(other[i], abs=1e-9) for i in one)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_passes_equal_single_models(spark, rows, monkeypatch, by):
    monkeypatch.setattr(boosting, "WHOLE_BYTES", 0)
    test_shared_passes_equal_single_models(spark, rows, monkeypatch, by, boosting.MODELS)


def test_rounds_need_no_jobs_where_a_models_rows_fit_a_task(spark, rows):
    df = spark.createDataFrame(rows, "i int, a double, b double, l string, g string, fold int, y double, t double")
    context, jobs = spark.sparkContext, []
    try:
        for rounds in (1, 6):
            context.setJobGroup(f"rounds {rounds}", "")
            boosting.tree_residuals(df, ["y"], ["a", "b"], ["l"], **OPTIONS | {"rounds": rounds}).collect()
            jobs.append(len(context.statusTracker().getJobIdsForGroup(f"rounds {rounds}")))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_shared_codes_hold_every_features_histogram():
    rng = np.random.default_rng(4)
    borders = np.full((5, 6), np.inf)
    for j, width in enumerate((6, 2, 6, 0, 3)):
        borders[j, :width] = np.arange(width)
    codes = boosting.shared_codes(borders, 70)
    assert sorted(j for c in codes for j in c.features) == [0, 1, 2, 3, 4] and len(codes) < 5 and all(c.size() <= 70 for c in codes)
    x = np.stack([rng.integers(0, (borders[j] < np.inf).sum() + 2, 300) for j in range(5)]).astype(np.uint8)
    got = np.zeros((1, 5, 8))
    for code, numbers in zip(codes, boosting.coded(x, codes)):
        boosting._spread_out(got, code, np.bincount(numbers, minlength=code.size()))
    assert (got[0] == [np.bincount(v, minlength=8) for v in x]).all()

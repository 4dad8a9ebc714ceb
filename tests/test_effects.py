import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promoloom.operators import causal, interference, resample
from promoloom.operators.features import CONTROLS, add_features
from promoloom.operators.nuisance import Nuisance, residuals, with_folds
from promoloom.plans.registry import TREES
from promoloom.storage import settle

SMALL = Nuisance("linear", controls=("m_sin", "m_cos", "lag_qty_1"))
CELLS = Nuisance("cells")


@pytest.fixture(scope="module")
def feats(made_panel):
    return settle(add_features(made_panel))


@pytest.fixture(scope="module")
def design(feats):
    return causal.design(feats, Nuisance(cells=CELLS.cells, controls=CONTROLS), extra=["month_num"])


def hash60(*parts):
    return int(hashlib.md5("#".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_folds_come_from_the_key(design):
    for r in design.limit(50).collect():
        assert r.fold == hash60(f"{r.sku}|{r.client}|{r.month}", 42) % 5


def test_cell_residuals_match_brute_force(design):
    pdf = residuals(design, ["y", "t"], CELLS).toPandas()
    for f in range(5):
        held, train = pdf[pdf.fold == f], pdf[pdf.fold != f]
        means = train.groupby(["category", "month_num"]).y.mean()
        expected = held.y - [means[c, m] for c, m in zip(held.category, held.month_num)]
        assert np.allclose(held.y_r, expected)


def test_cell_without_training_rows_uses_the_overall_mean(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 10.0), ("c", 1, 5.0)]
    df = spark.createDataFrame(rows, "cell string, fold int, y double")
    got = {(r.cell, r.fold): r.y_r for r in residuals(df, ["y"], Nuisance("cells", cells=("cell",))).collect()}
    # Fold 0 trains on fold 1 (3, 5) and fold 1 on fold 0 (1, 10).
    assert got == {("a", 0): -2.0, ("a", 1): 2.0, ("b", 0): 6.0, ("c", 1): -0.5}


@pytest.mark.parametrize("by", [[], ["category"]])
def test_linear_residuals_match_least_squares(design, by):
    labels = () if by else ("category",)
    nuisance = Nuisance("linear", controls=CONTROLS, labels=labels)
    pdf = residuals(design, ["y", "t"], nuisance, by).toPandas()
    for _, part in (pdf.groupby("category") if by else [(None, pdf)]):
        dummies = np.stack([(part.category == c) for c in sorted(part.category.unique())], 1).astype(float)
        x = np.hstack([part[list(CONTROLS)].to_numpy(float), dummies])
        for f in range(5):
            held = (part.fold == f).to_numpy()
            for target in ("y", "t"):
                v = part[target].to_numpy()
                beta = np.linalg.lstsq(x[~held], v[~held], rcond=None)[0]
                assert np.allclose(part[f"{target}_r"].to_numpy()[held], v[held] - x[held] @ beta, atol=1e-6)


def test_linear_label_missing_from_training(spark):
    rows = [("a", f, float(x), 2.0 * x + 1) for f in (0, 1) for x in range(5)] + [("b", 0, 2.0, 9.0)]
    df = spark.createDataFrame(rows, "category string, fold int, x double, y double")
    got = residuals(df, ["y"], Nuisance("linear", controls=("x",))).collect()
    assert all(abs(r.y_r) < 1e-9 for r in got if r.category == "a")
    # 'b' has no row outside fold 0: the mean outside the fold (x 2, y 5) and the slope serve it.
    assert [r.y_r for r in got if r.category == "b"] == pytest.approx([4.0])


def test_cluster_slope_matches_sandwich(spark):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 12, 400)
    x = rng.normal(size=400) + g * 0.1
    y = 0.5 * x + rng.normal(size=400) + rng.normal(size=12)[g]
    df = spark.createDataFrame([(str(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "sku string, x double, y double")
    got = resample.cluster_slope(resample.cluster_moments(df, "x", "y")).first()
    X = np.stack([np.ones(400), x], 1)
    beta = np.linalg.solve(X.T @ X, X.T @ y)
    e = y - X @ beta
    meat = sum(np.outer(X[g == k].T @ e[g == k], X[g == k].T @ e[g == k]) for k in range(12))
    bread = np.linalg.inv(X.T @ X)
    var = (bread @ meat @ bread)[1, 1] * 12 / 11 * 399 / 398
    assert got.theta == pytest.approx(beta[1]) and got.se == pytest.approx(np.sqrt(var))
    assert got.hi - got.lo == pytest.approx(2 * 1.959963984540054 * np.sqrt(var))


def test_bootstrap_draws_match_brute_force(spark):
    rows = [(f"s{i:02d}", float(i + 1), float(i * i)) for i in range(9)]
    df = spark.createDataFrame(rows, "sku string, a double, b double")
    got = {r.rep: (r.a, r.b) for r in resample.bootstrap_sums(df, ["a", "b"], 20).collect()}
    assert len(got) == 20
    for rep, sums in got.items():
        drawn = [rows[hash60(rep, at, 42) % 9] for at in range(1, 10)]
        assert sums == pytest.approx((sum(d[1] for d in drawn), sum(d[2] for d in drawn)))


def test_bootstrap_within_groups(spark):
    rows = [(g, f"{g}{i}", 1.0) for g, n in (("p", 3), ("q", 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, sku string, a double")
    got = resample.bootstrap_sums(df, ["a"], 5, by=["g"]).collect()
    assert len(got) == 10 and all(r.a == {"p": 3.0, "q": 8.0}[r.g] for r in got)


def test_poisson_bootstrap_spread(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i}", 10.0, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in
            enumerate(zip(rng.normal(size=80), rng.normal(size=80), rng.uniform(9, 11, 80), rng.normal(1, 1, 80)))]
    df = spark.createDataFrame(rows, "sku string, n double, sx double, sy double, sxx double, sxy double")
    a = resample.bootstrap_slope(df, 200).first()
    b = resample.bootstrap_slope(df, 200, scheme="poisson").first()
    assert a.theta == b.theta and b.se == pytest.approx(a.se, rel=0.35)
    with pytest.raises(ValueError):
        resample.bootstrap_slope(df, 2, scheme="other")


@pytest.mark.parametrize("nuisance", [CELLS, SMALL], ids=["cells", "linear"])
def test_planted_effect_is_recovered(design, nuisance):
    got = causal.effect(design, nuisance).first()
    assert got.theta == pytest.approx(0.03, abs=0.002) and got.lo < 0.03 < got.hi and got.p < 1e-6
    boot = causal.effect(design, nuisance, "bootstrap", 100).first()
    assert boot.theta == pytest.approx(got.theta) and boot.p is None
    assert boot.se == pytest.approx(got.se, rel=0.4)


def test_tree_nuisance(design):
    got = causal.effect(design, Nuisance("gbt", controls=("m_sin", "m_cos"), max_iter=5)).first()
    assert got.theta == pytest.approx(0.03, abs=0.004)


def test_registered_trees_recover_a_planted_slope(spark):
    # Discount and sales both follow a sum of six controls.
    rng = np.random.default_rng(3)
    w = rng.standard_normal((2000, len(CONTROLS)))
    z = w[:, :6].sum(1)
    depth = z + 2 * rng.standard_normal(len(z))
    y = 0.5 * depth + z + 0.3 * rng.standard_normal(len(z))
    rows = [(f"S{i % 200:03d}", "A", dt.date(2020 + i // 200, 1, 1), f"C{i % 3}", *map(float, r), float(a), float(b))
            for i, (r, a, b) in enumerate(zip(w, y, depth))]
    fields = ", ".join(f"`{c}` double" for c in (*CONTROLS, "y", "own_disc"))
    feats = spark.createDataFrame(rows, f"sku string, client string, month date, category string, {fields}")
    got = causal.effect(causal.design(feats, TREES, folds=2), TREES).first()
    assert TREES == Nuisance("gbt")
    assert got.theta == pytest.approx(0.5, abs=0.2)


def test_effect_by_category_and_support(design):
    got = causal.effect_by_category(design, CELLS).collect()
    assert sorted(r.category for r in got) == ["C0", "C1", "C2"]
    assert all(r.lo < 0.03 < r.hi or abs(r.theta - 0.03) < 0.003 for r in got)
    sizes = {r.category: r["count"] for r in design.groupBy("category").count().collect()}
    some = causal.supported(design, min_rows=max(sizes.values())).collect()
    assert {r.category for r in some} == {c for c, n in sizes.items() if n == max(sizes.values())}
    # No category with enough support: an empty table, and planning falls back on the overall effect.
    for nuisance in (CELLS, SMALL):
        assert causal.effect_by_category(design, nuisance, min_rows=10**6).collect() == []
    top = causal.strongest(causal.effect_by_category(design, SMALL), 2).collect()
    assert len(top) == 2 and top[0].theta >= top[1].theta


def test_placebo_is_near_zero_and_keeps_the_values(design):
    got = causal.placebo(design, CELLS).first()
    assert abs(got.theta) < 0.005 and got.lo < 0.003 and got.hi > -0.003
    for by in ([], ["category"]):
        mixed = causal.permute(design, "t", by=by)
        assert mixed.columns == design.columns and mixed.count() == design.count()
        count = lambda df: {tuple(r) for r in df.groupBy(*by, "t").count().collect()}
        assert count(mixed) == count(design)
    moved = causal.permute(design, "t").alias("m").join(design.alias("d"), ["sku", "client", "month"])
    assert moved.filter("m.t <> d.t").count() > 500


def test_curves_and_inverse(design):
    curves = causal.response_curves(design, CELLS, reps=30)
    got = {r.grid: r for r in causal.dose_response(causal.effect(design, CELLS), curves).collect()}
    assert set(got) == {0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0}
    for d, r in got.items():
        true = np.expm1(0.03 * d) * 100
        assert r.lin == pytest.approx(true, abs=15) and r.nl == pytest.approx(true, abs=25)
        assert r.nl_lo <= r.nl <= r.nl_hi or d == 0
    # Brute force on the residuals.
    t = F.col("t")
    rows = design.withColumns({"h0": t, "h1": F.greatest(t - 10, F.lit(0.0)), "h2": F.greatest(t - 20, F.lit(0.0))})
    pdf = residuals(rows, ["y", "h0", "h1", "h2"], CELLS).toPandas()
    beta = np.linalg.lstsq(pdf[["h0_r", "h1_r", "h2_r"]].to_numpy(), pdf.y_r.to_numpy(), rcond=None)[0]
    assert got[30.0].nl == pytest.approx(np.expm1(beta @ [30, 20, 10]) * 100)
    inverse = {r.target_pct: r for r in causal.inverse_discount(curves, (10, 50, 100000)).collect()}
    assert inverse[10.0].disc_pct == 5.0 and inverse[10.0].low <= 5.0 <= inverse[10.0].high
    assert inverse[50.0].disc_pct == 15.0
    assert inverse[100000.0].disc_pct is None and inverse[100000.0].low is None


def test_singular_curve_is_solved(spark, design):
    # No depth above 10: both excess columns vanish, as in a small resample.
    shallow = settle(design.withColumn("t", F.least("t", F.lit(10.0))))
    point, _ = causal.response_curves(shallow, CELLS, reps=3)
    assert point.filter(F.isnan("nl") | F.col("nl").isNull()).count() == 0


@pytest.mark.parametrize("nuisance", [Nuisance("cells", cells=("category", "own_disc")),
                                      Nuisance("linear", controls=("m_sin", "m_cos", "own_disc"))], ids=["cells", "linear"])
def test_conformal_coverage(feats, nuisance):
    got = causal.split_conformal(feats, nuisance).first()
    assert 0.75 <= got.coverage <= 1.0 and got.halfwidth > 0


def test_conformal_brute_force(feats):
    got = causal.split_conformal(feats, Nuisance("linear", controls=("m_sin", "own_disc"))).first()
    pdf = feats.toPandas()
    months = np.sort(pdf.month.unique())
    x = np.stack([pdf.m_sin, pdf.own_disc] + [(pdf.category == c).astype(float) for c in ("C0", "C1", "C2")], 1)
    y = pdf.y.to_numpy()
    train = (pdf.month < months[-6]).to_numpy()
    test = (pdf.month >= months[-3]).to_numpy()
    beta = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
    err = np.abs(y - x @ beta)
    q = np.quantile(err[~train & ~test], 0.9)
    assert got.halfwidth == pytest.approx(q) and got.coverage == pytest.approx(np.mean(err[test] <= q))


@pytest.fixture(scope="module")
def pressure(made_panel):
    groups = made_panel.groupBy("sku").agg(F.min("grp").alias("grp")).filter("sku <> 'S07'")
    return settle(interference.substitute_pressure(made_panel, groups))


def test_leave_one_out_pressure(pressure, made_panel):
    pdf = made_panel.toPandas()
    pdf.loc[pdf.sku == "S07", "grp"] = "—"
    got = pressure.toPandas().set_index(["sku", "client", "month"]).subst_disc
    assert len(got) == len(pdf)
    for r in pdf.sample(60, random_state=1).itertuples():
        peers = pdf[(pdf.grp == r.grp) & (pdf.client == r.client) & (pdf.month == r.month) & (pdf.sku != r.sku)]
        assert got[r.sku, r.client, r.month] == pytest.approx(peers.own_disc.mean() if len(peers) else 0.0)


def test_within_effect(pressure):
    got = interference.within_effect(pressure, 50).first()
    pdf = pressure.toPandas()
    key = [pdf.sku, pdf.client]
    y = np.log1p(pdf.qty)
    x = pdf.subst_disc - pdf.subst_disc.groupby(key).transform("mean")
    assert got.theta == pytest.approx(np.polyfit(x, y - y.groupby(key).transform("mean"), 1)[0])
    assert got.lo <= got.theta <= got.hi


@pytest.mark.parametrize("by_category_month", [False, True])
def test_fixed_effects_match_dummies(pressure, by_category_month):
    thinned = settle(pressure.filter(F.pmod(F.hash("sku", "client", "month"), F.lit(4)) > 0))
    got = {r.term: r for r in interference.fixed_effects(thinned, by_category_month).collect()}
    pdf = thinned.toPandas()
    second = pdf.category + "|" + pdf.month.astype(str) if by_category_month else pdf.month.astype(str)
    cols = [pdf.subst_disc.to_numpy(float), pdf.own_disc.to_numpy(float)]
    cols += [(pdf.sku == s).to_numpy(float) for s in sorted(pdf.sku.unique())]
    cols += [(second == m).to_numpy(float) for m in sorted(second.unique())]
    X, y = np.stack(cols, 1), np.log1p(pdf.qty).to_numpy()
    rank = np.linalg.matrix_rank(X)
    pinv = np.linalg.pinv(X)
    beta = pinv @ y
    e = y - X @ beta
    bread = np.linalg.pinv(X.T @ X)
    meat = np.zeros((X.shape[1],) * 2)
    for s in pdf.sku.unique():
        m = (pdf.sku == s).to_numpy()
        u = X[m].T @ e[m]
        meat += np.outer(u, u)
    n, g = len(y), pdf.sku.nunique()
    var = np.diag(bread @ meat @ bread) * g / (g - 1) * (n - 1) / (n - rank)
    for k, term in enumerate(("subst", "own")):
        assert got[term].coef == pytest.approx(beta[k], abs=1e-8)
        assert got[term].hi - got[term].lo == pytest.approx(2 * 1.959963984540054 * np.sqrt(var[k]), rel=1e-5)
    # Positive control: a product's own discount does raise its sales.
    assert got["own"].lo > 0.02


def test_pressure_effect(pressure):
    got = interference.dml_pressure(pressure).first()
    assert abs(got.theta) < 0.02 and got.lo < got.theta < got.hi


def test_with_folds_is_stable(made_panel):
    a = with_folds(made_panel).select("sku", "client", "month", "fold")
    b = with_folds(made_panel.repartition(13)).select("sku", "client", "month", "fold")
    assert a.exceptAll(b).count() == 0

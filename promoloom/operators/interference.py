"""Do neighbours' discounts depress a product's sales?"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..columns import DEFAULTS, NO_GROUP
from ..functions.stats import Z_975
from ..storage import bounded, forget, settle
from .causal import design, effect
from .features import add_season, log_quantity
from .nuisance import Nuisance
from .resample import bootstrap_slope, cluster_moments


def substitute_pressure(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean discount of the other products of the group at the same client and month.

    The cell sums are aggregated (with map-side combine) and joined back, so a
    group holding a third of all rows is never gathered: the join splits it by
    adaptive skew handling, or needs no shuffle when the cells are few.
    """
    lookup = groups.select(F.col("sku").cast("string").alias("sku"), "grp")
    df = (panel.drop("grp").join(bounded(lookup), "sku", "left")
          .fillna({"grp": NO_GROUP}))
    cell = ["grp", "client", "month"]
    sums = df.groupBy(*cell).agg(F.sum("own_disc").alias("sum_disc"), F.count(F.lit(1)).alias("n"))
    joined = df.join(sums, cell)
    others = (F.col("sum_disc") - F.col("own_disc")) / F.nullif(F.col("n") - 1, F.lit(0))
    return joined.withColumn("subst_disc", F.coalesce(others, F.lit(0.0)))


def within_deviations(df: DataFrame) -> DataFrame:
    """Log sales and pressure minus their mean in the (sku, client) series.

    A series has one row per month, so its window is bounded by the calendar.
    """
    series = W.partitionBy("sku", "client")
    rows = df.select("sku", "client", log_quantity(F.col("qty")).alias("y"),
                     F.col("subst_disc").alias("x"))
    return rows.select("sku", (F.col("y") - F.avg("y").over(series)).alias("y_w"),
                       (F.col("x") - F.avg("x").over(series)).alias("x_w"))


def within_effect(df: DataFrame, reps: int = DEFAULTS.within_reps, seed: int = DEFAULTS.seed,
                  scheme: str = "draws") -> DataFrame:
    """Within slope with a bootstrap interval over SKUs: theta, lo, hi."""
    moments = cluster_moments(within_deviations(df), "x_w", "y_w")
    return bootstrap_slope(moments, reps, seed=seed, scheme=scheme).select("theta", "lo", "hi")


def dml_pressure(df: DataFrame, nuisance: Nuisance | None = None) -> DataFrame:
    """Cross-fitted effect of the pressure given season, own discount and category."""
    controls = nuisance or Nuisance(controls=("m_sin", "m_cos", "own_disc"))
    rows = add_season(df).withColumn("y", log_quantity(F.col("qty")))
    return effect(design(rows, controls, "subst_disc"), controls)


_VALUES = ("subst_disc", "own_disc", "y")


def fixed_effects(df: DataFrame, by_category_month: bool = False, tolerance: float = 1e-12,
                  max_steps: int = 200) -> DataFrame:
    """y on pressure and own discount with SKU and month effects, SKU-clustered errors.

    Returns term, coef, lo, hi.  With ``by_category_month`` the second effect
    is category x month.  The second effects solve normal equations whose
    matrix is never built: each conjugate-gradient step is one pass over a
    table of (sku, second effect) sums, for pressure, discount and y at once.  The
    vectors are tables; a step's few dot products come with the job that writes it.
    """
    label = F.date_format("month", "yyyy-MM-dd")
    if by_category_month:
        label = F.concat_ws("|", "category", label)
    rows = df.withColumn("y", log_quantity(F.col("qty"))).select("sku", label.alias("fe2"), *_VALUES)
    rows = settle(rows)
    cells = (rows.groupBy("sku", "fe2")
             .agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(v).alias(v) for v in _VALUES]))
    # Kept hash-partitioned by SKU, so the per-SKU windows below never shuffle.
    cells = settle(cells).repartition("sku").persist()
    table = _second_effects(cells, tolerance, max_steps)
    levels = table.count()
    clean = rows.join(table, "fe2").select(
        "sku", *[(F.col(v) - F.col(f"x{i}")).alias(f"z{i}") for i, v in enumerate(_VALUES)])
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = clean.groupBy("sku").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(3)],
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in pairs])
    # Deviations from the SKU mean: sums of products less the product of sums.
    own = settle(sums.select("sku", "n", *[
        (F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"q{i}{j}")
        for i, j in pairs]))
    linked = _components(cells)
    cells.unpersist()
    tot = own.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"),
                  *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in pairs]).first()
    gram = np.array([[tot["q00"], tot["q01"]], [tot["q01"], tot["q11"]]])
    target = np.array([tot["q02"], tot["q12"]])
    # A term that the effects explain fully has no coefficient.
    seen = [k for k in range(2) if gram[k, k] > 1e-9 * max(tot["n"], 1)]
    beta = np.zeros(2)
    beta[seen] = np.linalg.lstsq(gram[np.ix_(seen, seen)], target[seen], rcond=None)[0]
    b0, b1 = map(float, beta)
    u0 = F.col("q02") - F.lit(b0) * F.col("q00") - F.lit(b1) * F.col("q01")
    u1 = F.col("q12") - F.lit(b0) * F.col("q01") - F.lit(b1) * F.col("q11")
    m = own.select(u0.alias("u0"), u1.alias("u1")).agg(
        F.sum(F.col("u0") * F.col("u0")).alias("m00"), F.sum(F.col("u0") * F.col("u1")).alias("m01"),
        F.sum(F.col("u1") * F.col("u1")).alias("m11")).first()
    meat = np.array([[m["m00"], m["m01"]], [m["m01"], m["m11"]]])[np.ix_(seen, seen)]
    bread = np.linalg.pinv(gram[np.ix_(seen, seen)])
    rank = tot["g"] + levels - linked + len(seen)
    scale = tot["g"] / (tot["g"] - 1) * (tot["n"] - 1) / (tot["n"] - rank)
    half = dict(zip(seen, Z_975 * np.sqrt(np.clip(np.diag(bread @ meat @ bread) * scale, 0, None))))
    out = [(term, float(beta[k]), float(beta[k] - half[k]), float(beta[k] + half[k])) if k in half
           else (term, None, None, None) for k, term in enumerate(("subst", "own"))]
    return df.sparkSession.createDataFrame(out, "term string, coef double, lo double, hi double")


def _written(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, float]]:
    """A table written once, and sums over its rows from the same job."""
    seen = Observation()
    out = settle(df.observe(seen, *[F.sum(c).alias(n) for n, c in sums.items()]))
    return out, {n: v or 0.0 for n, v in seen.get.items()}


def _components(cells: DataFrame) -> int:
    """Redundant second effects: one per set of SKUs linked through shared levels.

    Every level takes the least name among the levels that share a SKU with it,
    until none changes.
    """
    least = F.min("name").over(W.partitionBy("sku"))
    names, changed = cells.select("fe2", F.col("fe2").alias("name")).distinct(), {"n": 1}
    while changed["n"]:
        met = cells.select("sku", "fe2").join(names, "fe2").withColumn("low", least)
        low = met.groupBy("fe2").agg(F.min("low").alias("new"), F.min("name").alias("old"))
        low, changed = _written(low, n=(F.col("new") != F.col("old")).cast("int"))
        names = low.select("fe2", F.col("new").alias("name"))
    return names.select("name").distinct().count()


def _second_effects(cells: DataFrame, tolerance: float, max_steps: int) -> DataFrame:
    """``fe2``, ``x0``, ``x1``, ``x2``: second-way effects of the three values after taking out SKU means.

    Conjugate gradients, preconditioned by the levels' sizes, on three right-hand
    sides side by side; each has its own step lengths.
    """
    ks = range(len(_VALUES))
    sku = W.partitionBy("sku")

    def centred(of: DataFrame, totals: list[Column], name: str) -> DataFrame:
        """Per level: sums over rows of (value - SKU mean of value), from cell sums."""
        n = F.sum("n").over(sku)
        apart = of.select("fe2", "n", *[(t - F.col("n") * F.sum(t).over(sku) / n).alias(f"{name}{k}") for k, t in enumerate(totals)])
        return apart.groupBy("fe2").agg(F.sum("n").alias("d"), *[F.sum(f"{name}{k}").alias(f"{name}{k}") for k in ks])

    def over_d(a: str, b: str) -> Column:
        return F.col(a) * F.col(b) / F.col("d")

    start = centred(cells, [F.col(v) for v in _VALUES], "r")
    state, rz = _written(start.select("fe2", "d", *[F.lit(0.0).alias(f"x{k}") for k in ks], *[f"r{k}" for k in ks],
                                      *[(F.col(f"r{k}") / F.col("d")).alias(f"p{k}") for k in ks]),
                         **{f"rz{k}": over_d(f"r{k}", f"r{k}") for k in ks})
    held, rz = state, [rz[f"rz{k}"] for k in ks]
    stop = [tolerance * max(v, 1e-300) for v in rz]
    for _ in range(max_steps):
        if all(v <= s for v, s in zip(rz, stop)):
            break
        met = cells.select("sku", "fe2", "n").join(state.select("fe2", *[f"p{k}" for k in ks]), "fe2")
        ap = centred(met, [F.col("n") * F.col(f"p{k}") for k in ks], "a").drop("d")
        last, (state, dots) = held, _written(state.join(ap, "fe2"), **{
            name: c for k in ks for name, c in ((f"pa{k}", F.col(f"p{k}") * F.col(f"a{k}")), (f"rr{k}", over_d(f"r{k}", f"r{k}")),
                                                (f"ra{k}", over_d(f"r{k}", f"a{k}")), (f"aa{k}", over_d(f"a{k}", f"a{k}")))})
        forget(last)
        held = state
        # A solved right-hand side stands still.
        alpha = [rz[k] / dots[f"pa{k}"] if rz[k] > stop[k] and dots[f"pa{k}"] else 0.0 for k in ks]
        new = [max(dots[f"rr{k}"] - 2 * alpha[k] * dots[f"ra{k}"] + alpha[k] ** 2 * dots[f"aa{k}"], 0.0) if alpha[k] else rz[k] for k in ks]
        beta = [new[k] / rz[k] if alpha[k] else 0.0 for k in ks]
        left = [F.col(f"r{k}") - F.lit(alpha[k]) * F.col(f"a{k}") for k in ks]
        state = state.select("fe2", "d", *[(F.col(f"x{k}") + F.lit(alpha[k]) * F.col(f"p{k}")).alias(f"x{k}") for k in ks],
                             *[left[k].alias(f"r{k}") for k in ks],
                             *[(left[k] / F.col("d") + F.lit(beta[k]) * F.col(f"p{k}")).alias(f"p{k}") for k in ks])
        rz = new
    if any(v > s for v, s in zip(rz, stop)):
        raise RuntimeError(f"fixed effects: no convergence in {max_steps} steps, squared residuals {rz} above {stop}; raise max_steps")
    out = settle(state.select("fe2", *[f"x{k}" for k in ks]))
    forget(held)
    return out

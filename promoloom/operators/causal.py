"""Effect of discount depth on log sales: cross-fitted partialling out and what follows."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULTS
from ..functions.hashing import hash60, panel_key
from ..functions.stats import percent_effect
from ..storage import attach, bounded, join_null_safe, settle
from .nuisance import Nuisance, residuals, solve_rows, with_folds
from .numbering import global_rank
from .quantiles import exact_quantile
from .resample import bootstrap_slope, bootstrap_sums, cluster_moments, cluster_slope


def design(features: DataFrame, nuisance: Nuisance, treatment: str = "own_disc",
           folds: int = DEFAULTS.folds, seed: int = DEFAULTS.seed,
           extra: list[str] | None = None) -> DataFrame:
    """Key, target ``y``, treatment ``t``, controls and fold; written once, read by each pass."""
    keep = dict.fromkeys(["sku", "client", "month", "category", *nuisance.columns(), *(extra or [])])
    rows = features.select(*keep, "y", F.col(treatment).cast("double").alias("t"))
    return settle(with_folds(rows, folds, seed))


def effect_moments(rows: DataFrame, nuisance: Nuisance, by: list[str] | None = None,
                   cluster: str = "sku") -> DataFrame:
    """Per-cluster sums of the residuals of ``t`` (x) and ``y``."""
    left = residuals(rows, ["y", "t"], nuisance, by)
    return cluster_moments(left, "t_r", "y_r", cluster, by)


def effect(rows: DataFrame, nuisance: Nuisance, errors: str = "cluster",
           reps: int = DEFAULTS.boot_reps) -> DataFrame:
    """One row theta, se, p, lo, hi; ``errors='bootstrap'`` resamples clusters (p is null)."""
    moments = effect_moments(rows, nuisance)
    if errors == "cluster":
        return cluster_slope(moments)
    boot = bootstrap_slope(moments, reps)
    return boot.select("theta", "se", F.lit(None).cast("double").alias("p"), "lo", "hi")


def treated_share(rows: DataFrame, treatment: str = "t") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"),
                    F.avg((F.col(treatment) > 0).cast("int")).alias("treated_share"))


def supported(rows: DataFrame, min_rows: int = DEFAULTS.min_rows,
              min_treated: int = DEFAULTS.min_treated) -> DataFrame:
    """Categories with enough rows and enough treated rows."""
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("_n"),
                                          F.count_if(F.col("t") > 0).alias("_treated"))
    return counts.filter((F.col("_n") >= min_rows) & (F.col("_treated") >= min_treated)).select("category")


def effect_by_category(rows: DataFrame, nuisance: Nuisance, min_rows: int = DEFAULTS.min_rows,
                       min_treated: int = DEFAULTS.min_treated) -> DataFrame:
    """category, theta, lo, hi of every supported category, fitted on its own rows."""
    enough = rows.join(bounded(supported(rows, min_rows, min_treated)), "category", "left_semi")
    inner = replace(nuisance, labels=tuple(c for c in nuisance.labels if c != "category"))
    moments = effect_moments(enough, inner, ["category"])
    return cluster_slope(moments, ["category"]).select("category", "theta", "lo", "hi")


def strongest(effects: DataFrame, k: int = 8) -> DataFrame:
    return effects.orderBy(F.desc("theta"), "category").limit(k)


def hinge(t: Column, knots: tuple[int, ...] = DEFAULTS.hinge_knots) -> list[Column]:
    """Piecewise-linear basis: t and its excess over each knot."""
    return [t.cast("double")] + [F.greatest(t - F.lit(float(k)), F.lit(0.0)) for k in knots]


def _curve_moments(rows: DataFrame, nuisance: Nuisance, knots: tuple[int, ...]) -> DataFrame:
    basis = [f"h{i}" for i in range(len(knots) + 1)]
    spread = rows.withColumns(dict(zip(basis, hinge(F.col("t"), knots))))
    left = residuals(spread, ["y", *basis], nuisance)
    sums = [F.sum(F.col(f"{a}_r") * F.col(f"{b}_r")).alias(f"g_{a}_{b}")
            for i, a in enumerate(basis) for b in basis[i:]]
    sums += [F.sum(F.col(f"{a}_r") * F.col("y_r")).alias(f"r_{a}") for a in basis]
    return settle(left.groupBy("sku").agg(*sums))


def _curve_values(sums: DataFrame, keys: list[str], p: int, knots: tuple[int, ...],
                  grid: tuple[int, ...]) -> DataFrame:
    """Solve each row's normal equations and evaluate the curve on the grid."""
    def g(i: int, j: int) -> Column:
        return F.col(f"g_h{min(i, j)}_h{max(i, j)}")

    packed = sums.select(*keys, F.array(*[g(i, j) for i in range(p) for j in range(p)]).alias("_a"),
                         F.array(*[F.col(f"r_h{i}") for i in range(p)]).alias("_b"))
    beta = solve_rows(packed, "_a", "_b", p, 1)
    points = beta.select(*keys, "_beta", F.explode(F.array(*[F.lit(float(d)) for d in grid])).alias("grid"))
    basis = hinge(F.col("grid"), knots)
    line = reduce(Column.__add__, [F.col("_beta")[i] * basis[i] for i in range(p)])
    return points.select(*keys, "grid", percent_effect(line, F.lit(1.0)).alias("nl"))


def response_curves(rows: DataFrame, nuisance: Nuisance, reps: int = DEFAULTS.boot_reps,
                    grid: tuple[int, ...] = DEFAULTS.curve_grid,
                    knots: tuple[int, ...] = DEFAULTS.hinge_knots,
                    scheme: str = "draws") -> tuple[DataFrame, DataFrame]:
    """Percent change per grid depth: the point curve (grid, nl) and the replicates (rep, grid, nl)."""
    moments = _curve_moments(rows, nuisance, knots)
    columns = [c for c in moments.columns if c != "sku"]
    p = len(knots) + 1
    point = _curve_values(moments.agg(*[F.sum(c).alias(c) for c in columns]), [], p, knots, grid)
    drawn = bootstrap_sums(moments, columns, reps, scheme=scheme)
    return settle(point), settle(_curve_values(drawn, ["rep"], p, knots, grid))


def dose_response(effect_row: DataFrame, curves: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Linear and piecewise curves with 95 % bands per grid depth."""
    point, boot = curves
    band = boot.groupBy("grid").agg(F.percentile("nl", F.array(F.lit(0.025), F.lit(0.975))).alias("_b"))
    joined = attach(point.join(bounded(band), "grid"), effect_row.select("theta", "lo", "hi"), [])
    d = F.col("grid")
    return joined.select("grid", percent_effect(F.col("theta"), d).alias("lin"),
                         percent_effect(F.col("lo"), d).alias("lin_lo"),
                         percent_effect(F.col("hi"), d).alias("lin_hi"), "nl",
                         F.col("_b")[0].alias("nl_lo"), F.col("_b")[1].alias("nl_hi"))


def inverse_discount(curves: tuple[DataFrame, DataFrame],
                     targets: tuple[int, ...] = DEFAULTS.inverse_targets) -> DataFrame:
    """Smallest grid depth reaching each target, with a 10-90 % band over replicates."""
    point, boot = curves
    goals = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_pct")

    def reached(curve: DataFrame, keys: list[str]) -> DataFrame:
        return (curve.select(*keys, "grid", "nl", goals).groupBy(*keys, "target_pct")
                .agg(F.min(F.when(F.col("nl") >= F.col("target_pct"), F.col("grid"))).alias("disc_pct")))

    band = (reached(boot, ["rep"]).groupBy("target_pct")
            .agg(F.percentile("disc_pct", F.array(F.lit(0.1), F.lit(0.9))).alias("_b"))
            .select("target_pct", F.col("_b")[0].alias("low"), F.col("_b")[1].alias("high")))
    return reached(point, []).join(bounded(band), "target_pct", "left")


def split_conformal(features: DataFrame, nuisance: Nuisance, test_months: int = DEFAULTS.test_months,
                    level: float = 0.9) -> DataFrame:
    """Coverage on the last months of an interval calibrated on the months before.

    The outcome model sees the controls and the treatment; its half width is
    the ``level`` quantile of absolute errors in the calibration months.
    """
    # The calendar is short; all its months fit one row.
    months = features.agg(F.sort_array(F.collect_set("month"), asc=False).alias("m")).first()["m"]
    if len(months) < 2 * test_months:
        raise ValueError(f"{len(months)} months are too few for {test_months} test and {test_months} calibration months")
    test_from, cal_from = months[test_months - 1], months[2 * test_months - 1]
    keep = list(dict.fromkeys([*nuisance.columns(), "own_disc"]))
    part = F.when(F.col("month") >= F.lit(test_from), 2).when(F.col("month") >= F.lit(cal_from), 1).otherwise(0)
    # Held-out months are one fold: everything outside it is the training part.
    rows = settle(features.select(*keep, "y", part.alias("part"), (part > 0).cast("int").alias("fold")))
    errors = settle(residuals(rows, ["y"], nuisance, only_fold=1)
                    .select("part", F.abs("y_r").alias("err")))
    width = exact_quantile(errors.filter(F.col("part") == 1), "err", level, name="halfwidth")
    test = attach(errors.filter(F.col("part") == 2), width, [])
    return test.agg(F.avg((F.col("err") <= F.col("halfwidth")).cast("int")).alias("coverage"),
                    F.first("halfwidth").alias("halfwidth"))


def permute(rows: DataFrame, column: str, seed: int = DEFAULTS.seed,
            by: list[str] | None = None) -> DataFrame:
    """Shuffle ``column`` over the rows (within ``by`` groups when given).

    The value at each place of a seeded hash order moves to the row at the same
    place of the key order; both orders are range-partitioned.
    """
    by = list(by or [])
    order = [F.col("sku"), F.col("client"), F.col("month")]
    others = [c for c in rows.columns if c != column]
    targets = global_rank(rows.select(*others), order, by, "_at")
    shuffled = rows.select(*dict.fromkeys([*by, "sku", "client", "month"]), column,
                           hash60(panel_key(), F.lit(seed), F.lit("permute")).alias("_h"))
    values = global_rank(shuffled, [F.col("_h"), *order], by, "_at").select(*by, "_at", column)
    return join_null_safe(targets, values.select(*by, "_at", column), [*by, "_at"]).select(*rows.columns)


def placebo(rows: DataFrame, nuisance: Nuisance, seed: int = DEFAULTS.seed,
            by: list[str] | None = None) -> DataFrame:
    """The effect after permuting the treatment; theta should be near zero."""
    return effect(settle(permute(rows, "t", seed, by)), nuisance).select("theta", "lo", "hi")

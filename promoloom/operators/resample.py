"""Slopes, cluster-robust errors and cluster bootstraps from per-cluster sums.

Rows are read once, into one small row of sums per cluster.  Errors and every
bootstrap replicate are then weighted sums of those rows; data rows are never
drawn or copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULTS
from ..functions.hashing import hash60, hash_uniform, poisson1
from ..functions.stats import Z_975, normal_two_sided_p
from ..storage import attach, bounded, settle, spread
from .numbering import global_rank

SUMS = ("n", "sx", "sy", "sxx", "sxy")


def cluster_moments(df: DataFrame, x: str, y: str, cluster: str = "sku",
                    by: list[str] | None = None) -> DataFrame:
    """Sums of 1, x, y, x*x and x*y per cluster, written once."""
    # Only rows that have both values count; a filter in front would compute costly values twice.
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return settle(df.groupBy(*(by or []), cluster).agg(
        F.count_if(both).cast("double").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"),
        F.sum(a * F.col(x)).alias("sxx"), F.sum(a * F.col(y)).alias("sxy")).filter("n > 0"))


def _slope(n, sx, sy, sxx, sxy):
    return (sxy - sx * sy / n) / F.nullif(sxx - sx * sx / n, F.lit(0.0))


def cluster_slope(moments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Slope of y on x with intercept; cluster-robust se, normal p and 95 % interval."""
    by = list(by or [])
    total = moments.groupBy(*by).agg(*[F.sum(c).alias(f"_{c}") for c in SUMS],
                                     F.count(F.lit(1)).alias("_g"))
    n, sx, sy, sxx, sxy = (F.col(f"_{c}") for c in SUMS)
    line = (total.withColumn("theta", _slope(n, sx, sy, sxx, sxy))
            .withColumn("_mean", sx / n)
            .withColumn("_icpt", (sy - F.col("theta") * sx) / n)
            .withColumn("_spread", sxx - sx * sx / n)
            .select(*by, "theta", "_mean", "_icpt", "_spread", "_n", "_g"))
    # Score of a cluster: sum of (x - mean) * residual over its rows.
    score = (F.col("sxy") - F.col("_icpt") * F.col("sx") - F.col("theta") * F.col("sxx")
             - F.col("_mean") * (F.col("sy") - F.col("_icpt") * F.col("n")
                                 - F.col("theta") * F.col("sx")))
    kept = ["theta", "_spread", "_n", "_g"]
    out = (attach(moments, line, by).withColumn("_score", score).groupBy(*by)
           .agg(F.sum(F.col("_score") * F.col("_score")).alias("_meat"),
                *[F.first(c).alias(c) for c in kept]))
    g, rows = F.col("_g"), F.col("_n")
    correction = g / F.nullif(g - 1, F.lit(0)) * (rows - 1) / F.nullif(rows - 2, F.lit(0.0))
    se = F.sqrt(F.col("_meat") * correction) / F.col("_spread")
    out = out.withColumn("se", se)
    return out.select(*by, "theta", "se",
                      normal_two_sided_p(F.col("theta") / F.col("se")).alias("p"),
                      (F.col("theta") - F.lit(Z_975) * F.col("se")).alias("lo"),
                      (F.col("theta") + F.lit(Z_975) * F.col("se")).alias("hi"))


def bootstrap_sums(moments: DataFrame, columns: list[str], reps: int, cluster: str = "sku",
                   by: list[str] | None = None, seed: int = DEFAULTS.seed,
                   scheme: str = "draws") -> DataFrame:
    """Per replicate, the sums of ``columns`` over resampled clusters.

    ``draws`` takes as many clusters as there are, with replacement, so each
    cluster row makes one seeded draw per replicate and looks up the drawn row.
    ``poisson`` weights each cluster by an independent Poisson(1) number: no
    numbering and no join, for very many clusters.
    """
    by = list(by or [])
    replicate = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    if scheme == "poisson":
        weighted = (moments.select(*by, cluster, *columns, replicate)
                    .withColumn("_w", poisson1(hash_uniform(F.col("rep"), F.col(cluster), F.lit(seed)))))
        return weighted.groupBy(*by, "rep").agg(*[F.sum(F.col("_w") * F.col(c)).alias(c)
                                                  for c in columns])
    if scheme != "draws":
        raise ValueError(f"unknown scheme {scheme!r}")
    numbered = global_rank(moments.select(*by, cluster, *columns), [F.col(cluster)], by, "_at")
    size = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_g"))
    placed = spread(attach(numbered.select(*by, "_at"), size, by), reps, *by, "_at")
    draws = placed.select(*by, "_at", "_g", replicate)
    picked = F.pmod(hash60(F.col("rep"), F.col("_at"), F.lit(seed)), F.col("_g")) + F.lit(1)
    draws = draws.select(*by, "rep", picked.alias("_at"))
    clusters = bounded(numbered)
    # Clusters beyond the bound meet their draws by shuffle; neither side is broadcast.
    drawn = (draws.hint("merge") if clusters is numbered else draws).join(clusters, [*by, "_at"])
    return drawn.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in columns])


def bootstrap_slopes(moments: DataFrame, reps: int, cluster: str = "sku",
                     by: list[str] | None = None, seed: int = DEFAULTS.seed,
                     scheme: str = "draws") -> DataFrame:
    """Slope of every replicate."""
    sums = bootstrap_sums(moments, list(SUMS), reps, cluster, by, seed, scheme)
    return sums.select(*(by or []), "rep", _slope(*[F.col(c) for c in SUMS]).alias("theta"))


def bootstrap_slope(moments: DataFrame, reps: int = DEFAULTS.boot_reps, cluster: str = "sku",
                    by: list[str] | None = None, seed: int = DEFAULTS.seed,
                    scheme: str = "draws") -> DataFrame:
    """Point slope, spread over replicates and 95 % percentile interval."""
    by = list(by or [])
    totals = moments.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])
    point = totals.select(*by, _slope(*[F.col(c) for c in SUMS]).alias("theta"))
    slopes = bootstrap_slopes(moments, reps, cluster, by, seed, scheme)
    # At most ``reps`` numbers per group.
    spread = slopes.groupBy(*by).agg(F.stddev_pop("theta").alias("se"),
                                     F.percentile("theta", F.array(F.lit(0.025), F.lit(0.975))).alias("_b"))
    spread = spread.select(*by, "se", F.col("_b")[0].alias("lo"), F.col("_b")[1].alias("hi"))
    return attach(spread, point, by).select(*by, "theta", "se", "lo", "hi")

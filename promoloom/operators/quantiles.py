"""Exact quantiles of groups of any size.

``percentile`` holds a whole group's values in one task.  Here a sketch only
brackets the wanted ranks, counts in bins narrow the bracket until at most
``INSIDE`` rows are in it, and exact counts below the bracket and the values
inside it give the answer.  So no task holds more of a group than that, however
large the group is; rows that repeat a value are one counted row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import bounded, join_null_safe, settle
from .numbering import running_total

ACCURACY = 10_000
#: Rows of a group that one task ranks, and bins of a narrowing step.
INSIDE, BINS = 100_000, 1_024


def exact_quantile(df: DataFrame, value: str, q: float, by: list[str] | None = None,
                   name: str = "quantile", accuracy: int = ACCURACY, inside: int = INSIDE) -> DataFrame:
    """Linear-interpolated quantile per group; nulls and null groups are dropped.

    ``df`` is read three times (bracket, its size, exact counts) and once more
    for each narrowing: settle it first when it is costly.
    """
    by = list(by or [])
    marker = by or ["_all"]
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    for b in by:
        rows = rows.filter(F.col(b).isNotNull())
    if not by:
        rows = rows.withColumn("_all", F.lit(0))

    slack = 2.0 / accuracy
    # The sketch errs by at most 1/accuracy of the group's ranks, so this bracket
    # holds the wanted ones; a miss would raise below, never pass unseen.  A group
    # no longer than the accuracy is its own bracket.
    sketch = rows.groupBy(*marker).agg(
        F.percentile_approx("_v", [max(q - slack, 0.0), min(q + slack, 1.0)], accuracy).alias("_b"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.count(F.lit(1)).alias("_total"))
    sketch = sketch.select(
        *marker, "_total",
        F.when((F.col("_total") <= accuracy) | F.lit(q - slack <= 0), F.col("_min")).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when((F.col("_total") <= accuracy) | F.lit(q + slack >= 1), F.col("_max")).otherwise(F.col("_b")[1]).alias("_hi"),
        ((F.col("_total") - 1) * F.lit(q)).alias("_pos"))
    near = rows.join(bounded(_narrowed(rows, settle(sketch), marker, inside)), marker).filter(F.col("_v") <= F.col("_hi"))
    # Everything below the bracket travels as one counted row, and so do repeats.
    near = (near.withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
            .groupBy(*marker, "_v", "_pos").agg(F.count(F.lit(1)).alias("_n")))
    run = W.partitionBy(*marker).orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0)
    counted = (near.withColumn("_end", F.sum("_n").over(run))
               .withColumn("_start", F.col("_end") - F.col("_n")))
    low, high = F.floor("_pos"), F.ceil("_pos")
    at = counted.groupBy(*marker).agg(
        F.first("_pos").alias("_pos"),
        F.max(F.when((F.col("_start") <= low) & (low < F.col("_end")), F.col("_v"))).alias("_vl"),
        F.max(F.when((F.col("_start") <= high) & (high < F.col("_end")), F.col("_v"))).alias("_vh"))
    frac = F.col("_pos") - F.floor("_pos")
    value_at = F.col("_vl") + (F.col("_vh") - F.col("_vl")) * frac
    missed = F.col("_vl").isNull() | F.col("_vh").isNull()
    checked = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
    return at.select(*by, checked.otherwise(value_at).alias(name))


def group_quantiles(df: DataFrame, value: str, q: float, by: list[str], name: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile of each group, for many groups of any sizes in one pass.

    Equal values of a group become one counted row before anything moves; the
    counted rows are dealt out by (group, value), so that a huge group is many
    tasks' work, and running counts say which values hold the wanted ranks.
    Null values are dropped, and groups that have no others.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counted = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ended = running_total(counted, [F.asc("_v")], by, "_n", "_end").withColumn("_start", F.col("_end") - F.col("_n"))
    totals = rows.groupBy(*by).agg((F.lit(q) * (F.count(F.lit(1)) - 1)).alias("_pos"))
    low, high = F.floor("_pos"), F.ceil("_pos")
    holds = lambda rank: (F.col("_start") <= rank) & (rank < F.col("_end"))
    met = join_null_safe(ended, totals, by).filter(holds(low) | holds(high))
    at = met.groupBy(*by).agg(F.first("_pos").alias("_pos"), F.max(F.when(holds(low), F.col("_v"))).alias("_vl"),
                              F.max(F.when(holds(high), F.col("_v"))).alias("_vh"))
    return at.select(*by, (F.col("_vl") + (F.col("_vh") - F.col("_vl")) * (F.col("_pos") - F.floor("_pos"))).alias(name))


def _narrowed(rows: DataFrame, bracket: DataFrame, marker: list[str], inside: int) -> DataFrame:
    """The bracket with at most ``inside`` rows a group between its ends, or one value."""
    while True:
        met = rows.join(bounded(bracket), marker)
        held = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        wide = met.groupBy(*marker).agg(F.count_if(held).alias("_held"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        if wide.filter((F.col("_held") > inside) & (F.col("_lo") < F.col("_hi"))).isEmpty():
            return bracket
        # Rows below the bracket are bin -1; rows above it don't matter.
        width = (F.col("_hi") - F.col("_lo")) / BINS
        cell = F.when(F.col("_v") < F.col("_lo"), -1).when(width <= 0, 0).otherwise(
            F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / width)))
        bins = (met.filter("_v <= _hi").withColumn("_bin", cell.cast("int")).groupBy(*marker, "_bin", "_pos", "_total")
                .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
        run = W.partitionBy(*marker).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
        placed = bins.withColumn("_end", F.sum("_n").over(run)).withColumn("_start", F.col("_end") - F.col("_n"))

        def at(rank, end: str):
            return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")) & (F.col("_bin") >= 0), F.col(end)))

        bracket = settle(placed.groupBy(*marker, "_total", "_pos").agg(
            at(F.floor("_pos"), "_low").alias("_lo"), at(F.ceil("_pos"), "_high").alias("_hi"))
            .select(*marker, "_total", "_lo", "_hi", "_pos"))

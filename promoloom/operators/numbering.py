"""Exact ranks and dense numbers without sorting anything in one task.

Rows are range-partitioned on the order, each partition numbers its own rows,
and the partitions' counts (one small row per partition and group) give the
offsets.  A group that holds a third of all rows simply spans more partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import join_null_safe, settle


def global_rank(df: DataFrame, order: list[Column], by: list[str] | None = None,
                name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in its ``by`` group under ``order``.

    ``order`` must be a total order inside a group.
    """
    by = list(by or [])
    keys = [F.col(b).asc() for b in by] + list(order)
    placed = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = settle(placed).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"),
                                            F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = (runs.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .drop("_n"))
    rank = F.col("_at") - F.col("_first") + F.col("_skip") + F.lit(1)
    joined = join_null_safe(placed, runs, [*by, "_part"])
    return joined.select(*df.columns, rank.cast("bigint").alias(name))


def running_total(df: DataFrame, order: list[Column], by: list[str], value: str, name: str = "total") -> DataFrame:
    """Add the sum of ``value`` up to each row, itself included, in its ``by`` group under the total ``order``.

    As in ``global_rank``, a task sums its own partition of a range partitioning.
    """
    keys = [F.col(b).asc() for b in by] + list(order)
    placed = settle(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_held"))
    runs = runs.withColumn("_skip", F.coalesce(F.sum("_held").over(before), F.lit(0))).drop("_held")
    own = placed.withColumn(name, F.sum(value).over(inside))
    return join_null_safe(own, runs, [*by, "_part"]).select(*df.columns, (F.col(name) + F.col("_skip")).alias(name))


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add 0-based consecutive numbers under a total ``order``."""
    return global_rank(df, order, name=name).withColumn(name, F.col(name) - F.lit(1))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int,
                  name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark cuts each partition to ``k`` before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= k)

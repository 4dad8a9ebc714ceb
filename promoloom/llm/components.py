"""Connected components of a link table, in rounds of grouping and joining.

Large-star and small-star steps (Kiveris et al., 2014) rewrite the links until
every node points at the smallest node it can reach.  Links stay in DataFrames;
only their number and a sum of their hashes reach the driver, with the job that
writes them: a round that leaves both alone has changed nothing.  A hub's links are reduced map-side before its
minimum is shuffled, and joins on hubs are split by adaptive execution.  A round over few links
has few tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import settle

#: Links of a partition; that few need no exchange.
PART_LINKS = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every linked node.

    Links have no direction; repeated links and self-links are harmless, links
    with a null end are ignored.  No links give no rows.
    """
    x, y = F.col(a), F.col(b)
    edges, state = _written(links.filter(x.isNotNull() & y.isNotNull() & (x != y))
                            .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    before = None
    while state["n"] and state != before:
        before = state
        few = state["n"] <= PART_LINKS
        edges, state = _written(_small_star(_large_star(edges, few), few))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Links written to the shared folder, their number and the sum of their hashes."""
    seen = Observation()
    code = F.xxhash64("u", "v").cast("decimal(38,0)")
    out = settle(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(code).alias("code")))
    return out, seen.get


def _near(df: DataFrame, few: bool) -> DataFrame:
    """Few links stay in one partition, where groups and joins need no exchange."""
    return df.coalesce(1) if few else df


def _large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Every greater neighbour of a node points at the smallest of its neighbourhood.

    A link's greater end is the only one that its smaller end moves, and a node
    without smaller neighbours is itself the smallest.
    """
    edges = _near(edges, few)
    low = edges.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "node")
    return (edges.join(low, F.col("v") == F.col("node"), "left")
            .select("u", F.coalesce("low", "v").alias("v")).distinct())


def _small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """A node and its smaller neighbours point at the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = low.select("u", F.col("low").alias("v"))
    return _near(moved.unionByName(own).filter("u != v"), few).distinct()

"""Monthly product x client panel and the product catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..columns import DESCRIPTORS, PANEL_KEY, UNKNOWN_CATEGORY
from ..functions.clean import month, number
from ..sources.extracts import union_facts
from .numbering import dense_index


def modal_attributes(df: DataFrame, keys: list[str], attributes: list[str],
                     total: tuple[Column, str] | None = None) -> DataFrame:
    """Most frequent non-null text of each attribute per key (smallest on ties).

    Rows first shrink to distinct (key, attributes) combinations with counts, a
    plain hash aggregate with map-side combine, so a key with a third of all
    rows moves as a few rows.  One shuffle on the keys then serves every
    attribute's counting window and the final aggregate.
    """
    sums = [F.count(F.lit(1)).alias("_n")]
    if total is not None:
        sums.append(F.sum(total[0]).alias("_sum"))
    tuples = df.groupBy(*keys, *[F.col(a).cast("string").alias(a) for a in attributes]).agg(*sums)
    tuples = tuples.repartition(*keys)
    for a in attributes:
        votes = F.sum("_n").over(W.partitionBy(*keys, a))
        tuples = tuples.withColumn(f"_vote_{a}",
                                   F.when(F.col(a).isNotNull(), F.struct((-votes).alias("n"), a)))
    picks = [F.min(f"_vote_{a}").getField(a).alias(a) for a in attributes]
    if total is not None:
        picks.insert(0, F.sum("_sum").alias(total[1]))
    return tuples.groupBy(*keys).agg(*picks)


def monthly_sales(sales: DataFrame, qty_name: str = "qty") -> DataFrame:
    """Quantity and modal descriptors per (sku, client, month); null keys drop."""
    attributes = [c for c in DESCRIPTORS if c in sales.columns]
    rows = sales.select(F.col("sku").cast("string").alias("sku"),
                        F.col("client").cast("string").alias("client"),
                        month(sales, "date").alias("month"),
                        F.coalesce(number(sales, "qty"), F.lit(0.0)).alias("_qty"), *attributes)
    rows = rows.dropna(subset=list(PANEL_KEY))
    return modal_attributes(rows, list(PANEL_KEY), attributes, (F.col("_qty"), qty_name))


def monthly_discounts(discounts: DataFrame) -> DataFrame:
    """Deepest, mean and number of positive weekly discounts per (sku, client, month)."""
    depth = F.coalesce(number(discounts, "disc_pct"), F.lit(0.0))
    rows = discounts.select(F.col("sku").cast("string").alias("sku"),
                            F.col("client").cast("string").alias("client"),
                            month(discounts, "week_start").alias("month"), depth.alias("_d"))
    return (rows.dropna(subset=list(PANEL_KEY)).groupBy(*PANEL_KEY)
            .agg(F.max("_d").alias("own_disc"), F.avg("_d").alias("promo_disc_mean"),
                 F.count_if(F.col("_d") > 0).alias("promo_weeks")))


def build_panel(sales: DataFrame, discounts: DataFrame) -> DataFrame:
    """Monthly sales with the month's own discount; returns never go below zero.

    Both sides are aggregated on the panel key, so the join adds no shuffle.
    """
    sold = monthly_sales(sales).withColumn("qty", F.greatest("qty", F.lit(0.0)))
    panel = (sold.join(monthly_discounts(discounts), list(PANEL_KEY), "left")
             .fillna({"own_disc": 0.0, "promo_disc_mean": 0.0, "promo_weeks": 0}))
    if "category" not in panel.columns:
        return panel.withColumn("category", F.lit(UNKNOWN_CATEGORY))
    return panel.fillna({"category": UNKNOWN_CATEGORY})


def build_catalog(sales: DataFrame | None = None, promo: DataFrame | None = None) -> DataFrame:
    """One row per product name with modal descriptors and a dense ``doc_id`` in SKU order."""
    facts = union_facts(*[f if f is None else f.select(*[c for c in ("sku", *DESCRIPTORS)
                                                         if c in f.columns])
                          for f in (sales, promo)])
    rows = facts.withColumn("sku", F.col("sku").cast("string")).dropna(subset=["sku", "name"])
    attributes = [c for c in DESCRIPTORS if c in rows.columns]
    items = (modal_attributes(rows, ["sku"], attributes)
             .withColumn("name", F.trim("name")))
    # Of several SKUs with one name the lowest stays; min combines map-side.
    others = [c for c in items.columns if c not in ("sku", "name")]
    items = (items.groupBy("name")
             .agg(F.min(F.struct("sku", *others)).alias("_row"))
             .select("name", "_row.*"))
    catalog = dense_index(items, [F.col("sku")], "doc_id")
    return catalog.select("doc_id", "sku", "name",
                          *[c for c in ("category", "grp", "type") if c in catalog.columns])

"""Unit prices inferred from a price list through product and pack weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULTS
from ..functions.text import product_head, with_pack_weight
from ..storage import attach, bounded, settle
from .quantiles import exact_quantile

# Where a SKU's price per kilogram came from.
BY_PRODUCT, BY_MEDIAN = "по продукту", "запасная медиана"


def price_per_kg(price_list: DataFrame,
                 bounds: tuple[float, float] = DEFAULTS.price_bounds) -> DataFrame:
    """Entry and shelf price per kilogram of the rows with a weight and plausible prices."""
    rows = with_pack_weight(price_list).withColumn("product", product_head(F.col("name")))
    rows = rows.filter(F.col("weight_g") > 0)
    kilos = F.col("weight_g") / F.lit(1000.0)
    return (rows.select("product", (F.col("entry_price") / kilos).alias("entry_kg"),
                        (F.col("shelf_price") / kilos).alias("shelf_kg"))
            .filter(F.col("entry_kg").between(*bounds) & F.col("shelf_kg").between(*bounds)))


EVERYTHING = "*"


def _medians(priced: DataFrame) -> DataFrame:
    """scope, entry_kg, shelf_kg: medians per product and, under ``*``, of all rows."""
    scope = F.explode(F.array_compact(F.array("product", F.lit(EVERYTHING)))).alias("scope")
    rows = priced.select(scope, "entry_kg", "shelf_kg")
    long = rows.unpivot("scope", ["entry_kg", "shelf_kg"], "price", "value")
    return (exact_quantile(long, "value", 0.5, ["scope", "price"], "median")
            .groupBy("scope").pivot("price", ["entry_kg", "shelf_kg"]).agg(F.first("median")))


def price_by_product(priced: DataFrame) -> DataFrame:
    """Median prices and row count per product; rows without a product are left out."""
    counts = (priced.filter(F.col("product").isNotNull()).groupBy("product")
              .agg(F.count(F.lit(1)).alias("n")))
    medians = _medians(priced).filter(F.col("scope") != EVERYTHING).withColumnRenamed("scope", "product")
    return medians.join(counts, "product")


def overall_prices(priced: DataFrame) -> DataFrame:
    """One row of medians over every plausible row, with or without a product."""
    medians = _medians(priced).filter(F.col("scope") == EVERYTHING)
    return medians.agg(F.first("entry_kg").alias("all_entry_kg"),
                       F.first("shelf_kg").alias("all_shelf_kg"))


def our_items(sales: DataFrame) -> DataFrame:
    """One named row per SKU: the one with the smallest descriptors."""
    rows = sales.withColumn("sku", F.col("sku").cast("string")).filter(F.col("name").isNotNull())
    keep = [c for c in ("name", "category", "grp") if c in rows.columns]
    distinct = rows.select("sku", *keep).distinct()
    return (distinct.groupBy("sku").agg(F.min(F.struct(*keep)).alias("_row"))
            .select("sku", "_row.*"))


def build_price_table(sales: DataFrame, price_list: DataFrame,
                      bounds: tuple[float, float] = DEFAULTS.price_bounds) -> DataFrame:
    """Price per kilogram and per piece of every SKU in the sales.

    The product's median is used when the list has it, else the median of all.
    """
    priced = settle(price_per_kg(price_list, bounds))
    medians = settle(_medians(priced))
    known = medians.filter(F.col("scope") != EVERYTHING).withColumnRenamed("scope", "product")
    overall = medians.filter(F.col("scope") == EVERYTHING).agg(
        F.first("entry_kg").alias("all_entry_kg"), F.first("shelf_kg").alias("all_shelf_kg"))
    items = with_pack_weight(our_items(sales)).withColumn("product", product_head(F.col("name")))
    table = items.join(bounded(known), "product", "left")
    table = attach(table, overall, [])
    known = F.col("entry_kg").isNotNull()
    table = (table
             .withColumn("price_method", F.when(known, BY_PRODUCT).otherwise(BY_MEDIAN))
             .withColumn("shelf_kg", F.when(known, F.col("shelf_kg")).otherwise(F.col("all_shelf_kg")))
             .withColumn("entry_kg", F.when(known, F.col("entry_kg")).otherwise(F.col("all_entry_kg"))))
    piece = F.col("weight_g") / F.lit(1000.0)
    return table.select(
        "sku", "name", *[c for c in ("category", "grp") if c in table.columns], "product",
        "weight_method", "weight_g", "price_method", "entry_kg", "shelf_kg",
        ((F.col("shelf_kg") / F.col("entry_kg") - F.lit(1.0)) * F.lit(100.0)).alias("markup_pct"),
        F.when(F.col("weight_g").isNotNull(), F.col("entry_kg") * piece).alias("entry_piece"),
        F.when(F.col("weight_g").isNotNull(), F.col("shelf_kg") * piece).alias("shelf_piece"))


def price_coverage(table: DataFrame) -> DataFrame:
    """Number of SKUs, how many have a product price, and their share in percent."""
    found = F.count_if(F.col("price_method") == BY_PRODUCT)
    everything = F.count(F.lit(1))
    return table.agg(everything.alias("skus"), found.alias("by_product"),
                     F.bround(found / everything * F.lit(100.0), 1).alias("pct"))

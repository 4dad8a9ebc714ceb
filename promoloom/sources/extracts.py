"""Business extracts: sales, promo fact, discount plan, price list, result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import (DISCOUNT_HEADERS, PRICE_LIST_HEADER, PRICE_LIST_POSITIONS, SALES_HEADERS,
                       rename_source)
from ..functions.clean import text_to_date, text_to_number
from ..storage import settle


def _read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; without an inference pass every column is text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_sales(spark: SparkSession, path: str, headers: dict[str, str] = SALES_HEADERS) -> DataFrame:
    """Sales (or promo fact) rows; optional columns may be missing."""
    return rename_source(_read_text_csv(spark, path), headers)


def read_discounts(spark: SparkSession, path: str,
                   headers: dict[str, str] = DISCOUNT_HEADERS) -> DataFrame:
    return rename_source(_read_text_csv(spark, path), headers)


#: Why a row of an extract is turned away, the first that holds.
REASONS = ("width", "date", "number", "key")


def read_checked(spark: SparkSession, path: str, headers: dict[str, str], dates: tuple[str, ...], numbers: tuple[str, ...],
                 keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of an extract that can be read, and the others with the reason.

    The first table is what ``read_sales`` or ``read_discounts`` gives, without the rows of the
    second: ``file``, ``reason``, ``column`` and ``line`` (the row's text).  A row has
    the wrong ``width`` if its cells are fewer or more than the header's, a wrong ``date``
    or ``number`` if the text is given but can't be read, and no ``key`` if a
    key's text is missing.  Empty cells of dates and numbers are nulls, not faults.
    """
    names = _read_text_csv(spark, path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_line"]])
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
           .csv(path).withColumn("_file", F.col("_metadata.file_name")))
    rows = rename_source(raw, {**headers, "_line": "_line", "_file": "_file"})
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    faults = [(F.col("_line").isNotNull(), "width", F.lit(None).cast("string"))]
    faults += [(given(F.col(c)) & text_to_date(F.col(c)).isNull(), "date", F.lit(c)) for c in dates if c in rows.columns]
    faults += [(given(F.col(c)) & text_to_number(F.col(c)).isNull(), "number", F.lit(c)) for c in numbers if c in rows.columns]
    faults += [(~given(F.col(c)), "key", F.lit(c)) for c in keys if c in rows.columns]
    first = F.coalesce(*[F.when(bad, F.struct(F.lit(reason).alias("reason"), column.alias("column"))) for bad, reason, column in faults])
    cells = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in rows.columns if not c.startswith("_")])
    # Both tables come from one parse of the files.
    marked = settle(rows.select("*", first.alias("_fault"), F.coalesce("_line", cells).alias("_text")))
    good = marked.filter(F.col("_fault").isNull()).drop("_fault", "_line", "_file", "_text")
    bad = marked.filter(F.col("_fault").isNotNull()).select(F.col("_file").alias("file"), "_fault.reason", "_fault.column",
                                                            F.col("_text").alias("line"))
    return good, bad


def read_sales_checked(spark: SparkSession, path: str, headers: dict[str, str] = SALES_HEADERS) -> tuple[DataFrame, DataFrame]:
    """Sales rows that can be read, and the others with the reason."""
    return read_checked(spark, path, headers, ("date",), ("qty",), ("sku", "client", "date"))


def read_discounts_checked(spark: SparkSession, path: str, headers: dict[str, str] = DISCOUNT_HEADERS) -> tuple[DataFrame, DataFrame]:
    """Discount rows that can be read, and the others with the reason."""
    return read_checked(spark, path, headers, ("week_start",), ("disc_pct",), ("sku", "client", "week_start"))


def union_facts(*facts: DataFrame | None) -> DataFrame:
    """Stack the fact tables that are present; raise when there is none."""
    present = [f for f in facts if f is not None]
    if not present:
        raise FileNotFoundError("neither the sales nor the promo fact is given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def read_price_list(spark: SparkSession, path: str,
                    positions: tuple[int, int, int] = PRICE_LIST_POSITIONS) -> DataFrame:
    """Positional CSV export of a price sheet.

    Preamble and repeated header rows carry no number in the entry-price
    column and drop out with the unpriced rows.
    """
    width = max(positions) + 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(path)
    name, entry, shelf = (f"c{i}" for i in positions)
    return clean_price_list(raw.select(F.col(name).alias("name"), F.col(entry).alias("entry_price"),
                                       F.col(shelf).alias("shelf_price")))


def clean_price_list(df: DataFrame) -> DataFrame:
    return (df.select("name", F.col("entry_price").try_cast("double").alias("entry_price"),
                      F.col("shelf_price").try_cast("double").alias("shelf_price"))
            .filter(F.col("name").isNotNull() & F.col("entry_price").isNotNull()
                    & ~F.isnan("entry_price")
                    & (F.trim("name") != PRICE_LIST_HEADER)))


def write_source(df: DataFrame, path: str, headers: dict[str, str]) -> None:
    """CSV with the business headers, as the extracts come: every value as text."""
    names = {short: long for long, short in headers.items()}
    (df.select(*[F.col(c).cast("string").alias(names[c]) for c in df.columns])
     .write.option("header", True).csv(path))


def write_price_sheet(df: DataFrame, path: str, positions: tuple[int, int, int] = PRICE_LIST_POSITIONS) -> None:
    """Positional CSV of a price list; each file repeats the header row inside, as the sheets do."""
    cells = dict(zip(positions, ("name", "entry_price", "shelf_price")))
    head = dict(zip(positions, (PRICE_LIST_HEADER, "entry", "shelf")))
    width = range(max(positions) + 1)
    rows = df.select(*[(F.col(cells[i]).cast("string") if i in cells else F.lit("")).alias(f"c{i}") for i in width])
    titles = df.sparkSession.range(1).select(*[F.lit(head.get(i, "")).alias(f"c{i}") for i in width])
    titles.unionByName(rows).write.option("header", False).csv(path)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round every double half to even, as the written sheets do; on decimals, so that ties are exact."""
    return df.select(*[F.bround(F.col(f.name).cast("decimal(38,6)"), digits).cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def write_price_tables(folder: str, table: DataFrame, by_product: DataFrame,
                       coverage: DataFrame) -> None:
    """Three tables: coverage, prices per SKU (1 digit), prices per product (0 digits)."""
    coverage.write.mode("overwrite").parquet(f"{folder}/coverage")
    rounded(table, 1).write.mode("overwrite").parquet(f"{folder}/price_per_sku")
    rounded(by_product, 0).write.mode("overwrite").parquet(f"{folder}/price_per_product")


def read_price_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/price_per_sku")


def write_plan(path: str, plan: DataFrame) -> None:
    """Plan rows, whole numbers, best contribution first (at most ``slots`` rows)."""
    rounded(plan.orderBy(F.desc("net"), "sku"), 0).write.mode("overwrite").parquet(path)

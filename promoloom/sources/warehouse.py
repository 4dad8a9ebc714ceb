"""The business inputs derived from a star schema of order lines.

``lineitem``/``orders``/``customer``/``part`` rows become sales, a discount
plan and a price list: a SKU is a head article over 20 part numbers, a client
is a market segment, and product names are composed from the article number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread

# Word lists for composed names: products (the last one unknown), categories of
# two products each, and treatments, some abbreviated as in trade names.
HEAD_WORDS = ("Сельдь", "Скумбрия", "Форель", "Сёмга", "Килька", "Кета", "Икра", "Мойва",
              "Анчоус", "Спред", "Имбирь", "Ассорти")
CATEGORY_WORDS = ("Сельдь и икра", "Скумбрия и мойва", "Форель и анчоусы", "Сёмга и спреды",
                  "Килька и имбирь", "Кета и ассорти")
STYLE_WORDS = ("копченая", "с/с", "филе", "маринованная в/у", "п/п")


# Declared schemas: opening a table then needs no job.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


#: A name that is taken apart is the work of so many plain rows.
NAME_ROWS = 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _pick(words: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), (at % len(words)).cast("int"))


def composed_name(i: Column) -> Column:
    """Product name of article number ``i``: head, treatment, pack weight in one of 7 styles."""
    grams = (F.lit(10) * (F.lit(1) + i % 50)).cast("int")
    kilos = F.concat(F.floor(grams / 1000).cast("int"), F.lit("."),
                     F.lpad((grams % 1000).cast("string"), 3, "0"))
    style = i % 7
    weight = (F.when(style == 0, F.concat(F.replace(kilos, F.lit("."), F.lit(",")), F.lit(" кг")))
              .when(style == 1, F.concat(grams, F.lit(" г")))
              .when(style == 2, F.concat(grams, F.lit("гр.")))
              .when(style == 3, kilos)
              .when(style == 4, grams.cast("string"))
              .when(style == 5, F.lit("вес"))
              .otherwise(F.concat(F.lit("1/6 "), grams, F.lit("г"))))
    return F.concat_ws(" ", _pick(HEAD_WORDS, i), _pick(STYLE_WORDS, i), weight)


# Word lists for names that reach every rule: product words, colours, and trade abbreviations.
ODD_HEADS = ("Имбирь", "Анчоус", "Хамса", "Килька", "Икра", "Капуста", "Скумбрия", "Сельдь", "Сёмга", "Форель", "Горбуша", "Салака",
             "Мойва", "Ставрида", "Креветка", "Паштет", "Спред", "Пресервы", "Морепродукты", "Масло", "Мидии", "Кальмар", "Осьминог",
             "Тунец", "Лосось", "Кета", "Сардина", "Масляная", "Треска", "Минтай", "Краб", "Путассу", "Сайра", "Салат", "Ассорти")
ODD_COLOURS = ("красная", "чёрная", "розовая", "белая", "")
ODD_SHORT = ("с/с", "п/п", "пр/посола", "пр/п", "в/у", "в/м", "г/к", "х/к", "")


def odd_name(i: Column) -> Column:
    """A name of number ``i`` with any product, colour, abbreviation and way to state a weight, up to nine kilograms."""
    grams = (F.lit(10) * (F.lit(1) + i % 900)).cast("int")
    kilos = F.concat(F.floor(grams / 1000).cast("int"), F.lit("."), F.lpad((grams % 1000).cast("string"), 3, "0"))
    style = F.floor(i / 2) % 8
    weight = (F.when(style == 0, F.concat(F.replace(kilos, F.lit("."), F.lit(",")), F.lit(" кг"))).when(style == 1, kilos)
              .when(style == 2, F.concat(grams, F.lit(" г"))).when(style == 3, grams.cast("string")).when(style == 4, F.lit("весовая"))
              .when(style == 5, F.lit("вес")).when(style == 6, F.concat(F.lit("1/2 "), grams, F.lit("гр"))).otherwise(F.lit("")))
    words = [_pick(ODD_HEADS, i), _pick(ODD_COLOURS, F.floor(i / 3)), _pick(ODD_SHORT, F.floor(i / 7)), weight]
    return F.array_join(F.filter(F.array(*words), lambda w: w != ""), " ")


def category_of(i: Column) -> Column:
    return _pick(CATEGORY_WORDS, i)


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with article, client, day and discount; settle them when several tables are made of them."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    # Customers meet the orders, so that the lines move once.
    buyers = orders.join(customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", "c_mktsegment")
    joined = lines.join(buyers, lines.l_orderkey == buyers.o_orderkey)
    article = F.floor(F.col("l_partkey") / 20).cast("bigint")
    percent = F.round(F.col("l_discount") * 100).cast("int")
    return joined.select(
        article.alias("i"), F.concat(F.lit("S"), article).alias("sku"),
        F.col("c_mktsegment").alias("client"), F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("type"),
        (F.lit(6.0) * F.greatest(F.lit(0), percent - 5)).alias("disc_pct"))


def sales(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Sales rows; ``type`` varies by line, so its mode is a real choice."""
    rows = order_lines(spark, folder) if lines is None else lines
    return rows.select("sku", composed_name(F.col("i")).alias("name"),
                       category_of(F.col("i")).alias("category"),
                       F.concat(F.lit("G"), F.col("i") % 12).alias("grp"),
                       "type", "client", "date", "qty")


def promo_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The discounted part of the sales, the same structure without ``type``."""
    rows = order_lines(spark, folder).filter(F.col("disc_pct") > 0)
    return rows.select("sku", composed_name(F.col("i")).alias("name"),
                       category_of(F.col("i")).alias("category"),
                       F.concat(F.lit("G"), F.col("i") % 12).alias("grp"),
                       "client", "date", "qty")


def discounts(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    rows = order_lines(spark, folder) if lines is None else lines
    return rows.select("sku", "client", F.col("date").alias("week_start"), "disc_pct")


def price_list(spark: SparkSession, folder: str) -> DataFrame:
    # A file of parts is one task, and reading a name takes the time of many plain rows.
    parts = spread(table(spark, folder, "part").select("p_partkey", "p_retailprice"), NAME_ROWS)
    return parts.select(composed_name(F.col("p_partkey")).alias("name"),
                        (F.col("p_retailprice") * 0.75).alias("entry_price"),
                        F.col("p_retailprice").alias("shelf_price"))


def search_queries(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One query per group of the catalog, and its gold rule.

    The text names the group's product with a treatment; the rules alternate
    between equality, containment and prefix on the group.
    """
    groups = catalog.select("grp").distinct().withColumn("g", F.substring("grp", 2, 9).cast("bigint"))
    queries = groups.select(F.col("grp").alias("qid"),
                            F.lower(F.concat_ws(" ", _pick(HEAD_WORDS, F.col("g")),
                                                _pick(STYLE_WORDS, F.col("g")))).alias("text"))
    kind = _pick(("equals", "contains", "starts"), F.col("g"))
    rules = groups.select(F.col("grp").alias("qid"), kind.alias("kind"),
                          F.when(F.col("g") % 3 == 1, F.lower("grp")).otherwise(F.col("grp")).alias("value"))
    return queries, rules


def with_vectors(spark: SparkSession, folder: str, catalog: DataFrame) -> DataFrame:
    """Catalog rows with the vector whose number is the SKU's; null without one."""
    vectors = table(spark, folder, "embeddings").select(
        F.concat(F.lit("S"), "vec_id").alias("sku"), F.col("embedding").alias("vec"))
    return catalog.join(vectors, "sku", "left")


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key, element by element."""
    parts = vectors.select(key, F.posexplode("vec").alias("pos", "v"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("vec"))

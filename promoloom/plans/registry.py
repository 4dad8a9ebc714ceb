"""Named queries over the order-line warehouse, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import DEFAULTS, DISCOUNT_HEADERS, SALES_HEADERS
from ..functions import clean
from ..functions.text import (name_attributes, name_tokens, product_head, with_pack_weight,
                              word_roots)
from ..operators import causal, goldranks, interference, planning, pricing, rankeval, resample, retrieval, vectorindex
from ..operators.embedding import attach_components, name_components, name_terms, projected, term_components
from ..operators.features import CONTROLS, add_features
from ..operators.increments import PanelStore
from ..operators.nuisance import Nuisance
from ..operators.panel import build_catalog, build_panel, monthly_discounts, monthly_sales
from ..sources import extracts
from ..sources import warehouse as wh
from ..storage import attach, settle, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

CELLS = Nuisance("cells")
TWO_CONTROLS = Nuisance("linear", controls=("m_sin", "lag_qty_1"))
FULL = Nuisance()
OUTCOME = Nuisance(controls=(*CONTROLS, "own_disc"))
COST_SHARE = 0.3
TIGHT = 0.2
POOL = DEFAULTS.pool
TREES = Nuisance("gbt")


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Dates as text, counts as bigint, doubles rounded: the form results are compared in."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, special.get(f.name, digits))
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- shared inputs ----------------------------------------------------------

def _panel(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    lines = settle(wh.order_lines(spark, d)) if lines is None else lines
    return build_panel(wh.sales(spark, d, lines), wh.discounts(spark, d, lines))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return add_features(_panel(spark, d))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return build_catalog(wh.sales(spark, d), wh.promo_sales(spark, d))


def _rows(spark: SparkSession, d: str, nuisance: Nuisance = FULL) -> DataFrame:
    return causal.design(_features(spark, d), nuisance)


def _prices(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    return pricing.build_price_table(wh.sales(spark, d, lines), wh.price_list(spark, d))


def _pressure(spark: SparkSession, d: str) -> DataFrame:
    panel = settle(_panel(spark, d))
    groups = panel.groupBy("sku").agg(F.min("grp").alias("grp"))
    return settle(interference.substitute_pressure(panel, groups))


def _search(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Described documents and queries with vectors, and gold pairs."""
    catalog = settle(_catalog(spark, d))
    docs = settle(retrieval.describe(wh.with_vectors(spark, d, catalog)))
    queries, rules = wh.search_queries(docs)
    middle = wh.centroids(docs.select(F.col("grp").alias("qid"), "vec"), "qid")
    queries = settle(retrieval.describe(queries, "text").join(middle, "qid", "left"))
    return queries, docs, rankeval.gold_documents(rules, docs)


class _Planning:
    """Tables every planning query starts from."""

    def __init__(self, spark: SparkSession, d: str, cost_share: float = COST_SHARE):
        lines = settle(wh.order_lines(spark, d))
        # Prices are read more than once, to see whether they can be broadcast and to be joined.
        prices = settle(_prices(spark, d, lines))
        priced = settle(planning.attach_prices(_panel(spark, d, lines), prices))
        rows = causal.design(add_features(priced), FULL)
        overall = settle(causal.effect(rows, FULL))
        by_category = settle(causal.effect_by_category(rows, FULL))
        self.base = settle(planning.baseline_table(priced))
        self.cand = settle(planning.candidates(self.base, by_category, overall, cost_share=cost_share))
        self.past = settle(planning.past_policy(priced, self.base, by_category, overall, cost_share))

    def budget(self, share: float = 1.0) -> float:
        return self.past.first()["hist_spend"] * share


# --- queries ----------------------------------------------------------------

def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/extracts-{uuid.uuid4().hex}"


def sales_extract(spark: SparkSession, d: str) -> DataFrame:
    """Sales written as a business extract (day-first dates, decimal commas), read back and summed by month."""
    whole = F.col("qty").cast("bigint")
    rows = wh.sales(spark, d).withColumns({
        "date": F.date_format("date", "dd.MM.yyyy"),
        "qty": F.concat(whole.cast("string"), F.lit(","), F.lpad(F.round((F.col("qty") - whole) * 100).cast("int").cast("string"), 2, "0"))})
    folder = _folder(spark)
    extracts.write_source(rows, folder, SALES_HEADERS)
    return tidy(monthly_sales(extracts.read_sales(spark, folder)))


def promo_extract(spark: SparkSession, d: str) -> DataFrame:
    """The promo fact, without ``type``, written and read back, stacked on nothing, totalled by month."""
    folder = _folder(spark)
    extracts.write_source(wh.promo_sales(spark, d), folder, SALES_HEADERS)
    fact = extracts.union_facts(None, extracts.read_sales(spark, folder))
    return tidy(fact.groupBy(clean.month(fact, "date").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(clean.number(fact, "qty")).alias("qty"), F.lit("type" in fact.columns).alias("typed")))


def discount_extract(spark: SparkSession, d: str) -> DataFrame:
    """The discount plan written as a business extract and read back."""
    rows = wh.discounts(spark, d).withColumn("week_start", F.date_format("week_start", "d/M/yyyy"))
    folder = _folder(spark)
    extracts.write_source(rows, folder, DISCOUNT_HEADERS)
    return tidy(monthly_discounts(extracts.read_discounts(spark, folder)))


def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sales written with planted faults by line, read back: rows taken and turned away, by reason."""
    lines = wh.sales(spark, d).withColumns({"date": F.date_format("date", "dd.MM.yyyy"), "qty": F.col("qty").cast("string")})
    rows = lines.withColumn("day", F.dayofmonth(F.to_date("date", "dd.MM.yyyy"))).withColumns({
        "qty": F.when(F.col("day") == 5, F.concat("qty", F.lit("x"))).otherwise(F.col("qty")),
        "client": F.when(F.col("day") == 6, F.lit(None).cast("string")).otherwise(F.col("client")),
        "date": F.when(F.col("day") == 7, F.concat(F.lit("31."), F.lit("02."), F.substring("date", 7, 4))).otherwise(F.col("date"))})
    names = {short: long for long, short in SALES_HEADERS.items()}
    cells = [F.concat(F.lit('"'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in lines.columns]
    text = F.concat_ws(",", *cells, F.when(F.col("day") == 8, F.lit("one too many")))
    folder = _folder(spark)
    head = F.lit(",".join(names[c] for c in lines.columns))
    # One file a task, each with the header line first: nothing moves, and a file has a task's rows.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    headed = rows.select(text.alias("value")).select(F.when(first, F.concat(head, F.lit("\n"), F.col("value"))).otherwise(F.col("value")).alias("value"))
    headed.write.option("maxRecordsPerFile", 0).text(folder)
    spark.range(1).select(head.alias("value")).write.mode("append").text(folder)
    good, bad = extracts.read_sales_checked(spark, folder)
    counts = bad.groupBy("reason", "column").agg(F.count(F.lit(1)).alias("rows"))
    taken = good.agg(F.lit("taken").alias("reason"), F.lit(None).cast("string").alias("column"), F.count(F.lit(1)).alias("rows"))
    return tidy(taken.unionByName(counts))


def incremental_features(spark: SparkSession, d: str) -> DataFrame:
    """The feature panel stored up to its last two months, which are then added one by one."""
    panel = settle(_panel(spark, d))
    last = [r.month for r in panel.select("month").distinct().orderBy(F.desc("month")).limit(2).collect()]
    store = PanelStore(spark, _folder(spark))
    store.create(panel.filter(F.col("month") < F.lit(min(last))))
    for month in sorted(last):
        store.append(panel.filter(F.col("month") == F.lit(month)))
    return tidy(store.panel())


def faulty_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel of sales with returns, missing quantities, missing categories and unreadable dates, and a partial discount plan."""
    day = F.dayofmonth("date")
    sales = wh.sales(spark, d).withColumns({
        "qty": F.when(day % 4 == 1, F.col("qty") * -3).when(day % 4 != 2, F.col("qty")),
        "category": F.when(F.substring("sku", 2, 9).cast("bigint") % 3 != 0, F.col("category")),
        "date": F.when(day == 9, "не дата").otherwise(F.date_format("date", "d/M/yyyy"))})
    plan = wh.discounts(spark, d).filter("client != 'BUILDING'").withColumn(
        "disc_pct", F.when(F.dayofmonth("week_start") % 3 != 0, F.col("disc_pct")))
    return tidy(build_panel(sales, plan).select("sku", "client", "month", "qty", "category", "own_disc", "promo_disc_mean", "promo_weeks"))


def trimmed_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog of sales whose names come with blanks round them, some of them empty."""
    number = F.substring("sku", 2, 9).cast("bigint")
    sales = wh.sales(spark, d).withColumn("name", F.when(number % 7 != 0, F.concat(F.lit("  "), "name", F.lit(" "))))
    return tidy(build_catalog(sales).select("doc_id", "sku", "name"))


def supported_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories with at least as many rows as the average one, and of treated rows as well."""
    rows = _rows(spark, d)
    each = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") > 0).alias("treated"))
    least = each.agg(F.ceil(F.avg("n")).alias("n"), F.floor(F.avg("treated")).alias("treated")).first()
    return tidy(causal.supported(rows, least.n, least.treated))


def gold_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries that keep a relevant document when every other rule names no group."""
    queries, docs, _ = _search(spark, d)
    _, rules = wh.search_queries(docs)
    number = F.substring("qid", 2, 9).cast("bigint")
    rules = rules.withColumn("value", F.when(number % 2 == 0, F.col("value")).otherwise(F.concat("value", F.lit("?"))))
    return tidy(rankeval.queries_with_gold(queries.select("qid", "text"), rankeval.gold_documents(rules, docs)))


def name_vectors(spark: SparkSession, d: str) -> DataFrame:
    return tidy(name_terms(settle(_catalog(spark, d)), "sku"))


def component_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Squared length of every name under all its principal components, whatever their signs: its distance from the mean name."""
    parts = term_components(name_terms(settle(_catalog(spark, d)), "sku", features=128), "sku", 128, 128)
    squares = [F.col(c) * F.col(c) for c in parts.columns if c != "sku"]
    return tidy(parts.select("sku", sum(squares[1:], squares[0]).alias("length2")))


def panel_with_components(spark: SparkSession, d: str) -> DataFrame:
    """Every panel row with four numbers from its product's name."""
    parts = settle(projected(name_terms(settle(_catalog(spark, d)), "sku"), "sku", 4))
    return tidy(attach_components(_panel(spark, d).select("sku", "client", "month", "qty"), parts))


def price_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The positional price sheet written and read back."""
    folder = _folder(spark)
    extracts.write_price_sheet(wh.price_list(spark, d), folder)
    return tidy(pricing.price_per_kg(extracts.read_price_list(spark, folder), (2000.0, 15000.0)))


def price_sink(spark: SparkSession, d: str) -> DataFrame:
    """Price tables written rounded; the table per SKU read back as planning reads it."""
    prices, folder = settle(_prices(spark, d)), _folder(spark)
    by_product = pricing.price_by_product(settle(pricing.price_per_kg(wh.price_list(spark, d))))
    extracts.write_price_tables(folder, prices, by_product, pricing.price_coverage(prices))
    return tidy(extracts.read_price_table(spark, folder))


def plan_sink(spark: SparkSession, d: str) -> DataFrame:
    """The greedy plan written in whole numbers and read back."""
    p, folder = _Planning(spark, d), _folder(spark)
    extracts.write_plan(folder, planning.greedy_plan(p.cand, p.budget()))
    return tidy(spark.read.parquet(folder), 2)


def clean_values(spark: SparkSession, d: str) -> DataFrame:
    """Prices and dates written as text in mixed forms, read back and totalled by month."""
    lines = wh.table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    whole = F.floor(cents / 100).cast("bigint")
    price = F.concat(F.floor(whole / 1000).cast("bigint"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"),
                     F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    price = F.when(F.col("l_linenumber") == 7, F.concat(price, F.lit(" руб"))).otherwise(price)
    day = F.col("l_shipdate").cast("date")
    written = (F.when(F.col("l_linenumber") == 1, F.date_format(day, "d.M.yyyy"))
               .when(F.col("l_linenumber") == 2, F.date_format(day, "dd/MM/yyyy"))
               .when(F.col("l_linenumber") == 3, F.date_format(day, "d-M-yyyy"))
               .when(F.col("l_linenumber") == 4, F.lit("не дата"))
               .otherwise(F.date_format(day, "yyyy-MM-dd")))
    texts = lines.select(price.alias("price"), written.alias("day"))
    out = texts.select(clean.month(texts, "day").alias("month"), clean.number(texts, "price").alias("price"))
    return tidy(out.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.count("price").alias("priced"),
                                         F.sum("price").alias("total")), total=2)


def name_features(spark: SparkSession, d: str) -> DataFrame:
    """Everything read from the names of the price list."""
    names = wh.price_list(spark, d).select("name").distinct()
    a = name_attributes(F.col("name"))
    rows = with_pack_weight(names).withColumn("a", a)
    return tidy(rows.select(
        "name", "weight_method", "weight_g", product_head(F.col("name")).alias("product"),
        *[F.col(f"a.{f}").alias(f) for f in ("processing", "form", "packaging", "colour")],
        F.concat_ws(" ", name_tokens(F.col("name"))).alias("tokens"),
        F.concat_ws(" ", F.array_sort(word_roots(F.col("name")))).alias("roots")))


def fuzzy_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of product words that lack their third letter, so that no root or token is shared."""
    words = F.split_part(wh.composed_name(F.col("p_partkey")), F.lit(" "), F.lit(1))
    texts = wh.table(spark, d, "part").select(words.alias("right")).distinct()
    texts = texts.withColumn("text", F.concat(F.substring("right", 1, 2), F.expr("substring(right, 4)")))
    categories = _catalog(spark, d).select("category").distinct()
    found = retrieval.best_category(retrieval.describe(texts, "text"), "text", settle(categories))
    return tidy(found)


def odd_names(spark: SparkSession, d: str) -> DataFrame:
    """Everything read from names that reach every product, colour, abbreviation and weight rule."""
    names = wh.table(spark, d, "part").select(wh.odd_name(F.col("p_partkey")).alias("name")).distinct()
    rows = with_pack_weight(names).withColumn("a", name_attributes(F.col("name")))
    return tidy(rows.select("name", "weight_method", "weight_g", *[F.col(f"a.{f}").alias(f) for f in
                                                                   ("product", "processing", "form", "packaging", "colour")],
                            F.concat_ws(" ", name_tokens(F.col("name"))).alias("tokens")))


def _rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    queries, docs, gold = _search(spark, d)
    queries = rankeval.queries_with_gold(queries, gold)
    gold = settle(gold)
    return settle(rankeval.rank_metrics(goldranks.all_gold_ranks(queries, docs, gold, POOL), gold, methods=goldranks.METHODS))


def _top(search: Callable[..., DataFrame], **options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        queries, docs, _ = _search(spark, d)
        return tidy(search(queries, docs, **options))

    return run


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All vectors as documents, the mean vector of each label as queries, labels as gold."""
    vectors = wh.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("qid"),
        F.col("embedding").alias("vec"))
    return settle(wh.centroids(vectors, "qid")), vectors.select("doc_id", "vec"), vectors.select("qid", "doc_id")


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    queries, docs, _ = _vectors(spark, d)
    return tidy(retrieval.dense_top(queries, docs, 10))


def vector_metrics(spark: SparkSession, d: str) -> DataFrame:
    queries, docs, gold = _vectors(spark, d)
    return tidy(rankeval.rank_metrics(goldranks.dense_ranks(queries, docs, gold), gold, methods=("dense",)))


def _asked_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a query against all."""
    docs = wh.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "qid"), docs


def approximate_search(spark: SparkSession, d: str) -> DataFrame:
    """Best ten of every hundredth vector by probed lists."""
    queries, docs = _asked_vectors(spark, d)
    return tidy(vectorindex.approximate_top(vectorindex.build_index(docs), queries, 10))


def approximate_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether probing finds nine tenths of the exact best ten."""
    queries, docs = _asked_vectors(spark, d)
    near = vectorindex.approximate_top(vectorindex.build_index(docs), queries, 10)
    found = vectorindex.recall(near, retrieval.dense_top(queries, docs, 10))
    return tidy(found.agg(F.count(F.lit(1)).alias("queries"), F.sum("exact").alias("exact"),
                          (F.sum("found") >= 0.9 * F.sum("exact")).alias("enough")))


def find_products(spark: SparkSession, d: str) -> DataFrame:
    queries, docs, _ = _search(spark, d)
    return tidy(retrieval.find_products(queries, docs, threshold=3.5, pool=POOL, topk=10))


def bootstrap_effect(spark: SparkSession, d: str) -> DataFrame:
    return tidy(causal.effect(_rows(spark, d), FULL, errors="bootstrap").drop("p"))


def bootstrap_poisson(spark: SparkSession, d: str) -> DataFrame:
    moments = causal.effect_moments(_rows(spark, d), FULL)
    return tidy(resample.bootstrap_slope(moments, scheme="poisson"))


def _curves(spark: SparkSession, d: str):
    rows = _rows(spark, d)
    return rows, causal.response_curves(rows, FULL)


def dose_response(spark: SparkSession, d: str) -> DataFrame:
    rows, curves = _curves(spark, d)
    return tidy(causal.dose_response(causal.effect(rows, FULL), curves), 4)


def inverse_discount(spark: SparkSession, d: str) -> DataFrame:
    return tidy(causal.inverse_discount(_curves(spark, d)[1]))


def _plan(share: float = 1.0, robust: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = _Planning(spark, d)
        return tidy(planning.greedy_plan(p.cand, p.budget(share), robust=robust), 2)

    return run


def plan_report(spark: SparkSession, d: str) -> DataFrame:
    p = _Planning(spark, d)
    return tidy(planning.plan_report(planning.greedy_plan(p.cand, p.budget()), p.past), 2)


def empty_plan_report(spark: SparkSession, d: str) -> DataFrame:
    """At the default cost share every discount loses: the report says so."""
    p = _Planning(spark, d, DEFAULTS.cost_share)
    return tidy(planning.plan_report(planning.greedy_plan(p.cand, p.budget(1.0)), p.past), 2)


def lagrangian_plan(spark: SparkSession, d: str) -> DataFrame:
    p = _Planning(spark, d)
    return tidy(planning.lagrangian_plan(p.cand, p.budget(TIGHT))[0], 2)


def lagrangian_report(spark: SparkSession, d: str) -> DataFrame:
    p = _Planning(spark, d)
    return tidy(planning.lagrangian_plan(p.cand, p.budget(TIGHT))[1], 2)


def selection_plan(spark: SparkSession, d: str) -> DataFrame:
    p = _Planning(spark, d)
    return tidy(planning.selection_plan(p.cand, p.budget(TIGHT))[0], 2)


def selection_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the closed-in selection keeps every limit and leaves at most half the gap of fixed prices."""
    p = _Planning(spark, d)
    budget = p.budget(TIGHT)
    plan, report = planning.selection_plan(p.cand, budget)
    plan, mine, fixed = settle(plan), report.first(), planning.lagrangian_plan(p.cand, budget)[1].first()
    groups = plan.groupBy("group").count().agg(F.max("count").alias("most"))
    sums = plan.agg(F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"), F.count(F.lit(1)).alias("n"), F.countDistinct("sku").alias("skus"))
    row = attach(sums, groups, [])
    return tidy(row.select(
        F.lit(budget).alias("budget"), (F.col("spend") <= F.lit(budget) + 1e-6).alias("within_budget"),
        ((F.col("n") <= DEFAULTS.slots) & (F.col("n") == F.col("skus"))).alias("within_slots"),
        (F.coalesce("most", F.lit(0)) <= DEFAULTS.kmax).alias("within_groups"),
        F.lit(mine.value >= fixed.value - 1e-6 and mine.gap <= fixed.gap + 1e-6).alias("no_worse"),
        F.lit(mine.gap <= 0.5 * fixed.gap + 1e-6).alias("gap_halved")), 2)


def price_by_product(spark: SparkSession, d: str) -> DataFrame:
    return tidy(pricing.price_by_product(settle(pricing.price_per_kg(wh.price_list(spark, d)))))


def overall_prices(spark: SparkSession, d: str) -> DataFrame:
    return tidy(pricing.overall_prices(settle(pricing.price_per_kg(wh.price_list(spark, d)))))


QUERIES: dict[str, Query] = {
    "clean_values": clean_values,
    "sales_extract": sales_extract,
    "promo_extract": promo_extract,
    "discount_extract": discount_extract,
    "price_sheet": price_sheet,
    "rejected_rows": rejected_rows,
    "incremental_features": incremental_features,
    "faulty_panel": faulty_panel,
    "trimmed_catalog": trimmed_catalog,
    "supported_categories": supported_categories,
    "gold_queries": gold_queries,
    "name_vectors": name_vectors,
    "component_lengths": component_lengths,
    "panel_with_components": panel_with_components,
    "price_sink": price_sink,
    "plan_sink": plan_sink,
    "monthly_sales": lambda s, d: tidy(monthly_sales(wh.sales(s, d))),
    "monthly_discounts": lambda s, d: tidy(monthly_discounts(wh.discounts(s, d))),
    "monthly_panel": lambda s, d: tidy(_panel(s, d)),
    "panel_features": lambda s, d: tidy(_features(s, d)),
    "catalog": lambda s, d: tidy(_catalog(s, d)),
    "name_features": name_features,
    "odd_names": odd_names,
    "price_per_kg": lambda s, d: tidy(pricing.price_per_kg(wh.price_list(s, d), (2000.0, 15000.0))),
    "price_by_product": price_by_product,
    "overall_prices": overall_prices,
    "price_table": lambda s, d: tidy(_prices(s, d)),
    "price_coverage": lambda s, d: tidy(pricing.price_coverage(_prices(s, d))),
    "substitute_pressure": lambda s, d: tidy(_pressure(s, d)),
    "within_effect": lambda s, d: tidy(interference.within_effect(_pressure(s, d))),
    "fixed_effects": lambda s, d: tidy(interference.fixed_effects(_pressure(s, d))),
    "fixed_effects_by_category": lambda s, d: tidy(interference.fixed_effects(_pressure(s, d), True)),
    "pressure_effect": lambda s, d: tidy(interference.dml_pressure(
        _pressure(s, d), Nuisance("linear", controls=("m_sin", "m_cos", "own_disc")))),
    "treated_share": lambda s, d: tidy(causal.treated_share(_rows(s, d))),
    "effect_cells": lambda s, d: tidy(causal.effect(_rows(s, d, CELLS), CELLS)),
    "effect_linear": lambda s, d: tidy(causal.effect(_rows(s, d, TWO_CONTROLS), TWO_CONTROLS)),
    "effect_all_controls": lambda s, d: tidy(causal.effect(_rows(s, d), FULL)),
    "effect_trees": lambda s, d: tidy(causal.effect(_rows(s, d, TREES), TREES)),
    "bootstrap_effect": bootstrap_effect,
    "bootstrap_poisson": bootstrap_poisson,
    "effect_by_category": lambda s, d: tidy(causal.effect_by_category(_rows(s, d), FULL)),
    "strongest_categories": lambda s, d: tidy(causal.strongest(
        causal.effect_by_category(_rows(s, d), FULL), 3)),
    "placebo": lambda s, d: tidy(causal.placebo(_rows(s, d), FULL)),
    "dose_response": dose_response,
    "inverse_discount": inverse_discount,
    "split_conformal": lambda s, d: tidy(causal.split_conformal(settle(_features(s, d)), OUTCOME)),
    "baseline": lambda s, d: tidy(_Planning(s, d).base),
    "candidates": lambda s, d: tidy(_Planning(s, d).cand, 2),
    "past_policy": lambda s, d: tidy(_Planning(s, d).past, 2),
    "greedy_plan": _plan(),
    "greedy_plan_tight": _plan(TIGHT),
    "greedy_plan_robust": _plan(TIGHT, True),
    "lagrangian_plan": lagrangian_plan,
    "lagrangian_report": lagrangian_report,
    "selection_plan": selection_plan,
    "selection_check": selection_check,
    "plan_report": plan_report,
    "empty_plan_report": empty_plan_report,
    "fuzzy_categories": fuzzy_categories,
    "gold_documents": lambda s, d: tidy(_search(s, d)[2]),
    "search_category": _top(retrieval.category_top, k=10),
    "search_lexical": _top(retrieval.lexical_top, k=10),
    "search_structured": _top(retrieval.structured_top, k=10),
    "search_dense": _top(retrieval.dense_top, k=10),
    "search_rerank": _top(retrieval.rerank_all, pool=POOL),
    "find_products": find_products,
    "vector_search": vector_search,
    "vector_metrics": vector_metrics,
    "approximate_search": approximate_search,
    "approximate_recall": approximate_recall,
    "rank_metrics": lambda s, d: tidy(_rank_metrics(s, d)),
    "method_summary": lambda s, d: tidy(rankeval.method_summary(_rank_metrics(s, d))),
    "mean_ranks": lambda s, d: tidy(rankeval.mean_ranks(_rank_metrics(s, d))),
    "friedman": lambda s, d: tidy(rankeval.friedman(_rank_metrics(s, d), 5)),
    "nemenyi": lambda s, d: tidy(rankeval.nemenyi(_rank_metrics(s, d), 5)),
    "name_components": lambda s, d: tidy(name_components(settle(_catalog(s, d)), DEFAULTS.embedding_dims)),
}

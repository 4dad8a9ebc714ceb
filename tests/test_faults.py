"""Cases that once lost rows or hid a failure."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from promoloom.functions import clean
from promoloom.functions.stats import nemenyi_q05
from promoloom.operators import causal, interference, planning, retrieval
from promoloom.operators.features import add_features, controls_for
from promoloom.operators.nuisance import Nuisance, residuals
from promoloom.operators.numbering import global_rank
from promoloom.operators.resample import cluster_moments


def test_date_forms(spark):
    forms = {"01.02.23": (2023, 2, 1), "1/2/23": (2023, 2, 1), "1-2-99": (1999, 2, 1), "2023/02/01": (2023, 2, 1),
             "2023-2-1": (2023, 2, 1), "01.02.2023 00:00": (2023, 2, 1), "2023-02-01T10:00": (2023, 2, 1), "x": None, "": None}
    df = spark.createDataFrame([(k,) for k in forms], "t string")
    got = {r.t: r.d for r in df.select("t", clean.text_to_date(F.col("t")).alias("d")).collect()}
    assert got == {k: dt.date(*v) if v else None for k, v in forms.items()}
    assert clean.unreadable_dates(df, "t").first()[0] == 1


def test_letters_after_digits_are_no_number(spark):
    forms = {"1d": None, "2f": None, "1,5": 1.5, "1 000": 1000.0, "1e3": 1000.0, "3.": 3.0, "3.D": None, "abc": None}
    df = spark.createDataFrame([(k,) for k in forms], "t string")
    assert {r.t: r.v for r in df.select("t", clean.text_to_number(F.col("t")).alias("v")).collect()} == forms


def test_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    assert sorted((r.v, r["rank"]) for r in global_rank(df, [F.col("v")], ["g"]).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_residuals_of_null_cells(spark):
    rows = [(i, "a" if i % 2 else None, i % 4 // 2, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "sku int, category string, fold int, y double").withColumn("t", F.col("y") * F.col("y"))
    for nuisance in (Nuisance("cells", cells=("category",)), Nuisance("linear", controls=("t",))):
        left = residuals(df, ["y"], nuisance)
        assert left.count() == 20 and left.filter("y_r is null").count() == 0


def test_moments_count_complete_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 3.0), ("a", 2.0, None)], "sku string, x double, y double")
    assert cluster_moments(df, "x", "y").first()["n"] == 1.0


def test_fixed_effects_report_missing_convergence(made_panel):
    pressure = interference.substitute_pressure(made_panel, made_panel.groupBy("sku").agg(F.min("grp").alias("grp")))
    thinned = pressure.filter(F.pmod(F.hash("sku", "client", "month"), F.lit(4)) > 0)
    with pytest.raises(RuntimeError, match="no convergence"):
        interference.fixed_effects(thinned, max_steps=1)


def test_search_fills_from_the_documents_given(spark):
    docs = retrieval.describe(spark.createDataFrame([(5, "Сельдь"), (7, "Форель"), (9, "Икра")], "doc_id bigint, name string"))
    queries = retrieval.describe(spark.createDataFrame([("q", "сельдь")], "qid string, text string"), "text")
    assert [r.doc_id for r in retrieval.lexical_top(queries, docs, 3).orderBy("rank").collect()] == [5, 7, 9]


def test_no_queries_give_no_scores(spark):
    docs = spark.createDataFrame([(1, [1.0])], "doc_id bigint, vec array<double>")
    assert retrieval.dense_scores(spark.createDataFrame([], "qid string, vec array<double>"), docs).count() == 0


def test_controls_follow_the_lags(made_panel):
    made = add_features(made_panel, (1, 2))
    assert set(controls_for((1, 2))) <= set(made.columns) and "lag_qty_3" not in made.columns


def test_clear_messages(made_panel):
    with pytest.raises(ValueError, match="2 to 10 methods"):
        nemenyi_q05(11)
    few = add_features(made_panel.filter(F.col("month") < "2021-04-01"))
    with pytest.raises(ValueError, match="months are too few"):
        causal.split_conformal(few, Nuisance("cells"))


def test_prices_round_half_even_to_a_tenth(spark):
    panel = spark.createDataFrame([("a",), ("b",)], "sku string")
    table = spark.createDataFrame([("a", 0.25, "g"), ("b", 0.35, "g")], "sku string, entry_piece double, grp string")
    assert {r.sku: r.price_unit for r in planning.attach_prices(panel, table).collect()} == {"a": 0.2, "b": 0.4}


def test_bound_is_the_least_over_prices(spark):
    cand = spark.createDataFrame([("a", "c", "g", 5.0, 10.0, 9.0, 1.0, 4.0), ("b", "c", "g", 5.0, 6.0, 5.0, 1.0, 3.0)],
                                 "sku string, cat string, `group` string, d double, net double, net_robust double, rev double, spend double")
    bounds = [planning.spending_bound(cand, 4.0, [p]) for p in (0.0, 1.0, 2.0)]
    assert planning.spending_bound(cand, 4.0, [0.0, 1.0, 2.0]) == min(bounds)

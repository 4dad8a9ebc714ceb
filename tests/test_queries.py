"""Registered queries against their SQL on the smallest tables, and the stage functions."""

from dataclasses import replace

import pytest

import __spark_entry__ as contract
from checks.compare import compare, tables
from checks.oracle import SQL
from promoloom.columns import DEFAULTS
from promoloom.plans import stages
from promoloom.plans.registry import QUERIES
from promoloom.sources import warehouse as wh
from promoloom.operators.panel import build_catalog, build_panel
from promoloom.storage import settle

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["clean_values", "panel_features", "catalog", "price_table", "substitute_pressure", "effect_linear",
           "greedy_plan_tight", "find_products", "vector_metrics"]


def test_contract():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(QUERIES) - set(SQL) == {"effect_trees", "name_components", "approximate_search", "selection_plan"}


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, tables(FOLDER), name, FOLDER) is None


@pytest.fixture(scope="module")
def inputs(spark):
    sales = settle(wh.sales(spark, FOLDER))
    return {"sales": sales, "panel": settle(build_panel(sales, wh.discounts(spark, FOLDER))),
            "catalog": settle(build_catalog(sales)), "prices": wh.price_list(spark, FOLDER)}


SETTINGS = replace(DEFAULTS, boot_reps=20, within_reps=20, min_rows=300, cost_share=0.3, embedding_dims=3)


def test_pricing_and_planning_stages(inputs):
    priced = stages.pricing_stage(inputs["sales"], inputs["prices"])
    assert priced["coverage"].first().skus == 10
    planned = stages.planning_stage(inputs["panel"], priced["table"], SETTINGS)
    plan, past = planned["plan"].collect(), planned["past"].first()
    assert sum(r.spend for r in plan) <= past.hist_spend
    assert planned["report"].first().skus == len(plan) > 0


def test_search_stage(spark, inputs):
    queries = spark.createDataFrame([("a", "сельдь"), ("b", "форель филе"), ("c", "нет")], "qid string, text string")
    rules = spark.createDataFrame([("a", "equals", "G0"), ("b", "starts", "G2"), ("c", "equals", "zz")],
                                  "qid string, kind string, value string")
    out = stages.search_stage(inputs["sales"], None, queries, rules)
    assert {r.qid for r in out["metrics"].collect()} == {"a", "b"}
    summary = {r.method: r for r in out["summary"].collect()}
    assert set(summary) == {"category", "lexical", "structured", "dense", "rerank"}
    assert summary["structured"].mrr == 1.0
    assert out["friedman"].count() == 1 and out["nemenyi"].count() == 10


def test_interference_stage(inputs):
    out = stages.interference_stage(inputs["panel"], inputs["catalog"], SETTINGS)
    assert out["within"].count() == out["dml"].count() == 1
    # Ten SKUs, each alone in its group: no pressure anywhere, so only the own effect exists.
    terms = {r.term: r for r in out["fixed_effects"].collect()}
    assert terms["subst"].coef is None and terms["own"].lo > 0


def test_effect_stage(inputs):
    out = stages.effect_stage(inputs["panel"], inputs["catalog"], SETTINGS)
    theta = out["overall"].first().theta
    assert 0.0 < theta < 0.1 and abs(out["placebo"].first().theta) < theta
    assert out["curve"].count() == 9 and out["inverse"].count() == 4
    assert 0.7 < out["conformal"].first().coverage <= 1.0
    assert 0.5 < out["share"].first().treated_share < 0.8
    assert out["by_category"].count() >= 1

"""What makes queries grow with their input: how rows are dealt out, what is broadcast, what a task holds."""

import datetime as dt
import glob
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from promoloom import storage
from promoloom.columns import SALES_HEADERS
from promoloom.functions import clean
from promoloom.operators import boosting, nuisance, planning, resample
from promoloom.operators.nuisance import Nuisance
from promoloom.plans import registry
from promoloom.sources import extracts
from promoloom.sources import warehouse as wh


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    day = dt.datetime(2020, 1, 1)
    lines = [(i, i % 80, 1, 1, float(i % 9), 10.0, (i % 11) / 100, 0.0, "ANR"[i % 3], "O", day + dt.timedelta(days=i % 400)) for i in range(400)]
    orders = [(i, i % 20, "O", 1.0, day, "1") for i in range(400)]
    customers = [(i, f"c{i}", 0, 0.0, ("BUILDING", "AUTO")[i % 2]) for i in range(20)]
    parts = [(i, f"p{i}", "b", "t", 1, 100.0 + i) for i in range(80)]
    for name, rows, files in (("lineitem", lines, 12), ("orders", orders, 1), ("customer", customers, 1), ("part", parts, 1)):
        spark.createDataFrame(rows, wh.SCHEMAS[name]).repartition(files).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_draws_are_not_broadcast_beside_many_clusters(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"S{i:03d}", *map(float, rng.normal(size=5))) for i in range(300)], "sku string, n double, sx double, sy double, sxx double, sxy double")
    few = {r.rep: r.sx for r in resample.bootstrap_sums(rows, list(resample.SUMS), 20).collect()}
    monkeypatch.setattr(resample, "bounded", lambda df: df)
    many = resample.bootstrap_sums(rows, list(resample.SUMS), 20)
    assert "BroadcastHashJoin [_at" not in plan_of(many) and "SortMergeJoin [_at" in plan_of(many)
    assert {r.rep: r.sx for r in many.collect()} == pytest.approx(few)


def test_rows_that_multiply_are_dealt_out(spark, folder, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 50)
    cand = spark.createDataFrame([(f"S{i}", "C", f"G{i % 3}", float(d), float(i + d), float(i), 9.0, float(1 + d)) for i in range(20) for d in (0, 5, 10)],
                                 "sku string, cat string, `group` string, d double, net double, net_robust double, rev double, spend double")
    plans = planning.priced_plans(cand, slots=5, kmax=2, prices=4)
    assert re.search(r"hashpartitioning\(sku#\d+, 5\)", plan_of(plans))
    want = {}
    for r in cand.collect():
        if r.d > 0 and r.net - 0.0 * r.spend > 0:
            want[r.sku] = max(want.get(r.sku, 0.0), r.net)
    by_group = {}
    for s, v in sorted(want.items(), key=lambda x: -x[1]):
        by_group.setdefault(int(s[1:]) % 3, []).append(v)
    top = sorted((v for vs in by_group.values() for v in vs[:2]), reverse=True)[:5]
    assert sorted((r.net for r in plans.filter("price = 0").collect()), reverse=True) == top
    assert wh.price_list(spark, folder).rdd.getNumPartitions() > 20


def test_every_extract_file_is_a_tasks_rows_under_the_header(spark, folder, monkeypatch):
    seen, read = [], extracts.read_sales_checked
    monkeypatch.setattr(extracts, "read_sales_checked", lambda s, at: (seen.append(at), read(s, at))[1])
    held = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {(r.reason, r.column): r.rows for r in registry.rejected_rows(spark, folder).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = glob.glob(f"{seen[0]}/**/part-*.txt", recursive=True)
    head = ",".join({v: k for k, v in SALES_HEADERS.items()}[c] for c in wh.sales(spark, folder).columns)
    texts = [open(f, encoding="utf-8").read().splitlines() for f in files]
    assert len(files) > 5 and all(t[0] == head and head not in t[1:] for t in texts if t)
    days = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=i % 400)).day for i in range(400)]
    assert sum(map(len, texts)) - len([t for t in texts if t]) == 400
    assert got == {("taken", None): sum(d not in (5, 6, 7, 8) for d in days), ("number", "qty"): days.count(5), ("key", "client"): days.count(6),
                   ("date", "date"): days.count(7), ("width", None): days.count(8)}


def test_dates_are_parsed_only_where_the_form_fits(spark):
    texts = ["1.2.2020", "01.02.2020", "1/2/2020", "1-2-2020", "2020-1-2", "2020/01/2", "2020.1.2", "1.2.20", "1/2/69", "1-2-70", "31.02.2020", "не", "", None,
             "2020", "1.2", "1.2.3.2020", "12020-1-2", "+12020-1-2", "-2020-1-2", "001.2.2020", "1.2.020", "1.2.2", "1..2020", "1.2/2020", "1.2.12020", "1.2.+12020",
             "20.1.2", "2020-1-20", "20-1-2020", "１.2.2020", "1.2.２０２０", "a.b.2020", "1.2.2020\n", "1.2.20x", "10.10.1010", "1-2--2020", "0020-1-2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fmt in (*clean.DATE_FORMATS, *clean.SHORT_YEAR_FORMATS):
        rows = df.select("t", clean._parsed(F.col("t"), fmt).cast("string").alias("got"), F.try_to_date("t", fmt).cast("string").alias("want")).collect()
        assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows], fmt
    assert "RLIKE" in plan_of(df.select(clean.text_to_date(F.col("t")))) or "rlike" in str(clean.text_to_date(F.col("t"))).lower()


def test_residuals_are_array_products_computed_once(spark, made_panel):
    rows = nuisance.with_folds(made_panel.withColumn("y", F.log1p("qty")).withColumn("t", F.col("own_disc")).withColumn("a", F.month("month").cast("double"))
                               .withColumn("b", F.when(F.col("sku") != "S01", F.year("month").cast("double"))))
    kind = Nuisance("linear", controls=("a", "b"))
    left = nuisance.residuals(rows, ["y", "t"], kind)
    assert "zip_with" in plan_of(left.select("y_r"))
    # A row without a control has no residual, and a cluster of such rows no sums.
    assert left.filter("sku = 'S01' and y_r is not null").isEmpty() and not left.filter("sku != 'S01'").filter("y_r is null").count()
    moments = resample.cluster_moments(left, "t_r", "y_r")
    assert {r.sku for r in moments.collect()} == {f"S{i:02d}" for i in range(40) if i != 1}
    r = left.filter("sku = 'S02'").agg(F.sum("t_r").alias("sx"), F.sum(F.col("t_r") * F.col("y_r")).alias("sxy"), F.count("y_r").alias("n")).first()
    m = moments.filter("sku = 'S02'").first()
    assert (m.n, m.sx, m.sxy) == pytest.approx((r.n, r.sx, r.sxy))


def test_trees_keep_rows_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(rng.integers(0, 3)), float(rng.normal()), float(rng.normal())) for i in range(600)], "i long, fold int, a double, y double")
    fit, held = boosting._fit, []
    monkeypatch.setattr(boosting, "_fit", lambda state, *a: (held.append(state.count()), fit(state, *a))[1])
    got = boosting.tree_residuals(df, ["y"], ["a"], [], rounds=1)
    assert got.count() == 600 and held[0] < 60


def test_order_lines_are_joined_once_a_panel(spark, folder):
    plan = plan_of(registry._panel(spark, folder))
    assert "o_orderkey" not in plan and "l_orderkey" not in plan
    asked = wh.order_lines(spark, folder)
    assert asked.count() == 400 and {r.client for r in asked.select("client").distinct().collect()} == {"BUILDING", "AUTO"}

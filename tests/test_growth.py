"""Stored panels that grow, extracts with faulty rows, encoders as arguments."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from promoloom.columns import SALES_HEADERS
from promoloom.operators import embedding, nuisance
from promoloom.operators.features import add_features
from promoloom.operators.increments import PanelStore
from promoloom.operators.numbering import running_total
from promoloom.sources import extracts


def months(n):
    return [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(n)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = [(f"S{s}", c, m, float(rng.integers(0, 50)), "X", 0.0) for s in range(6) for c in ("A", "B") for i, m in enumerate(months(20))
            if (s + i) % 4 and (s < 4 or i >= 15 if s != 5 else i < 9)]
    return spark.createDataFrame(rows, "sku string, client string, month date, qty double, category string, own_disc double")


def test_grown_panel_equals_the_whole(spark, panel, tmp_path):
    store = PanelStore(spark, str(tmp_path / "panel"))
    *first, a, b, c = months(20)
    store.create(panel.filter(F.col("month") <= F.lit(first[-1])))
    for month in (a, b, c):
        store.append(panel.filter(F.col("month") == F.lit(month)))
    want = add_features(panel)
    got = store.panel().select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert store.month(str(b)).count() == panel.filter(F.col("month") == F.lit(b)).count()
    plan = store.month(str(b))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stored" in plan


def test_store_refuses_what_it_cant_add(spark, panel, tmp_path):
    store = PanelStore(spark, str(tmp_path / "panel"))
    early = panel.filter(F.col("month") < F.lit(months(5)[-1]))
    store.create(early)
    with pytest.raises(ValueError, match="already"):
        store.create(early)
    with pytest.raises(ValueError, match="one month after"):
        store.append(early.filter(F.col("month") == F.lit(months(1)[0])))
    with pytest.raises(ValueError, match="one month after"):
        store.append(panel.filter(F.col("month") >= F.lit(months(5)[-1])))
    store.append(panel.limit(0))
    # The same month again after an append that was cut off: its panel folder is there, its tails are not.
    new = panel.filter(F.col("month") == F.lit(months(5)[-1]))
    add_features(new).withColumn("stored", F.col("month")).write.partitionBy("stored").mode("append").parquet(f"{store.folder}/panel")
    store.append(new)
    whole = add_features(panel.filter(F.col("month") <= F.lit(months(5)[-1])))
    assert sorted(map(str, store.panel().select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_faulty_rows_are_turned_away_with_a_reason(spark, tmp_path):
    names = {short: long for long, short in SALES_HEADERS.items()}
    order = ("sku", "client", "date", "qty", "name")
    lines = [",".join(names[c] for c in order), "1,A,01.02.2023,5,ok", "2,A,31.02.2023,5,bad day", "3,A,01.02.2023,five,bad number",
             "4,,01.02.2023,5,no client", "5,A,01.02.2023", "6,A,01.02.2023,5,a,b", "7,A,2023-02-01,,no quantity", '8,A,1/2/23,"5,5","a, b"']
    (tmp_path / "sales.csv").write_text("\n".join(lines), encoding="utf-8")
    good, bad = extracts.read_sales_checked(spark, str(tmp_path / "sales.csv"))
    assert sorted(r.sku for r in good.collect()) == ["1", "7", "8"]
    assert sorted((r.line[0], r.reason, r.column) for r in bad.collect()) == [
        ("2", "date", "date"), ("3", "number", "qty"), ("4", "key", "client"), ("5", "width", None), ("6", "width", None)]
    assert {r.file for r in bad.collect()} == {"sales.csv"}
    plain = extracts.read_sales(spark, str(tmp_path / "sales.csv"))
    assert set(good.columns) == set(plain.columns)
    assert good.unionByName(plain.limit(0)).count() == 3


def test_any_encoder(spark):
    def make():
        def predict(texts):
            return np.array([[len(t), t.count("a"), 1.0] for t in texts], np.float32)

        return predict

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "aa")], "k int, name string")
    got = {r.k: r.vec for r in embedding.encode_with(df, "name", make, 2).collect()}
    assert got == {1: [3.0, 1.0, 1.0], 2: [0.0, 0.0, 1.0], 3: [2.0, 2.0, 1.0]}


def test_name_terms_are_unit_vectors(spark):
    df = spark.createDataFrame([("a", "Сельдь копченая"), ("b", "сельдь филе"), ("c", "xy"), ("d", None), ("e", "икра икра")],
                               "sku string, name string")
    terms = embedding.name_terms(df, "sku")
    sums = {r.sku: r.s for r in terms.groupBy("sku").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()}
    assert set(sums) == {"a", "b", "e"} and all(abs(s - 1) < 1e-9 for s in sums.values())
    parts = embedding.projected(terms, "sku", 3)
    assert parts.columns == ["sku", "emb_0", "emb_1", "emb_2"] and parts.count() == 3


def test_running_totals_follow_the_order(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", int(i), float(rng.integers(1, 9))) for i in rng.permutation(900)] + [(None, 1, 2.0), (None, 2, 3.0)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    got = {(r.g, r.i): r.total for r in running_total(df, [F.asc("i")], ["g"], "v").collect()}
    sums = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0.0) + v
        assert got[g, i] == sums[g]


def test_gram_step_is_planned_quickly_with_many_columns(spark):
    n = 40
    df = spark.range(50).select((F.col("id") % 5).cast("int").alias("fold"), F.lit("A").alias("category"),
                                *[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(n)])
    value = [F.col(f"c{i}") for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    step = nuisance._summed(nuisance._batch_moments(df, ["category", "fold"], value, pairs), ["category", "fold"], "_m")
    start = time.perf_counter()
    step._jdf.queryExecution().optimizedPlan()
    assert time.perf_counter() - start < 1.0
    row = {r.fold: r["_m"] for r in step.collect()}
    data = np.array([[(k * (i + 1)) % 17 for i in range(n)] for k in range(50)], float)
    for fold in range(5):
        part = data[np.arange(50) % 5 == fold]
        want = [len(part), *part.sum(0), *[part[:, i] @ part[:, j] for i, j in pairs]]
        assert np.allclose(row[fold], want)


def test_rows_with_a_missing_value_count_nowhere(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0), ("A", None, 5.0), ("A", float("nan"), 5.0), (None, 3.0, 4.0)], "k string, a double, b double")
    got = {r.k: r["_m"] for r in nuisance._batch_moments(df, ["k"], [F.col("a"), F.col("b")], [(0, 0), (0, 1)]).collect()}
    assert got == {"A": [1.0, 1.0, 2.0, 1.0, 2.0], None: [1.0, 3.0, 4.0, 9.0, 12.0]}


def test_components_of_terms_keep_distances(spark):
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(["сельдь копченая", "сельдь филе", "икра красная", "форель филе", "кета"])],
                               "sku string, name string")
    terms = embedding.name_terms(df, "sku", features=32)
    x = np.zeros((5, 32))
    for r in terms.collect():
        x[int(r.sku[1]), r.term] = r.weight
    parts = sorted(embedding.term_components(terms, "sku", 32, 32).collect())
    z = np.array([r[1:] for r in parts], float)
    gap = lambda m: ((m[:, None] - m[None]) ** 2).sum(-1)
    assert z.shape == (5, 5) and np.allclose(gap(z), gap(x), atol=1e-9)
    assert np.all(np.diff(z.var(0)) <= 1e-12)

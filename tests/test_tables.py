import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from promoloom.operators import features, panel, pricing
from promoloom.operators.numbering import dense_index, global_rank, top_per_group
from promoloom.operators.quantiles import exact_quantile, group_quantiles
from promoloom.sources import extracts
from promoloom.storage import bounded, settle

SALES = "sku string, client string, date string, qty string, name string, category string, grp string, type string"


def rows(*items):
    return [(s, c, d, q, n, k, g, t) for s, c, d, q, n, k, g, t in items]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(rows(
        ("1", "A", "1.1.2023", "1 000,5", "Сельдь 250 г", "Рыба", "G1", "x"),
        ("1", "A", "15.1.2023", "2", "Сельдь 250 г", "Рыба", "G1", "y"),
        ("1", "A", "20.1.2023", "bad", "Селедка", None, "G1", "x"),
        ("1", "A", "21.1.2023", "1", "Селедка", None, "G2", "y"),
        ("1", "B", "1.2.2023", "-5", "Сельдь 250 г", None, None, None),
        ("2", "A", "1.1.2023", "3", " Сельдь 250 г ", "Рыба", "G1", "x"),
        ("3", "A", "oops", "3", "Икра", "Икра", "G3", "x"),
        (None, "A", "1.1.2023", "3", "Икра", "Икра", "G3", "x"),
        ("4", None, "1.1.2023", "3", "Кета", "Икра", "G3", "x")), SALES)


def test_monthly_sales_and_modes(spark, sales):
    got = {(r.sku, r.client, str(r.month)): r for r in panel.monthly_sales(sales).collect()}
    assert set(got) == {("1", "A", "2023-01-01"), ("1", "B", "2023-02-01"), ("2", "A", "2023-01-01")}
    r = got["1", "A", "2023-01-01"]
    assert r.qty == pytest.approx(1003.5)
    # Ties go to the smallest text, nulls do not vote.
    assert (r.name, r.category, r.grp, r.type) == ("Селедка", "Рыба", "G1", "x")


def test_modal_attributes_match_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(str(rng.integers(5)), str(rng.integers(4)), str(rng.integers(3))) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, a string, b string")
    for r in panel.modal_attributes(df, ["k"], ["a", "b"]).collect():
        for at, value in ((1, r.a), (2, r.b)):
            votes = {}
            for d in data:
                if d[0] == r.k:
                    votes[d[at]] = votes.get(d[at], 0) + 1
            assert value == min(votes, key=lambda v: (-votes[v], v))


def test_panel_joins_discounts(spark, sales):
    disc = spark.createDataFrame([("1", "A", "2.1.2023", "10"), ("1", "A", "9.1.2023", "20,5"),
                                  ("1", "A", "16.1.2023", None), ("9", "A", "2.1.2023", "50")],
                                 "sku string, client string, week_start string, disc_pct string")
    got = {(r.sku, r.client): r for r in panel.build_panel(sales, disc).collect()}
    assert len(got) == 3
    r = got["1", "A"]
    assert (r.own_disc, r.promo_weeks) == (20.5, 2) and r.promo_disc_mean == pytest.approx(30.5 / 3)
    r = got["1", "B"]
    assert (r.qty, r.own_disc, r.promo_weeks, r.category) == (0.0, 0.0, 0, "unknown")


def test_panel_without_category(spark, sales):
    disc = spark.createDataFrame([], "sku string, client string, week_start string, disc_pct string")
    got = panel.build_panel(sales.drop("category"), disc)
    assert {r.category for r in got.collect()} == {"unknown"}


def test_catalog(spark, sales):
    promo = spark.createDataFrame([("5", "Кета 1 кг", "Кета", "G5")], "sku string, name string, category string, grp string")
    got = panel.build_catalog(sales, promo).orderBy("doc_id").collect()
    # SKU 2 has the trimmed name of no other SKU; SKU 3 keeps its unparsed date row.
    assert [(r.doc_id, r.sku, r.name) for r in got] == [
        (0, "1", "Сельдь 250 г"), (1, "3", "Икра"), (2, "4", "Кета"), (3, "5", "Кета 1 кг")]
    assert got[3].type is None
    with pytest.raises(FileNotFoundError):
        panel.build_catalog(None, None)


def test_features(spark):
    months = [dt.date(2023, m, 1) for m in (1, 2, 4, 5)]
    data = [("1", "A", m, float(q)) for m, q in zip(months, (1, 3, 8, 5))] + [("1", "B", months[0], 7.0)]
    got = {(r.client, r.month.month): r for r in features.add_features(
        spark.createDataFrame(data, "sku string, client string, month date, qty double")).collect()}
    r = got["A", 5]
    assert (r.lag_qty_1, r.lag_qty_2, r.lag_qty_3, r.lag_qty_6) == (8.0, 3.0, 1.0, 0.0)
    assert r.roll3_qty_mean == pytest.approx(4.0) and r.roll3_qty_std == pytest.approx(np.std([1, 3, 8], ddof=1))
    assert got["A", 2].roll3_qty_std == 0.0 and got["A", 1].roll6_qty_mean == 0.0
    # Another series never leaks in.
    assert got["B", 1].lag_qty_1 == 0.0
    assert (r.quarter, r.is_high_season, got["A", 1].is_high_season) == (2, 0, 1)
    assert r.y == pytest.approx(np.log1p(5))


@pytest.mark.parametrize("accuracy,inside", [(20, 100_000), (10_000, 100_000), (20, 15), (10_000, 40)])
def test_exact_quantile_hot_group(spark, accuracy, inside):
    rng = np.random.default_rng(1)
    hot = np.round(rng.lognormal(2, 1.5, 3000), 2)
    data = [("hot", float(v)) for v in hot] + [("tie", 5.0)] * 700 + [("tie", float(i)) for i in range(9)]
    data += [("one", 3.0), ("two", 1.0), ("two", 4.0), ("hot", None), (None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = {r.g: r.quantile for r in exact_quantile(df, "v", q, ["g"], accuracy=accuracy, inside=inside).collect()}
        assert set(got) == {"hot", "tie", "one", "two"}
        for g, value in got.items():
            expected = np.quantile([v for k, v in data if k == g and v is not None], q)
            assert value == pytest.approx(expected, rel=1e-12), (g, q)
    assert exact_quantile(df, "v", 0.5, accuracy=accuracy).first()[0] == \
        pytest.approx(np.median([v for _, v in data if v is not None]))


def test_global_rank_spans_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
                                  F.hash("id").alias("v"), "id")
    got = global_rank(df, [F.desc("v"), F.asc("id")], ["g"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    for group in by.values():
        group.sort(key=lambda r: (-r.v, r.id))
        assert [r["rank"] for r in group] == list(range(1, len(group) + 1))
    numbers = dense_index(df.select("id"), [F.desc("id")], "n").collect()
    assert sorted((r.n, r.id) for r in numbers) == [(i, 4999 - i) for i in range(5000)]


def test_top_per_group(spark):
    df = spark.range(100).select((F.col("id") % 4).alias("g"), "id")
    got = top_per_group(df, ["g"], [F.desc("id")], 2).collect()
    assert sorted(r.id for r in got) == list(range(92, 100))


def test_bounded_falls_back(spark):
    small = bounded(spark.range(10), 10)
    assert small.count() == 10 and "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    big = spark.range(11)
    assert bounded(big, 10) is big


def test_settle_round_trip(spark, sales):
    assert settle(sales).exceptAll(sales).count() == 0


PRICE_ROWS = [("Сельдь 250 г", 50.0, 75.0), ("Сельдь 0,5 кг", 120.0, 150.0), ("Сельдь 100 г", 40.0, 50.0),
              ("Икра вес", 900.0, 1000.0), ("Нечто 200 г", 60.0, 80.0), ("Кета 100 г", 5.0, 7.0),
              ("Краб 100 г", 10.0, 1500.1)]


def test_price_table(spark, sales):
    plist = spark.createDataFrame(PRICE_ROWS, "name string, entry_price double, shelf_price double")
    priced = pricing.price_per_kg(plist)
    # By-weight, below the lower and above the upper bound drop out.
    assert sorted(r.entry_kg for r in priced.collect()) == pytest.approx([200.0, 240.0, 300.0, 400.0])
    by = {r["product"]: r for r in pricing.price_by_product(settle(priced)).collect()}
    assert set(by) == {"сельдь"} and by["сельдь"].n == 3
    assert (by["сельдь"].entry_kg, by["сельдь"].shelf_kg) == pytest.approx((240.0, 300.0))
    got = {r.sku: r for r in pricing.build_price_table(sales, plist).collect()}
    # Unnamed rows drop out; named rows without a SKU stay as one line.
    assert set(got) == {"1", "2", "3", "4", None}
    assert got["2"].price_method == "по продукту" and got["2"].entry_piece == pytest.approx(60.0)
    assert got["2"].markup_pct == pytest.approx(25.0)
    assert got["3"].price_method == "запасная медиана" and got["3"].entry_kg == pytest.approx(270.0)
    assert got["3"].entry_piece is None
    cover = pricing.price_coverage(pricing.build_price_table(sales, plist)).first()
    # SKU 1 is named "Селедка" first, which is no known product.
    assert (cover.skus, cover.by_product, cover.pct) == (5, 1, 20.0)


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text("Головное СКЮ Артикул,Головное СКЮ Наименование,Категория,Группа new,УПП__Группа клиентов,Дата,Кол_шт,Лишнее\n"
                    '7,Кета 1 кг,Рыба,G,Сеть,03.02.2023,"1 200,5",x\n', encoding="utf-8")
    got = extracts.read_sales(spark, str(path))
    assert got.columns == ["sku", "name", "category", "grp", "client", "date", "qty"]
    r = panel.monthly_sales(got).first()
    assert (r.sku, str(r.month), r.qty) == ("7", "2023-02-01", 1200.5)
    path = tmp_path / "plan.csv"
    path.write_text("Головное СКЮ Артикул,УПП__Группа клиентов,_промо план шт,_промо %скидки,Год,Неделя,Дата начала недели\n"
                    '7,Сеть,10,"12,5",2023,6,06.02.2023\n', encoding="utf-8")
    r = panel.monthly_discounts(extracts.read_discounts(spark, str(path))).first()
    assert (r.sku, r.own_disc, r.promo_weeks) == ("7", 12.5, 1)


def test_price_list_by_position(spark, tmp_path):
    def line(name, entry, shelf):
        cells = [""] * 59
        cells[1], cells[57], cells[58] = name, entry, shelf
        return ",".join(cells)

    path = tmp_path / "prices.csv"
    path.write_text("\n".join(["Прайс"] + [line("Отчет", "", "")] * 4 + [line("Наименование", "Вход", "Полка"),
                              line("Кета 1 кг", "500", "700"), line("Сайра", "x", "90"), line("", "5", "6"),
                              line("Икра", "10", "")]), encoding="utf-8")
    got = sorted(extracts.read_price_list(spark, str(path)).collect())
    assert [tuple(r) for r in got] == [("Икра", 10.0, None), ("Кета 1 кг", 500.0, 700.0)]


def test_result_tables(spark, sales, tmp_path):
    plist = spark.createDataFrame(PRICE_ROWS, "name string, entry_price double, shelf_price double")
    table = settle(pricing.build_price_table(sales, plist))
    by = pricing.price_by_product(settle(pricing.price_per_kg(plist)))
    folder = str(tmp_path / "prices")
    extracts.write_price_tables(folder, table, by, pricing.price_coverage(table))
    back = extracts.read_price_table(spark, folder)
    assert back.columns == table.columns and back.count() == 5
    plan = spark.createDataFrame([("a", 2.5), ("b", 10.4), ("c", 3.5)], "sku string, net double")
    extracts.write_plan(str(tmp_path / "plan"), plan)
    got = {r.sku: r.net for r in spark.read.parquet(str(tmp_path / "plan")).collect()}
    # Half to even.
    assert got == {"a": 2.0, "b": 10.0, "c": 4.0}


def test_group_quantiles_of_small_and_huge_groups(spark):
    rng = np.random.default_rng(8)
    rows = [("hot", float(v)) for v in rng.integers(0, 500, 6000)] + [(f"g{i % 40}", float(v)) for i, v in enumerate(rng.normal(size=300))]
    rows += [("one", 3.0), ("none", None), ("some", None), ("some", 2.0), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r.k: r["quantile"] for r in group_quantiles(df, "v", q, ["k"]).collect()}
        assert got.keys() == held.keys()
        assert all(abs(got[k] - np.quantile(v, q)) < 1e-9 for k, v in held.items())


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    def hinted(df):
        return "BroadcastHint" in df._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    narrow = settle(spark.range(5000))
    assert hinted(bounded(narrow)) and not hinted(bounded(narrow, 4999)) and hinted(bounded(narrow, 5000))
    assert bounded(narrow, 5000).count() == 5000 and bounded(spark.range(0)).count() == 0
    wide = settle(spark.range(3000).select("id", F.array_repeat(F.lit(1.5), 100).alias("v")))
    assert hinted(bounded(wide)) and not hinted(bounded(wide, max_bytes=500_000)) and not hinted(bounded(wide, max_bytes=2_000_000))
    assert not hinted(bounded(spark.range(300).select(F.array_repeat(F.lit(1.5), 100).alias("v")), max_bytes=10_000))

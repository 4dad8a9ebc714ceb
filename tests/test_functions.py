import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from promoloom.functions import clean, text
from promoloom.functions.economics import discount_economics
from promoloom.functions.hashing import poisson1
from promoloom.functions.stats import chi2_upper_tail, erfc, normal_cdf


def one(spark, rows, kind, expr):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_numbers_from_text(spark):
    rows = ["1 234,5", "7", "-3,25", "abc", None, "", "nan", "1 000", "2.5"]
    got = one(spark, rows, "string", clean.text_to_number(F.col("x")))
    assert got == [1234.5, 7.0, -3.25, None, None, None, None, None, 2.5]


def test_dates_from_text(spark):
    rows = ["1.2.2023", "31/12/2022", "05-03-2021", "2020-04-09", "2020-04-09 10:11:12", "32.1.2023", "x", None]
    got = one(spark, rows, "string", clean.text_to_date(F.col("x")))
    assert got == [dt.date(2023, 2, 1), dt.date(2022, 12, 31), dt.date(2021, 3, 5), dt.date(2020, 4, 9),
                   dt.date(2020, 4, 9), None, None, None]


GOLDEN_WEIGHTS = [
    ("Сельдь филе 0,5 кг", "кг", 500.0), ("Кета 1.25кг", "кг", 1250.0), ("Сельдь 250 г", "г", 250.0),
    ("Икра 100гр.", "г", 100.0), ("Килька 1/6 250г", "г", 250.0), ("Сёмга с/с 0.3", "голое-кг", 300.0),
    ("Форель 180", "голое-г", 180.0), ("Сайра 100грамм", "голое-г", 100.0), ("Скумбрия вес", "весовой", None),
    ("Скумбрия весовая 2 кг", "весовой", None), ("Мойва 30", "нет", None), ("Мойва 9.5", "нет", None),
    ("Набор", "нет", None), (None, "нет", None), ("Мойва 9.5 250", "нет", None),
]


def test_pack_weight_golden_rows(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in GOLDEN_WEIGHTS], "name string")
    got = text.with_pack_weight(df).collect()
    for row, (_, method, grams) in zip(got, GOLDEN_WEIGHTS):
        assert row["weight_method"] == method, row
        assert row["weight_g"] == (None if grams is None else pytest.approx(grams)), row


def test_product_head_order(spark):
    rows = ["Икра кеты", "СЁМГА с/с", "Хамса", "Рыба масляная", "Масло", "Набор", None]
    assert one(spark, rows, "string", text.product_head(F.col("x"))) == \
        ["икра", "семга", "анчоус", "масляная рыба", "масло", None, None]


def test_attributes(spark):
    got = one(spark, ["Сельдь г/к филе в/у", "Икра красная с/с стекло", "Набор"], "string",
              text.name_attributes(F.col("x")))
    assert tuple(got[0]) == ("сельдь", "копченый", "филе", "вакуум", None)
    assert tuple(got[1]) == ("икра", "слабосоленый", None, "стекло", "красный")
    assert tuple(got[2]) == (None, None, None, None, None)


def test_normalized_name(spark):
    got = one(spark, ["Сёмга с/с 0,5 кг в/у", "Килька п/п из моря 1/6", "  "], "string",
              text.normalized_name(F.col("x")))
    assert got == ["вакуумная семга слабосоленый упаковка", "килька моря посола пряного", ""]


def test_lemma_hook(spark):
    got = one(spark, ["рыбы рыба"], "string",
              text.normalized_name(F.col("x"), lambda w: F.when(w == "рыбы", "рыба").otherwise(w)))
    assert got == ["рыба"]


def test_word_roots(spark):
    got = one(spark, ["Копчёная сельдь/скумбрия и хек"], "string", text.word_roots(F.col("x")))
    assert sorted(got[0]) == ["копч", "сель", "скум"]


def test_token_set_similarity(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a"], ["a", "b"]), (["a"], ["b"]), ([], ["a"]),
                                (["abcd"], ["abce"])], "l array<string>, r array<string>")
    plain = [r[0] for r in df.select(text.token_set_similarity(F.col("l"), F.col("r"))).collect()]
    assert plain == [50.0, 100.0, 0.0, 0.0, 0.0]
    fine = [r[0] for r in df.select(text.token_set_similarity(F.col("l"), F.col("r"), refine=True)).collect()]
    assert fine == [50.0, 100.0, 0.0, 0.0, 75.0]


def test_attribute_score(spark):
    names = [("сельдь копченая", "сельдь копченая филе"), ("сельдь", "икра"), ("филе", "сельдь филе"),
             ("сельдь филе", "сельдь филе")]
    df = spark.createDataFrame(names, "q string, d string")
    got = [r[0] for r in df.select(text.attribute_score(text.name_attributes(F.col("q")),
                                                        text.name_attributes(F.col("d")))).collect()]
    assert got == [4.0, 0.0, 1.0, 4.0]


def test_erfc_and_normal(spark):
    xs = [-3.0, -0.5, 0.0, 0.7, 2.5, 6.0]
    for x, v, c in zip(xs, one(spark, xs, "double", erfc(F.col("x"))),
                       one(spark, xs, "double", normal_cdf(F.col("x")))):
        assert v == pytest.approx(math.erfc(x), rel=2e-7)
        assert c == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=2e-7)


def test_chi2_tail(spark):
    # Table values of the chi-square distribution.
    for df, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (5, 11.070498)):
        assert one(spark, [x], "double", chi2_upper_tail(F.col("x"), df))[0] == pytest.approx(0.05, abs=1e-6)


def test_economics(spark):
    m = discount_economics(F.lit(10.0), F.lit(100.0), F.lit(0.03), F.col("x"), 0.6)
    got = spark.createDataFrame([(10.0,)], "x double").select(*[c.alias(k) for k, c in m.items()]).first()
    nq = 10 * math.exp(0.3)
    assert got["net"] == pytest.approx(nq * (90 - 60) - 10 * 40)
    assert got["rev"] == pytest.approx(nq * 90 - 1000)
    assert got["spend"] == pytest.approx(nq * 10)


def test_poisson_weights(spark):
    us = [0.0, 0.367, 0.368, 0.74, 0.95, 0.99999]
    edges = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    got = one(spark, us, "double", poisson1(F.col("x")))
    assert got == [float(sum(u >= e for e in edges)) for u in us]

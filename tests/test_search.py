import math

import numpy as np
import pytest

from promoloom.operators import embedding, goldranks, rankeval, retrieval, vectorindex
from promoloom.storage import settle

NAMES = [("Сельдь копченая 100 г", "Рыба копченая", "Копчение Сельдь"), ("Скумбрия г/к филе", "Рыба копченая", "Копчение Скумбрия"),
         ("Сёмга с/с кусок", "Красная рыба", "#КР_Семга"), ("Форель с/с в/у", "Красная рыба", "#КР_Форель"),
         ("Имбирь маринованный", "Закуски", "Имбирь"), ("Икра красная стекло", "Икорная", "Икра"),
         ("Набор", None, None), ("Сельдь филе", "Рыба копченая", "Сельдь"), ("Нечто филе", "Закуски", "Прочее"),
         ("Хек мяса", "Да мяса", "Прочее")]
TEXTS = ["копчёная сельдь", "сёмга", "маринованный имбирь", "филе", "нет такого", "рыба", "икра", "мяса"]


@pytest.fixture(scope="module")
def search(spark):
    docs = spark.createDataFrame([(i, *n) for i, n in enumerate(NAMES)], "doc_id bigint, name string, category string, grp string")
    queries = spark.createDataFrame([(t, t) for t in TEXTS], "qid string, text string")
    docs, queries = embedding.encode_names(retrieval.describe(docs), retrieval.describe(queries, "text"), features=64)
    return settle(queries), settle(docs)


ALL = {"category": retrieval.category_all, "lexical": retrieval.lexical_all, "structured": retrieval.structured_all,
       "dense": retrieval.dense_all, "rerank": lambda q, d: retrieval.rerank_all(q, d, pool=4)}
TOP = {"category": retrieval.category_top, "lexical": retrieval.lexical_top, "structured": retrieval.structured_top,
       "dense": retrieval.dense_top, "rerank": lambda q, d, k: retrieval.rerank_top(q, d, k, pool=4)}


@pytest.mark.parametrize("method", list(ALL))
@pytest.mark.parametrize("k", [1, 3, 7])
def test_top_k_is_the_head_of_the_full_ranking(search, method, k):
    full = ALL[method](*search)
    top = TOP[method](*search, k)
    a = sorted((r.qid, r.doc_id, round(r.score, 9), r["rank"]) for r in full.collect() if r["rank"] <= k)
    b = sorted((r.qid, r.doc_id, round(r.score, 9), r["rank"]) for r in top.collect())
    assert a == b


@pytest.mark.parametrize("method", list(ALL))
def test_full_rankings_are_complete_and_ordered(search, method):
    got = {}
    for r in ALL[method](*search).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.score, r.doc_id))
    assert set(got) == set(TEXTS)
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(NAMES) + 1))
        assert [(-s, d) for _, s, d in rows] == sorted((-s, d) for _, s, d in rows)


def test_categories(search):
    queries, docs = search
    cats = docs.select("category").filter("category is not null").distinct()
    got = {r.qid: (r.cat, r.cat_score) for r in retrieval.best_category(queries, "qid", cats).collect()}
    # Roots "копч" and "рыба" are shared; ties take the lowest name; no overlap takes it with 0.
    assert got["копчёная сельдь"] == ("Рыба копченая", 1.0)
    assert got["рыба"] == ("Красная рыба", 1.0)
    assert got["нет такого"] == ("Да мяса", 0.0)
    # "Хек" has 3 letters and is no root, so tokens decide.
    short = retrieval.describe(queries.sparkSession.createDataFrame([("a", "да хек")], "qid string, text string"), "text")
    cats = queries.sparkSession.createDataFrame([("Хек да",), ("Ааааа",)], "category string")
    assert tuple(retrieval.best_category(short, "qid", cats).first()) == ("a", "Хек да", 1.0)


def test_misspelt_words_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(60)]
    terms = ["".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(40)] + ["aaaaaa", "ababab", ""]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        return new

    left, right = (spark.createDataFrame([(w,) for w in ws], f"{n} string") for ws, n in ((words, "w"), (terms, "t")))
    for least in (0.5, 0.7):
        got = {(r.w, r.t): r.alike for r in retrieval.alike_words(left, right, least).collect()}
        want = {(w, t): 1 - edits(w, t) / max(len(w), len(t)) for w in words for t in terms if t}
        want = {k: v for k, v in want.items() if v >= least - 1e-12}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError, match="half"):
        retrieval.alike_words(left, right, 0.4)


def test_misspelt_category(spark):
    cats = spark.createDataFrame([("Рыба копченая",), ("Икорная",), ("Да мяса",)], "category string")
    texts = spark.createDataFrame([("кпоченая",), ("ккорная",), ("zzz",)], "text string")
    got = {r.text: (r.cat, round(r.cat_score, 3)) for r in retrieval.best_category(retrieval.describe(texts, "text"), "text", cats).collect()}
    assert got == {"кпоченая": ("Рыба копченая", 0.75), "ккорная": ("Икорная", 0.857), "zzz": ("Да мяса", 0.0)}


def test_rerank_tail(search):
    rows = [r for r in ALL["rerank"](*search).collect() if r.qid == "сёмга"]
    rows.sort(key=lambda r: r["rank"])
    pool, tail = rows[:4], rows[4:]
    assert {r.score for r in tail} == {pool[-1].score - 1.0}
    assert [r.doc_id for r in tail] == sorted(r.doc_id for r in tail)


def test_find_products(search):
    got = retrieval.find_products(*search, threshold=1.0, pool=4, topk=2).collect()
    best = {r.qid: r for r in got if r["rank"] == 1}
    assert best["сёмга"].name == "Сёмга с/с кусок" and best["сёмга"].grp == "#КР_Семга"
    assert all(r.score >= 1.0 for r in got)
    whole = retrieval.find_products(*search, pool=4)
    assert whole.count() == len(TEXTS) * len(NAMES)


def test_blocks_change_nothing(search, monkeypatch):
    near = sorted((r.qid, r.doc_id, round(r.score, 9)) for r in retrieval.dense_scores(*search).collect())
    cut = sorted((r.qid, r.doc_id, round(r.score, 9)) for r in retrieval.dense_scores(*search, query_block=2, doc_block=3).collect())
    assert cut == near
    pairs = retrieval.every_pair(search[0].select("qid"), search[1].select("doc_id"), 2, 3).select("q.qid", "doc_id").collect()
    assert sorted(pairs) == sorted((r[0], r[1]) for r in near)


@pytest.fixture(scope="module")
def gold(spark, search):
    """Some relevant documents of every query, found or not."""
    pairs = [(q, d) for i, q in enumerate(TEXTS) for d in range(len(NAMES)) if (d * 7 + i * 3) % 4 < 2]
    return settle(spark.createDataFrame(pairs, "qid string, doc_id bigint"))


def test_gold_ranks_equal_the_full_ranking(search, gold):
    queries, docs = search
    got = sorted(tuple(r) for r in goldranks.all_gold_ranks(queries, docs, gold, 4).select("method", "qid", "doc_id", "rank").collect())
    full = None
    for method, rank in ALL.items():
        part = rank(queries, docs)
        full = part if full is None else full.unionByName(part)
    want = sorted(tuple(r) for r in full.join(gold, ["qid", "doc_id"], "left_semi").select("method", "qid", "doc_id", "rank").collect())
    assert got == want
    metrics = lambda r, **o: sorted(map(str, rankeval.rank_metrics(r, gold, 3, **o).collect()))
    ranks = goldranks.all_gold_ranks(queries, docs, gold, 4)
    assert metrics(ranks, methods=goldranks.METHODS) == metrics(full)


def test_beaten_vectors_are_counted(spark):
    rng = np.random.default_rng(1)
    vecs = [list(map(float, rng.integers(-2, 3, 6) / 4)) for _ in range(60)]  # many ties
    docs = settle(spark.createDataFrame([(i, v) for i, v in enumerate(vecs)] + [(99, None)], "doc_id bigint, vec array<double>"))
    queries = settle(spark.createDataFrame([(f"q{i}", vecs[i]) for i in range(7)] + [("none", None)], "qid string, vec array<double>"))
    gold = settle(spark.createDataFrame([(f"q{i}", d) for i in range(7) for d in range(i, 60, i + 1)] + [("none", 3), ("q0", 99)],
                                        "qid string, doc_id bigint"))
    full = retrieval.dense_all(queries, docs).join(gold, ["qid", "doc_id"], "left_semi").select("method", "qid", "doc_id", "rank")
    want = sorted(tuple(r) for r in full.collect())
    for counted in (goldranks.COUNTED, 12, 0):
        got = goldranks.dense_ranks(queries, docs, gold, counted, 3, 11).select("method", "qid", "doc_id", "rank")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_approximate_search_finds_most(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    vecs = [list(map(float, centres[i % 30] + 0.4 * rng.standard_normal(24))) for i in range(3000)]
    docs = settle(spark.createDataFrame([(i, v) for i, v in enumerate(vecs)] + [(9999, None)], "doc_id bigint, vec array<double>"))
    queries = settle(docs.filter("doc_id % 60 = 0").withColumnRenamed("doc_id", "qid"))
    exact = settle(retrieval.dense_top(queries, docs, 10))
    index = vectorindex.build_index(docs, doc_block=40)
    assert index.lists.count() == 3000
    near = settle(vectorindex.approximate_top(index, queries, 10, query_block=20))
    found = vectorindex.recall(near, exact).agg({"found": "sum", "exact": "sum"}).first()
    assert found["sum(found)"] >= 0.9 * found["sum(exact)"]
    assert near.groupBy("qid").count().filter("count > 10").isEmpty()
    assert 1 <= index.probes < len(index.centres) / 2
    whole = vectorindex.approximate_top(index, queries, 10, len(index.centres), "dense")
    key = lambda r: (r.qid, r["rank"], r.doc_id)
    assert sorted(map(key, whole.collect())) == sorted(map(key, exact.collect()))
    none = vectorindex.build_index(docs.limit(0))
    assert vectorindex.approximate_top(none, queries, 10).isEmpty()


def test_gold_rules(spark, search):
    rules = spark.createDataFrame([("a", "contains", "имбирь"), ("b", "equals", "Икра"), ("c", "starts", "Копчение С"),
                                   ("d", "equals", "икра")], "qid string, kind string, value string")
    got = {(r.qid, r.doc_id) for r in rankeval.gold_documents(rules, search[1]).collect()}
    assert got == {("a", 4), ("b", 5), ("c", 0), ("c", 1)}
    kept = rankeval.queries_with_gold(rules.select("qid"), rankeval.gold_documents(rules, search[1]))
    assert sorted(r.qid for r in kept.collect()) == ["a", "b", "c"]


def test_rules_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abAB#ж"), rng.integers(0, 7))) for _ in range(120)] + [None, "İstanbul"]
    rules = [(f"r{i}", kind, "".join(rng.choice(list("abAB#ж"), rng.integers(0, 5)))) for i in range(60)
             for kind in ("equals", "contains", "starts")] + [("n", "starts", None), ("i", "contains", "STAN")]
    groups = spark.createDataFrame([(w,) for w in words], "grp string")
    got = {(r.qid, r.grp) for r in rankeval.matched_groups(spark.createDataFrame(rules, "qid string, kind string, value string"), groups).collect()}
    meets = {"equals": str.__eq__, "contains": lambda g, v: v.lower() in g.lower(), "starts": str.startswith}
    assert got == {(q, w) for q, kind, v in rules for w in words if w is not None and v is not None and meets[kind](w, v)}


def test_metrics_match_brute_force(spark):
    rng = np.random.default_rng(2)
    ranking, gold = [], []
    for m in ("m1", "m2"):
        for q in ("q1", "q2", "q3"):
            for i, d in enumerate(rng.permutation(30)):
                ranking.append((m, q, int(d), -float(i), i + 1))
    rel = {"q1": {1, 5, 9}, "q2": set(range(15)), "q3": {29}}
    gold = [(q, d) for q, ds in rel.items() for d in ds]
    frame = spark.createDataFrame(ranking, "method string, qid string, doc_id bigint, score double, rank bigint")
    got = rankeval.rank_metrics(frame, spark.createDataFrame(gold, "qid string, doc_id bigint"), 5).collect()
    assert len(got) == 6
    for r in got:
        order = [d for m, q, d, _, _ in ranking if (m, q) == (r.method, r.qid)]
        hits = [d in rel[r.qid] for d in order]
        n = len(rel[r.qid])
        precision = [sum(hits[:i + 1]) / (i + 1) for i in range(30)]
        ideal = sum(1 / math.log2(i + 2) for i in range(min(n, 5)))
        assert r.p_at_k == pytest.approx(sum(hits[:5]) / 5) and r.r_at_k == pytest.approx(sum(hits[:5]) / n)
        assert r.ap == pytest.approx(sum(p for p, h in zip(precision, hits) if h) / n)
        assert r.rr == pytest.approx(1 / (hits.index(True) + 1))
        assert r.ndcg_at_k == pytest.approx(sum(1 / math.log2(i + 2) for i in range(5) if hits[i]) / ideal)
    summary = rankeval.method_summary(spark.createDataFrame(got)).collect()
    assert [r.map for r in summary] == sorted((r.map for r in summary), reverse=True)


def _scores(spark, table):
    return spark.createDataFrame([(m, f"q{i}", float(v)) for m, vs in table.items() for i, v in enumerate(vs)],
                                 "method string, qid string, ap double")


def test_friedman_hand_computed(spark):
    # Ranks per query 1,2,3 / 1,2,3 / 1,2,3 / 2,1,3: sums 5, 7, 12, chi2 = 12/(4*3*4)*218 - 48 = 6.5.
    df = _scores(spark, {"a": [3, 3, 3, 2], "b": [2, 2, 2, 3], "c": [1, 1, 1, 1]})
    got = rankeval.friedman(df, 3).first()
    assert got.chi2 == pytest.approx(6.5) and got.p == pytest.approx(math.exp(-3.25))
    means = {r.method: r.mean_rank for r in rankeval.mean_ranks(df).collect()}
    assert means == {"a": 1.25, "b": 1.75, "c": 3.0}


def test_friedman_with_ties(spark):
    # One tie of two in the first query: ranks 1.5,1.5,3 / 1,2,3; sums 2.5, 3.5, 6.
    df = _scores(spark, {"a": [2, 3], "b": [2, 2], "c": [1, 1]})
    plain = 12 / (2 * 3 * 4) * (2.5**2 + 3.5**2 + 36) - 24
    assert rankeval.friedman(df, 3).first().chi2 == pytest.approx(plain / (1 - 6 / (3 * 8 * 2)))


def test_nemenyi(spark):
    df = _scores(spark, {"a": [3] * 4, "b": [2] * 4, "c": [1] * 4})
    got = {(r.method_a, r.method_b): r for r in rankeval.nemenyi(df, 3).collect()}
    unit = math.sqrt(3 * 4 / (6 * 4))
    r = got["a", "c"]
    assert r.rank_diff == 2.0 and r.q == pytest.approx(2 / unit) and r.significant
    assert r.critical_diff == pytest.approx(2.343 * unit)
    # Published 5 % point of the studentised range of 3 means, infinite degrees of freedom: 3.314.
    assert not got["a", "b"].significant and 0.0 < r.p < 0.05 < got["a", "b"].p
    two = rankeval.nemenyi(_scores(spark, {"a": [2] * 9, "b": [1] * 9}), 2).first()
    # With two methods the range test is the normal test: q = 1 / sqrt(1/9) = 3.
    assert two.p == pytest.approx(math.erfc(3.0 / math.sqrt(2.0)), abs=1e-6)


def test_name_components(spark, search):
    catalog = search[1].select("name", "doc_id").selectExpr("cast(doc_id as string) as sku", "name")
    parts = settle(embedding.name_components(catalog, 3, features=64))
    assert parts.columns == ["sku", "emb_0", "emb_1", "emb_2"] and parts.count() == len(NAMES)
    pdf = parts.toPandas()
    spread = pdf[["emb_0", "emb_1", "emb_2"]].to_numpy()
    assert np.allclose(spread.mean(0), 0, atol=1e-9)
    assert list(spread.var(0)) == sorted(spread.var(0), reverse=True)
    cov = np.cov(spread.T)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-9)
    panel = spark.createDataFrame([("0",), ("zz",)], "sku string")
    got = {r.sku: r.emb_0 for r in embedding.attach_components(panel, parts).collect()}
    assert got["zz"] == 0.0 and got["0"] == pytest.approx(pdf.set_index("sku").emb_0["0"])

import math

import numpy as np
from pyspark.sql import functions as F

from promoloom.llm import language, mixing, quality

FOLDER = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert np.mean([r.quality == r.predicted for r in held]) > 0.95


def test_quality_votes_equal_brute_force():
    rng = np.random.default_rng(2)
    texts = ["Plain words in a line. " * rng.integers(1, 9) for _ in range(30)] + ["LOUD!! WORDS!! " * rng.integers(1, 9) for _ in range(20)]
    x, y = np.stack([quality.terms(t) for t in texts]), np.array([1.0] * 30 + [0.0] * 20)
    v = quality.fit(x, y, (200, 300))
    score = quality.vote(v, x[:5])
    z = quality.latent(v.project, x)
    for i in range(5):
        sim = np.array([float(z[i] @ w) for w in v.vectors])
        top = sorted(range(len(sim)), key=lambda j: -sim[j])[:quality.NEIGHBOURS]
        w = np.maximum(sim, 0) ** 8 * v.weights
        edge = sorted(sim)[-quality.NEIGHBOURS]
        if (sim == edge).sum() == 1:
            assert abs(score[i] - (w[top] @ v.labels[top]) / w[top].sum()) < 1e-5
    assert (score > 0.5).all()


def test_quality_of_odd_rows(spark, odd_rows, no_rows):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(odd_rows, labels).collect()}
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got.values())
    assert got[3].score == got[4].score
    assert quality.classify(no_rows, labels).count() == 0
    assert {r.score for r in quality.classify(odd_rows, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(odd_rows, labels).columns == odd_rows.columns


def test_language_recovers_planted_languages(spark):
    texts = [("the house and the garden are green and the sky is blue " * 3, "en"), ("das haus und der garten sind grün und der himmel ist blau " * 3, "de")]
    docs = spark.createDataFrame(texts * 5 + [(None, "en"), ("unknown", None)], "text string, lang string")
    page = lambda lang, body: f'<html lang="{lang}"><script>x < y</script><body><p>{body}</p><!-- das der und --></body></html>'
    pages = [(i, f"http://{'de' if i % 2 else 'en'}.example.org/{i}", page("de" if i % 2 else "en", texts[i % 2][0][i:])) for i in range(20)]
    # No text: the host, the declaration and the suffix decide.
    pages += [(100, "http://de.example.org/x", page("de", "")), (101, None, None), (102, "not a url", "<"), (None, "http://en.example.org", "")]
    pages += [(103, "http://en.example.org/y", page("", texts[1][0]))]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in language.identify(df, docs).collect()}
    assert [got[i].lang for i in range(20)] == ["de" if i % 2 else "en" for i in range(20)]
    assert got[100].lang == "de" and got[None].lang == "en" and got[103].lang == "de"
    assert 0 < got[101].probability <= 1 and got[101].host == "" and len(got) == 25
    assert language.identify(df.limit(0), docs).count() == 0
    assert {r.lang for r in language.identify(df, docs.limit(0)).collect()} == {None}


def test_visible_text():
    assert language.visible("a<b>c</b><!-- x --><SCRIPT>y<z</script >d&amp;e<style>q").split() == ["a", "c", "d&e"]
    assert language.visible("<" * 10).strip("<") == "" and language.visible("a < b and <i>c") == "a < b and  c" and language.address("http://a.b.co.uk:80/x") == ("a.b.co.uk", "co.uk", "uk")
    assert language.address("http://[::1]/") == ("::1", "::1", "") and language.address("") == ("", "", "")


def test_declared_language_anywhere_in_the_root_tag():
    said = language.declared
    assert said(f'<html class="{"x " * 5000}" data-x="a > b" lang="fr">') == "fr"
    assert said(f'<html{" " * 3000}lang{" " * 99}={" " * 99}DE>') == "de"
    assert said("<html><p lang=fr>") == "" and said('<html data="<" lang=it-IT>') == "it" and said("<htmlx lang=de>") == ""
    for page in ("<html " + '"' * 100_001, "<html " + "lang " * 100_000, "<html " + "lang=" * 100_000):
        said(page)


def by_hand(pages, texts):
    """The operator's rows from dictionary sums over all pages."""
    names = sorted({lang for _, lang in texts if lang is not None})
    counts = np.full((len(names), language.BUCKETS), language.GRAM)
    for t, lang in texts:
        if lang is not None:
            counts[names.index(lang)] += language.grams(t or "")
    model = np.log(counts / counts.sum(1, keepdims=True))
    rows = []
    for key, url, page in pages:
        c = language.grams(language.visible(page or ""))
        n = int(c.sum())
        score = model @ c * (min(n * language.TEMPER, language.MOST_GRAMS) / n if n else 0.0)
        likely = score - score.max()
        rows.append((key, *language.address(url or ""), language.declared(page or ""), likely, np.exp(likely) / np.exp(likely).sum()))
    total, size, n = sum(r[6] for r in rows), len(names), len(rows)
    prior = [(total[i] + 1) / (n + size) for i in range(size)]
    out = []
    for key, host, domain, suffix, said, likely, belief in rows:
        of = lambda at, value: sum(r[6] for r in rows if r[at] == value)
        others = {name: of(at, value) - belief for name, at, value in (("h", 1, host), ("m", 2, domain), ("s", 3, suffix), ("d", 4, said))}
        scores = []
        for i in range(size):
            top = (max(others["m"][i], 0) + language.PARENT * prior[i]) / (max(others["m"].sum(), 0) + language.PARENT)
            own = (max(others["h"][i], 0) + language.PARENT * top) / (max(others["h"].sum(), 0) + language.PARENT)
            score = math.log(own) + likely[i]
            for name in "ds":
                share = (others[name].sum() + language.FEATURE) / (max(n - 1, 0) + language.FEATURE)
                held = max(total[i] - belief[i], 0)
                score += math.log(max((max(others[name][i], 0) + language.FEATURE * share) / (held + language.FEATURE), 1e-12))
            scores.append(score)
        best = int(np.argmax(scores))
        out.append((key, host, said, names[int(np.argmax(likely))], names[best], 1 / sum(math.exp(x - scores[best]) for x in scores)))
    return out


def test_language_equals_sums_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang")
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [pages[0], (None, None, None), (7001, "http://odd.example/", "<p>1 < 2</p>"), (7002, "", f"<html lang='de'>{'wort ' * 30_000}")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, declared string").repartition(3)
    got = sorted((tuple(r) for r in language.identify(df, docs).collect()), key=str)
    want = sorted(by_hand(pages, [tuple(r) for r in docs.collect()]), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 for g, w in zip(got, want))


def taken_by_hand(rows, block_words, weights=mixing.WEIGHTS, repeats=mixing.MAX_REPEATS):
    """Words that a walk over the schedule, slot by slot, takes from each (key, size) of every source."""
    order = sorted({s for _, _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, _, s, _ in rows) else [])
    held = [sorted((m, k, n) for k, n, s, m in rows if s == name) for name in order]
    sizes = [sum(n for _, _, n in h) for h in held]
    goals = [round(t) for t in mixing.targets(sizes, weights, repeats)]
    taken = {}
    for h, size, goal in zip(held, sizes, goals):
        words = [i for i, (_, _, n) in enumerate(h) for _ in range(n)]
        blocks, got, turn = [words[i:i + block_words] for i in range(0, len(words), block_words)], 0, 0
        while got < goal:
            cut = blocks[turn % len(blocks)][:goal - got]
            for i in cut:
                taken[h[i][1]] = taken.get(h[i][1], 0) + 1
            got, turn = got + len(cut), turn + 1
    return taken


def test_mix_equals_a_walk_over_the_schedule(spark):
    rows = [(i, "w " * (i * 7 % 40), ["big", "mid", None][i % 3] if i % 11 else "tiny") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = {r.doc_id: r.m for r in df.select("doc_id", F.xxhash64(F.lit(0), "doc_id", mixing.word_count("text")).alias("m")).collect()}
    for block_words in (7, 100):
        got = {r.doc_id: r.taken for r in mixing.mix(df.repartition(4), block_words=block_words).collect() if r.taken}
        assert got == taken_by_hand([(k, len(t.split()), s, hashed[k]) for k, t, s in rows], block_words)


def test_targets_share_the_excess():
    assert mixing.targets([], (1.0,)) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    got = mixing.targets([10, 1000, 1000])
    assert got[0] == 30.0 and math.isclose(sum(got), 2010) and math.isclose(got[1] / got[2], 2.0)


def test_mix_takes_targets_exactly(spark, odd_rows, no_rows):
    rows = [(i, "w " * (i % 97), "big" if i % 3 else f"s{i % 5}") for i in range(1500)] + [(9999, "x " * 30_000, None), (5000, "one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(5), block_words=50).collect()
    source = {r[0]: r[2] for r in rows}
    by = {}
    for r in got:
        assert r.size == len(dict((x[0], x[1]) for x in rows)[r.doc_id].split()) if r.doc_id < 40 else True
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(source[r.doc_id], []).append(r)
    order = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r.size for r in by[s]) for s in order]
    for s, n, t in zip(order, sizes, mixing.targets(sizes)):
        assert {(r.source_size, r.target) for r in by[s]} == {(n, t)}
        assert sum(r.taken for r in by[s]) == round(t)
    again = mixing.mix(df.repartition(2), block_words=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(odd_rows).count() == 12 and mixing.mix(no_rows).count() == 0


def test_schedule_ranks_follow_the_points(spark):
    needs = {0: 500, 1: 3, 2: 40, 3: 0}
    sources = spark.createDataFrame([(i, 10, 1.0) for i in range(4)], "source_no int, source_size long, target double")
    wanted = spark.createDataFrame(list(needs.items()), "source_no long, need long")
    got = mixing.schedule(spark, sources, wanted).groupBy("source_no").agg(F.count("*").alias("n"), F.max("rank").alias("high"), F.countDistinct("rank").alias("d"))
    got = {r.source_no: r for r in got.collect()}
    assert set(got) == {0, 1, 2} and all(r.n >= needs[k] and r.high + 1 == r.n == r.d for k, r in got.items())


def test_repeated_rows_keep_columns(spark, odd_rows):
    got = mixing.repeat_rows(odd_rows)
    assert got.columns == odd_rows.columns and got.filter("text is null or trim(text) = ''").count() == 0


def test_rows_that_repeat_a_key_are_taken_each_for_itself(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e f", "s"), (1, "d e", "s"), (None, "x y", "t"), (None, "z w", "t"),
            (2, "one two three four", "t"), (3, None, "s"), (4, "k", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df, block_words=2).filter("size > 0").collect()
    want = sum(round(r.taken / r.size) for r in taken)
    got = mixing.repeat_rows(df, block_words=2).collect()
    assert len(got) == want and set(map(tuple, got)) <= set(rows)
    of = lambda rs, k: sum(r.doc_id == k for r in rs)
    for k in (1, 2, 4, None):
        assert of(got, k) == sum(round(r.taken / r.size) for r in taken if r.doc_id == k)
    assert mixing.repeat_rows(df.limit(0)).isEmpty()


def test_mix_of_odd_rows_equals_a_walk(spark, odd_rows):
    rows = [(i, r.text, r.source) for i, r in enumerate(odd_rows.collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = {r.doc_id: (r.n, r.m) for r in df.select("doc_id", mixing.word_count("text").alias("n"), F.xxhash64(
        F.lit(0), "doc_id", mixing.word_count("text")).alias("m")).collect()}
    want = taken_by_hand([(k, hashed[k][0], s, hashed[k][1]) for k, _, s in rows], 500)
    got = mixing.mix(df, block_words=500).collect()
    assert {r.doc_id: r.taken for r in got if r.taken} == want and len(got) == len(rows)
    assert {r.doc_id: r.size for r in got} == {k: n for k, (n, _) in hashed.items()}


def test_many_sources_stay_a_table(spark, monkeypatch):
    rows = [(i, "w " * (i % 23), f"host{i * 7 % 41}" if i % 5 else None) for i in range(400)] + [(900, "x " * 3000, "big"), (901, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(tuple, mixing.mix(df, block_words=20).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    many = sorted(map(tuple, mixing.mix(df, block_words=20).collect()))
    assert [(a[0], a[1], a[2], a[4]) for a in few] == [(b[0], b[1], b[2], b[4]) for b in many]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(few, many))
    assert mixing.mix(df.limit(0)).isEmpty()

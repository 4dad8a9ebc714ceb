import random
import re

import numpy as np
import pytest

from promoloom.llm import exact_dedup, near_dedup, vectors
from promoloom.llm.components import components


def groups(n, links):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(61, 200), rng.randrange(61, 200)) for _ in range(90)] + [(100, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(200, links)
    assert got == {x: want[x] for a, b in links for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_groups(odd_rows, no_rows, support):
    got = exact_dedup.exact_groups(odd_rows, support=support).collect()
    rows = odd_rows.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    members = {}
    for r in rows:
        members.setdefault(norm(r.text), []).append(r.doc_id)
    want = [(r.doc_id, min((x for x in members[norm(r.text)] if x is not None), default=None), len(members[norm(r.text)])) for r in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_groups(no_rows).count() == 0
    assert exact_dedup.drop_copies(odd_rows).columns == odd_rows.columns


def shingle_links(texts, size):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return sets, [(i, j) for i in range(len(sets)) for j in range(i)
                  if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]


def made_texts(n, seed):
    """Texts around the threshold: edited copies, shared passages, short ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(400))
    passage = " ".join(word() for _ in range(60))
    roots, out = [[word() for _ in range(rng.choice([3, 12, 40, 90, 200]))] for _ in range(6)], []
    for _ in range(n):
        w = list(rng.choice(roots))
        for _ in range(int(len(w) * rng.choice([0, 0.02, 0.05, 0.08, 0.1, 0.15]))):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w) if rng.random() < 0.8 else " ".join([word() for _ in range(rng.randrange(30))]) + " " + passage)
    return out


@pytest.mark.parametrize("size,short", [(2, 48), (5, 3)])
def test_near_groups_equal_brute_force(spark, monkeypatch, size, short):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    texts = made_texts(150, size) + [None, "", "  ", "one", "One"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in near_dedup.near_groups(df, size=size).collect()}
    sets, links = shingle_links(texts, size)
    want = groups(len(texts), links)
    assert len(links) > 100
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


@pytest.mark.parametrize("percent", [60, 70, 100])
def test_sets_on_both_sides_of_the_sketch_meet(spark, percent):
    rng = random.Random(percent)
    texts = []
    for n in (40, 46, 52, 60, 64, 70, 90):
        words = [f"{n}-{i}" for i in range(n)]
        # A prefix of the words with just the share of the shingles that links.
        texts += [" ".join(words), " ".join(words[:-(-(n - 1) * percent // 100) + 1]), " ".join(words[:rng.randrange(20, n)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, _ = shingle_links(texts, 2)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, size=2, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == groups(len(texts), links) and len(links) >= 7


def test_near_groups_of_odd_rows(odd_rows, no_rows):
    got = near_dedup.near_groups(odd_rows).collect()
    assert len(got) == odd_rows.count()
    by = {r.doc_id: r for r in got}
    assert (by[2].component_id, by[9].component_id, by[4].component_id, by[3].n_shingles) == (1, 1, 4, 0)
    assert near_dedup.near_groups(no_rows).count() == 0
    kept = near_dedup.drop_near(odd_rows)
    assert kept.columns == odd_rows.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, None, 10}


def cosine_links(vs, ok):
    u = [np.array(v, float) / np.linalg.norm(v) if k else None for v, k in zip(vs, ok)]
    return [(i, j) for i in range(len(vs)) for j in range(i) if ok[i] and ok[j] and len(vs[i]) == len(vs[j]) and u[i] @ u[j] >= 0.9]


def test_near_vectors_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((1500, 64))
    for i in range(0, 1500, 3):
        base[i + 1] = base[i] / np.linalg.norm(base[i]) + rng.standard_normal(64) * rng.uniform(0.005, 0.05)
    base[1200:1300] = base[1200] + rng.standard_normal((100, 64)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    links = cosine_links(base, [True] * len(base))
    want = np.bincount([x for p in links for x in p], minlength=len(base))
    found = np.array([got[i].n_links for i in range(len(base))])
    assert (found <= want).all()
    assert found.sum() >= 0.9 * want.sum()


def test_near_vectors_count_links_at_both_ends(spark, monkeypatch):
    def one_way(index, x, *_):
        return [list(range(h + 1)) for h in vectors.nearest(x, index.centres)]

    # Each pair across lists is found by one end alone.
    monkeypatch.setattr(vectors, "probes", one_way)
    monkeypatch.setattr(vectors, "LIST_ROWS", 20)
    rng = np.random.default_rng(4)
    one, across = rng.standard_normal((2, 150, 16))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    across -= (across * one).sum(1, keepdims=True) * one
    other = 0.905 * one + np.sqrt(1 - 0.905 ** 2) * across / np.linalg.norm(across, axis=1, keepdims=True)
    vs = np.concatenate([one, other, one[:9], other[3:6]])  # with copies of either end
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()))
    links = cosine_links(vs, [True] * len(vs))
    n = np.bincount([x for p in links for x in p], minlength=len(vs))
    want = groups(len(vs), links)
    assert got == [(i, int(n[i]), want[i], want[i] == i) for i in range(len(vs))]


def test_near_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vs = [[1.0, 0.0], [2.0, 0.0], [1.0, 0.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [], [0.0, 1.0], [1.0], [5.0], [0.9, 0.1]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vs)], "vec_id long, embedding array<double>, list string")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()))
    ok = [bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vs]
    links = cosine_links(vs, ok)
    n = np.bincount([x for p in links for x in p], minlength=len(vs))
    want = groups(len(vs), links)
    assert got == [(i, int(n[i]), want[i], want[i] == i) for i in range(len(vs))]
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("rank", [8, 20, 384])
def test_probing_finds_links_in_few_directions(rank):
    n, dim = 40_000, 384
    rng = np.random.default_rng(rank)
    one, across = rng.standard_normal((2, n // 2, rank))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    across -= (across * one).sum(1, keepdims=True) * one
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.92, (n // 2, 1))
    turned = np.linalg.qr(rng.standard_normal((dim, rank)))[0].T
    x = vectors.unit(np.concatenate([one, cos * one + np.sqrt(1 - cos ** 2) * across]) @ turned)
    index = vectors.fit(x[rng.choice(n, vectors.SAMPLE, replace=False)], n)
    home = vectors.nearest(x, index.centres)
    lists = vectors.probes(index, x, home, 0.9)
    half = n // 2
    found = [home[i + half] in lists[i] or home[i] in lists[i + half] for i in range(half)]
    assert len(index.centres) == 200 and np.mean(found) >= 0.99
    assert np.mean([len(p) for p in lists]) < 25


def test_few_and_many_links_give_the_same_components(spark, monkeypatch):
    from promoloom.llm import components as module

    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, i) for i in range(401, 440)]
    df = spark.createDataFrame(links, "a long, b long")
    want = sorted(map(tuple, components(df).collect()))
    monkeypatch.setattr(module, "PART_LINKS", 10)
    assert sorted(map(tuple, components(df).collect())) == want


def test_stars_come_out_as_they_went_in(spark):
    links = [(i, 0) for i in range(1, 9)] + [(12, 10)]
    got = sorted(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == sorted({(a, b) for a, b in links} | {(0, 0), (10, 10)})


def test_rows_that_repeat_key_and_text_are_one(spark):
    rows = [(1, "a b", 1), (1, "a  b", 2), (1, "c", 3), (2, "a b", 4), (None, "n", 5), (None, "n", 6), (3, None, 7), (3, "", 8), (4, "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stays int")
    got = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(df).collect()), key=str)
    assert len(got) == 4 and {(k, " ".join((t or "").split())) for k, t in got} == {(1, "a b"), (1, "c"), (None, "n"), (3, "")}
    assert exact_dedup.drop_copies(df).columns == df.columns


def test_near_vectors_of_null_and_repeated_keys(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.99, 0.05]), (7, [2.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (8, [0.0, 3.0]), (None, None), (9, [-1.0, 0.0]),
            (None, [-1.0, -1.0])]
    got = sorted(map(tuple, vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    want = [(5, 3, 5, True), (5, 3, 5, True), (7, 3, 5, False), (None, 3, 5, False), (None, 1, 8, False), (8, 1, 8, True),
            (None, 0, None, True), (9, 0, 9, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)

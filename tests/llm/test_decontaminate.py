import hashlib
import random
import re

from pyspark.sql import functions as F

from promoloom.llm import decontaminate as D
from promoloom.llm import queries
from promoloom.llm.suffixes import SuffixAutomaton, Windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute_force(texts, items, width):
    out = []
    windows = [(name, w[i:i + k]) for name, t in items for w in [words(t)] for k in [min(len(w), width)] if k
               for i in range(len(w) - k + 1)]
    for t in texts:
        w, hit, found = words(t), set(), set()
        for name, g in windows:
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add(name)
        out.append((len(w), sorted(hit), sorted(found, key=lambda x: (x is not None, x))))
    return out


def test_automaton_follows_the_longest_run():
    rng = random.Random(2)
    for _ in range(60):
        items = [[rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 5))]
        runs = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
        stream = [rng.randrange(4) for _ in range(60)]
        auto = SuffixAutomaton(items)
        for i, (state, run) in enumerate(auto.follow(stream), 1):
            want = max((n for n in range(min(i, 9) + 1) if not n or tuple(stream[i - n:i]) in runs))
            assert run == want
            assert state == 0 if run == 0 else auto.length[auto.link[state]] < run <= auto.length[state]


def test_windows_equal_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        items = [[rng.randrange(3) for _ in range(rng.randint(0, 8))] for _ in range(rng.randint(1, 6))]
        stream, width = [rng.randrange(3) for _ in range(25)], rng.randint(1, 6)
        spans, found = Windows(items, width).hits(stream)
        [(_, hit, names)] = brute_force([" ".join(map(str, stream))], [(i, " ".join(map(str, x))) for i, x in enumerate(items)], width)
        assert sorted(x for a, b in spans for x in range(a, b)) == hit and sorted(found) == names
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def made(rng):
    vocabulary = ["alpha", "Beta", "gamma9", "éa", "Straße", "x", "y1", "ſ"]
    say = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i % 9, say(rng.randint(0, 16))) for i in range(12)] + [(None, "alpha alpha y1"), (50, None), (51, "...")]
    texts = [say(rng.randint(0, 60)) for _ in range(30)] + [None, "", "?!", *[f"{say(3)} ; {t} / {say(2)}" for _, t in items if t]]
    return items, texts


def test_overlaps_equal_brute_force(spark):
    items, texts = made(random.Random(8))
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, words int")
    docs = spark.createDataFrame([(i % 20 or None, t, "n", 3) for i, t in enumerate(texts)],
                                 "doc_id long, text string, items string, n_words int").repartition(3)
    named = [(None if a is None else str(a), b) for a, b in items]
    for width, block in ((4, D.BLOCK_BYTES), (4, 300), (10, 150)):
        want = sorted(((i % 20 or None, *x) for i, x in enumerate(brute_force(texts, named, width))), key=str)
        got = D.find_overlaps(docs, bench, width=width, block_bytes=block).collect()
        assert sorted(((r.doc_id, r.n_words, [x for s in r.spans for x in range(s.first, s.last)], list(r["items"])) for r in got), key=str) == \
            [(k, n, hit, names) for k, n, hit, names in want]


def test_spans_are_cut_out(spark):
    items, texts = made(random.Random(3))
    texts.append("KEEP This, alpha BETA gamma9 éa x end.")
    items.append((99, "alpha beta gamma9 éa"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in D.without_overlaps(docs, bench, width=4).collect()}
    spans = {r.doc_id: r.spans for r in D.find_overlaps(docs, bench, width=4).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        for s in spans[i]:
            want, at = want + t[at:s.start], s.end
            assert words(t[s.start:s.end]) == words(t)[s.first:s.last]
        assert got[i].text == (t if t is None else want + t[at:]) and got[i].spans == 5
    few = {r.doc_id: r.text for r in D.without_overlaps(docs, bench, width=4, max_words=6, max_coverage=1.0).collect()}
    assert any(few[i] == t != got[i].text for i, t in enumerate(texts))
    most = {r.doc_id: r.text for r in D.without_overlaps(docs, bench, width=4, max_words=10**6, max_coverage=0.5).collect()}
    for i, t in enumerate(texts):
        hit = sum(s.last - s.first for s in spans[i])
        assert most[i] == (got[i].text if hit > 0.5 * len(words(t)) else t)


def test_odd_rows(spark, odd_rows, no_rows):
    bench = spark.createDataFrame([(1, "lazy dog again and again"), (2, "word " * 30), (3, None)], "item_id long, text string")
    got = D.find_overlaps(odd_rows, bench).collect()
    want = brute_force([r.text for r in odd_rows.collect() if len(r.text or "") < 1000], [("1", "lazy dog again and again")], 10)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_rows.collect())
    assert sum(bool(r.spans) and "1" in r["items"] for r in got) == sum(bool(x[1]) for x in want) == 3
    long = next(r for r in got if r.doc_id == 6)
    assert len(long.spans) == 1 and long.spans[0].last == 60_000 == long.n_words and long["items"] == ["2"]
    assert D.find_overlaps(no_rows, bench).count() == 0
    none = D.find_overlaps(odd_rows, bench.limit(0))
    assert none.filter(F.size("spans") > 0).isEmpty() and none.count() == odd_rows.count()
    assert D.without_overlaps(no_rows, bench).count() == 0


def test_query_names_its_columns(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op11_decontaminate(spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    clean = got.filter("not contaminated").first()
    assert clean.items_sha256 == hashlib.sha256(b"").hexdigest() and clean.n_hit == clean.n_items == 0

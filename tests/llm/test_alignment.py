import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from promoloom.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text):
    """(id, bytes) of both sides by the libraries; none where they don't spell space and text."""
    if not text:
        return [], []
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    enc = a.encode(" " + text, add_special_tokens=False)
    chars = {c: i for i, c in enumerate(alignment.byte_characters())}
    left = [(i, bytes(chars[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
             for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def groups_of(left, right):
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (left, right)]
    out, at = [], [0, 0]
    for border in sorted(ends[0] & ends[1]):
        group = []
        for k, side in enumerate((left, right)):
            ids = []
            while at[k] < len(side) and sum(len(x) for _, x in side[:at[k] + 1]) <= border:
                ids.append(side[at[k]][0])
                at[k] += 1
            group.append(ids)
        out.append(group)
    return out


def brute_force(texts):
    every = [groups_of(*tokens(t)) for t in texts]
    links = [Counter((a, b) for g in gs for a in g[0] for b in g[1]) for gs in every]
    docs = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = []
    for gs, c in zip(every, links):
        written = ";".join("|".join(",".join(map(str, x)) for x in g) for g in gs)
        out.append((sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(c.values()),
                    sum(n for p, n in c.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in c.items()), written))
    return out, docs


TEXTS = ["The quick brown fox.", "The quick brown fox.", None, "", " ", "  two  spaces", "Ünïcödé Σίσυφος 漢字かな \U0001F600",
         "<|endoftext|> and <s> <unk>", "tab\tnew\nline\r\n", "a▁b", "x" * 300, "ababab" * 40, "1234567890" * 9, "null\0byte",
         "nbsp  ﬁ ligature ① ㍿", "word " * 200, "é é"]


def test_equals_brute_force(spark):
    want, docs = brute_force(TEXTS)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, block long").repartition(3)
    for block_pairs in (1, 50, alignment.BLOCK_PAIRS):
        got = sorted(alignment.align(df, A, B, block_pairs=block_pairs).collect())
        assert [tuple(r)[1:] for r in got] == want
    assert sum(r[0] == 0 for r in want) >= 2
    table = {(r.a, r.b): r.docs for r in alignment.translation_table(df, A, B).collect()}
    assert table == dict(docs)
    hashed = sorted(alignment.align(df, A, B, digests=True).collect())
    assert [r.groups for r in hashed] == [hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want]


def test_large_groups_are_linked_id_by_id(spark, monkeypatch):
    left, right = [[3, 3, 5, 1, 2]], [[7, 7, 7, 8, 9]]
    a = alignment.Side([bytes(n) for n in (1, 3, 2, 2, 2, 2)], ",", "|")
    b = alignment.Side([bytes(n) for n in (1, 1, 1, 1, 1, 1, 1, 1, 3, 5)], ",", ";")
    want = alignment.Aligned(left, right, a, b)
    for limit in (0, 1, 100):
        monkeypatch.setattr(alignment, "LAID_OUT", limit)
        got = alignment.Aligned(left, right, a, b).pairs()
        assert sum(got[2]) == want.n_links.sum()
        assert [x.tolist() for x in got] == [x.tolist() for x in want.pairs()]


def test_groups_break_where_both_end():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = [rng.integers(1, 5, rng.integers(1, 20)) for _ in range(2)]
        total = max(s.sum() for s in sizes)
        sizes = [np.append(s, total - s.sum()) if s.sum() < total else s for s in sizes]
        ends = [np.cumsum(s) for s in sizes]
        group = alignment.coalesce(np.concatenate([e - s for e, s in zip(ends, sizes)]), np.concatenate(ends),
                                   np.repeat([0, 1], [len(s) for s in sizes]))
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        want = np.concatenate([np.searchsorted(both, e) for e in ends])
        assert group.tolist() == want.tolist()


def test_odd_rows(spark, odd_rows, no_rows):
    rows = odd_rows.collect()
    short = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 10_000]
    got = alignment.align(odd_rows, A, B).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
    want, _ = brute_force([t for _, t in short])
    by_key = Counter((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) for r in got)
    assert all(by_key[str(k), *w[:4], w[-1]] for (k, _), w in zip(short, want))
    long = {r.doc_id: r for r in got if r.doc_id in (6, 7)}
    assert long[6].n_a >= 60_000 and long[7].n_links >= long[7].n_a
    assert alignment.align(no_rows, A, B).count() == 0 and alignment.translation_table(no_rows, A, B).count() == 0


def test_query_equals_brute_force_on_a_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op13_alignment(spark, folder).collect()}
    assert len(got) == len(rows)
    assert list(got.values())[0].asDict().keys() == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    for r in rows[:40]:
        left, right = tokens(r.text[:4000]) if len(r.text) <= 4000 else (None, None)
        if left is not None:
            gs = groups_of(left, right)
            written = ";".join("|".join(",".join(map(str, x)) for x in g) for g in gs)
            assert got[r.doc_id].groups_sha256 == (hashlib.sha256(written.encode()).hexdigest() if gs else "")
            assert got[r.doc_id].n_links == sum(len(a) * len(b) for a, b in gs)


def test_both_encoders_of_the_first_side_agree_below_u0100():
    both = alignment.Tokenizers(A, B)
    assert both.quick is not None
    chars = [chr(c) for c in range(256)]
    texts = [" " + a + b for a in chars for b in chars] + ["x" + a + b + "y" for a in chars for b in chars[:64]]
    rng = np.random.default_rng(7)
    texts += ["".join(chars[c] for c in rng.integers(0, 256, 40)) for _ in range(3000)]
    texts += ["".join(rng.choice(list("  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0'stremvd1²¼ªµß×.!"), 30)) for _ in range(20_000)]
    want = [e.ids for e in both.first.encode_batch_fast(texts, add_special_tokens=False)]
    assert [both.quick.encode_ordinary(t) for t in texts] == want
    assert both._first_ids([" a", " 漢字", " é", " <|endoftext|>"]) == [e.ids for e in both.first.encode_batch_fast(
        [" a", " 漢字", " é", " <|endoftext|>"], add_special_tokens=False)]

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from promoloom.llm import pii, queries, secret_scan
from promoloom.llm import text as text_module

ALPHABET = "ab9@.-+ 0123456789(fAKIAX:='\"_tokenpasswd\n"


def by_contract_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def by_contract_secrets(t):
    assign = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", m.start(), m.end()) for m in re.finditer(assign, t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet=ALPHABET, max_size=80), st.text(alphabet="1.2+ -5@a", max_size=60)))
def test_contract_spans(t):
    assert [s[:3] for s in pii.spans(t) if s.kind in pii.BASE] == by_contract_pii(t)
    assert secret_scan.base_parts(t) == by_contract_secrets(t)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "abc123", "AKIA" + "B2" * 9,
                                 "0a" * 13, "x"]), max_size=12).map("".join))
def test_contract_secret_spans(t):
    assert secret_scan.base_parts(t) == by_contract_secrets(t)


def test_checksums_and_context():
    kinds = lambda t: [s.kind for s in pii.spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("SSN: 078-05-1120") == ["ssn"] and kinds("part 078-05-1120") == []
    near, far = pii.spans("call +1 555 010 9999")[0], pii.spans("+1 555 010 9999")[0]
    assert near.score > far.score


def test_ibans_end_at_their_own_border():
    found = lambda t: [t[s.start:s.end] for s in pii.spans(t) if s.kind == "iban"]
    de, gb = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    for after in (" BIC COBADEFFXXX", " 2024-05-01", " 7", " X", ", BIC", "\nBIC", ""):
        assert found(f"IBAN {de}{after}") == [de]
        assert found(f"IBAN {de.replace(' ', '')}{after}") == [de.replace(" ", "")]
    assert found(f"{de} {gb} {de}") == [de, gb, de]
    assert found(f"DE88 3704 0044 0532 0130 00 {gb} EUR") == [gb]
    assert found(f"AB12 {de} BIC") == [de]
    # A code without a known size ends at the last token border that mod 97 confirms.
    body = "0000 1111 2222 3333"
    check = next(f"{n:02d}" for n in range(2, 99) if pii.mod97(f"ZZ{n:02d}" + body.replace(" ", "")))
    other = f"ZZ{check} {body}"
    assert found(f"{other} EUR") == [other]
    assert found(f"{de.replace(' ', '')}BIC") == [] and found(de + "x") == []


def test_long_runs_of_iban_heads_take_linear_time():
    for t in ("DE89 " * 60_000, "ZZ11 " * 60_000, "DE89" + "A" * 300_000, "AA11 A " * 40_000):
        pii.spans(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "<" * 300_000, "AKIA" * 70_000, "0f" * 150_000,
              "+1 " * 100_000, "token " * 50_000, "https://" * 40_000):
        pii.spans(t)
        secret_scan.weak_parts(t, secret_scan.base_parts(t))


def test_pii_of_odd_rows(odd_rows, no_rows):
    got = pii.find_pii(odd_rows).collect()
    want = [(r.doc_id, by_contract_pii(r.text or "")) for r in odd_rows.collect()]
    assert sorted(((r.doc_id, [tuple(s)[:3] for s in r.spans]) for r in got), key=str) == sorted(want, key=str)
    assert pii.find_pii(no_rows).count() == 0


def near_by_brute_force(t, window):
    base = secret_scan.base_parts(t)
    weak = secret_scan.weak_parts(t, base)
    near = lambda p, q: q[1] < p[2] + window and q[2] > p[1] - window
    out = list(base)
    for p in weak:
        if all(any(secret_scan.ROLES[q[0]] == role and near(p, q) for q in base + weak) for role in secret_scan.NEEDS[p[0]]):
            out.append(p)
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]), s[2]))


def test_linking_equals_brute_force(spark, odd_rows, no_rows):
    import random

    rng = random.Random(5)
    bits = ["user = alice ", "https://db.example.org/x ", "Zz09" * 9 + "qQ7 ", "AKIA" + "Q7" * 10 + " ", "token=abcdef99 ",
            "word " * 5, "pad " * 30, "10.0.0.1:8080 "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (16, 256):
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.find_secrets(df, window=window).collect()}
        assert got == {i: near_by_brute_force(t, window) for i, t in enumerate(texts)}
    rows = secret_scan.find_secrets(odd_rows).collect()
    assert sorted((str(r.doc_id) for r in rows)) == sorted(str(r.doc_id) for r in odd_rows.collect())
    assert secret_scan.find_secrets(no_rows).count() == 0


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_digests_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for query, brute, kinds in ((queries.op1_pii, by_contract_pii, pii.BASE), (queries.op9_secrets, by_contract_secrets, secret_scan.BASE)):
        rows = query(spark, folder).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = brute(texts[r.doc_id])
            assert r.base_sha256 == digest(want)
            assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in want) for k in kinds]
            assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r.spans.split(",")) | {""}


def test_secrets_of_odd_rows(odd_rows):
    got = secret_scan.find_secrets(odd_rows).collect()
    want = [(r.doc_id, by_contract_secrets(r.text or ""), near_by_brute_force(r.text or "", secret_scan.WINDOW)) for r in odd_rows.collect()]
    assert sorted(((r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in got), key=str) == sorted(want, key=str)


def test_queries_name_their_columns(spark):
    folder = "/root/testdata/sf0.001"
    assert queries.op1_pii(spark, folder).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert queries.op9_secrets(spark, folder).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def test_slices_keep_every_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 30, 1, 9)])], names=["text"])
    parts = list(text_module.per_slice([batch], 10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 2

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from promoloom.llm import bpe, token_counts
from promoloom.llm.segmenttree import MergeTable

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def libs():
    out = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
    for t in out.values():
        t.no_padding()
        t.no_truncation()
    return out


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(WORD)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
# Unassigned code points differ between the Unicode versions of the libraries.
@given(st.text(alphabet=st.characters(exclude_categories=["Cn", "Cs"]), max_size=60))
def test_ids_and_text_equal_the_library(libs, encoder, text):
    lib = libs[WORD]
    ids = encoder.encode(text)
    assert ids == lib.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="abcdefghinorst", min_size=1, max_size=200))
def test_shared_and_single_trees_agree_with_the_library(libs, text):
    table = MergeTable(BYTE)
    expected = libs[BYTE].encode(text, add_special_tokens=False).ids
    assert table.encode([text.encode()]) == [expected]
    assert table._merge_one(text.encode()) == expected
    assert table.count([text.encode()])[0] == len(expected)


def test_long_word_is_merged_in_reasonable_time(libs):
    text = "".join(random.Random(3).choices("abcdeh", k=50_000))
    assert MergeTable(WORD).encode([text.encode()])[0] == libs[WORD].encode(text, add_special_tokens=False).ids


def test_encoding_odd_rows(libs, odd_rows, no_rows):
    lib = libs[WORD]
    got = bpe.encode_texts(odd_rows, WORD, digests=True).collect()
    want = []
    for r in odd_rows.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in
                   (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))]
        want.append((r.doc_id, len(ids), *digests))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    whole = bpe.encode_texts(odd_rows.filter("doc_id = 1"), WORD).first()
    assert lib.encode("the quick brown fox jumps over the lazy dog again and again.", add_special_tokens=False).ids == whole.ids
    assert bpe.encode_texts(no_rows, WORD).count() == 0


def test_counts_of_odd_rows(libs, odd_rows, no_rows):
    got = token_counts.token_counts(odd_rows.repartition(3), BYTE).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(libs[BYTE].encode(r.text or "", add_special_tokens=False).ids))
            for r in odd_rows.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(no_rows, BYTE).count() == 0


def test_counts_with_many_blocks(libs, odd_rows, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 50)
    got = token_counts.token_counts(odd_rows.filter("doc_id < 10").coalesce(1), BYTE).collect()
    want = [(r.doc_id, len(libs[BYTE].encode(r.text or "", add_special_tokens=False).ids))
            for r in odd_rows.filter("doc_id < 10").collect()]
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted(want)

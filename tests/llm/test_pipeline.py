import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from promoloom.llm import mixing, near_dedup, quality
from pyspark.sql import functions as F
from test_duplicates import groups, shingle_links
from test_learning import taken_by_hand

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        assert name == "bpe" or out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = (before, docs)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["quality"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert ids(after) == ids(quality.classify(before, labels).filter("predicted = 1"))
    before, after = kept["exact_dedup"]
    texts = {}
    for r in before.orderBy("doc_id").collect():
        texts.setdefault(" ".join(r.text.replace("\n", " ").split(" ")), r.doc_id)
    assert ids(after) == sorted(texts.values())
    before, after = kept["near_dedup"]
    rows = before.orderBy("doc_id").collect()
    low = groups(len(rows), shingle_links([r.text for r in rows], 5)[1])
    assert ids(after) == [rows[i].doc_id for i in sorted(set(low))]
    before, after = kept["mixing"]
    taken = {r.doc_id: round(r.taken / r.size) for r in mixing.mix(before).collect() if r.size}
    assert ids(after) == sorted(k for k, n in taken.items() for _ in range(n))
    before, after = kept["bpe"]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    want = sorted((r.doc_id, len(lib.encode(r.text, add_special_tokens=False).ids)) for r in before.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in after.collect()) == want
    assert near_dedup.near_groups(before).filter("not kept").count() == 0


def by_votes(docs, labels):
    """Keys that the nearest labelled texts accept, neighbour by neighbour."""
    voters, out = quality.train(docs, labels), []
    for r in docs.collect():
        z = quality.latent(voters.project, quality.terms(r.text or "")[None])[0]
        sims = sorted(((float(z @ v), w * y, w) for v, y, w in zip(voters.vectors, voters.labels, voters.weights)), key=lambda x: -x[0])
        near = [(max(s, 0.0) ** 8, wy, w) for s, wy, w in sims[:quality.NEIGHBOURS]]
        total = sum(s * w for s, _, w in near)
        score = sum(s * wy for s, wy, _ in near) / total if total else voters.prior
        edge = abs(score - quality.ACCEPT) < 1e-3
        out.append((r.doc_id, score >= quality.ACCEPT, edge))
    return out


def test_quality_and_mixing_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good(spark, docs, FOLDER).collect()}
    votes = by_votes(docs, labels)
    assert all((k in kept) == yes for k, yes, edge in votes if not edge) and sum(e for *_, e in votes) < 3
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    rows = docs.select("doc_id", "source", F.xxhash64(F.lit(0), "doc_id", mixing.word_count("text")).alias("m")).collect()
    taken = taken_by_hand([(r.doc_id, words[r.doc_id], r.source, r.m) for r in rows], mixing.BLOCK_WORDS)
    copies = {}
    for r in corpus_pipeline.mixed(spark, docs, FOLDER).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    # Spark rounds halves up.
    want = {k: int(np.floor(n / words[k] + 0.5)) for k, n in taken.items()}
    assert copies == {k: n for k, n in want.items() if n}


def test_run_on_odd_and_empty_tables(spark, odd_rows, tmp_path):
    odd = odd_rows.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars"), F.lit("x").alias("stays"))
    again = odd.filter("doc_id in (1, 8)").withColumn("text", F.concat("text", F.lit(" and other words that only this row has")))
    for name, rows in (("odd", odd.unionByName(again)), ("empty", odd.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
            f"{tmp_path}/{name}/labels.parquet")
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    texts = {}
    for r in odd.unionByName(again).collect():
        texts.setdefault(r.doc_id, set()).add(len(lib.encode(r.text or "", add_special_tokens=False).ids))
    assert got and all(r.n_tokens in texts[r.doc_id] and r.n_tokens > 0 for r in got)
    # Of the three copies one row is left, and of the repeated row one text.
    assert {r.doc_id for r in got} <= {1, 6, 7, 8, 10, None} and 9 not in {r.doc_id for r in got}
    none = corpus_pipeline.run(spark, f"{tmp_path}/empty")
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

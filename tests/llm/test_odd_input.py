"""Repeated, empty, null and very long rows; no switches by size; the pipeline's stages against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ordina.llm import langid, minhash, toxicity
from ordina.llm import textvec as tv
from test_minhash import brute

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_ngrams_of_a_long_text_count_once(monkeypatch):
    rng = np.random.default_rng(1)
    buf = np.frombuffer(("Überall äußerst schöne Wörter und numbers 12 " * 40).encode(), np.uint8)
    whole = [x for x in langid.grams(buf, np.array([0, len(buf)]))]
    monkeypatch.setattr(tv, "PIECE", 101)
    got = list(langid.long_grams(buf))
    for n in range(len(langid.GRAMS)):
        assert (np.concatenate(got[n :: len(langid.GRAMS)]) == whole[n]).all()
    for size in range(6):  # shorter than an n-gram
        assert all(len(x) == size for x in langid.grams(buf[:size], np.array([0, size])))
    x = rng.random((40, langid.DIMENSIONS)).astype(np.float32)
    model = langid.train(x / x.sum(axis=1, keepdims=True), ["a", "b"] * 20)
    long_ = model.predict(buf, np.array([0, len(buf)]))
    monkeypatch.setattr(tv, "PIECE", 1 << 20)
    short = model.predict(buf, np.array([0, len(buf)]))
    assert long_[0] == short[0] and np.allclose(long_[1], short[1])


@pytest.mark.parametrize("n", [300, 3000])
def test_rare_markers_tell_at_every_size(n):
    """A word of toxic texts alone is known as soon as chance can't explain it, in small and large samples; common words never are."""
    rng = np.random.default_rng(n)
    rate, texts = 0.12, np.array([8, 40, 200, 60, 3])
    marked = np.array([8, 30, 24, 7, 0])
    common = rng.integers(3, n // 4, 500)
    all_texts, all_marked = np.concatenate([texts, common]), np.concatenate([marked, rng.binomial(common, rate)])
    keep = toxicity.telling(all_texts, all_marked, n, rate)
    assert keep[0] and keep[1] and not keep[2:5].any() and keep[5:].sum() <= 3


def test_runs_of_known_words_once():
    ids = np.zeros((40, 3), np.int64)
    ids[[5, 6, 15, 16, 30], 0] = [1, 2, 1, 2, 3]
    squeezed = toxicity.squeeze(ids, np.array([0, 40]))[0]
    once = toxicity.distinct_runs(squeezed)
    assert len(once) < len(squeezed) and (once[:, 0] > 0).sum() == 3
    net = toxicity.Network.fresh(5)
    net.vectors *= 20
    assert np.allclose(*(net.logits(x, np.array([0, len(x)])) for x in (squeezed, once)))


def words(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n))


def test_near_duplicates_stage_by_row(spark):
    rng = random.Random(2)
    texts = [words(rng, 60) for _ in range(12)]
    near = texts[3].rsplit(" ", 1)[0] + " changed"
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(20, texts[0]), (21, near), (22, None), (23, ""), (24, " \n"), (None, texts[1]), (None, None)]
    rows += [(5, texts[0]), (5, words(rng, 30)), (6, texts[6]), (6, texts[6])]  # repeated ids: another's text, one of its own, itself
    long_ = words(rng, 150_000)
    rows += [(30, long_), (31, long_)]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], KIND).withColumn("key", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = corpus_pipeline.without_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    gone = [(20, texts[0]), (21, near), (5, texts[0]), (6, texts[6]), (6, texts[6]), (31, long_)]
    want = list(rows)
    for g in gone:
        want.remove(g)
    assert kept == sorted(want, key=str)
    assert corpus_pipeline.without_duplicates(spark, docs.limit(0), "").count() == 0


def test_sets_that_share_a_smallest_doc_id(spark):
    """doc 5 leads two sets, and each set has links of its own."""
    rng = random.Random(4)
    one, two = words(rng, 80), words(rng, 80)
    edit = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(5, one), (5, two), (3, edit(one)), (9, edit(two)), (7, one)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 3, False), (9, 5, False)]


def test_a_hub_of_many_and_a_hot_shingle(spark):
    """More members than a run holds, and short texts that share nearly all shingles."""
    rng = random.Random(6)
    base = words(rng, 120).split()
    rows = []
    for i in range(700):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, f"always the same few words here {i % 9} {i}") for i in range(120)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == brute(rows, 2, 80)


def test_language_and_toxicity_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "12 34", "en", "s", 5), (None, "ok", "en", "s", 2)], KIND).select(*docs.columns)
    out = corpus_pipeline.with_language(spark, docs.unionByName(odd), sf)
    assert out.columns == docs.columns and out.where(f"doc_id >= {10**9}").count() == 0
    assert out.count() >= 0.99 * docs.count()
    for stage in (corpus_pipeline.without_toxic, corpus_pipeline.with_language, corpus_pipeline.mixed):
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = corpus_pipeline.without_toxic(spark, docs.unionByName(odd), sf)
    assert kept.where(f"doc_id >= {10**9}").count() == 3

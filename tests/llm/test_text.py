"""Tokens, files, mixing, languages, toxicity: round trips, brute force and held-out accuracy, and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ordina.llm import bpe, langid, mixing, tokens, toxicity
from ordina.llm.storage import Scratch

ODD = ["", " ", "  ", "it's they're 'tention ''s 's don't I'll", "<|endoftext|>x<|endoftext|>", " é　 1½２ ③x", "日本語 😀😀 👍🏽", "x" * 3000, "ab" * 700 + " 's", "\r\n'll  'reee", "'", "  <|endoftext|>  ", None]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_segment_tree_equals_the_library(library):
    rnd = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab'srtvemld  \n\té1½!. <|>_") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    enc = bpe.Encoder(bpe.Merges(bpe.default_tokenizer()), bpe.Merges(bpe.default_tokenizer()).merge, most=500)
    for a in range(0, len(texts), 101):
        part = texts[a : a + 101]
        ids, off, raw, at = enc.checked(part)
        for i, text in enumerate(part):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[off[i] : off[i + 1]].tolist() == want, text
            assert raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_encode_and_decode_columns(spark, library):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df)).collect()
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == (r.text or "")
    assert bpe.encode(df.limit(0)).count() == 0


def test_token_files(spark, library):
    rows = [(i * 3 % 13, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = Scratch(spark, "t").path()
    manifest = tokens.write(df, root, end_id=0)
    got = tokens.load(spark, root).orderBy("start").collect()
    assert sum(s["docs"] for s in manifest["shards"]) == len(rows) == len(got)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    total = 0
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows), key=str)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=str) == want
    for r in got:
        assert r.start == total and r.n_tokens == len(r.ids) // 4
        total += r.n_tokens
    root = Scratch(spark, "t").path()
    tokens.write(df.limit(0), root)
    assert tokens.load(spark, root).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        tokens.local_path("hdfs://a/b")


def fill(sizes, weights, share, most):
    """Water filling, one cap at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, budget = {}, set(names), share * sum(sizes.values())
    while True:
        total = sum(w[s] for s in left)
        over = [s for s in left if budget * w[s] / total > most * sizes[s]] if left else []
        if not over:
            return out | {s: budget * w[s] / total for s in left}
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
            left.discard(s)


def test_mixing(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "a", "a", "b", "é", None])) for i in range(400)] + [(None, "x y", "b"), (7, None, "zero"), (8, "same text", "c"), (8, "same text", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"\S+", t or ""))
    want = fill(sizes, (3, 1, 2), 1.5, 2)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    unique = df.where("doc_id is not null and doc_id <> 8")
    made = mixing.materialise(unique, mixing.mix(unique)).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORDS))).alias("n")).collect()
    sure = {r.source: r.taken for r in mixing.mix(unique).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    assert {r.source: r.n for r in made} == {s: n for s, n in sure.items() if n}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(langid.fold_of(4) != 2))
    got = langid.identify(docs.where(langid.fold_of(4) == 2), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 !? 34", 0.5), (4, "a", 0.5), (5, "é" * 3_000_000, 0.5), (6, "日本", 0.5)], "doc_id long, text string, score double")
    named = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert all(named[i] == ("und", 0.0) for i in (1, 2, 3)) and all(named[i][0] in model.languages for i in (4, 5, 6))
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    """Clean prose with a few marked words among the toxic half, also inflected."""
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(1600):
        words, toxic = rnd.choices(vocabulary, k=rnd.randint(5, 120)), i % 5 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["zorkbad", "Vileness", "vilest", "zorks,"])
        rows.append((i, " ".join(words), rnd.choice(["en", "de"])))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [i % 5 == 0 for i in range(1600)]
    model = toxicity.fit(docs.where(langid.fold_of(3) != 1), marks.where(langid.fold_of(3) != 1))
    got = {r.doc_id: r.score for r in toxicity.classify(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    hit = [(s >= 0.7, held[i]) for i, s in got.items()]
    true = sum(a and b for a, b in hit)
    assert true / sum(b for _, b in hit) > 0.9 and true / max(1, sum(a for a, _ in hit)) > 0.9
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "vilest " + "word " * 700_000, "x"), (3, "zorks", "x")], "doc_id long, text string, score string")
    scores = toxicity.classify(odd, model).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores) and scores[0].score == scores[1].score < 0.7 <= scores[2].score
    none = toxicity.fit(docs, marks.limit(0))
    assert {r.score for r in toxicity.classify(docs.limit(5), none).collect()} == {0.0}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark, "t").table(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() > 0 and all(r.exact for r in last)


def test_toxicity_scores_do_not_depend_on_the_next_text():
    net = toxicity.Network.fresh(40)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 41, (n, 3)) for n in (0, 1, 2, 5, 0, 9, 30, 1, 4, 4)]
    net.vectors *= 20
    score = lambda own: net.logits(np.concatenate([texts[i] for i in own]), np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])]))
    alone = np.array([score([i])[0] for i in range(len(texts))])
    for _ in range(20):
        order = rng.permutation(len(texts))
        assert np.allclose(score(order), alone[order], atol=1e-4)


def test_pipeline_without_languages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.with_language(spark, docs, SF).count() == docs.count() > 0


def test_training_rows_stay_off_the_driver(spark, monkeypatch):
    """The driver gets the trained models: a row each, no row of a sample."""
    from pyspark.sql.classic.dataframe import DataFrame

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    collect, seen = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append((self.columns, collect(self))) or seen[-1][1])
    model = toxicity.fit(docs, labels)
    assert model.net is not None and len(model.place) > 1 and len(model.languages.languages) == 4
    large = [(columns, len(rows)) for columns, rows in seen if len(rows) > 4]  # counts by language
    assert not large and not any("x" in columns or "bucket" in columns for columns, _ in seen)

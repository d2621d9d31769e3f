"""Columns named like those that the operators and stages add for themselves, and very long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_odd_input import words

import corpus_pipeline
from ordina.llm import ann, bpe, hnsw, langid, mixing, tokens
from ordina.llm.storage import Scratch, free

OWN = "_toxic _lang _sure _key _id _size _taken _copy _TARGET key class kept n size taken component_id".split()


def with_own(df):
    return df.withColumns({n: F.lit(i) for i, n in enumerate(OWN)})


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_key int, __KEY int, b int")
    assert free(df, "_key", "b", "c", "c") == ["___key", "_b", "c", "_c"]


def test_stages_keep_columns_of_their_own_names(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000")
    more = with_own(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, more, sf), stage(spark, docs, sf)
        assert got.columns == more.columns, name
        held = got.collect()
        assert all(r[n] == i for r in held for i, n in enumerate(OWN)), name
        assert sorted((r.doc_id, r.text) for r in held) == sorted((r.doc_id, r.text) for r in want.collect()), name
    last = corpus_pipeline.STAGES[-1][1](spark, more.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("y")), sf)
    assert last.where("exact").count() == docs.count()


def test_mix_of_a_very_long_text(spark):
    rng = random.Random(8)
    rows = [(1, words(rng, 200_000), "a"), (2, words(rng, 50), "a"), (3, " \n", "a"), (4, "", None), (5, None, "b")]
    docs = with_own(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = mixing.mix(docs)
    got = {r.doc_id: r for r in plan.collect()}
    assert {i: r.size for i, r in got.items()} == {1: 200_000, 2: 50, 3: 0, 4: 0, 5: 0}
    assert abs(sum(r.taken for r in got.values()) - sum({r.source: r.target for r in got.values()}.values())) <= 1
    made = mixing.materialise(docs, plan).collect()
    for i in (1, 2):
        texts = sorted((r.text for r in made if r.doc_id == i), key=len)
        whole = next(t for j, t, _ in rows if j == i)
        assert sum(len(t.split()) for t in texts) == got[i].taken and all(whole.startswith(t) for t in texts)


@pytest.mark.parametrize("name", ["ids", "IDS", "decoded"])
def test_outputs_replace_columns_of_their_name(spark, name):
    df = spark.createDataFrame([(1, "some text", "old"), (2, None, "old")], f"doc_id long, text string, {name} string")
    rows = bpe.round_trip(df)
    assert len({c.lower() for c in rows.columns}) == len(rows.columns)
    assert {r.doc_id: r.decoded for r in rows.select("doc_id", "decoded").collect()} == {1: "some text", 2: ""}


def test_files_and_vectors_leave_other_columns_out(spark):
    root = Scratch(spark, "t").path()
    docs = spark.createDataFrame([(2, "b", 1, "x"), (1, None, 2, "y")], "doc_id long, text string, tie int, ids string")
    tokens.write(docs, root)
    assert [(r.doc_id, r.start, r.n_tokens) for r in tokens.load(spark, root).orderBy("start").collect()] == [(1, 0, 1), (2, 1, 2)]
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[30:40] = x[:10]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({n: F.lit("clash") for n in "v dim raw shard shards fit n_links query_id rank score list".split()})
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(vecs).collect()}
    assert all(got[i] == (1, i) and got[30 + i] == (1, i) for i in range(10)) and all(got[i] == (0, i) for i in [*range(10, 30), *range(40, 60)])
    near = ann.search(vecs, F.col("vec_id") % 20 == 0, k=5).collect()
    score = x @ x.T
    for q in (0, 20, 40):
        want = sorted((j for j in range(60) if j != q), key=lambda j: (-score[q, j], j))[:5]
        assert len(set(want) & {r.vec_id for r in near if r.query_id == q}) >= 4


def test_languages_replace_columns_of_their_name(spark):
    docs = spark.createDataFrame([(i, t, n) for i in range(12) for t, n in ((f"the cat {i} and the dog", "en"), (f"der Hund {i} und die Katze", "de"))], "doc_id long, text string, lang string")
    rows = langid.identify(docs.withColumn("Score", F.lit("x")).withColumn("lang_pred", F.lit(1)), langid.fit(docs))
    assert len({c.lower() for c in rows.columns}) == len(rows.columns) and all(r.lang == r.lang_pred for r in rows.collect())

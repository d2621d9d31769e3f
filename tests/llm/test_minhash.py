import re
from collections import defaultdict

import pytest

from ordina.llm.components import components
from ordina.llm.minhash import near_duplicates
from ordina.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall(fold(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], k, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, k=k).collect()}
    assert got == want


def test_chains_and_left_over_pairs(spark):
    """Neighbours in a chain of edits are alike, its ends are not: every link is needed."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:j] + [f"x{j}y{t}" for t in range(i)] + words[j + i :])) for j in [20] for i in range(1, 12)]
    rows += [(100 + i, " ".join(words[i : i + 40])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, k=2).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "oNE"), (6, "a b"), (6, "a b"), (None, "a b"), (7, "É b"), (8, "é b"), (9, "z " * 200_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, k=2).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (None, 1, None, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True)], key=str
    )
    assert near_duplicates(docs.limit(0), k=2).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(301)}

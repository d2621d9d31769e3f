import numpy as np
from pyspark.sql import functions as F

from ordina.llm import ann, hnsw

NAN, INF = float("nan"), float("inf")


def made(spark, n=700, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, dim))
    for g in range(0, 120, 4):  # near copies, a chain of them in the last group
        x[g + 1 : g + 4] = x[g] + 0.02 * rng.normal(size=(3, dim))
    x[200:330] = x[200] + 0.01 * rng.normal(size=(130, dim))
    rows = [(i, [float(np.float32(v)) for v in row], i % 3 if not 200 <= i < 330 else 1) for i, row in enumerate(x)]
    odd = [(9001, None, 1), (9002, [0.0] * dim, 1), (9003, [NAN] * dim, 1), (9004, [1.0, None] + [0.0] * (dim - 2), 1), (9005, [INF] * dim, 1), (9006, [], 1), (None, rows[0][1], 0), (9007, rows[0][1], None), (0, rows[0][1], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), rows


def test_neighbours(spark):
    df, rows = made(spark)
    ids, x = np.array([r[0] for r in rows] + [9007]), np.array([r[1] for r in rows] + [rows[0][1]])
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 700, 20):
        score = x @ x[q]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:10]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(abs(s - score[list(ids).index(v)]) < 1e-12 for _, v, s in found)
        hit += len({ids[i] for i in best} & {v for _, v, _ in found})
        total += 10
    assert hit / total >= 0.9
    few = df.where("vec_id in (0, 5, 20) and label is not null")
    assert {(r.query_id, r.vec_id) for r in ann.search(few, F.col("vec_id") % 20 == 0).collect()} == {(0, 5), (0, 20), (20, 0), (20, 5)}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_embedding_duplicates(spark):
    df, rows = made(spark)
    ids, x, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    root = ids.copy()
    for _ in range(50):
        root = np.minimum(root, np.where(link, root[None, :], 10**9).min(axis=1))
    for shard in (4096, 60):
        got = {}
        for r in hnsw.near_duplicates(df, shard=shard).collect():
            got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
        assert all(got[i][0] == (int(link[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(700)), shard
        assert len(got[0]) == 2 and len(set(got[0])) == 1
        assert all(got[i] == [(0, i, True)] for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007)) and got[None] == [(0, None, True)]
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_neighbours_of_the_method_alone(spark):
    """Probes and abandonment together, on a table of more rows than anchors; what is not in a probed list is not found."""
    rng = np.random.default_rng(4)
    n, dim = 20_000, 32
    x = (rng.normal(size=(200, dim))[rng.integers(0, 200, n)] + 1.5 * rng.normal(size=(n, dim))).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = F.col("vec_id") % 100 == 0

    def found(recall):
        got = {}
        for r in ann.search(df, asked, k=10, recall=recall).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert len(got) == n // 100 and all(len(v) == 10 for v in got.values())
        score = x[::100] @ x.T
        score[np.arange(n // 100), np.arange(0, n, 100)] = -np.inf
        best = np.argsort(-score, axis=1)[:, :10]
        return np.mean([len(set(b.tolist()) & got[q]) / 10 for q, b in zip(range(0, n, 100), best)])

    whole, low = found(0.95), found(0.3)
    print("recall asked 0.95, 0.3; found", whole, low)
    assert whole >= 0.9
    # where few lists are probed neighbours are lost, and nothing else brings them back
    assert 0.2 <= low <= 0.38


def test_links_to_a_node_without_a_way():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[1:120:2] = x[0:120:2] + 0.01 * rng.normal(size=(60, 16))
    ids = np.arange(len(x))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.Graph(ids, unit.astype(np.float32))
    lost = ids[:120][ids[:120] != graph.entry]
    for layer in graph.layers:  # as pruning may leave them
        layer[np.isin(layer, lost)] = -1
    want = unit @ unit.T >= 0.98
    np.fill_diagonal(want, False)
    found = hnsw.unpacked(hnsw.links(graph, x, ids, x, 0.98), len(x))
    assert found.sum() > 0 and (found == want).all()


def test_packed_matrices():
    rng = np.random.default_rng(1)
    for r, c in ((1, 1), (9, 30), (1030, 17), (2, 2050)):
        m = rng.random((r, c)) < 0.3
        assert (hnsw.unpacked(hnsw.turned(np.packbits(m, axis=1), c), r) == m.T).all()


def test_a_large_group_of_copies(spark):
    """Thousands of near copies in two shards: every pair is a link."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4600, 16))
    x[:3000] = x[0] + 0.001 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df).collect()}
    assert all(got[i] == (2999, 0) for i in range(3000))


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("raw", F.lit("x"))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 90, 20):
        other = [(-float(np.dot(v, rows[q][1])), i) for i, v in rows if i != q and len(v) == len(rows[q][1])]
        assert [v for _, v in sorted(got[q])] == [i for _, i in sorted(other)[:3]]


def test_sparse_pairs_over_shards(spark):
    """A label of several full shards where one vector in forty has a link, often of another shard."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 24))
    x[:75] = x[75:150] + 0.02 * rng.normal(size=(75, 24))
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df, shard=1500).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.98
    np.fill_diagonal(link, False)
    assert link.sum() >= 140
    first = {i: int(min(i, *np.flatnonzero(link[i]))) if link[i].any() else i for i in range(6000)}
    wrong = [i for i in range(6000) if got[i] != (int(link[i].sum()), first[i], first[i] == i)]
    assert not wrong, len(wrong)

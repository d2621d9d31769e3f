"""Approximate nearest neighbours by inner product: inverted lists and adaptive dimension scan.

* A vector x gets one component more, sqrt(M**2 - |x|**2) with M the largest norm, so that the largest inner product
  is the least distance; then everything is turned by a random rotation.
* Lists come from k-means, in a task, on a random sample bounded in rows and bytes; every row is assigned to one.  How
  many lists a query probes is set from an audit: for AUDITED queries the exact neighbours among all rows are found, EPSILON
  is doubled while the test below would abandon too many of them, and the probes are widened until the asked share of them
  lies in probed lists and is not abandoned.  A query whose lists hold fewer than k others probes more.
* What was found is audited too: while the audited queries' results hold less than the asked share of their neighbours,
  less LEEWAY, probes and epsilon are doubled and the search is done again.
* A list is one chunk, and a hot one is cut into several.  Within a chunk the rotated vectors are scanned
  in column blocks: from the distance over the first d of D columns a hypothesis test tells whether the whole distance
  can still be below the best so far, partial > best * (1 + EPSILON / sqrt(d))**2 * d / D abandons a candidate.
* The best so far is known before the scan: of up to ANCHORS rows of the sample, those in the lists that a query probes
  give it a distance that k candidates reach.  Rows of other lists are no candidates.
* Who is left is scored by the inner product of the original vectors in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without vec_id; vectors of each length are searched by themselves; rows of a query's own vec_id are no candidates of it;
ties go to the smaller vec_id; fewer candidates give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors
from .storage import Scratch, read

#: Lists at most; training vectors for each, and bytes of them all; rows of a chunk, and queries of a block; queries of the audit.
#: ANCHORS, ANCHOR_BYTES: rows of the sample, at most, that are sent to every task.
MOST_LISTS, TRAIN_PER_LIST, TRAIN_BYTES, CHUNK, QUERY_BLOCK, AUDITED = 16384, 64, 128 << 20, 8192, 4096, 64
EPSILON, COLUMN_BLOCK, QUERY_GROUP, ANCHORS, ANCHOR_BYTES, LEEWAY = 2.1, 16, 64, 8192, 16 << 20, 0.05


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(8).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _kmeans(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    rng = np.random.default_rng(13)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        own = _nearest(x, centres, 1)[:, 0]
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0)
        centres[full] = sums / count[full][:, None]
        for e in np.flatnonzero(count == 0):  # an empty list takes a random vector
            centres[e] = x[rng.integers(len(x))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out = []
    for a in range(0, len(x), 2048):
        d = (centres**2).sum(axis=1) - 2 * x[a : a + 2048] @ centres.T
        if k == 1:
            out.append(d.argmin(axis=1)[:, None])
        else:
            part = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, min(k, len(centres))), np.int64)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _slack(a: int, d: int, epsilon: float) -> float:
    """Over the first a of d columns, the share of a distance that one below it passes but rarely."""
    return (1 + epsilon / math.sqrt(a)) ** 2 * a / d


def scan(ids: np.ndarray, x: np.ndarray, turned: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_turned: np.ndarray, k: int, known: np.ndarray, epsilon: float = EPSILON) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vec_ids, scores) of the k best of a chunk for each query.  turned, q_turned: float32, rotated.

    known: a distance that k candidates reach for sure, or infinity; then the chunk's most promising give one.
    Queries go in groups; the candidates still alive are pairs (query, row), and each column block is scanned for those.
    """
    n, d = turned.shape
    cuts = [*range(0, d, COLUMN_BLOCK), d]
    first, head = min(n, 4 * k), turned[:, : cuts[1]]
    length = (head**2).sum(axis=1)
    for g in range(0, len(q_ids), QUERY_GROUP):
        own_ids, own, own_turned = q_ids[g : g + QUERY_GROUP], q[g : g + QUERY_GROUP], q_turned[g : g + QUERY_GROUP]
        lead = own_turned[:, : cuts[1]]
        part = length[None, :] + (lead**2).sum(axis=1)[:, None] - 2 * lead @ head.T
        part[own_ids[:, None] == ids[None, :]] = np.inf
        bound = known[g : g + QUERY_GROUP].copy()
        if first >= k and len(blind := np.flatnonzero(np.isinf(bound))):
            best = np.argpartition(part[blind], first - 1, axis=1)[:, :first]
            whole = ((turned[best] - own_turned[blind, None, :]) ** 2).sum(axis=2)
            whole[np.isinf(np.take_along_axis(part[blind], best, axis=1))] = np.inf
            bound[blind] = np.partition(whole, k - 1, axis=1)[:, k - 1]
        limit = lambda a: bound * _slack(a, d, epsilon) + 1e-6  # noqa: E731, B023
        r, c = np.nonzero((part <= limit(cuts[1])[:, None]) & ~np.isinf(part))
        far = part[r, c]
        for a, b in zip(cuts[1:-1], cuts[2:]):
            far = far + ((turned[c, a:b] - own_turned[r, a:b]) ** 2).sum(axis=1)
            # the whole distance, at last, is compared as it is; single precision gets some room
            alive = far <= (limit(b) if b < d else bound * 1.0001 + 1e-4)[r]
            r, c, far = r[alive], c[alive], far[alive]
        score = np.einsum("ij,ij->i", x[c], own[r])
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        ends = np.searchsorted(r, np.arange(len(own_ids) + 1))
        for i, (a, b) in enumerate(zip(ends[:-1], np.minimum(ends[1:], ends[:-1] + k))):
            if b > a:
                yield own_ids[i], ids[c[a:b]], score[a:b]


def search(rows: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``queries`` (over vec_id) holds, against all rows."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    packed = scratch.table(vectors.pack(rows.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")), ["vec_id"], "v"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in packed.groupBy("dim").count().orderBy("dim").collect():  # one row a length
        out = out.union(_of_length(packed.where(F.col("dim") == r["dim"]).select("vec_id", "raw"), queries, k, r["dim"], r["count"], recall, scratch))
    return out


def _place(seed: int) -> Column:
    """A number in [0, 1) from the hash of vec_id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "vec_id"), 12) / F.lit(float(1 << 52))


def _of_length(packed: DataFrame, queries: Column, k: int, dim: int, n: int, recall: float, scratch: Scratch) -> DataFrame:
    spark = packed.sparkSession
    most = max(64, TRAIN_BYTES // (8 * dim))
    lists = max(1, min(MOST_LISTS, math.isqrt(n), most // 8))
    sample = scratch.table(packed.where(_place(41) < min(most, TRAIN_PER_LIST * lists) / n).dropDuplicates(["vec_id"]))
    if sample.isEmpty():
        sample = scratch.table(packed.dropDuplicates(["vec_id"]).orderBy(F.xxhash64(F.lit(41), "vec_id")).limit(64))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in filter(len, batches):
            most = max(most, float((vectors.matrix(batch.column(0), dim) ** 2).sum(axis=1).max()))
        yield pa.RecordBatch.from_pydict({"m": [most]})

    longest = packed.select("raw").mapInArrow(norms, "m double").agg(F.max("m")).first()[0]
    rotation = _rotation(dim + 1)

    def turn(x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, longest - (x**2).sum(axis=1)))
        return (np.concatenate([x, more[:, None]], axis=1) @ rotation).astype(np.float32)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column(0)), vectors.matrix(b.column(1), dim)) for b in batches if len(b)]
        if held:
            x = np.concatenate([v for _, v in held])[np.argsort(np.concatenate([i for i, _ in held]), kind="stable")]
            found = _kmeans(turn(x, False), min(lists, len(x)))
            for a in range(0, len(found), 1024):
                yield pa.RecordBatch.from_pydict({"place": np.arange(a, min(len(found), a + 1024)), "centre": [c.tobytes() for c in found[a : a + 1024]]})

    centres = sorted((r["place"], bytes(r["centre"])) for r in sample.coalesce(1).mapInArrow(train, "place long, centre binary").collect())
    centres = np.frombuffer(b"".join(c for _, c in centres), np.float32).reshape(-1, dim + 1)
    lists = len(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            own = _nearest(turn(vectors.matrix(batch.column(1), dim), False), centres, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["vec_id", "raw", "list"])

    # anchors: rows of the sample, one of a vec_id; the k-th distance of those in a query's lists is one that k candidates reach
    anchors = sample.orderBy(F.xxhash64(F.lit(47), "vec_id"), "vec_id").limit(max(k, min(ANCHORS, ANCHOR_BYTES // (8 * dim)))).collect()
    anchor_ids = np.array([r.vec_id for r in anchors], np.int64)
    anchors_turned = turn(np.frombuffer(b"".join(bytes(r.raw) for r in anchors), np.float64).reshape(-1, dim), False)
    anchor_list = _nearest(anchors_turned, centres, 1)[:, 0]
    anchors_length = (anchors_turned**2).sum(axis=1)

    held = scratch.table(packed.select("vec_id", "raw").mapInArrow(assign, "vec_id long, raw binary, list int"))
    asked = held.where(queries)
    audit = sorted((r.vec_id, bytes(r.raw)) for r in asked.select("vec_id", "raw").dropDuplicates(["vec_id"]).orderBy(F.xxhash64(F.lit(43), "vec_id"), "vec_id").limit(AUDITED).collect())
    probes, epsilon, truth = _probes(held, audit, dim, k, recall, centres, turn, lists)
    counts = {r["list"]: (-(-r["n"] // CHUNK), r["ids"]) for r in held.groupBy("list").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids")).collect()}  # one row a list
    n_chunks, n_ids = (np.array([counts.get(i, (0, 0))[j] for i in range(lists)]) for j in (0, 1))

    def attempt(probes: int, epsilon: float) -> DataFrame:
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                for a in range(0, len(batch), 1024):
                    part = batch.slice(a, 1024)
                    q_turned = turn(vectors.matrix(part.column(1), dim), True)
                    near = _nearest(q_turned, centres, probes)
                    few = n_ids[near].sum(axis=1) <= k
                    row, own = np.repeat(np.flatnonzero(~few), near.shape[1]), near[~few].ravel()
                    if few.any():  # lists enough for k others
                        wide = _nearest(q_turned[few], centres, lists)
                        r, c = np.nonzero((np.cumsum(n_ids[wide], axis=1) - n_ids[wide] <= k) | (np.arange(lists) < probes))
                        row, own = np.concatenate([row, np.flatnonzero(few)[r]]), np.concatenate([own, wide[r, c]])
                    probed = np.zeros((len(part), lists), bool)
                    probed[row, own] = True
                    times = n_chunks[own]
                    row, own = np.repeat(row, times), np.repeat(own, times)
                    chunk = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    at = pa.array(row)
                    far = anchors_length[None, :] + (q_turned**2).sum(axis=1)[:, None] - 2 * q_turned @ anchors_turned.T
                    far[(np.asarray(part.column(0))[:, None] == anchor_ids[None, :]) | ~probed[:, anchor_list]] = np.inf
                    bound = np.partition(far, k - 1, axis=1)[:, k - 1] * 1.0001 + 1e-5 if far.shape[1] >= k else np.full(len(part), np.inf)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(bound[row].astype(np.float32)), pa.array(own.astype(np.int32)), pa.array(chunk.astype(np.int32))], names=["query_id", "raw", "bound", "list", "chunk"])

        asking = asked.count()
        blocks = max(1, -(-asking * probes // (lists * QUERY_BLOCK)))
        sent = asked.select("vec_id", "raw").mapInArrow(spread, "query_id long, raw binary, bound float, list int, chunk int").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        many = F.element_at(F.array(*[F.lit(int(c)) for c in n_chunks]), F.col("list") + 1) if lists <= 512 else None
        if many is None:
            table = spark.createDataFrame([(i, int(c)) for i, c in enumerate(n_chunks)], "list int, many int")
            candidates = held.join(table, "list")
        else:
            candidates = held.withColumn("many", many)
        candidates = candidates.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "many").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            got = []
            if len(left) and len(right):
                ids, x = np.asarray(left["vec_id"]), vectors.matrix(left["raw"], dim)
                q_ids, q = np.asarray(right["query_id"]), vectors.matrix(right["raw"], dim)
                got = list(scan(ids, x, turn(x, False), q_ids, q, turn(q, True), k, np.asarray(right["bound"]), epsilon))
            return pa.table({"query_id": pa.array([g[0] for g in got], pa.int64()), "vec_ids": pa.array([g[1] for g in got], pa.list_(pa.int64())), "scores": pa.array([g[2] for g in got], pa.list_(pa.float64()))})

        keys = ["list", "chunk", "block"]
        met = candidates.select(*keys, "vec_id", "raw").groupBy(*keys).cogroup(sent.select(*keys, "query_id", "raw", "bound").groupBy(*keys)).applyInArrow(compare, "query_id long, vec_ids array<long>, scores array<double>")
        met = met.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("m")).select("query_id", F.col("m.vec_ids").alias("vec_id"), F.col("m.scores").alias("score"))
        met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    while True:
        found = scratch.table(attempt(probes, epsilon))
        if not truth:
            return found
        got: dict[int, list[float]] = {}
        for r in found.where(F.col("query_id").isin(list(truth))).collect():  # AUDITED * k rows
            got.setdefault(r.query_id, []).append(r.score)
        # a neighbour counts as found by its score, so that ties don't matter
        hits = sum(min(len(best), sum(x >= best[-1] - 1e-12 for x in got.get(q, []))) for q, best in truth.items())
        share = hits / sum(map(len, truth.values()))
        if share >= recall - LEEWAY or (probes >= lists and epsilon > math.sqrt(dim) * 64):
            found.recall = share
            return found
        probes, epsilon = min(lists, 2 * probes), 2 * epsilon
        scratch.drop(found)


def _probes(held: DataFrame, audit: list[tuple[int, bytes]], dim: int, k: int, recall: float, centres: np.ndarray, turn, lists: int) -> tuple[int, float, dict[int, list[float]]]:
    """(how many lists, at which epsilon, the exact neighbours' scores): what finds the asked share of the audited queries' neighbours."""
    if not audit:
        return lists, EPSILON, {}
    q_ids, q = np.array([i for i, _ in audit]), np.frombuffer(b"".join(r for _, r in audit), np.float64).reshape(-1, dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, dim))) for _ in q_ids]
        for batch in filter(len, batches):
            x = vectors.matrix(batch.column(1), dim)
            ids, own, score = np.asarray(batch.column(0)), np.asarray(batch.column(2)), x @ q.T
            for i in range(len(q_ids)):
                keep = ids != q_ids[i]
                a, b, c = np.concatenate([best[i][0], ids[keep]]), np.concatenate([best[i][1], score[keep, i]]), np.concatenate([best[i][2], own[keep]])
                top, m = _best(a, b, k), len(best[i][0])
                v = np.concatenate([best[i][3][top[top < m]], x[np.flatnonzero(keep)[top[top >= m] - m]]])
                best[i] = a[top], b[top], c[top], v[np.argsort(np.argsort(top >= m, kind="stable"))]
        size = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(np.arange(len(best)), size), pa.int64()), "id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best]), "list": pa.array(np.concatenate([b[2] for b in best]), pa.int64()), "raw": pa.array([v.tobytes() for b in best for v in b[3]], pa.binary())})

    found = held.select("vec_id", "raw", "list").mapInArrow(exact, "q long, id long, score double, list long, raw binary")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k).collect()  # AUDITED * k rows
    if not top:
        return lists, EPSILON, {}
    truth: dict[int, list[float]] = {}
    for r in sorted(top, key=lambda r: -r.score):
        truth.setdefault(int(q_ids[r.q]), []).append(r.score)
    own = np.array([r.q for r in top])
    rank = np.argsort(_nearest(turn(q, True), centres, lists), axis=1)
    parts = (turn(np.frombuffer(b"".join(r.raw for r in top), np.float64).reshape(-1, dim), False) - turn(q, True)[own]) ** 2
    bound = np.zeros(len(q_ids), np.float32)
    np.maximum.at(bound, own, parts.sum(axis=1))  # the least that a scan can know
    epsilon = EPSILON
    while True:
        lost = np.zeros(len(top), bool)
        for a in range(COLUMN_BLOCK, dim + 1, COLUMN_BLOCK):
            lost |= parts[:, :a].sum(axis=1) > bound[own] * _slack(a, dim + 1, epsilon) + 1e-6
        if lost.mean() <= (1 - recall) / 2:
            break
        epsilon *= 2
    places = np.sort(np.where(lost, lists, [rank[r.q, r.list] for r in top]))
    return min(lists, int(places[math.ceil(recall * len(places)) - 1]) + 1), epsilon, truth


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by 20."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

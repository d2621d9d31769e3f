"""Near-duplicate embeddings: hierarchical navigable small-world graphs per shard.

The vectors of a label are dealt by hash into shards, whose size grows with the root of the label's up to a bound in
rows and in bytes, and each shard gets a layered graph once.
Then every shard of a label is asked for the neighbours of every vector of the label, one block of queries at a
time: a beam walks down the layers and over the lowest one.  A query with links in a quarter of its beam may have more
than the beam can hold, and scans the shard instead.  Queries of each block are audited against the whole shard at
random, until AUDITED of them have links or all were; while they miss a link, the beams are doubled, up to the shard's
size, and the block is asked again; if even that misses one, the block is compared with the whole shard.
Two shards ask each other in one task, and a link found from either end counts for both.
Links are confirmed by cosine in double precision and held as one bit for each pair of two shards, so a group of
thousands of copies costs no more than any other.  A pair of shards hands on the number of links of each vector and a
forest that joins what is linked, no pairs; large-star and small-star unite the forests.

All graph work is vectorised over the queries of a block.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without label or
vec_id, link with nothing; vectors of different lengths don't link; rows of one vec_id are one vector to the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .components import components
from .storage import Scratch, read

#: Vectors of a shard at least, where there are as many; at most; bytes of its vectors at most.
SHARD, MOST_SHARD, SHARD_BYTES = 4096, 16384, 64 << 20
#: Neighbours in the lowest layer, half of it above; beams while building and asking; audited queries with links; queries of a step.
DEGREE, BUILD_BEAM, BEAM, AUDITED, BATCH = 24, 32, 32, 48, 256


def _levels(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x2545F4914F6CDD1D)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    return np.minimum(16, (-np.log(u) / np.log(DEGREE / 2)).astype(np.int64))


class Graph:
    """layers[l]: neighbours of each node in layer l, -1 where there are fewer; unit: vectors of length 1, float32."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray):
        self.ids, self.unit = ids, unit
        level = _levels(ids)
        self.entry = int(level.argmax()) if len(ids) else -1
        self.layers = [np.full((len(ids), DEGREE if l == 0 else DEGREE // 2), -1, np.int32) for l in range(int(level.max(initial=0)) + 1)]
        # nodes of the higher layers come first, so that every layer grows from its own entry
        order = np.argsort(-level, kind="stable")
        done = 0
        while done < len(order):
            new = order[done : done + max(1, min(BATCH, done // 2))]
            self._insert(new, order[:done], level)
            done += len(new)

    def _insert(self, new: np.ndarray, have: np.ndarray, level: np.ndarray) -> None:
        q = self.unit[new]
        within = q @ q.T
        np.fill_diagonal(within, -2)
        start = np.full((len(new), 1), self.entry, np.int32) if len(have) else None
        for l in range(len(self.layers) - 1, -1, -1):
            part = np.flatnonzero(level[new] >= l)
            if start is not None:
                found, alike = self.walk(q, start, l, BUILD_BEAM if len(part) else 1)
                start = found[:, :1] if not len(part) else found
            if not len(part):
                continue
            near = np.broadcast_to(new[part].astype(np.int32), (len(part), len(part)))
            c, s = near, within[np.ix_(part, part)]
            if start is not None:
                c, s = np.concatenate([found[part], c], axis=1), np.concatenate([alike[part], s], axis=1)
            self._connect(new[part], c, s, l)

    def _connect(self, nodes: np.ndarray, c: np.ndarray, s: np.ndarray, l: int) -> None:
        """The best candidates become neighbours, and the nodes theirs; a full list keeps its most alike and one random place for the new."""
        layer = self.layers[l]
        half = layer.shape[1] // 2
        top = np.argsort(-s, axis=1, kind="stable")[:, :half]
        own, alike = np.take_along_axis(c, top, axis=1), np.take_along_axis(s, top, axis=1)
        own = np.where(alike > -1.5, own, -1)
        layer[nodes, : own.shape[1]] = own
        a, b = own.ravel(), np.repeat(nodes, own.shape[1])
        keep = a >= 0
        a, b = a[keep], b[keep]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        for i, j in zip(head, np.append(head[1:], len(a))):
            t = a[i]
            old = layer[t][layer[t] >= 0]
            both = np.unique(np.concatenate([old, b[i:j].astype(np.int32)]))
            if len(both) > layer.shape[1]:
                sim = self.unit[both] @ self.unit[t]
                rank = np.argsort(-sim, kind="stable")
                keep = layer.shape[1] * 3 // 4
                rest = rank[keep:]
                both = np.concatenate([both[rank[:keep]], both[rest[np.linspace(0, len(rest) - 1, layer.shape[1] - keep).astype(int)]]])
            layer[t, : len(both)] = both
            layer[t, len(both) :] = -1

    def walk(self, q: np.ndarray, start: np.ndarray, l: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of a beam search in layer l for each query, most alike first; -1 and -2 where there are fewer."""
        layer, n = self.layers[l], len(q)
        beam = max(beam, 1)
        nodes = np.full((n, beam), -1, np.int32)
        alike = np.full((n, beam), -2, np.float32)
        open_ = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.ids)), bool)
        width = min(beam, start.shape[1])
        nodes[:, :width] = start[:, :width]
        fine = nodes[:, :width] >= 0
        alike[:, :width] = np.where(fine, np.einsum("bmd,bd->bm", self.unit[nodes[:, :width]], q), -2)
        open_[:, :width] = fine
        r, c = np.nonzero(fine)
        seen[r, nodes[r, c]] = True
        rows = np.arange(n)
        while len(rows):
            pick = np.where(open_[rows], alike[rows], -3).argmax(axis=1)
            go = open_[rows, pick]
            rows, pick = rows[go], pick[go]
            if not len(rows):
                break
            open_[rows, pick] = False
            next_ = layer[nodes[rows, pick]]
            fresh = (next_ >= 0) & ~seen[rows[:, None], next_]
            seen[rows[:, None], next_] = True
            s = np.where(fresh, np.einsum("bmd,bd->bm", self.unit[next_], q[rows]), -2)
            if width := s.shape[1]:
                a = np.concatenate([alike[rows], s], axis=1)
                top = np.argsort(-a, axis=1, kind="stable")[:, :beam]
                alike[rows] = np.take_along_axis(a, top, axis=1)
                nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], next_], axis=1), top, axis=1)
                open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], axis=1), top, axis=1)
        return np.where(alike > -1.5, nodes, -1), alike

    def ask(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry, np.int32)
        for l in range(len(self.layers) - 1, 0, -1):
            start = self.walk(q, start, l, 4)[0]
        return self.walk(q, start, 0, beam)


def unpacked(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=n).astype(bool)


def turned(bits: np.ndarray, n: int) -> np.ndarray:
    """The packed matrix with rows and columns exchanged; n: its columns."""
    out = np.zeros((n, -(-len(bits) // 8)), np.uint8)
    for a in range(0, len(bits), 1024):  # a multiple of 8
        part = np.packbits(unpacked(bits[a : a + 1024], n).T, axis=1)
        out[:, a // 8 : a // 8 + part.shape[1]] = part
    return out


def links(graph: Graph, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: float, beam: int = BEAM, audited: int = AUDITED) -> np.ndarray:
    """For each query a row of bits, one for each node, set where a cosine of at least ``least`` was found; x, q: doubles.  No query meets its own id."""
    bits = np.zeros((len(q), -(-len(x) // 8)), np.uint8)
    if not len(x) or not len(q):
        return bits
    long_x, long_q = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    unit = (q / long_q[:, None]).astype(np.float32)

    def whole(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), bits.shape[1]), np.uint8)
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            near = (q[part] @ x.T) / np.outer(long_q[part], long_x) >= least
            out[a : a + 256] = np.packbits(near & (q_ids[part][:, None] != graph.ids[None, :]), axis=1)
        return out

    order, looked, linked, told = np.random.default_rng(17).permutation(len(q)), 0, 0, []
    while looked < len(q) and linked < audited:
        part = order[looked : looked + max(1, audited, looked)]
        told.append(whole(part))
        looked, linked = looked + len(part), linked + int(told[-1].any(axis=1).sum())
    audit, truth = order[:looked], np.concatenate(told)
    if looked == len(q):  # the audit has met all there is
        bits[audit] = truth
        return bits
    same = len(q_ids) == len(graph.ids) and bool((q_ids == graph.ids).all())
    while True:
        bits[:] = 0
        for a in range(0, len(q), BATCH):
            part = np.arange(a, min(len(q), a + BATCH))
            nodes, alike = graph.ask(unit[part], min(beam, len(x)))
            dense = ((alike >= least - 1e-5).sum(axis=1) >= max(1, nodes.shape[1] // 4)) & (nodes.shape[1] < len(x))
            r, c = np.nonzero((alike >= least - 1e-5) & ~dense[:, None])
            r, c = part[r], nodes[r, c].astype(np.int64)
            real = np.einsum("ij,ij->i", q[r], x[c]) / (long_q[r] * long_x[c]) >= least
            real &= q_ids[r] != graph.ids[c]
            r, c = r[real], c[real]
            np.bitwise_or.at(bits, (r, c >> 3), (128 >> (c & 7)).astype(np.uint8))
            if dense.any():
                bits[part[dense]] = whole(part[dense])
        if same:  # the shard asks itself: a link found from one end is one of the other
            bits |= turned(bits, len(x))
        if not (truth & ~bits[audit]).any():
            return bits
        if beam >= len(x):  # some nodes can't be reached
            return whole(np.arange(len(q)))
        beam *= 2


def times(bits: np.ndarray, q_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, links) of those of q_ids that have any; repeated rows are one vector, on either side."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0])) if len(ids) else np.zeros(0, np.int64)
    each = np.zeros(len(q_ids), np.int64)
    for a in range(0, len(q_ids), 256):
        near = unpacked(bits[a : a + 256], len(ids))
        each[a : a + 256] = near.sum(axis=1) if len(first) == len(ids) else np.logical_or.reduceat(near[:, order], first, axis=1).sum(axis=1)
    owner, at = np.unique(q_ids, return_inverse=True)
    most = np.zeros(len(owner), np.int64)
    np.maximum.at(most, at, each)
    return owner[most > 0], most[most > 0]


def forest(bits: np.ndarray, q_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node joined with it), over the linked ids of both sides, a block of rows at a time."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, len(q_ids), 256):
        r, c = np.nonzero(unpacked(bits[a : a + 256], len(ids)))
        if len(r):
            held.append(_forest(q_ids[a + r], ids[c]))
    return _forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node joined with it) over the links a-b of ids."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "hnsw")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    packed = scratch.table(vectors.pack(rows.where("vec_id is not null and label is not null"), ["vec_id", "label"], "v"))
    size = F.greatest(F.lit(1), F.least(F.greatest(F.sqrt("count"), F.lit(float(shard))), F.lit(float(MOST_SHARD)), F.lit(float(SHARD_BYTES)) / (8 * F.col("dim"))))
    counts = packed.groupBy("label", "dim").count().withColumn("shards", F.ceil(F.col("count") / size).cast("int")).drop("count")
    dealt = packed.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int"))

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        ids, dim = np.asarray(part["vec_id"]), part["dim"][0].as_py()
        x = vectors.matrix(part["raw"], dim)
        graph = Graph(ids, (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32))
        return pa.table({
            "label": part["label"].slice(0, 1), "dim": part["dim"].slice(0, 1), "shard": part["shard"].slice(0, 1), "shards": part["shards"].slice(0, 1),
            "ids": [ids.astype("<i8").tobytes()], "x": [x.tobytes()], "layers": [[y.tobytes() for y in graph.layers]], "entry": [graph.entry],
        })

    kept = "label string, dim int, shard int, shards int, ids binary, x binary, layers array<binary>, entry long"
    graphs = scratch.table(dealt.select("label", "dim", "shard", "shards", "vec_id", "raw").groupBy("label", "dim", "shard").applyInArrow(build, kept))
    other = graphs.select("label", "dim", F.col("shard").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "x", "layers", "entry")])

    def graph_of(ids: np.ndarray, x: np.ndarray, layers: list[bytes], entry: int) -> Graph:
        graph = Graph.__new__(Graph)
        graph.ids, graph.unit, graph.entry = ids, (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32), entry
        graph.layers = [np.frombuffer(y, np.int32).reshape(len(ids), -1) for y in layers]
        return graph

    def meet(part: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(len(part)):
            row = {c: part[c][i].as_py() for c in part.column_names}
            ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
            x, q = np.frombuffer(row["x"]).reshape(len(ids), -1), np.frombuffer(row["q_x"]).reshape(len(q_ids), -1)
            bits = links(graph_of(ids, x, row["layers"], row["entry"]), x, q_ids, q, least)
            if row["shard"] != row["block"]:  # and from the other end
                bits |= turned(links(graph_of(q_ids, q, row["q_layers"], row["q_entry"]), q, ids, x, least), len(q_ids))
            node, root = forest(bits, q_ids, ids)
            n = np.zeros(len(node), np.int64)
            for owner, most in [times(bits, q_ids, ids)] + ([times(turned(bits, len(ids)), ids, q_ids)] if row["shard"] != row["block"] else []):
                np.maximum.at(n, np.searchsorted(node, owner), most)
            out.append((node, root, n))
        node, root, n = (np.concatenate([o[k] for o in out]) for k in range(3))
        return pa.table({"vec_id": node, "root": root, "n": n})

    pairs = graphs.drop("shards").join(other, ["label", "dim"]).where("shard <= block")
    met = pairs.groupBy("label", "dim", "shard", "block").applyInArrow(meet, "vec_id long, root long, n long")
    met = scratch.table(met)
    linked = components(met.select("vec_id", "root"), scratch, "vec_id", "root").withColumnRenamed("node", "vec_id")
    found = scratch.table(met.groupBy("vec_id").agg(F.sum("n").alias("n_links")).join(linked, "vec_id", "left"))
    scratch.only(found)
    fit = F.col("label").isNotNull() & vectors.usable(F.col("v"))
    out = rows.select("vec_id", fit.alias("fit")).join(found, "vec_id", "left")
    own = F.when(F.col("fit"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("fit"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every embedding; links within a label at a cosine of 0.98 or more."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))

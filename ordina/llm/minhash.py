"""Near-duplicate documents: MinHash with banding, signature verification, full sets, components.

1. Each whole text becomes its set of k-word shingles (64-bit hashes), a 128-bit fingerprint of the set and a
   signature of minima under many universal hash functions ``a*x + b mod 2**64``.
2. Equal sets collapse into one representative, the smallest doc_id, before anything is compared.
3. The signature is cut into bands.  Within a bucket of equal bands every member is compared with one hub,
   the smallest member: first by signature, with a margin of five standard deviations, then on full sets.
   A hub's text goes along once for each block of its members.
4. Links give components by large-star and small-star.
5. Buckets of more than two members that still span several components hold pairs nobody compared.  They are
   not enumerated: two sets with the asked similarity share a shingle within their first, rarest ones, and
   from there on enough shingles are left in both (prefix and position filter, exact).  Pairs of different
   components that pass go to the full sets too, and the components are joined.  Texts that share a shingle are
   dealt into blocks, and blocks meet by twos, so a shingle of many texts is many keys.

So a group of copies costs its size and not its square, and no link between the candidates of step 3 is lost.
Candidates miss a pair of similarity 0.8 with probability (1 - 0.8**4)**32 < 5e-8.

Defined results: null, empty and blank texts have no set, and link with nothing; a row without doc_id links
with nothing and keeps a null component; rows of one doc_id are documents of their own, each with the component of
its text, and are kept where that is the doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ordinal
from . import textvec as tv
from .components import components
from .storage import Scratch, read

_MARGIN = 5.0
#: Members of a hub that are compared in one run; texts of a shingle in a block of the left-over round.
MEMBERS, BLOCK = 256, 512


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    hashes, at = tv.words(buf, off)
    sh, so = tv.shingles(hashes, at, k)
    return [np.unique(sh[a:b]) for a, b in zip(so[:-1].tolist(), so[1:].tolist())]


def sign(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key, n (set size), fp1, fp2, sig: 16 bits of each minimum, so that a band is 2 * rows bytes.  docs: doc_id, text, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(bands * rows)
        for batch in batches:
            buf, off = tv.text_buffers(batch.column(1))
            for i, j in tv.slices(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sig, fp1, fp2 = np.zeros((len(n), bands * rows), np.uint64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                if len(full):
                    x = np.concatenate([sets[t] for t in full])
                    at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    fp1[full] = np.add.reduceat(tv.mix(x ^ np.uint64(0x243F6A8885A308D3)), at).view(np.int64)
                    fp2[full] = np.add.reduceat(tv.mix(x ^ np.uint64(0x13198A2E03707344)), at).view(np.int64)
                    y = np.empty_like(x)
                    for h in range(bands * rows):
                        np.multiply(x, a[h], out=y)
                        np.add(y, b[h], out=y)
                        sig[full, h] = np.minimum.reduceat(y, at)
                lanes = (tv.mix(sig) >> np.uint64(48)).astype("<u2")
                raw = np.ascontiguousarray(lanes).view(np.uint8).ravel()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(i, j - i), "key": batch.column(2).slice(i, j - i), "n": n, "fp1": fp1, "fp2": fp2,
                    "sig": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * (2 * bands * rows)).astype(np.int32)), pa.py_buffer(raw)]),
                })

    return docs.mapInArrow(run, "doc_id long, key long, n long, fp1 long, fp2 long, sig binary")


def _alike(pairs: DataFrame, lanes: int, similarity: float) -> DataFrame:
    """Pairs whose signatures agree in enough places; columns a, b, sig_a, sig_b."""
    least = similarity - _MARGIN * math.sqrt(similarity * (1 - similarity) / lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, lanes) for c in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity.  texts: node, text, once a node.

    A run is a b with a block of its a's: b's text comes first, once, and its set is held while the run passes.
    """
    pairs = scratch.table(pairs.select("a", "b"))
    runs = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("runs"))
    members = pairs.join(runs, "b").select("a", "b", F.pmod(F.xxhash64("a"), "runs").cast("int").alias("run"))
    members = members.join(texts.select(F.col("node").alias("a"), "text"), "a").select("b", "run", "a", "text")
    hubs = runs.select("b", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"))
    hubs = hubs.join(texts.select(F.col("node").alias("b"), "text"), "b").select("b", "run", F.lit(None).cast("long").alias("a"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            buf, off = tv.text_buffers(batch.column(3))
            b, a = np.asarray(batch.column(0)).tolist(), batch.column(2).to_pylist()
            for i, j in tv.slices(off, 4 << 20):
                keep = []
                for t, p in zip(range(i, j), shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)):
                    if a[t] is None:
                        hub, hub_set = b[t], p
                        continue
                    p, q = (p, hub_set) if len(p) <= len(hub_set) else (hub_set, p)
                    where = np.searchsorted(q, p)
                    where[where == len(q)] = 0
                    common = int((q[where] == p).sum()) if len(q) else 0
                    if hub == b[t] and common and 100 * common >= percent * (len(p) + len(q) - common):
                        keep.append((a[t], b[t]))
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in keep], pa.int64()), "b": pa.array([y for _, y in keep], pa.int64())})

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hubs.unionByName(members).repartition(parts, "b", "run").sortWithinPartitions("b", "run", F.asc_nulls_first("a"))
    return rows.mapInArrow(run, "a long, b long")


def _shingle_rows(texts: DataFrame, k: int) -> DataFrame:
    """node, n, shingle: one row for each element of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_buffers(batch.column(1))
            for i, j in tv.slices(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_pydict({"node": batch.column(0).slice(i, j - i), "shingles": pa.ListArray.from_arrays(pa.array(at), pa.array(flat))})

    rows = texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")
    return rows.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))


def _left_over(active: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Pairs of different components that may reach the similarity.  active: node, component."""
    rows = scratch.table(_shingle_rows(texts.join(active.select("node"), "node", "left_semi"), k))
    shared = scratch.table(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    common = rows.join(shared, "shingle")
    # shingles of one text alone come first in the order (df, shingle), and join with nothing
    order = "row_number() over (partition by node order by df, shingle) - 1 + n - count(*) over (partition by node)"
    prefix = common.withColumn("pos", F.expr(order)).where(F.expr(f"100 * (n - pos) >= {percent} * n")).join(active, "node")
    prefix = scratch.table(prefix.select("shingle", "node", "component", "n", "pos"))
    # of a shingle in many prefixes every two blocks are a key: left of one, right of the other
    blocks = prefix.groupBy("shingle").agg(F.count("*").alias("_n")).where("_n > 1").select("shingle", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("blocks"))
    dealt = prefix.join(blocks, "shingle").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    l = dealt.withColumnsRenamed({"own": "x", "other": "y"}).drop("blocks").alias("l")
    r = dealt.withColumnsRenamed({"own": "y", "other": "x"}).drop("blocks").alias("r")
    on = F.expr(f"l.shingle = r.shingle and l.x = r.x and l.y = r.y and l.node > r.node and l.component <> r.component and {100 + percent} * least(l.n - l.pos, r.n - r.pos) >= {percent} * (l.n + r.n)")
    return l.join(r, on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4
) -> DataFrame:
    """doc_id, key (hash of the text), class, n_shingles, component_id, kept: one row for each document; see the module for the method.

    class: the component's own number, where rows of one doc_id lead several; null without a set.

    k: words of a shingle; percent: the least Jaccard similarity of a link, in hundredths.
    """
    spark = docs.sparkSession
    scratch, lanes, similarity = Scratch(spark, "minhash"), bands * rows, percent / 100
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    signed = scratch.table(sign(docs, k, bands, rows))
    reps = scratch.table(
        signed.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "key", "sig")).alias("m"))
        .select("fp1", "fp2", "n", F.col("m.doc_id").alias("rep"), F.col("m.key").alias("rep_key"), F.col("m.sig").alias("sig"))
    )
    # a set's node is its smallest doc_id; were sets to share one, nodes are the places in the order of doc_id
    shared = not reps.groupBy("rep").count().where("count > 1").isEmpty()
    reps = scratch.table(ordinal.dense(reps, ("rep", "fp1", "fp2", "n"), "node")) if shared else reps.withColumn("node", F.col("rep"))
    keys = F.array(*[F.xxhash64(F.substring("sig", 2 * rows * b + 1, 2 * rows), F.lit(b)) for b in range(bands)])
    banded = reps.select("node", F.explode(keys).alias("band"))
    hubs = scratch.table(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"))
    buckets = scratch.table(banded.join(hubs, "band"))

    small = reps.select("node", "n", "sig")
    pairs = buckets.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = pairs.join(small.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
    pairs = pairs.join(small.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    pairs = scratch.table(_alike(pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"), lanes, similarity))

    wanted = buckets.where("members > 2").select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = scratch.table(reps.select("node", F.col("rep").alias("doc_id"), F.col("rep_key").alias("key")).join(wanted, "node", "left_semi"))
    # wanted grows with the documents: dealt by key at every size, and each key's texts are together
    texts = scratch.table(docs.join(wanted.hint("merge"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("node", "text"))
    links = scratch.table(_confirmed(pairs, texts, k, percent, scratch))
    linked = components(links, scratch, "a", "b")

    grouped = buckets.where("members > 2").join(linked, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    grouped = scratch.table(grouped)
    open_bands = scratch.table(grouped.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band"))
    if not open_bands.isEmpty():
        active = scratch.table(grouped.join(open_bands, "band").select("node", "component").distinct())
        more = scratch.table(_confirmed(_left_over(active, texts, k, percent, scratch), texts, k, percent, scratch))
        if not more.isEmpty():
            stars = linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
            linked = components(stars.unionByName(more), scratch, "a", "b")

    classes = reps.join(linked, "node", "left").select("fp1", "fp2", "n", F.coalesce("component", "node").alias("class"))
    if shared:
        classes = classes.join(reps.select(F.col("node").alias("class"), "rep"), "class")
    else:
        classes = classes.withColumn("rep", F.col("class"))
    classes = scratch.table(classes)
    scratch.only(signed, classes)
    found = signed.select("doc_id", "key", "n", "fp1", "fp2").join(classes, ["fp1", "fp2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return found.select("doc_id", "key", "class", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept over 2-word shingles, at 80 in 100."""
    return near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")

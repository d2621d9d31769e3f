"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source, keys are cut into ranges of equal width, as many as
keep about ``RANGE_ROWS`` documents in each, so a hot source is many ranges; sizes are summed by range, the
sums' prefix gives each range its base, and a running sum within the range gives every document its place in
the source's random order.  A source's target is whole epochs and a rest, and the rest is cut exactly: documents
before the cut are taken once more, the one on the cut with the words that are left.  Targets come from places and
prefix sums over the table of sources, in ranges of it where it is large.  All of it is native, and no task holds more
than a range.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in
the order; keys hash doc_id and size, so reruns agree, and rows that are equal in both share them in any order.
An empty table gives no rows; columns of the input that aren't used are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import ordinal
from .storage import Scratch, free, read

WORDS = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 4096


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most_epochs: float) -> DataFrame:
    """source, source_size, docs, target from source, source_size, docs (one row a source).

    ``share`` times all sizes is dealt by weight; a target stops at most_epochs * source_size and the excess is
    dealt anew.  In the order of the caps per weight, the level at which dealing ends is a prefix sum.
    """
    names = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumns({"last": F.col("source").isNull(), "by": F.encode("source", "UTF-8")})
    rows = ordinal.dense(rows, ("last", "by"), "place").withColumn("w", F.element_at(names, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    rows = rows.withColumn("rate", F.col("cap") / F.col("w"))
    for name in ("cap", "w"):  # up to each source in the order of the level that fills it
        rows = ordinal.running(rows, ("rate", "last", "by"), F.sum, lambda a, b: a + b, F.col(name), f"upto_{name}")
    sums = lambda column: rows.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("s")).scalar()
    budget = F.lit(float(share)) * sums(F.col("source_size").cast("double"))
    # were every source from this one on at the level of this one's cap, this much would be dealt
    full, rest = F.col("upto_cap") - F.col("cap"), sums(F.col("w")) - (F.col("upto_w") - F.col("w"))
    rows = rows.withColumn("budget", budget).withColumn("capped", full + rest * F.col("rate") <= F.col("budget"))
    left, spent = sums(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("w"))), sums(F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(0.0)))
    level = (F.col("budget") - spent) * F.col("w") / F.nullif(left, F.lit(0.0))
    return rows.select("source", "source_size", "docs", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), level)).alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most_epochs: float = 2.0, seed: int = 17,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each document, taken in words, repeats counted."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    rows = scratch.table(rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size")))
    plan = scratch.table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, most_epochs))
    plan = plan.withColumn("ranges", F.ceil(F.col("docs") / F.lit(RANGE_ROWS)))
    # the key's place in [0, 1), to 52 bits
    at = F.shiftrightunsigned("key", 12) / F.lit(float(1 << 52))
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select("doc_id", rows["source"], "size", "key", "source_size", "target", F.floor(at * F.col("ranges")).alias("range"))
    placed = scratch.table(placed)
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("own"))
    base = Window.partitionBy("source").orderBy("range")
    sums = scratch.table(sums.withColumn("base", F.sum("own").over(base) - F.col("own"))).withColumnsRenamed({"source": "s", "range": "r"})
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("upto", F.sum("size").over(inside))
    ranked = ranked.join(sums, ranked["source"].eqNullSafe(F.col("s")) & (ranked["range"] == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    upto = F.col("base") + F.col("upto")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (upto - F.col("size"))))
    return ranked.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def materialise(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of a mix: whole copies by epoch, and of a document on its source's cut the words that are left.

    Same columns as ``docs``; documents that take no words go; rows equal in doc_id and size all take what the
    most taking of them does.
    """
    id_, size_, taken_, copy_ = free(docs, "_id", "_size", "_taken", "_copy")
    size, taken = F.col(size_), F.col(taken_)
    plan = mixed.where("taken > 0").groupBy(F.col("doc_id").alias(id_), F.col("size").alias(size_)).agg(F.max("taken").alias(taken_))
    rows = docs.join(plan, docs[doc_id].eqNullSafe(F.col(id_)) & (F.regexp_count(docs[text], F.lit(WORDS)) == size))
    rows = rows.withColumn(copy_, F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    words = F.least(size, taken - (F.col(copy_) - 1) * size).cast("int")
    # cut behind each word, so that the pieces put together are the text as it stands
    cut = F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), words), "")
    return rows.withColumn(text, F.when(words == size, F.col(text)).otherwise(cut)).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

"""The corpus pipeline: toxicity, language, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every stage as
Parquet in the shared folder and reads it again for the next.  All stages but the last return the columns of
``documents``.  Models learn from the rows that the operators' own queries learn from.

Defined results: a document goes if it has no letter, or if the language model is less sure of it than of any text
that it was calibrated on; where no language can be learnt all stay.  Of a group of near-duplicates one row stays, of the
smallest doc_id; rows of one doc_id are documents of their own, and of literally repeated rows one stays, those without
words apart; rows without doc_id are never near-duplicates.  A mix repeats documents by epoch.  An empty table passes
through.  Extra columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.llm import bpe, langid, minhash, mixing, toxicity
from ordina.llm.storage import Scratch, free, read


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below the calibrated threshold."""
    labels = read(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(langid.fold_of(3) != 1), labels.where(langid.fold_of(3) != 1))
    (toxic,) = free(docs, "_toxic")
    return toxicity.classify(docs, model, score=toxic).where(F.col(toxic) < toxicity.THRESHOLD).select(*docs.columns)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure enough of, or all if there is no language to learn."""
    model = langid.fit(docs.where(langid.fold_of(4) != 2))
    if not model.languages:
        return docs
    lang, sure = free(docs, "_lang", "_sure")
    return langid.identify(docs, model, lang=lang, score=sure).where((F.col(lang) != "und") & (F.col(sure) >= model.floor)).select(*docs.columns)


def without_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words, 80 in 100."""
    scratch = Scratch(spark, "kept")
    found = scratch.table(minhash.near_duplicates(docs).where("doc_id is not null and n_shingles > 0").select("doc_id", "key", "class", "kept"))
    # a component keeps one row; where rows repeat its doc_id, the one whose text has the smallest hash
    several = found.where("kept").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    several = scratch.table(several)
    more = found.where("kept").join(several.drop("doc_id"), "class").where("key <> first")
    gone = found.where("not kept").select("doc_id", "key").unionByName(more.select("doc_id", "key"))
    (key,) = free(docs, "_key")
    rows = docs.withColumn(key, F.xxhash64("text"))
    left = rows.join(gone.select("doc_id", F.col("key").alias(key)).distinct(), ["doc_id", key], "left_anti")
    if several.isEmpty():
        return left.select(*docs.columns)
    repeated = several.select("doc_id", F.col("first").alias(key))
    once = left.join(repeated, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return left.join(repeated, ["doc_id", key], "left_anti").unionByName(once).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2, ..., one and a half times the words, at most two epochs of a source."""
    return mixing.materialise(docs, mixing.mix(docs))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32 bit), and whether the ids decode to the text."""
    rows = bpe.round_trip(docs.select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("exact"))


STAGES = [("toxicity", without_toxic), ("language", with_language), ("near_duplicates", without_duplicates), ("mixing", mixed), ("tokens", tokenised)]

#: Trained models and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.only(docs)
    return docs

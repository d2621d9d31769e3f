"""Flat token files with 64-bit document offsets, written by range of doc_id and read back memory-mapped.

Layout of a folder, shard ``s`` holding the s-th range of document ids in ascending order:

* ``s.bin``  token ids, one after the other, little-endian unsigned 16 bit (32 bit if the vocabulary needs it);
* ``s.idx``  signed 64-bit offsets into ``s.bin`` in ids, one more than the shard has documents;
* ``s.doc``  signed 64-bit document ids, in the order of ``s.idx``;
* ``manifest.json``  the width of an id, and for each shard its documents, ids and base, which is the
  prefix sum of the ids of the shards before it.

Files are memory-mapped, so the folder has to be a mounted one that driver and executors share.  A shard is
written under another name and then renamed: a task that runs twice leaves one whole file.

Defined results: a null or empty text holds the end id alone; rows without doc_id come first and keep a null
doc_id; rows of one doc_id keep all of them, in the order of a hash of their texts; an empty table gives no shard.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .storage import Scratch, read

_NO_ID = -(1 << 63)  # stands for a null doc_id in .doc


@lru_cache(2)
def library(path: str):
    """The public tokenizers library's tokenizer, on one thread as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def ids_with_end(tok, texts: list[str], end_id: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the whole texts as the library gives them, each text's end id after them; offsets)."""
    found = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    off = np.concatenate([[0], np.cumsum([len(ids) + 1 for ids in found])]).astype(np.int64)
    out = np.full(off[-1], end_id, kind)
    for at, ids in zip(off, found):
        out[at : at + len(ids)] = ids
    return out, off


def local_path(path: str) -> str:
    scheme, _, rest = path.partition(":")
    if rest and scheme != "file":
        raise ValueError(f"token files are memory-mapped: {path} is no mounted folder; give one that all executors share")
    return "/" + (rest if rest else path).lstrip("/")


def write(df: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0) -> dict:
    """Writes the whole table in ascending doc_id order and returns the manifest."""
    spark, path, folder = df.sparkSession, tokenizer or bpe.default_tokenizer(), local_path(root)
    os.makedirs(folder, exist_ok=True)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange(shards, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, ctx = library(path), TaskContext.get()
        kind = np.dtype("<u2" if max(end_id, *tok.get_vocab().values()) < 1 << 16 else "<u4")
        name, part = f"{folder}/{ctx.partitionId():06d}", f".{ctx.taskAttemptId()}"
        docs = ids = 0
        with open(f"{name}.bin{part}", "wb") as fb, open(f"{name}.idx{part}", "wb") as fi, open(f"{name}.doc{part}", "wb") as fd:
            fi.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for rows, texts in bpe.text_slices(batch, "text"):
                    out, off = ids_with_end(tok, texts, end_id, kind)
                    fb.write(out.tobytes())
                    fi.write((ids + off[1:]).astype("<i8").tobytes())
                    fd.write(np.asarray(rows.column(0).fill_null(_NO_ID)).astype("<i8").tobytes())
                    docs, ids = docs + len(texts), ids + len(out)
        for end in (".bin", ".idx", ".doc"):
            os.replace(f"{name}{end}{part}", f"{name}{end}")
        yield pa.RecordBatch.from_pydict({"shard": [ctx.partitionId()], "docs": [docs], "ids": [ids], "width": [kind.itemsize]})

    found = sorted(rows.mapInArrow(run, "shard long, docs long, ids long, width long").collect())  # one row a shard
    base, manifest = 0, {"width": found[0]["width"] if found else 2, "end_id": end_id, "shards": []}
    for r in found:
        manifest["shards"].append({"shard": r["shard"], "docs": r["docs"], "ids": r["ids"], "base": base})
        base += r["ids"]
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump(manifest, f)
    return manifest


def load(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32 bit), read from the mapped files."""
    folder = local_path(root)
    with open(f"{folder}/manifest.json") as f:
        manifest = json.load(f)
    shards = [s for s in manifest["shards"] if s["docs"]]
    kind = np.dtype(f"<u{manifest['width']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                s = shards[k]
                name = f"{folder}/{s['shard']:06d}"
                flat, off, doc = np.memmap(f"{name}.bin", kind, "r"), np.memmap(f"{name}.idx", "<i8", "r"), np.memmap(f"{name}.doc", "<i8", "r")
                for i, j in tv_slices(off):
                    at = np.asarray(off[i : j + 1])
                    own = np.asarray(doc[i:j])
                    ids = np.asarray(flat[at[0] : at[-1]]).astype("<u4")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, mask=own == _NO_ID), "start": pa.array(at[:-1] + s["base"]), "n_tokens": pa.array(np.diff(at)),
                        "ids": bpe.binary(ids.view(np.uint8), 4 * (at - at[0]), pa.binary()),
                    })

    def tv_slices(off):
        return bpe.tv.slices(off, 1 << 20)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    root = Scratch(spark, "op9").path()
    write(read(spark, sf_dir, "documents").select("doc_id", "text"), root)
    return load(spark, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

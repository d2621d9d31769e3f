"""Shared scratch space: cut lineage in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder of our own only where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    path = "file://" + tempfile.mkdtemp(prefix="ordina-")
    spark.sparkContext.setCheckpointDir(path)
    return path


#: Bytes of a batch that goes to a Python worker: with long texts, rows alone don't bound its memory.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if held is None or not held.rstrip("bB").isdigit() or not 0 < int(held.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Tables written once and read again, so that a lost executor costs one task and not a lineage."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        held = self.spark.read.schema(df.schema).parquet(path)
        held.scratch_path = path
        return held

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/{self._n}"

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is not None:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        self.remove(df.scratch_path)

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {t.scratch_path for t in tables}
        for i in range(1, self._n + 1):
            if f"{self.root}/{i}" not in kept:
                self.remove(f"{self.root}/{i}")

    def clear(self) -> None:
        try:
            self.remove(self.root)
        except Exception:  # the session is gone at exit; the folder is the cluster's to clean
            pass


def in_one_task(rows: DataFrame, make: Callable[[list[pa.RecordBatch]], Any]) -> Any:
    """What ``make`` makes of the batches of a bounded table, in one task: rows and work stay off the driver, which gets the result alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"made": [pickle.dumps(make([b for b in batches if len(b)]))]})

    made = rows.repartition(1).mapInArrow(run, "made binary").collect()
    return pickle.loads(bytes(made[0].made)) if made else make([])


def free(df: DataFrame, *names: str) -> list[str]:
    """``names`` as columns to add for a while: each with underscores before it until no column of ``df`` is called that, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

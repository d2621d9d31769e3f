"""Vectors as flat float32 binaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def pack(df: DataFrame, columns: list[str], vector: str) -> DataFrame:
    """The columns, dim int and raw (binary: the vector's doubles)."""

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("_v"))
            off = np.asarray(col.offsets).astype(np.int64)
            flat = np.asarray(col.values.cast(pa.float64()).fill_null(0.0))[off[0] : off[-1]] if len(col) else np.zeros(0)
            raw = np.ascontiguousarray(flat).view(np.uint8)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(off).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer((8 * (off - off[0])).astype(np.int32)), pa.py_buffer(raw)])], names=[*columns, "dim", "raw"])

    rows = df.where(usable(F.col(vector))).select(*columns, F.col(vector).cast("array<double>").alias("_v"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, dim int, raw binary")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)

"""Newline-delimited JSON with a declared flat schema: batch, in memory and streamed.

Only the fields a plan reads are parsed, and filters on them reach the parser; ``plan()`` of the frame shows both.
"""

from __future__ import annotations

import dataclasses
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frame import POS, SeqFrame
from ..streaming.frame import StreamFrame

_KINDS = {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
_ALLOWED = (T.IntegerType, T.LongType, T.DoubleType, T.StringType)


def schema_of(record: type | T.StructType | str) -> T.StructType:
    """The schema of a dataclass, a StructType or DDL; fields are int, long, double or string."""
    if isinstance(record, str):
        record = T.StructType.fromDDL(record)
    if dataclasses.is_dataclass(record):
        hints = get_type_hints(record)
        record = T.StructType([T.StructField(f.name, _KINDS[hints[f.name]]) for f in dataclasses.fields(record)])
    for f in record.fields:
        if not isinstance(f.dataType, _ALLOWED):
            raise TypeError(f"field {f.name}: {f.dataType.simpleString()} is no flat record field")
    return record


def _zeros(df: DataFrame, schema: T.StructType, missing: str) -> DataFrame:
    if missing == "null":
        return df
    zero = lambda f: F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0).cast(f.dataType)
    return df.withColumns({f.name: F.coalesce(f.name, zero(f)) for f in schema.fields})


def files(spark: SparkSession, path: str, record: type | T.StructType | str, missing: str = "null") -> SeqFrame:
    """Records of files in the order of path, block and place.  missing: what an absent field is, 'null' or 'zero'."""
    schema = schema_of(record)
    df = spark.read.schema(schema).json(path).select(*schema.names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return SeqFrame(_zeros(df, schema, missing).withColumn("_line", F.monotonically_increasing_id()), ("_file", "_block", "_line"))


def table(spark: SparkSession, path: str, record: type | T.StructType | str, missing: str = "null") -> DataFrame:
    """The records without an order, for plans that need none."""
    schema = schema_of(record)
    return _zeros(spark.read.schema(schema).json(path), schema, missing)


def parse(lines: SeqFrame, record: type | T.StructType | str, column: str = "line", missing: str = "null") -> SeqFrame:
    """Records from a column of lines, in its order."""
    schema = schema_of(record)
    df = lines.df.select(*lines.order, F.from_json(column, schema).alias("_r")).select(*lines.order, "_r.*")
    return SeqFrame(_zeros(df, schema, missing), lines.order, lines.is_dense)


def in_memory(spark: SparkSession, data: bytes | str, record: type | T.StructType | str, missing: str = "null", start: int = 0, until: int | None = None) -> SeqFrame:
    """Records of the lines in data[start:until], places in bytes of UTF-8."""
    raw = (data if isinstance(data, bytes) else data.encode("utf-8"))[start:until]
    text = raw.decode("utf-8")
    rows: list[tuple[int, Any]] = list(enumerate(x for x in text.split("\n") if x.strip()))
    return parse(SeqFrame(spark.createDataFrame(rows, f"{POS} bigint, line string"), (POS,), True), record, "line", missing)


def fuse(spark: SparkSession, path: str, record: type | T.StructType | str, order: str, files_per_trigger: int = 1) -> StreamFrame:
    """The same as a pipeline; ``order``: a field that orders the records of a batch."""
    return StreamFrame(stream(spark, path, record, files_per_trigger), order)


def stream(spark: SparkSession, path: str, record: type | T.StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """A streaming DataFrame over a folder of files."""
    return spark.readStream.schema(schema_of(record)).option("maxFilesPerTrigger", files_per_trigger).json(path)

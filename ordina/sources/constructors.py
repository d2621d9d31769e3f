"""Sequences from values, ranges, generators and text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import IO, Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..operators.frame import POS, SeqFrame


def empty(spark: SparkSession, kind: str = "bigint", name: str = "x") -> SeqFrame:
    return SeqFrame.literal(spark, [], kind, name)


def of(spark: SparkSession, *values: Any, kind: str = "bigint", name: str = "x") -> SeqFrame:
    return SeqFrame.literal(spark, list(values), kind, name)


def from_iterable(spark: SparkSession, values: Iterable, kind: str = "bigint", name: str = "x") -> SeqFrame:
    return SeqFrame.literal(spark, list(values), kind, name)


def tabulate(spark: SparkSession, n: int, f: Callable[[Column], Column], name: str = "x") -> SeqFrame:
    """f(0) .. f(n-1); none for n below 1."""
    return SeqFrame(spark.range(max(0, n)).select(F.col("id").alias(POS), f(F.col("id")).alias(name)), (POS,), True)


def fill(spark: SparkSession, n: int, e: Column, name: str = "x") -> SeqFrame:
    return tabulate(spark, n, lambda i: e, name)


def range_(spark: SparkSession, start: int, end: int, step: int = 1, name: str = "x") -> SeqFrame:
    """Half open; a step of 0 or away from ``end`` is an error."""
    if step == 0 or (start < end and step < 0) or (start > end and step > 0):
        raise ValueError(f"no range from {start} to {end} by {step}")
    n = max(0, -((start - end) // step)) if step > 0 else max(0, -((end - start) // -step))
    return tabulate(spark, n, lambda i: F.lit(start) + i * step, name)


def source_range(spark: SparkSession, start: int, end: int, step: int = 1, name: str = "x") -> SeqFrame:
    """As range_, but a step away from ``end`` gives no elements."""
    if step == 0:
        raise ValueError("step is 0")
    return empty(spark, name=name) if (end - start) * step <= 0 else range_(spark, start, end, step, name)


def repeat(spark: SparkSession, e: Column, n: int, name: str = "x") -> SeqFrame:
    """The first n of an unbounded repetition."""
    return fill(spark, n, e, name)


def iterate(spark: SparkSession, start: str, step: str, n: int, kind: str = "bigint", name: str = "x") -> SeqFrame:
    """start, f(start), ...: n elements of a recurrence, ``step`` SQL over ``x``; a recursive query."""
    if n <= 0:
        return empty(spark, kind, name)
    df = spark.sql(f"WITH RECURSIVE r(p, x) AS (SELECT 0L, CAST({start} AS {kind}) UNION ALL SELECT p + 1, CAST({step} AS {kind}) FROM r WHERE p + 1 < {n}) SELECT p AS {POS}, x AS {name} FROM r")
    return SeqFrame(df, (POS,), True)


def concat(*parts: SeqFrame) -> SeqFrame:
    return parts[0].concat(*parts[1:])


class Source(Protocol):
    """What is pulled: the next elements, None at the end.  ``close`` is called once: at the end, at a limit or on an error."""

    def pull_chunk(self) -> list | None: ...

    def close(self) -> None: ...


class _Generated(DataSource):
    """A Python generator as a table: read by one task, closed on exhaustion, a limit or an error."""

    make: Callable[[], Iterator] = None
    kind = "bigint"

    @classmethod
    def name(cls) -> str:
        return "ordina_generated"

    def schema(self) -> str:
        return f"{POS} bigint, x {self.kind}"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        make = type(self).make

        class Reader(DataSourceReader):
            def read(self, partition):  # noqa: ANN001
                it = make()
                try:
                    yield from enumerate(it)
                finally:
                    if hasattr(it, "close"):
                        it.close()

        return Reader()


def generate(spark: SparkSession, make: Callable[[], Iterator], kind: str = "bigint") -> SeqFrame:
    """The elements of an iterator made on the executor."""
    source = type("Generated", (_Generated,), {"make": staticmethod(make), "kind": kind})
    spark.dataSource.register(source)
    return SeqFrame(spark.read.format("ordina_generated").load(), (POS,), True, arrives=True)


def from_source(spark: SparkSession, make: Callable[[], Source], kind: str = "bigint") -> SeqFrame:
    """The elements of a source made on the executor.  ``take``, ``head`` and ``find`` stop pulling when they have theirs."""

    def pull() -> Iterator:
        source = make()
        try:
            while (chunk := source.pull_chunk()) is not None:
                yield from chunk
        finally:
            source.close()

    return generate(spark, pull, kind)


def from_iterator(spark: SparkSession, make: Callable[[], Iterable], kind: str = "bigint") -> SeqFrame:
    """The elements of an iterator made on the executor, pulled as they are asked for."""
    return generate(spark, lambda: iter(make()), kind)


def from_reader(spark: SparkSession, open_: Callable[[], IO[str]]) -> SeqFrame:
    """The lines of a text reader opened on the executor, without their ends; the reader is closed."""

    def pull() -> Iterator[str]:
        with open_() as reader:
            for line in reader:
                yield line.rstrip("\n").removesuffix("\r")

    return generate(spark, pull, "string")


def lines_of(spark: SparkSession, open_: Callable[[], IO[bytes]]) -> SeqFrame:
    """The lines of a stream of UTF-8 bytes opened on the executor; bytes that are none become U+FFFD."""
    import io

    return from_reader(spark, lambda: io.TextIOWrapper(open_(), "utf-8", "replace", newline="\n"))


def stop_at(make: Callable[[], Iterator], p: Callable[[Any], bool]) -> Callable[[], Iterator]:
    """The same generator up to the first element for which ``p`` does not hold; no more is pulled."""

    def pull() -> Iterator:
        it = make()
        try:
            for x in it:
                if not p(x):
                    break
                yield x
        finally:
            if hasattr(it, "close"):
                it.close()

    return pull


def unfold(spark: SparkSession, init: Any, f: Callable[[Any], tuple[Any, Any] | None], kind: str = "bigint") -> SeqFrame:
    """Elements and states until None."""

    def make() -> Iterator:
        state = init
        while (got := f(state)) is not None:
            value, state = got
            yield value

    return generate(spark, make, kind)


def unfold_chunk(spark: SparkSession, init: Any, f: Callable[[Any], tuple[list, Any] | None], kind: str = "bigint") -> SeqFrame:
    """As unfold, a list of elements at a time."""

    def make() -> Iterator:
        state = init
        while (got := f(state)) is not None:
            values, state = got
            yield from values

    return generate(spark, make, kind)


def lines(spark: SparkSession, path: str, name: str = "line") -> SeqFrame:
    """The lines of text files in the order of path, block and place within it."""
    df = spark.read.text(path).select(F.col("value").alias(name), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    df = df.withColumn("_line", F.monotonically_increasing_id())
    return SeqFrame(df, ("_file", "_block", "_line"))


def from_frame(df: DataFrame, *order: str) -> SeqFrame:
    return SeqFrame.of(df, *order)

"""StreamFrame: the pipeline vocabulary over a stream, as SeqFrame has it over a table.

Filters and projections are those of the DataFrame; what needs the place of an element has a stage with state.  Stages
that change what an element is (windows, runs, scans) end in a plain streaming DataFrame; a terminal is a running
aggregation, or what ``settle`` has written when the stream is through.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stages


class StreamFrame:
    def __init__(self, df: DataFrame, order: str, by: tuple[str, ...] = (), end: str | None = None):
        """``order``: a whole number that orders rows within a batch; ``by``: columns that split the stream into sequences of their own; ``end``: true of a sequence's last row, a sentinel."""
        self.df, self.order, self.by, self.end = df, order, tuple(by), end

    def _with(self, df: DataFrame) -> StreamFrame:
        return StreamFrame(df, self.order, self.by, self.end)

    @property
    def _held(self) -> list[str]:
        return list(dict.fromkeys([self.order, *self.by, *([self.end] if self.end else [])]))

    def _passes(self, p: Column) -> Column:
        """A sentinel passes every filter."""
        p = F.coalesce(p, F.lit(False))
        return p | F.col(self.end) if self.end else p

    # -- stages that are plain
    def map(self, **named: Column) -> StreamFrame:
        return self._with(self.df.select(*[c for c in self._held if c not in named], *[c.alias(n) for n, c in named.items()]))

    def filter(self, p: Column) -> StreamFrame:
        return self._with(self.df.where(self._passes(p)))

    def filter_not(self, p: Column) -> StreamFrame:
        return self._with(self.df.where(self._passes(~F.coalesce(p, F.lit(False)))))

    def collect(self, when: Column, **named: Column) -> StreamFrame:
        return self.filter(when).map(**named)

    def flat_map(self, array: Column, name: str = "x") -> DataFrame:
        """(order, by, element): elements of one row stay together, without places of their own."""
        return self.df.select(*self._held, F.explode(array).alias(name))

    def tap_each(self, name: str, *metrics: Column) -> StreamFrame:
        return self._with(self.df.observe(name, *metrics))

    def distinct(self, *columns: str) -> DataFrame:
        return stages.distinct(self.df, *columns)

    # -- stages with state
    def _stage(self, stage: Any, column: str, *args: Any, **more: Any) -> DataFrame:
        return stage(self.df, self.order, column, *args, by=self.by, kind=dict(self.df.dtypes)[column], **more)

    def _live(self) -> StreamFrame:
        return StreamFrame(self.df.where(~F.col(self.end)), self.order, self.by) if self.end else self

    def take(self, n: int, column: str = "x") -> DataFrame:
        return self._live()._stage(stages.take, column, n)

    def drop(self, n: int, column: str = "x") -> DataFrame:
        return self._live()._stage(stages.drop, column, n)

    def take_while(self, p: Column, column: str = "x") -> DataFrame:
        return self._live()._stage(stages.take_while, column, p)

    def drop_while(self, p: Column, column: str = "x") -> DataFrame:
        return self._live()._stage(stages.drop_while, column, p)

    def take_right(self, n: int, column: str = "x") -> DataFrame:
        return self._stage(stages.take_right, column, n, self.end)

    def zip_with_index(self, column: str = "x") -> DataFrame:
        return self._live()._stage(stages.zip_with_index, column)

    def scan_left(self, zero: Any, f: stages.Fold, column: str = "x", kind: str = "bigint") -> DataFrame:
        live = self._live()
        return stages.scan(live.df, self.order, column, zero, f, kind, self.by)

    def grouped(self, n: int, column: str = "x") -> DataFrame:
        return self._stage(stages.grouped, column, n, end=self.end)

    def sliding(self, n: int, column: str = "x") -> DataFrame:
        return self._live()._stage(stages.sliding, column, n)

    def fold_adjacent_by(self, key: Column, seed: Any, f: stages.Fold, column: str = "x", kind: str = "bigint") -> DataFrame:
        rows = self.df.withColumn("key__", key)
        return stages.fold_adjacent(rows, self.order, "key__", column, seed, f, (dict(rows.dtypes)["key__"], kind), self.end, self.by)

    def group_adjacent_by(self, key: Column, column: str = "x") -> DataFrame:
        """(key, acc): the values of each run that has ended."""
        rows = self.df.withColumn("key__", key)
        kinds = dict(rows.dtypes)
        return stages.fold_adjacent(rows, self.order, "key__", column, [], lambda acc, v: [*acc, v], (kinds["key__"], f"array<{kinds[column]}>"), self.end, self.by)

    # -- terminals
    def group_reduce(self, key: Column, **aggregates: Column) -> DataFrame:
        return stages.group_reduce(self._live().df, key, **aggregates)

    def agg(self, **aggregates: Column) -> DataFrame:
        """Running aggregates of the whole stream, for complete or update mode."""
        return self._live().df.agg(*[a.alias(n) for n, a in aggregates.items()])

    def find(self, p: Column) -> DataFrame:
        """The first row for which ``p`` holds, in the order of batches; reads no batch after it."""
        found = stages.settle(self._live().df.where(F.coalesce(p, F.lit(False))), most=1)
        return found.orderBy(self.order).limit(1)

    def exists(self, p: Column) -> bool:
        return not self.find(p).isEmpty()

    def run(self, most: int | None = None) -> DataFrame:
        return stages.settle(self._live().df, most)

"""Aggregate specifications with fixed results for empty input."""

from __future__ import annotations

import builtins
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

On = Callable[[Column], Column]  #: null in place of rows that don't count
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Order(tuple):
    """Names of the columns whose ascending order, nulls first, is the order; ``fields``: what the frame knows of them."""

    fields: tuple[T.StructField, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, names: tuple[str, ...]) -> Order:
        out, schema = cls(names), df.schema
        out.fields = tuple(schema[n] for n in names)
        return out

    def turned(self) -> list[Column] | None:
        """Columns whose ascending order is the opposite of this one; None if a type has no such columns."""
        out = []
        for f in self.fields:
            x, kind = F.col(f.name), f.dataType
            if isinstance(kind, WHOLE):
                own = [F.bitwise_not(x)]  # no overflow, as a minus sign has at the least value
            elif isinstance(kind, T.BooleanType):
                own = [~x]
            elif isinstance(kind, T.DateType):
                own = [F.bitwise_not(F.unix_date(x))]
            elif isinstance(kind, T.TimestampType):
                own = [F.bitwise_not(F.unix_micros(x))]
            elif isinstance(kind, (T.FloatType, T.DoubleType)):
                own = [~F.isnan(x), -F.nanvl(x, F.lit(0.0))]  # NaN is the greatest
            elif isinstance(kind, T.DecimalType):
                own = [-x]
            else:
                return None
            out += [x.isNull(), *own] if len(self) > 1 and f.nullable else own
        return out


def key_of(order: tuple[str, ...]) -> Column:
    """The order as one comparable column.  A struct compares nulls and NaN as sorting does; a column alone holds no null."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


@dataclass(frozen=True)
class Agg:
    """``build`` gives the aggregate column for order columns and the rows that count; ``turns``: it needs the opposite order."""

    build: Callable[[Order, On], Column]
    keep: Column | None = None
    turns: bool = False

    def column(self, order: Order) -> Column:
        return self.build(order, (lambda x: x) if self.keep is None else (lambda x: F.when(self.keep, x)))

    def where(self, keep: Column) -> Agg:
        """The same over the rows for which ``keep`` holds; a group without any still has its empty result."""
        return Agg(self.build, keep if self.keep is None else self.keep & keep, self.turns)


def _or_raise(value: Column, on: On, what: str) -> Column:
    return F.when(F.count(on(F.lit(1))) == 0, F.raise_error(F.lit(f"{what} of an empty sequence"))).otherwise(value)


def sum(x: Column) -> Agg:  # noqa: A001
    """0 for empty input."""
    return Agg(lambda order, on: F.coalesce(F.sum(on(x)), F.lit(0)))


def product(x: Column) -> Agg:
    """1 for empty input."""
    return Agg(lambda order, on: F.coalesce(F.product(on(x)), F.lit(1.0)))


def count() -> Agg:
    return Agg(lambda order, on: F.count(on(F.lit(1))))


def min(x: Column) -> Agg:  # noqa: A001
    """Null for empty input."""
    return Agg(lambda order, on: F.min(on(x)))


def max(x: Column) -> Agg:  # noqa: A001
    """Null for empty input."""
    return Agg(lambda order, on: F.max(on(x)))


def min1(x: Column) -> Agg:
    """Raises for empty input."""
    return Agg(lambda order, on: _or_raise(F.min(on(x)), on, "min"))


def max1(x: Column) -> Agg:
    """Raises for empty input."""
    return Agg(lambda order, on: _or_raise(F.max(on(x)), on, "max"))


def avg(x: Column) -> Agg:
    """0.0 for empty input."""
    return Agg(lambda order, on: F.coalesce(F.avg(on(x)), F.lit(0.0)))


def gather(x: Column, order: Order, on: On) -> Column:
    """The values in order as one array: for bounded groups and folds that nothing else expresses."""
    rows = F.array_agg(on(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], x.alias("x"))))
    return F.transform(F.array_sort(rows), lambda e: e["x"])


def to_array(x: Column) -> Agg:
    return Agg(lambda order, on: gather(x, order, on))


def fold(zero: Column, step: Callable[[Column, Column], Column], x: Column) -> Agg:
    """A fold in order for steps no built-in aggregate knows."""
    return Agg(lambda order, on: F.aggregate(gather(x, order, on), zero, step))


def fold_right(zero: Column, step: Callable[[Column, Column], Column], x: Column) -> Agg:
    return Agg(lambda order, on: F.aggregate(F.reverse(gather(x, order, on)), zero, lambda acc, v: step(v, acc)))


def reduce(step: Callable[[Column, Column], Column], x: Column, required: bool = False, right: bool = False) -> Agg:
    """The first value folded with the others in order (from the last one, if ``right``); empty: null, or an error if ``required``."""

    def build(order: Order, on: On) -> Column:
        xs = gather(x, order, on)
        xs, go = (F.reverse(xs), lambda acc, v: step(v, acc)) if right else (xs, step)
        got = F.when(F.size(xs) > 0, F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), F.element_at(xs, 1), go))
        return _or_raise(got, on, "reduce") if required else got

    return Agg(build)


def _first_by(value: Column, key: Column, order: Order, on: On, down: bool) -> Column:
    if not down:
        return F.min_by(value, on(F.struct(key.alias("k"), *order)))
    # the greatest key first, then the smallest place: the greatest key's own first row
    return F.max_by(value, on(F.struct(key.alias("k"), *order.turned())))


def _edge_by(value: Column, key: Column, required: bool, down: bool, what: str) -> Agg:
    def build(order: Order, on: On) -> Column:
        found = _first_by(value, key, order, on, down)
        return _or_raise(found, on, what) if required else found

    return Agg(build, turns=down)


def min_by(value: Column, key: Column, required: bool = False) -> Agg:
    """The first on ties; keys compare as sorting does (null least, NaN greatest); empty: null, or an error if ``required``."""
    return _edge_by(value, key, required, False, "min_by")


def max_by(value: Column, key: Column, required: bool = False) -> Agg:
    """The first on ties; keys of any type that sorts; empty: null, or an error if ``required``."""
    return _edge_by(value, key, required, True, "max_by")


def _best(n: int, key: Column, value: Column, order: Order, on: On, down: bool) -> Column:
    rows = F.array_agg(on(F.struct(F.struct(key.alias("k")).alias("k"), F.struct(*order).alias("o"), value.alias("v"))))

    def compare(a: Column, b: Column) -> Column:
        ahead, behind = (a["k"] > b["k"], a["k"] < b["k"]) if down else (a["k"] < b["k"], a["k"] > b["k"])
        return F.when(ahead, -1).when(behind, 1).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)

    return F.transform(F.slice(F.array_sort(rows, compare), 1, builtins.max(1, n)), lambda e: e["v"])


def top_n_by(n: int, key: Column, value: Column) -> Agg:
    """Best first, the earlier on ties, n below 1 counts as 1; keys of any type, null is the least; for bounded groups.  SeqFrame.top_n_by sorts with a limit instead."""
    return Agg(lambda order, on: _best(n, key, value, order, on, True))


def bottom_n_by(n: int, key: Column, value: Column) -> Agg:
    return Agg(lambda order, on: _best(n, key, value, order, on, False))


def largest(n: int, x: Column) -> Agg:
    return top_n_by(n, x, x)


def smallest(n: int, x: Column) -> Agg:
    return bottom_n_by(n, x, x)


def foreach(f: Callable, x: Column) -> Agg:
    """Calls ``f`` with every value that counts, at least once each, where its row is; the result is how many there are."""

    def call(counts: pd.Series, values: pd.Series) -> pd.Series:
        for v in values[counts]:
            f(v)
        return counts.astype("int64")

    def build(order: Order, on: On) -> Column:
        run = F.pandas_udf(call, "long")
        return F.coalesce(F.sum(run(F.coalesce(on(F.lit(True)), F.lit(False)), x)), F.lit(0))

    return Agg(build)

"""SeqFrame: a DataFrame with a declared total order, and the operators of an ordered sequence on it.

Stages are lazy and return a SeqFrame; what needs a place counts places only where it is asked to (``dense``), so a
filter or a projection stays one narrow plan.  Terminals return a ``Scalar``, one lazy row that ``value()`` fetches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import ordinal
from . import agg as A
from .agg import WHOLE, Agg, Order, key_of

POS = "_pos"
#: Beyond so many rows a prefix or suffix is cut by places and not by a sort with a limit, which is one task.
FEW = 1 << 20
Step = Callable[[Column, Column], Column]


def _true(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


class Scalar:
    """A result of one row."""

    def __init__(self, df: DataFrame):
        self.df = df

    def value(self) -> Any:
        row = self.df.first()
        return None if row is None else row[0] if len(row) == 1 else row


class SeqFrame:
    """``order``: columns that together are unique; a column that is the order alone holds no null.

    ``arrives``: one partition brings the rows in their order, so that a prefix is a limit, which stops reading.
    """

    def __init__(self, df: DataFrame, order: tuple[str, ...] = (POS,), is_dense: bool = False, arrives: bool = False):
        self.df, self.order, self.is_dense, self.arrives = df, tuple(order), is_dense and len(order) == 1, arrives

    # -- construction -------------------------------------------------------------------------------------------
    @classmethod
    def of(cls, df: DataFrame, *order: str, dense: bool = False) -> SeqFrame:
        """A frame ordered by columns that together are unique.  They stay values, too."""
        names = (POS,) if len(order) == 1 else tuple(f"{POS}{i}" for i in range(len(order)))
        return cls(df.withColumns({n: F.col(o) for n, o in zip(names, order)}), names, dense)

    @classmethod
    def literal(cls, spark: SparkSession, values: list, kind: str = "bigint", name: str = "x") -> SeqFrame:
        return cls(spark.createDataFrame(list(enumerate(values)), f"{POS} bigint, {name} {kind}"), (POS,), True)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.order]

    @property
    def key(self) -> Column:
        return key_of(self.order)

    def _with(self, df: DataFrame, dense: bool = False) -> SeqFrame:
        return SeqFrame(df, self.order, dense)

    def _narrow(self, df: DataFrame, dense: bool = False) -> SeqFrame:
        """As _with, for rows that stay where they are."""
        return SeqFrame(df, self.order, dense, self.arrives)

    def _select(self, *columns: Column | str) -> DataFrame:
        return self.df.select(*self.order, *columns)

    def dense(self) -> SeqFrame:
        """The same with ``_pos`` 0, 1, 2, ..."""
        if self.is_dense and self.order == (POS,):
            return self
        rows = ordinal.dense(self.df, self.order, "__d").drop(*self.order)
        return SeqFrame(rows.withColumnRenamed("__d", POS), (POS,), True)

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order).select(*self.columns)

    def _specs(self, specs: dict[str, Agg]) -> tuple[SeqFrame, list[Column]]:
        """The aggregate columns, and the frame they are for: with dense places where an order has to be turned that can't be."""
        order = Order.of(self.df, self.order)
        if any(a.turns for a in specs.values()) and order.turned() is None:
            return self.dense()._specs(specs)
        return self, [a.column(order).alias(n) for n, a in specs.items()]

    def _one(self, spec: Agg, name: str = "value") -> Scalar:
        return self.agg(**{name: spec})

    def _fresh(self, n: int = 1) -> list[str]:
        """Names of order columns that are not taken."""
        names = (f"{POS}_{i}" for i in range(n + len(self.df.columns)))
        return [x for x in names if x not in self.df.columns][:n]

    def _edge(self, rows: DataFrame, last: bool = False) -> Column:
        """The order key of the first or last of ``rows`` as a scalar subquery, null if there is none."""
        return rows.agg((F.max if last else F.min)(self.key).alias("k")).scalar()

    # -- projection and filters ---------------------------------------------------------------------------------
    def map(self, *columns: Column | str, **named: Column) -> SeqFrame:
        return self._narrow(self._select(*columns, *[c.alias(n) for n, c in named.items()]), self.is_dense)

    map_conserve = map

    def filter(self, p: Column) -> SeqFrame:
        return self._narrow(self.df.where(p))

    with_filter = filter

    def filter_not(self, p: Column) -> SeqFrame:
        return self._narrow(self.df.where(~_true(p)))

    def flat_map(self, array: Column, name: str = "x", *keep: str) -> SeqFrame:
        (sub,) = self._fresh()
        return SeqFrame(self._select(*keep, F.posexplode(array).alias(sub, name)), (*self.order, sub))

    def flatten(self, column: str = "x") -> SeqFrame:
        return self.flat_map(F.col(column), column)

    def collect(self, when: Column, **named: Column) -> SeqFrame:
        """filter and map in one, as a partial function does."""
        return self.filter(when).map(**named)

    def foreach(self, f: Callable) -> None:
        self.df.select(*self.columns).foreach(f)

    def foreach_while(self, f: Callable[[Any], bool]) -> None:
        for row in self.iterator():
            if not f(row):
                break

    def tap_each(self, name: str, *metrics: Column) -> SeqFrame:
        """Observes metrics of the rows that pass, at least once each."""
        return self._narrow(self.df.observe(name, *metrics), self.is_dense)

    def partition(self, p: Column) -> tuple[SeqFrame, SeqFrame]:
        return self.filter(_true(p)), self.filter_not(p)

    def partition_map(self, left: Column, left_value: Column, right_value: Column, name: str = "x") -> tuple[SeqFrame, SeqFrame]:
        yes, no = self.partition(left)
        return yes.map(**{name: left_value}), no.map(**{name: right_value})

    # -- zips ----------------------------------------------------------------------------------------------------
    def zip_with_index(self, name: str = "index") -> SeqFrame:
        rows = self.dense()
        return rows._with(rows.df.withColumn(name, F.col(POS).cast("int")), True)

    def zip(self, that: SeqFrame) -> SeqFrame:
        """Row by row, as long as the shorter; column names must differ."""
        if clash := set(self.columns) & set(that.columns):
            raise ValueError(f"both sides have {sorted(clash)}")
        return SeqFrame(self.dense().df.join(that.dense().df, POS), (POS,), True)

    def map2(self, that: SeqFrame, **named: Column) -> SeqFrame:
        return self.zip(that).map(**named)

    def lazy_zip(self, ys: SeqFrame, zs: SeqFrame) -> SeqFrame:
        return self.zip(ys).zip(zs)

    def unzip(self, *columns: str) -> tuple[SeqFrame, ...]:
        return tuple(self.map(c) for c in columns)

    unzip3 = unzip

    def transpose(self, column: str = "x") -> SeqFrame:
        """Rows of arrays to columns of arrays; the first row's width holds, shorter rows are an error."""
        width = self._one(Agg(lambda order, on: F.min_by(F.size(column), key_of(order)))).df.scalar()
        short = F.raise_error(F.lit("a row is shorter than the first"))
        cells = self._select(F.posexplode(F.when(F.size(column) < width, short).otherwise(F.slice(column, F.lit(1), width))).alias("__c", "__v"))
        rows = cells.groupBy(F.col("__c").cast("bigint").alias(POS)).agg(A.gather(F.col("__v"), self.order, lambda x: x).alias(column))
        return SeqFrame(rows, (POS,), True)

    # -- structure -----------------------------------------------------------------------------------------------
    def take(self, n: int) -> SeqFrame:
        if self.arrives:
            return self._narrow(self.df.limit(max(0, n)), self.is_dense)
        if n > FEW:
            return SeqFrame(self.dense().df.where(F.col(POS) < n), (POS,), True)
        return self._with(self.df.orderBy(*self.order).limit(max(0, n)), self.is_dense)

    def drop(self, n: int) -> SeqFrame:
        if n <= 0:
            return self
        if self.is_dense or n > FEW:
            rows = self.dense()
            return rows._with(rows.df.where(F.col(POS) >= n))
        edge = self._edge(self.df.select(*self.order).orderBy(*self.order).limit(n), last=True)
        return self._with(self.df.where(self.key > edge))

    def take_right(self, n: int) -> SeqFrame:
        if n > FEW:
            rows = self.dense()
            return rows._with(rows.df.where(F.col(POS) >= rows.df.agg(F.count("*")).scalar() - n))
        return self._with(self.df.orderBy(*[F.desc(o) for o in self.order]).limit(max(0, n)))

    def drop_right(self, n: int) -> SeqFrame:
        if n <= 0:
            return self
        if n > FEW:
            rows = self.dense()
            return rows._with(rows.df.where(F.col(POS) < rows.df.agg(F.count("*")).scalar() - n), True)
        edge = self._edge(self.df.select(*self.order).orderBy(*[F.desc(o) for o in self.order]).limit(n))
        return self._with(self.df.where(self.key < edge), self.is_dense)

    def slice(self, start: int, until: int) -> SeqFrame:
        start = max(0, start)
        return self.take(max(0, until)).drop(start) if until > start else self.take(0)

    def split_at(self, n: int) -> tuple[SeqFrame, SeqFrame]:
        return self.take(n), self.drop(n)

    def reverse(self) -> SeqFrame:
        """The order turned: nothing moves.  Where its columns can't be turned (strings), places are counted first."""
        turned = Order.of(self.df, self.order).turned()
        if turned is None:
            return self.dense().reverse()
        names = self.order if len(turned) == len(self.order) else tuple(self._fresh(len(turned)))
        return SeqFrame(self.df.select(*[c.alias(n) for n, c in zip(names, turned)], *self.columns), names)

    def init(self) -> SeqFrame:
        return self.drop_right(1)

    def tail(self) -> SeqFrame:
        return self.drop(1)

    def concat(self, *those: SeqFrame) -> SeqFrame:
        """++: one after the other.  Each part keeps the type of its order columns; parts share columns of a type, and are null in others' columns."""
        parts = [self, *those]
        kinds = {tuple(t for c, t in p.df.dtypes if c not in p.order) for p in parts}
        if len(kinds) > 1:
            raise TypeError(f"parts of different element types: {sorted(kinds)}")
        slots: list[str] = []
        held: list[dict[int, str]] = []
        for p in parts:
            own, at = {}, 0
            for f in Order.of(p.df, p.order).fields:
                kind = "bigint" if isinstance(f.dataType, WHOLE) else f.dataType.simpleString()
                at = next((j for j in range(at, len(slots)) if slots[j] == kind), len(slots))
                if at == len(slots):
                    slots.append(kind)
                own[at] = f.name
                at += 1
            held.append(own)
        names = (f"{POS}_side", *[f"{POS}_{i}" for i in range(len(slots))])
        out = None
        for i, (p, own) in enumerate(zip(parts, held)):
            places = [(F.col(own[j]) if j in own else F.lit(None)).cast(kind).alias(n) for j, (kind, n) in enumerate(zip(slots, names[1:]))]
            rows = p.df.select(F.lit(i).cast("bigint").alias(names[0]), *places, *p.columns)
            out = rows if out is None else out.union(rows)
        return SeqFrame(out, names)

    def _row(self, *values: Column) -> SeqFrame:
        spark, kinds = self.df.sparkSession, dict(self.df.dtypes)
        one = spark.range(1).select(F.col("id").alias(POS), *[v.cast(kinds[c]).alias(c) for v, c in zip(values, self.columns)])
        return SeqFrame(one, (POS,), True)

    def append(self, *values: Column) -> SeqFrame:
        return self.concat(self._row(*values))

    def prepend(self, *values: Column) -> SeqFrame:
        return self._row(*values).concat(self)

    def updated(self, i: int, column: str, value: Column) -> SeqFrame:
        """An index outside raises when the plan runs."""
        rows = self.dense()
        fits = F.lit(i >= 0) & (F.lit(i) < rows.df.agg(F.count("*")).scalar())
        bad = F.raise_error(F.lit(f"index {i} is out of bounds"))
        return rows._with(rows.df.withColumn(column, F.when(~fits, bad).when(F.col(POS) == i, value).otherwise(F.col(column))), True)

    def pad_to(self, n: int, *values: Column) -> SeqFrame:
        rows, kinds = self.dense(), dict(self.df.dtypes)
        more = self.df.sparkSession.range(max(0, n)).where(F.col("id") >= rows.df.agg(F.count("*")).scalar())
        more = more.select(F.col("id").alias(POS), *[v.cast(kinds[c]).alias(c) for v, c in zip(values, rows.columns)])
        return SeqFrame(rows.df.select(POS, *rows.columns).union(more), (POS,), True)

    def patch(self, start: int, that: SeqFrame, replaced: int) -> SeqFrame:
        start = max(0, start)
        return self.take(start).concat(that, self.drop(start + max(0, replaced)))

    def grouped(self, size: int, name: str = "group", column: str = "x") -> SeqFrame:
        """Arrays of ``size`` elements, the last may have fewer; below 1 counts as 1."""
        rows, size = self.dense(), max(1, size)
        out = rows.df.groupBy(F.floor(F.col(POS) / size).cast("bigint").alias("__g")).agg(A.gather(F.col(column), (POS,), lambda x: x).alias(name))
        return SeqFrame(out.withColumnRenamed("__g", POS), (POS,), True)

    def sliding(self, size: int, step: int = 1, name: str = "window", column: str = "x") -> SeqFrame:
        """Windows of ``size`` every ``step``; the last may have fewer, a short sequence has one.

        Places are dealt in ranges much longer than a window, the first elements of a range to the one before, too, and
        a window is the rows that follow its first one.  Where windows hardly overlap, an element goes to those it is part of.
        """
        if size < 1 or step < 1:
            raise ValueError("size and step must be positive")
        rows = self.dense()
        n = rows.df.agg(F.count("*")).scalar()
        windows = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step) + 1)
        if size > 2 * step:
            width = max(8 * size, 1 << 13)
            own = F.floor(F.col(POS) / width)
            parts = F.when((F.col(POS) % width < size - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
            spread = rows.df.select(POS, F.struct(F.col(column).alias("v")).alias("__v"), F.explode(parts).alias("__p"))
            follow = Window.partitionBy("__p").orderBy(POS).rowsBetween(0, size - 1)
            spread = spread.withColumn("__w", F.collect_list("__v").over(follow))
            spread = spread.where((F.floor(F.col(POS) / width) == F.col("__p")) & (F.col(POS) % step == 0) & (F.col(POS) / step < windows))
            return SeqFrame(spread.select(F.floor(F.col(POS) / step).cast("bigint").alias(POS), F.transform("__w", lambda e: e["v"]).alias(name)), (POS,), True)
        first = F.greatest(F.lit(0), F.floor((F.col(POS) - size) / step) + 1)
        last = F.least(F.floor(F.col(POS) / step), windows - 1)
        spread = rows.df.select(POS, F.col(column).alias("__v"), first.alias("__a"), last.alias("__b")).where("__a <= __b")
        spread = spread.select(POS, "__v", F.explode(F.sequence("__a", "__b")).alias("__w"))
        out = spread.groupBy(F.col("__w").cast("bigint").alias("__g")).agg(A.gather(F.col("__v"), (POS,), lambda x: x).alias(name))
        return SeqFrame(out.withColumnRenamed("__g", POS), (POS,), True)

    def inits(self, name: str = "init", column: str = "x") -> SeqFrame:
        """All prefixes, longest first: the output has the square of the size."""
        return self._parts(name, column, lambda n, i: F.sequence(F.lit(0), n - 1 - i), lambda n: n)

    def tails(self, name: str = "tail", column: str = "x") -> SeqFrame:
        return self._parts(name, column, lambda n, i: F.sequence(F.lit(0), i), lambda n: n)

    def _parts(self, name: str, column: str, places: Callable, end: Callable) -> SeqFrame:
        rows, kind = self.dense(), dict(self.df.dtypes)[column]
        n = rows.df.agg(F.count("*")).scalar()
        spread = rows.df.select(POS, F.col(column).alias("__v"), F.explode(places(n, F.col(POS))).alias("__w"))
        out = spread.groupBy(F.col("__w").cast("bigint").alias("__g")).agg(A.gather(F.col("__v"), (POS,), lambda x: x).alias(name))
        empty = self.df.sparkSession.range(1).select(end(n).cast("bigint").alias(POS), F.array().cast(f"array<{kind}>").alias(name))
        return SeqFrame(out.withColumnRenamed("__g", POS).union(empty), (POS,), True)

    def combinations(self, k: int, column: str = "x", name: str = "combination") -> SeqFrame:
        """Distinct multiset choices in the order of first occurrence; for small sequences, gathered in one row."""
        return self._choices("c", k, column, name)

    def permutations(self, column: str = "x", name: str = "permutation") -> SeqFrame:
        return self._choices("p", 0, column, name)

    def _choices(self, what: str, k: int, column: str, name: str) -> SeqFrame:
        from .choices import choose

        kind = dict(self.df.dtypes)[column]
        ranks = self.map(column).df.groupBy(column).agg(F.min(self.key).alias("k"), F.count("*").alias("n"))
        one = ranks.agg(F.transform(F.array_sort(F.array_agg(F.struct("k", F.col(column).alias("v"), "n"))), lambda e: F.struct(e["v"].alias("v"), e["n"].alias("n"))).alias("vs"))
        return SeqFrame(choose(one, what, k, kind, name), (POS,), True)

    # -- prefixes by predicate -----------------------------------------------------------------------------------
    def _first_failure(self, p: Column) -> Column:
        return self._edge(self.df.where(~_true(p)))

    def take_while(self, p: Column) -> SeqFrame:
        edge = self._first_failure(p)
        return self._with(self.df.where(edge.isNull() | (self.key < edge)), self.is_dense)

    def drop_while(self, p: Column) -> SeqFrame:
        return self._with(self.df.where(self.key >= self._first_failure(p)))

    def span(self, p: Column) -> tuple[SeqFrame, SeqFrame]:
        return self.take_while(p), self.drop_while(p)

    # -- distinct, sort, multisets -------------------------------------------------------------------------------
    def distinct(self, *columns: str, ieee: bool = False) -> SeqFrame:
        return self.distinct_by(*[F.col(c) for c in columns or self.columns], ieee=ieee)

    def distinct_by(self, *keys: Column, ieee: bool = False) -> SeqFrame:
        """The first of each key.  ``ieee``: NaN differs from itself, as in primitive comparison; zeros of both signs are one."""
        names = [f"__k{i}" for i in range(len(keys))]
        rows = self.df.withColumns({n: k for n, k in zip(names, keys)})
        kinds = dict(rows.dtypes)
        if ieee:
            rows = rows.withColumn("__nan", F.when(_any_nan([n for n in names if kinds[n] in ("double", "float")]), self.key))
            names.append("__nan")
        first = F.min_by(F.struct(*self.df.columns), self.key).alias("__r")
        return self._with(rows.groupBy(*names).agg(first).select("__r.*"))

    def sort_by(self, *keys: Column) -> SeqFrame:
        """Stable: ties keep their order."""
        names = self._fresh(len(keys))
        return SeqFrame(self.df.withColumns({n: k for n, k in zip(names, keys)}), (*names, *self.order))

    def sorted(self, column: str = "x") -> SeqFrame:
        return self.sort_by(F.col(column))

    def sort_with(self, compare: Step, column: str = "x") -> SeqFrame:
        """By a comparator (-1, 0, 1) on columns; gathered in one row, so for bounded sequences: prefer sort_by."""
        rows = self.dense()
        tied = lambda a, b: F.when(compare(a["v"], b["v"]) != 0, compare(a["v"], b["v"])).when(a["p"] < b["p"], -1).otherwise(1)
        one = rows.df.agg(F.array_sort(F.array_agg(F.struct(F.col(POS).alias("p"), F.col(column).alias("v"))), tied).alias("a"))
        return SeqFrame(one.select(F.posexplode("a").alias(POS, "e")).select(F.col(POS).cast("bigint").alias(POS), F.col("e.v").alias(column)), (POS,), True)

    def diff(self, that: SeqFrame, column: str = "x", that_column: str | None = None) -> SeqFrame:
        """Multiset difference: as many of the earliest go as ``that`` has."""
        return self._less(that, column, that_column, lambda o, n: o > F.coalesce(n, F.lit(0)), "left")

    def intersect(self, that: SeqFrame, column: str = "x", that_column: str | None = None) -> SeqFrame:
        return self._less(that, column, that_column, lambda o, n: o <= n, "inner")

    def _less(self, that: SeqFrame, column: str, that_column: str | None, keep: Step, how: str) -> SeqFrame:
        counts = that.df.groupBy(F.col(that_column or column).alias("__y")).agg(F.count("*").alias("__n"))
        rows = ordinal.occurrences(self.df, self.order, F.col(column), "__o").join(counts, F.col(column).eqNullSafe(F.col("__y")), how).where(keep(F.col("__o"), F.col("__n")))
        return self._with(rows.select(*self.df.columns))

    # -- grouping ------------------------------------------------------------------------------------------------
    def group_by(self, key: Column, name: str = "rows", column: str = "x") -> DataFrame:
        """(key, values in order)."""
        return self.group_map(key, F.col(column), name)

    def group_map(self, key: Column, value: Column, name: str = "rows") -> DataFrame:
        return self.df.groupBy(key.alias("key")).agg(A.gather(value, self.order, lambda x: x).alias(name))

    def group_reduce_by(self, key: Column, **specs: Agg) -> DataFrame:
        rows, columns = self._specs(specs)
        return rows.df.groupBy(key.alias("key")).agg(*columns)

    group_map_reduce = group_reduce = group_reduce_by

    def group_count(self, key: Column) -> DataFrame:
        return self.df.groupBy(key.alias("key")).agg(F.count("*").alias("count"))

    def group_sum(self, key: Column, x: Column) -> DataFrame:
        return self.df.groupBy(key.alias("key")).agg(F.sum(x).alias("sum"))

    # -- adjacency -----------------------------------------------------------------------------------------------
    def _runs(self, key: Column) -> DataFrame:
        return ordinal.run_ids(self.df.withColumn("__key", key), self.order, F.col("__key"), "__run")

    def group_adjacent_reduce_by(self, key: Column, **specs: Agg) -> SeqFrame:
        """(key, aggregates) of each maximal run; a run whose rows are all left out by an aggregate's ``where`` stays."""
        rows, columns = self._specs(specs)
        found = rows._runs(key).groupBy("__run").agg(F.first("__key").alias("key"), *columns)
        return SeqFrame(found.withColumnRenamed("__run", POS), (POS,), True)

    def fold_adjacent_by(self, key: Column, seed: Column, combine: Step, value: Column, name: str = "acc") -> SeqFrame:
        return self.group_adjacent_reduce_by(key, **{name: A.fold(seed, combine, value)})

    def group_adjacent_by(self, key: Column, name: str = "rows", column: str = "x") -> SeqFrame:
        return self.group_adjacent_reduce_by(key, **{name: A.to_array(F.col(column))})

    # -- scans ---------------------------------------------------------------------------------------------------
    def scan_left(self, zero: Column, fold: Callable[[Column], Column], both: Step, value: Column, name: str = "acc") -> SeqFrame:
        """zero, then zero joined with each running result of an associative aggregate."""
        rows = ordinal.running(self.dense().df, (POS,), fold, both, value, "__s").select((F.col(POS) + 1).alias(POS), both(zero, F.col("__s")).alias(name))
        kind = dict(rows.dtypes)[name]
        first = self.df.sparkSession.range(1).select(F.col("id").alias(POS), zero.cast(kind).alias(name))
        return SeqFrame(first.union(rows), (POS,), True)

    scan = scan_left

    def scan_right(self, zero: Column, fold: Callable[[Column], Column], both: Step, value: Column, name: str = "acc") -> SeqFrame:
        return self.reverse().scan_left(zero, fold, both, value, name).reverse()

    def scan_general(self, zero: Column, step: Step, value: Column, name: str = "acc") -> SeqFrame:
        """For steps that aren't associative: one row gathers the sequence."""
        xs = A.gather(value, self.order, lambda x: x)
        got = self.df.agg(F.aggregate(xs, F.array(zero), lambda acc, v: F.array_append(acc, step(F.element_at(acc, -1), v))).alias("a"))
        return SeqFrame(got.select(F.posexplode("a").alias(POS, name)).withColumn(POS, F.col(POS).cast("bigint")), (POS,), True)

    # -- terminals -----------------------------------------------------------------------------------------------
    def agg(self, **specs: Agg) -> Scalar:
        rows, columns = self._specs(specs)
        return Scalar(rows.df.agg(*columns))

    def agg_to(self, name: str = "value", **specs: Agg) -> Scalar:
        rows, columns = self._specs(specs)
        return Scalar(rows.df.agg(F.struct(*columns).alias(name)))

    def count(self, p: Column | None = None) -> Scalar:
        return self._one(A.count() if p is None else A.count().where(_true(p)), "count")

    size = length = count

    def is_empty(self) -> Scalar:
        return Scalar(self.df.limit(1).agg((F.count("*") == 0).alias("value")))

    def non_empty(self) -> Scalar:
        return Scalar(self.df.limit(1).agg((F.count("*") > 0).alias("value")))

    def length_compare(self, n: int) -> Scalar:
        """-1, 0 or 1; reads no more than n + 1 rows."""
        c = F.count("*")
        return Scalar(self.df.limit(max(0, n) + 1).agg(F.when(c < n, -1).when(c == n, 0).otherwise(1).alias("value")))

    length_is = size_is = length_compare

    def indices(self) -> SeqFrame:
        return self.dense().map(index=F.col(POS).cast("int"))

    def is_defined_at(self, i: int) -> Scalar:
        return Scalar(self.df.limit(max(0, i) + 1).agg((F.count("*") > F.lit(i)).alias("value") if i >= 0 else F.lit(False).alias("value")))

    def exists(self, p: Column) -> Scalar:
        return Scalar(self.df.where(p).limit(1).agg((F.count("*") > 0).alias("value")))

    def forall(self, p: Column) -> Scalar:
        return Scalar(self.df.where(~_true(p)).limit(1).agg((F.count("*") == 0).alias("value")))

    def contains(self, e: Column, column: str = "x") -> Scalar:
        """NaN is contained nowhere, as in primitive comparison."""
        p = F.col(column).eqNullSafe(e)
        return self.exists(p & ~F.isnan(column) if dict(self.df.dtypes)[column] in ("double", "float") else p)

    def _first(self, last: bool = False) -> DataFrame:
        if self.arrives and not last:
            return self.df.limit(1).select(*self.columns)
        return self.df.orderBy(*[F.desc(o) if last else F.asc(o) for o in self.order]).limit(1).select(*self.columns)

    def head_option(self) -> Scalar:
        return Scalar(self._first())

    def last_option(self) -> Scalar:
        return Scalar(self._first(True))

    def _required(self, rows: DataFrame, what: str) -> Scalar:
        one = rows.agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in rows.columns])
        return Scalar(one.select(*[F.when(F.col("__n") == 0, F.raise_error(F.lit(f"{what} of an empty sequence"))).otherwise(F.col(c)).alias(c) for c in rows.columns]))

    def head(self) -> Scalar:
        return self._required(self._first(), "head")

    def last(self) -> Scalar:
        return self._required(self._first(True), "last")

    def apply(self, i: int) -> Scalar:
        return self._required(self.drop(i)._first() if i >= 0 else self.df.limit(0).select(*self.columns), f"element {i}")

    def find(self, p: Column) -> Scalar:
        return self.filter(p).head_option()

    def collect_first(self, when: Column, **named: Column) -> Scalar:
        return self.collect(when, **named).head_option()

    def _place_of(self, edge: Column) -> Scalar:
        """How many elements come before an order key, -1 without one: two narrow aggregates, and no places."""
        before = F.count_if(self.key < edge)
        return Scalar(self.df.agg(F.when(edge.isNull(), F.lit(-1)).otherwise(before).cast("bigint").alias("value")))

    def index_where(self, p: Column, start: int = 0) -> Scalar:
        return self._place_of(self._edge(self.drop(start).df.where(p))) if start <= 0 or not self.is_dense else self._place_of(self._edge(self.df.where(p & (F.col(POS) >= start))))

    def index_of(self, e: Column, start: int = 0, column: str = "x") -> Scalar:
        return self.index_where(F.col(column).eqNullSafe(e), start)

    def last_index_where(self, p: Column, end: int | None = None) -> Scalar:
        rows = self if end is None else self.take(end + 1)
        return self._place_of(self._edge(rows.df.where(p), last=True))

    def last_index_of(self, e: Column, end: int | None = None, column: str = "x") -> Scalar:
        return self.last_index_where(F.col(column).eqNullSafe(e), end)

    def segment_length(self, p: Column, start: int = 0) -> Scalar:
        rows = self.drop(start)
        fail = rows._first_failure(p)
        return Scalar(rows.df.agg(F.count_if(fail.isNull() | (rows.key < fail)).alias("value")))

    def corresponds(self, that: SeqFrame, p: Column) -> Scalar:
        """p over the columns of both, of which the names differ, and equal lengths."""
        both = self.dense().df.withColumn("__l", F.lit(True)).join(that.dense().df.withColumn("__r", F.lit(True)), POS, "full")
        fine = F.col("__l").isNotNull() & F.col("__r").isNotNull() & _true(p)
        return Scalar(both.agg(F.coalesce(F.bool_and(fine), F.lit(True)).alias("value")))

    def _renamed(self, prefix: str = "__that_") -> SeqFrame:
        return self._with(self.df.withColumnsRenamed({c: prefix + c for c in self.columns}), self.is_dense)

    def same_elements(self, that: SeqFrame) -> Scalar:
        p = F.lit(True)
        for a, b in zip(self.columns, that.columns):
            p = p & F.col(a).eqNullSafe(F.col("__that_" + b))
        return self.corresponds(that._renamed(), p)

    def starts_with(self, that: SeqFrame, offset: int = 0) -> Scalar:
        return self._match(that, F.lit(offset))

    def ends_with(self, that: SeqFrame) -> Scalar:
        n, m = (s.df.agg(F.count("*")).scalar() for s in (self, that))
        return self._match(that, n - m)

    def _match(self, that: SeqFrame, offset: Column) -> Scalar:
        p = F.lit(True)
        right = that.dense()._renamed()
        for a, b in zip(self.columns, that.columns):
            p = p & F.col(a).eqNullSafe(F.col("__that_" + b))
        moved = right.df.withColumn(POS, F.col(POS) + offset)
        both = moved.join(self.dense().df.withColumn("__l", F.lit(True)), POS, "left")
        return Scalar(both.agg(F.coalesce(F.bool_and(F.col("__l").isNotNull() & _true(p)), F.lit(True)).alias("value")))

    def _slices(self, those: list, column: str, choose: Callable, none: Column) -> Scalar:
        """Places where the literal values follow one another: each element votes for the starts it fits."""
        rows, m = self.dense(), len(those)
        if not m:
            return Scalar(rows.df.agg(none.alias("value")))
        fits = F.array(*[F.when(F.col(column).eqNullSafe(F.lit(v)), F.col(POS) - j) for j, v in enumerate(those)])
        starts = rows.df.select(F.explode(F.array_compact(fits)).alias("s")).groupBy("s").count().where((F.col("count") == m) & (F.col("s") >= 0))
        return Scalar(starts.agg(F.coalesce(choose("s"), F.lit(-1)).alias("value")))

    def index_of_slice(self, those: list, column: str = "x") -> Scalar:
        return self._slices(those, column, F.min, F.lit(0).cast("bigint"))

    def last_index_of_slice(self, those: list, column: str = "x") -> Scalar:
        return self._slices(those, column, F.max, F.count("*"))

    def contains_slice(self, those: list, column: str = "x") -> Scalar:
        return Scalar(self.index_of_slice(those, column).df.select((F.col("value") >= 0).alias("value")))

    def fold_left(self, zero: Column, step: Step, x: Column) -> Scalar:
        return self._one(A.fold(zero, step, x))

    fold = fold_left

    def fold_right(self, zero: Column, step: Step, x: Column) -> Scalar:
        return self._one(A.fold_right(zero, step, x))

    def reduce(self, step: Step, x: Column) -> Scalar:
        return self._one(A.reduce(step, x, required=True))

    reduce_left = reduce

    def reduce_right(self, step: Step, x: Column) -> Scalar:
        return self._one(A.reduce(step, x, required=True, right=True))

    def reduce_option(self, step: Step, x: Column) -> Scalar:
        return self._one(A.reduce(step, x))

    reduce_left_option = reduce_option

    def reduce_right_option(self, step: Step, x: Column) -> Scalar:
        return self._one(A.reduce(step, x, right=True))

    def sum(self, x: Column) -> Scalar:
        return self._one(A.sum(x))

    def product(self, x: Column) -> Scalar:
        return self._one(A.product(x))

    def min(self, x: Column) -> Scalar:
        return self._one(A.min1(x))

    def max(self, x: Column) -> Scalar:
        return self._one(A.max1(x))

    def min_option(self, x: Column) -> Scalar:
        return self._one(A.min(x))

    def max_option(self, x: Column) -> Scalar:
        return self._one(A.max(x))

    def min_by(self, value: Column, key: Column) -> Scalar:
        return self._one(A.min_by(value, key, required=True))

    def max_by(self, value: Column, key: Column) -> Scalar:
        return self._one(A.max_by(value, key, required=True))

    def min_by_option(self, value: Column, key: Column) -> Scalar:
        return self._one(A.min_by(value, key))

    def max_by_option(self, value: Column, key: Column) -> Scalar:
        return self._one(A.max_by(value, key))

    def mk_string(self, x: Column, sep: str = "", start: str = "", end: str = "") -> Scalar:
        return self._one(Agg(lambda order, on: F.concat(F.lit(start), F.array_join(gather_text(x, order), sep, "null"), F.lit(end))))

    def _best(self, n: int, key: Column, down: bool) -> SeqFrame:
        (name,) = self._fresh()
        by = [F.desc_nulls_last(name) if down else F.asc_nulls_first(name), *self.order]
        rows = self.df.withColumn(name, key).orderBy(*by).limit(max(1, n))
        rows = rows.withColumn("__d", (F.row_number().over(Window.orderBy(*by)) - 1).cast("bigint"))  # over n rows
        return SeqFrame(rows.select(F.col("__d").alias(POS), *self.columns), (POS,), True)

    def top_n_by(self, n: int, key: Column) -> SeqFrame:
        """Best first, the earlier on ties; n below 1 counts as 1; keys of any type that sorts, NaN is the greatest, null the least."""
        return self._best(n, key, True)

    def bottom_n_by(self, n: int, key: Column) -> SeqFrame:
        return self._best(n, key, False)

    def top_n(self, n: int, column: str = "x") -> SeqFrame:
        return self.top_n_by(n, F.col(column))

    def bottom_n(self, n: int, column: str = "x") -> SeqFrame:
        return self.bottom_n_by(n, F.col(column))

    def run(self) -> DataFrame:
        return self.dense().df

    def iterator(self) -> Iterator:
        for row in self.ordered().toLocalIterator():
            yield row[0] if len(row) == 1 else row

    def reverse_iterator(self) -> Iterator:
        return self.reverse().iterator()

    def to_list(self) -> list:
        return [r[0] if len(r) == 1 else r for r in self.ordered().collect()]

    to_seq = to_vector = to_array = to_indexed_seq = to_list

    def copy_to_array(self, target: list, start: int = 0) -> int:
        """Copies what fits and returns how many."""
        got = self.take(max(0, len(target) - start)).to_list()
        target[start : start + len(got)] = got
        return len(got)

    def to_set(self) -> DataFrame:
        return self.df.select(*self.columns).distinct()

    def to_map(self, key: Column, value: Column) -> DataFrame:
        """(key, value), the last value of each key."""
        return self.df.groupBy(key.alias("key")).agg(F.max_by(value, self.key).alias("value"))

    def to(self, factory: Callable[[Iterator], Any]) -> Any:
        """What ``factory`` makes of the elements in order, a partition at a time."""
        return factory(self.iterator())

    def plan(self) -> dict[str, list[str]]:
        from ..plans.report import report

        return report(self.df.select(*self.columns))

    def plan_fold(self, zero: Column, step: Step, x: Column) -> dict[str, list[str]]:
        """What a fold reads, and how."""
        return self.plan_agg(value=A.fold(zero, step, x))

    def plan_agg(self, **specs: Agg) -> dict[str, list[str]]:
        from ..plans.report import report

        return report(self.agg(**specs).df)


def gather_text(x: Column, order: Order) -> Column:
    return A.gather(x.cast("string"), order, lambda v: v)


def _any_nan(names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.isnan(n)
    return out

"""SetFrame: sets as one distinct column, or as a condition that need not be finite, under one algebra.

A finite set is a DataFrame of one column.  Any other set is a tree of ``not``, ``and``, ``or`` and ``xor`` over finite
sets and predicates, functions from a Column to a boolean Column.  A finite set meets such a tree by null-safe semi and
anti joins and by filters, and whether a result is finite is known when it is planned.  Null is an element like any
other: a predicate that gives null for it doesn't hold, and its complement does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import table
from .frame import Scalar

Member = Callable[[Column], Column]


@dataclass(frozen=True)
class Node:
    """``kind``: 'in' (of a DataFrame of x), 'is' (a predicate), 'not', 'and', 'or' or 'xor'."""

    kind: str
    parts: tuple = ()

    def plain(self) -> bool:
        """No finite set in it."""
        return self.kind == "is" or (self.kind != "in" and all(p.plain() for p in self.parts))

    def column(self, x: Column, flags: dict[int, Column]) -> Column:
        """Whether x is in the set, never null; flags: a column for each finite set."""
        if self.kind == "is":
            return F.coalesce(self.parts[0](x), F.lit(False))
        if self.kind == "in":
            return flags[id(self)]
        own = [p.column(x, flags) for p in self.parts]
        return ~own[0] if self.kind == "not" else own[0] & own[1] if self.kind == "and" else own[0] | own[1] if self.kind == "or" else own[0] != own[1]

    def leaves(self) -> list[Node]:
        return [self] if self.kind == "in" else [] if self.kind == "is" else [x for p in self.parts for x in p.leaves()]

    def choose(self, df: DataFrame, x: str, wanted: bool = True) -> DataFrame:
        """The rows of ``df`` whose column ``x`` is in the set, or is not."""
        if self.kind == "not":
            return self.parts[0].choose(df, x, not wanted)
        if self.kind == "in":
            return df.join(self.parts[0].select(F.col("x").alias("__x")), F.col(x).eqNullSafe(F.col("__x")), "left_semi" if wanted else "left_anti")
        if self.kind == ("and" if wanted else "or"):
            return self.parts[1].choose(self.parts[0].choose(df, x, wanted), x, wanted)
        flags = {}
        rows = df
        for i, leaf in enumerate({id(n): n for n in self.leaves()}.values()):  # sets are distinct, so a row stays one row
            rows = rows.join(leaf.parts[0].select(F.col("x").alias(f"__x{i}"), F.lit(True).alias(f"__f{i}")), F.col(x).eqNullSafe(F.col(f"__x{i}")), "left")
            flags[id(leaf)] = F.coalesce(F.col(f"__f{i}"), F.lit(False))
        holds = self.column(F.col(x), flags)
        return rows.where(holds if wanted else ~holds).select(*df.columns)


class SetFrame:
    def __init__(self, df: DataFrame | None, member: Member | Node | None = None):
        self._df, self._member = df, member if isinstance(member, Node) or member is None else Node("is", (member,))

    # -- construction -------------------------------------------------------------------------------------------
    @classmethod
    def of(cls, df: DataFrame, column: str | None = None) -> SetFrame:
        """The distinct values of a column."""
        return cls(df.select(F.col(column or df.columns[0]).alias("x")).distinct())

    @classmethod
    def doubles(cls, df: DataFrame, column: str | None = None) -> SetFrame:
        """Distinct doubles where NaN is one element and zeros of different sign are two."""
        rows = df.select(F.col(column or df.columns[0]).alias("x"))
        return cls(rows.withColumn("s", F.col("x").cast("string") == "-0.0").dropDuplicates(["x", "s"]).select("x"))

    @classmethod
    def literal(cls, spark: SparkSession, *values: Any, kind: str = "bigint") -> SetFrame:
        return cls(spark.createDataFrame([(v,) for v in values], f"x {kind}").distinct())

    @classmethod
    def empty(cls, spark: SparkSession, kind: str = "bigint") -> SetFrame:
        return cls(spark.createDataFrame([], f"x {kind}"))

    @classmethod
    def range(cls, lo: int, hi: int) -> SetFrame:
        """lo to hi, both included."""
        return cls._bounded(lo, hi)

    @classmethod
    def until(cls, lo: int, hi: int) -> SetFrame:
        return cls._bounded(lo, hi - 1)

    @classmethod
    def range_open(cls, lo: int, hi: int) -> SetFrame:
        return cls._bounded(lo + 1, hi - 1)

    @classmethod
    def _bounded(cls, lo: int, hi: int) -> SetFrame:
        out = cls(None, lambda x: x.between(lo, hi))
        out.bounds = (lo, hi)
        return out

    bounds: tuple[int, int] | None = None

    @classmethod
    def above(cls, k: Any) -> SetFrame:
        return cls(None, lambda x: x > k)

    @classmethod
    def below(cls, k: Any) -> SetFrame:
        return cls(None, lambda x: x < k)

    @classmethod
    def universal(cls) -> SetFrame:
        return cls(None, lambda x: F.lit(True))

    # -- kind ----------------------------------------------------------------------------------------------------
    @property
    def is_finite(self) -> bool:
        return self._df is not None or self.bounds is not None

    def finite(self) -> SetFrame | None:
        return self if self.is_finite else None

    @property
    def df(self) -> DataFrame:
        if self._df is None and self.bounds is not None:
            lo, hi = self.bounds
            self._df = SparkSession.active().range(lo, max(lo, hi + 1)).select(F.col("id").alias("x"))
        if self._df is None:
            raise ValueError("the set is not finite")
        return self._df

    def materialize(self) -> SetFrame:
        """The algebra done once: written to the shared folder until the program ends.  A set that is not finite raises."""
        return SetFrame(table(self.df))

    @property
    def node(self) -> Node:
        """The set as a condition."""
        return self._member if self._member is not None else Node("in", (self.df,))

    # -- algebra -------------------------------------------------------------------------------------------------
    def union(self, that: SetFrame) -> SetFrame:
        if self.is_finite and that.is_finite:
            return SetFrame(self.df.union(that.df).distinct())
        return SetFrame(None, Node("or", (self.node, that.node)))

    def intersect(self, that: SetFrame) -> SetFrame:
        for a, b in ((self, that), (that, self)):
            if a._df is not None or (a.is_finite and not b.is_finite):
                return SetFrame(b.node.choose(a.df, "x"))
        if self.is_finite and that.is_finite:
            return SetFrame(self.df.intersect(that.df))
        return SetFrame(None, Node("and", (self.node, that.node)))

    def diff(self, that: SetFrame) -> SetFrame:
        if self.is_finite:
            return SetFrame(that.node.choose(self.df, "x", False))
        return SetFrame(None, Node("and", (self.node, Node("not", (that.node,)))))

    def xor(self, that: SetFrame) -> SetFrame:
        if self.is_finite and that.is_finite:
            both = self.df.withColumn("s", F.lit(1)).union(that.df.withColumn("s", F.lit(2)))
            return SetFrame(both.groupBy("x").agg(F.sum("s").alias("s")).where("s <> 3").select("x"))
        return SetFrame(None, Node("xor", (self.node, that.node)))

    def complement(self) -> SetFrame:
        """Of a complement, the set itself: finite again, if it was."""
        if self._member is not None and self._member.kind == "not":
            inner = self._member.parts[0]
            return SetFrame(inner.parts[0]) if inner.kind == "in" else SetFrame(None, inner)
        return SetFrame(None, Node("not", (self.node,)))

    __or__ = __add__ = union
    __and__, __sub__, __xor__, __invert__ = intersect, diff, xor, complement

    def incl(self, e: Any) -> SetFrame:
        if not self.is_finite:
            return SetFrame(None, Node("or", (self.node, Node("is", (lambda x: x.eqNullSafe(F.lit(e)),)))))
        return SetFrame(self.df.union(self.df.sparkSession.range(1).select(F.lit(e).cast(self.df.dtypes[0][1]).alias("x"))).distinct())

    def excl(self, e: Any) -> SetFrame:
        if not self.is_finite:
            return SetFrame(None, Node("and", (self.node, Node("is", (lambda x: ~x.eqNullSafe(F.lit(e)),)))))
        return SetFrame(self.df.where(~F.col("x").eqNullSafe(F.lit(e))))

    # -- membership ----------------------------------------------------------------------------------------------
    def contains(self, e: Any) -> Scalar:
        if self._df is not None:
            return Scalar(self.df.where(F.col("x").eqNullSafe(F.lit(e))).limit(1).agg((F.count("*") > 0).alias("value")))
        one = SparkSession.active().range(1).select(F.lit(e).alias("x"))
        return Scalar(self.node.choose(one, "x").agg((F.count("*") > 0).alias("value")))

    def among(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose column is in the set."""
        return self.node.choose(df, column)

    def subset_of(self, that: SetFrame) -> Scalar:
        return Scalar(self.diff(that).df.limit(1).agg((F.count("*") == 0).alias("value")))

    # -- finite sets ---------------------------------------------------------------------------------------------
    def filter(self, p: Member) -> SetFrame:
        return SetFrame(self.df.where(p(F.col("x"))))

    def filter_not(self, p: Member) -> SetFrame:
        return SetFrame(self.df.where(~F.coalesce(p(F.col("x")), F.lit(False))))

    def map(self, f: Member) -> SetFrame:
        return SetFrame(self.df.select(f(F.col("x")).alias("x")).distinct())

    def flat_map(self, f: Member) -> SetFrame:
        return SetFrame(self.df.select(F.explode(f(F.col("x"))).alias("x")).distinct())

    def size(self) -> Scalar:
        return Scalar(self.df.agg(F.count("*").alias("value")))

    def is_empty(self) -> Scalar:
        return Scalar(self.df.limit(1).agg((F.count("*") == 0).alias("value")))

    def non_empty(self) -> Scalar:
        return Scalar(self.df.limit(1).agg((F.count("*") > 0).alias("value")))

    def count(self, p: Member) -> Scalar:
        return Scalar(self.df.agg(F.count_if(p(F.col("x"))).alias("value")))

    def exists(self, p: Member) -> Scalar:
        return Scalar(self.df.where(p(F.col("x"))).limit(1).agg((F.count("*") > 0).alias("value")))

    def forall(self, p: Member) -> Scalar:
        return Scalar(self.filter_not(p).df.limit(1).agg((F.count("*") == 0).alias("value")))

    def foreach(self, f: Callable) -> None:
        self.df.foreach(f)

    def _edge(self, choose: Callable) -> Scalar:
        empty = F.raise_error(F.lit("an empty set has no least or greatest element"))
        return Scalar(self.df.agg(F.when(F.count("*") == 0, empty).otherwise(choose("x")).alias("value")))

    def min(self) -> Scalar:
        return self._edge(F.min)

    def max(self) -> Scalar:
        return self._edge(F.max)

    def to_list(self) -> list:
        return [r[0] for r in self.df.orderBy("x").collect()]

    def iterator(self):
        return (r[0] for r in self.df.orderBy("x").toLocalIterator())

    def same_elements(self, that: SetFrame) -> Scalar:
        return Scalar(self.xor(that).df.limit(1).agg((F.count("*") == 0).alias("value")))

    def set_hash(self) -> Scalar:
        """The same for equal sets, whatever their order."""
        return Scalar(self.df.agg(F.coalesce(F.sum(F.xxhash64("x").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("value")))

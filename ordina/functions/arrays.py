"""The sequence operators inside one row: Column to Column over ArrayType."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column, Column], Column]


def tabulate(n: Column, f: Callable[[Column], Column]) -> Column:
    """f(0) .. f(n-1); none for n below 1."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n), f)


def take(xs: Column, n: int) -> Column:
    return F.slice(xs, 1, max(0, n))


def drop(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(max(0, n) + 1), F.greatest(F.size(xs) - max(0, n), F.lit(0)))


def take_right(xs: Column, n: int) -> Column:
    return F.reverse(take(F.reverse(xs), n))


def drop_right(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(F.size(xs) - max(0, n), F.lit(0)))


def slice_(xs: Column, start: int, until: int) -> Column:
    start = max(0, start)
    return F.slice(xs, start + 1, max(0, until - start))


def _first(xs: Column, p: Callable[[Column], Column]) -> Column:
    """The first place where p fails, or the size."""
    flags = F.transform(xs, lambda x, i: F.when(F.coalesce(p(x), F.lit(False)), F.lit(None)).otherwise(i))
    return F.coalesce(F.array_min(F.array_compact(flags)), F.size(xs))


def take_while(xs: Column, p: Callable[[Column], Column]) -> Column:
    return F.slice(xs, F.lit(1), _first(xs, p))


def drop_while(xs: Column, p: Callable[[Column], Column]) -> Column:
    return F.slice(xs, _first(xs, p) + 1, F.size(xs))


def zip_(xs: Column, ys: Column) -> Column:
    """As long as the shorter."""
    n = F.least(F.size(xs), F.size(ys))
    return F.zip_with(F.slice(xs, F.lit(1), n), F.slice(ys, F.lit(1), n), lambda a, b: F.struct(a.alias("_1"), b.alias("_2")))


def zip_with_index(xs: Column) -> Column:
    return F.transform(xs, lambda x, i: F.struct(x.alias("_1"), i.alias("_2")))


def pad_to(xs: Column, n: int, e: Column) -> Column:
    return F.concat(xs, F.array_repeat(e, F.greatest(F.lit(n) - F.size(xs), F.lit(0))))


def updated(xs: Column, i: int, e: Column) -> Column:
    bad = F.raise_error(F.lit(f"index {i} is out of bounds"))
    return F.when((F.lit(i) < 0) | (F.size(xs) <= i), bad).otherwise(F.transform(xs, lambda x, j: F.when(j == i, e).otherwise(x)))


def patch(xs: Column, start: int, those: Column, replaced: int) -> Column:
    start = max(0, start)
    return F.concat(take(xs, start), those, drop(xs, start + max(0, replaced)))


def index_where(xs: Column, p: Callable[[Column], Column]) -> Column:
    at = _first(xs, lambda x: ~F.coalesce(p(x), F.lit(False)))
    return F.when(at < F.size(xs), at).otherwise(-1)


def grouped(xs: Column, n: int) -> Column:
    n = max(1, n)
    return tabulate(F.ceil(F.size(xs) / n).cast("int"), lambda g: F.slice(xs, g * n + 1, n))


def sliding(xs: Column, n: int, step: int = 1) -> Column:
    count = F.when(F.size(xs) == 0, 0).when(F.size(xs) <= n, 1).otherwise(F.ceil((F.size(xs) - n) / step) + 1)
    return tabulate(count.cast("int"), lambda w: F.slice(xs, w * step + 1, n))


def fold_left(xs: Column, zero: Column, step: Step) -> Column:
    return F.aggregate(xs, zero, step)


def fold_right(xs: Column, zero: Column, step: Step) -> Column:
    return F.aggregate(F.reverse(xs), zero, lambda acc, x: step(x, acc))


def scan_left(xs: Column, zero: Column, step: Step) -> Column:
    return F.aggregate(xs, F.array(zero), lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x)))


def sum_(xs: Column, zero: Column) -> Column:
    return F.aggregate(xs, zero, lambda a, x: a + x)


def diff(xs: Column, ys: Column) -> Column:
    """Multiset difference: the earliest occurrences go."""
    return F.aggregate(
        xs, F.struct(F.filter(xs, lambda x: F.lit(False)).alias("kept"), ys.alias("left")),
        lambda acc, x: F.when(
            F.array_contains(acc["left"], x),
            F.struct(acc["kept"].alias("kept"), _without_first(acc["left"], x).alias("left")),
        ).otherwise(F.struct(F.array_append(acc["kept"], x).alias("kept"), acc["left"].alias("left"))),
        lambda acc: acc["kept"],
    )


def _without_first(xs: Column, x: Column) -> Column:
    at = F.array_position(xs, x).cast("int")
    return F.concat(F.slice(xs, F.lit(1), at - 1), F.slice(xs, at + 1, F.size(xs)))


def distinct(xs: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(xs)


def sort_by(xs: Column, key: Callable[[Column], Column]) -> Column:
    """Stable."""
    tagged = F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])

"""Dense ordinals, run ids and running folds over a declared order, without a single task for large inputs.

A frame that the optimizer's own size estimate puts below ``SMALL`` bytes is ordered by one window, if nothing in its
plan makes more rows than the estimate knows of.  Any other frame is dealt by range of its order, sorted and written
once; a row's place within its range comes from ``monotonically_increasing_id`` and what a range has to add from a
prefix sum over one row per range.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scratch import table

SMALL = 32 << 20
_RANGE, _PLACE = "__range", "__place"


#: Operators whose estimate bounds what they give: those that give no more rows than they take, and joins, estimated as a product.
_BOUNDED = set("Project Filter Relation LocalRelation LogicalRDD OneRowRelation Range Aggregate Distinct Deduplicate Sort Window GlobalLimit LocalLimit Limit Offset Union Join Intersect Except SubqueryAlias Repartition RepartitionByExpression RebalancePartitions CollectMetrics WithCTE CTERelationRef CTERelationDef InMemoryRelation".split())


def is_small(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [re.match(r"[\s:+\-!]*(\w+)", line) for line in plan.toString().splitlines()]
    if not all(m and m[1] in _BOUNDED for m in nodes):
        return False
    return int(str(plan.stats().sizeInBytes())) < SMALL


def ranged(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``df`` cut into sorted ranges, with __range and __place (from 0 within the range)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    rows = table(rows)
    return rows.withColumn(_RANGE, F.shiftright("__m", 33)).withColumn(_PLACE, F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")


def _added(rows: DataFrame, *totals: Column) -> DataFrame:
    return rows.groupBy(F.col(_RANGE).alias("__r")).agg(*totals)


def _up_to() -> WindowSpec:
    """The ranges before one: over one row a range."""
    return Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)


def dense(df: DataFrame, order: tuple[str, ...], name: str, small: bool | None = None) -> DataFrame:
    """Adds the 0-based place in the order as BIGINT ``name``."""
    if is_small(df) if small is None else small:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    rows = ranged(df, order)
    base = _added(rows, F.count("*").alias("__n")).select("__r", F.coalesce(F.sum("__n").over(_up_to()), F.lit(0)).alias("__base"))
    return rows.join(F.broadcast(base), F.col(_RANGE) == F.col("__r")).withColumn(name, F.col(_PLACE) + F.col("__base")).drop(_RANGE, _PLACE, "__r", "__base")


def run_ids(df: DataFrame, order: tuple[str, ...], key: Column, name: str, small: bool | None = None) -> DataFrame:
    """Adds the 0-based number of the maximal run of equal keys (null equals null) as BIGINT ``name``."""
    df = df.withColumn("__k", F.struct(key.alias("k")))
    if is_small(df) if small is None else small:
        w = Window.orderBy(*order)
        changed = F.when(F.lag("__k").over(w).eqNullSafe(F.col("__k")), 0).otherwise(1)
        out = df.withColumn("__c", changed).withColumn(name, (F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
        return out.drop("__k", "__c")
    rows, w = ranged(df, order), Window.partitionBy(_RANGE).orderBy(_PLACE)
    rows = rows.withColumn("__c", F.when((F.col(_PLACE) == 0) | F.lag("__k").over(w).eqNullSafe(F.col("__k")), 0).otherwise(1))
    rows = rows.withColumn("__l", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = _added(rows, F.max("__l").alias("__n"), F.min_by("__k", _PLACE).alias("__first"), F.max_by("__k", _PLACE).alias("__last"))
    by = Window.orderBy("__r")
    joint = F.when(F.row_number().over(by) == 1, 0).when(F.lag("__last").over(by).eqNullSafe(F.col("__first")), 0).otherwise(1)
    ends = ends.withColumn("__j", joint)
    base = ends.select("__r", (F.coalesce(F.sum("__n").over(_up_to()), F.lit(0)) + F.sum("__j").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("__base"))
    out = rows.join(F.broadcast(base), F.col(_RANGE) == F.col("__r")).withColumn(name, (F.col("__l") + F.col("__base")).cast("long"))
    return out.drop("__k", "__c", "__l", _RANGE, _PLACE, "__r", "__base")


def running(df: DataFrame, order: tuple[str, ...], fold: Callable[[Column], Column], both: Callable[[Column, Column], Column], value: Column, name: str, small: bool | None = None) -> DataFrame:
    """Adds the associative aggregate ``fold`` of ``value`` over all rows up to each; ``both`` joins two results."""
    if is_small(df) if small is None else small:
        return df.withColumn(name, fold(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = ranged(df.withColumn("__v", value), order)
    base = _added(rows, fold(F.col("__v")).alias("__t")).select("__r", fold(F.col("__t")).over(_up_to()).alias("__base"))
    own = fold(F.col("__v")).over(Window.partitionBy(_RANGE).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(F.broadcast(base), F.col(_RANGE) == F.col("__r")).withColumn("__o", own)
    return out.withColumn(name, F.when(F.col("__base").isNull(), F.col("__o")).otherwise(both(F.col("__base"), F.col("__o")))).drop("__v", "__o", _RANGE, _PLACE, "__r", "__base")


def occurrences(df: DataFrame, order: tuple[str, ...], key: Column, name: str, small: bool | None = None) -> DataFrame:
    """Adds the 1-based number of a row among the rows of its key (null equals null) as BIGINT ``name``.  A hot key's rows stay in their ranges."""
    if is_small(df) if small is None else small:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    rows = ranged(df.withColumn("__k", key), order)
    counts = rows.groupBy(F.col(_RANGE).alias("__r"), F.struct("__k").alias("__kk")).agg(F.count("*").alias("__n"))
    base = counts.withColumn("__base", F.sum("__n").over(Window.partitionBy("__kk").orderBy("__r")) - F.col("__n"))
    own = F.row_number().over(Window.partitionBy(_RANGE, "__k").orderBy(_PLACE))
    out = rows.withColumn("__own", own).join(base, (F.col(_RANGE) == F.col("__r")) & F.struct("__k").eqNullSafe(F.col("__kk")))
    return out.withColumn(name, (F.col("__own") + F.col("__base")).cast("long")).drop("__k", "__own", _RANGE, _PLACE, "__r", "__kk", "__n", "__base")

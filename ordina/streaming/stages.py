"""Stages with state over micro-batches: scans, runs of equal keys, prefixes and windows by count.

A stream's own order is the order within a key's arrival, so each stage takes the columns that split the stream into
independent sequences (``by``) and the column that orders rows within a batch (``order``).  Without ``by`` the whole
stream is one sequence and one task, as its meaning asks.  What is open when the stream ends (a run, a short window)
is flushed by a sentinel row for which ``end`` is true, or stays in the state.

A stage works on the arrays of a batch: folds named ``sum``, ``min`` or ``max`` are array operations that pass over
nulls, any other is a function of (accumulator, value).  Nulls arrive as nulls: whole numbers keep all their digits beside them.
"""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.scratch import folder

Fold = Callable[[Any, Any], Any] | str
_CONF, _STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMED = {"sum": (np.add, lambda a, v: a + v), "min": (np.minimum, min), "max": (np.maximum, max)}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The only store that holds this kind of state, for queries started inside; the session's own comes back after."""
    before = spark.conf.get(_CONF, None)
    spark.conf.set(_CONF, _STORE)
    try:
        yield
    finally:
        spark.conf.unset(_CONF) if before is None else spark.conf.set(_CONF, before)


class _Stage(StatefulProcessor):
    """``step(state, frame)`` gives the new state and the rows to emit; the frame is a batch of one sequence in its order."""

    def __init__(self, order: str, zero: Any, step: Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]):
        self.order, self.zero, self.step = order, zero, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "held binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import pickle

        state = pickle.loads(self.held.get()[0]) if self.held.exists() else self.zero
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        state, out = self.step(state, frame)
        self.held.update((pickle.dumps(state),))
        yield out

    def close(self) -> None:
        pass


def _null(name: str) -> str:
    return f"null__{name}"  # no underscore ahead: rows pass through named tuples


def _run(df: DataFrame, by: tuple[str, ...], order: str, zero: Any, step: Callable, schema: str, *values: str) -> DataFrame:
    """``values``: columns that may hold nulls, which go beside them, so that an array of whole numbers stays one."""
    kinds = dict(df.dtypes)
    zeros = {"bigint": 0, "int": 0, "smallint": 0, "tinyint": 0, "double": 0.0, "float": 0.0, "boolean": False}
    for v in dict.fromkeys(values):
        df = df.withColumn(_null(v), F.col(v).isNull())
        if kinds[v] in zeros:
            df = df.withColumn(v, F.coalesce(v, F.lit(zeros[kinds[v]]).cast(kinds[v])))
    keyed = df if by else df.withColumn("all__", F.lit(0))
    return keyed.groupBy(*(by or ("all__",))).transformWithStateInPandas(_Stage(order, zero, step), schema, "Append", "None")


def _values(frame: pd.DataFrame, name: str) -> list:
    """A column as a list, None for null."""
    xs = frame[name].tolist()
    none = frame[_null(name)].to_numpy(bool)
    return [None if n else x for x, n in zip(xs, none)] if none.any() else xs


def _live(frame: pd.DataFrame, end: str | None) -> tuple[pd.DataFrame, bool]:
    """The rows before the end row, and whether there is one."""
    if end is None:
        return frame, False
    over = frame[end].fillna(False).to_numpy(bool)
    return frame[~over], bool(over.any())


def _python(f: Fold) -> Callable[[Any, Any], Any]:
    if not isinstance(f, str):
        return f
    both = _NAMED[f][1]
    return lambda a, v: a if v is None else both(a, v)


def _rows(**columns: list) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in columns.items()})


def scan(df: DataFrame, order: str, value: str, zero: Any, f: Fold, kind: str = "bigint", by: tuple[str, ...] = ()) -> DataFrame:
    """(order, acc) after each row."""

    def step(acc: Any, frame: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        if isinstance(f, str) and not frame[_null(value)].any():
            got = _NAMED[f][0].accumulate(np.concatenate([[acc], frame[value].to_numpy()]))[1:].tolist()
        else:
            got = list(itertools.accumulate(_values(frame, value), _python(f), initial=acc))[1:]
        return got[-1], pd.DataFrame({order: frame[order], "acc": pd.Series(got, dtype=object)})

    return _run(df, by, order, zero, step, f"{order} bigint, acc {kind}", value)


def _starts(frame: pd.DataFrame, key: str) -> np.ndarray:
    """Where a run of equal keys begins; null equals null and NaN equals NaN."""
    k, none = frame[key].to_numpy(), frame[_null(key)].to_numpy(bool)
    same = k[1:] == k[:-1]
    if k.dtype.kind == "f":
        same |= np.isnan(k[1:]) & np.isnan(k[:-1])
    same = np.where(none[1:] | none[:-1], none[1:] & none[:-1], same.astype(bool))
    return np.flatnonzero(np.concatenate([[True], ~same]))


def _same(a: Any, b: Any) -> bool:
    return a == b or (a != a and b != b)


def fold_adjacent(df: DataFrame, order: str, key: str, value: str, seed: Any, f: Fold, kinds: tuple[str, str] = ("string", "bigint"), end: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, acc) of each run that has ended; runs go on over batches."""

    def step(state: Any, frame: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        live, over = _live(frame, end)
        done = [] if state is None else [state]
        if len(live):
            at = _starts(live, key)
            keys, values = _values(live.iloc[at], key), _values(live, value)
            if isinstance(f, str) and not live[_null(value)].any():
                ufunc, both = _NAMED[f]
                accs = [both(seed, x) for x in ufunc.reduceat(live[value].to_numpy(), at).tolist()]
                if state is not None and _same(state[0], keys[0]):
                    accs[0] = both(state[1], accs[0])
            else:
                first = state[1] if state is not None and _same(state[0], keys[0]) else seed
                accs = [reduce(_python(f), values[a:b], first if i == 0 else seed) for i, (a, b) in enumerate(zip(at, [*at[1:], len(values)]))]
            if state is not None and _same(state[0], keys[0]):
                done = []
            done += list(zip(keys, accs))
        state = None if over or not done else done.pop()
        return state, _rows(key=[k for k, _ in done], acc=[a for _, a in done])

    return _run(df, by, order, None, step, f"key {kinds[0]}, acc {kinds[1]}", key, value)


def grouped(df: DataFrame, order: str, value: str, n: int, kind: str = "bigint", end: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Arrays of n values, over batches; the short last one at the end row."""

    def step(state: list, frame: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        live, over = _live(frame, end)
        xs = state + _values(live, value)
        full = len(xs) if over else len(xs) // n * n
        return xs[full:], _rows(group=[xs[i : min(i + n, full)] for i in range(0, full, n)])

    return _run(df, by, order, [], step, f"group array<{kind}>", value)


def sliding(df: DataFrame, order: str, value: str, n: int, kind: str = "bigint", by: tuple[str, ...] = ()) -> DataFrame:
    """Every full window of n values, over batches."""

    def step(state: list, frame: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        xs = state + _values(frame, value)
        return xs[max(0, len(xs) - n + 1) :], _rows(window=[xs[i : i + n] for i in range(len(xs) - n + 1)])

    return _run(df, by, order, [], step, f"window array<{kind}>", value)


def zip_with_index(df: DataFrame, order: str, value: str, kind: str = "bigint", by: tuple[str, ...] = ()) -> DataFrame:
    """(value, index): the place in the stream."""

    def step(i: int, frame: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        return i + len(frame), pd.DataFrame({"value": pd.Series(_values(frame, value), dtype=object), "index": np.arange(i, i + len(frame))})

    return _run(df, by, order, 0, step, f"value {kind}, index bigint", value)


def take(df: DataFrame, order: str, value: str, n: int, kind: str = "bigint", by: tuple[str, ...] = ()) -> DataFrame:
    """(value) of the first n rows; ``settle`` and ``drain`` with ``most`` end the query when they are there."""

    def step(seen: int, frame: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        return min(n, seen + len(frame)), _rows(value=_values(frame.iloc[: max(0, n - seen)], value))

    return _run(df, by, order, 0, step, f"value {kind}", value)


def drop(df: DataFrame, order: str, value: str, n: int, kind: str = "bigint", by: tuple[str, ...] = ()) -> DataFrame:
    """(value) of all but the first n rows."""

    def step(seen: int, frame: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        return min(n, seen + len(frame)), _rows(value=_values(frame.iloc[max(0, n - seen) :], value))

    return _run(df, by, order, 0, step, f"value {kind}", value)


def _while(df: DataFrame, order: str, value: str, p: Column, kind: str, by: tuple[str, ...], lead: bool) -> DataFrame:
    def step(open_: bool, frame: pd.DataFrame) -> tuple[bool, pd.DataFrame]:
        fails = np.flatnonzero(~frame["held__p"].to_numpy(bool))
        at = 0 if not open_ else int(fails[0]) if len(fails) else len(frame)
        return open_ and not len(fails), _rows(value=_values(frame.iloc[:at] if lead else frame.iloc[at:], value))

    return _run(df.withColumn("held__p", F.coalesce(p, F.lit(False))), by, order, True, step, f"value {kind}", value)


def take_while(df: DataFrame, order: str, value: str, p: Column, kind: str = "bigint", by: tuple[str, ...] = ()) -> DataFrame:
    """(value) of the rows before the first for which ``p`` does not hold."""
    return _while(df, order, value, p, kind, by, True)


def drop_while(df: DataFrame, order: str, value: str, p: Column, kind: str = "bigint", by: tuple[str, ...] = ()) -> DataFrame:
    return _while(df, order, value, p, kind, by, False)


def take_right(df: DataFrame, order: str, value: str, n: int, end: str, kind: str = "bigint", by: tuple[str, ...] = ()) -> DataFrame:
    """The last n values, at the end row."""

    def step(state: list, frame: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        live, over = _live(frame, end)
        xs = (state + _values(live, value))[-n:] if n > 0 else []
        return ([], _rows(value=xs)) if over else (xs, _rows(value=[]))

    return _run(df, by, order, [], step, f"value {kind}", value)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    """First occurrences; the state holds the distinct keys."""
    return df.dropDuplicates(list(columns))


def group_reduce(df: DataFrame, key: Column, **aggregates: Column) -> DataFrame:
    """A running aggregation by key, for complete or update mode."""
    return df.groupBy(key.alias("key")).agg(*[a.alias(n) for n, a in aggregates.items()])


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now into a table in memory: for tests and small results."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    with state_store(df.sparkSession):
        query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def settle(df: DataFrame, most: int | None = None, done: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Runs an append stream over all that is there now into Parquet in the shared folder, and reads it.

    It ends early as soon as ``most`` rows are written or ``done`` holds of a batch that was; batches after that are
    not read.  ``most`` counts whole batches: put ``take`` before it for an exact number.
    """
    to, spark = folder(df.sparkSession), df.sparkSession
    writer = df.writeStream.option("checkpointLocation", f"{to}/state").trigger(availableNow=True)
    held = spark.read.schema(df.schema)
    if most is None and done is None:
        with state_store(spark):
            query = writer.format("parquet").start(f"{to}/rows")
        query.awaitTermination()
        return held.parquet(f"{to}/rows")
    enough, written = threading.Event(), [0]
    spark.createDataFrame([], df.schema).write.parquet(f"{to}/rows/batch=none")

    def put(batch: DataFrame, number: int) -> None:
        if enough.is_set():
            return
        path = f"{to}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        rows = held.parquet(path)
        if most is not None:
            written[0] += rows.count()
        if (most is not None and written[0] >= most) or (done is not None and done(rows)):
            enough.set()

    with state_store(spark):
        query = writer.foreachBatch(put).start()
    while not enough.is_set() and not query.awaitTermination(0.1):
        pass
    query.stop()
    return held.option("recursiveFileLookup", "true").parquet(f"{to}/rows")

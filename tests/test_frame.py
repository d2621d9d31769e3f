"""Parity of the sequence operators with plain lists, at small sizes, and of the distributed helpers with one window."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ordina.operators import agg as A
from ordina.operators.frame import SeqFrame
from ordina.operators.sets import SetFrame
from ordina.plans import ordinal
from ordina.sources import constructors as C



@pytest.fixture(autouse=True)
def _columns(spark):
    """Columns need a session."""
    globals()["X"] = F.col("x")


SIZES = [[], [5], [3, 1], [4, 4, 1, 3, 3, 2, 4]]


def seq(spark, values, kind="bigint"):
    return SeqFrame.literal(spark, values, kind)


@pytest.mark.parametrize("xs", SIZES)
def test_structure(spark, xs):
    q = seq(spark, xs)
    for n in (-1, 0, 1, 3, 99):
        k = max(0, n)
        assert q.take(n).to_list() == xs[:k]
        assert q.drop(n).to_list() == xs[k:]
        assert q.filter(X > 0).drop(n).to_list() == xs[k:]
    assert q.take_right(2).to_list() == xs[-2:]
    assert q.drop_right(2).to_list() == xs[:-2]
    assert q.slice(1, 3).to_list() == xs[1:3]
    assert q.reverse().to_list() == xs[::-1]
    assert q.concat(q, q).to_list() == xs * 3
    assert q.append(F.lit(9)).prepend(F.lit(8)).to_list() == [8, *xs, 9]
    assert q.pad_to(3, F.lit(0)).to_list() == xs + [0] * (3 - len(xs))
    assert q.patch(1, seq(spark, [7, 7]), 2).to_list() == xs[:1] + [7, 7] + xs[3:]
    assert q.zip_with_index().to_list() == [(x, i) for i, x in enumerate(xs)]
    assert q.grouped(2).to_list() == [xs[i : i + 2] for i in range(0, len(xs), 2)]
    assert q.take_while(X > 2).to_list() == list(itertools.takewhile(lambda x: x > 2, xs))
    assert q.drop_while(X > 2).to_list() == list(itertools.dropwhile(lambda x: x > 2, xs))
    assert q.inits().to_list() == [xs[: len(xs) - i] for i in range(len(xs) + 1)]
    assert q.tails().to_list() == [xs[i:] for i in range(len(xs) + 1)]


@pytest.mark.parametrize("xs", SIZES)
def test_windows_of_all_sizes(spark, xs):
    for n, step in ((1, 1), (2, 1), (3, 2), (9, 1)):
        count = 0 if not xs else 1 if len(xs) <= n else -(-(len(xs) - n) // step) + 1
        assert seq(spark, xs).sliding(n, step).to_list() == [xs[i * step : i * step + n] for i in range(count)]


@pytest.mark.parametrize("xs", SIZES)
def test_order_and_multisets(spark, xs):
    q, ys = seq(spark, xs), [4, 3, 9]
    assert q.sorted().to_list() == sorted(xs)
    assert q.sort_by(X % 2).to_list() == sorted(xs, key=lambda x: x % 2)
    assert q.distinct().to_list() == list(dict.fromkeys(xs))
    left = list(ys)
    gone = [x for x in xs if not (x in left and (left.remove(x) or True))]
    assert q.diff(seq(spark, ys)).to_list() == gone
    left = list(ys)
    assert q.intersect(seq(spark, ys)).to_list() == [x for x in xs if x in left and (left.remove(x) or True)]
    assert q.top_n(2).to_list() == sorted(xs, reverse=True)[:2]
    assert q.bottom_n(0).to_list() == sorted(xs)[:1]


@pytest.mark.parametrize("xs", SIZES)
def test_searches_and_folds(spark, xs):
    q = seq(spark, xs)
    assert q.count(X > 2).value() == sum(x > 2 for x in xs)
    assert q.index_of(F.lit(3)).value() == (xs.index(3) if 3 in xs else -1)
    assert q.last_index_of(F.lit(4)).value() == (len(xs) - 1 - xs[::-1].index(4) if 4 in xs else -1)
    assert q.exists(X == 3).value() == (3 in xs) and q.forall(X > 0).value()
    assert q.sum(X).value() == sum(xs)
    assert q.reduce_option(lambda a, b: a * 2 - b, X).value() == (None if not xs else __import__("functools").reduce(lambda a, b: a * 2 - b, xs))
    assert q.fold_left(F.lit(1).cast("bigint"), lambda a, x: a * 3 + x, X).value() == __import__("functools").reduce(lambda a, x: a * 3 + x, xs, 1)
    assert q.scan_left(F.lit(0).cast("bigint"), F.sum, lambda a, b: a + b, X).to_list() == list(itertools.accumulate(xs, initial=0))
    assert q.scan_general(F.lit(1).cast("bigint"), lambda a, x: a * 2 - x, X).to_list() == list(itertools.accumulate(xs, lambda a, x: a * 2 - x, initial=1))
    assert q.mk_string(X, ",", "<", ">").value() == "<" + ",".join(map(str, xs)) + ">"
    assert q.is_empty().value() == (not xs) and q.length_compare(2).value() == (len(xs) > 2) - (len(xs) < 2)
    assert q.segment_length(X > 2).value() == len(list(itertools.takewhile(lambda x: x > 2, xs)))
    for pattern in ([4, 1], [3, 3], [8]):
        at = [i for i in range(len(xs)) if xs[i : i + len(pattern)] == pattern]
        assert q.index_of_slice(pattern).value() == (at[0] if at else -1)
        assert q.last_index_of_slice(pattern).value() == (at[-1] if at else -1)
    assert q.head_option().value() == (xs[0] if xs else None) and q.last_option().value() == (xs[-1] if xs else None)


def test_empty_input_raises_where_a_value_is_due(spark):
    q = seq(spark, [])
    for terminal in (q.head(), q.last(), q.min(X), q.max(X), q.reduce(lambda a, b: a, X), q.max_by(X, X), q.apply(0)):
        with pytest.raises(Exception, match="empty sequence"):
            terminal.value()
    with pytest.raises(Exception, match="out of bounds"):
        seq(spark, [1]).updated(3, "x", F.lit(0)).to_list()


def test_adjacent_runs_also_without_a_row_that_counts(spark):
    xs = [5, 5, 5, 9, 9, 1, 7, 7]
    q = seq(spark, xs)
    runs = [(k, list(g)) for k, g in itertools.groupby(xs)]
    assert q.group_adjacent_by(X).to_list() == runs
    assert q.fold_adjacent_by(X, F.lit(0).cast("bigint"), lambda a, x: a + x, X).to_list() == [(k, sum(g)) for k, g in runs]
    assert q.group_adjacent_reduce_by(X, n=A.count().where(X > 6)).to_list() == [(k, sum(v > 6 for v in g)) for k, g in runs]


def test_choices(spark):
    xs = [2, 1, 2, 3]
    first = {v: i for i, v in reversed(list(enumerate(xs)))}
    want = sorted({tuple(sorted(c, key=first.get)) for c in itertools.combinations(xs, 2)}, key=lambda c: [first[v] for v in c])
    assert [tuple(c) for c in seq(spark, xs).combinations(2).to_list()] == want
    perms = sorted(set(itertools.permutations(xs)), key=lambda c: [first[v] for v in c])
    assert [tuple(c) for c in seq(spark, xs).permutations().to_list()] == perms
    assert seq(spark, xs).combinations(9).to_list() == [] and seq(spark, []).combinations(0).to_list() == [[]]


def test_floats_in_primitive_comparison(spark):
    q = seq(spark, [float("nan"), 0.0, -0.0, float("nan"), 1.0], "double")
    assert q.distinct(ieee=True).count().value() == 4
    assert q.contains(F.lit(float("nan"))).value() is False
    s = SetFrame.doubles(q.map("x").df.select("x"))
    assert s.size().value() == 4


def test_zips_stop_at_the_shorter(spark):
    a, b = seq(spark, [1, 2, 3]), seq(spark, [4, 5]).map(y=X)
    assert a.zip(b).to_list() == [(1, 4), (2, 5)]
    assert a.map2(b, z=X + F.col("y")).to_list() == [5, 7]
    with pytest.raises(ValueError, match="both sides"):
        a.zip(a)


def test_distributed_helpers_equal_one_window(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("o"), (F.floor(F.col("id") / 3) % 4).alias("k"))
    for key in (F.col("k"), F.when(F.col("k") > 1, F.col("k"))):
        a = {r.o: (r.d, r.run, r.s) for r in ordinal.running(ordinal.run_ids(ordinal.dense(df, ("o",), "d", True), ("o",), key, "run", True), ("o",), F.sum, lambda x, y: x + y, F.col("k"), "s", True).collect()}
        b = {r.o: (r.d, r.run, r.s) for r in ordinal.running(ordinal.run_ids(ordinal.dense(df, ("o",), "d", False), ("o",), key, "run", False), ("o",), F.sum, lambda x, y: x + y, F.col("k"), "s", False).collect()}
        assert a == b


def test_random_pipelines(spark):
    rnd = random.Random(64222)
    stages = [
        (lambda q: q.map(x=X + 1), lambda v: [x + 1 for x in v]),
        (lambda q: q.filter(X % 2 == 0), lambda v: [x for x in v if x % 2 == 0]),
        (lambda q: q.take(4), lambda v: v[:4]),
        (lambda q: q.drop(2), lambda v: v[2:]),
        (lambda q: q.reverse(), lambda v: v[::-1]),
        (lambda q: q.distinct(), lambda v: list(dict.fromkeys(v))),
        (lambda q: q.flat_map(F.array(X, -X)), lambda v: [y for x in v for y in (x, -x)]),
        (lambda q: q.take_while(X < 8), lambda v: list(itertools.takewhile(lambda x: x < 8, v))),
        (lambda q: q.sorted(), sorted),
        (lambda q: q.append(F.lit(3)), lambda v: [*v, 3]),
    ]
    for _ in range(12):
        xs = [rnd.randint(-4, 11) for _ in range(rnd.randint(0, 21))]
        q, v, path = seq(spark, xs), xs, []
        for i in [rnd.randrange(len(stages)) for _ in range(rnd.randint(1, 4))]:
            q, v = stages[i][0](q), stages[i][1](v)
            path.append(i)
        assert q.to_list() == v, (xs, path)


def test_sets(spark):
    a, b = SetFrame.literal(spark, 1, 2, 3, 4), SetFrame.literal(spark, 3, 4, 5, 6)
    assert (a | b).to_list() == [1, 2, 3, 4, 5, 6] and (a & b).to_list() == [3, 4] and (a - b).to_list() == [1, 2] and (a ^ b).to_list() == [1, 2, 5, 6]
    assert (a & SetFrame.above(2)).to_list() == [3, 4] and (a - SetFrame.above(2)).to_list() == [1, 2]
    rest = ~SetFrame.literal(spark, 2, 4)
    assert rest.finite() is None and [rest.contains(i).value() for i in (1, 2)] == [True, False]
    assert (a & rest).to_list() == [1, 3]
    assert SetFrame.range(5, 4).to_list() == [] and SetFrame.until(1, 4).to_list() == [1, 2, 3]
    assert a.same_elements(SetFrame.literal(spark, 4, 3, 2, 1, 1)).value() and (a & b).subset_of(a).value()
    assert a.set_hash().value() == SetFrame.literal(spark, 4, 3, 2, 1).set_hash().value()
    with pytest.raises(ValueError, match="not finite"):
        SetFrame.above(3).materialize()
    with pytest.raises(Exception, match="empty set"):
        SetFrame.empty(spark).min().value()


def test_constructors(spark):
    assert C.range_(spark, 0, 5).to_list() == [0, 1, 2, 3, 4] and C.range_(spark, 5, 0, -2).to_list() == [5, 3, 1] and C.range_(spark, 3, 3).to_list() == []
    assert C.source_range(spark, 0, 5, -1).to_list() == []
    for bad in ((0, 5, 0), (0, 5, -1), (5, 0, 1)):
        with pytest.raises(ValueError):
            C.range_(spark, *bad)
    assert C.iterate(spark, "1", "x * 2", 5).to_list() == [1, 2, 4, 8, 16] and C.iterate(spark, "1", "x", 0).to_list() == []
    assert C.unfold(spark, 3, lambda v: (v, v - 1) if v else None).to_list() == [3, 2, 1]
    with pytest.raises(TypeError, match="element types"):
        seq(spark, [1]).concat(seq(spark, ["a"], "string"))


def test_limits_and_pruning_in_the_plan(spark):
    q = SeqFrame.of(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey")
    plan = q.filter(F.col("o_totalprice") > 10).map("o_custkey").plan()
    assert set(plan["live"]) <= {"o_custkey", "o_totalprice", "o_orderkey"} and any("o_totalprice" in p for p in plan["predicate"])
    assert "TakeOrderedAndProject" in q.top_n_by(3, F.col("o_totalprice")).plan()["operators"]

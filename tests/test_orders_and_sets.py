"""Orders of any type, nulls and NaN; sets with null; what is pulled and what ends early."""

import itertools
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from ordina.operators import agg as A
from ordina.operators.frame import SeqFrame
from ordina.operators.sets import SetFrame
from ordina.plans import ordinal
from ordina.sources import constructors as C
from ordina.streaming import stages
from ordina.streaming.frame import StreamFrame

NAN = float("nan")


def by_spark(x):
    """Null is the least, NaN the greatest."""
    return (0, 0) if x is None else (2, 0) if isinstance(x, float) and math.isnan(x) else (1, x)


def plain(xs):
    return ["nan" if isinstance(x, float) and math.isnan(x) else x for x in xs]


def test_order_keys_keep_their_type(spark):
    q = C.of(spark, 0.9, 0.1, 0.5, 0.3, kind="double").sorted()
    assert q.append(F.lit(9.0)).to_list() == [0.1, 0.3, 0.5, 0.9, 9.0]
    assert q.patch(1, C.of(spark, 7.0, kind="double"), 1).to_list() == [0.1, 7.0, 0.5, 0.9]
    names = C.of(spark, "b", "c", "a", kind="string").sorted()
    assert names.append(F.lit("A")).prepend(F.lit("z")).to_list() == ["z", "a", "b", "c", "A"]
    assert names.concat(names.reverse()).to_list() == ["a", "b", "c", "c", "b", "a"]
    stamps = C.of(spark, *["2020-01-01 00:00:00.25", "2020-01-01 00:00:00.75"], kind="string").map(x=F.to_timestamp("x")).sorted().reverse()
    assert [t.microsecond for t in stamps.append(F.lit(None)).to_list()[:2]] == [750000, 250000]


@pytest.mark.parametrize("kind,xs", [("double", [1.0, None, NAN, 3.0, -0.5, None, NAN]), ("bigint", [3, None, 1, -(1 << 63), (1 << 63) - 1]), ("string", ["b", None, "a", "ab", ""]), ("boolean", [True, None, False, True]), ("date", None)])
def test_reverse_and_top(spark, kind, xs):
    q = C.of(spark, *xs, kind=kind) if xs else C.of(spark, "2020-02-01", None, "1960-01-01", kind="string").map(x=F.to_date("x"))
    xs = xs or q.to_list()
    up = sorted(xs, key=by_spark)
    assert plain(q.sorted().to_list()) == plain(up)
    assert plain(q.sorted().reverse().to_list()) == plain(up[::-1])
    assert plain(q.sorted().reverse().reverse().to_list()) == plain(up)
    assert plain(q.top_n(3).to_list()) == plain(up[::-1][:3])
    assert plain(q.bottom_n(3).to_list()) == plain(up[:3])
    ranked = sorted(range(len(xs)), key=lambda i: by_spark(xs[i]))
    best = max(range(len(xs)), key=lambda i: (by_spark(xs[i]), -i))
    row = q.zip_with_index("i")
    got = row.agg(hi=A.max_by(F.col("i"), F.col("x")), lo=A.min_by(F.col("i"), F.col("x")), top=A.top_n_by(2, F.col("x"), F.col("i"))).value()
    assert got.hi == best and got.lo == ranked[0] and got.top[0] == best


def test_text_orders_are_turned_by_places(spark):
    q = SeqFrame.of(spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "k string, v int"), "k")
    assert q.max_by(F.col("k"), F.col("v")).value() == "a"
    assert q.map("v").reverse().to_list() == [0, 1, 1]


def test_random_pipelines(spark):
    """Chains of stages against lists."""
    rng = random.Random(4)
    for _ in range(6):
        xs = [rng.choice([None, NAN, rng.random(), float(rng.randrange(4))]) for _ in range(rng.randrange(9))]
        q, want = C.of(spark, *xs, kind="double"), list(xs)
        for step in rng.choices("srapdtkcu", k=4):
            n = rng.randrange(5)
            if step == "s":
                q, want = q.sorted(), sorted(want, key=by_spark)
            elif step == "r":
                q, want = q.reverse(), want[::-1]
            elif step == "a":
                q, want = q.append(F.lit(float(n))), [*want, float(n)]
            elif step == "p":
                q, want = q.prepend(F.lit(float(n))), [float(n), *want]
            elif step == "d":
                q, want = q.drop(n), want[n:]
            elif step == "t":
                q, want = q.take(n), want[:n]
            elif step == "k":
                q, want = q.drop_right(n), want[: max(0, len(want) - n)]
            elif step == "c":
                q, want = q.concat(q), want + want
            else:
                q, want = q.patch(n, C.of(spark, 8.0, kind="double"), 1), want[:n] + [8.0] + want[n + 1 :]
        assert plain(q.to_list()) == plain(want)


def test_places_and_windows(spark):
    xs = [5, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    q = C.of(spark, *xs).map(x=F.col("x"))
    for start in (0, 3, 20):
        assert q.index_of(F.lit(5), start).value() == (xs.index(5, start) if 5 in xs[start:] else -1)
        assert q.last_index_of(F.lit(5), start).value() == max([i for i in range(len(xs)) if xs[i] == 5 and i <= start], default=-1)
        want = len(list(itertools.takewhile(lambda x: x < 6, xs[start:])))
        assert q.segment_length(F.col("x") < 6, start).value() == want
    holes = C.of(spark, *[1, None, 3, None, 5, 6, 7])
    for size, step in ((3, 1), (5, 2), (9, 1), (2, 3), (1, 1)):
        ys = [1, None, 3, None, 5, 6, 7]
        ends = [0] if len(ys) <= size else range(0, len(ys) - size + step, step)
        assert holes.sliding(size, step).to_list() == [ys[i : i + size] for i in ends]


def test_windows_over_ranges(spark):
    got = C.tabulate(spark, 20_000, lambda i: i).sliding(4, 1).df.select(F.count("*"), F.sum(F.when(F.col("window") == F.sequence(F.col("_pos"), F.col("_pos") + 3), 1))).first()
    assert tuple(got) == (19_997, 19_997)


def test_occurrences_of_a_hot_key(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).alias("k"))
    one, two = (sorted(map(tuple, ordinal.occurrences(df, ("id",), F.col("k"), "o", small=s).select("id", "o").collect())) for s in (True, False))
    assert one == two and one[3] == (3, 2)


def test_exploded_rows_are_not_taken_for_few(spark):
    df = spark.range(1000).select(F.explode(F.sequence(F.lit(1), F.lit(500_000))).alias("x"))
    assert ordinal.is_small(spark.range(1000)) and not ordinal.is_small(df)


def test_sets_hold_null(spark):
    a, b = SetFrame.literal(spark, 0, 1, 2, 3, 4), SetFrame.literal(spark, 1, None)
    assert (a - b).to_list() == [0, 2, 3, 4] == (a & ~b).to_list()
    with_null = a | b
    assert (with_null & ~SetFrame.literal(spark, 1)).to_list() == [None, 0, 2, 3, 4]
    assert (with_null & ~SetFrame.above(1)).to_list() == [None, 0, 1]
    assert (with_null & (SetFrame.above(3) | b)).to_list() == [None, 1, 4]
    assert (with_null & (SetFrame.above(3) ^ b)).to_list() == [None, 1, 4]
    assert (with_null & ~(SetFrame.above(3) | b)).to_list() == [0, 2, 3]
    assert (with_null & ~~b).to_list() == [None, 1] and (~~b).is_finite
    assert [(~b).contains(x).value() for x in (1, 2)] == [False, True]
    assert (~b).incl(1).contains(1).value() and not (~b).excl(2).contains(2).value()
    assert [r[0] for r in (~b).among(spark.range(3), "id").collect()] == [0, 2]


def test_complement_broadcasts_nothing(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = SetFrame.of(spark.range(100)), SetFrame.of(spark.range(50))
        assert "Broadcast" not in (a & ~b).df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def counting(where, bad=None):
    """Made here, so that it goes to the executor by value."""

    class Counting:
        """A source that tells what was pulled and whether it was closed."""

        def __init__(self, folder, bad=None):
            self.folder, self.n, self.bad = folder, 0, bad

        def pull_chunk(self):
            if self.n == self.bad:
                raise ValueError("no more")
            self.n += 1
            with open(os.path.join(self.folder, "pulled"), "w") as f:
                f.write(str(self.n))
            return list(range(1000 * self.n, 1000 * self.n + 1000))

        def close(self):
            with open(os.path.join(self.folder, "closed"), "w") as f:
                f.write("x")

    return lambda: Counting(where, bad)


def test_a_limit_stops_pulling_and_closes(spark, tmp_path):
    where = str(tmp_path)
    got = C.from_source(spark, counting(where)).filter(F.col("x") % 2 == 1).take(3).to_list()
    assert got == [1001, 1003, 1005]
    for _ in range(100):
        if (tmp_path / "closed").exists():
            break
        import time

        time.sleep(0.1)
    assert (tmp_path / "closed").exists() and int((tmp_path / "pulled").read_text()) < 1000


def test_an_error_closes(spark, tmp_path):
    where = str(tmp_path)
    with pytest.raises(Exception, match="no more"):
        C.from_source(spark, counting(where, 2)).to_list()
    assert (tmp_path / "closed").exists()


def test_stop_at(spark):
    assert C.generate(spark, C.stop_at(itertools.count, lambda x: x < 5)).to_list() == [0, 1, 2, 3, 4]


def test_a_stream_ends_early(spark, tmp_path):
    for i in range(12):
        path = tmp_path / f"{i}.json"
        path.write_text("\n".join(json.dumps({"pos": 10 * i + j, "v": j}) for j in range(10)))
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    df = spark.readStream.schema("pos bigint, v bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    found = stages.settle(df, most=15)
    assert 15 <= found.count() < 120
    q = StreamFrame(df, "pos")
    assert q.find(F.col("pos") > 33).first()["pos"] == 34 and not q.exists(F.col("v") > 10)


def test_runs_with_null_keys_on_a_stream(spark, tmp_path):
    keys = [1, 1, None, None, (1 << 60) + 1, (1 << 60) + 1, 0, None]
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"pos": i, "k": k, "fin": False}) for i, k in enumerate(keys)) + "\n" + json.dumps({"pos": 99, "k": None, "fin": True}))
    df = spark.readStream.schema("pos bigint, k bigint, fin boolean").json(str(tmp_path))
    q = StreamFrame(df, "pos", end="fin")
    got = [tuple(r) for r in stages.settle(q.fold_adjacent_by(F.col("k"), 0, "sum", "pos")).collect()]
    assert got == [(1, 1), (None, 5), ((1 << 60) + 1, 9), (0, 6), (None, 7)]

import dataclasses
import itertools
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ordina.operators import agg as A
from ordina.sources import constructors as C
from ordina.sources import ndjson
from ordina.streaming import stages


@dataclasses.dataclass
class Rec:
    id: int
    amount: float
    category: str


def test_records(spark, tmp_path):
    rows = [{"category": f"shelf {i % 4}", "extra": {"a": [1]}, "id": i, "amount": i * 0.75 + 2} for i in range(50)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = ndjson.files(spark, str(tmp_path), Rec)
    assert [r.id for r in q.to_list()] == list(range(50))
    plan = ndjson.table(spark, str(tmp_path), Rec).where("amount > 18").select("category")
    from ordina.plans.report import report

    found = report(plan)
    assert set(found["live"]) == {"amount", "category"} and any("amount" in p for p in found["predicate"])
    got = ndjson.in_memory(spark, '{"id": 1}\n{"amount": 2.5, "category": "é\\n"}', Rec, "zero").to_list()
    assert [tuple(r) for r in got] == [(1, 0.0, ""), (0, 2.5, "é\n")]
    assert q.filter(F.col("amount") > 18).agg(n=A.count()).value() == sum(r["amount"] > 18 for r in rows)
    with pytest.raises(TypeError, match="flat"):
        ndjson.schema_of("a ARRAY<INT>")


def test_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("b\na\n\nc")
    assert C.lines(spark, str(tmp_path / "t.txt")).to_list() == ["b", "a", "", "c"]


@pytest.fixture
def folder(spark, tmp_path):
    """A stream of four files with runs that go on over files, and an end row."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    chunks = [[3, 5, 9], [14, 40], [41, 47, 62], [65]]
    n = 0
    for i, chunk in enumerate(chunks):
        lines = []
        for v in chunk:
            lines.append(json.dumps({"pos": n, "v": v, "fin": False}))
            n += 1
        if i == 3:
            lines.append(json.dumps({"pos": n, "v": 0, "fin": True}))
        path = tmp_path / f"{i}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    df = spark.readStream.schema("pos bigint, v bigint, fin boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    return df, [v for c in chunks for v in c]


def test_stages_keep_their_state_over_batches(spark, folder):
    df, xs = folder
    runs = [(k, sum(g)) for k, g in itertools.groupby(xs, key=lambda v: v // 10)]
    keyed = df.withColumn("k", F.floor(F.col("v") / 10))
    got = stages.drain(stages.fold_adjacent(keyed, "pos", "k", "v", 0, lambda a, v: a + v, ("bigint", "bigint"), "fin"), "runs").collect()
    assert [tuple(r) for r in got] == runs
    got = stages.drain(stages.grouped(df, "pos", "v", 4, end="fin"), "groups").collect()
    assert [list(r[0]) for r in got] == [xs[i : i + 4] for i in range(0, len(xs), 4)]
    live = df.where("not fin")
    got = {r.pos: r.acc for r in stages.drain(stages.scan(live, "pos", "v", 0, lambda a, v: a + v), "sums").collect()}
    assert list(got.values()) == list(itertools.accumulate(xs))


def test_streams_take_every_user(spark, tmp_path):
    """Brute force over every user."""
    from ordina.plans import catalog

    rows = [(i, (7, 59, 60, 1000)[i * i % 11 % 4], "ab"[i // 3 % 2]) for i in range(48)]
    columns = dict(zip(("event_id", "user_id", "event_type"), map(list, zip(*rows))))
    pq.write_table(pa.table(columns), tmp_path / "events.parquet")
    own = [[r for r in rows if r[1] == u] for u in (7, 59, 60, 1000)]
    got = lambda name: sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    assert got("stream_scan") == sorted((r[0], a) for rs in own for r, a in zip(rs, itertools.accumulate(r[0] for r in rs)))
    runs = [[(k, sum(r[0] for r in g)) for k, g in itertools.groupby(rs, key=lambda r: r[2])][:-1] for rs in own]
    assert got("stream_fold_adjacent") == sorted(x for rs in runs for x in rs)
    ids = [[r[0] for r in rs] for rs in own]
    assert got("stream_grouped") == sorted((tuple(x[i : i + 3]),) for x in ids for i in range(0, len(x) - 2, 3))
    assert got("stream_sliding") == sorted((tuple(x[i : i + 3]),) for x in ids for i in range(len(x) - 2))
    assert got("stream_zip_with_index") == sorted((v, i) for x in ids for i, v in enumerate(x))
    assert got("stream_distinct") == sorted({(r[1], r[2]) for r in rows})

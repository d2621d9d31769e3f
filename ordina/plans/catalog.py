"""Registered queries of the sequence engine over the star tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as R
from ..operators import agg as A
from ..operators.frame import POS, SeqFrame
from ..operators.sets import SetFrame
from ..sources import constructors as C
from ..sources import ndjson
from ..streaming import stages
from ..streaming.frame import StreamFrame
from .scratch import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _read(s: SparkSession, d: str, table: str) -> DataFrame:
    return s.read.parquet(f"{d}/{table}.parquet")


def events(s: SparkSession, d: str) -> SeqFrame:
    """Events in the order of event_id; x is the user."""
    return SeqFrame.of(_read(s, d, "events").select("event_id", "user_id", "event_type", "value", "props", F.col("user_id").alias("x")), "event_id")


def orders(s: SparkSession, d: str) -> SeqFrame:
    return SeqFrame.of(_read(s, d, "orders").withColumn("x", F.col("o_custkey")), "o_orderkey")


def places(q: SeqFrame, *columns: str) -> DataFrame:
    """The frame with its dense places as ``pos``."""
    return q.dense().df.select(F.col(POS).cast("bigint").alias("pos"), *columns)


def c(name: str) -> F.Column:
    return F.col(name)


_EV = "SELECT *, user_id AS x, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events"
_P = "CAST(row_number() OVER (ORDER BY {}) - 1 AS BIGINT) AS pos"


# -- fused filters, projections and aggregates ------------------------------------------------------------------------
@query("SELECT CAST(sum(l_linenumber * 2) AS BIGINT) AS total, count(*) AS n, max(l_extendedprice) AS peak FROM lineitem WHERE l_quantity > 20")
def fuse_filter_map_agg(s, d):
    q = SeqFrame(_read(s, d, "lineitem"), ("l_orderkey", "l_linenumber"))
    return q.filter(c("l_quantity") > 20).map(twice=c("l_linenumber") * 2, price=c("l_extendedprice")).agg(total=A.sum(c("twice")), n=A.count(), peak=A.max(c("price"))).df


@query("SELECT event_id, upper(event_type) AS kind, user_id * 2 AS twice FROM events")
def map_(s, d):
    return events(s, d).map("event_id", kind=F.upper("event_type"), twice=c("user_id") * 2).ordered()


@query("SELECT event_id FROM events WHERE value > 50")
def filter_(s, d):
    return events(s, d).filter(c("value") > 50).map("event_id").ordered()


@query("SELECT event_id FROM events WHERE NOT coalesce(value > 50, false)")
def filter_not(s, d):
    return events(s, d).filter_not(c("value") > 50).map("event_id").ordered()


@query("SELECT o_orderkey, unnest([o_custkey, -o_custkey]) AS k FROM orders")
def flat_map(s, d):
    return orders(s, d).flat_map(F.array("o_custkey", -c("o_custkey")), "k", "o_orderkey").ordered()


@query("SELECT vec_id, unnest(embedding) AS e FROM embeddings")
def flatten(s, d):
    q = SeqFrame.of(_read(s, d, "embeddings").select("vec_id", c("embedding").alias("e")), "vec_id")
    return q.flat_map(c("e"), "e", "vec_id").ordered()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS code FROM orders WHERE o_orderstatus IN ('F', 'O')")
def collect(s, d):
    return orders(s, d).collect(c("o_orderstatus").isin("F", "O"), o_orderkey=c("o_orderkey"), code=F.when(c("o_orderstatus") == "F", 1).otherwise(2)).ordered()


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS side FROM events")
def partition(s, d):
    even, odd = events(s, d).partition(c("user_id") % 2 == 0)
    return even.map("event_id", side=F.lit("even")).df.select("event_id", "side").union(odd.map("event_id", side=F.lit("odd")).df.select("event_id", "side"))


@query("SELECT event_id, CASE WHEN value > 50 THEN user_id ELSE -user_id END AS y FROM events")
def partition_map(s, d):
    yes, no = events(s, d).partition(c("value") > 50)
    return yes.map("event_id", y=c("user_id")).df.select("event_id", "y").union(no.map("event_id", y=-c("user_id")).df.select("event_id", "y"))


@query("SELECT count(*) AS n FROM events WHERE event_id >= 0")
def tap_each(s, d):
    return events(s, d).tap_each("seen", F.count(F.lit(1)).alias("n")).count().df.select(F.col("count").alias("n"))


# -- positions ----------------------------------------------------------------------------------------------------------
@query("SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def take(s, d):
    return events(s, d).take(100).map("event_id").ordered()


@query("SELECT event_id FROM events ORDER BY event_id OFFSET 100")
def drop(s, d):
    return events(s, d).drop(100).map("event_id").ordered()


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50")
def take_right(s, d):
    return events(s, d).take_right(50).map("event_id").ordered()


@query("SELECT event_id FROM events ORDER BY event_id DESC OFFSET 50")
def drop_right(s, d):
    return events(s, d).drop_right(50).map("event_id").ordered()


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 70 OFFSET 30")
def slice_(s, d):
    return events(s, d).slice(30, 100).map("event_id").ordered()


@query(f"SELECT event_id, CASE WHEN pos < 10 THEN 'left' ELSE 'right' END AS side FROM ({_EV})")
def split_at(s, d):
    left, right = events(s, d).split_at(10)
    return left.map("event_id", side=F.lit("left")).concat(right.map("event_id", side=F.lit("right"))).ordered()


@query(f"SELECT {_P.format('event_id DESC')}, event_id FROM events")
def reverse(s, d):
    return places(events(s, d).reverse(), "event_id")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT max(event_id) FROM events)")
def init(s, d):
    return events(s, d).init().map("event_id").ordered()


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT min(event_id) FROM events)")
def tail(s, d):
    return events(s, d).tail().map("event_id").ordered()


@query(f"SELECT {_P.format('side, k')}, k FROM (SELECT 0 AS side, o_orderkey AS k FROM orders UNION ALL SELECT 1, event_id FROM events)")
def concat(s, d):
    return places(orders(s, d).map(k=c("o_orderkey")).concat(events(s, d).map(k=c("event_id"))), "k")


@query("SELECT CAST(row_number() OVER (ORDER BY i, event_id) - 1 AS BIGINT) AS pos, x FROM (SELECT 1 AS i, event_id, user_id AS x FROM events UNION ALL SELECT 0, 0, -1 UNION ALL SELECT 2, 0, -2)")
def append_prepend(s, d):
    return places(events(s, d).map("x").append(F.lit(-2)).prepend(F.lit(-1)), "x")


@query(f"SELECT CAST(pos AS BIGINT) AS pos, CASE WHEN pos = 7 THEN -1 ELSE x END AS x FROM ({_EV})")
def updated(s, d):
    return places(events(s, d).map("x").updated(7, "x", F.lit(-1)), "x")


@query("SELECT CAST(range AS BIGINT) AS pos, coalesce(r_regionkey, -1) AS x FROM range(8) LEFT JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos FROM region) ON pos = range")
def pad_to(s, d):
    return places(SeqFrame.of(_read(s, d, "region").select(c("r_regionkey").alias("x")), "x").pad_to(8, F.lit(-1)), "x")


@query(f"SELECT CAST(row_number() OVER (ORDER BY i, p) - 1 AS BIGINT) AS pos, x FROM (SELECT CASE WHEN pos < 5 THEN 0 ELSE 2 END AS i, pos AS p, x FROM ({_EV}) WHERE pos < 5 OR pos >= 8 UNION ALL SELECT 1, n_nationkey, n_nationkey FROM nation)")
def patch(s, d):
    nation = SeqFrame.of(_read(s, d, "nation").select(c("n_nationkey").cast("bigint").alias("x")), "x")
    return places(events(s, d).map("x").patch(5, nation, 3), "x")


@query("SELECT event_id FROM events WHERE event_id < (SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE NOT value < 400)")
def take_while(s, d):
    return events(s, d).take_while(c("value") < 400).map("event_id").ordered()


@query("SELECT event_id FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE NOT value < 400)")
def drop_while(s, d):
    return events(s, d).drop_while(c("value") < 400).map("event_id").ordered()


@query("SELECT event_id, CASE WHEN event_id < (SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE NOT value < 300) THEN 0 ELSE 1 END AS side FROM events")
def span(s, d):
    a, b = events(s, d).span(c("value") < 300)
    return a.map("event_id", side=F.lit(0)).df.select("event_id", "side").union(b.map("event_id", side=F.lit(1)).df.select("event_id", "side"))


@query(f"SELECT event_id, CAST(pos AS INTEGER) AS index FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE value > 50)")
def zip_with_index(s, d):
    return events(s, d).filter(c("value") > 50).map("event_id").zip_with_index().df.select("event_id", "index")


@query(f"SELECT e.event_id, o.o_orderkey FROM ({_EV}) e JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) o USING (pos)")
def zip_(s, d):
    return events(s, d).map("event_id").zip(orders(s, d).map("o_orderkey")).df.select("event_id", "o_orderkey")


@query(f"SELECT CAST(pos AS BIGINT) AS pos, e.user_id + o.o_custkey AS total FROM ({_EV}) e JOIN (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) o USING (pos)")
def map2(s, d):
    return places(events(s, d).map("user_id").map2(orders(s, d).map("o_custkey"), total=c("user_id") + c("o_custkey")), "total")


@query("SELECT CAST(pos AS BIGINT) AS pos, event_id, o_orderkey, p_partkey FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) USING (pos) JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) USING (pos)")
def lazy_zip(s, d):
    parts = SeqFrame.of(_read(s, d, "part").select("p_partkey"), "p_partkey")
    return places(events(s, d).map("event_id").lazy_zip(orders(s, d).map("o_orderkey"), parts), "event_id", "o_orderkey", "p_partkey")


@query("SELECT 'a' AS side, o_orderkey AS k FROM orders UNION ALL SELECT 'b', o_custkey FROM orders")
def unzip(s, d):
    a, b = orders(s, d).unzip("o_orderkey", "o_custkey")
    return a.df.select(F.lit("a").alias("side"), c("o_orderkey").alias("k")).union(b.df.select(F.lit("b"), "o_custkey"))


@query("SELECT CAST(i - 1 AS BIGINT) AS pos, list(e ORDER BY vec_id) AS x FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i")
def transpose(s, d):
    q = SeqFrame.of(_read(s, d, "embeddings").select("vec_id", c("embedding").alias("x")), "vec_id").map("x")
    return places(q.transpose(), "x")


@query(f"SELECT CAST(pos // 7 AS BIGINT) AS pos, list(event_id ORDER BY pos) AS ids FROM ({_EV}) GROUP BY pos // 7")
def grouped(s, d):
    return places(events(s, d).grouped(7, "ids", "event_id"), "ids")


@query(f"SELECT CAST(w AS BIGINT) AS pos, list(event_id ORDER BY pos) AS ids FROM ({_EV}), LATERAL (SELECT unnest(range(CAST(greatest(0, pos - 3) AS BIGINT), CAST(pos + 1 AS BIGINT))) AS w) WHERE w <= (SELECT count(*) FROM events) - 4 GROUP BY w")
def sliding(s, d):
    return places(events(s, d).sliding(4, 1, "ids", "event_id"), "ids")


@query("SELECT CAST(5 - n AS BIGINT) AS pos, (SELECT coalesce(list(r_regionkey ORDER BY r_regionkey), []) FROM region WHERE r_regionkey < n) AS ks FROM (SELECT unnest(range(6)) AS n)")
def inits(s, d):
    return places(SeqFrame.of(_read(s, d, "region").select("r_regionkey"), "r_regionkey").inits("ks", "r_regionkey"), "ks")


@query("SELECT CAST(n AS BIGINT) AS pos, (SELECT coalesce(list(r_regionkey ORDER BY r_regionkey), []) FROM region WHERE r_regionkey >= n) AS ks FROM (SELECT unnest(range(6)) AS n)")
def tails(s, d):
    return places(SeqFrame.of(_read(s, d, "region").select("r_regionkey"), "r_regionkey").tails("ks", "r_regionkey"), "ks")


@query("SELECT CAST(row_number() OVER (ORDER BY a.r_regionkey, b.r_regionkey, z.r_regionkey) - 1 AS BIGINT) AS pos, [a.r_regionkey, b.r_regionkey, z.r_regionkey] AS ks FROM region a, region b, region z WHERE a.r_regionkey < b.r_regionkey AND b.r_regionkey < z.r_regionkey")
def combinations(s, d):
    return places(SeqFrame.of(_read(s, d, "region").select("r_regionkey"), "r_regionkey").combinations(3, "r_regionkey", "ks"), "ks")


@query("SELECT CAST(row_number() OVER (ORDER BY a.r_regionkey, b.r_regionkey, z.r_regionkey) - 1 AS BIGINT) AS pos, [a.r_regionkey, b.r_regionkey, z.r_regionkey] AS ks FROM region a, region b, region z WHERE a.r_regionkey < 3 AND b.r_regionkey < 3 AND z.r_regionkey < 3 AND a.r_regionkey <> b.r_regionkey AND b.r_regionkey <> z.r_regionkey AND a.r_regionkey <> z.r_regionkey")
def permutations(s, d):
    return places(SeqFrame.of(_read(s, d, "region").select("r_regionkey"), "r_regionkey").take_while(c("r_regionkey") < 3).permutations("r_regionkey", "ks"), "ks")


# -- searches -----------------------------------------------------------------------------------------------------------
@query("SELECT event_id, user_id FROM events WHERE value > 100 ORDER BY event_id LIMIT 1")
def find(s, d):
    return events(s, d).map("event_id", "user_id", "value").find(c("value") > 100).df.select("event_id", "user_id")


@query(f"SELECT coalesce(min(pos) FILTER (WHERE value > 100), -1) AS first, coalesce(max(pos) FILTER (WHERE value > 100), -1) AS last FROM ({_EV})")
def index_where(s, d):
    q = events(s, d)
    return q.index_where(c("value") > 100).df.select(c("value").alias("first"), q.last_index_where(c("value") > 100).df.scalar().alias("last"))


@query(f"SELECT coalesce(min(pos) FILTER (WHERE x = 42 AND pos >= 10), -1) AS first, coalesce(max(pos) FILTER (WHERE x = 42 AND pos <= 900), -1) AS last FROM ({_EV})")
def index_of(s, d):
    q = events(s, d)
    return q.index_of(F.lit(42), 10).df.select(c("value").alias("first"), q.last_index_of(F.lit(42), 900).df.scalar().alias("last"))


@query("SELECT bool_or(value > 100) AS some, bool_and(value >= 0) AS every, bool_or(user_id = 42) AS has, count(*) = 0 AS none, count(*) > 0 AS filled FROM events")
def exists_forall_contains(s, d):
    q = events(s, d)
    one = lambda r, n: r.df.scalar().alias(n)
    return s.range(1).select(one(q.exists(c("value") > 100), "some"), one(q.forall(c("value") >= 0), "every"), one(q.contains(F.lit(42)), "has"), one(q.is_empty(), "none"), one(q.non_empty(), "filled"))


@query(f"SELECT (SELECT event_id FROM events ORDER BY event_id LIMIT 1) AS head, (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1) AS last, (SELECT event_id FROM ({_EV}) WHERE pos = 17) AS at")
def head_last_apply(s, d):
    q = events(s, d).map("event_id")
    return s.range(1).select(q.head().df.scalar().alias("head"), q.last().df.scalar().alias("last"), q.apply(17).df.scalar().alias("at"))


@query("SELECT user_id * 10 AS y FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 1")
def collect_first(s, d):
    return events(s, d).collect_first(c("event_type") == "purchase", y=c("user_id") * 10).df


@query(f"SELECT coalesce(min(pos) FILTER (WHERE NOT value < 300) - 20, count(*)) AS n FROM ({_EV}) WHERE pos >= 20")
def segment_length(s, d):
    return events(s, d).segment_length(c("value") < 300, 20).df.select(c("value").alias("n"))


@query("SELECT true AS same, false AS shifted, true AS starts, true AS ends, true AS paired")
def corresponds(s, d):
    q = events(s, d).map("x")
    one = lambda r, n: r.df.scalar().alias(n)
    return s.range(1).select(one(q.same_elements(q), "same"), one(q.same_elements(q.drop(1)), "shifted"), one(q.starts_with(q.take(20)), "starts"), one(q.ends_with(q.take_right(20)), "ends"), one(q.corresponds(q.map(y=c("x") + 1), c("y") > c("x")), "paired"))


@query("WITH r AS (SELECT r_regionkey AS x, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos FROM region) SELECT CAST(min(a.pos) AS BIGINT) AS first, CAST(max(a.pos) AS BIGINT) AS last, count(*) > 0 AS has FROM r a JOIN r b ON b.pos = a.pos + 1 WHERE a.x = 2 AND b.x = 3")
def index_of_slice(s, d):
    q = SeqFrame.of(_read(s, d, "region").select(c("r_regionkey").alias("x")), "x")
    one = lambda r, n: r.df.scalar().alias(n)
    return s.range(1).select(one(q.index_of_slice([2, 3]), "first"), one(q.last_index_of_slice([2, 3]), "last"), one(q.contains_slice([2, 3]), "has"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE value > 50) AS some, CASE WHEN count(*) > 100 THEN 1 WHEN count(*) = 100 THEN 0 ELSE -1 END AS cmp, count(*) > 5 AS at5 FROM events")
def count_size(s, d):
    q = events(s, d)
    return s.range(1).select(q.count().df.scalar().alias("n"), q.count(c("value") > 50).df.scalar().alias("some"), q.length_compare(100).df.scalar().alias("cmp"), q.is_defined_at(5).df.scalar().alias("at5"))


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS index FROM region")
def indices(s, d):
    return SeqFrame.of(_read(s, d, "region").select("r_regionkey"), "r_regionkey").indices().ordered()


# -- folds and scans ------------------------------------------------------------------------------------------------------
@query("SELECT CAST(list_reduce(list_prepend(CAST(1 AS BIGINT), list(n_nationkey ORDER BY n_nationkey)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS l, CAST(list_reduce(list_prepend(CAST(1 AS BIGINT), list(n_nationkey ORDER BY n_nationkey DESC)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS r FROM nation")
def fold_left_right(s, d):
    q = SeqFrame.of(_read(s, d, "nation").select(c("n_nationkey").cast("bigint").alias("x")), "x")
    step = lambda a, x: (a * 31 + x) % 1000003
    return q.agg(l=A.fold(F.lit(1).cast("bigint"), step, c("x")), r=A.fold_right(F.lit(1).cast("bigint"), lambda x, a: step(a, x), c("x"))).df


@query("SELECT CAST(list_reduce(list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey), lambda a, x: a * 2 - x) AS BIGINT) AS l, CAST(list_reduce(list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey DESC), lambda a, x: x - a) AS BIGINT) AS r FROM nation")
def reduce(s, d):
    q = SeqFrame.of(_read(s, d, "nation").select(c("n_nationkey").cast("bigint").alias("x")), "x")
    return q.agg(l=A.reduce(lambda a, x: a * 2 - x, c("x"), required=True), r=A.reduce(lambda x, a: x - a, c("x"), right=True)).df


@query("SELECT CAST(sum(r_regionkey) AS BIGINT) AS total, product(r_regionkey + 1) AS product, min(r_regionkey) AS lo, max(r_regionkey) AS hi FROM region")
def sum_product_min_max(s, d):
    q = SeqFrame.of(_read(s, d, "region"), "r_regionkey")
    x = c("r_regionkey")
    return q.agg(total=A.sum(x), product=A.product(x + 1), lo=A.min1(x), hi=A.max1(x)).df


@query("SELECT (SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 1) AS lo, (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 1) AS hi")
def min_by_max_by(s, d):
    q = SeqFrame.of(_read(s, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return q.agg(lo=A.min_by(c("p_partkey"), c("p_size")), hi=A.max_by(c("p_partkey"), c("p_size"))).df


@query(f"SELECT CAST(pos + 1 AS BIGINT) AS pos, CAST(sum(x) OVER (ORDER BY pos) AS BIGINT) AS acc FROM ({_EV}) UNION ALL SELECT 0, 0")
def scan_left(s, d):
    q = events(s, d).scan_left(F.lit(0).cast("bigint"), F.sum, lambda a, b: a + b, c("x"))
    return places(q, "acc")


@query(f"SELECT CAST(pos AS BIGINT) AS pos, max(x) OVER (ORDER BY pos DESC) AS acc FROM ({_EV}) UNION ALL SELECT count(*), 0 FROM events")
def scan_right(s, d):
    q = events(s, d).scan_right(F.lit(0).cast("bigint"), F.max, lambda a, b: F.greatest(a, b), c("x"))
    return places(q, "acc")


@query("SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS plain, '[' || string_agg(n_name, ';' ORDER BY n_nationkey) || ']' AS framed FROM nation")
def mk_string(s, d):
    q = SeqFrame.of(_read(s, d, "nation"), "n_nationkey")
    return s.range(1).select(q.mk_string(c("n_name"), ",").df.scalar().alias("plain"), q.mk_string(c("n_name"), ";", "[", "]").df.scalar().alias("framed"))


# -- order, distinct, multisets ---------------------------------------------------------------------------------------------
@query(f"SELECT {_P.format('p_size, p_partkey')}, p_partkey FROM part")
def sort_by(s, d):
    return places(SeqFrame.of(_read(s, d, "part").select("p_partkey", "p_size"), "p_partkey").sort_by(c("p_size")), "p_partkey")


@query(f"SELECT {_P.format('o_custkey, o_orderkey')}, o_custkey AS x FROM orders")
def sorted_(s, d):
    return places(orders(s, d).map("x").sorted(), "x")


@query(f"SELECT {_P.format('n_regionkey DESC, n_nationkey')}, n_regionkey AS x FROM nation")
def sort_with(s, d):
    q = SeqFrame.of(_read(s, d, "nation").select("n_nationkey", c("n_regionkey").alias("x")), "n_nationkey").map("x")
    return places(q.sort_with(lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), "x")


@query("SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS BIGINT) AS pos, x FROM (SELECT user_id AS x, min(event_id) AS p FROM events GROUP BY user_id)")
def distinct(s, d):
    return places(events(s, d).map("x").distinct(), "x")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def distinct_by(s, d):
    docs = SeqFrame.of(_read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id")
    return docs.distinct_by(c("h")).map("doc_id").ordered()


@query("WITH a AS (SELECT event_id, user_id AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id AS x, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY user_id) SELECT event_id FROM a LEFT JOIN b USING (x) WHERE o > coalesce(n, 0)")
def multiset_diff(s, d):
    q = events(s, d).map("event_id", "x")
    return q.filter(c("event_id") % 2 == 0).diff(q.filter(c("event_id") % 3 == 0)).map("event_id").ordered()


@query("WITH a AS (SELECT event_id, user_id AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id AS x, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY user_id) SELECT event_id FROM a JOIN b USING (x) WHERE o <= n")
def multiset_intersect(s, d):
    q = events(s, d).map("event_id", "x")
    return q.filter(c("event_id") % 2 == 0).intersect(q.filter(c("event_id") % 3 == 0)).map("event_id").ordered()


@query(f"SELECT {_P.format('o_totalprice DESC, o_orderkey')}, o_orderkey FROM orders ORDER BY pos LIMIT 25")
def top_n_by(s, d):
    return places(orders(s, d).top_n_by(25, c("o_totalprice")), "o_orderkey")


@query(f"SELECT {_P.format('o_totalprice, o_orderkey')}, o_orderkey FROM orders ORDER BY pos LIMIT 25")
def bottom_n_by(s, d):
    return places(orders(s, d).bottom_n_by(25, c("o_totalprice")), "o_orderkey")


@query("SELECT o_orderpriority AS key, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3] AS best, list(o_orderkey ORDER BY o_totalprice, o_orderkey)[1:3] AS worst FROM orders GROUP BY 1")
def agg_top_n(s, d):
    return orders(s, d).group_reduce_by(c("o_orderpriority"), best=A.top_n_by(3, c("o_totalprice"), c("o_orderkey")), worst=A.bottom_n_by(3, c("o_totalprice"), c("o_orderkey")))


@query("SELECT o_orderstatus AS key, list(DISTINCT o_custkey ORDER BY o_custkey DESC)[1:1][1] AS most, min(o_custkey) AS least FROM orders GROUP BY 1")
def agg_largest_smallest(s, d):
    return orders(s, d).group_reduce_by(c("o_orderstatus"), most=A.largest(1, c("o_custkey")), least=A.smallest(1, c("o_custkey"))).select("key", F.element_at("most", 1).alias("most"), F.element_at("least", 1).alias("least"))


# -- grouping -----------------------------------------------------------------------------------------------------------------
@query("SELECT user_id AS key, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1")
def group_by(s, d):
    return events(s, d).group_by(c("user_id"), "ids", "event_id")


@query("SELECT o_orderstatus AS key, list(o_custkey + 1 ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def group_map(s, d):
    return orders(s, d).group_map(c("o_orderstatus"), c("o_custkey") + 1, "ids")


@query("SELECT l_returnflag AS key, count(*) AS count FROM lineitem GROUP BY 1")
def group_count(s, d):
    return SeqFrame(_read(s, d, "lineitem"), ("l_orderkey",)).group_count(c("l_returnflag"))


@query("SELECT l_partkey AS key, CAST(sum(l_linenumber) AS BIGINT) AS sum FROM lineitem GROUP BY 1")
def group_sum(s, d):
    return SeqFrame(_read(s, d, "lineitem"), ("l_orderkey",)).group_sum(c("l_partkey"), c("l_linenumber"))


@query("SELECT l_returnflag || l_linestatus AS key, count(*) AS n, max(l_extendedprice) AS peak, CAST(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1")
def group_reduce_by(s, d):
    q = SeqFrame(_read(s, d, "lineitem"), ("l_orderkey",))
    out = q.group_reduce_by(F.concat("l_returnflag", "l_linestatus"), n=A.count(), peak=A.max(c("l_extendedprice")), quantity=A.sum(c("l_quantity").cast("decimal(18,2)")))
    return out.withColumn("quantity", c("quantity").cast("double"))


@query("SELECT l_suppkey AS key, max(l_linenumber * 3) AS m FROM lineitem GROUP BY 1")
def group_map_reduce(s, d):
    return SeqFrame(_read(s, d, "lineitem"), ("l_orderkey",)).group_map_reduce(c("l_suppkey"), m=A.max(c("l_linenumber") * 3))


@query("SELECT user_id AS key, event_id AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def to_map(s, d):
    return events(s, d).to_map(c("user_id"), c("event_id"))


@query("SELECT DISTINCT event_type FROM events")
def to_set(s, d):
    return events(s, d).map("event_type").to_set()


@query("SELECT CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS lo, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS product")
def agg_empty(s, d):
    x = c("o_totalprice")
    return orders(s, d).filter(F.lit(False)).agg(total=A.sum(c("o_custkey")), n=A.count(), lo=A.min(x), mean=A.avg(x), product=A.product(x)).df


@query("SELECT count(*) AS n, max(o_custkey) AS peak FROM orders WHERE o_orderstatus = 'F'")
def agg_to(s, d):
    return orders(s, d).filter(c("o_orderstatus") == "F").agg_to("r", n=A.count(), peak=A.max(c("o_custkey"))).df.select("r.n", "r.peak")


@query("SELECT CAST(CAST(avg(o_custkey) * 1000 AS BIGINT) AS BIGINT) AS mean FROM orders")
def agg_avg(s, d):
    return orders(s, d).agg(mean=A.avg(c("o_custkey"))).df.select(F.round(c("mean") * 1000).cast("bigint").alias("mean"))


# -- adjacency ------------------------------------------------------------------------------------------------------------------
_RUNS = "SELECT *, sum(ch) OVER (ORDER BY event_id) - 1 AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS ch FROM events)"


@query(f"SELECT CAST(run AS BIGINT) AS pos, any_value(event_type) AS key, CAST(sum(user_id) AS BIGINT) AS acc FROM ({_RUNS}) GROUP BY run")
def fold_adjacent_by(s, d):
    q = events(s, d).fold_adjacent_by(c("event_type"), F.lit(0).cast("bigint"), lambda a, x: a + x, c("user_id"))
    return places(q, "key", "acc")


@query(f"SELECT CAST(run AS BIGINT) AS pos, any_value(event_type) AS key, list(event_id ORDER BY event_id) AS ids FROM ({_RUNS}) GROUP BY run")
def group_adjacent_by(s, d):
    return places(events(s, d).group_adjacent_by(c("event_type"), "ids", "event_id"), "key", "ids")


@query(f"SELECT CAST(run AS BIGINT) AS pos, any_value(event_type) AS key, count(*) FILTER (WHERE value > 50) AS n, max(value) FILTER (WHERE value > 50) AS peak FROM ({_RUNS}) GROUP BY run")
def group_adjacent_reduce_by(s, d):
    q = events(s, d).group_adjacent_reduce_by(c("event_type"), n=A.count().where(c("value") > 50), peak=A.max(c("value")).where(c("value") > 50))
    return places(q, "key", "n", "peak")


# -- sets -------------------------------------------------------------------------------------------------------------------------
def _sets(s: SparkSession, d: str) -> tuple[SetFrame, SetFrame]:
    o = _read(s, d, "orders")
    return SetFrame.of(o.where("o_orderstatus = 'F'"), "o_custkey"), SetFrame.of(o.where("o_orderstatus = 'O'"), "o_custkey")


_FS, _OS = "SELECT o_custkey AS x FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS x FROM orders WHERE o_orderstatus = 'O'"


@query(f"{_FS} UNION {_OS}")
def set_union(s, d):
    a, b = _sets(s, d)
    return (a | b).df


@query(f"{_FS} INTERSECT {_OS}")
def set_intersect(s, d):
    a, b = _sets(s, d)
    return (a & b).df


@query(f"{_FS} EXCEPT {_OS}")
def set_diff(s, d):
    a, b = _sets(s, d)
    return (a - b).df


@query(f"({_FS} EXCEPT {_OS}) UNION ({_OS} EXCEPT {_FS})")
def set_xor(s, d):
    a, b = _sets(s, d)
    return (a ^ b).df


@query(f"SELECT DISTINCT x FROM ({_FS}) WHERE NOT (x > 100 AND x < 900) AND (x BETWEEN 10 AND 1200)")
def set_predicates(s, d):
    a, _ = _sets(s, d)
    return (a & ~(SetFrame.above(100) & SetFrame.below(900)) & SetFrame.range(10, 1200)).df


@query("SELECT range AS x FROM range(5, 12) UNION SELECT range FROM range(101, 104)")
def set_ranges(s, d):
    return (SetFrame.until(5, 12) | SetFrame.range_open(100, 104)).df


@query(f"SELECT (SELECT count(*) FROM ({_FS} EXCEPT {_OS})) = 0 AS sub, true AS own, (SELECT count(DISTINCT x) FROM ({_FS})) AS n, (SELECT min(x) FROM ({_FS})) AS lo, (SELECT max(x) FROM ({_FS})) AS hi, (SELECT count(DISTINCT x) FROM ({_FS}) WHERE x > 50) AS big, (SELECT count(*) > 0 FROM ({_FS}) WHERE x = 7) AS has")
def set_terminals(s, d):
    a, b = _sets(s, d)
    one = lambda r, n: r.df.scalar().alias(n)
    return s.range(1).select(one(a.subset_of(b), "sub"), one((a & b).subset_of(a), "own"), one(a.size(), "n"), one(a.min(), "lo"), one(a.max(), "hi"), one(a.count(lambda x: x > 50), "big"), one(a.contains(7), "has"))


@query(f"SELECT DISTINCT unnest([x // 10, -(x // 10)]) AS x FROM (({_FS} WHERE true) EXCEPT SELECT 7)".replace(" WHERE true", "") + "")
def set_map_flat_map(s, d):
    a, _ = _sets(s, d)
    return a.excl(7).map(lambda x: F.floor(x / 10)).flat_map(lambda x: F.array(x, -x)).df


@query(f"SELECT DISTINCT x FROM ({_FS} UNION ALL SELECT -5) WHERE x % 2 <> 0 AND x <> 11")
def set_incl_excl_filter(s, d):
    a, _ = _sets(s, d)
    return a.incl(-5).excl(11).filter_not(lambda x: x % 2 == 0).df


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_membership(s, d):
    a, _ = _sets(s, d)
    return a.among(_read(s, d, "customer"), "c_custkey").select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN ({_FS})")
def set_complement(s, d):
    a, _ = _sets(s, d)
    return (SetFrame.of(_read(s, d, "customer"), "c_custkey") & ~a).df.select(c("x").alias("c_custkey"))


# -- records --------------------------------------------------------------------------------------------------------------------------
@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 30")
def json_projection(s, d):
    rows = SeqFrame.of(_read(s, d, "events").select("event_id", "props"), "event_id")
    parsed = rows.df.select("event_id", F.from_json("props", ndjson.schema_of("k INT")).alias("r"))
    return parsed.select("event_id", "r.k").where("k > 30")


@query("SELECT count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total FROM events")
def json_parse_agg(s, d):
    rows = SeqFrame.of(_read(s, d, "events").select("event_id", "props"), "event_id")
    return ndjson.parse(rows, "k INT", "props", "zero").agg(n=A.count(), total=A.sum(c("k"))).df


@query(f"SELECT {_P.format('n_nationkey')}, n_name AS line FROM nation")
def text_lines(s, d):
    to = folder(s)
    _read(s, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(to)
    return places(C.lines(s, to), "line")


@query("SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 50000")
def ndjson_files(s, d):
    to = folder(s)
    _read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.json(to)
    return ndjson.table(s, to, "o_custkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING").where("o_totalprice > 50000").select("o_custkey", "o_orderstatus")


# -- streams ------------------------------------------------------------------------------------------------------------
def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events of each user as a sequence of its own."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d).select("event_id", "user_id", "event_type")


@query("SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS acc FROM events")
def stream_scan(s, d):
    return stages.settle(stages.scan(_stream(s, d), "event_id", "event_id", 0, "sum", by=("user_id",)))


@query("WITH r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS ch FROM events)) SELECT any_value(event_type) AS key, CAST(sum(event_id) AS BIGINT) AS acc FROM r GROUP BY user_id, run QUALIFY run < max(run) OVER (PARTITION BY user_id)")
def stream_fold_adjacent(s, d):
    return stages.settle(stages.fold_adjacent(_stream(s, d), "event_id", "event_type", "event_id", 0, "sum", by=("user_id",)))


@query('SELECT list(event_id ORDER BY event_id) AS "group" FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS g FROM events) GROUP BY user_id, g HAVING count(*) = 3')
def stream_grouped(s, d):
    return stages.settle(stages.grouped(_stream(s, d), "event_id", "event_id", 3, by=("user_id",)))


@query('SELECT "window" FROM (SELECT list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) AS "window" FROM events) WHERE len("window") = 3')
def stream_sliding(s, d):
    return stages.settle(stages.sliding(_stream(s, d), "event_id", "event_id", 3, by=("user_id",)))


@query("SELECT event_id AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS index FROM events")
def stream_zip_with_index(s, d):
    return stages.settle(stages.zip_with_index(_stream(s, d), "event_id", "event_id", by=("user_id",)))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(s, d):
    return stages.settle(stages.distinct(_stream(s, d).select("user_id", "event_type"), "user_id", "event_type"))


# -- constructors -------------------------------------------------------------------------------------------------------------------------
@query("SELECT range AS pos, range * range AS x FROM range(50)")
def tabulate(s, d):
    return places(C.tabulate(s, 50, lambda i: i * i), "x")


@query("SELECT CAST((10 - range) // 3 AS BIGINT) AS pos, range AS x FROM range(10, -5, -3)")
def range_(s, d):
    return places(C.range_(s, 10, -5, -3), "x")


@query("SELECT range AS pos, 'a' AS x FROM range(5)")
def fill(s, d):
    return places(C.fill(s, 5, F.lit("a")), "x")


@query("WITH RECURSIVE r(pos, x) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT pos + 1, x * 3 + 1 FROM r WHERE pos < 19) SELECT pos, x FROM r")
def iterate(s, d):
    return places(C.iterate(s, "1", "x * 3 + 1", 20), "x")


@query("SELECT range AS pos, CAST(power(2, range) AS BIGINT) AS x FROM range(11)")
def unfold(s, d):
    return places(C.unfold(s, 1, lambda v: (v, 2 * v) if v <= 1024 else None), "x")


@query("SELECT range AS pos, range AS x FROM range(12)")
def unfold_chunk(s, d):
    return places(C.unfold_chunk(s, 0, lambda v: (list(range(v, v + 4)), v + 4) if v < 12 else None), "x")


@query("SELECT range AS pos, [7, 7, 9][range + 1] AS x FROM range(3)")
def literal(s, d):
    return places(C.of(s, 7, 7, 9), "x")


@query("SELECT CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS x WHERE false")
def empty(s, d):
    return places(C.empty(s), "x")


@query("SELECT range AS pos, 5 AS x FROM range(4)")
def repeat(s, d):
    return places(C.repeat(s, F.lit(5), 4), "x")


@query("SELECT range // 4 AS pos, range AS x FROM range(0, 20, 4)")
def source_range(s, d):
    return places(C.source_range(s, 0, 20, 4), "x")


@query("WITH RECURSIVE r(pos, acc) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT pos + 1, acc * 2 - pos FROM r WHERE pos < 25) SELECT pos, acc FROM r")
def scan_general(s, d):
    q = SeqFrame.of(_read(s, d, "nation").select(c("n_nationkey").cast("bigint").alias("x")), "x")
    return places(q.scan_general(F.lit(1).cast("bigint"), lambda a, x: a * 2 - x, c("x")), "acc")


@query(f"SELECT (SELECT count(*) FROM (({_FS} EXCEPT {_OS}) UNION ({_OS} EXCEPT {_FS}))) = 0 AS same, true AS own")
def set_same_elements(s, d):
    a, b = _sets(s, d)
    return s.range(1).select(a.same_elements(b).df.scalar().alias("same"), (a | b).same_elements(b | a).df.scalar().alias("own"))


@query("SELECT count(*) AS n FROM (SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region)")
def concat_constructor(s, d):
    q = SeqFrame.of(_read(s, d, "region").select("r_regionkey"), "r_regionkey")
    return C.concat(q, q).count().df.select(c("count").alias("n"))


# -- arrays in a row ------------------------------------------------------------------------------------------------------------------------
def _vectors(s: SparkSession, d: str) -> DataFrame:
    ints = F.transform("embedding", lambda e: F.floor(e * 100).cast("bigint"))
    return _read(s, d, "embeddings").select("vec_id", ints.alias("xs"))


_XS = "SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS FLOAT) * 100) AS BIGINT)) AS xs FROM embeddings"


@query(f"SELECT vec_id, list_transform(xs, lambda x: x * 2) AS twice, list_filter(xs, lambda x: x > 0) AS positive, CAST(list_sum(xs) AS BIGINT) AS total, len(list_filter(xs, lambda x: x > 10)) > 0 AS some FROM ({_XS})")
def array_map_filter_fold(s, d):
    xs = c("xs")
    return _vectors(s, d).select("vec_id", F.transform(xs, lambda x: x * 2).alias("twice"), F.filter(xs, lambda x: x > 0).alias("positive"), R.sum_(xs, F.lit(0).cast("bigint")).alias("total"), F.exists(xs, lambda x: x > 10).alias("some"))


@query(f"SELECT vec_id, xs[1:3] AS t, xs[4:] AS dr, xs[-3:] AS tr, xs[3:5] AS sl, list_reverse(xs) AS rev, list_concat(xs, [0, 0, 0]) AS padded FROM ({_XS})")
def array_structure(s, d):
    xs = c("xs")
    return _vectors(s, d).select("vec_id", R.take(xs, 3).alias("t"), R.drop(xs, 3).alias("dr"), R.take_right(xs, 3).alias("tr"), R.slice_(xs, 2, 5).alias("sl"), F.reverse(xs).alias("rev"), R.pad_to(xs, 67, F.lit(0).cast("bigint")).alias("padded"))


@query(f"SELECT vec_id, list_transform(range(0, (len(xs) + 4) // 5), lambda i: xs[5 * i + 1 : least(5 * i + 5, len(xs))]) AS groups, list_transform(range(0, (len(xs) - 8) // 2 + 1), lambda i: xs[2 * i + 1 : 2 * i + 8]) AS windows, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(xs) + 1), lambda i: CAST(list_sum(xs[1:i]) AS BIGINT))) AS sums FROM ({_XS})")
def array_windows_scan(s, d):
    xs = c("xs")
    return _vectors(s, d).select("vec_id", R.grouped(xs, 5).alias("groups"), R.sliding(xs, 8, 2).alias("windows"), R.scan_left(xs, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sums"))


@query(f"SELECT vec_id, CAST(coalesce(list_position(list_transform(xs, lambda x: x > 10), true), 0) - 1 AS INTEGER) AS at, list_sort(xs) AS ordered FROM ({_XS})")
def array_search_sort(s, d):
    xs = c("xs")
    return _vectors(s, d).select("vec_id", R.index_where(xs, lambda x: x > 10).alias("at"), R.sort_by(xs, lambda x: x).alias("ordered"))


@query(f"SELECT vec_id, list_transform(range(1, len(xs) - 3), lambda i: xs[i] * 1000 + xs[i + 4]) AS pairs, list_concat(xs[1:2], [CAST(0 AS BIGINT)], xs[5:]) AS patched, list_concat(xs[1:3], [CAST(7 AS BIGINT)], xs[5:]) AS updated FROM ({_XS})")
def array_zip_patch(s, d):
    xs = c("xs")
    zero = F.array(F.lit(0).cast("bigint"))
    return _vectors(s, d).select("vec_id", F.transform(R.zip_(xs, R.drop(xs, 4)), lambda p: p["_1"] * 1000 + p["_2"]).alias("pairs"), R.patch(xs, 2, zero, 2).alias("patched"), R.updated(xs, 3, F.lit(7).cast("bigint")).alias("updated"))


@query(f"SELECT vec_id, list_filter(xs, lambda x, i: i < coalesce(list_position(list_transform(xs, lambda x: x > 5), true), len(xs) + 1)) AS lead, list_filter(xs, lambda x, i: i >= coalesce(list_position(list_transform(xs, lambda x: x > 5), true), len(xs) + 1)) AS rest FROM ({_XS})")
def array_take_drop_while(s, d):
    xs = c("xs")
    return _vectors(s, d).select("vec_id", R.take_while(xs, lambda x: x <= 5).alias("lead"), R.drop_while(xs, lambda x: x <= 5).alias("rest"))


@query("SELECT o_orderkey, [3, 1] AS kept FROM orders")
def array_diff(s, d):
    some = F.array(*[F.lit(v) for v in (2, 3, 2, 1)])
    return _read(s, d, "orders").select("o_orderkey", R.diff(some, F.array(F.lit(2), F.lit(2), F.lit(9))).alias("kept"))


# -- orders of any type -----------------------------------------------------------------------------------------------------------------------
_ODD = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"


def _odd(s: SparkSession, d: str) -> SeqFrame:
    """Events whose x is a double with nulls and NaN."""
    return SeqFrame.of(_read(s, d, "events").select("event_id", F.expr(_ODD).alias("x")), "event_id")


@query("SELECT CAST(row_number() OVER (ORDER BY i, x, k) - 1 AS BIGINT) AS pos, x FROM (SELECT 0 AS i, o_totalprice AS x, o_orderkey AS k FROM orders UNION ALL SELECT 1, 9.5, 0)")
def sorted_append(s, d):
    return places(orders(s, d).map(x=c("o_totalprice")).sorted().append(F.lit(9.5)), "x")


@query("WITH a AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p FROM orders) SELECT CAST(row_number() OVER (ORDER BY i, p) - 1 AS BIGINT) AS pos, x FROM (SELECT CASE WHEN p < 5 THEN 0 ELSE 2 END AS i, p, o_totalprice AS x FROM a WHERE p < 5 OR p >= 8 UNION ALL SELECT 1, n_nationkey, CAST(n_nationkey AS DOUBLE) FROM nation)")
def sorted_patch(s, d):
    nation = SeqFrame.of(_read(s, d, "nation").select("n_nationkey", c("n_nationkey").cast("double").alias("x")), "n_nationkey").map("x")
    return places(orders(s, d).map(x=c("o_totalprice")).sorted().patch(5, nation, 3), "x")


@query("SELECT CAST(row_number() OVER (ORDER BY i, x, k) - 1 AS BIGINT) AS pos, x FROM (SELECT 1 AS i, n_name AS x, n_nationkey AS k FROM nation UNION ALL SELECT 2, r_name, r_regionkey FROM region UNION ALL SELECT 0, 'first', 0)")
def sorted_concat_text(s, d):
    one = SeqFrame.of(_read(s, d, "nation").select("n_nationkey", c("n_name").alias("x")), "n_nationkey").map("x").sorted()
    two = SeqFrame.of(_read(s, d, "region").select("r_regionkey", c("r_name").alias("x")), "r_regionkey").map("x").sorted()
    return places(one.concat(two).prepend(F.lit("first")), "x")


@query(f"SELECT CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, event_id DESC) - 1 AS BIGINT) AS pos, event_id FROM (SELECT event_id, {_ODD} AS x FROM events)")
def reverse_nulls(s, d):
    return places(_odd(s, d).sorted().map("event_id").reverse(), "event_id")


@query("SELECT CAST(row_number() OVER (ORDER BY n_name DESC) - 1 AS BIGINT) AS pos, n_nationkey FROM nation")
def reverse_text(s, d):
    return places(SeqFrame.of(_read(s, d, "nation"), "n_nationkey").sort_by(c("n_name")).map("n_nationkey").reverse(), "n_nationkey")


@query("SELECT CAST(row_number() OVER (ORDER BY event_type DESC, event_id) - 1 AS BIGINT) AS pos, event_id FROM events ORDER BY pos LIMIT 40")
def top_n_string(s, d):
    return places(events(s, d).top_n_by(40, c("event_type")), "event_id")


@query(f"SELECT CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, event_id) - 1 AS BIGINT) AS pos, event_id FROM (SELECT event_id, {_ODD} AS x FROM events) ORDER BY pos LIMIT 200")
def top_n_nan(s, d):
    return places(_odd(s, d).top_n(200), "event_id")


@query(f"SELECT CAST(row_number() OVER (ORDER BY x NULLS FIRST, event_id) - 1 AS BIGINT) AS pos, event_id FROM (SELECT event_id, {_ODD} AS x FROM events) ORDER BY pos LIMIT 200")
def bottom_n_nan(s, d):
    return places(_odd(s, d).bottom_n(200), "event_id")


@query("SELECT event_type AS key, max(CAST(ts AS DATE)) AS day, arg_max(event_id, (ts, -event_id)) AS latest, list(event_id ORDER BY ts DESC, event_id)[1:3] AS last3 FROM events GROUP BY 1")
def max_by_time(s, d):
    q = SeqFrame.of(_read(s, d, "events").select("event_id", "event_type", "ts"), "event_id")
    out = q.group_reduce_by(c("event_type"), day=A.max(F.to_date("ts")), latest=A.max_by(c("event_id"), c("ts")), last3=A.top_n_by(3, c("ts"), c("event_id")))
    return out.select("key", "day", "latest", "last3")


@query("SELECT (SELECT n_nationkey FROM nation ORDER BY n_regionkey DESC, n_name LIMIT 1) AS hi, (SELECT n_nationkey FROM nation ORDER BY n_regionkey, n_name LIMIT 1) AS lo")
def max_by_text_order(s, d):
    """The order itself is a text, which can't be turned: ties go to the first name."""
    q = SeqFrame.of(_read(s, d, "nation").select("n_nationkey", "n_regionkey", "n_name"), "n_name")
    return q.agg(hi=A.max_by(c("n_nationkey"), c("n_regionkey"), required=True), lo=A.min_by(c("n_nationkey"), c("n_regionkey"), required=True)).df


@query("SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_name, n_nationkey) - 1 AS BIGINT) AS pos, n_nationkey FROM nation")
def sort_by_twice(s, d):
    return places(SeqFrame.of(_read(s, d, "nation"), "n_nationkey").sort_by(c("n_name")).sort_by(c("n_regionkey")), "n_nationkey")


# -- sets with null ---------------------------------------------------------------------------------------------------------------------------
_FIVE, _NULLED = "SELECT DISTINCT o_custkey % 5 AS x FROM orders", "SELECT DISTINCT nullif(o_custkey % 3, 0) AS x FROM orders"


@query(f"WITH a AS ({_FIVE} UNION SELECT NULL), b AS ({_NULLED}) SELECT 'minus' AS side, x FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'not', x FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'and', x FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'or', x FROM a WHERE x > 2 OR x IN (SELECT x FROM b WHERE x IS NOT NULL) OR (x IS NULL AND EXISTS (FROM b WHERE x IS NULL)) UNION ALL SELECT 'xor', x FROM a WHERE coalesce(x > 1, false) <> EXISTS (FROM b WHERE b.x IS NOT DISTINCT FROM a.x)")
def set_null_algebra(s, d):
    o = _read(s, d, "orders")
    a = SetFrame.of(o.select((c("o_custkey") % 5).alias("x"))).incl(None)
    b = SetFrame.of(o.select(F.nullif(c("o_custkey") % 3, F.lit(0)).alias("x")))
    parts = {"minus": a - b, "not": a & ~b, "and": a & b, "or": a & (SetFrame.above(2) | b), "xor": a & (SetFrame.above(1) ^ b)}
    out = None
    for side, found in parts.items():
        rows = found.df.select(F.lit(side).alias("side"), "x")
        out = rows if out is None else out.union(rows)
    return out


@query(f"SELECT (SELECT count(*) FROM ({_FS} UNION {_OS})) AS n, true AS known, false AS open, true AS some, (SELECT min(x) >= 0 FROM ({_FS})) AS every")
def set_finite(s, d):
    a, b = _sets(s, d)
    one = lambda r, n: r.df.scalar().alias(n)
    kinds = ((a | b).finite() is not None, (a | ~b).finite() is not None)
    return s.range(1).select(one((a | b).materialize().size(), "n"), F.lit(kinds[0]).alias("known"), F.lit(kinds[1]).alias("open"), one(a.exists(lambda x: x > 1), "some"), one(a.forall(lambda x: x >= 0), "every"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_regionkey) - 1 AS BIGINT) AS pos, n_regionkey AS x FROM (SELECT DISTINCT n_regionkey FROM nation)")
def set_to_list(s, d):
    a = SetFrame.of(_read(s, d, "nation"), "n_regionkey")
    assert a.to_list() == list(a.iterator())
    return places(C.from_iterable(s, a.to_list()), "x")


# -- what ends in the program -------------------------------------------------------------------------------------------------------------------
def _nations(s: SparkSession, d: str) -> SeqFrame:
    return C.from_frame(_read(s, d, "nation").select(c("n_nationkey").cast("bigint").alias("x"), "n_name"), "x")


@query("SELECT CAST(x AS BIGINT) AS pos, x FROM (SELECT CAST(n_nationkey AS BIGINT) AS x FROM nation)")
def from_frame(s, d):
    return places(_nations(s, d), "x")


@query("SELECT CAST(n_nationkey AS BIGINT) AS pos, CAST(n_nationkey AS BIGINT) AS x FROM nation")
def iterator(s, d):
    return places(C.from_iterable(s, list(_nations(s, d).map("x").iterator())), "x")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS BIGINT) AS pos, CAST(n_nationkey AS BIGINT) AS x FROM nation")
def to_list(s, d):
    q, half = _nations(s, d).map("x").reverse(), [None] * 3
    got = q.to_list()
    assert q.copy_to_array(half) == 3 and half == got[:3] and q.to(tuple) == tuple(got)
    return places(C.from_iterable(s, got), "x")


@query("SELECT CAST(n_nationkey AS BIGINT) AS pos, CAST(n_nationkey AS BIGINT) AS x FROM nation WHERE n_nationkey <= 7")
def foreach_while(s, d):
    seen: list[int] = []
    _nations(s, d).map("x").foreach_while(lambda x: seen.append(x) or x < 7)
    return places(C.from_iterable(s, seen), "x")


@query("SELECT count(*) AS called, count(*) FILTER (WHERE value > 50) AS some FROM events")
def agg_foreach(s, d):
    q = events(s, d)
    return q.agg(called=A.foreach(lambda v: None, c("x")), some=A.foreach(lambda v: None, c("x")).where(c("value") > 50)).df


@query("SELECT count(*) AS n, max(user_id) AS peak FROM events WHERE value > 50")
def tap_each_metric(s, d):
    from pyspark.sql import Observation

    seen = Observation("seen")
    events(s, d).filter(c("value") > 50).tap_each(seen, F.count(F.lit(1)).alias("n"), F.max("x").alias("peak")).map("x").df.write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(seen.get["n"], seen.get["peak"])], "n bigint, peak bigint")


@query("SELECT CAST(list_reduce(list_prepend(CAST(1 AS BIGINT), list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda a, x: (a * 7 + x) % 10007) AS BIGINT) AS value FROM nation")
def fold(s, d):
    return _nations(s, d).fold(F.lit(1).cast("bigint"), lambda a, x: (a * 7 + x) % 10007, c("x")).df


@query("SELECT unnest(['l_extendedprice', 'l_orderkey', 'l_quantity']) AS live, unnest([true, false, true]) AS summed")
def plan_agg(s, d):
    q = SeqFrame(_read(s, d, "lineitem"), ("l_orderkey", "l_linenumber")).filter(c("l_quantity") > 20)
    live = set(q.plan_agg(total=A.sum(c("l_extendedprice")))["live"])
    return s.createDataFrame([(n, n in live) for n in ("l_extendedprice", "l_orderkey", "l_quantity")], "live string, summed boolean")


# -- what is pulled ---------------------------------------------------------------------------------------------------------------------------
@query("SELECT range AS pos, range * 3 AS x FROM range(7)")
def pull_take(s, d):
    """The first of an unbounded iterator, after a filter; nothing beyond the limit's batch is pulled."""
    import itertools

    return C.from_iterator(s, itertools.count).filter(c("x") % 3 == 0).take(7).df.select((c("x") / 3).cast("bigint").alias("pos"), "x")


@query("SELECT range AS pos, 'line ' || range AS x FROM range(4)")
def from_reader(s, d):
    import io

    return places(C.from_reader(s, lambda: io.StringIO("\n".join(f"line {i}" for i in range(4)))), "x")


@query("SELECT range AS pos, ['a', '', 'ü'][range + 1] AS x FROM range(3)")
def lines_of(s, d):
    import io

    return places(C.lines_of(s, lambda: io.BytesIO("a\r\n\nü".encode())), "x")


@query("SELECT CAST(0 AS BIGINT) AS pos, CAST(2 AS BIGINT) AS id, 'b' AS name UNION ALL SELECT 1, 3, 'c'")
def ndjson_range(s, d):
    lines = [f'{{"id": {i}, "name": "{n}"}}\n' for i, n in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))]
    return places(ndjson.in_memory(s, "".join(lines), "id BIGINT, name STRING", start=len(lines[0]), until=len("".join(lines[:3]))), "id", "name")


# -- streams of records, prefixes and ends ------------------------------------------------------------------------------------------------------
@query("SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 50000")
def ndjson_stream(s, d):
    to = folder(s)
    _read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.json(to)
    q = ndjson.fuse(s, to, "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING", "o_orderkey")
    return q.filter(c("o_totalprice") > 50000).run().select("o_custkey", "o_orderstatus")


def _users(s: SparkSession, d: str) -> StreamFrame:
    return StreamFrame(_stream(s, d), "event_id", ("user_id",))


@query("SELECT event_id AS value FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 5")
def stream_take(s, d):
    return stages.settle(_users(s, d).take(5, "event_id"))


@query("SELECT event_id AS value FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 5")
def stream_drop(s, d):
    return stages.settle(_users(s, d).drop(5, "event_id"))


@query("SELECT event_id AS value FROM (SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS over FROM events) WHERE over = 0")
def stream_take_while(s, d):
    return stages.settle(_users(s, d).take_while(c("event_type") != "purchase", "event_id"))


@query("SELECT event_id AS value FROM (SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS over FROM events) WHERE over = 1")
def stream_drop_while(s, d):
    return stages.settle(_users(s, d).drop_while(c("event_type") != "purchase", "event_id"))


def _ending(s: SparkSession, d: str) -> StreamFrame:
    """The events of each user, in two batches, with a row at the end."""
    to, e = folder(s), _read(s, d, "events").select("event_id", "user_id", "event_type")
    e.withColumn("fin", F.lit(False)).write.parquet(f"{to}/1")
    e.groupBy("user_id").agg((F.max("event_id") + 1).alias("event_id")).select("event_id", "user_id", F.lit("").alias("event_type"), F.lit(True).alias("fin")).write.parquet(f"{to}/2")
    schema = "event_id bigint, user_id bigint, event_type string, fin boolean"
    files = s.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    return StreamFrame(files.parquet(to), "event_id", ("user_id",), "fin")


@query('SELECT list(event_id ORDER BY event_id) AS "group" FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS g FROM events) GROUP BY user_id, g')
def stream_grouped_end(s, d):
    return stages.settle(_ending(s, d).grouped(3, "event_id"))


@query("WITH r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS ch FROM events)) SELECT any_value(event_type) AS key, max(event_id) AS acc FROM r GROUP BY user_id, run")
def stream_fold_adjacent_end(s, d):
    return stages.settle(_ending(s, d).fold_adjacent_by(c("event_type"), 0, "max", "event_id"))


@query("SELECT event_id AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2")
def stream_take_right(s, d):
    return stages.settle(_ending(s, d).take_right(2, "event_id"))


@query("SELECT event_type AS key, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1")
def stream_group_reduce(s, d):
    import uuid

    q = _users(s, d).group_reduce(c("event_type"), n=F.count("*"), total=F.sum("user_id"))
    return stages.drain(q, f"reduced_{uuid.uuid4().hex}", "complete")


@query("SELECT event_id, user_id * 2 AS twice FROM events WHERE event_type = 'click'")
def stream_map_filter(s, d):
    return _users(s, d).collect(c("event_type") == "click", twice=c("user_id") * 2).run().select("event_id", "twice")

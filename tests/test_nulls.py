"""Null keys, null values and integers beyond 2^53 in every form of the aggregates."""

import pytest
from pyspark.sql import functions as F

from tidemark import streaming as W
from tidemark.operators import collection as C, trace as T
from tidemark.plans.streams import replayed

SCHEMA = "key bigint, value bigint, multiplicity bigint, version int"
BIG = 2**53 + 1


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, 5, 1, 0), (None, 3, 1, 0), (None, 3, -1, 1), (None, None, 1, 1), (BIG, BIG, 1, 0), (BIG, None, 1, 0), (BIG, BIG + 1, 1, 2), (BIG, BIG, -1, 2), (1, 7, 2, 1), (1, 7, -2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


MIN = [(None, 3, 1, 0), (None, 3, -1, 1), (None, 5, 1, 1), (BIG, BIG, 1, 0), (BIG, BIG, -1, 2), (BIG, BIG + 1, 1, 2), (1, 7, 1, 1), (1, 7, -1, 3)]
MAX = [(None, 5, 1, 0), (BIG, BIG, 1, 0), (BIG, BIG, -1, 2), (BIG, BIG + 1, 1, 2), (1, 7, 1, 1), (1, 7, -1, 3)]


def first():
    return lambda r: [(v, m) for v, m in r[:1]]  # made here: workers cannot import test modules


FIRST = [(None, 3, 1, 0), (None, 3, -1, 1), (None, None, 1, 1), (BIG, None, 1, 0), (1, 7, 2, 1), (1, 7, -2, 3)]


def test_traces(odd):
    assert rows(T.min_trace(odd, ["key"], "value")) == sorted(MIN, key=repr)
    assert rows(T.max_trace(odd, ["key"], "value")) == sorted(MAX, key=repr)
    assert rows(T.reduce_trace(odd, ["key"], ["value"], first(), "value bigint")) == sorted(FIRST, key=repr)


def test_collection(odd):
    now = odd.drop("version")
    assert rows(C.reduce_groups(now, ["key"], ["value"], first(), "value bigint")) == sorted([(None, None, 1), (BIG, None, 1)], key=repr)
    total = lambda r: [((sum(v[0] or 0 for v, m in r for _ in range(m)), len(r)), 1)]
    assert rows(C.reduce_groups(now, ["key"], ["value"], total, "total bigint, kinds bigint")) == sorted([(None, 5, 2, 1), (BIG, BIG + 1, 2, 1)], key=repr)


def test_structs_and_nan(spark):
    df = spark.createDataFrame([("k", (1, None), 1, 0), ("k", (1, 0.5), 1, 0), ("k", (1, float("nan")), 1, 1), ("k", (1, float("nan")), -1, 2)],
                               "key string, value struct<a:int,b:double>, multiplicity bigint, version int")
    biggest = T.max_trace(df, ["key"], "value")
    got = sorted((r.version, r.multiplicity, str(r["max"].b)) for r in biggest.collect())
    assert got == [(0, 1, "0.5"), (1, -1, "0.5"), (1, 1, "nan"), (2, -1, "nan"), (2, 1, "0.5")]


@pytest.mark.parametrize("name", ["min", "max", "count", "sum", "distinct"])
def test_streams_equal_batch(odd, name):
    stream = replayed(odd, f"n-{name}")
    got = rows(W.run_to_end(getattr(W, f"stream_{name}")(stream, "key", "value"), f"n-{name}"))
    batch = {"min": lambda: T.min_trace(odd, ["key"], "value"), "max": lambda: T.max_trace(odd, ["key"], "value"), "count": lambda: T.count_trace(odd, ["key"]),
             "sum": lambda: T.sum_trace(odd, ["key"], "value"), "distinct": lambda: T.distinct_trace(odd, ["key", "value"])}[name]()
    assert got == rows(batch)


def test_stream_join_matches_null_keys(odd):
    a, b = replayed(odd, "n-a"), replayed(odd, "n-b")
    got = W.run_to_end(W.stream_join(a, b, ["key"]), "n-join").where("multiplicity <> 0")
    want = T.join_trace(odd, odd, ["key"])
    assert rows(C.consolidate(got.select("key", "value", "value_right", "version", "multiplicity"))) == rows(C.consolidate(want.select("key", "value", "value_right", "version", "multiplicity")))
    assert got.where(F.col("key").isNull()).count() > 0

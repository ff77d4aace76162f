"""Traces: small goldens in total, lexicographic and product order, and the defining law.

The law: the snapshot of an operator's changes is the operator on the snapshot.
"""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import versions as V
from tidemark.operators import collection as C, trace as T

SCHEMA = "key string, value bigint, multiplicity bigint, version int"
PRODUCT = "key string, value bigint, multiplicity bigint, v0 int, v1 int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def churn(spark):
    r = random.Random(3)
    live, out = [], []
    for version in range(8):
        for _ in range(12):
            if live and r.random() < 0.4:
                k, v = live.pop(r.randrange(len(live)))
                out.append((k, v, -1, version))
            else:
                k, v = r.choice("abc"), r.randrange(6)
                live.append((k, v))
                out.append((k, v, 1, version))
    return spark.createDataFrame(out, SCHEMA).cache()


PAIRS = {
    "count": (lambda tr: T.count_trace(tr, ["key"]), lambda c: C.count(c, ["key"])),
    "sum": (lambda tr: T.sum_trace(tr, ["key"], "value"), lambda c: C.sum_values(c, ["key"], "value")),
    "min": (lambda tr: T.min_trace(tr, ["key"], "value"), lambda c: C.min_value(c, ["key"], "value")),
    "max": (lambda tr: T.max_trace(tr, ["key"], "value"), lambda c: C.max_value(c, ["key"], "value")),
    "distinct": (lambda tr: T.distinct_trace(tr, ["key", "value"]), lambda c: C.distinct(c, ["key", "value"])),
    "reduce": (lambda tr: T.reduce_trace(tr, ["key"], ["value"], lambda r: [(v, m) for v, m in r[:2]], "value bigint"),
               lambda c: C.reduce_groups(c, ["key"], ["value"], lambda r: [(v, m) for v, m in r[:2]], "value bigint")),
}


@pytest.mark.parametrize("name", PAIRS)
def test_snapshot_law(churn, name):
    on_trace, on_collection = PAIRS[name]
    changes = on_trace(churn).cache()
    for v in (0, 3, 7):
        # count and sum keep rows of vanished keys, so they see the unconsolidated prefix
        prefix = churn.where(F.col("version") <= v).drop("version")
        assert rows(T.snapshot_at(changes, {"version": v})) == rows(on_collection(prefix))


def test_join_law(churn):
    joined = T.join_trace(churn, churn, ["key"])
    for v in (2, 6):
        s = T.snapshot_at(churn, {"version": v})
        assert rows(T.snapshot_at(joined, {"version": v})) == rows(C.consolidate(C.join(s, s, ["key"])))


def test_compact_keeps_later_snapshots(churn):
    folded = T.compact(churn, [(4,)])
    assert folded.where("version < 4").isEmpty()
    for v in (4, 7):
        assert rows(T.snapshot_at(folded, {"version": v})) == rows(T.snapshot_at(churn, {"version": v}))


def test_snapshots_agree(churn):
    spans = T.snapshots(churn).cache()
    at = spans.where("valid_from <= 5 and (valid_to is null or valid_to > 5)").select("key", "value", "multiplicity")
    assert rows(at) == rows(T.snapshot_at(churn, {"version": 5}))


def test_vanished_keys(spark):
    tr = spark.createDataFrame([("k", 1, 2, 0), ("k", 1, -2, 1), ("k", 9, 1, 2)], SCHEMA)
    assert rows(T.count_trace(tr, ["key"])) == [("k", 0, -1, 2), ("k", 0, 1, 1), ("k", 1, 1, 2), ("k", 2, -1, 1), ("k", 2, 1, 0)]
    assert rows(T.min_trace(tr, ["key"], "value")) == [("k", 1, -1, 1), ("k", 1, 1, 0), ("k", 9, 1, 2)]
    assert rows(T.distinct_trace(tr, ["key", "value"])) == [("k", 1, -1, 1), ("k", 1, 1, 0), ("k", 9, 1, 2)]


def test_join_count_over_ten_versions(spark):
    from tidemark.plans.jobs import join_count
    a = spark.createDataFrame([(k, i, 2, i) for i in range(10) for k in "12"], SCHEMA)
    b = spark.createDataFrame([(k, i + 2, 2, i) for i in range(10) for k in "12"], SCHEMA)
    got = [r for r in rows(join_count(a, b)) if r[0] == "1" and r[2] > 0]
    assert sorted(r[1] for r in got) == [4 * (i + 1) ** 2 for i in range(10)]


def test_product_order(spark):
    tr = spark.createDataFrame([("k", 5, 1, 0, 1), ("k", 3, 1, 1, 0), ("k", 3, -1, 2, 2)], PRODUCT)
    assert rows(T.count_product(tr, ["key"])) == [
        ("k", 1, -2, 1, 1), ("k", 1, 1, 0, 1), ("k", 1, 1, 1, 0), ("k", 1, 1, 2, 2), ("k", 2, -1, 2, 2), ("k", 2, 1, 1, 1)]
    assert rows(T.min_product(tr, ["key"], "value")) == [("k", 3, -1, 2, 2), ("k", 3, 1, 1, 0), ("k", 5, -1, 1, 1), ("k", 5, 1, 0, 1), ("k", 5, 1, 2, 2)]
    assert rows(T.distinct_product(tr, ["key", "value"])) == [("k", 3, -1, 2, 2), ("k", 3, 1, 1, 0), ("k", 5, 1, 0, 1)]


def test_join_count_in_product_order(spark):
    a = spark.createDataFrame([("1", i, 2, 0, i) for i in range(2)], PRODUCT)
    b = spark.createDataFrame([("1", i, 2, i, 0) for i in range(2)], PRODUCT)
    joined = T.join_trace(a, b, ["key"], ["v0", "v1"])
    assert rows(T.count_product(joined, ["key"])) == [
        ("1", 16, 1, 1, 1), ("1", 4, -1, 0, 1), ("1", 4, -1, 1, 0), ("1", 4, 1, 0, 0), ("1", 4, 1, 1, 1), ("1", 8, -2, 1, 1), ("1", 8, 1, 0, 1), ("1", 8, 1, 1, 0)]


def test_version_order(spark):
    one = spark.range(1)

    def true(c):
        return one.select(c).first()[0]

    assert true(V.version_lt([0, 0], [1, 0])) and true(V.version_leq([1, 0], [1, 0])) and not true(V.version_lt([1, 0], [1, 0]))
    assert not true(V.version_leq([1, 0], [0, 1])) and not true(V.version_leq([0, 1], [1, 0]))
    f = lambda *v: spark.createDataFrame(list(v), "v0 int, v1 int")
    assert V.frontier_lt(f((0, 0)), f((1, 0)), ["v0", "v1"]) and V.frontier_lt(f((2, 0), (1, 1)), f((2, 0)), ["v0", "v1"])
    assert not V.frontier_equal(f((0, 0)), f((1, 0)), ["v0", "v1"])
    assert rows(V.minimal_versions(f((2, 0), (1, 1), (2, 2), (1, 1)), ["v0", "v1"])) == [(1, 1), (2, 0)]
    three = spark.createDataFrame([(1, 0, 0), (0, 1, 0), (1, 1, 1)], "a int, b int, c int")
    assert rows(V.minimal_versions(three, ["a", "b", "c"])) == [(0, 1, 0), (1, 0, 0)]


def test_join_count_in_total_order_needs_no_join(spark):
    """Running counts of both sides give what the join's count gives, with nulls, zeros and keys of one side only."""
    from tidemark.plans.jobs import join_count
    r = random.Random(3)
    a, b = (spark.createDataFrame([(r.choice([1, 2, 3, None]), r.choice([1, 1, 2, -1]), r.randrange(6)) for _ in range(30)] + [(10 + i, 1, 0), (20, 1, 2), (20, -1, 2)],
                                  "key bigint, multiplicity bigint, version int") for i in (0, 1))
    got, want = join_count(a, b), T.count_trace(T.join_trace(a, b, ["key"]), ["key"])
    in_order = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    assert in_order(got) == in_order(want)
    assert in_order(join_count(a, b, null_keys=False)) == in_order(want.where("key is not null"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()

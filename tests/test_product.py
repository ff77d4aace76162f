"""Product order in any number of coordinates against recomputation at every place of the grid."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import product as P, trace as T

COORDS = ["v0", "v1", "v2"]
SCHEMA = "key string, value bigint, multiplicity bigint, v0 int, v1 int, v2 int"


def made():
    r = random.Random(8)
    out = []
    for _ in range(60):
        k, v, at = r.choice(["a", "b", None]), r.choice([1, 2, 3, None]), [r.randrange(3) for _ in COORDS]
        out.append((k, v, 1, *at))
        if r.random() < 0.5:
            out.append((k, v, -1, *(x + r.randrange(2) for x in at)))
    return out


def plain(rows, answer):
    """Changes by inclusion and exclusion over the whole grid of 5 places along each axis."""
    def at(k, spot):
        seen = [r for r in rows if r[0] == k and all(x <= s for x, s in zip(r[3:], spot))]
        net = {}
        for _, v, m, *_ in seen:
            net[v] = net.get(v, 0) + m
        return answer(net) if seen else []
    out = {}
    for k in {r[0] for r in rows}:
        for spot in itertools.product(range(5), repeat=3):
            for e in itertools.product((0, 1), repeat=3):
                for a in at(k, [s - x for s, x in zip(spot, e)]):
                    out[(k, a, *spot)] = out.get((k, a, *spot), 0) + (-1) ** sum(e)
    return sorted(((k, a, m, *spot) for (k, a, *spot), m in out.items() if m), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FORMS = {
    "count": (lambda tr: T.count_product(tr, ["key"], COORDS), lambda net: [sum(net.values())]),
    "sum": (lambda tr: T.sum_product(tr, ["key"], "value", COORDS), lambda net: [sum(v * m for v, m in net.items() if v is not None)]),
    "min": (lambda tr: T.min_product(tr, ["key"], "value", COORDS), lambda net: [min(live)] if (live := [v for v, m in net.items() if m > 0 and v is not None]) else []),
    "max": (lambda tr: T.max_product(tr, ["key"], "value", COORDS), lambda net: [max(live)] if (live := [v for v, m in net.items() if m > 0 and v is not None]) else []),
    "distinct": (lambda tr: T.distinct_product(tr, ["key", "value"], COORDS), lambda net: [v for v, m in net.items() if m > 0]),
    "reduce": (lambda tr: T.reduce_product(tr, ["key"], ["value"], lambda r: [(v, 1) for v, m in r if v[0] is not None][-1:], "last bigint", COORDS),
               lambda net: [max(live)] if (live := [v for v, m in net.items() if m and v is not None]) else []),
}


@pytest.mark.parametrize("name", FORMS)
def test_three_coordinates_with_nulls_and_retractions(spark, name):
    f, answer = FORMS[name]
    # a record is never taken back before it came: keep what stays non-negative everywhere
    data = made()
    assert rows(f(spark.createDataFrame(data, SCHEMA).repartition(3))) == plain(data, answer)


def test_points_are_the_closure_and_not_the_grid(spark):
    chain = spark.range(40).select(F.struct(F.lit("k").alias("key")).alias("_k"), *[F.col("id").cast("int").alias(c) for c in COORDS])
    assert P.lub_closure(chain, COORDS).count() == 40  # the grid has 64,000
    axes = spark.createDataFrame([((1,), 1, 0, 0), ((1,), 0, 1, 0), ((1,), 0, 0, 1)], "_k struct<key:int>, v0 int, v1 int, v2 int")
    assert P.lub_closure(axes, COORDS).count() == 7


def test_no_rows_and_one_coordinate(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    for f, _ in FORMS.values():
        assert f(df.where("false")).collect() == []
    one = df.withColumn("version", F.col("v0"))
    assert rows(T.count_product(one, ["key"], ["version"])) == rows(T.count_trace(one, ["key"]).select("key", "count", "multiplicity", "version"))


def test_reduce_sees_each_point_once_and_in_order_across_batches(spark):
    """A task answers many points in one stretch of Python, whatever the batches: a worker is not asked once a group."""
    data = [(f"k{k}", v, 1, k % 3, k % 2, 0) for k in range(40) for v in [None, *range(12)]]
    tr = spark.createDataFrame(data, SCHEMA).repartition(5)
    seen = lambda r: [(",".join(str(v[0]) for v, m in r if m == 1), 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = T.reduce_product(tr, ["key"], ["value"], lambda r: [((x,), m) for x, m in seen(r)], "said string", COORDS)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = rows(out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(((f"k{k}", ",".join(["None", *map(str, range(12))]), 1, k % 3, k % 2, 0) for k in range(40)), key=repr)
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan

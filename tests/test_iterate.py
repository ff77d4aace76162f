"""Fixpoints: closures under change, the sparse grid, bounds."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import collection as C, iterate as I
from tidemark.plans.jobs import closure_step, grid_step


def xs(df):
    return sorted(r.x for r in df.collect())


def test_closures(spark):
    one = spark.createDataFrame([(1, 1)], "x bigint, multiplicity bigint")
    assert xs(I.iterate(one, closure_step(5, lambda x: x + 1))) == [1, 2, 3, 4, 5]
    assert xs(I.iterate_insert_only(one, lambda d: d.withColumn("x", F.col("x") * 2).where("x <= 50"))) == [1, 2, 4, 8, 16, 32]
    log = I.iterate_log(one, closure_step(4, lambda x: x * 2))
    assert sorted((r["round"], r.x) for r in log.collect()) == [(0, 1), (1, 2), (2, 4)]


def test_bound(spark):
    one = spark.createDataFrame([(1, 1)], "x bigint, multiplicity bigint")
    grow = closure_step(10**9, lambda x: x + 1)
    with pytest.raises(RuntimeError):
        I.iterate(one, grow, max_rounds=2)
    assert xs(I.iterate(one, grow, max_rounds=2, on_limit="return")) == [1, 2, 3]


def test_doubling_under_change(spark):
    tr = spark.createDataFrame([(1, 1, 0), (16, 1, 1), (3, 1, 1), (3, -1, 2)], "x bigint, multiplicity bigint, version int")
    got = sorted((r.version, r.x, r.multiplicity) for r in I.iterate_trace(tr, closure_step(50, lambda x: x * 2)).collect())
    first = [(0, x, 1) for x in (1, 2, 4, 8, 16, 32)]
    assert got == first + [(1, x, 1) for x in (3, 6, 12, 24, 48)] + [(2, x, -1) for x in (3, 6, 12, 24, 48)]


def test_sparse_grid(spark):
    cells = spark.createDataFrame([(2, 2, 1), (2, 3, 1), (2, 4, 1), (3, 2, 1)], "x int, y int, multiplicity bigint")
    once = sorted((r.x, r.y) for r in grid_step(cells).collect())
    assert once == [(1, 3), (2, 2), (2, 3), (3, 2)]
    stable = I.iterate(cells, grid_step)
    assert sorted((r.x, r.y) for r in C.distinct(stable).collect()) == [(1, 2), (1, 3), (2, 1), (2, 4), (3, 2), (3, 3)]

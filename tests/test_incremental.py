"""Fixpoints under change against recomputation, and what a small change costs."""

import random

from pyspark.sql import functions as F

from tidemark.operators import incremental as N, iterate as I
from tidemark.plans import jobs as J

SCHEMA = "x bigint, multiplicity bigint, version int"


def rows(df):
    return sorted((r.x, r.multiplicity, r.version) for r in df.collect())


def plain(changes, limit, steps):
    """The closure of each version's input, and its differences along versions."""
    out, was = [], set()
    for v in sorted({v for *_, v in changes}):
        net = {}
        for x, m, w in changes:
            if w <= v:
                net[x] = net.get(x, 0) + m
        now = {x for x, m in net.items() if m and x <= limit}
        while more := {y for x in now for s in steps if (y := s(x)) <= limit} - now:
            now |= more
        out += [(x, 1, v) for x in now - was] + [(x, -1, v) for x in was - now]
        was = now
    return sorted(out)


def test_updates_with_retractions_equal_recomputation(spark):
    r = random.Random(6)
    live, changes = [], []
    for v in range(5):
        for _ in range(3):
            if live and r.random() < 0.5:
                changes.append((live.pop(r.randrange(len(live))), -1, v))
            else:
                live.append(r.randrange(1, 40))
                changes.append((live[-1], 1, v))
    linear = J.reached(70, lambda x: x * 2)
    want = plain(changes, 70, [lambda x: x * 2])
    assert rows(N.iterate_changes(spark.createDataFrame(changes, SCHEMA), linear, ["x"])) == want
    fix = N.IncrementalFixpoint(spark, "t-fix", linear, ["x"], buckets=4)
    got = []
    for low, high in ((0, 2), (3, 4)):
        got += rows(fix.update(spark.createDataFrame([c for c in changes if low <= c[2] <= high], SCHEMA)))
    assert sorted(got) == want


def test_a_small_change_looks_at_its_effects_only(spark):
    fix = N.IncrementalFixpoint(spark, "t-small", J.reached(4000, lambda x: x * 2), ["x"], buckets=8)
    seeds = spark.range(1, 2001).selectExpr("id as x", "1L as multiplicity", "0 as version")
    fix.update(seeds)
    assert max(fix.looked_at) >= 2000
    got = rows(fix.update(spark.createDataFrame([(1999, -1, 1), (2001, 1, 1)], SCHEMA)))
    assert got == [(1999, -1, 1), (2001, 1, 1), (3998, -1, 1)]
    assert max(fix.looked_at) <= 4
    # 3 stays reachable from nothing else; 6 is an input of its own
    assert rows(fix.update(spark.createDataFrame([(3, -1, 2)], SCHEMA))) == [(3, -1, 2)]
    # an update that is given again replaces itself
    assert rows(fix.update(spark.createDataFrame([(3, -1, 2)], SCHEMA), number=2)) == [(3, -1, 2)]


def test_cycles_die_when_their_cause_goes(spark):
    """1 -> 2 -> 3 -> 1: records that only support each other must vanish."""
    linear = lambda df: df.unionByName(df.where("x <= 3").withColumn("x", F.col("x") % 3 + 1))
    changes = [(1, 1, 0), (9, 1, 0), (1, -1, 1)]
    got = rows(N.iterate_changes(spark.createDataFrame(changes, SCHEMA), linear, ["x"]))
    assert got == [(1, -1, 1), (1, 1, 0), (2, -1, 1), (2, 1, 0), (3, -1, 1), (3, 1, 0), (9, 1, 0)]


def test_nested_scopes(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 5, 1), (None, 7, 1)], "scope string, x bigint, multiplicity bigint")
    got = I.iterate_nested(df, J.closure_step(50, lambda x: x * 3), J.closure_step(50, lambda x: x * 2), ["scope"])
    want = {(s, x) for s, seed in (("a", 1), ("b", 5), (None, 7)) for i in range(6) for j in range(4) if (x := seed * 2**i * 3**j) <= 50}
    assert {(r.scope, r.x) for r in got.collect()} == want

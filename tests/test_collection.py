"""One collection: small goldens, null keys, vanished keys, physical forms."""

import pytest
from pyspark.sql import functions as F

from tidemark import sources as S
from tidemark.operators import collection as C


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def fruit(spark):
    schema = "key string, value string, multiplicity bigint"
    a = spark.createDataFrame([("apple", "$5", 2), ("banana", "$2", 1)], schema)
    b = spark.createDataFrame([("apple", "$3", 1), ("apple", "$2", 1), ("kiwi", "$2", 1)], schema)
    return a, b


def test_linear(fruit):
    a, b = fruit
    assert rows(C.filter_records(a, F.col("key") != "apple")) == [("banana", "$2", 1)]
    assert rows(C.map_records(a, F.col("value").alias("key"), F.col("key").alias("value"))) == [("$2", "banana", 1), ("$5", "apple", 2)]
    assert rows(C.difference(a, a)) == []
    assert C.concat(a, b).count() == 5


def test_join_multiplies_and_matches_null_keys(spark, fruit):
    a, b = fruit
    assert rows(C.join(a, b, ["key"])) == [("apple", "$5", "$2", 2), ("apple", "$5", "$3", 2)]
    schema = "key string, value int, multiplicity bigint"
    n = spark.createDataFrame([(None, 1, 2), ("x", 2, 1)], schema)
    assert rows(C.join(n, n, ["key"])) == [("x", 2, 2, 1), (None, 1, 1, 4)]
    assert rows(C.join(n, n, ["key"], null_keys=False)) == [("x", 2, 2, 1)]


def test_semijoin_keeps_the_keys_multiplicity(spark, fruit):
    keys = spark.createDataFrame([("apple", 3)], "key string, multiplicity bigint")
    assert rows(C.semijoin(fruit[0], keys, ["key"])) == [("apple", "$5", 6)]


def test_aggregates(spark, fruit):
    a, b = fruit
    both = C.concat(a, b)
    assert rows(C.count(both, ["key"])) == [("apple", 4, 1), ("banana", 1, 1), ("kiwi", 1, 1)]
    assert len(rows(C.distinct(both))) == 5
    d = spark.createDataFrame([("apple", 11, 1), ("apple", 3, 2), ("banana", 2, 3), ("coconut", 3, 1)], "key string, value bigint, multiplicity bigint")
    assert rows(C.sum_values(d, ["key"], "value")) == [("apple", 17, 1), ("banana", 6, 1), ("coconut", 3, 1)]
    assert rows(C.min_value(d, ["key"], "value"))[0] == ("apple", 3, 1)
    assert rows(C.max_value(d, ["key"], "value"))[0] == ("apple", 11, 1)
    top = C.reduce_groups(d, ["key"], ["value"], lambda r: [(v, 1) for v, m in r][-1:], "value bigint")
    assert rows(top) == [("apple", 11, 1), ("banana", 2, 1), ("coconut", 3, 1)]


def test_vanished_keys(spark):
    d = spark.createDataFrame([("k", 1, 2), ("k", 1, -2)], "key string, value bigint, multiplicity bigint")
    assert rows(C.count(d, ["key"])) == [("k", 0, 1)]
    assert rows(C.count(d, ["key"], drop_zero_keys=True)) == []
    assert rows(C.count(C.consolidate(d), ["key"])) == []
    assert rows(C.min_value(d, ["key"], "value")) == [] == rows(C.distinct(d))


def test_negative_net_is_refused(spark):
    d = spark.createDataFrame([("k", 1, -1)], "key string, value bigint, multiplicity bigint")
    with pytest.raises(Exception, match="negative net multiplicity"):
        C.min_value(d, ["key"], "value").collect()


def test_physical_form_is_free(spark):
    schema = "x int, multiplicity bigint"
    forms = [[(1, 1), (1, 1)], [(1, 2)], [(1, 3), (1, -1)]]
    assert {tuple(rows(C.consolidate(spark.createDataFrame(f, schema)))) for f in forms} == {((1, 2),)}


def test_sources(spark):
    df = spark.range(3).withColumnRenamed("id", "x")
    assert dict(S.collection(df).dtypes)["multiplicity"] == "bigint"
    tr = S.trace_from_sequence([S.collection(df), S.collection(df.limit(1))])
    assert sorted(r.version for r in tr.collect()) == [0, 0, 0, 1]

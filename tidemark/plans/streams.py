"""Registered streaming queries: a trace is replayed in micro-batches, the SQL is the batch answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructType

from tidemark import sources as S, streaming as W
from tidemark.functions import versions as V
from tidemark.operators import incremental as N, trace as T
from tidemark.plans import jobs as J
from tidemark.plans.catalog import ORACLE as ORACLE_BATCH, _CLOSURE_SQL, _DISTINCT, _EVEN, _JOIN_COUNT, _JOINED, _all_trace, _changes_sql, _closure_trace, _customers, _extreme_sql, even_difference, sql
from tidemark.scratch import new_folder
from tidemark.sources import M

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
BATCHES = 6


def query(name: str, statement: str):
    def register(f):
        QUERIES[name], ORACLE[name] = f, statement
        return f
    return register


def replayed(tr: DataFrame, name: str, batches: int = BATCHES) -> DataFrame:
    """The whole trace as a stream, versions in order, with a heartbeat that closes the last one."""
    low, high = tr.agg(F.min("version"), F.max("version")).first()
    if low is None:
        return W.feed([tr], name)
    step = -(-(high - low + 1) // batches)
    dealt = new_folder(tr.sparkSession, f"{name}-parts")  # so that a batch reads its own rows and not the whole trace
    part = F.floor((F.col("version") - low) / step).cast("int")
    tr.withColumn("_part", part).hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(dealt)
    whole = tr.sparkSession.read.schema(StructType([*tr.schema.fields]).add("_part", IntegerType())).parquet(dealt)
    parts = [whole.where(F.col("_part") == i).drop("_part") for i in range((high - low) // step + 1)]
    return W.feed([*parts, W.heartbeat(tr, high + 1)], name)


@query("w1_linear", sql("SELECT value + 5 AS value, multiplicity, version FROM order_churn WHERE (value + 5) % 2 = 0 UNION ALL SELECT value, -multiplicity, version FROM order_churn", "order_churn"))
def _(spark, d):
    stream = replayed(J.order_churn(spark, d), "linear")
    return W.run_to_end(W.stream_linear(stream, even_difference), "linear").where(F.col(M) != 0)


@query("w2_consolidate", sql("SELECT key, CAST(sum(multiplicity) AS BIGINT) AS multiplicity, version FROM event_signed GROUP BY key, version HAVING sum(multiplicity) <> 0", "event_signed"))
def _(spark, d):
    return W.run_to_end(W.stream_consolidate(replayed(J.event_signed(spark, d), "consolidate"), ["key"]), "consolidate")


@query("w3_join", sql(_JOINED, "order_trace", "line_trace"))
def _(spark, d):
    a, b = replayed(J.order_trace(spark, d), "join-a"), replayed(J.line_trace(spark, d), "join-b")
    return W.run_to_end(W.stream_join(a, b, ["key"]), "join").where(F.col(M) != 0)


def _reduced(name: str, f):
    def run(spark, d):
        return W.run_to_end(f(replayed(J.order_churn(spark, d), name), "key", "value"), name)
    return run


query("w4_count", sql(_changes_sql("multiplicity", "count", "order_churn"), "order_churn"))(_reduced("count", W.stream_count))
query("w4_sum", sql(_changes_sql("value * multiplicity", "sum", "order_churn"), "order_churn"))(_reduced("sum", W.stream_sum))
query("w4_min", _extreme_sql("min"))(_reduced("min", W.stream_min))
query("w4_max", _extreme_sql("max"))(_reduced("max", W.stream_max))
query("w4_distinct", sql(_DISTINCT.format("order_churn"), "order_churn"))(_reduced("distinct", W.stream_distinct))


@query("w4_reduce", _extreme_sql("max"))
def _(spark, d):
    largest = lambda rows: [((max(v for v, m in rows if m > 0),), 1)]
    return W.run_to_end(W.stream_reduce(replayed(J.order_churn(spark, d), "reduce"), "key", "value", largest, "max bigint"), "reduce")


@query("w6_late", sql("SELECT key, value, multiplicity, version FROM order_churn WHERE key % 7 = 0 AND version < (SELECT max(version) FROM order_churn WHERE key % 7 <> 0)", "order_churn"))
def _(spark, d):
    tr = J.order_churn(spark, d)
    store = W.VersionedStore(spark, "late", lambda stored, low, high: stored)
    store.run(W.feed([tr.where("key % 7 <> 0"), tr.where("key % 7 = 0")], "late"))
    return store.late_rows(tr.schema)


def _closure_store(spark, name: str, linear) -> W.VersionedStore:
    fixpoint = N.IncrementalFixpoint(spark, name, linear, ["x"])
    return W.VersionedStore(spark, name, lambda rows, low, high, n: fixpoint.update(rows, n), keeps_state=True)


@query("w8_iterate", _CLOSURE_SQL)
def _(spark, d):
    tr = _closure_trace(spark, d)
    return _closure_store(spark, "iterate", J.reached(500, lambda x: x * 2)).run(replayed(tr, "iterate", 2)).changes(tr.schema)


@query("w8_iterate_whole", ORACLE_BATCH["x3_closure_whole"])
def _(spark, d):
    tr, top = _all_trace(spark, d)
    return _closure_store(spark, "iterate-whole", J.reached(top, lambda x: x * 3)).run(replayed(tr, "iterate-whole", 4)).changes(tr.schema)


def _two_sides(a: DataFrame, b: DataFrame, *versions: str) -> DataFrame:
    tagged = lambda df, k: df.select("key", M, *versions, F.lit(k).alias("side"))
    return tagged(a, 0).unionByName(tagged(b, 1))


def _joined_counts(*versions: str):
    def answer(stored: DataFrame, low, high) -> DataFrame:
        if len(versions) == 1:
            return J.join_count_of_sides(stored)
        return J.join_count(stored.where("side = 0"), stored.where("side = 1"), versions=versions)
    return answer


def _join_counted(batches: int):
    def run(spark, d):
        both = _two_sides(J.order_trace(spark, d), J.line_trace(spark, d), "version")
        store = W.VersionedStore(spark, "join-count", _joined_counts("version"), key=["key"]).run(replayed(both, "join-count", batches))
        return store.changes("key bigint, count bigint, multiplicity bigint, version int")
    return run


query("w9_join_count", _JOIN_COUNT)(_join_counted(BATCHES))
query("w9_many_batches", _JOIN_COUNT)(_join_counted(24))


@query("s5_advance", sql(_changes_sql("multiplicity", "count", "order_churn"), "order_churn"))
def _(spark, d):
    """Words between batches, each batch given twice, a new store before each step: every change comes once."""
    tr = J.order_churn(spark, d)
    path, low, high = new_folder(spark, "advance"), *tr.agg(F.min("version"), F.max("version")).first()
    store = lambda: W.VersionedStore(spark, "advance", lambda stored, a, b: T.count_trace(stored, ["key"]), path=path, key=["key"])
    if low is None:
        return T.count_trace(tr, ["key"])
    step = -(-(high - low + 1) // 4)
    for i, v in enumerate(range(low, high + 1, step)):
        part = tr.where((F.col("version") >= v) & (F.col("version") < v + step))
        store().batch(part, i)
        store().advance(v + step)  # the batch's last version too
        store().batch(part, i)
    return store().changes("key bigint, count bigint, multiplicity bigint, version int")


@query("w5_meet", sql(_changes_sql("multiplicity", "count", "(SELECT key, multiplicity, version FROM order_trace UNION ALL SELECT key, multiplicity, version FROM line_trace)"), "order_trace", "line_trace"))
def _(spark, d):
    """Two inputs that move apart: a version is answered when both have closed it."""
    both = _two_sides(J.order_trace(spark, d), J.line_trace(spark, d), "version")
    store = W.VersionedStore(spark, "meet", lambda stored, a, b: T.count_trace(stored, ["key"]), key=["key"], side="side", sides=2)
    cuts = [(0, -1000, 1 << 20), (1, -1000, 20), (1, 20, 50), (1, 50, 1 << 20)]
    for i, (side, a, b) in enumerate(cuts):
        store.batch(both.where((F.col("side") == side) & (F.col("version") >= a) & (F.col("version") < b)), i)
    store.advance(1 << 20, "0")
    store.advance(1 << 20, "1")
    return store.changes("key bigint, count bigint, multiplicity bigint, version int")


@query("w10_join_count_product", ORACLE_BATCH["x6_join_count_product"])
def _(spark, d):
    """x6 in product order, fed by frontiers that are antichains."""
    both = _two_sides(J.order_churn2(spark, d), _customers(spark, d), "v0", "v1")
    store = W.VersionedStore(spark, "join-count-product", _joined_counts("v0", "v1"), key=["key"], coords=("v0", "v1"))
    was = [(-100, -100)]
    for i, now in enumerate(([(0, 0)], [(3, 0), (0, 3)], [(5, 0), (3, 4)], [(100, 0), (5, 5)], [(100, 100)])):
        store.batch(both.where(V.open_at(["v0", "v1"], was) & ~V.open_at(["v0", "v1"], now)), i)
        store.advance(now)
        was = now
    return store.changes("key bigint, count bigint, multiplicity bigint, v0 int, v1 int")


@query("k2_stream", sql("SELECT key, value, multiplicity, version FROM order_churn", "order_churn"))
def _(spark, d):
    """A stream's changes written by batch; the whole stream is given twice."""
    tr = J.order_churn(spark, d)
    stream, path = replayed(tr, "sink"), new_folder(spark, "sink")
    for attempt in range(2):
        done = S.write_stream_deltas(stream.where(F.col(M) != 0), path).option("checkpointLocation", f"{path}-checkpoint{attempt}").trigger(availableNow=True).start()
        done.awaitTermination()
    return S.read_deltas(spark, path, tr.schema)


@query("k3_closed_through", sql("SELECT max(version) AS version, count(*) AS rows FROM order_churn", "order_churn"))
def _(spark, d):
    """The watermark after all input: versions below the last heartbeat's are answered."""
    tr = J.order_churn(spark, d)
    stream, out = W.event_time(replayed(tr, "through")), new_folder(spark, "through")
    query = (stream.groupBy("et", "version").agg(F.sum(F.abs(M)).alias("rows")).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", f"{out}-checkpoint").outputMode("append").start())
    try:
        through = W.closed_through(query)
    finally:
        query.stop()
    done = spark.read.schema("et timestamp, version int, rows bigint").parquet(out).where(F.col("et") <= F.lit(through).cast("timestamp"))
    return done.agg(F.max("version").alias("version"), F.sum("rows").alias("rows"))

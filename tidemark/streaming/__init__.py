"""Incremental forms on Structured Streaming: closed versions, running answers, late rows.

A version is a logical integer.  ``event_time`` maps version n to second n + 1, and a watermark of
one second then means: seeing version n closes all versions below n.  The last version closes after
a heartbeat, a row with multiplicity 0 at the version to which the frontier moves; heartbeats reach
the stateful operator and are dropped there.
Running answers of keys (``ClosedAnswers``) close versions in the same way, by the store's ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tidemark.operators import trace as T
from tidemark.scratch import new_folder
from tidemark.sources import M, stream_trace
from tidemark.streaming.store import VersionedStore

__all__ = ["ClosedAnswers", "JoinedStreams", "VersionedStore", "closed_through", "event_time", "feed", "heartbeat", "run_to_end", "stream_concat", "stream_consolidate", "stream_count", "stream_distinct",
           "stream_join", "stream_linear", "stream_max", "stream_min", "stream_reduce", "stream_sum"]

def event_time(df: DataFrame, version: str = "version") -> DataFrame:
    return df.withColumn("et", F.timestamp_seconds(F.col(version) + 1)).withWatermark("et", "1 second")


def heartbeat(df: DataFrame, version: int) -> DataFrame:
    """A row with multiplicity 0 that declares all versions below ``version`` closed.

    Its other columns are null.
    """
    def blank(name: str, kind: str):
        return F.lit(0 if name == M else version if name == "version" else None).cast(kind).alias(name)
    return df.sparkSession.range(1).select(*[blank(c, t) for c, t in df.dtypes])


def feed(batches: Sequence[DataFrame], name: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """A stream that delivers the given tables one micro-batch each, for replays and tests."""
    spark = batches[0].sparkSession
    path = new_folder(spark, f"{name}-input")
    files = max(1, max(-(-b.count() // rows_per_file) for b in batches))
    for b in batches:
        b.repartition(files).write.mode("append").parquet(path)
    return stream_trace(spark, path, batches[0].schema, files)


def run_to_end(df: DataFrame | ClosedAnswers | JoinedStreams, name: str, mode: str = "append") -> DataFrame:
    """Runs the query over all that has arrived and returns what it wrote."""
    if isinstance(df, (ClosedAnswers, JoinedStreams)):
        return df.run(name)
    spark = df.sparkSession
    out, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")
    query = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def closed_through(query) -> str | None:
    """The watermark after all input that has arrived: versions below it are answered."""
    query.processAllAvailable()
    last = query.lastProgress
    return (last or {}).get("eventTime", {}).get("watermark") if last else None


def stream_linear(stream: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """map, filter, negate and concat emit at once and keep no state."""
    return f(stream)


def stream_consolidate(stream: DataFrame, record: Sequence[str]) -> DataFrame:
    """Net changes of each closed version, once."""
    grouped = event_time(stream).groupBy("et", "version", *record).agg(F.sum(M).alias(M))
    return grouped.where(F.col(M) != 0).select(*record, M, "version")


class JoinedStreams:
    """Each side's changes meet the other side's history, at once; both histories are kept as tables, a folder a batch.

    A batch writes its rows, then the changes that they make: new rows of the left with all of the right, and old rows of
    the left with new ones of the right.  A batch that is given again overwrites its own folders and reads none after it.
    """

    def __init__(self, a: DataFrame, b: DataFrame, key: Sequence[str]):
        self.spark, self.key, self.sides = a.sparkSession, list(key), (a, b)
        right = {c: f"{c}_right" if c in a.columns else c for c in b.columns if c not in (*key, M, "version")}
        out = a.drop(M, "version").schema
        for c, name in right.items():
            out = out.add(name, b.schema[c].dataType)
        self.right, self.schema = right, out.add("version", a.schema["version"].dataType).add(M, LongType())

    def _both(self) -> DataFrame:
        """One stream of both sides: a row's own columns are in its side's struct."""
        a, b = (F.struct(*[F.col(c) for c in x.columns]) for x in self.sides)
        kinds = [x.select(s.alias("s")).schema["s"].dataType for x, s in zip(self.sides, (a, b))]
        left = self.sides[0].where(F.col(M) != 0).select(F.lit(0).alias("side"), a.alias("_a"), F.lit(None).cast(kinds[1]).alias("_b"))
        right = self.sides[1].where(F.col(M) != 0).select(F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("_a"), b.alias("_b"))
        return left.unionByName(right)

    def _rows(self, path: str, side: int, batches: str, last: int) -> DataFrame:
        """A side's rows of the batches up to ``last`` that ``batches`` names."""
        own = self.sides[side].schema
        found = self.spark.read.schema(StructType().add("ab"[side], own).add("batch", IntegerType()).add("side", IntegerType())).parquet(f"{path}/rows")
        return found.where(F.col("side") == side).where(f"batch {batches} {last}").select(f"{'ab'[side]}.*")

    def _joined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        moved = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)], *[F.col(c).alias(name) for c, name in self.right.items()],
                             F.col(M).alias("_m"), F.col("version").alias("_v"))
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)]
        kept = [c for c in left.columns if c not in (M, "version")]
        return left.join(moved, on).select(*kept, *self.right.values(), F.greatest("version", "_v").alias("version"), (F.col(M) * F.col("_m")).alias(M))

    def run(self, name: str, path: str | None = None) -> DataFrame:
        """Takes all that has arrived and returns the changes so far; an old path goes on where it ended."""
        path = path or new_folder(self.spark, name)

        def take(df: DataFrame, n: int) -> None:
            (df.withColumnsRenamed({"_a": "a", "_b": "b"}).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch", "side").parquet(f"{path}/rows"))
            a, b = (lambda how: self._rows(path, 0, how, n)), (lambda how: self._rows(path, 1, how, n))
            changes = self._joined(a("="), b("<=")).unionByName(self._joined(a("<"), b("=")))
            changes.write.mode("overwrite").parquet(f"{path}/changes/_batch={n}")

        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{path}/changes/_batch=-1")  # of a stream that brings nothing
        self._both().writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(self.schema).parquet(f"{path}/changes").select(*self.schema.names)


def stream_join(a: DataFrame, b: DataFrame, key: Sequence[str]) -> JoinedStreams:
    """Each side's changes meet the other side's history, which grows by design; null keys match, as in the batch join."""
    return JoinedStreams(a, b, key)


class ClosedAnswers:
    """The running answer of a stream's keys at closed versions, as stored traces give it: ``run`` or ``run_to_end``.

    A micro-batch is one Spark job over the keys that it closes versions of, not a call a row or a key.  ``answer`` makes
    the changes of stored rows; ``shape`` is the DDL of its columns.
    """

    def __init__(self, stream: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame], shape: str):
        self.stream, self.key, self.answer, self.shape = stream, key, answer, shape

    def store(self, name: str, path: str | None = None) -> VersionedStore:
        """A store on an old path goes on where it ended."""
        return VersionedStore(self.stream.sparkSession, name, lambda stored, low, high: self.answer(stored), path=path, key=[self.key])

    def run(self, name: str, path: str | None = None) -> DataFrame:
        """Takes all that has arrived and returns the changes so far."""
        return self.store(name, path).run(self.stream).changes(self.shape)


def _closed(stream: DataFrame, key: str, result: str, answer: Callable[[DataFrame], DataFrame]) -> ClosedAnswers:
    types = dict(stream.dtypes)
    return ClosedAnswers(stream, key, answer, f"`{key}` {types[key]}, {result}, {M} bigint, version {types['version']}")


def stream_reduce(stream: DataFrame, key: str, value: str, f: Callable, result: str, empty_too: bool = False) -> ClosedAnswers:
    """Changes of ``f``'s answer at each closed version.

    ``f`` maps the sorted (value, net multiplicity) list to [(result tuple, multiplicity)].
    ``empty_too`` keeps an answer for keys whose records cancelled, as count and sum want.
    """
    def of_values(rows):
        return f([(v[0], m) for v, m in rows])
    return _closed(stream.select(key, value, M, "version"), key, result, lambda stored: T.reduce_trace(stored, [key], [value], of_values, result, empty_too=empty_too))


def stream_count(stream: DataFrame, key: str, value: str) -> ClosedAnswers:
    """A key's history is one number a version: its values are not told apart."""
    return _closed(stream.select(key, M, "version"), key, "count bigint", lambda stored: T.count_trace(stored, [key]))


def stream_sum(stream: DataFrame, key: str, value: str) -> ClosedAnswers:
    """Null values add nothing."""
    return _closed(stream.select(key, value, M, "version"), key, "sum bigint", lambda stored: T.sum_trace(stored, [key], value))


def stream_min(stream: DataFrame, key: str, value: str) -> ClosedAnswers:
    """Null values are no candidates."""
    return _closed(stream.select(key, value, M, "version"), key, f"min {dict(stream.dtypes)[value]}", lambda stored: T.min_trace(stored, [key], value))


def stream_max(stream: DataFrame, key: str, value: str) -> ClosedAnswers:
    return _closed(stream.select(key, value, M, "version"), key, f"max {dict(stream.dtypes)[value]}", lambda stored: T.max_trace(stored, [key], value))


def stream_distinct(stream: DataFrame, key: str, value: str) -> ClosedAnswers:
    return _closed(stream.select(key, value, M, "version"), key, f"`{value}` {dict(stream.dtypes)[value]}", lambda stored: T.distinct_trace(stored, [key, value]))


def stream_concat(a: DataFrame, b: DataFrame, record: Sequence[str]) -> DataFrame:
    """Net changes of both inputs at versions that *both* have closed: the frontier is the meet of theirs.

    Each input has a watermark of its own, and the query goes by the smaller one.
    """
    a.sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    both = event_time(a).unionByName(event_time(b))
    return both.groupBy("et", "version", *record).agg(F.sum(M).alias(M)).where(F.col(M) != 0).select(*record, M, "version")

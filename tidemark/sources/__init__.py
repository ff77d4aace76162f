"""Collections and traces from tables, sequences and streams; sinks for changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

M = "multiplicity"


def collection(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Records with a BIGINT multiplicity, 1 where no weight is given."""
    return df.withColumn(M, (F.lit(1) if weight is None else weight).cast("bigint"))


def trace(df: DataFrame, version: Column, weight: Column | None = None) -> DataFrame:
    """A change log: records, multiplicity and an explicit version."""
    return collection(df, weight).withColumn("version", version)


def trace_from_sequence(collections: Iterable[DataFrame]) -> DataFrame:
    """Difference collections in order; a collection's place is its version."""
    out = None
    for i, df in enumerate(collections):
        step = df.withColumn("version", F.lit(i))
        out = step if out is None else out.unionByName(step)
    if out is None:
        raise ValueError("an empty sequence has no schema")
    return out


def stream_trace(spark: SparkSession, path: str, schema, files_at_once: int = 1, source: str = "parquet") -> DataFrame:
    """An unbounded change log from files that keep arriving below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(source).load(path)


def tap(df: DataFrame, name: str) -> DataFrame:
    """Passes ``df`` through and observes its rows and net multiplicity while it runs."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(M).alias("net"))


def write_deltas(tr: DataFrame, path: str, version: str = "version") -> None:
    """Changes as Parquet, one folder a version; rewriting a version replaces it.

    Rows are dealt by version, and Spark splits a version that is too large for one task.
    """
    (tr.hint("rebalance", F.col(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(version).parquet(path))


def write_stream_deltas(stream: DataFrame, path: str):
    """A writer for a stream's changes: each micro-batch owns the folder of its id, split by version.

    A batch that is given again overwrites its own folder and nothing else, so a restart leaves no change twice.
    """
    def put(df: DataFrame, batch_id: int) -> None:
        df.hint("rebalance", F.col("version")).write.mode("overwrite").partitionBy("version").parquet(f"{path}/batch_id={batch_id}")
    return stream.writeStream.foreachBatch(put)


def read_deltas(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_stream_deltas`` wrote; a filter on ``version`` opens that version's folders only."""
    kind = spark.createDataFrame([], schema).schema
    if "batch_id" not in kind.names:
        kind = kind.add("batch_id", LongType())
    return spark.read.schema(kind).option("basePath", path).parquet(path).drop("batch_id")

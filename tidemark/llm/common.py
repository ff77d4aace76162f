"""Shared pieces of the training-data operators: components, input shaping."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.scratch import saved

__all__ = ["components", "crc_fold", "documents", "give_back", "in_places", "saved", "table"]


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: Spark keeps idle workers, which would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(df: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more); a null text counts as empty.  Other columns never get further."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def in_places(df: DataFrame, f) -> DataFrame:
    """``f`` of ``df`` with its columns named by place, then under their own names again, whatever these hold (dots, blanks)."""
    return f(df.toDF(*[f"c{i}" for i in range(len(df.columns))])).toDF(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id, folds: int):
    """crc32 of the id written in decimal, modulo ``folds``; null ids count as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def _smallest_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): (node, component = smallest node).

    Alternates the large-star and small-star contractions.  Each half is one map-side-combined
    minimum per node and one equi-join, so a hub costs its own edges only (AQE splits the join),
    and the number of edges never grows.  Nodes without a partner are not returned.
    Self-loops and null ends are ignored; no edges give no rows.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    state = mark(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.where("b > a").join(_smallest_neighbour(both), "a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        large = large.where("a <> b").distinct()
        joined = large.join(_smallest_neighbour(large), "a")
        small = (joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                                 F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        edges = saved(small, "edges")
        was, state = state, mark(edges)
        if was == state:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))

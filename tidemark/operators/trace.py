"""Operators on traces: change logs whose results are the changes of the answer.

Every aggregate first sums a key's changes within a version, so a hot key holds at most one row a
version (or a distinct value and version) before the window that follows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import replay
from tidemark.functions.versions import advance_by, version_leq, version_lub
from tidemark.operators.collection import consolidate, difference, join, not_negative
from tidemark.operators.product import count_product, distinct_product, max_product, min_product, reduce_product, sum_product
from tidemark.sources import M

__all__ = ["append_trace", "changes_of", "compact", "count_product", "count_trace", "delta_between", "distinct_product", "distinct_trace", "join_trace",
           "max_product", "max_trace", "min_product", "min_trace", "reduce_product", "reduce_trace", "snapshot_at", "snapshots", "sum_product", "sum_trace", "versions_of"]


def join_trace(a: DataFrame, b: DataFrame, key: Sequence[str], versions: Sequence[str] = ("version",), null_keys: bool = True) -> DataFrame:
    """Changes of the join: one equi-join of both change logs, at the least upper bound of versions.

    The join is bilinear, so no loop over versions is needed, in total or product order.
    """
    out = join(a, b, key, null_keys)
    lub = version_lub(versions, [f"{v}_right" for v in versions])
    kept = [c for c in out.columns if c not in (M, *versions, *(f"{v}_right" for v in versions))]
    return out.select(*kept, *[x.alias(v) for x, v in zip(lub, versions)], M)


def changes_of(totals: DataFrame, key: Sequence[str], name: str, version: str) -> DataFrame:
    """-1 for the old and +1 for the new answer wherever it differs."""
    old = F.lag(name).over(Window.partitionBy(*key).orderBy(version))
    pairs = totals.withColumn("_old", old).where(F.col("_old").isNull() | (F.col("_old") != F.col(name)))
    both = F.array(F.struct(F.col("_old").alias("x"), F.lit(-1).cast("bigint").alias("m")), F.struct(F.col(name).alias("x"), F.lit(1).cast("bigint").alias("m")))
    return pairs.select(*key, version, F.explode(both).alias("_c")).where("_c.x is not null").select(*key, F.col("_c.x").alias(name), F.col("_c.m").alias(M), version)


def _running(tr: DataFrame, key: Sequence[str], term: Column, name: str, version: str) -> DataFrame:
    summed = tr.groupBy(*key, version).agg(F.coalesce(F.sum(term), F.lit(0)).alias("_d"))
    w = Window.partitionBy(*key).orderBy(version).rowsBetween(Window.unboundedPreceding, 0)
    return changes_of(summed.select(*key, version, F.sum("_d").over(w).alias(name)), key, name, version)


def count_trace(tr: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """Changes of the count; a key whose records cancel goes to 0.  Struct versions order by field."""
    return _running(tr, key, F.col(M), "count", version)


def sum_trace(tr: DataFrame, key: Sequence[str], value: str, version: str = "version") -> DataFrame:
    return _running(tr, key, F.col(value) * F.col(M), "sum", version)


def _extreme(tr: DataFrame, key, value: str, version: str, greatest: bool, insert_only: bool, spread: int) -> DataFrame:
    name, pick = ("max", F.max) if greatest else ("min", F.min)
    if insert_only:
        best = tr.groupBy(*key, version).agg(pick(value).alias("_d"))
        w = Window.partitionBy(*key).orderBy(version).rowsBetween(Window.unboundedPreceding, 0)
        return changes_of(best.select(*key, version, pick("_d").over(w).alias(name)), key, name, version)
    kind = dict(tr.dtypes)[value]
    present = tr.where(F.col(value).isNotNull())
    if spread > 1:
        dealt = present.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(spread)).cast("int"))
        present = replay.replay(dealt, [*key, "_part"], [value], lambda: replay.RunningExtreme(greatest), f"`{value}` {kind}", version).drop("_part")
    return replay.replay(present, key, [value], lambda: replay.RunningExtreme(greatest), f"{name} {kind}", version)


def min_trace(tr: DataFrame, key: Sequence[str], value: str, version: str = "version", insert_only: bool = False, spread: int = 1) -> DataFrame:
    """Changes of the least value; ``insert_only`` says that nothing is ever taken back.

    A key's changes pass through one task; where keys are hot, ``spread`` deals each key's values over so many tasks first, and
    only the changes of the parts' extremes meet.
    """
    return _extreme(tr, key, value, version, False, insert_only, spread)


def max_trace(tr: DataFrame, key: Sequence[str], value: str, version: str = "version", insert_only: bool = False, spread: int = 1) -> DataFrame:
    return _extreme(tr, key, value, version, True, insert_only, spread)


def distinct_trace(tr: DataFrame, cols: Sequence[str], version: str = "version") -> DataFrame:
    """+1 and -1 where a record appears and vanishes."""
    summed = tr.groupBy(*cols, version).agg(F.sum(M).alias("_d"))
    w = Window.partitionBy(*cols).orderBy(version)
    total = summed.withColumn("_net", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    there = total.withColumn("_in", (not_negative(F.col("_net")) > 0).cast("bigint"))
    change = there.withColumn(M, F.col("_in") - F.lag("_in", 1, 0).over(w))
    return change.where(F.col(M) != 0).select(*cols, M, version)


def reduce_trace(tr: DataFrame, key: Sequence[str], value: Sequence[str], f: Callable, result: str, version: str = "version", empty_too: bool = False) -> DataFrame:
    """Changes of ``f``'s answer; it sees a key's consolidated (value, multiplicity) list.

    ``empty_too``: it is asked for keys whose records cancelled too.
    """
    return replay.replay(tr, key, value, lambda: replay.Replay(f, empty_too), result, version, empty_too)


def snapshot_at(tr: DataFrame, at: dict[str, int]) -> DataFrame:
    """The collection as of a version: all changes at or before it."""
    names = list(at)
    return consolidate(tr.where(version_leq(names, [at[n] for n in names])).drop(*names))


def snapshots(tr: DataFrame, version: str = "version") -> DataFrame:
    """The collection at every version, as intervals [valid_from, valid_to) of net multiplicity."""
    record = [c for c in tr.columns if c not in (M, version)]
    summed = tr.groupBy(*record, version).agg(F.sum(M).alias("_d")).where("_d <> 0")
    w = Window.partitionBy(*record).orderBy(version)
    net = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = summed.select(*record, net.alias(M), F.col(version).alias("valid_from"), F.lead(version).over(w).alias("valid_to"))
    return spans.where(F.col(M) != 0)


def delta_between(a: DataFrame, b: DataFrame) -> DataFrame:
    """The change that leads from answer ``a`` to answer ``b``."""
    return difference(b, a)


def versions_of(tr: DataFrame, key: Sequence[str], versions: Sequence[str] = ("version",)) -> DataFrame:
    return tr.select(*key, *versions).distinct()


def compact(tr: DataFrame, frontier: Sequence[Sequence[int]], versions: Sequence[str] = ("version",)) -> DataFrame:
    """History before the frontier folded together; reads at or after the frontier are unchanged."""
    moved = advance_by(versions, frontier)
    return consolidate(tr.withColumns({v: x.cast(dict(tr.dtypes)[v]) for v, x in zip(versions, moved)}))


def append_trace(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)

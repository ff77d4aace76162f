"""Versions as columns: product order, lexicographic order, frontiers.

A version is one integer column for each coordinate.  Frontiers are either short lists of tuples,
folded into expressions, or DataFrames with the coordinates as columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.scratch import saved

Version = Sequence[Column]
FAN = 8          # antichains merged at once
PIECE = 100_000  # versions of a frontier that travel to tasks at once


def _cols(v) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x) for x in v]


def version_leq(a, b) -> Column:
    """a <= b in every coordinate."""
    return reduce(lambda x, y: x & y, [x <= y for x, y in zip(_cols(a), _cols(b), strict=True)])


def version_lt(a, b) -> Column:
    return version_leq(a, b) & ~reduce(lambda x, y: x & y, [x == y for x, y in zip(_cols(a), _cols(b), strict=True)])


def version_lub(a, b) -> list[Column]:
    return [F.greatest(x, y) for x, y in zip(_cols(a), _cols(b), strict=True)]


def version_glb(a, b) -> list[Column]:
    return [F.least(x, y) for x, y in zip(_cols(a), _cols(b), strict=True)]


def advance_by(version, frontier: Sequence[Sequence[int]]) -> list[Column]:
    """The greatest lower bound over the frontier's elements f of lub(version, f)."""
    if not frontier:
        return _cols(version)
    return reduce(lambda x, y: version_glb(x, y), [version_lub(version, f) for f in frontier])


def lexicographic(version) -> Column:
    """One struct, which Spark compares field by field."""
    return F.struct(*_cols(version))


def _swept(df: DataFrame, order: Sequence[str], low: str) -> DataFrame:
    """``df`` with ``_low``: the least ``low`` of the rows before and at each one in ``order``; a prefix scan.

    Ranges of ``order`` go to tasks, each range's least to the driver (a row a range), and a range
    starts from the least of those before it.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    least = sorted((r._range, r.least) for r in ranged.groupBy("_range").agg(F.min(low).alias("least")).collect())
    starts, so_far = [], None
    for k, x in least:
        starts.append((k, so_far))
        so_far = x if so_far is None else so_far if x is None else min(x, so_far)
    begin = df.sparkSession.createDataFrame(starts, f"_range int, _begin {dict(df.dtypes)[low]}")
    own = F.min(low).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(begin), "_range").withColumn("_low", F.least(own, "_begin")).drop("_range", "_begin")


def _antichain(x: np.ndarray) -> np.ndarray:
    """The minimal ones of the rows, each once: in order of their sums only kept rows can lie below a later one."""
    x = np.unique(x, axis=0)
    x = x[np.argsort(x.sum(axis=1), kind="stable")]
    kept = x[:0]
    for k in range(0, len(x), 512):
        part = x[k:k + 512]
        part = part[~_above(part, kept)]
        inner = (part[None] <= part[:, None]).all(axis=2)
        np.fill_diagonal(inner, False)
        kept = np.concatenate([kept, part[~inner.any(axis=1)]])
    return kept


def _above(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` have a row of ``low`` at or below them?"""
    found = np.zeros(len(x), dtype=bool)
    for k in range(0, len(low), 4096):
        open_ = np.flatnonzero(~found)
        for a in range(0, len(open_), 512):
            at = open_[a:a + 512]
            found[at] = (low[None, k:k + 4096] <= x[at][:, None]).all(axis=2).any(axis=1)
    return found


def _matrix(batch, coords: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in coords], axis=1).astype(np.int64)


def minimal_versions(df: DataFrame, coords: Sequence[str]) -> DataFrame:
    """The minimal elements of ``df``'s versions (integers), each once; versions with a null coordinate count for nothing.

    In two coordinates: the least second one for each first (map-side combined), then a prefix scan of these.
    In more: an antichain a task, merged ``FAN`` at a time in a tree; a task holds a few antichains and no more.
    """
    types = dict(df.dtypes)
    whole = df.select(*coords).dropna()
    if len(coords) == 1:
        return whole.agg(F.min(coords[0]).alias(coords[0])).where(F.col(coords[0]).isNotNull())
    if len(coords) == 2:
        a, b = coords
        least = whole.groupBy(a).agg(F.min(b).alias(b))
        # strictly below all before: the scan up to a row falls at the row itself
        swept = _swept(least, [a], b)
        first = F.min(a).alias(a)
        return swept.where(F.col(b) == F.col("_low")).groupBy(b).agg(first).select(a, b)
    schema = pa.schema([*((c, pa.int64()) for c in coords)])
    spec = ", ".join(f"`{c}` bigint" for c in coords)

    def local(batches):
        held = np.zeros((0, len(coords)), np.int64)
        for batch in batches:
            held = _antichain(np.concatenate([held, _matrix(batch, coords)]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T.copy()], schema=schema)

    def merged(group: pa.Table) -> pa.Table:
        held = _antichain(_matrix(group, coords))
        return pa.Table.from_arrays([group.column("_g").combine_chunks().take(pa.array(np.zeros(len(held), np.int64))), *(pa.array(c) for c in held.T.copy())], schema=pa.schema([("_g", pa.int32()), *schema]))

    parts = saved(whole.mapInArrow(local, spec).withColumn("_g", F.spark_partition_id()), "antichains")
    top = parts.agg(F.max("_g")).first()[0] or 0
    while True:
        parts = saved(parts.withColumn("_g", F.expr(f"cast(_g div {FAN} as int)")).groupBy("_g").applyInArrow(merged, f"_g int, {spec}"), "antichains")
        if not (top := top // FAN):
            break
    return parts.select(*[F.col(c).cast(types[c]).alias(c) for c in coords])


def frontier_meet(f: DataFrame, g: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Minimal elements of both frontiers."""
    return minimal_versions(f.select(*coords).unionByName(g.select(*coords)), coords)


def not_covered(f: DataFrame, g: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Elements of ``g`` with no element of ``f`` at or below them.

    In two coordinates by one prefix scan of both.  In more, ``f`` shrinks to its antichain, which meets all of
    ``g`` in pieces of at most ``PIECE`` versions: one piece for any frontier of usual size, and never more in a task.
    """
    f, g = f.select(*coords).dropna(), g.select(*coords)
    if len(coords) == 2:
        a, b = coords
        low = f.groupBy(a).agg(F.min(b).alias("_f")).select(a, F.lit(0).alias("_side"), F.lit(None).cast(dict(g.dtypes)[b]).alias(b), "_f")
        high = g.select(a, F.lit(1).alias("_side"), b, F.lit(None).cast(dict(f.dtypes)[b]).alias("_f"))
        swept = _swept(low.unionByName(high), [a, "_side", b], "_f")
        return swept.where("_side = 1").where(F.col("_low").isNull() | (F.col("_low") > F.col(b)) | F.col(a).isNull() | F.col(b).isNull()).select(a, b)

    def beyond(low: np.ndarray):
        def run(batches):
            for batch in batches:
                known = np.flatnonzero(np.all([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in coords], axis=0))
                covered = np.zeros(batch.num_rows, dtype=bool)
                covered[known] = _above(_matrix(batch.take(pa.array(known)), coords), low)
                yield batch.filter(pa.array(~covered))
        return run

    piece: list = []
    for row in minimal_versions(f, coords).toLocalIterator():
        piece.append(tuple(row))
        if len(piece) == PIECE:
            g, piece = saved(g.mapInArrow(beyond(np.array(piece, np.int64)), g.schema), "beyond"), []
    return g.mapInArrow(beyond(np.array(piece, np.int64)), g.schema) if piece else g


def frontier_leq(f: DataFrame, g: DataFrame, coords: Sequence[str]) -> bool:
    return not_covered(f, g, coords).isEmpty()


def frontier_equal(f: DataFrame, g: DataFrame, coords: Sequence[str]) -> bool:
    return frontier_leq(f, g, coords) and frontier_leq(g, f, coords)


def frontier_lt(f: DataFrame, g: DataFrame, coords: Sequence[str]) -> bool:
    return frontier_leq(f, g, coords) and not frontier_leq(g, f, coords)


def below(a: Sequence[int], b: Sequence[int]) -> bool:
    """a <= b in every coordinate, for versions at hand."""
    return all(x <= y for x, y in zip(a, b, strict=True))


def minimal_of(elements: Sequence[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The minimal ones of a few versions at hand, in order: an antichain."""
    every = sorted(set(elements))
    return [e for e in every if not any(o != e and below(o, e) for o in every)]


def open_at(version, frontier: Sequence[Sequence[int]]) -> Column:
    """May data at this version still come: is an element of the frontier at or below it?"""
    return reduce(lambda x, y: x | y, [version_leq(f, version) for f in frontier], F.lit(False))


def split_by_frontier(tr: DataFrame, coords: Sequence[str], frontier: Sequence[Sequence[int]]) -> tuple[DataFrame, DataFrame]:
    """(rows at closed versions, rows at open ones)."""
    is_open = open_at(coords, frontier)
    return tr.where(~is_open), tr.where(is_open)

"""Aggregates on traces whose versions are partially ordered by any number of coordinates.

An answer changes only at least upper bounds of a key's versions, so each key has as its points the
closure of its versions under least upper bounds (``lub_closure``: one self-join for each further
coordinate), not the grid of all coordinates.  At a point c the change of the answer is a signed sum
over the 2^d corners: corner e takes what lies below c, and strictly below it in the coordinates of e.
Counts and sums need these corner sums only.  Other answers are found once a point, and a corner's
answer is that of the largest point that lies within it (``_corners``).

Keys travel as one struct, whose null fields equal each other, so null keys are kept.  Versions must
not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.values import arrow_schema, columns_of, rows_of
from tidemark.operators.collection import consolidate, not_negative
from tidemark.sources import M

Coords = Sequence[str]


def _both(a: Column, b: Column) -> Column:
    return a & b


def _keyed(tr: DataFrame, key: Sequence[str], *more: str) -> DataFrame:
    return tr.select(F.struct(*[F.col(k) for k in key] or [F.lit(0)]).alias("_k"), *more)


def _unkeyed(df: DataFrame, key: Sequence[str], *more: Column | str) -> DataFrame:
    return df.select(*[F.col("_k")[k].alias(k) for k in key], *more)


def _other(coords: Coords) -> list[str]:
    return [f"_below{i}" for i in range(len(coords))]


def lub_closure(points: DataFrame, coords: Coords) -> DataFrame:
    """``points(_k, *coords)`` and all least upper bounds of a key's points, each once.

    A bound's coordinates come from at most as many points as there are coordinates.
    """
    every = points.distinct()
    more = every.select("_k", *[F.col(c).alias(o) for c, o in zip(coords, _other(coords))])
    for _ in coords[1:]:
        every = every.join(more, "_k").select("_k", *[F.greatest(c, o).alias(c) for c, o in zip(coords, _other(coords))]).distinct()
    return every


def _below(points: DataFrame, changes: DataFrame, coords: Coords) -> DataFrame:
    """Each point with the changes of its key at or below it."""
    moved = changes.select("_k", *[F.col(c).alias(o) for c, o in zip(coords, _other(coords))], *[c for c in changes.columns if c not in ("_k", *coords)])
    return points.join(moved, "_k").where(reduce(_both, [F.col(o) <= F.col(c) for c, o in zip(coords, _other(coords))]))


def _in_corner(e: int, coords: Coords) -> Column:
    strict = [F.col(o) < F.col(c) for i, (c, o) in enumerate(zip(coords, _other(coords))) if e >> i & 1]
    return reduce(_both, strict, F.lit(True))


def _signs(coords: Coords) -> list[tuple[int, int]]:
    return [(e, -1 if e.bit_count() % 2 else 1) for e in range(1 << len(coords))]


def _corner_sums(tr: DataFrame, key: Sequence[str], coords: Coords, term: Column) -> DataFrame:
    """Per key and point, ``_s{e}`` (sum of ``term``) and ``_n{e}`` (changes, null if none) of each corner."""
    changes = _keyed(tr.withColumn("_t", term), key, "_t", *coords).groupBy("_k", *coords).agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("_d"))
    pairs = _below(lub_closure(changes.select("_k", *coords), coords), changes, coords)
    sums = []
    for e, _ in _signs(coords):
        inside = _in_corner(e, coords)
        sums += [F.sum(F.when(inside, F.col("_d"))).alias(f"_s{e}")]
    return pairs.groupBy("_k", *coords).agg(*sums)


def _summed_product(tr: DataFrame, key: Sequence[str], coords: Coords, term: Column, name: str) -> DataFrame:
    sums = _corner_sums(tr, key, coords, term)
    terms = F.array(*[F.struct(F.col(f"_s{e}").alias("x"), F.lit(sign).cast("bigint").alias("m")) for e, sign in _signs(coords)])
    rows = sums.select("_k", *coords, F.explode(terms).alias("_c")).where("_c.x is not null")
    return _unkeyed(consolidate(rows.select("_k", F.col("_c.x").alias(name), F.col("_c.m").alias(M), *coords)), key, name, M, *coords)


def count_product(tr: DataFrame, key: Sequence[str], coords: Coords = ("v0", "v1")) -> DataFrame:
    """``count_trace`` where versions are partially ordered; a key whose records cancel goes to 0."""
    return _summed_product(tr, key, coords, F.col(M), "count")


def sum_product(tr: DataFrame, key: Sequence[str], value: str, coords: Coords = ("v0", "v1")) -> DataFrame:
    """``sum_trace`` in product order; null values add nothing."""
    return _summed_product(tr, key, coords, F.col(value) * F.col(M), "sum")


def distinct_product(tr: DataFrame, cols: Sequence[str], coords: Coords = ("v0", "v1")) -> DataFrame:
    """Presence of each record at its own points, differenced over the corners; nulls are values like others."""
    sums = _corner_sums(tr, cols, coords, F.col(M))
    present = [F.when((not_negative(F.col(f"_s{e}")) if e == 0 else F.col(f"_s{e}")) > 0, F.lit(sign)).otherwise(0) for e, sign in _signs(coords)]
    return _unkeyed(sums.withColumn(M, reduce(lambda a, b: a + b, present).cast("bigint")).where(F.col(M) != 0), cols, M, *coords)


def _corners(points: DataFrame, changes: DataFrame, coords: Coords) -> DataFrame:
    """(_k, *coords, _sign, the largest point within the corner as ``_below*``) of every point and corner that holds changes."""
    pairs = _below(points, changes.select("_k", *coords).distinct(), coords)
    largest = [F.struct(F.lit(sign).cast("bigint").alias("sign"), *[F.max(F.when(_in_corner(e, coords), F.col(o))).alias(o) for o in _other(coords)]).alias(f"_e{e}") for e, sign in _signs(coords)]
    each = pairs.groupBy("_k", *coords).agg(*largest)
    rows = each.select("_k", *coords, F.explode(F.array(*[F.col(f"_e{e}") for e, _ in _signs(coords)])).alias("_e"))
    return rows.select("_k", *coords, F.col("_e.sign").alias("_sign"), *[F.col(f"_e.{o}").alias(o) for o in _other(coords)]).where(f"{_other(coords)[0]} is not null")


def _from_answers(answers: DataFrame, points: DataFrame, changes: DataFrame, key: Sequence[str], names: Sequence[str], coords: Coords) -> DataFrame:
    """Changes of answers that are given at points: (_k, *coords, *names, multiplicity)."""
    at = answers.select("_k", *[F.col(c).alias(o) for c, o in zip(coords, _other(coords))], *names, M)
    rows = _corners(points, changes, coords).join(at, ["_k", *_other(coords)])
    return _unkeyed(consolidate(rows.select("_k", *names, (F.col(M) * F.col("_sign")).alias(M), *coords)), key, *names, M, *coords)


def _live(tr: DataFrame, key: Sequence[str], value: Sequence[str], coords: Coords) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(net multiplicity ``_net`` of each value at each point of its key, points, changes)."""
    changes = _keyed(tr, key, *value, M, *coords).groupBy("_k", *value, *coords).agg(F.sum(M).alias("_d"))
    points = lub_closure(changes.select("_k", *coords), coords)
    live = _below(points, changes.where("_d <> 0"), coords).groupBy("_k", *coords, *value).agg(F.sum("_d").alias("_net")).where("_net <> 0")
    return live, points, changes


def _extreme_product(tr: DataFrame, key: Sequence[str], value: str, coords: Coords, name: str, pick: Callable) -> DataFrame:
    live, points, changes = _live(tr, key, [value], coords)
    answers = live.where(not_negative(F.col("_net")) > 0).groupBy("_k", *coords).agg(pick(value).alias(name)).where(F.col(name).isNotNull()).withColumn(M, F.lit(1).cast("bigint"))
    return _from_answers(answers, points, changes, key, [name], coords)


def min_product(tr: DataFrame, key: Sequence[str], value: str, coords: Coords = ("v0", "v1")) -> DataFrame:
    """``min_trace`` in product order; null values are no candidates."""
    return _extreme_product(tr, key, value, coords, "min", F.min)


def max_product(tr: DataFrame, key: Sequence[str], value: str, coords: Coords = ("v0", "v1")) -> DataFrame:
    return _extreme_product(tr, key, value, coords, "max", F.max)


def reduce_product(tr: DataFrame, key: Sequence[str], value: Sequence[str], f: Callable, result: str, coords: Coords = ("v0", "v1")) -> DataFrame:
    """``reduce_trace`` in product order: ``f`` sees a key's values at each of its points.

    A group is one point of one key.  Groups come one after the other as rows in order, numbered from 1 in each, so a
    task calls ``f`` for many of them in one Arrow batch and holds one point's distinct values.
    """
    live, points, changes = _live(tr, key, value, coords)
    kind = dict(live.dtypes)
    spec = ", ".join([f"`_k` {kind['_k']}", *(f"`{c}` {kind[c]}" for c in coords), result, f"{M} bigint"])
    shape = arrow_schema(spec)
    at, width = ["_k", *coords], 1 + len(coords)

    def answered(places: pa.RecordBatch, groups: list[list]) -> pa.RecordBatch:
        """The answers of ``groups``, whose key and point are the rows of ``places``; Spark has sorted them as ``in_order`` does."""
        said = [(i, (*v, m)) for i, g in enumerate(groups) for v, m in f(g)]
        same = [places.column(c).take(pa.array([i for i, _ in said], pa.int64())).cast(shape.field(c).type) for c in at]
        return pa.RecordBatch.from_arrays([*same, *columns_of([r for _, r in said], pa.schema(list(shape)[width:]))], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = None, []  # the group that may go on in the next batch
        for batch in batches:
            starts = [i for i, n in enumerate(batch.column("_n").to_pylist()) if n == 1]
            rows = list(zip(rows_of([batch.column(c) for c in value]), batch.column("_net").to_pylist()))
            last += rows[:starts[0]] if starts else rows
            if not starts:
                continue
            if place is not None:
                yield answered(place, [last])
            if len(starts) > 1:
                yield answered(batch.select(at).take(pa.array(starts[:-1], pa.int64())), [rows[a:b] for a, b in pairwise(starts)])
            place, last = batch.select(at).take(pa.array(starts[-1:], pa.int64())), rows[starts[-1]:]
        if place is not None:
            yield answered(place, [last])

    numbered = live.withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy(*value)))
    answers = numbered.mapInArrow(run, spec)
    names = [c for c in answers.columns if c not in ("_k", M, *coords)]
    return _from_answers(answers, points, changes, key, names, coords)

"""Helpers that replay a key's changes in version order inside Spark tasks.

Rows arrive partitioned by key and sorted by (key, version), already summed to one row for each
(key, value, version).  A task streams over them and holds only the current key's live values, not
its history, so a key with a long history is bounded by its distinct values.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.values import arrow_schema, columns_of, rank, rows_of
from tidemark.sources import M

Weighted = list[tuple[tuple, int]]


class RunningExtreme:
    """Least (or greatest) live value under insertions and deletions: a heap with lazy deletion."""

    def __init__(self, greatest: bool):
        self.greatest, self.net, self.heap = greatest, {}, []

    def _entry(self, v):
        return (_Reversed(rank(v)) if self.greatest else rank(v)), v

    def apply(self, changes: Weighted) -> None:
        for v, m in changes:
            new = self.net.get(v, 0) + m
            if new < 0:
                raise ValueError(f"negative net multiplicity of {v}")
            if new and v not in self.net:
                heapq.heappush(self.heap, self._entry(v))
            if new:
                self.net[v] = new
            else:
                self.net.pop(v, None)

    def answer(self) -> Weighted:
        while self.heap:
            top = self.heap[0][1]
            if top in self.net:
                return [(top, 1)]
            heapq.heappop(self.heap)
        return []


class _Reversed:
    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


def in_order(net: dict) -> Weighted:
    """(value, multiplicity) by value, nulls first."""
    return sorted(net.items(), key=lambda e: rank(e[0]))


class Replay:
    """A key's weighted values and what a user function makes of them."""

    def __init__(self, f: Callable[[Weighted], Weighted], empty_too: bool = False):
        self.f, self.empty_too, self.net = f, empty_too, {}

    def apply(self, changes: Weighted) -> None:
        for v, m in changes:
            new = self.net.get(v, 0) + m
            if new:
                self.net[v] = new
            else:
                self.net.pop(v, None)

    def answer(self) -> Weighted:
        return self.f(in_order(self.net)) if self.net or self.empty_too else []


def changes_between(old: Weighted, new: Weighted) -> Weighted:
    net: dict[tuple, int] = {}
    for rows, sign in ((old, -1), (new, 1)):
        for v, m in rows:
            net[v] = net.get(v, 0) + sign * m
    return in_order({v: m for v, m in net.items() if m})


def replay(tr: DataFrame, key: Sequence[str], value: Sequence[str], make: Callable[[], object], result: str, version: str = "version", empty_too: bool = False) -> DataFrame:
    """Changes of a key's answer at each version that touches it; ``result`` names its columns.

    ``empty_too``: versions whose changes cancel are seen too.
    """
    types = dict(tr.dtypes)
    summed = tr.groupBy(*key, *value, version).agg(F.sum(M).alias(M)).where(F.lit(True) if empty_too else F.col(M) != 0)
    dealt = summed.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, version, *value)
    spec = ", ".join([*(f"`{k}` {types[k]}" for k in key), result, f"{M} bigint", f"`{version}` {types[version]}"])
    schema, width = arrow_schema(spec), len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, said, pending = None, None, [], []

        def close():
            nonlocal said
            state.apply(pending)
            new = state.answer()
            rows = [(*at[0], *v, m, at[1]) for v, m in changes_between(said, new)]
            said = new
            return rows

        for batch in batches:
            out = []
            for row in rows_of([batch.column(c) for c in (*key, version, *value, M)]):
                here = (row[:width], row[width])
                if here != at:
                    if at is not None:
                        out += close()
                    if at is None or here[0] != at[0]:
                        state, said = make(), []
                    at, pending = here, []
                pending.append((row[width + 1:-1], row[-1]))
            yield pa.RecordBatch.from_arrays(columns_of(out, schema), schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays(columns_of(close(), schema), schema=schema)

    return dealt.mapInArrow(run, spec)

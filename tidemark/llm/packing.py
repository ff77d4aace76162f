"""Best-fit packing of token sequences, improved by swap-based local search.

A document longer than the sequence is cut so that only its first piece is shorter.  Full pieces
fill sequences of their own.  The short ones are dealt at random (by a hash, so a hot source or a
crowd of equal lengths spreads) to groups of about ``GROUP`` pieces; the number of groups grows
with the table.  Each group is packed best-fit decreasing, and its underfull bins are searched:
moves and one-for-one or two-for-one exchanges that raise the sum of squared fills, until none is
left or the bins are as few as the lengths allow.  The lightest bin of each group is opened again
and packed with those of other groups, level by level until one group holds them all, so that a
large table does not keep an underfull bin for every group.

Defined results: a null text counts as empty and is its end id; rows without a doc_id and repeated
rows are packed like any other, each once; other columns never reach a task; ties go to the
earlier bin; an empty table gives an empty result.  A very long text's ids are held in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import documents, saved
from tidemark.llm.tokens import encoder

LENGTH = 2048
GROUP = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
OUT = PIECES + ", sequence_id long, offset long"


def _cutter(path: str, spaced: bool, end_id: int, length: int):
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, ids in zip(b.column("doc_id").to_pylist(), encoder(path, spaced).encode_all(b.column("text"))):
                ids = np.r_[ids, end]
                n = len(ids)
                stop, start, piece = (n - 1) % length + 1, 0, 0
                while start < n:
                    rows.append((d, piece, start, stop - start, zlib.crc32(ids[start:stop])))
                    start, stop, piece = stop, stop + length, piece + 1
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # distinct rooms with a bin, ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins


def _pairs(bins: list[list[int]], size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, bin) of pairs of pieces that share an underfull bin, one for each pair of lengths."""
    first, second, owner = [], [], []
    for b, members in enumerate(bins):
        if len(members) < 2 or size[members].sum() >= capacity:
            continue
        own = np.array(members)
        lengths, one, many = np.unique(size[own], return_index=True, return_counts=True)
        i, j = np.triu_indices(len(lengths), 1)
        first.append(own[one[i]])
        second.append(own[one[j]])
        twice = np.flatnonzero(many > 1)
        for t in twice.tolist():
            two = own[size[own] == lengths[t]][:2]
            first.append(two[:1])
            second.append(two[1:])
        owner.append(np.full(len(i) + len(twice), b))
    if not first:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(first), np.concatenate(second), np.concatenate(owner)


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins that raise the sum of squared fills.

    Bins are taken from the lightest on.  For each of a bin's pieces another underfull bin is sought
    that takes it outright (move), for a shorter one (one for one) or for two that are shorter
    together (two for one), the one that is fullest afterwards, if it is then fuller than the
    lighter bin was.  Each step raises the sum of squares, which is bounded, so the search ends: when
    a pass over all bins changes nothing, or the bins are as few as the sum of lengths allows.
    """
    bins = [list(b) for b in bins]
    size = np.asarray(lengths, dtype=np.int64)
    home = np.zeros(len(size), dtype=np.int64)
    for b, members in enumerate(bins):
        home[members] = b
    fill = np.bincount(home, weights=size, minlength=len(bins)).astype(np.int64)
    fewest = -(-int(size.sum()) // capacity)
    used = int((fill > 0).sum())
    changed = True
    while changed and used > fewest:
        changed = False
        one, two, shared = _pairs(bins, size, capacity)
        both = size[one] + size[two]
        for light in np.argsort(fill, kind="stable").tolist():
            if used == fewest:
                break
            if not 0 < fill[light] < capacity:
                continue
            for i in sorted(bins[light], key=lambda k: -size[k]):
                s, now = int(size[i]), int(fill[light])
                best, back, to = -1, [], -1
                # how full is a bin with the piece?  Only underfull ones that end fuller than this one was count.
                after = np.where((fill > 0) & (fill < capacity), fill + s, 0)
                after[light] = 0
                after[after > capacity] = 0
                b = int(after.argmax())
                if after[b] > now:
                    best, to = int(after[b]), b
                if best < capacity:
                    gone = fill[home] - size  # fill without each piece
                    after = np.where((size < s) & (fill[home] < capacity) & (home != light) & (gone + s <= capacity), gone + s, 0)
                    j = int(after.argmax())
                    if after[j] > max(best, now):
                        best, back, to = int(after[j]), [j], int(home[j])
                if best < capacity and len(both):
                    there = (home[one] == shared) & (home[two] == shared) & (shared != light) & (both < s)
                    after = np.where(there & (fill[shared] < capacity), fill[shared] - both + s, 0)
                    after[after > capacity] = 0
                    k = int(after.argmax())
                    if after[k] > max(best, now):
                        best, back, to = int(after[k]), [int(one[k]), int(two[k])], int(shared[k])
                if to < 0:
                    continue
                changed = True
                given = int(size[back].sum())
                bins[light].remove(i)
                bins[to].append(i)
                home[i] = to
                for j in back:
                    bins[to].remove(j)
                    bins[light].append(j)
                    home[j] = light
                fill[light] += given - s
                fill[to] += s - given
                if not fill[light]:
                    used -= 1
                    break
    return [b for b in bins if b]


def _pack(capacity: int, level: int):
    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy().astype(np.int64)
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset, tail = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        base = (level << 56) + (int(group.column("g")[0].as_py()) << 24)
        for k, members in enumerate(bins):
            sequence[members] = base + k
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        fills = [int(lengths[b].sum()) for b in bins]
        lightest = bins[int(np.argmin(fills))]
        tail[lightest] = min(fills) < capacity
        return (group.drop_columns(["g"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
                .append_column("tail", pa.array(tail)))
    return run


def pieces(docs: DataFrame, path: str, spaced: bool = True, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    return documents(docs).mapInArrow(_cutter(path, spaced, end_id, length), PIECES)


def pack(docs: DataFrame, path: str, spaced: bool = True, end_id: int = 0, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = saved(pieces(docs, path, spaced, end_id, length), "pieces")
    full = cut.where(F.col("length") == length).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = cut.where(F.col("length") < length)
    done, level = [full], 0
    while (n := open_.count()):
        groups = -(-n // group)
        dealt = open_.withColumn("g", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
        packed = saved(dealt.groupBy("g").applyInArrow(_pack(length, level), OUT + ", tail boolean"), "packed")
        done.append(packed.where("not tail" if groups > 1 else "true").drop("tail"))
        if groups == 1:
            break
        open_, level = packed.where("tail").select(*cut.columns), level + 1
    return reduce(DataFrame.unionByName, done)

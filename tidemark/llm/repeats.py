"""Repeated passages: a logarithmic family of sparse suffix arrays, in Spark.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id.

*Sampled suffixes.*  Every string of LENGTH bytes holds an anchor, its smallest hash of ``K`` bytes, and
equal strings have it at the same place.  A suffix is kept where it starts at an anchor, with the
hash of these K bytes (``key``), the hash of all that strings over this anchor can hold (``ctx``: LENGTH - K
bytes before and LENGTH bytes from it, cut at the document's ends) and the smallest id that has it.

*Levels.*  Documents come in batches of ascending ids.  A batch's suffixes are dealt by range of the key
and sorted to one array a shard; the array is scanned along the arrays of the existing levels, and then
becomes a level of its own, which merges with the last one as long as that is of its size or smaller.  Levels hold
no ctx twice.

*Answers.*  Where a ctx is known from a smaller id, all strings over the anchor repeat.  Otherwise, where other
contexts share the key, their bytes are fetched from the blocks of documents that hold them first, strings are
compared place by place, and the first holder gets the places that repeat as bits of a number.  Documents travel as blocks of
about ``BLOCK_BYTES``, dealt by the task that first read them; a passage that many documents share is one entry
a block.

Null text is empty; null ids count as smaller than any other, and rows of equal id as one document, so that they do not
remove each other; documents shorter than LENGTH keep all; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import documents, give_back, saved
from tidemark.scratch import discard

LENGTH, K = 50, 16
BEFORE = LENGTH - K        # places at which a string over an anchor may start
WIDE = BEFORE + LENGTH     # bytes of a context
BATCHES = 4
BATCH_BYTES = 1 << 40      # larger tables come in more batches
BLOCK_BYTES = 2 << 20
SHARD_SUFFIXES = 1 << 18   # suffixes of all levels in a shard, about
STEPS = 1 << 12          # of the table by which keys are dealt
ROW_SUFFIXES = 1 << 15     # of a row of an array, so that rows stay small for Spark
SUFFIXES = 0.06            # anchors a byte: 2 / (BEFORE + 2), measured 0.058
PIECE = 1 << 18            # bytes whose anchors are sought at once
LEAST = -(1 << 63)         # null ids

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_32, _29 = np.uint64(32), np.uint64(29)
_ALL = np.uint64(2**64 - 1)


def _words(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from every place as a number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:len(buf)] = buf
    return np.ndarray((len(buf),), "<u8", padded, strides=(1,)).copy()


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> _32
    h *= _C1
    h ^= h >> _29
    return h


def _slide(x: np.ndarray, width: int, pick, forward: bool) -> np.ndarray:
    """Extreme over ``width`` places from each one on (or up to it), by doubling."""
    span = 1
    while span < width:
        d = min(span, width - span)
        if forward:
            x[:-d] = pick(x[:-d], x[d:])
        else:
            x[d:] = pick(x[d:], x[:-d].copy())
        span += d
    return x


def _sought(data: np.ndarray, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray, first: int, last: int):
    """(places, document of each, key, ctx, bytes before, bytes from it) of anchors of strings that start in [first, last).

    ``data[lo:hi]`` holds parts of the documents that begin and end at ``starts`` and ``ends``.
    """
    buf = data[lo:hi]
    n = len(buf)
    inner = np.minimum(ends, hi) - np.maximum(starts, lo)
    doc = np.repeat(np.arange(len(starts)), inner)
    rest = ends[doc] - (lo + np.arange(n))  # bytes to the document's end
    v = _words(buf)
    key = v * _C2
    key[:n - 8] ^= (v[8:] + _C3) * _C1
    _mixed(key)
    small = (key >> _32).astype(np.uint32)
    np.clip(small, 1, 2**32 - 2, out=small)
    small[rest < K] = 2**32 - 1
    least = _slide(small.copy(), BEFORE + 1, np.minimum, True)
    least[rest < LENGTH] = 0
    least[:max(0, first - lo)] = 0
    least[max(0, last - lo):] = 0
    most = _slide(least, BEFORE + 1, np.maximum, False)
    at = np.flatnonzero(small == most)
    doc, rest = doc[at], np.minimum(rest[at], LENGTH)
    before = np.minimum(at + lo - starts[doc], BEFORE)
    ctx = np.full(len(at), _C3) + (before * 64 + rest).astype(np.uint64)
    whole = (before == BEFORE) & (rest == LENGTH)
    for o in (*range(-BEFORE, LENGTH - 8, 8), LENGTH - 8):
        place = at + o
        w = v[np.clip(place, 0, n - 1)]
        cut = np.flatnonzero(~whole)
        if len(cut):
            # bytes outside the document count as zeros
            low, high = np.clip(-before[cut] - o, 0, 8), np.clip(o + 8 - rest[cut], 0, 8)
            off = np.clip(-place[cut], 0, 8)  # before the buffer's own begin: shift the first bytes up
            x = np.where(off < 8, w[cut] << (8 * np.minimum(off, 7)).astype(np.uint64), 0)
            keep = np.where(low < 8, _ALL << (8 * np.minimum(low, 7)).astype(np.uint64), 0) & np.where(high < 8, _ALL >> (8 * np.minimum(high, 7)).astype(np.uint64), 0)
            w[cut] = x & keep
        ctx = _mixed((ctx ^ w) * _C2)
    return at + lo, doc, key[at], ctx, before, rest


def anchors(data: np.ndarray, bounds: np.ndarray):
    """Anchors of all documents ``data[bounds[k]:bounds[k + 1]]``, in order, as one set of arrays (``_sought``)."""
    found, k, count = [], 0, len(bounds) - 1
    while k < count:
        j = max(k + 1, int(np.searchsorted(bounds, bounds[k] + PIECE, side="right")) - 1)
        starts, ends = bounds[k:j], bounds[k + 1:j + 1]
        if ends[-1] - starts[0] <= PIECE or j > k + 1:
            if ends[-1] - starts[0] >= LENGTH:
                x = _sought(data, int(starts[0]), int(ends[-1]), starts, ends, int(starts[0]), int(ends[-1]))
                found.append((x[0], x[1] + k, *x[2:]))
        else:  # a long document in overlapping pieces
            known = -1
            for s in range(int(starts[0]), int(ends[0]), PIECE):
                e = min(s + PIECE, int(ends[0]))
                x = _sought(data, max(int(starts[0]), s - BEFORE), min(int(ends[0]), e + WIDE), starts, ends, s, e)
                new = x[0] > known  # the piece before may have met the first ones
                found.append((x[0][new], x[1][new] + k, *(y[new] for y in x[2:])))
                known = int(x[0][-1]) if len(x[0]) else known
        k = j
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(c) for c in zip(*found))


def _texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds of each)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    at = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def _ids(column) -> np.ndarray:
    return column.fill_null(LEAST).to_numpy() if isinstance(column, pa.ChunkedArray) else column.fill_null(LEAST).to_numpy(zero_copy_only=False)


def _firsts(ctx: np.ndarray, low: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each ctx once, with its smallest ``low`` and what stands beside that."""
    order = np.lexsort((low, ctx))
    ctx, low = ctx[order], low[order]
    head = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else order
    return ctx[head], low[head], *(x[order][head] for x in more)


def _planes(x: np.ndarray, steps: bool = False) -> bytes:
    """Numbers by byte planes (ascending ones as steps), which compress where they are small."""
    x = np.ascontiguousarray(x).view(np.uint64)
    if steps and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes, steps: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if steps else x


_PACKED = "kind int, place bigint, a binary, b binary, c binary, d binary, e binary"
_PACKED_ARROW = pa.schema([("kind", pa.int32()), ("place", pa.int64()), *((x, pa.binary()) for x in "abcde")])
ANSWER, REQUEST, LEVEL, PLACES, BYTES, SUFFIX = range(6)


def _packed(rows: list[tuple]) -> pa.Table:
    give_back()
    rows = [(*r, *(None,) * (7 - len(r))) for r in rows]
    columns = zip(*rows) if rows else [[]] * 7
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PACKED_ARROW)], schema=_PACKED_ARROW)


def _rows(table: pa.Table | pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(table.column(n).to_pylist() for n in names))


def _split(where: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(value of ``where``, the columns' items that have it)."""
    order = np.argsort(where, kind="stable")
    where = where[order]
    columns = [c[order] for c in columns]
    heads = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else order
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(where)]):
        yield int(where[a]), *(c[a:b] for c in columns)


def _dealing(shards: int):
    """Keys to shards: ranges of the key that hold about as many anchors each.

    Anchors are the smallest of BEFORE + 1 hashes, so small keys are far more frequent than large ones.  The driver makes the
    bounds, so that all machines have the same.
    """
    low, high = np.zeros(STEPS - 1), np.ones(STEPS - 1)
    wanted = np.arange(1, STEPS) / STEPS
    for _ in range(60):  # the share of anchors up to x is 1 - (n + 2) / 2 * p**(n + 1) + n / 2 * p**(n + 2), n = BEFORE, p = 1 - x
        x = (low + high) / 2
        less = 1 - (BEFORE + 2) / 2 * (1 - x) ** (BEFORE + 1) + BEFORE / 2 * (1 - x) ** (BEFORE + 2) < wanted
        low, high = np.where(less, x, low), np.where(less, high, x)
    bounds = np.concatenate([[0], (low * 2**32).astype(np.int64), [2**32]])

    def shard_of(key: np.ndarray) -> np.ndarray:
        x = (key >> _32).astype(np.int64)
        k = np.searchsorted(bounds, x, side="right") - 1
        share = (k << 20) + ((x - bounds[k]) << 20) // (bounds[k + 1] - bounds[k])  # of STEPS * 2**20 = 2**32
        return share * shards >> 32
    return shard_of


def _suffixes(shard_of):
    """Blocks of documents to their suffixes, one row for each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None

        def close():
            ctx, low, key, spot = _firsts(*(np.concatenate(c) for c in zip(*held)))
            rows = [(SUFFIX, shard, k.tobytes(), c.tobytes(), _planes(x), at.to_bytes(8, "little"), _planes(y))
                    for shard, k, c, x, y in _split(shard_of(key), key, ctx, low, spot)]
            yield from _packed(rows).to_batches(max_chunksize=256)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for a, b in _stretches(blocks):
                if held and (at != int(blocks[a]) or size >= BLOCK_BYTES):
                    yield from close()
                    held, size = [], 0
                at = int(blocks[a])
                part = batch.slice(a, b - a)
                data, bounds = _texts(part.column("text"))
                place, doc, key, ctx, _, _ = anchors(data, bounds)
                held.append((ctx, _ids(part.column("doc_id"))[doc], key, part.column("start").to_numpy()[doc] + place - bounds[doc]))
                size += len(data) + 1
        if held:
            yield from close()
        held = batch = None
        give_back()
    return run


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return list(zip(heads.tolist(), [*heads[1:].tolist(), len(x)]))


def _level_rows(shard: int, key: np.ndarray, ctx: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """A sorted array in rows."""
    cuts = [(k, k + ROW_SUFFIXES) for k in range(0, len(key), ROW_SUFFIXES)]
    return [(LEVEL, shard, _planes(key[a:b], True), ctx[a:b].tobytes(), *(_planes(x[a:b]) for x in more)) for a, b in cuts]


def _scan(batch_rows: pa.Table, level_rows: pa.Table, keep: bool) -> pa.Table:
    """A shard's new array along the arrays of the levels: answers, requests for bytes, and, to ``keep``, the array that becomes a level."""
    if not batch_rows.num_rows:
        return _packed([])
    parts = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), _from_planes(c).view(np.int64), _from_planes(e).view(np.int64), int.from_bytes(d, "little"))
             for a, b, c, d, e in _rows(batch_rows, *"abcde")]
    shard = batch_rows.column("place")[0].as_py()
    key, ctx, low, spot = (np.concatenate([p[k] for p in parts]) for k in range(4))
    block = np.concatenate([np.full(len(p[0]), p[4], np.int64) for p in parts])
    new = np.ones(len(key), dtype=bool)
    keys = np.unique(key)
    for a, *others in _rows(level_rows, *"abcde"):
        k = _from_planes(a, True)
        here = keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k
        if here.any():
            x, y, z, w = np.frombuffer(others[0], np.uint64)[here], *(_from_planes(o).view(np.int64)[here] for o in others[1:])
            key, ctx, low, block, spot, new = np.r_[key, k[here]], np.r_[ctx, x], np.r_[low, y], np.r_[block, z], np.r_[spot, w], np.r_[new, np.zeros(len(x), bool)]
    order = np.lexsort((new, low, ctx, key))  # what a level has goes first among equals
    key, ctx, low, block, spot, new = key[order], ctx[order], low[order], block[order], spot[order], new[order]
    head = np.r_[True, (ctx[1:] != ctx[:-1]) | (key[1:] != key[:-1])]
    group = np.cumsum(head) - 1
    first = low[head][group]
    out = []
    told = np.flatnonzero(new & (low > first))
    for b, c, x in _split(block[told], ctx[told], first[told]):
        out.append((ANSWER, b, c.tobytes(), _planes(x)))
    if keep:
        level = head & new
        out += _level_rows(shard, key[level], ctx[level], low[level], block[level], spot[level])
    # from here on the first holders of each ctx; rows of one id may lie in several blocks
    holds = head | (new & (low == first))
    key, ctx, low, block, spot, new = key[holds], ctx[holds], low[holds], block[holds], spot[holds], new[holds]
    of_key = np.r_[True, key[1:] != key[:-1]]
    start, group = np.flatnonzero(of_key), np.cumsum(of_key) - 1
    asks = new & (low > np.minimum.reduceat(low, start)[group])
    # what asks, and what may be the earlier holder of one of its strings
    upto = np.full(len(low), LEAST)
    upto[asks] = low[asks]
    wanted = np.flatnonzero(asks | (low < np.maximum.reduceat(upto, start)[group]))
    for b, c, k, x, y in _split(block[wanted], ctx[wanted], key[wanted], low[wanted], spot[wanted]):
        out.append((REQUEST, b, c.tobytes(), k.tobytes(), _planes(x), y.tobytes()))
    return _packed(out)


def _fetched(shard_of):
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        """The bytes of the contexts that a block is asked for, by shard."""
        if not asked.num_rows or not docs.num_rows:
            return _packed([])
        block = asked.column("place")[0].as_py()
        want, key, low, spot = (np.concatenate(c) for c in zip(*((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), _from_planes(c), np.frombuffer(d, np.int64)) for a, b, c, d in _rows(asked, *"abcd"))))
        data, bounds = _texts(docs.column("text"))
        starts = docs.column("start").to_numpy()
        order = np.argsort(starts, kind="stable")
        doc = order[np.searchsorted(starts[order], spot, side="right") - 1]
        at = bounds[doc] + spot - starts[doc]
        before, rest = np.minimum(at - bounds[doc], BEFORE), np.minimum(bounds[doc + 1] - at, LENGTH)
        off = np.arange(-BEFORE, LENGTH)
        body = data[np.clip(at[:, None] + off, 0, len(data) - 1)]
        body[(off < -before[:, None]) | (off >= rest[:, None])] = 0
        sides = np.stack([before, rest], axis=1).astype(np.uint8)
        return _packed([(BYTES, s, np.stack([k, w], axis=1).tobytes(), _planes(x), sd.tobytes(), bd.tobytes(), block.to_bytes(8, "little"))
                        for s, k, w, x, sd, bd in _split(shard_of(key), key, want, low, sides, body)])
    return run


def _compared(batch: int, batches: int):
    def run(rows: pa.Table) -> pa.Table:
        """Strings over contexts of one key, place by place: those that an earlier holder has."""
        parts = []
        for a, b, c, d, e in _rows(rows, "a", "b", "c", "d", "e"):
            named = np.frombuffer(a, np.uint64).reshape(-1, 2)
            parts.append((named[:, 0], named[:, 1], _from_planes(b).view(np.int64), np.frombuffer(c, np.uint8).reshape(-1, 2), np.frombuffer(d, np.uint8).reshape(-1, WIDE),
                          np.full(len(named), int.from_bytes(e, "little"))))
        key, ctx, low, sides, body, block = (np.concatenate(c) for c in zip(*parts))
        told = np.zeros(len(key), np.int64)
        for i in range(BEFORE + 1):  # strings that start i bytes before the anchor
            fits = np.flatnonzero((sides[:, 0] >= i) & (sides[:, 1] >= LENGTH - i))
            if len(fits) < 2:
                continue
            text = np.zeros((len(fits), -(-LENGTH // 8) * 8), np.uint8)
            text[:, :LENGTH] = body[fits, BEFORE - i:BEFORE - i + LENGTH]
            h = key[fits].copy()
            for w in text.view(np.uint64).T:
                h = _mixed((h ^ w) * _C2)
            order = np.lexsort((low[fits], h))
            h, at = h[order], fits[order]
            first = np.r_[True, h[1:] != h[:-1]]
            group = np.cumsum(first) - 1
            told[at[low[at] > low[at][np.flatnonzero(first)][group]]] |= 1 << i
        own = np.flatnonzero((told != 0) & (block % batches == batch))
        return _packed([(PLACES, b, c.tobytes(), x.tobytes()) for b, c, x in _split(block[own], ctx[own], told[own])])
    return run


_RESULT = "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", _SPAN)])


def _lookup(names: list[np.ndarray], values: list[np.ndarray], of: np.ndarray, default: int) -> np.ndarray:
    """The smallest value of each of ``of`` under its name."""
    if not names:
        return np.full(len(of), default, np.int64)
    names, values = _firsts(np.concatenate(names), np.concatenate(values))
    at = np.minimum(np.searchsorted(names, of), len(names) - 1)
    return np.where(names[at] == of, values[at], default)


def _removed(docs: pa.Table, told: pa.Table) -> pa.Table:
    """A block's documents without what repeats."""
    if not docs.num_rows:
        return _RESULT_ARROW.empty_table()
    data, bounds = _texts(docs.column("text"))
    ids = _ids(docs.column("doc_id"))
    at, doc, _, ctx, before, rest = anchors(data, bounds)
    low = ids[doc]
    names, values, marks, places = [ctx], [low], [], []
    for kind, a, b in _rows(told, "kind", "a", "b"):
        if kind == ANSWER:
            names.append(np.frombuffer(a, np.uint64))
            values.append(_from_planes(b).view(np.int64))
        else:
            marks.append(np.frombuffer(a, np.uint64))
            places.append(np.frombuffer(b, np.int64))
    first = _lookup(names, values, ctx, 0)
    cover = np.zeros(len(data) + 1, np.int32)
    late = low > first
    np.add.at(cover, (at - before)[late], 1)
    np.add.at(cover, (at + rest)[late], -1)
    bits = np.where(late, 0, _lookup(marks, places, ctx, 0))
    some = np.flatnonzero(bits)
    for i in range(BEFORE + 1):
        here = at[some[(bits[some] >> i & 1) == 1]] - i
        np.add.at(cover, here, 1)
        np.add.at(cover, here + LENGTH, -1)
    np.cumsum(cover, out=cover)
    gone = cover[:-1] > 0
    del cover
    # maximal runs within documents
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins, stops = gone.copy(), gone.copy()
    begins[1:] &= ~gone[:-1] | edge[1:-1]
    stops[:-1] &= ~gone[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    of = np.searchsorted(starts, bounds)
    give_back()
    shift = np.repeat(bounds[:-1], np.diff(of))
    lost = np.r_[0, np.cumsum(ends - starts)][of]  # bytes that went before each document
    left, upto = data[~gone], bounds - lost
    spans = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - shift, pa.int64()), pa.array(ends - shift, pa.int64())], ["start", "end"]))
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(upto), pa.py_buffer(left)]).cast(pa.binary())
    return pa.Table.from_arrays([docs.column("doc_id"), pa.array(np.diff(bounds)), kept, spans], schema=_RESULT_ARROW)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _short_batches(spark, rows: int = 1000):
    """Texts are long: fewer of them go to a Python worker at once."""
    was = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, was)


class RepeatIndex:
    """The levels.  ``add`` takes documents whose ids are not smaller than any before, and returns them without what repeats."""

    def __init__(self, spark, shards: int, batches: int, block_bytes: int = BLOCK_BYTES):
        self.spark, self.shard_of, self.batches, self.block_bytes = spark, _dealing(shards), batches, block_bytes
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, a row a shard)
        self.texts: list[DataFrame] = []

    def _blocks(self, docs: DataFrame, batch: int) -> DataFrame:
        limit, batches = self.block_bytes, self.batches

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            size, number, own = 0, 0, TaskContext.get().partitionId() << 24
            for part in parts:
                blocks, starts = [], []
                for n in np.diff(_texts(part.column("text"))[1]).tolist():
                    blocks.append((own + number) * batches + batch)
                    starts.append(size)
                    size += n + 64
                    if size >= limit:
                        size, number = 0, number + 1
                whole = pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(starts, pa.int64()), part.column("doc_id"), part.column("text")], names=["block", "start", "doc_id", "text"])
                for k in range(0, len(blocks), 512):
                    yield whole.slice(k, 512)
            part = whole = None
            give_back()

        with _short_batches(self.spark):
            return saved(documents(docs).mapInArrow(run, "block bigint, start bigint, doc_id bigint, text string"), "repeat-texts", compression="zstd")

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """``last`` says that nothing more will come, so that no level is kept."""
        batch = len(self.texts)
        texts = self._blocks(docs, batch)
        self.texts.append(texts)
        none = self.spark.createDataFrame([], _PACKED)
        suffixes = texts.mapInArrow(_suffixes(self.shard_of), _PACKED)
        stored = none
        for _, level in self.levels:
            stored = stored.unionByName(level)
        parts = [(ANSWER, "answers"), (REQUEST, "requests"), *([] if last else [(LEVEL, "level")])]
        with _short_batches(self.spark):
            scanned = saved(suffixes.groupBy("place").cogroup(stored.groupBy("place")).applyInArrow(lambda new, known: _scan(new, known, not last), _PACKED), "repeat-scan", compression="zstd")
            if last:
                discard(*(x for _, x in self.levels))
            answers, asked, *level = (saved(scanned.where(F.col("kind") == k), f"repeat-{n}", compression="zstd") for k, n in parts)
            discard(scanned)
            holders = self.texts[0]
            for t in self.texts[1:]:
                holders = holders.unionByName(t)
            bodies = holders.withColumnRenamed("block", "place").groupBy("place").cogroup(asked.groupBy("place")).applyInArrow(_fetched(self.shard_of), _PACKED)
            places = saved(bodies.groupBy("place").applyInArrow(_compared(batch, self.batches), _PACKED), "repeat-places", compression="zstd")
            discard(asked)
        told = answers.unionByName(places)
        out = texts.withColumnRenamed("block", "place").groupBy("place").cogroup(told.groupBy("place")).applyInArrow(_removed, _RESULT)
        if not last:
            self._keep(*level)
        return out

    def _keep(self, level: DataFrame) -> None:
        """A new level; levels of its size or smaller merge with it, array by array."""
        size, parts = 1, [level]
        while self.levels and self.levels[-1][0] <= size:
            n, other = self.levels.pop()
            size += n
            parts.append(other)
        if len(parts) > 1:
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            level = saved(every.groupBy("place").applyInArrow(_merged, _PACKED), "repeat-level", compression="zstd")
            discard(*parts)
        self.levels.append((size, level))


def _merged(rows: pa.Table) -> pa.Table:
    key, ctx, *more = (np.concatenate(c) for c in zip(*((_from_planes(a, True), np.frombuffer(b, np.uint64), *map(_from_planes, others)) for a, b, *others in _rows(rows, *"abcde"))))
    order = np.lexsort((ctx, key))
    return _packed(_level_rows(rows.column("place")[0].as_py(), key[order], ctx[order], *(x[order] for x in more)))


def without_repeats(docs: DataFrame, batches: int = BATCHES, shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, kept: the bytes that stay, spans: what went, in bytes) of every row of ``docs``."""
    docs = documents(docs)
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(batches, -(-size // BATCH_BYTES))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size * SUFFIXES / SHARD_SUFFIXES) + 1)
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    index, out = RepeatIndex(spark, shards, batches, block_bytes), None
    for k in range(len(bounds) + 1):
        part = docs
        if k:
            part = part.where(F.col("doc_id") > bounds[k - 1])
        if k < len(bounds):
            inside = F.col("doc_id") <= bounds[k]
            part = part.where(inside | F.col("doc_id").isNull() if not k else inside)
        done = index.add(part, last=k == len(bounds))
        out = done if out is None else out.unionByName(done)
    return out


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return without_repeats(docs, **options).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

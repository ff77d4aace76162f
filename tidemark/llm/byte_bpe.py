"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves pre-tokens that are whole vocabulary entries through a minimal perfect hash over
the vocabulary (hash and displace: a key's bucket names the displacement that sends it to its own
slot; the slot's bytes are compared, so strangers are refused).  Tier two merges the others: their
bytes form a doubly linked list, and a heap yields the adjacent pair of the lowest rank.

Documents are read, cut and encoded in the scan's own tasks with no shuffle.  Each distinct chunk of
a batch is encoded once (``cutting``), and a worker keeps the ids of chunks in a bounded cache.

Defined results: null texts count as empty and have no ids; the hash of no ids is that of the empty
string; repeated rows are encoded each for itself, rows without a doc_id too; other columns never
reach a task.  Very long texts are cut in parts of about 4 MB, their ids hashed as they come; a
single word of any length goes over one heap, in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import eq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import documents
from tidemark.llm.cutting import spread
from tidemark.llm.tokens import BatchEncoder, Cache

SIDE_BY_SIDE = 1 << 16  # pre-tokens that are merged together


class PerfectHash:
    """A minimal perfect hash from byte strings to their index, by hash and displace.

    Keys are dealt to buckets by the high half of a 64-bit hash.  Buckets are placed from the
    largest on; a bucket takes the first displacement d for which (low + d * step + d * d) mod n are
    free and distinct, and buckets of one key, which come last, name a free slot outright.  ``find``
    compares the key that owns the slot, so it never answers wrongly.
    """

    def __init__(self, keys: list[bytes], per_bucket: float = 3.0):
        self.keys, self.n = keys, len(keys)
        self.buckets = max(1, int(self.n / per_bucket))
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        low, step = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), ((h >> np.uint64(20)).astype(np.int64) & 0xFFFFF) | 1
        bucket = ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        shift, slot = np.zeros(self.buckets, dtype=np.int64), np.full(self.n, -1, dtype=np.int64)
        free = np.ones(self.n, dtype=bool)
        by_bucket = np.argsort(bucket, kind="stable")
        many = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(many) - many
        for b in np.argsort(-many, kind="stable")[:int((many > 1).sum())].tolist():
            own = by_bucket[first[b]:first[b] + many[b]]
            d0, tries = 0, 16
            while True:
                d = np.arange(d0, d0 + tries)
                at = (low[own] + d[:, None] * step[own] + (d * d)[:, None]) % self.n
                fits = free[at].all(axis=1)
                if len(own) > 1:
                    order = np.sort(at, axis=1)
                    fits &= (order[:, 1:] != order[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(fits.argmax())
                    shift[b], slot[at[k]], free[at[k]] = d0 + k, own, False
                    break
                d0, tries = d0 + tries, min(4 * tries, 4096)
        alone, left = np.flatnonzero(many == 1), np.flatnonzero(free)
        shift[alone], slot[left] = -left - 1, by_bucket[first[alone]]
        self.shift, self.slot = shift, slot

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The index of each key, or -1 where it is not in the set."""
        if not self.n or not keys:
            return np.full(len(keys), -1, dtype=np.int64)
        h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        low, step = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), ((h >> np.uint64(20)).astype(np.int64) & 0xFFFFF) | 1
        d = self.shift[((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        i = self.slot[np.where(d < 0, -d - 1, (low + d * step + d * d) % self.n)]
        own = np.fromiter(map(eq, map(self.keys.__getitem__, i.tolist()), keys), bool, len(keys))
        return np.where(own, i, -1)


class PairTable:
    """What rank do two parts side by side have together?  An open hash table that answers arrays of pairs."""

    def __init__(self, joined: dict[int, int], base: int):
        self.base, self.mask = base, (1 << max(4, (4 * len(joined)).bit_length())) - 1
        self.key, self.rank = np.full(self.mask + 1, -1, dtype=np.int64), np.full(self.mask + 1, -1, dtype=np.int32)
        key = np.fromiter(joined, np.int64, len(joined))
        rank = np.fromiter(joined.values(), np.int32, len(joined))
        at = self._place(key)
        while len(key):
            # of those that want a free place the first takes it, the others go on to the next
            free = self.key[at] == -1
            taker = np.zeros(len(at), dtype=bool)
            taker[np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]]] = True
            self.key[at[taker]], self.rank[at[taker]] = key[taker], rank[taker]
            key, rank, at = key[~taker], rank[~taker], at[~taker] + 1 & self.mask

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(30)).astype(np.int64) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of a and b joined, or -1; a part of -1 joins with nothing."""
        key = a.astype(np.int64) * self.base + b
        key[(a < 0) | (b < 0)] = -2
        at = self._place(key)
        seen = self.key[at]
        found = np.where(seen == key, self.rank[at], -1)
        todo = np.flatnonzero((seen != key) & (seen != -1))
        key, at = key[todo], at[todo]
        while len(todo):
            at = at + 1 & self.mask
            seen = self.key[at]
            hit = seen == key
            found[todo[hit]] = self.rank[at[hit]]
            go = ~hit & (seen != -1)
            todo, key, at = todo[go], key[go], at[go]
        return found


class ByteBPE(BatchEncoder):
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        whole = sorted(ranks, key=ranks.__getitem__)
        self.whole, self.rank_of = PerfectHash(whole), np.array([ranks[k] for k in whole] or [0], dtype=np.int64)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.bytes_of[r] = k
        self.text_of = [str(r) for r in range(len(self.bytes_of))]
        # two parts side by side are told by their ranks: which rank has their bytes together?
        self.base = len(self.bytes_of)
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.joined = {ranks[k[:c]] * self.base + ranks[k[c:]]: r for k, r in ranks.items()
                       for c in range(1, len(k)) if k[:c] in ranks and k[c:] in ranks}
        self.pairs = PairTable(self.joined, self.base)
        self.cut = regex.compile(pattern)
        self.known = Cache()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry: lowest rank first, leftmost on ties."""
        n, base, get = len(piece), self.base, self.joined.get
        part = [self.byte[b] for b in piece]  # the rank of the part that starts here
        if -1 in part:
            raise ValueError("the vocabulary lacks a byte of the text")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the linked list of parts
        pair = [get(a * base + b, -1) for a, b in zip(part, part[1:])]  # the rank of this part and the next together
        pair.append(-1)
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if pair[i] != r:
                continue  # one of the two parts has changed since
            j = after[i]
            after[i] = k = after[j]
            part[i], pair[j] = r, -1
            if k < n:
                before[k] = i
                pair[i] = q = get(r * base + part[k], -1)
                if q >= 0:
                    heappush(heap, q * n + i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                pair[p] = q = get(part[p] * base + r, -1)
                if q >= 0:
                    heappush(heap, q * n + p)
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = after[i]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` for many pre-tokens: those of about a length go side by side, the longest one by one."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for width in (8, 16, 32, 64):
            own = np.flatnonzero((size > low) & (size <= width)).tolist()
            for k in range(0, len(own), SIDE_BY_SIDE):
                group = own[k:k + SIDE_BY_SIDE]
                for i, ids in zip(group, self._side_by_side([pieces[i] for i in group], width)):
                    out[i] = ids
            low = width
        for i in np.flatnonzero(size > low).tolist():
            out[i] = array("I", self.merge(pieces[i])).tobytes()
        return out

    def _side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        """A row for each pre-token: its linked parts, and its heap over their pairs.

        The heap is a tree of minima: leaf i holds (rank, i) of the pair that starts at part i, every
        other node the smaller of its children, so that the root is the pair to merge next.  A round
        merges one pair in every row and mends the ways from the changed leaves to the root.
        """
        rows, stride, bits = len(pieces), width + 1, width.bit_length() - 1
        size = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join([p.ljust(stride, b"\0") for p in pieces]), dtype=np.uint8).reshape(rows, stride)
        part = np.where(np.arange(stride) < size[:, None], np.array(self.byte, dtype=np.int32)[raw], -1)
        if (np.count_nonzero(part >= 0, axis=1) < size).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        pair = self.pairs.find(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(rows, width)
        none = np.int64(1 << 40)
        tree = np.full((rows, 2 * width), none, dtype=np.int64)
        tree[:, width:] = np.where(pair >= 0, pair.astype(np.int64) * width + np.arange(width), none)
        for low in [width >> k for k in range(1, width.bit_length())]:
            tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
        after = np.broadcast_to(np.arange(1, stride + 1, dtype=np.int16), (rows, stride)).ravel().copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int16), (rows, stride)).ravel().copy()
        part, tree = part.ravel(), tree.ravel()
        row = np.arange(rows)
        while True:
            top = tree[row * (2 * width) + 1]
            row, top = row[top < none], top[top < none]
            if not len(row):
                break
            r, i = top >> bits, top & (width - 1)
            at, leaves = row * stride, row * (2 * width)
            j = after[at + i]
            k = after[at + j]
            part[at + i], part[at + j] = r, -1
            after[at + i], before[at + k] = k, i
            p = before[at + i].astype(np.int64)
            has = p >= 0
            joined = self.pairs.find(r, part[at + k])
            tree[leaves + width + i] = np.where(joined >= 0, joined * np.int64(width) + i, none)
            tree[leaves + width + j] = none
            joined = self.pairs.find(part[(at + p)[has]], r[has])
            tree[(leaves + width + p)[has]] = np.where(joined >= 0, joined * np.int64(width) + p[has], none)
            for base, node in ((leaves, width + i), (leaves, width + j.astype(np.int64)), (leaves[has], (width + p)[has])):
                while True:
                    node = node >> 1
                    if not len(node) or not node[0]:
                        break
                    two = base + 2 * node
                    tree[base + node] = np.minimum(tree[two], tree[two + 1])
        part = part.reshape(rows, stride)[:, :width]
        left = part >= 0
        ids = part[left].astype("<u4").tobytes()
        stop = 4 * np.cumsum(left.sum(axis=1))
        return [ids[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]

    def _learn(self, chunks: list[bytes]) -> None:
        pieces: list[bytes] = []
        many: list[int] = []
        for c in chunks:
            if c.isascii() and b"'" not in c:
                pieces.append(c)  # of one kind, as ``cutting`` leaves them
                many.append(1)
            else:
                found = self.cut.findall(c.decode())
                pieces += [p.encode() for p in found]
                many.append(len(found))
        whole = self.whole.find(pieces)
        misses = np.flatnonzero(whole < 0).tolist()
        hits = np.where(whole >= 0, self.rank_of[whole], 0).astype("<u4").tobytes()
        ids = [hits[k:k + 4] for k in range(0, len(hits), 4)]
        for k, merged in zip(misses, self.merge_all([pieces[k] for k in misses])):
            ids[k] = merged
        if len(ids) == len(chunks):
            self.known.update(zip(chunks, ids))
        else:
            at = 0
            for c, n in zip(chunks, many):
                self.known[c] = ids[at] if n == 1 else b"".join(ids[at:at + n])
                at += n

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, column: pa.Array) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of their decimal text, SHA-256 of the decoded bytes) of each text in order."""
        at, many, ids_hash, back_hash = 0, 0, hashlib.sha256(), hashlib.sha256()
        for first, texts, chunk, numbers, found in self.numbered(column):
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            every, per_chunk = spread(numbers, sizes, np.frombuffer(b"".join(found), dtype="<u4"))
            stops = np.cumsum(np.add.reduceat(per_chunk, chunk)).tolist()
            begin = 0
            for t, stop in zip((texts + first).tolist(), stops):
                while at < t:
                    yield many, ids_hash.hexdigest(), back_hash.hexdigest()
                    at, many, ids_hash, back_hash = at + 1, 0, hashlib.sha256(), hashlib.sha256()
                if many:  # a further part of a very long text
                    ids_hash.update(b",")
                ids = every[begin:stop].tolist()
                ids_hash.update(",".join(map(self.text_of.__getitem__, ids)).encode())
                back_hash.update(self.decode(ids))
                many, begin = many + stop - begin, stop
        while at < len(column):
            yield many, ids_hash.hexdigest(), back_hash.hexdigest()
            at, many, ids_hash, back_hash = at + 1, 0, hashlib.sha256(), hashlib.sha256()


_codecs: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each worker process, kept between its tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            ids = [x.view(np.int32) for x in bpe.encode_all(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, raw binary) from (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            raw = [bpe.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one task, ids never leave it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            many, said, back = zip(*bpe.digests(b.column("text"))) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(many, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Language-model scoring by deleted interpolation over the whole corpus.

Model.  p(w | u) = l2[b] c(u w)/c(u) + l1[b] c(w)/N + l0[b] / (V + 1), where b is the bucket of the
context's frequency c(u).  The weights are learned by expectation-maximisation on held-out counts:
each training token in turn is held out, that is, its own occurrence is deleted from the counts
that predict it.  An ``end`` token closes each document and is the context of its first word.

Data flow.  Neither the vocabulary nor the bigrams fit one machine, so counts live in shards:

1.  Documents are dealt to blocks of about ``BLOCK_BYTES`` of text by a hash of doc_id and text, so
    that one id, or none, fills no block alone.  A block tokenizes its texts with numpy and sends each
    shard its *distinct* word and bigram hashes, sorted and compressed, with the block's training
    counts (a map-side combine; shards are ranges of the hash, one for ``SHARD_BYTES`` of text).
2.  A shard adds the counts up and replies to each block with the totals for what it asked.
3.  A block meets its replies again and has the exact counts c(u w), c(u), c(w) of every token.
    They are written once; EM and scoring read them.

Blocks and shards both grow with the text, so no task does; the number of requests is their product.

EM works on a histogram of (bucket, log ratios in steps of 0.05), whose size does not depend on the
corpus and which covers every training token.  All that crosses the driver is that histogram, N, V
and the weights.  Words are identified by 64-bit hashes: a sum of random byte weights times powers
of an odd number, mixed; among V words a clash has probability V * V / 2 ** 65.

Defined results: null and empty texts are one ``end`` token; rows without a doc_id count as fold 0;
repeated rows count as often as they occur; without any training token all counts are zero and the
model falls to 1 / (V + 1); other columns never reach a task; a very long text is hashed in parts and has its
block's memory to itself beside a few others.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import crc_fold, documents, saved
from tidemark.scratch import discard

FOLDS, HELD_OUT = 5, 1
CHUNK = 1 << 20
BLOCK_BYTES, SHARD_BYTES = 1 << 23, 1 << 24
STEP = 0.05
BUCKETS = np.array([1, 2, 3, 5, 9, 17, 65, 257, 1025, 16385, 1 << 20])  # context counts, by np.searchsorted
U64 = np.uint64


@lru_cache(maxsize=1)
def _tables():
    r = np.random.default_rng(20240131)
    weight = r.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
    odd = int(weight[0])
    power = np.ones(CHUNK * 2, dtype=U64)
    power[1:] = U64(odd)
    np.cumprod(power, out=power)
    inverse = np.ones(CHUNK * 2, dtype=U64)
    inverse[1:] = U64(pow(odd, -1, 1 << 64))
    np.cumprod(inverse, out=inverse)
    blank = np.zeros(256, dtype=bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return weight, power, inverse, blank


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


END = int(_mix(np.array([0x5E3D], dtype=U64))[0])


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its hash) in ASCII-lowered bytes."""
    weight, power, inverse, blank = _tables()
    b = np.frombuffer(raw.lower(), dtype=np.uint8)
    if len(b) > len(power):  # a word of more than a million bytes
        power, inverse = (np.cumprod(np.r_[U64(1), np.full(len(b) - 1, x[1], dtype=U64)]) for x in (power, inverse))
    word = ~blank[b]
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, dtype=U64)
    total = np.r_[U64(0), np.cumsum(weight[b] * power[:len(b)])]
    h = (total[stop] - total[start]) * inverse[start]
    return start, _mix(h + U64(0x9E3779B97F4A7C15) * (stop - start).astype(U64))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts in turn, each text's number of tokens), the end included."""
    parts: list[np.ndarray] = []
    many: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        size, j = 0, k
        while j < len(texts) and (j == k or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        if size > 2 * CHUNK:  # one very long text: hash it word by word range
            found = [_hash_words(piece)[1] for piece in _long_pieces(texts[k])]
            h = np.concatenate([*found, np.array([END], dtype=U64)])
            parts.append(h)
            many.append(np.array([len(h)]))
        else:
            start, h = _hash_words(b"\n".join(texts[k:j]))
            first = np.cumsum([0] + [len(t) + 1 for t in texts[k:j - 1]])
            at = np.r_[np.searchsorted(start, first), len(start)]
            n = np.diff(at)
            parts.append(np.insert(h, at[1:], U64(END)))
            many.append(n + 1)
        k = j
    if not parts:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    return np.concatenate(parts), np.concatenate(many)


def _long_pieces(text: bytes):
    at = 0
    while at < len(text):
        stop = min(len(text), at + CHUNK)
        while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        yield text[at:stop]
        at = stop


def _pairs(t: np.ndarray) -> np.ndarray:
    """Bigram hash of each token with the one before it; each document follows an end."""
    return _mix(np.r_[U64(END), t[:-1]] * U64(0xD6E8FEB86659FD93) + t) if len(t) else t


def _press(x: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpress(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel() if len(planes) else np.zeros(0, dtype=kind)


def _press_sorted(x: np.ndarray) -> bytes:
    return _press(np.diff(x, prepend=U64(0)))


def _unpress_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpress(raw, U64), dtype=U64)


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _block_tokens(table: pa.Table):
    t, n = tokens(_column(table, "text"))
    return t, n, np.array(_column(table, "held_out"), dtype=bool)


REQUESTS = "block int, shard int, words binary, word_counts binary, pairs binary, pair_counts binary"
REPLIES = "block int, shard int, word_counts binary, pair_counts binary, n long, v long"
COUNTS = "doc_ids array<bigint>, held_out array<boolean>, n_tokens array<bigint>, words binary, pairs binary"


def _ask(shards: int):
    width = (1 << 64) // shards + 1
    edges = np.array([width * k for k in range(1, shards)], dtype=U64)

    def run(table: pa.Table) -> pa.Table:
        t, n, held = _block_tokens(table)
        learn = np.repeat(~held, n)
        block = table.column("block")[0].as_py()
        sides = []
        for x in (t, _pairs(t)):
            seen, inverse = np.unique(x, return_inverse=True)
            counts = np.bincount(inverse[learn], minlength=len(seen)).astype(np.int64)
            cuts = np.r_[0, np.searchsorted(seen, edges), len(seen)]
            sides.append((seen, counts, cuts))
        rows = [[], [], [], [], [], []]
        for s in range(shards):
            row: list = [block, s]
            for seen, counts, cuts in sides:
                part = slice(cuts[s], cuts[s + 1])
                row += [_press_sorted(seen[part]), _press(counts[part])]
            for column, value in zip(rows, row):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int32(), pa.int32(), *(pa.binary(),) * 4))],
                                    ["block", "shard", "words", "word_counts", "pairs", "pair_counts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a shard, for each block in the order of its request, and the shard's N and V."""
    block, shard = _column(table, "block"), table.column("shard")[0].as_py()
    replies, totals = [], None
    for name in ("words", "pairs"):
        asked = [_unpress_sorted(x) for x in _column(table, name)]
        counts = np.concatenate([_unpress(x, np.int64) for x in _column(table, name[:-1] + "_counts")])
        every = np.concatenate(asked)
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts, first) if len(first) else counts
        distinct = every[first]
        if totals is None:
            totals = (int(sums.sum()), int((sums > 0).sum()))
        replies.append([_press(sums[np.searchsorted(distinct, a)]) for a in asked])
    k = len(block)
    return pa.Table.from_arrays(
        [pa.array([*block, -1], pa.int32()), pa.array([shard] * (k + 1), pa.int32()),
         pa.array([*replies[0], None], pa.binary()), pa.array([*replies[1], None], pa.binary()),
         pa.array([0] * k + [totals[0]], pa.int64()), pa.array([0] * k + [totals[1]], pa.int64())],
        ["block", "shard", "word_counts", "pair_counts", "n", "v"])


def _meet(table: pa.Table, replies: pa.Table) -> pa.Table:
    """Counts of every token of a block: its word's and its bigram's."""
    t, n, held = _block_tokens(table)
    replies = replies.sort_by("shard")
    out = []
    for x, name in ((t, "word_counts"), (_pairs(t), "pair_counts")):
        inverse = np.unique(x, return_inverse=True)[1]
        counts = np.concatenate([_unpress(r, np.int64) for r in _column(replies, name)] or [np.zeros(0, np.int64)])
        out.append(_press(counts[inverse]))
    return pa.Table.from_arrays(
        [pa.array([_column(table, "doc_id")], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())),
         pa.array([n.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in out)],
        ["doc_ids", "held_out", "n_tokens", "words", "pairs"])


def token_counts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """(a table with the counts of every token by block, N, V)."""
    named = documents(docs)
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = max(1, -(-size // block_bytes)), max(1, -(-size // shard_bytes))
    dealt = named.select("doc_id", F.col("text").cast("binary").alias("text"),
                         (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                         F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    # the order of a block's rows must be the same in both passes
    in_order = lambda t: t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ask = _ask(shards)
    asked = dealt.groupBy("block").applyInArrow(lambda t: ask(in_order(t)), REQUESTS)
    replies = saved(asked.groupBy("shard").applyInArrow(_answer, REPLIES), "counts")
    n, v = replies.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    own = replies.where("block >= 0").select("block", "shard", "word_counts", "pair_counts")
    counts = saved(dealt.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda t, r: _meet(in_order(t), r), COUNTS), "token-counts")
    discard(replies)
    return counts, int(n), int(v)


def _parts(row, n_total: int, v_total: int):
    """(tokens per document, training flags, c(w), c(u w), c(u)) of a block's row."""
    n = np.array(row["n_tokens"], dtype=np.int64)
    words, pairs = _unpress(row["words"], np.int64), _unpress(row["pairs"], np.int64)
    end = words[n[0] - 1] if len(words) else 0
    return n, np.array(row["held_out"], dtype=bool), words, pairs, np.r_[end, words[:-1]]


def _histogram(n_total: int, v_total: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                n, held, words, pairs, context = _parts(row, n_total, v_total)
                learn = np.repeat(~held, n)
                w, p, u = words[learn] - 1, pairs[learn] - 1, context[learn] - 1
                floor = 1 / (v_total + 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    two = np.where((p > 0) & (u > 0), np.round(np.log10(p / np.maximum(u, 1) / floor) / STEP), -9999)
                    one = np.where(w > 0, np.round(np.log10(w / max(n_total - 1, 1) / floor) / STEP), -9999)
                bucket = np.searchsorted(BUCKETS, u, side="right")
                key = (bucket * 20_000 + two.astype(np.int64) + 10_000) * 20_000 + one.astype(np.int64) + 10_000
                seen, many = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (seen // 400_000_000, seen // 20_000 % 20_000 - 10_000, seen % 20_000 - 10_000, many.astype(np.int64))],
                    ["bucket", "two", "one", "many"])
    return run


def learn_weights(counts: DataFrame, n: int, v: int, rounds: int = 50) -> np.ndarray:
    """Weights (bucket, [l0, l1, l2]) by EM over the histogram of held-out tokens."""
    hist = counts.mapInArrow(_histogram(n, v), "bucket long, two long, one long, many long")
    rows = hist.groupBy("bucket", "two", "one").agg(F.sum("many").alias("many")).collect()  # bounded by the steps
    weights = np.full((len(BUCKETS) + 1, 3), 1 / 3)
    for b in range(len(weights)):
        own = [r for r in rows if r.bucket == b]
        if not own:
            weights[b] = (0.1, 0.9, 0.0) if b == 0 else (0.05, 0.55, 0.4)
            continue
        many = np.array([r.many for r in own], dtype=float)
        ratio = np.array([[1.0, 0 if r.one == -9999 else 10 ** (r.one * STEP), 0 if r.two == -9999 else 10 ** (r.two * STEP)] for r in own])
        for _ in range(rounds):
            share = ratio * weights[b]
            share /= share.sum(axis=1, keepdims=True)
            new = (share * many[:, None]).sum(axis=0) + np.array([1e-3, 1e-3, 1e-3])
            weights[b] = new / new.sum()
    return weights


def _scorer(n_total: int, v_total: int, weights: np.ndarray):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                n, held, words, pairs, context = _parts(row, n_total, v_total)
                first = np.cumsum(n) - n
                base = np.log10((words + 0.5) / (n_total + 0.5 * (v_total + 1)))
                l = weights[np.searchsorted(BUCKETS, context, side="right")]
                p = l[:, 0] / (v_total + 1) + l[:, 1] * words / max(n_total, 1) + np.where(context > 0, l[:, 2] * pairs / np.maximum(context, 1), 0)
                p += np.where(context == 0, l[:, 2] / (v_total + 1), 0)
                sums = [np.add.reduceat(x, first) if len(n) else x for x in (base, np.log10(p), (words > 0).astype(np.int64))]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(held.tolist(), pa.bool_()), pa.array(n), pa.array(sums[2]),
                     pa.array([n_total] * k, pa.int64()), pa.array(sums[0]), pa.array(sums[1])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    counts, n, v = token_counts(docs)
    weights = learn_weights(counts, n, v)
    return counts.mapInArrow(_scorer(n, v, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

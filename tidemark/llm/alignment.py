"""Alignment of two tokenizers' tokens on the bytes of whole texts.

A: byte-level BPE of a space and the text; B: sentencepiece BPE of the text, which adds that space
itself.  Byte offsets at which a token of A and one of B end cut both into groups.  ``runs`` finds
them by diagonal run skipping: while the end arrays agree at the present shift (place in B less place
in A) groups are one to one, and exponential probing jumps over the whole stretch; where they differ,
the group is resolved by steps on both sides, which gives the next shift.

Neither tokenizer joins anything across a space that follows a visible character (B's vocabulary
holds no such piece, which is checked), so a batch's texts are cut there; each distinct segment
is tokenized and aligned once a batch, all new ones in one pair of end arrays.  Segments end where
both sides have ends, so a text's groups are those of its segments in turn.

Pairs are counted without a row for each document and pair: a block of documents (``BLOCK_BYTES`` of
text, dealt by the task that read it) names its distinct pairs once, with the number of its documents
that hold each; documents refer to them by place.  Spark sums the blocks' numbers, finds each A
id's highest (at most one row for each id of A's vocabulary, which bounds the broadcast), and sends
every block its pairs' totals.

Null and empty texts, and texts whose tokens' bytes are not the text's (B cannot write U+2581),
have no tokens: zeros and an empty string.  Rows with equal or null ``doc_id`` count as documents of
their own.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import documents, saved
from tidemark.llm.cutting import distinct, groups, spread
from tidemark.llm.tokens import Cache

BLOCK_BYTES = 16 << 20
KEPT = 50_000    # segments that a worker keeps
SHIFT = 20       # a pair is one number: A's id, then SHIFT bits of B's
LONG_GROUP = 4096
SPACE = "▁"
_UNVISIBLE = np.zeros(256, dtype=bool)
_UNVISIBLE[:0x21] = True
_UNVISIBLE[0x7F] = True


def runs(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places behind the last token of each group in both end arrays (ascending; the last ends are equal)."""
    a, b = ends_a.tolist(), ends_b.tolist()
    n, m = len(a), len(b)
    from_a, from_b, many = [], [], []  # stretches of groups that follow each other one to one
    i = j = 0
    while i < n:
        x, y = a[i], b[j]
        if x != y:
            # an irregular group: the side that is behind goes on until both ends meet; the shift changes
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            known = 1
        else:
            # how far do the arrays agree at this shift?  one, two, four, ... places, then by halves
            known, step, limit = 1, 1, min(n - i, m - j)
            while known + step <= limit and a[i + known:i + known + step] == b[j + known:j + known + step]:
                known += step
                step *= 2
            step = min(step, limit - known)
            while step:
                if known + step <= limit and a[i + known:i + known + step] == b[j + known:j + known + step]:
                    known += step
                step //= 2
        from_a.append(i)
        from_b.append(j)
        many.append(known)
        i += known
        j += known
    return _unrolled(from_a, many), _unrolled(from_b, many)


def _unrolled(first: list[int], many: list[int]) -> np.ndarray:
    first, many = np.array(first, dtype=np.int64), np.array(many, dtype=np.int64)
    return np.arange(int(many.sum())) + np.repeat(first + 1 - (np.cumsum(many) - many), many)


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: visible Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in own]
    return {**{chr(x): x for x in own}, **{chr(256 + k): x for k, x in enumerate(rest)}}


class Pair:
    """Both tokenizers and the segments that a worker has aligned."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece of the vocabulary goes on after a space: texts cannot be cut there")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for p in pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << SHIFT:
            raise ValueError("a vocabulary is too large for the numbers of pairs")
        # what a token adds to a text of groups: its number and what follows it
        said = lambda n, mark: np.array([b"%d%s" % (i, mark) for i in range(n)], dtype=object)
        self.said_a, self.said_b = [[said(len(t), x) for x in marks] for t, marks in ((self.bytes_a, (b",", b"|")), (self.bytes_b, (b",", b";")))]
        self.known = Cache(KEPT)

    def _fitting(self, segments: list[bytes], ids: list[list[int]], names: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Are the tokens' bytes the segment's?  Asked of all at once; one by one only where that fails."""
        flat = _flat(ids)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        fits = np.bincount(owner, sizes[flat], len(ids)) == [len(s) for s in segments]
        if fits.all() and b"".join(map(names.__getitem__, flat.tolist())) == b"".join(segments):
            return fits
        return np.array([b"".join(map(names.__getitem__, x)) == s for s, x in zip(segments, ids)], dtype=bool)

    def learn(self, segments: list[bytes]) -> None:
        """Adds to ``known`` for each segment (fits, n_a, n_b, n_groups, links, their weights if not one, text of its groups)."""
        texts = [s.decode() for s in segments]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = [y if t != " " else [self.b.piece_to_id(SPACE)] for t, y in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1))]
        fits = self._fitting(segments, ids_a, self.bytes_a, self.size_a) & self._fitting(segments, ids_b, self.bytes_b, self.size_b)
        if not fits.all():
            bad = (False, 0, 0, 0, b"", b"", b"")
            self.known.update((s, bad) for s, f in zip(segments, fits.tolist()) if not f)
            segments, ids_a, ids_b = ([x for x, f in zip(every, fits.tolist()) if f] for every in (segments, ids_a, ids_b))
        if not segments:
            return
        flat_a, flat_b = _flat(ids_a), _flat(ids_b)
        cut_a, cut_b = runs(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
        from_a, from_b = np.r_[0, cut_a[:-1]], np.r_[0, cut_b[:-1]]
        n_a, n_b = cut_a - from_a, cut_b - from_b
        in_a, in_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
        groups_to = np.searchsorted(cut_a, np.cumsum(in_a)) + 1  # groups up to each segment's end
        n_groups = np.diff(groups_to, prepend=0)
        # the text of all groups in turn
        place_a, place_b = (np.repeat(f, n) for f, n in ((from_b, n_a), (cut_a, n_b)))  # tokens of the other side before one
        pieces = np.empty(len(flat_a) + len(flat_b), dtype=object)
        last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        last_a[cut_a - 1], last_b[cut_b - 1] = True, True
        pieces[np.arange(len(flat_a)) + place_a] = np.where(last_a, self.said_a[1][flat_a], self.said_a[0][flat_a])
        pieces[np.arange(len(flat_b)) + place_b] = np.where(last_b, self.said_b[1][flat_b], self.said_b[0][flat_b])
        pieces = pieces.tolist()
        stops = (np.cumsum(in_a) + np.cumsum(in_b)).tolist()
        # links: every token of A with every token of B of its group
        many = n_a * n_b
        long = many > LONG_GROUP
        usual = np.where(long, 0, many)
        offset = np.arange(int(usual.sum())) - np.repeat(np.cumsum(usual) - usual, usual)
        wide = np.repeat(n_b, usual)
        links = flat_a[np.repeat(from_a, usual) + offset // wide] << SHIFT | flat_b[np.repeat(from_b, usual) + offset % wide]
        upto = np.cumsum(usual)[groups_to - 1].tolist()
        rare = np.flatnonzero(long)
        owner = dict.fromkeys(np.searchsorted(groups_to, rare, side="right").tolist())
        x = y = 0
        for k, (s, a, b, g, stop, end) in enumerate(zip(segments, in_a.tolist(), in_b.tolist(), n_groups.tolist(), stops, upto)):
            own, weights = links[x:end], b""
            if k in owner:  # a long group is counted by kinds of token, not link by link
                found = [(own, np.ones(len(own), np.int64))]
                for q in rare[(rare >= groups_to[k] - g) & (rare < groups_to[k])].tolist():
                    (p, n), (r, m) = (np.unique(f[u:v], return_counts=True) for f, u, v in ((flat_a, from_a[q], cut_a[q]), (flat_b, from_b[q], cut_b[q])))
                    found.append(((p[:, None] << SHIFT | r[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()))
                own, n = _summed(*(np.concatenate(c) for c in zip(*found)))
                weights = n.tobytes()
            self.known[s] = (True, a, b, g, own.tobytes(), weights, b"".join(pieces[y:stop]))
            x, y = end, stop

    def segments(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[tuple]]]:
        """(first text, texts, their first segments, number of each segment, what each distinct one is)."""
        for first, texts, buf, starts in _spaced_groups(column):
            cuts = _cuts(buf, starts)
            numbers, names = distinct(buf, cuts)
            new = self.known.met(set(names))
            if new:
                self.learn(list(new))
            yield first, texts, np.searchsorted(cuts, starts), numbers, list(map(self.known.__getitem__, names))
            self.known.drop_long(new)


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))


def _summed(keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, many
    order = np.argsort(keys, kind="stable")
    keys, many = keys[order], many[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(many, first)


def _spaced_groups(column: pa.Array) -> Iterator[tuple]:
    """(first text, texts, bytes, starts): ``cutting.groups`` with a space before each text; a part that goes on begins with its own."""
    last = -1
    for first, data, starts, texts in groups(column):
        if not len(starts):
            continue
        alone = len(texts) == 1 and texts[0] == 0
        if first == last and alone:
            yield first, texts, data, starts
        else:
            yield first, texts, np.insert(data, starts, 0x20), starts + np.arange(len(starts))
        last = first if alone else -1


def _cuts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of segments: texts, and each space behind a visible character."""
    at = np.flatnonzero(buf[1:] == 0x20) + 1
    before = buf[at - 1]
    fine = ~_UNVISIBLE[before]
    wide = np.flatnonzero(before >= 0x80)  # the last byte of white space beyond ASCII?
    if len(wide):
        p1, p2 = before[wide], buf[at[wide] - 2]
        p3 = buf[np.maximum(at[wide] - 3, 0)]
        fine[wide] = ~((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 >= 0xE1) & (p3 <= 0xE3) & ((p2 == 0x9A) | (p2 == 0x80) | (p2 == 0x81)))
    first = np.zeros(len(buf), dtype=bool)
    first[at[fine]] = True
    first[starts] = True
    return np.flatnonzero(first)


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


class _Text:
    """What is known of the text that is being put together."""
    __slots__ = ("fits", "n_a", "n_b", "n_groups", "sha", "keys", "many")

    def __init__(self):
        self.fits, self.n_a, self.n_b, self.n_groups, self.sha, self.keys, self.many = True, 0, 0, 0, None, [], []

    def done(self) -> tuple:
        if not self.fits or self.sha is None:
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, many = (self.keys[0], self.many[0]) if len(self.keys) == 1 else _summed(np.concatenate(self.keys), np.concatenate(self.many))
        return self.n_a, self.n_b, self.n_groups, self.sha.hexdigest(), keys, many


def _aligned(pair: Pair, column: pa.Array) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, sha, distinct pairs, links of each) of each text in order."""
    at, now = 0, _Text()
    for first, texts, first_segment, numbers, what in pair.segments(column):
        fits, n_a, n_b, n_groups = (np.array(c, dtype=np.int64) for c in list(zip(*what))[:4])
        sizes = np.array([len(w[4]) // 8 for w in what], dtype=np.int64)
        links, per_segment = spread(numbers, sizes, np.frombuffer(b"".join([w[4] for w in what]), np.int64))
        weights = None
        if any(w[5] for w in what):
            weights, _ = spread(numbers, sizes, np.frombuffer(b"".join([w[5] or np.ones(len(w[4]) // 8, np.int64).tobytes() for w in what]), np.int64))
        said = [w[6] for w in what]
        sums = [np.add.reduceat(x[numbers], first_segment).tolist() for x in (1 - fits, n_a, n_b, n_groups)]
        # links of one pair in one text are one row: sort by text and pair, which share a number
        keys = np.repeat(np.arange(len(texts)) << 2 * SHIFT, np.add.reduceat(per_segment, first_segment)) | links
        if weights is None:
            keys.sort()
        else:
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], weights[order]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        many = np.diff(heads, append=len(keys)) if weights is None else np.add.reduceat(weights, heads)
        keys = keys[heads]
        bounds = np.searchsorted(keys, np.arange(len(texts) + 1) << 2 * SHIFT).tolist()
        keys &= (1 << 2 * SHIFT) - 1
        stops = np.r_[first_segment[1:], len(numbers)].tolist()
        numbers, first_segment = numbers.tolist(), first_segment.tolist()
        for k, t in enumerate(texts.tolist()):
            while at < first + t:
                yield now.done()
                at, now = at + 1, _Text()
            body = b"".join([said[x] for x in numbers[first_segment[k]:stops[k]]])[:-1]  # the last group ends without a mark
            if now.sha is None:
                now.sha = hashlib.sha256(body)
            else:
                now.sha.update(b";" + body)
            now.fits &= not sums[0][k]
            now.n_a, now.n_b, now.n_groups = now.n_a + sums[1][k], now.n_b + sums[2][k], now.n_groups + sums[3][k]
            now.keys.append(keys[bounds[k]:bounds[k + 1]])
            now.many.append(many[bounds[k]:bounds[k + 1]])
    while at < len(column):
        yield now.done()
        at, now = at + 1, _Text()


_ROWS = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, places binary, links binary, keys binary, holding binary"
_ROWS_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
                         ("places", pa.binary()), ("links", pa.binary()), ("keys", pa.binary()), ("holding", pa.binary())])
_TOTALS = "block bigint, key bigint, total bigint, best boolean"


def _aligner(path_a: str, path_b: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pair, held, size, block = _pair(path_a, path_b), [], 0, TaskContext.get().partitionId() << 32

        def close():
            every = [d[5] for d in held]
            keys, place, holding = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
            stops = np.cumsum([len(x) for x in every]).tolist()
            rows = [(block, None, None, None, None, None, None, None, keys.tobytes(), holding.astype("<i8").tobytes())]
            begin = 0
            for (doc_id, a, b, g, sha, _, many), stop in zip(held, stops):
                rows.append((block, doc_id, a, b, g, sha, place[begin:stop].astype("<u4").tobytes(), many.astype("<u4" if not len(many) or many.max() < 2**32 else "<u8").tobytes(), None, None))
                begin = stop
            for k in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k:k + 1024]), _ROWS_ARROW)], schema=_ROWS_ARROW)

        for batch in batches:
            texts = batch.column("text")
            lengths = pc.binary_length(texts).to_pylist()
            for doc_id, n, found in zip(batch.column("doc_id").to_pylist(), lengths, _aligned(pair, texts)):
                held.append((doc_id, *found))
                size += n + 64
                if size >= block_bytes:
                    yield from close()
                    held, size, block = [], 0, block + 1
        if held:
            yield from close()
    return run


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()),
                           ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _rated(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """A block's documents with their pairs' totals; places follow the ascending order of pairs."""
    order = np.argsort(totals.column("key").to_numpy())
    total, best = totals.column("total").to_numpy()[order], totals.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    links, bests, sums = [], [], []
    for places, many in zip(docs.column("places").to_pylist(), docs.column("links").to_pylist()):
        at = np.frombuffer(places, "<u4")
        n = np.frombuffer(many, "<u4" if len(many) == len(places) else "<u8").astype(np.int64)
        links.append(int(n.sum()))
        bests.append(int((n * best[at]).sum()))
        sums.append(int((n * total[at]).sum()))
    return pa.table([docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), docs.column("n_groups"), pa.array(links, pa.int64()), pa.array(bests, pa.int64()),
                     pa.array(sums, pa.int64()), docs.column("groups_sha256")], schema=_RESULT_ARROW)


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokens, groups, links and how well each document's links agree with the whole corpus."""
    rows = saved(documents(docs).mapInArrow(_aligner(path_a, path_b, block_bytes), _ROWS), "aligned", compression="zstd")
    own = (rows.where("keys is not null").select("block", "keys", "holding")
           .mapInArrow(_unpacked, "block bigint, key bigint, holding bigint"))
    own = saved(own, "block-pairs", compression="zstd")
    totals = own.groupBy("key").agg(F.sum("holding").alias("total"))
    totals = saved(totals.withColumn("a", F.shiftright("key", SHIFT)), "pair-totals")
    highest = totals.groupBy("a").agg(F.max("total").alias("highest"))  # a row for each id of A's vocabulary at most
    rated = totals.join(F.broadcast(highest), "a").select("key", "total", (F.col("total") == F.col("highest")).alias("best"))
    asked = own.select("block", "key").join(rated, "key").select("block", "key", "total", "best")
    texts = rows.where("keys is null").drop("keys", "holding")
    return texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_rated, _RESULT)


def pair_counts(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, documents): the corpus-wide table of linked ids, by which one vocabulary maps to the other."""
    rows = documents(docs).mapInArrow(_aligner(path_a, path_b, block_bytes), _ROWS).where("keys is not null").select("block", "keys", "holding")
    own = rows.mapInArrow(_unpacked, "block bigint, key bigint, holding bigint")
    return own.groupBy("key").agg(F.sum("holding").alias("documents")).select(F.shiftright("key", SHIFT).alias("a"), F.expr(f"key & {(1 << SHIFT) - 1}").alias("b"), "documents")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, keys, holding in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "holding"))):
            keys, holding = np.frombuffer(keys, "<i8"), np.frombuffer(holding, "<i8")
            for k in range(0, len(keys), 65_536):
                part = keys[k:k + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(holding[k:k + 65_536])], names=["block", "key", "holding"])

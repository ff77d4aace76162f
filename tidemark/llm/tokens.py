"""Shared whole-text tokenization with a public tokenizer file, in Spark tasks.

``cutting`` parts a batch's texts into chunks and names the distinct ones; the ids of a text are
those of its chunks in turn.  A worker asks the library once for each distinct chunk and keeps the
ids in a bounded cache, from which chunks that came only once go first.  New words go to the library
joined, where its pattern parts them again; everything else goes alone.  The tests compare whole
texts with the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm.cutting import cut, distinct, groups, spread

KEPT = 200_000  # chunks whose ids a worker keeps
LONGEST = 64    # bytes of a chunk worth keeping
JOINED = 1024


class Cache(dict):
    """Chunk to ids.  When full, chunks that were asked for in one batch only are forgotten."""

    def __init__(self, limit: int = KEPT):
        super().__init__()
        self.limit, self.again = limit, set()

    def met(self, chunks: set[bytes]) -> set[bytes]:
        """The chunks that are not here."""
        new = chunks.difference(self)
        if len(self) + len(new) > self.limit:
            often = {c: self[c] for c in self.again.union(chunks.difference(new)) if c in self}
            self.clear()
            if len(often) + len(new) <= self.limit:
                self.update(often)
            else:  # even these are too many: only what this batch needs stays
                self.update((c, often[c]) for c in chunks.difference(new))
            self.again = set()
        else:
            self.again |= chunks.difference(new)
        return new

    def drop_long(self, chunks: set[bytes]) -> None:
        for c in chunks:
            if len(c) > LONGEST:
                self.pop(c, None)


class BatchEncoder:
    """Ids of whole texts by their distinct chunks.  ``_learn`` puts the ids of new chunks into ``known``.

    ``spaced`` says that the vocabulary keeps white space (byte-level) instead of dropping it; the
    other kind lower-cases.
    """

    spaced: bool = True
    special: tuple[bytes, ...] = ()
    known: Cache

    def _learn(self, chunks: list[bytes]) -> None:
        raise NotImplementedError

    def numbered(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """(first text, texts with bytes counted from it, their first chunks, distinct number of each chunk, ids of each distinct one).

        A very long text comes in parts: then the next group has the same first text.
        """
        for first, data, starts, texts in groups(column):
            if not len(starts):
                continue
            buf, chunks = cut(data, starts, self.spaced, self.special, lower=not self.spaced)
            numbers, names = distinct(buf, chunks)
            if not self.spaced:
                names = [c.strip() for c in names]
            new = self.known.met(set(names))
            self._learn(list(new))
            found = list(map(self.known.__getitem__, names))
            self.known.drop_long(new)
            yield first, texts, np.searchsorted(chunks, starts), numbers, found

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids in turn, number of ids of each text from it) of groups of texts."""
        for first, texts, at, numbers, found in self.numbered(column):
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            ids, many = spread(numbers, sizes, np.frombuffer(b"".join(found), dtype="<u4"))
            per_text = np.zeros(int(texts[-1]) + 1, dtype=np.int64)
            per_text[texts] = np.add.reduceat(many, at)
            yield first, ids, per_text

    def encode_all(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order."""
        none = np.zeros(0, "<u4")
        at, held = 0, []  # the text that is being put together

        def whole():
            return np.concatenate(held) if len(held) > 1 else held[0] if held else none

        for first, ids, per_text in self.encode(column):
            begin = 0
            for k, stop in enumerate(np.cumsum(per_text).tolist(), first):
                while at < k:
                    yield whole()
                    at, held = at + 1, []
                held.append(ids[begin:stop])
                begin = stop
        while at < len(column):
            yield whole()
            at, held = at + 1, []


class LibraryEncoder(BatchEncoder):
    """The tokenizers library, asked once for each new chunk."""

    def __init__(self, path: str, spaced: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        # tokens that begin with a space, or that end a word
        mark = (lambda t: t.startswith("Ġ")) if spaced else (lambda t: t.endswith("</w>"))
        self.edge = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.edge[i] = mark(token)
        self.line_end = self.tokenizer.token_to_id("Ċ")
        self.known = Cache()

    def _alone(self, chunks: list[bytes]) -> None:
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)):
            self.known[c] = np.array(e.ids, dtype="<u4").tobytes()

    def _joined(self, words: list[bytes], gap: bytes) -> None:
        """Words told apart by their ends (white space dropped), their space, or a line end between them."""
        for k in range(0, len(words), JOINED):
            group = words[k:k + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([gap.join(group).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            if gap == b"\n":
                at = np.flatnonzero(ids == self.line_end)
                first, stop = np.r_[0, at + 1], np.r_[at, len(ids)]
            elif self.spaced:
                first = np.flatnonzero(self.edge[ids])
                stop = np.r_[first[1:], len(ids)]
            else:
                stop = np.flatnonzero(self.edge[ids]) + 1
                first = np.r_[0, stop[:-1]]
            if len(first) != len(group) or (len(first) and first[0]):  # some letters do not stay together
                self._alone(group)
                continue
            raw = ids.tobytes()
            for c, a, b in zip(group, (4 * first).tolist(), (4 * stop).tolist()):
                self.known[c] = raw[a:b]

    def _learn(self, chunks: list[bytes]) -> None:
        words: list[bytes] = []
        bare: list[bytes] = []
        alone: list[bytes] = []
        for c in chunks:
            if not self.spaced:
                (words if c.isalpha() or c.decode().isalpha() else alone).append(c)
            elif c[:1] == b" ":
                (words if c[1:].isalpha() or c[1:].decode().isalpha() else alone).append(c)
            else:
                (bare if c.isalpha() or c.decode().isalpha() else alone).append(c)
        self._joined(words, b"" if self.spaced else b" ")
        self._joined(bare, b"\n")
        self._alone(alone)


_encoders: dict[tuple[str, bool], LibraryEncoder] = {}


def encoder(path: str, spaced: bool) -> LibraryEncoder:
    """One encoder for each worker process, kept between its tasks."""
    key = (path, spaced)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[key] = LibraryEncoder(path, spaced)
    return _encoders[key]

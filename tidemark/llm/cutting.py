"""Cuts whole texts into chunks on their UTF-8 bytes, and names each distinct chunk once.

GPT-2's pattern and its lower-casing kin part a text at the same places as long as only kinds of
characters matter.  ``cut`` finds these places for a whole batch with array operations:

* between letters, digits and punctuation, where both neighbours are ASCII or letters of
  ``LETTER_LEADS``, which composition and lower-casing leave single letters.  Bytes of any other
  character join what they touch, and an apostrophe joins the letter after it (contractions);
* at white space: the vocabularies that keep it want it before the next word, runs leave their last
  blank; for the others white space goes with the next chunk and means nothing.

A text that holds a special token's string, or (where white space is kept) a blank beyond ASCII,
is one chunk, which the tokenizer then cuts itself.  ``distinct`` hashes the chunks in Arrow, so
that Python sees each distinct chunk of a batch once, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 22
SPACE, BLANK, LETTER, DIGIT, PUNCT, QUOTE, OTHER = range(7)
# First bytes of two-byte letters U+00C0-U+017F and U+0400-U+047F; the exceptions below are no
# letters (multiplication, division) or become two when lower-cased (dotted capital I).
LETTER_LEADS = (0xC3, 0xC4, 0xC5, 0xD0, 0xD1)
NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
# UTF-8 of white space beyond ASCII: fixed first bytes, range of the last one
WIDE_BLANKS = ((b"\xc2", 0x85, 0x85), (b"\xc2", 0xA0, 0xA0), (b"\xe1\x9a", 0x80, 0x80), (b"\xe2\x80", 0x80, 0x8A),
               (b"\xe2\x80", 0xA8, 0xA9), (b"\xe2\x80", 0xAF, 0xAF), (b"\xe2\x81", 0x9F, 0x9F), (b"\xe3\x80", 0x80, 0x80))


def _kinds() -> np.ndarray:
    kind = np.full(256, PUNCT, dtype=np.uint8)
    kind[128:] = OTHER
    kind[9:14] = BLANK
    kind[0x20] = SPACE
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[0x27] = QUOTE
    return kind


KIND = _kinds()
# May a chunk end between these kinds (left, right)?  White space has its own rules.
PARTED = np.zeros((8, 8), dtype=bool)
for _a in (LETTER, DIGIT, PUNCT, QUOTE):
    for _b in (LETTER, DIGIT, PUNCT, QUOTE):
        PARTED[_a, _b] = _a != _b and (_a, _b) not in ((QUOTE, LETTER), (QUOTE, PUNCT), (PUNCT, QUOTE))
PARTED = PARTED.ravel()


def _lead_pairs(buf: np.ndarray, kind: np.ndarray) -> None:
    """Marks both bytes of two-byte letters."""
    lead = np.zeros(256, dtype=bool)
    lead[list(LETTER_LEADS)] = True
    at = np.flatnonzero(lead[buf[:-1]]) if len(buf) else np.zeros(0, np.int64)
    a, b = buf[at], buf[at + 1]
    fine = np.ones(len(at), dtype=bool)
    for x, y in NO_LETTERS:
        fine &= (a != x) | (b != y)
    at = at[fine]
    kind[at] = LETTER
    kind[at + 1] = LETTER


def _wide_blanks(buf: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII."""
    found = []
    for first, low, high in WIDE_BLANKS:
        n = len(first)
        if len(buf) <= n:
            continue
        hit = np.flatnonzero(buf[:-n] == first[0])
        for k in range(1, n):
            hit = hit[buf[hit + k] == first[k]]
        found.append(hit[(buf[hit + n] >= low) & (buf[hit + n] <= high)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _places(raw: bytes, word: bytes) -> list[int]:
    found, at = [], raw.find(word)
    while at >= 0:
        found.append(at)
        at = raw.find(word, at + len(word))
    return found


def cut(buf: np.ndarray, starts: np.ndarray, spaced: bool, special: tuple[bytes, ...] = (), lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, chunk starts) of texts that begin at ``starts`` (ascending, distinct) of ``buf``."""
    n = len(buf)
    kind = KIND[buf]
    if (kind == OTHER).any():
        _lead_pairs(buf, kind)
    first = np.zeros(n + 1, dtype=bool)
    first[1:n] = PARTED[kind[:-1] * 8 + kind[1:]]
    blank = kind <= BLANK
    after, before = blank[:-1], blank[1:]  # is the byte before, the byte itself, white space?
    first[1:n] |= before & ~after
    if spaced:
        ends = np.flatnonzero(after & ~before) + 1  # a word that follows white space of its own text
        ends = ends[starts[np.minimum(np.searchsorted(starts, ends), len(starts) - 1)] != ends]
        first[ends[buf[ends - 1] != 0x20]] = True
        first[ends - 1] = True  # a run leaves its last blank
    whole = [np.searchsorted(starts, _wide_blanks(buf), side="right") - 1] if spaced and (kind == OTHER).any() else []
    if special:
        raw = buf.tobytes()
        for s in special:
            at = _places(raw, s)
            if at:
                whole.append(np.searchsorted(starts, np.array(at), side="right") - 1)
    stop = np.r_[starts[1:], n]
    owners = np.unique(np.concatenate(whole)).tolist() if whole else []
    for t in owners:
        first[starts[t]:stop[t]] = False
    first[starts] = True
    if lower:
        # not before a character that might compose with the small letter only
        big = (buf >= 65) & (buf <= 90)
        big[:-1] &= kind[1:] != OTHER
        for t in owners:
            big[starts[t]:stop[t]] = False
        buf = buf + (big.view(np.uint8) << 5)
    return buf, np.flatnonzero(first[:n])


def distinct(buf: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each chunk's bytes among the distinct ones, these)."""
    offsets = np.r_[chunks, len(buf)].astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])
    named = column.dictionary_encode()
    return named.indices.to_numpy(), named.dictionary.to_pylist()


def _break_after(data: np.ndarray, start: int, stop: int) -> int:
    """A place at most ``stop`` behind a word of ASCII and before white space, or ``stop``."""
    at = start + GROUP_BYTES
    while at < stop:
        kind = KIND[data[at - 1:min(at + 65536, stop)]]
        hit = np.flatnonzero((kind[1:] <= BLANK) & (kind[:-1] > BLANK) & (data[at - 1:at - 1 + len(kind) - 1] < 128))
        if len(hit):
            return at + int(hit[0])
        at += 65536
    return stop


def groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, bytes, segment starts, text of each segment from the first) of at most about GROUP_BYTES each.

    A longer text is divided into segments, behind a word of ASCII and before white space, where
    every tokenizer parts it; a text has one segment otherwise and none if it is empty.
    """
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = np.frombuffer(places, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    k = 0
    while k < len(column):
        j = max(k + 1, int(np.searchsorted(at, at[k] + GROUP_BYTES, side="right")) - 1)
        if j == k + 1 and at[j] - at[k] > GROUP_BYTES:
            start = int(at[k])
            while start < at[j]:
                stop = _break_after(data, start, int(at[j]))
                yield k, data[start:stop], np.zeros(1, np.int64), np.zeros(1, np.int64)
                start = stop
        else:
            texts = np.flatnonzero(at[k + 1:j + 1] > at[k:j])
            yield k, data[at[k]:at[j]], at[k:j][texts] - at[k], texts
        k = j


def spread(numbers: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items of all chunks in turn, number of items of each chunk); ``flat`` has each distinct chunk's items in turn."""
    first = np.cumsum(sizes) - sizes
    many = sizes[numbers]
    done = np.cumsum(many)
    total = int(done[-1]) if len(done) else 0
    return flat[np.repeat(first[numbers] - (done - many), many) + np.arange(total)], many

"""Tokenizing operators against their libraries: letters beside punctuation, random strings, very long texts, null and repeated ids."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import byte_bpe, cutting, packing, token_files, tokens

public = pytest.importorskip("public_tokenizers")
WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")
MULTI = public.path("byte_bpe_multi_50k.tiktoken")

LETTERS = [chr(c) for c in [*range(0x80, 0x600), *range(0x900, 0xA00), *range(0x1E00, 0x2100), *range(0x3000, 0x3100), *range(0xA640, 0xA700), *range(0xF900, 0xFB50)]
           if chr(c).isprintable() or chr(c).isspace()]
BESIDE = [",", "'", "(", "1", " ", "\n", "a", "'s", "=", "\u0301", "\u0338", "\u030c"]
ODD = [*"aAbJ sS  \n\t'.,-!0 19\u00e9\u00c9\u0130\u00d7\u00f7\u0338\u0301\u030c\u00a0\u3000\u2003\u0085\u4e2d\u0915\u093c\u0439\u0418\u0141\u0149\u212a\ufb01<|\u2019\u201c\u00df\u1e9e\u03a3\u03c3\u0345\u20e3\x1c\x0b",
       "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'S", "'ll", " 't", "the", " House", "\U0001f600"]


def strings():
    r = random.Random(7)
    beside = [x for c in LETTERS for p in r.sample(BESIDE, 3) for x in (c + p, p + c, "X" + c + p + "y", " " + c + p)]
    return beside + ["".join(r.choices(ODD, k=r.randint(0, 14))) for _ in range(20_000)]


def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def multi():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path, spaced", [(WORD, False), (BYTE, True)])
def test_ids_equal_the_library(path, spaced):
    texts, lib = strings(), library(path)
    for got, e, t in zip(tokens.encoder(path, spaced).encode_all(pa.array(texts)), lib.encode_batch(texts, add_special_tokens=False), texts, strict=True):
        assert got.tolist() == e.ids, t


def test_byte_bpe_equals_the_library(multi):
    texts, bpe = strings(), byte_bpe.codec(MULTI, public.PATTERN)
    column = pa.array(texts)
    for t, ids, digest in zip(texts, bpe.encode_all(column), bpe.digests(column), strict=True):
        want = multi.encode_ordinary(t)
        assert ids.tolist() == want, t
        assert digest == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_heaps_side_by_side_equal_one_heap():
    r, bpe = random.Random(3), byte_bpe.codec(MULTI, public.PATTERN)
    pieces = ["".join(r.choices("thenigo \u00e9", k=r.randint(1, 90))).encode() for _ in range(3000)]
    assert bpe.merge_all(pieces) == [np.array(bpe.merge(p), dtype="<u4").tobytes() for p in pieces]
    assert bpe.merge_all([]) == []


@pytest.mark.parametrize("spaced", [False, True])
def test_very_long_texts_come_in_parts(monkeypatch, multi, spaced):
    monkeypatch.setattr(cutting, "GROUP_BYTES", 700)
    r = random.Random(5)
    texts = ["", "a b", " ".join("".join(r.choices(ODD, k=6)) for _ in range(2000)), "z" * 3000, " \n" * 900, None and "", "end", "x y z " * 400]
    texts = [t or "" for t in texts]
    path = BYTE if spaced else WORD
    lib = library(path)
    got = [x.tolist() for x in tokens.encoder(path, spaced).encode_all(pa.array(texts))]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    bpe = byte_bpe.codec(MULTI, public.PATTERN)
    assert [d[0] for d in bpe.digests(pa.array(texts))] == [len(multi.encode_ordinary(t)) for t in texts]
    assert [d[2] for d in bpe.digests(pa.array(texts))] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_cache_keeps_what_came_again():
    c = tokens.Cache(4)
    for batch in ({b"a", b"b"}, {b"a", b"c"}, {b"d", b"e", b"a"}):
        new = c.met(batch)
        c.update({k: k for k in new})
        assert batch <= set(c) and len(c) <= 4
    assert set(c) == {b"a", b"d", b"e"}
    assert c.met({b"%d" % i for i in range(9)}) == {b"%d" % i for i in range(9)} and not c


SCHEMA = "doc_id bigint, text string, file int, part int, g int, ids string, length int"


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Null ids, ids and rows that repeat, nulls, and columns named like the operators' own."""
    rows = [(None, "no id"), (None, None), (5, "five"), (5, "five"), (5, "other five"), (2, ""), (7, None)] + [(9, f"hot {i % 11}") for i in range(60)]
    return spark.createDataFrame([(d, t, 1, 2, 3, "x", 4) for d, t in rows], SCHEMA).repartition(3), rows


def test_byte_bpe_on_odd_rows(odd_rows, multi):
    df, rows = odd_rows
    got = sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in byte_bpe.digests(df, MULTI, public.PATTERN).collect())
    assert got == sorted((str(d), len(multi.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


def test_token_files_on_odd_rows(odd_rows):
    df, rows = odd_rows
    got = token_files.read_token_files(token_files.write_token_files(df, WORD, file_ids=10)).collect()
    lib = library(WORD)
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(d), crc(t)) for d, t in rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_packing_of_odd_rows_in_many_groups(odd_rows):
    df, rows = odd_rows
    once = packing.pack(df, BYTE, length=16, group=8).collect()
    lib = library(BYTE)
    want = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in once) == want and len({(r.sequence_id, r.offset) for r in once}) == len(once)
    for _, own in itertools.groupby(sorted(once, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 16
    # groups of eight would keep a light sequence each; packed again, they do not
    assert len({r.sequence_id for r in once}) <= -(-want // 16) + 3


def optimum(lengths, capacity):
    """Fewest bins by search over every assignment."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for b in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, [*rooms[:b], rooms[b] - lengths[k], *rooms[b + 1:]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_local_search_against_the_optimum():
    r = np.random.default_rng(4)
    over = 0
    for _ in range(60):
        lengths = np.sort(r.integers(3, 20, 11))[::-1].copy()
        bins = packing.local_search(packing.best_fit(lengths, 20), lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(11)) and all(lengths[b].sum() <= 20 for b in bins)
        over += len(bins) - optimum(lengths.tolist(), 20)
    assert over <= 2


def test_local_search_ends_where_nothing_raises_the_squares():
    r = np.random.default_rng(6)
    lengths = r.integers(400, 1400, 600)
    start = packing.best_fit(lengths, 2048)
    bins = packing.local_search(start, lengths, 2048)
    square = lambda bs: sum(int(lengths[b].sum()) ** 2 for b in bs)
    assert sorted(i for b in bins for i in b) == list(range(600)) and all(lengths[b].sum() <= 2048 for b in bins)
    assert len(bins) <= len(start) and square(bins) >= square(start)
    assert [sorted(b) for b in packing.local_search(bins, lengths, 2048)] == [sorted(b) for b in bins]


def test_best_fit_takes_the_earlier_of_equal_bins():
    bins = packing.best_fit(np.array([6, 6, 4, 4]), 10)
    assert sorted(map(sorted, bins)) == [[0, 3], [1, 2]] or sorted(map(sorted, bins)) == [[0, 2], [1, 3]]

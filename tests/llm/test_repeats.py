"""Removal of repeated passages against the definition, string by string."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import repeats as R

SCHEMA = "doc_id bigint, text string, block bigint, place string"
L = R.LENGTH


def plain(rows):
    """(doc_id, text) to digests: every string of 50 bytes with the smallest id that has it."""
    rank = lambda d: -2**63 if d is None else d
    first = {}
    for d, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - L + 1):
            s = b[i:i + L]
            first[s] = min(first.get(s, rank(d)), rank(d))
    out = []
    for d, text, *_ in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - L + 1):
            if first[b[i:i + L]] < rank(d):
                gone[i:i + L] = [True] * L
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=70):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéö") for _ in range(r.randrange(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(k) for k in (6, 12, 15, 20, 40, 90)] + ["=" * 130, " " * 80, "ab" * 70, "x" * 49, "y" * 50, "z" * 51]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(r.randrange(0, 6)):
            p = r.choice(shared)
            parts.append(r.choice([text(r.randrange(0, 15)), p, p[r.randrange(len(p)):], p[:r.randrange(len(p))], p + p]))
        rows.append((r.choice([k, k, k, 5, None]), r.choice(["", " "]).join(parts), 1, "x"))
    whole = text(60)
    rows += [(300 + k, whole[:150 + k] + r.choice("uvw") + whole[150 + k:], 1, "x") for k in range(12)]  # near copies
    rows += [(400, None, 1, "x"), (401, "", 1, "x"), (402, "a" * 49, 1, "x"), (403, "a" * 49, 1, "x"), (404, "b" * 50, 1, "x"), (405, "b" * 50, 1, "x"), (405, "b" * 50, 1, "x")]
    return rows


@pytest.mark.parametrize("seed,batches,shards,block", [(1, 1, 1, 1 << 24), (2, 4, 3, 300), (3, 7, 16, 2000), (4, 4, 5, 1 << 24)])
def test_equals_the_definition(spark, seed, batches, shards, block):
    rows = made(seed)
    got = R.digests(spark.createDataFrame(rows, SCHEMA).repartition(3), batches=batches, shards=shards, block_bytes=block).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_levels_merge_geometrically(spark):
    index = R.RepeatIndex(spark, 4, 8)
    rows = made(9)
    sizes = []
    for k in range(7):
        index.add(spark.createDataFrame([(100 * k + i, r[1], 0, "") for i, r in enumerate(rows[k::7])], SCHEMA))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    names = [np.frombuffer(r.b, np.uint64) for _, level in index.levels for r in level.collect()]
    assert len(np.unique(np.concatenate(names))) == sum(map(len, names))  # no level holds what another has


def test_long_document_in_pieces(spark, monkeypatch):
    r = random.Random(3)
    letters = "abcdefghij "
    long = "".join(r.choice(letters) for _ in range(9000))
    data = np.frombuffer(long.encode(), np.uint8)
    whole = R.anchors(data, np.array([0, len(data)]))
    monkeypatch.setattr(R, "PIECE", 700)
    parts = R.anchors(data, np.array([0, len(data)]))
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    ties = np.frombuffer(("a" * 3000 + "bc" * 900 + long[:1500]).encode(), np.uint8)
    got = R.anchors(ties, np.array([0, len(ties)]))
    monkeypatch.setattr(R, "PIECE", 1 << 20)
    assert all(np.array_equal(a, b) for a, b in zip(R.anchors(ties, np.array([0, len(ties)])), got))


def test_empty_table_and_spans(spark):
    df = spark.createDataFrame([(1, "p" * 60, 0, ""), (2, "ab" + "p" * 55 + "é", 0, "")], SCHEMA)
    assert R.without_repeats(df.where("false")).collect() == []
    got = {r.doc_id: r for r in R.without_repeats(df).collect()}
    assert got[1].spans == [] and [tuple(s) for s in got[2].spans] == [(2, 57)] and bytes(got[2].kept) == "abé".encode()


def test_shards_hold_about_as_many_anchors_each():
    data = np.random.default_rng(5).integers(97, 123, 1_000_000, dtype=np.uint8)
    key = np.sort(R.anchors(data, np.array([0, len(data)]))[2])
    shard = R._dealing(64)(key)
    assert (np.diff(shard) >= 0).all() and shard[0] == 0 and shard[-1] == 63  # ranges
    sizes = np.bincount(shard, minlength=64)
    assert sizes.max() < 1.3 * sizes.mean() and sizes.min() > 0.7 * sizes.mean()
    ends = np.array([0, 2**64 - 1], np.uint64)
    assert R._dealing(1)(ends).tolist() == [0, 0] and R._dealing(10**8)(ends).tolist() == [0, 10**8 - 1]

"""The conversation trie against one built plainly from whole turns."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string"


def plain(rows):
    """Nodes by definition: every prefix of every rebuilt conversation."""
    convs = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    convs = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = (*convs.get(c - c % 5, [])[:h], *own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        out, todo = [], [p]
        while todo:
            out.append(todo.pop())
            todo += kids.get(out[-1], [])
        return out

    out = []
    for p, members in nodes.items():
        under = below(p)
        ends = ",".join(map(str, sorted(c for c in members if built[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in under),
                    sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 1, 2, 3, 7, 12])):
            rows.append((c, t, r.choice(["user", None, "bot"]), r.choice(["", "a", "ä b", None, "long " * 9]), "x"))
    rows += [(200 + k, t, "user", f"same {t}", "x") for k in range(30) for t in range(9)]  # copies
    rows += [(400, None, "user", "first", "x"), (400, 0, "user", "second", "x"), (400, 0, "user", "second", "x"), (None, 0, "user", "lost", "x"), (401, 3, None, None, "x")]
    return rows


@pytest.mark.parametrize("seed,shards", [(1, 1), (2, 3), (3, 7), (4, 40)])
def test_equals_every_prefix(spark, seed, shards):
    rows = table(seed)
    got = P.trie(P.spliced(P.numbered_turns(spark.createDataFrame(rows, SCHEMA))), shards).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_turnless_and_empty(spark):
    # conversation 1 has h own turns or fewer and no base: nothing is left of it
    h = zlib.crc32(b"1") % 9
    assert h > 0
    rows = [(1, t, "user", f"{t}", "x") for t in range(h)] + [(7, 0, "user", "a", "x")]
    got = P.trie(P.spliced(P.numbered_turns(spark.createDataFrame(rows, SCHEMA))), 3).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert P.trie(P.spliced(P.numbered_turns(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_median_insertion_keeps_the_tree_low():
    tree = P.Ternary([[k, 7] for k in range(1023)])
    depth, todo = 0, [(tree.same[0], 1)]
    while todo:
        node, d = todo.pop()
        if node >= 0:
            depth = max(depth, d)
            todo += [(tree.low[node], d + 1), (tree.high[node], d + 1)]
    assert depth == 10

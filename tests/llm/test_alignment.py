"""Alignment of two tokenizers against whole texts encoded by both libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment as A

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, block string, places string"


def plain_cuts(a, b):
    both = set(a) & set(b)
    return [k + 1 for k, x in enumerate(a) if x in both], [k + 1 for k, x in enumerate(b) if x in both]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_the_common_ends(seed):
    r = random.Random(seed)
    n = r.choice([1, 2, 5, 40, 700])
    ends = lambda p: sorted({x for x in range(1, n) if r.random() < p} | {n})
    a, b = ends(r.choice([0.1, 0.5, 1])), ends(r.choice([0.1, 0.5, 1]))
    if r.random() < 0.5:  # a long stretch that agrees, then a shift
        a, b = [*a, *range(n + 1, n + 300), n + 302, n + 305], [*b, *range(n + 1, n + 300), n + 301, n + 302, n + 305]
    got = A.runs(np.array(a), np.array(b))
    assert [x.tolist() for x in got] == list(plain_cuts(a, b))


def plain(rows):
    """By definition: whole texts, all links of each group, counts over documents."""
    tok = Tokenizer.from_file(PATH_A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    letters = A._byte_letters()
    names = {i: bytes(letters[c] for c in t) for t, i in tok.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
    found, count = [], Counter()
    for doc_id, text, *_ in rows:
        whole = (" " + (text or "")).encode()
        a, b = tok.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        pieces = [sp.id_to_piece(i) for i in b]
        said = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(names[i] for i in a) != whole or b"".join(said) != whole:
            found.append((doc_id, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(names[i]) for i in a]).tolist(), np.cumsum([len(x) for x in said]).tolist()
        groups, i, j = [], 0, 0
        for x, y in zip(*plain_cuts(ends_a, ends_b)):
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        found.append((doc_id, a, b, groups))
        count.update({(p, q) for left, right in groups for p in left for q in right})
    high = {}
    for (p, _), n in count.items():
        high[p] = max(high.get(p, 0), n)
    out = []
    for doc_id, a, b, groups in found:
        links = [(p, q) for left, right in groups for p in left for q in right]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == high[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ODD = ["", None, " ", "  ", "\n", " a", "a ", "a  b", "a▁b", "x  y", "x   y", "　 z 　", "<s> <|endoftext|> </s>", "\x00 \x01", "tab\t next\n\n line \r\n",
       "it's we'll 'tis ' s", "ﬁ ＡＢ İ ß", "漢字かな交じり文 と 空白", "🙂 🙃🙂", "a  b", "é ́", "word" * 900, "=" * 5000, " " * 700, "é " * 400, "\u0085 x\u0085 y", "<0x41> ▁"]


def test_equals_whole_texts(spark):
    r = random.Random(5)
    pool = ["the", "Étion", "für", "über", "x=1;", "don't", "1234", "naïve", "слово", "漢字", "\n", "\t", "  ", " ", "!!", "🙂", "<s>", "a▁"]
    texts = ODD + ["".join(r.choice(pool) + r.choice(["", " ", " ", "  ", "\n"]) for _ in range(r.randrange(1, 60))) for _ in range(250)] + ["the the the"] * 9
    rows = [(k if k % 11 else None, t, "c", "c") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block in (200, 1 << 24):
        assert sorted(map(tuple, A.align(df, PATH_A, PATH_B, block).collect()), key=str) == plain(rows)
    assert A.align(df.where("false"), PATH_A, PATH_B).collect() == []


def test_very_long_texts_in_parts(spark):
    r = random.Random(2)
    long = " ".join(r.choice(["alpha", "Straße", "bêta", "γ", "x1", "\n"]) for _ in range(900_000))
    rows = [(1, long, "", ""), (2, "alpha Straße", "", ""), (3, long[:100], "", "")]
    assert len(long.encode()) > 4 << 20
    assert sorted(map(tuple, A.align(spark.createDataFrame(rows, SCHEMA), PATH_A, PATH_B).collect()), key=str) == plain(rows)


def test_pair_counts(spark):
    rows = [(1, "the cat", "", ""), (2, "the the dog", "", ""), (3, None, "", "")]
    got = {(r.a, r.b): r.documents for r in A.pair_counts(spark.createDataFrame(rows, SCHEMA), PATH_A, PATH_B).collect()}
    assert max(got.values()) == 2 and sum(got.values()) >= 4

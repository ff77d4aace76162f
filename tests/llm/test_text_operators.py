"""Operators on documents against brute force: nulls, empty and long texts, repeated rows, extra columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, namedtuple

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, lm_scoring, packing, quality_rules, secret_scan, simhash, token_files, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, fp int, label string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(1)
    words = ["the", "of", "Straße", "été", "niño", "alpha", "beta", "GAMMA", "x", "don't", "3.14", "and", "to", "in"]
    some = [" ".join(r.choice(words, r.integers(1, 60))) for _ in range(40)]
    long = " ".join(r.choice(words, 30_000))
    return [None, "", " \n\t", "one", "two words", *some, some[0], some[0], some[3] + " end", long,
            "a\n\nb\n a\na\n", "a  b   c \n d\x1c e\x85f\u2003g <|endoftext|> x  <|endoftext|>y", "z" * 5000, "password = \"abcdefgh12\" tail", "😀 e\u0301 ﬁ"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, texts, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    want = []
    for t in texts:
        w = WORD.findall(lower(t))
        shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(want)))
    for _ in label:
        for i, a in enumerate(want):
            for j, b in enumerate(want):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in want]
    assert [got[i].component_id for i in range(len(texts))] == label
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_are_whole_for_crowded_shards(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[k] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (300, 3), dtype=np.uint64), axis=1) for k in range(3)]))
    label = np.arange(len(fps))
    for i in range(len(fps)):
        simhash.merge_labels(label, np.full((near := np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)).shape, i), near)
    df = spark.createDataFrame([(i, int(x.astype(np.int64))) for i, x in enumerate(fps)], "doc_id bigint, fp bigint")
    for hot in (8, 4096):  # with and without a second dealing of hot shards
        got = {x.doc_id: x.component_id for x in simhash.link(df, hot_shard=hot).collect()}
        assert [got[i] for i in range(len(fps))] == label.tolist()


def test_bk_forest_follows_every_edge_within_the_radius():
    r = np.random.default_rng(4)
    fp = np.unique(r.integers(0, 1 << 12, 200, dtype=np.uint64))
    shard = np.sort(r.integers(0, 4, len(fp)))
    found = {(int(a), int(b)) for q, n in simhash.BKForest(shard, fp).links(3) for a, b in zip(q, n)}
    assert found == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}


def test_one_of_each_keeps_rows_without_id(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (None, "a b c d", "z")], "doc_id bigint, text string, rep string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.rep) for r in out.collect()) == [(0, "z"), (1, "x")]


def test_one_of_each_keeps_other_texts_under_one_id(spark):
    """Unrelated texts that share an id stay apart, their copies go, whatever the columns are called."""
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six seven", "red green blue black white")
    rows = [(1, a, 1), (1, b, 2), (2, a, 3), (3, b, 4), (3, c, 5), (3, c, 6), (None, a, 7), (4, None, 8), (5, "", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, grp int")
    got = sorted((str(r.doc_id), str(r.text), r.grp) for r in simhash.one_of_each(df).collect())
    assert [g[:2] for g in got] == sorted([("1", a), ("1", b), ("3", c), ("None", a), ("4", "None")])
    linked = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert linked == sorted([("1", 1), ("1", 1), ("2", 1), ("3", 1), ("3", 3), ("3", 3), ("None", None), ("4", 4), ("5", 4)], key=lambda x: (x[0], x[1]))
    assert simhash.one_of_each(df.where("grp < 0")).count() == 0


def test_quality_rules(docs, texts, empty):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        many = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        row = got[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (row.base_failed and row.kept)
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_byte_bpe_equals_the_library(docs, texts, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ids = byte_bpe.encode(docs, path, pattern)
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert [got[i] for i in range(len(texts))] == [lib.encode_ordinary(t or "") for t in texts]
    back = {r.doc_id: bytes(r.raw) for r in byte_bpe.decode(ids, path, pattern).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").encode() for t in texts]
    assert byte_bpe.digests(empty, path, pattern).count() == 0


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = [f"key{i}".encode() for i in range(3000)]
    h = byte_bpe.PerfectHash(keys)
    assert h.find(keys).tolist() == list(range(3000)) and sorted(h.slot.tolist()) == list(range(3000))
    assert (h.find([f"no{i}".encode() for i in range(1000)]) == -1).all() and byte_bpe.PerfectHash([]).find([b"x"]).tolist() == [-1]


def encoded(path, texts, end):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(path)
    return [np.array(lib.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4") for t in texts]


def test_token_files(docs, texts, empty):
    path = tokenizers.path("word_bpe_49k.json")
    files = token_files.write_token_files(docs, path, file_ids=2000)
    assert files.count() > 3
    got = {r.doc_id: r for r in token_files.read_token_files(files).collect()}
    start = 0
    for i, ids in enumerate(encoded(path, texts, 2)):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(empty, path)).count() == 0


def test_bit_planes_round_trip():
    r = np.random.default_rng(0)
    ids = [r.integers(0, 1 << 32, n, dtype=np.uint32) for n in (0, 1, 70_000, 8)]
    image, places = token_files.write_image([4, None, 6, 7], ids)
    back = list(token_files.read_image(image))
    assert [d for d, _ in back] == [4, None, 6, 7] and [x.tolist() for _, x in back] == [x.tolist() for x in ids]
    assert len(places) == 2 and image[places[0]:places[0] + 4] == b"\x28\xb5\x2f\xfd"  # a zstandard frame


def test_packing(docs, texts, empty):
    path = tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, ids in enumerate(encoded(path, texts, 0)):
        at, own = 0, sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            assert r.length == 2048 or r.piece == 0
            at += r.length
        assert at == len(ids)
        total += at
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1
    assert packing.pack(empty, path).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 4, 5, 5, 3, 7])
    start = [[0], [1, 4], [2], [3], [5]]
    bins = packing.local_search(start, lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and all(sum(lengths[b]) <= 10 for b in bins)
    assert len(bins) < len(start)
    assert sum(int(sum(lengths[b])) ** 2 for b in bins) > sum(int(sum(lengths[b])) ** 2 for b in start)


def test_secret_scan(spark, empty):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    r = np.random.default_rng(5)
    hexes = ["".join(r.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    texts = [f"some words {k} token = \"{h}\" and more text here" if k % 2 else f"plain words of number {k} stand alone here" for k, h in enumerate(hexes)]
    texts += [None, "", "token=secret: abcdefgh123", "ſecret=abcdefghij", "AKIAABCDEFGHIJKL AKIASHORT", "f" * 31, "é" + "f" * 33, "API_KEY: 'abc.def=ghi'"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    net = secret_scan.train(docs)
    got = {r.doc_id: r for r in secret_scan.scan(docs, net).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert set(said.split(",")) <= set(got[i].spans.split(","))
    clean = secret_scan.redact(docs, net)
    assert clean.count() == len(texts) and not any(h in (r.text or "") for h in hexes for r in clean.collect() if r.doc_id % 2)
    assert secret_scan.train(empty) is None and secret_scan.scan(empty, None).count() == 0


KEYS = {"ghp": ("ghp_", 36), "live": ("sk_live_", 24), "bot": ("xoxb-123456789012-", 24), "bare": ("", 40)}
CLEAN = ["9807915762804490", "2024-11-28T07:12:13Z", "river_hill_stone_42", "utf8_general_ci_v2", "water/house/tree12.html", "123e4567-e89b-12d3-a456-426614174000",
         "RiverHillStoneWaterHouse", "build-2024.11.28-rc1", "x86_64-linux-gnu-gcc", "ISBN-978-3-16-148410-0", "www.river-hill-stone.com/en/page-12"]


def test_secret_network_finds_keys_that_no_pattern_names(spark):
    """Trained on base findings alone: planted keys of other kinds are found, look-alikes left alone."""
    r = np.random.default_rng(6)
    words = "the river over green hills with small house and many trees near water stone light shadow winter summer".split()
    say = lambda n: " ".join(r.choice(words, n))
    hexes = ["".join(r.choice(list("0123456789abcdef"), 40)) for _ in range(80)]
    rows = [(i, f"{say(20)} 98079157628044{i % 90 + 10} {say(20)}" + (f' token = "{hexes[i // 4]}" {say(9)}' if i % 4 == 0 else "")) for i in range(320)]
    rows += [(1, None), (None, rows[0][1]), (4, rows[4][1])]
    net = secret_scan.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    found = {k: 0 for k in KEYS}
    for k, (prefix, n) in KEYS.items():
        for _ in range(50):
            before = say(8) + " "
            key = prefix + "".join(r.choice(letters, n))
            base, spans = secret_scan.spans_of(before + key + " " + say(8), net)
            found[k] += any(s < len(before) + len(key) and e > len(before) for s, e, _ in spans)
    assert min(found.values()) >= 45
    kept = [not any(k == 3 for _, _, k in secret_scan.spans_of(f"{say(8)} {c} {say(8)}", net)[1]) for c in CLEAN for _ in range(20)]
    assert sum(kept) >= 0.98 * len(kept), [c for c, k in zip(CLEAN, kept[::20]) if not k]


def test_secret_threshold_is_the_recall_quantile():
    r = np.random.default_rng(6)
    key = lambda: "".join(r.choice(list("ABCDEFabcdef0123456789"), 24))
    good = [secret_scan.windows(f"the key = {k}", 10, 34)[0] for k in (key() for _ in range(150))]
    bad = [secret_scan.windows("plain words and no more of them than this", 6, 11 + i % 9)[0] for i in range(150)]
    net, y = secret_scan.CharCNN(), np.r_[np.ones(100), np.zeros(100)]
    net.fit(good[:100] + bad[:100], y)
    net.calibrate(good[100:] + bad[100:], np.r_[np.ones(50), np.zeros(50)], 0.98)
    assert net.threshold == np.sort(net.probabilities(good[100:]))[1]
    assert (net.probabilities(bad[100:]) >= net.threshold).mean() <= 0.05


def test_every_document_teaches_the_secret_network(spark):
    """Findings in few of many documents that look alike to a sample, and behind many runs; threshold over all of them."""
    r = np.random.default_rng(12)
    ids = [x.i for x in spark.range(2_300).select(F.col("id").alias("i")).orderBy(F.xxhash64("id"), "id").collect()]
    hexes = ["".join(r.choice(list("0123456789abcdef"), 40)) for _ in range(100)]
    late = "9807-1576-2804 " * 2_000
    rows = [(i, "a token of plain words that says nothing at all") for i in ids[:2_200]]
    rows += [(i, f"{late if k == 0 else ''}river hill stone token = \"{h}\" and 98079157628{k:03} more") for k, (i, h) in enumerate(zip(ids[2_200:], hexes))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    net = secret_scan.train(docs)
    assert net is not None
    found = secret_scan.labelled(docs).collect()
    value = lambda s: xxhash.xxh64_intdigest(s.encode()) >> 1
    assert {x.v for x in found if x.y == 1} == {value(f"{h}") for h in hexes}
    assert {value(f"98079157628{k:03}") for k in range(100)} | {value("9807-1576-2804")} <= {x.v for x in found if x.y == 0}
    held = np.array([list(x.w) for x in found if x.y == 1 and x.v % 4 == 3], dtype=np.uint8)
    p = np.sort(1 / (1 + np.exp(-np.clip(net.scale * net.logits(held) + net.shift, -40, 40))))
    assert net.threshold == pytest.approx(p[int((1 - secret_scan.RECALL) * len(p))], rel=1e-6)
    again = secret_scan.train(docs.repartition(2))
    assert again.threshold == pytest.approx(net.threshold, rel=1e-6) and np.array_equal(again.state(), net.state())


def test_secret_rank_of_all_values(spark):
    r = np.random.default_rng(13)
    for x in (r.normal(0, 9, 5_000), np.repeat([1.5, -2.25, 7.0], 900), np.array([3.0]), 1 + r.integers(0, 9, 4_000) * 2.0 ** -52):
        df = spark.createDataFrame([(float(v),) for v in x], "t double")
        for k in {0, len(x) // 100, len(x) - 1}:
            assert secret_scan._kth(df, k) == np.sort(x)[k]


def test_a_key_anywhere_in_a_long_run_is_read():
    assert len(secret_scan.windows("x" * 500, 10, 400)) > 10
    assert all(len(w) == secret_scan.WIDTH for w in secret_scan.windows("x" * 500, 10, 400))
    seen = "".join(w[secret_scan.BEFORE:-secret_scan.AFTER] for w in secret_scan.windows("".join(map(chr, range(200, 500))), 0, 300))
    assert set(seen) == set(map(chr, range(200, 500)))


def test_secret_scan_of_odd_rows(spark):
    """Null and repeated ids, clashing columns, a very long text."""
    text = "a password: hunter2hunter2 b " + "word " * 200_000
    df = spark.createDataFrame([(None, "token=abcdefgh", 1, "x"), (5, text, 1, "x"), (5, text, 1, "x"), (5, None, 1, "x")], "doc_id bigint, text string, w int, spans string")
    got = sorted((str(r.doc_id), r.n_assign, r.spans) for r in secret_scan.scan(df, None).collect())
    assert got == [("5", 0, ""), ("5", 1, "assign:2:26"), ("5", 1, "assign:2:26"), ("None", 1, "assign:0:14")]
    assert secret_scan.redact(df, None).columns == df.columns and secret_scan.train(df) is None


@pytest.fixture(scope="module")
def scorer(spark):
    r = np.random.default_rng(8)
    words = "the river over green hills with a small house and many trees near water stone light".split()
    bad = "idiot moron stupid trash".split()
    rows, labels = [], []
    for i in range(600):
        w = list(r.choice(words, 20))
        toxic = i % 5 == 0
        if toxic:
            w[3] = bad[i // 5 % 4]
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))


@pytest.mark.parametrize("word", ["idiot", "1d10t", "IDIOT!!", "m0r0n", "stuuuupid", "s t u p i d", "t.r.a.s.h", "$tupid", "tr@sh", "i-d-i-o-t"])
def test_toxicity_sees_through_disguise(scorer, word):
    assert scorer.score(f"the river {word} over green hills") >= 0.3


LETTERS = " ".join("theriveroverthegreenhillswithasmallhouseandastup1dtreenearthewater")


@pytest.mark.parametrize("word", ["i, d, i, o, t", "s. t. u. p. i. d.", "iddiot", "iidiot", "1ddi0t", "moroon", LETTERS])
def test_toxicity_sees_through_more_disguise(scorer, word):
    assert scorer.score(f"the river {word} over green hills") >= 0.3


def test_toxicity_finds_beginnings_in_spaced_text(scorer):
    own = toxicity.Scorer(scorer.channel, {}, {"stupi": 4.0}, 1.0, 0.0)
    assert own.evidence("s t u p i d") == own.evidence("stupidity") == 4.0


def test_cover_goes_on_after_a_term_without_news():
    row = namedtuple("row", "term docs odds")
    bits = lambda docs: sum(1 << d for d in docs)
    rows = [row("a", bits(range(100)).to_bytes(50, "little"), 9.0), row("b", bits([*range(96, 100), *range(200, 204)]), 9.0), row("c", bits(range(300, 305)), 2.0)]
    assert toxicity._cover(rows) == {"a": 9.0, "c": 2.0}


def test_viterbi_equals_exhaustive_decoding(scorer):
    import itertools
    channel = scorer.channel

    def probability(reading):
        a = b = 0
        total = 0.0
        for c in reading + "\0":
            k = toxicity.letter(c)
            total += channel.log[a, b, k]
            a, b = b, k
        return total

    for word in ("1d10t", "$tup1d", "m0r0n", "h3||0", "stuuupiid", "x1", "!!", "a|b(c"):
        for doubled in (False, True):
            lattice = channel.lattice(word, doubled)
            every = [(probability("".join(t for t, _ in way)) + sum(c for _, c in way), "".join(t for t, _ in way)) for way in itertools.product(*lattice)]
            said, score = channel.decode(lattice)
            assert math.isclose(score, max(every)[0], abs_tol=1e-9) and any(s == said and math.isclose(p, score, abs_tol=1e-9) for p, s in every)
    for run in ("idiot", "xbidiots", "theriver", "a", "zz"):
        cuts = ["".join(c + (" " if b else "") for c, b in zip(run, [*bits, False])) for bits in itertools.product((False, True), repeat=len(run) - 1)]
        best = max(map(probability, cuts))
        ahead, back = channel.ways(run)
        assert math.isclose(ahead[-1], best, abs_tol=1e-9)
        assert math.isclose(channel.decode([[(c, 0.0)] for c in run], blanks=True)[1], max(best, -math.inf), abs_tol=2.0)
        for i in range(1, len(run)):
            forced = max(probability(c) for c in cuts if len(c[:[k for k, x in enumerate(c) if x != " "][i]].rstrip()) < [k for k, x in enumerate(c) if x != " "][i])
            assert math.isclose(ahead[i] + back[i], forced, abs_tol=1e-9)
        assert math.isclose(channel.standing(run, 0, len(run)), probability(run), abs_tol=1e-9)


def test_toxicity_wants_word_breaks_in_spaced_text(scorer):
    own = toxicity.Scorer(scorer.channel, {"rover": 4.0, "house": 4.0}, {"ersto": 4.0}, 1.0, 0.0)
    assert own.evidence("r i v e r o v e r") == 0.0 and own.evidence("w a t e r s t o n e") == 0.0
    assert own.evidence("r i v e r h o u s e") == 4.0 and own.evidence("r o v e r") == 4.0
    assert scorer.score("the river and/or green hills") < 0.3


def test_words_of_copies_are_no_evidence_of_their_own():
    row = namedtuple("row", "term docs odds")
    bits = lambda docs: sum(1 << d for d in docs)
    copies = [row(f"copied{chr(97 + i)}{i}", bits(range(20)), 6.0) for i in range(20)]
    words = [row("moron", bits(range(0, 200, 9)), 6.0), row("idiot", bits(range(0, 200, 4)), 6.0), row("weak", bits(range(0, 99, 9)), 2.5)]
    assert set(toxicity._apart(copies + words)) == {"moron", "idiot"} and toxicity._apart([]) == {}


def test_toxicity_of_odd_rows_and_held_out_labels(spark, scorer):
    """Fold 2 teaches nothing, lang, source and doc_id score nothing; null and repeated ids, clashing columns, very long texts."""
    r = np.random.default_rng(8)
    words = "the river over green hills with a small house and many trees near water stone light".split()
    rows, labels = [], []
    for i in range(500):
        w = list(r.choice(words, 20))
        toxic = i % 5 == 0
        if toxic:
            w[3] = "idiot" if i % 10 else "moron"
        rows.append((i, " ".join(w), "en", "web"))
        labels.append((i, int(toxic)))
    schema = "doc_id bigint, text string, lang string, source string"
    docs, own = spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    turned = own.withColumn("toxic", F.when(fold == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda df, labels: {x.doc_id: x.score for x in toxicity.score(df, toxicity.train(docs, labels)).collect()}
    first = score(docs, own)
    assert first == score(docs, turned)
    assert first == score(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("idiot")), own)
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((first[i] >= 0.3) == (i % 5 == 0) for i in held)
    odd = spark.createDataFrame([(None, "you idiot", "a", 1.0), (3, "you idiot", "a", 1.0), (3, "calm water", "a", 1.0), (3, "word " * 100_000 + "1d10t", "a", 1.0), (9, None, None, None)],
                                "doc_id bigint, text string, held_out string, score double")
    got = sorted((str(x.doc_id), x.predicted) for x in toxicity.score(odd, scorer).collect())
    assert got == [("3", 0), ("3", 1), ("3", 1), ("9", 0), ("None", 1)]
    assert sorted(x.doc_id or 0 for x in toxicity.drop_toxic(odd, scorer).collect()) == [3, 9]


@pytest.mark.parametrize("text", ["", "the river over green hills", "a a a a a a", "house no. 10 and 3 trees, 50% light!", "x" * 50_000, "a b c d e f g"])
def test_toxicity_leaves_clean_text_alone(scorer, text):
    assert scorer.score(text) < 0.3


def test_toxicity_without_classes(spark, empty):
    docs = spark.createDataFrame([(1, None), (None, "x")], "doc_id bigint, text string")
    none = spark.createDataFrame([(1, None)], "doc_id bigint, toxic int")
    assert toxicity.train(docs, none) is None
    assert [(r.score, r.predicted) for r in toxicity.score(docs, None).collect()] == [(0.0, 0), (0.0, 0)]
    assert toxicity.drop_toxic(docs, None).count() == 2 and toxicity.score(empty, None).count() == 0


def test_lm_scoring(docs, texts, empty):
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    token = {i: [*WORD.findall(lower(t)), None] for i, t in enumerate(texts)}
    held = {i for i in token if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, ws in token.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in token.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    own = [got[i] for i in sorted(held)]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert lm_scoring.score(empty).count() == 0


def test_lm_counts_bigrams_exactly(docs, texts):
    counts, n, v = lm_scoring.token_counts(docs)
    token = {i: [*WORD.findall(lower(t)), None] for i, t in enumerate(texts)}
    pairs = Counter((a, b) for i, ws in token.items() if zlib.crc32(str(i).encode()) % 5 != 1 for a, b in zip([None, *ws], ws))
    for row in counts.collect():
        many, _, _, own, _ = lm_scoring._parts(row.asDict(), n, v)
        at = 0
        for i, k in zip(row["doc_ids"], many):
            assert own[at:at + k].tolist() == [pairs[p] for p in zip([None, *token[i]], token[i])]
            at += k


def test_lm_mixture_against_plain_dictionaries(spark):
    """Counts in many blocks and shards, weights by EM, and every score, recomputed with dictionaries."""
    r = np.random.default_rng(12)
    words = [f"w{int(k)}" for k in np.minimum(r.zipf(1.4, 6000), 900)]
    texts, at = [], 0
    for i in range(150):
        n = int(r.integers(0, 80))
        texts.append(" ".join(words[at:at + n]))
        at += n
    rows = [(i if i % 7 else 3, t) for i, t in enumerate(texts)] + [(None, "w1 w2 w1"), (None, None)]  # a hot id, and none
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts, n, v = lm_scoring.token_counts(df, block_bytes=2000, shard_bytes=3000)
    weights = lm_scoring.learn_weights(counts, n, v)
    assert counts.count() > 5
    token = [[*(t or "").split(), None] for _, t in rows]
    learn = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    c = Counter(w for ws, y in zip(token, learn) if y for w in ws)
    pairs = Counter(p for ws, y in zip(token, learn) if y for p in zip([None, *ws], ws))
    assert (n, v) == (sum(c.values()), len(c))
    bucket = lambda k: int(np.searchsorted(lm_scoring.BUCKETS, k, side="right"))
    for b in range(len(weights)):
        terms = Counter()
        for ws, y in zip(token, learn):
            for u, w in zip([None, *ws], ws) if y else ():
                if bucket(c[u] - 1) == b:
                    terms[c[u] - 1, c[w] - 1, pairs[u, w] - 1] += 1
        if b == 0 or not terms:
            continue
        step = lambda x: 10 ** (round(math.log10(x * (v + 1)) / 0.05) * 0.05) if x else 0.0  # noqa: E731  ratios go to EM in steps
        p = np.array([[1.0, step(w / (n - 1)), step(uw / u)] for u, w, uw in terms])
        many, plain = np.array(list(terms.values()), dtype=float), np.full(3, 1 / 3)
        for _ in range(50):
            share = p * plain
            share /= share.sum(axis=1, keepdims=True)
            plain = (share * many[:, None]).sum(axis=0) + 1e-3
            plain /= plain.sum()
        assert np.allclose(weights[b], plain, atol=1e-6)
    want = []
    for (d, _), ws in zip(rows, token):
        total = 0.0
        for u, w in zip([None, *ws], ws):
            l = weights[bucket(c[u])]
            total += math.log10(l[0] / (v + 1) + l[1] * c[w] / n + (l[2] * pairs[u, w] / c[u] if c[u] else l[2] / (v + 1)))
        want.append((str(d), len(ws), round(total, 6)))
    got = counts.mapInArrow(lm_scoring._scorer(n, v, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").collect()
    assert sorted((str(x.doc_id), x.n_tokens, round(x.score, 6)) for x in got) == sorted(want)

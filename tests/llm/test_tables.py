"""Vectors, urls and the pipeline against brute force."""

import math

import numpy as np
import pytest

from tidemark.llm import url_filter, vector_dedup


def components(link):
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None], len(link)).min(axis=1))
        if (new == label).all():
            return label
        label = new


def test_vectors_find_every_link(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 16))
    x = (centre[r.integers(0, 12, 700)] + r.normal(scale=0.14, size=(700, 16))).astype(np.float32)
    x[5:9] = x[4]
    x[9] = 3 * x[4]
    rows = [(i, v.tolist(), 0, 9) for i, v in enumerate(x)]
    rows += [(700, None, 0, 9), (701, [0.0] * 16, 0, 9), (702, [float("nan")] * 16, 0, 9), (703, [1.0, 2.0], 0, 9), (704, [2.0, 4.0], 0, 9), (705, [], 0, 9), (None, x[0].tolist(), 0, 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, list int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    for piece in (64, 4096):  # many tiles, and one for each list
        got = {q.vec_id: q for q in vector_dedup.near_duplicates(df, sample=300, lists=8, piece=piece, recall=1).collect()}
        assert [got[i].n_links for i in range(700)] == link.sum(axis=1).tolist()
        assert [got[i].component_id for i in range(700)] == components(link).tolist()
        assert all(got[i].kept == (got[i].component_id == i) for i in range(700))
        assert [got[i].n_links for i in range(700, 706)] == [0, 0, 0, 1, 1, 0] and got[704].component_id == 703
        assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)


def unit_links(x):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    return link


def test_the_measured_margin_keeps_the_recall(spark):
    """A third of all vectors in one crowd that k-means spreads over many lists, groups of near copies, and noise."""
    r = np.random.default_rng(9)
    n, size = 4_000, 1_300
    x = r.normal(size=(n, 32))
    x[:size] = r.normal(size=32) + r.normal(scale=0.1, size=(size, 32))
    x[size:2 * size] = x[size + r.integers(0, 300, size)] + r.normal(scale=0.12, size=(size, 32))
    x = x[r.permutation(n)].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    want = unit_links(x).sum(axis=1)
    got = {row.vec_id: row.n_links for row in vector_dedup.near_duplicates(df, queries=200).collect()}
    got = np.array([got[i] for i in range(n)])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    assert (got[want > 0] / want[want > 0]).mean() >= 0.98


def test_links_of_a_large_group_over_many_lists_are_whole(spark):
    r = np.random.default_rng(11)
    n, size = 3_000, 1_000
    x = r.normal(size=(n, 16))
    x[:size] = r.normal(size=16) + r.normal(scale=0.12, size=(size, 16))
    x = x[r.permutation(n)].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert want.max() >= size // 2
    got = {row.vec_id: row.n_links for row in vector_dedup.near_duplicates(df, recall=1).collect()}
    assert [got[i] for i in range(n)] == want.tolist()


def test_vectors_without_any(spark):
    df = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in vector_dedup.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert vector_dedup.near_duplicates(df.where("vec_id = 2")).count() == 0


URLS = [
    (1, "https://WWW.Example.com/en/a", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    (2, "https://m.example.com/en/a?x=/fr/#y", "m.example.com", "/en/a", "example.com/en/", "block"),
    (3, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (4, "http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    (5, "http://a.net/de/1", "a.net", "/de/1", None, None),
    (6, "http://a.com", "a.com", "", None, None),
    (7, "no scheme", "", "", None, None),
    (8, None, "", "", None, None),
    (9, "x://y.com?q=://z.net/es/", "y.com", "", None, None),
    (10, "http://a.b.net/fr/2", "a.b.net", "/fr/2", "net/fr/", "block"),
    (10, "http://a.b.net/fr/2", "a.b.net", "/fr/2", "net/fr/", "block"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "<html>", "h") for i, u, *_ in URLS], "page_id bigint, url string, html string, host string")
    got = sorted((tuple(r) for r in url_filter.judge(df).collect()), key=lambda r: r[0])
    assert [r[:4] for r in got] == [(i, h, p, rule) for i, _, h, p, rule, _ in URLS]
    assert all(r[4] == want if (want := u[5]) else r[4] in ("allow", "block") for r, u in zip(got, URLS))
    assert url_filter.judge(df.where("page_id < 0")).count() == 0


def test_url_trees_learn_from_other_folds(spark):
    """Held-out accuracy on a rule that the features carry; null ids, repeated rows and clashing columns come through."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(900):
        bad = bool(r.integers(0, 2))
        name = "".join(r.choice(list("abcdefghij"), 6))
        rows.append((i, f"http://{name}.net/fr/{'9' * 12}-{'1' * 9}" if bad else f"http://{name}.com/page", "e", 1))
    unruled = [(1000 + i, f"http://q{i}.net/de/{'9' * 12}-{'1' * 9}", "e", 1) for i in range(50)] + [(2000 + i, f"http://q{i}.org/page", "e", 1) for i in range(50)]
    rows += unruled + [(None, "http://q.net/de/" + "9" * 12 + "-" + "1" * 9, "e", 1), (1000, unruled[0][1], "e", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, _fold int")
    got = [(x.page_id, x.rule, x.verdict) for x in url_filter.judge(df).collect()]
    assert len(got) == len(rows)
    said = {p: v for p, rule, v in got if rule is None}
    assert np.mean([said[1000 + i] == "block" for i in range(50)] + [said[2000 + i] == "allow" for i in range(50)]) >= 0.95
    assert said[None] == "block"


def test_url_features_against_plain_python(spark):
    from collections import Counter
    urls = ["http://a.b.com/x/y-1?q=2&r=3#f", "", None, "x://h", "http://é.net/fr/ééé?a", "http://A.net"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for row in url_filter._features(df, ("page_id", "url")).collect():
        u = row.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        head, query = (rest.split("#")[0].split("?", 1) + [""])[:2]
        host, path = (head.split("/", 1)[0].lower(), "/" + head.split("/", 1)[1]) if "/" in head else (head.lower(), "")
        many = Counter(u)
        entropy = -sum(c / len(u) * math.log2(c / len(u)) for c in many.values()) if u else 0.0
        digits = sum(c in "0123456789" for c in u)
        want = (len(u), len(host), len(path), path.count("/"), host.count("."), digits / len(u) if u else 0.0, entropy, query.count("&") + 1 if query else 0, u.count("-"))
        assert (row.host, row.path, row._suffix) == (host, path, host.split(".")[-1])
        assert (row.url_length, row.host_length, row.path_length, row.depth, row.host_depth, row.digit_ratio, row.entropy, row.n_params, row.n_hyphens) == pytest.approx(want, abs=1e-9)


def test_entropy(spark):
    for text in ("", "a", "aab", "https://é.com/1"):
        got = spark.createDataFrame([(text,)], "t string").select(url_filter._entropy(url_filter.F.col("t"))).first()[0]
        want = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text)) if text else 0.0
        assert got == pytest.approx(want, abs=1e-9)


def test_pipeline_stages(spark):
    import os
    import corpus_pipeline as p
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    from tidemark.llm import quality_rules, simhash
    from tidemark.llm.common import saved, table
    docs = table(spark, sf, "documents")
    assert [n for n, _ in p.STAGES] == ["quality rules", "toxicity", "simhash near-dedup", "secret scan", "best-fit packing"]
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf), "stage")
        assert docs.columns == before.columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality rules":
            assert now == {r.doc_id for r in quality_rules.judge(before).where("kept").collect()}
        if name == "simhash near-dedup":
            assert now == {r.component_id for r in simhash.near_duplicates(before).collect()}
        if name == "secret scan":
            assert now == seen
        assert now <= seen
        seen = now
    assert {r.doc_id for r in p.run(spark, sf).select("doc_id").collect()} == seen


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_links_are_found(spark, seed):
    """Random vectors, and a hundred pairs just beyond the threshold: next to nothing in a sample has a link."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(100):
        c, z = r.uniform(0.951, 0.97), r.normal(size=64)
        z -= (z @ x[k]) * x[k]
        x[11_000 + k] = c * x[k] + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {row.vec_id: (row.n_links, row.component_id) for row in vector_dedup.near_duplicates(df).where("n_links > 0").collect()}
    assert sum(got.get(k, (0, -1))[1] == k and got.get(11_000 + k, (0, -1))[1] == k for k in range(100)) >= 99

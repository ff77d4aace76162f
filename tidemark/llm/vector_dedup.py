"""Embedding near-duplicates by product quantisation with coarse inverted lists.

Coarse lists come from k-means over a bounded sample, about the square root of the number of
vectors (at most ``LISTS``); each vector belongs to its nearest centroid, and its residual is coded
by one of 256 words in each of eight subspaces.  Between unit vectors cosine >= c means a distance
of at most r = sqrt(2 - 2c), so that a linked vector can lie in the list of centroid k only if the
query is within r of the plane between its own centroid and k.  Few links need that much: real
near copies differ along many directions.  Therefore the margin is measured: ``QUERIES`` vectors are
compared with *all* vectors, and the margin is the smallest at which ``RECALL`` of their links,
counted by link and by query, are found, with a tenth on top (r over the root of the dimension
at least); ``recall=1`` takes r itself and finds
every link.  A vector probes every list within the margin, however many these are.  Of two vectors
each must probe the other's list, so that an unordered pair of lists is searched once, between the
members of either that probe the other, and a link is credited to both ends.  In a pair of lists the
distance from each query to each member's decoded residual is asymmetric; as each member also
stores the length of its coding error, only members with distance <= r + error can be linked, and
those get the exact cosine in double precision.

Scale.  Exact copies are folded first.  Lists are put together to blocks of bounded size from counts
per list (at most ``LISTS`` rows), and a list that holds a third of all vectors is dealt over many
blocks.  A vector goes to a tile (block, block) only if it probes a list of the other block.  A tile
returns a number of links for each vector and a spanning forest of the links, never all pairs.  The
pairs searched grow with the power 1.5 of the distinct vectors up to ``LISTS`` squared of them, and
beyond with the square, divided by the lists' number; so they do in a crowd whose members all link,
as each vector's number of links is asked for.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link
with nothing; vectors of different lengths do not link; vectors of another length than the most
frequent are compared exactly, without codes; rows without a vec_id have 0 links, no component and
are not kept; repeated rows count as other vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import components, saved
from tidemark.llm.simhash import merge_labels

COSINE = 0.95
SAMPLE = 16_384
LISTS = 4096
QUERIES, RECALL = 512, 0.999
LINKED = 100  # sample vectors with links, from which the margin is measured
STEPS = 256  # of the measured margin
SUBSPACES, WORDS = 8, 256
PIECE = 1024
BLOCKS = 8  # at least, if they hold more than a piece


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    r = np.random.default_rng(seed)
    centre = x[r.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centre)
        many = np.bincount(near, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centre)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre ** 2).sum(axis=1) / 2
    return np.concatenate([(half - x[k:k + 4096] @ centre.T).argmin(axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centroids and the residual's words in each subspace."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.centre = _kmeans(sample, lists)
        residual = sample - self.centre[_nearest(sample, self.centre)]
        cuts = [self.dim * k // SUBSPACES for k in range(SUBSPACES + 1)]
        self.parts = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        self.words = [_kmeans(residual[:, p], WORDS, rounds=5) for p in self.parts]

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the coding error) of each row."""
        code = np.stack([_nearest(residual[:, p], w) for p, w in zip(self.parts, self.words)], axis=1)
        error = sum(((residual[:, p] - w[code[:, k]]) ** 2).sum(axis=1) for k, (p, w) in enumerate(zip(self.parts, self.words)))
        return code, np.sqrt(error)

    def planes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Rows by lists: how far is x from the plane between its own centroid and the list's?"""
        sq = (self.centre ** 2).sum(axis=1)
        d = (x ** 2).sum(axis=1)[:, None] - 2 * x @ self.centre.T + sq
        lists, at = np.unique(own, return_inverse=True)
        apart = np.sqrt(np.maximum(sq[lists][:, None] + sq - 2 * self.centre[lists] @ self.centre.T, 0))
        return (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * apart[at], 1e-12)

    def probes(self, x: np.ndarray, own: np.ndarray, margin: float) -> np.ndarray:
        """Rows by lists: which lists are within the margin?"""
        return self.planes(x, own) <= margin + 1e-6

    def decoded(self, centre: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        out = np.repeat(centre[None], len(code), axis=0)
        for k, (p, w) in enumerate(zip(self.parts, self.words)):
            out[:, p] += w[code[:, k]]
        return out

    def near(self, query: np.ndarray, decoded: np.ndarray, error: np.ndarray, radius: float) -> np.ndarray:
        """Asymmetric distances to decoded members: which (query, member) pairs may be linked?"""
        query, decoded = query.astype(np.float32), decoded.astype(np.float32)
        total = (query ** 2).sum(axis=1)[:, None] - 2 * (query @ decoded.T) + (decoded ** 2).sum(axis=1)
        return total <= ((radius + error + 1e-3) ** 2).astype(np.float32)[None]


def _unit(values: list | np.ndarray) -> np.ndarray:
    x = np.array(values, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column) -> np.ndarray:
    """Rows of one length from an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def representatives(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, group key v or null) for every row, and (v, dim, rep, copies) for every distinct vector."""
    e = F.col(column).cast("array<double>")
    good = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), F.col(column)).alias("v"))
    one = rows.where("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    return rows, one.withColumn("dim", F.size("v"))


def _fit(distinct: DataFrame, sample: int, lists: int) -> Quantiser | None:
    dims = distinct.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if dims is None:
        return None
    n_lists = int(max(1, min(lists, round(dims.n ** 0.5), sample // 4)))
    rows = distinct.where(F.col("dim") == dims.dim).select("v", "rep").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    return Quantiser(_unit([r.v for r in rows]), n_lists)


INDEXED = "rep long, copies long, v {0}, list int, codes binary, error double, probes binary"
DEALT = "own_group int, low int, high int, block int, " + INDEXED


def _needed(distinct: DataFrame, q: Quantiser, cosine: float, radius: float, queries: int) -> np.ndarray:
    """Links of sample vectors with all others: a row for each that has any, counted by the step of margin at which they are found."""
    rows = distinct.where(F.col("dim") == q.dim).select("v", "rep").orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(queries).collect()
    s, names = _unit([r.v for r in rows]), np.array([r.rep for r in rows])
    s_own = _nearest(s, q.centre)

    def run(batches):
        s_planes = q.planes(s, s_own)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                x, rep = _unit(_vectors(part.column("v"))), part.column("rep").to_numpy()
                i, j = np.nonzero((x @ s.T >= cosine) & (rep[:, None] != names))
                own = _nearest(x, q.centre)
                need = np.maximum(q.planes(x[i], own[i])[np.arange(len(i)), s_own[j]], s_planes[j, own[i]]) if len(i) else np.zeros(0)
                step = np.clip(np.ceil(need / radius * STEPS), 0, STEPS).astype(np.int64)
                seen, many = np.unique(j * (STEPS + 1) + step, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen // (STEPS + 1)), pa.array(seen % (STEPS + 1)), pa.array(many.astype(np.int64))], ["query", "step", "links"])

    found = (distinct.where(F.col("dim") == q.dim).select("v", "rep").mapInArrow(run, "query long, step long, links long")
             .groupBy("query", "step").agg(F.sum("links").alias("links")).collect())  # at most queries x steps
    table = np.zeros((len(s), STEPS + 1))
    for r in found:
        table[r.query, r.step] = r.links
    return table[table.any(axis=1)]


def _margin(distinct: DataFrame, q: Quantiser, cosine: float, radius: float, recall: float, queries: int) -> float:
    """The margin at which ``recall`` of the links between a sample and all vectors are found.

    It is measured only where ``LINKED`` sample vectors have links, of ``queries`` or eight times as many.  Where links are
    rarer the margin is the radius, at which no list that may hold a link is left out.
    """
    if recall >= 1:
        return radius
    table = _needed(distinct, q, cosine, radius, queries)
    if len(table) < LINKED:
        table = _needed(distinct, q, cosine, radius, 8 * queries)
    if len(table) < LINKED:
        return radius
    share = np.minimum(np.cumsum(table.sum(axis=0)) / table.sum(), np.cumsum((table / table.sum(axis=1, keepdims=True)).mean(axis=0)))
    return float(min(radius, radius * max(1.1 * np.argmax(share >= recall - 1e-12) / STEPS, 2 * q.dim ** -0.5)))


def _index(q: Quantiser, margin: float):
    """Every vector's list, codes and probes (a bit a list); vectors of other lengths share the list -dim."""
    def run(batches):
        for b in batches:
            dims = np.array(b.column("dim").to_pylist())
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                for s in range(0, part.num_rows, 1024):
                    rows = part.slice(s, 1024)
                    n = rows.num_rows
                    if dim == q.dim:
                        x = _unit(_vectors(rows.column("v")))
                        own = _nearest(x, q.centre)
                        codes, error = q.codes(x - q.centre[own])
                        codes = [r.tobytes() for r in codes.astype(np.uint8)]
                        probes = [r.tobytes() for r in np.packbits(q.probes(x, own, margin), axis=1)]
                    else:
                        own, error = np.full(n, -dim), np.zeros(n)
                        codes = probes = [b""] * n
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("rep"), rows.column("copies"), rows.column("v"), pa.array(own, pa.int32()),
                         pa.array(codes, pa.binary()), pa.array(error, pa.float64()), pa.array(probes, pa.binary())],
                        ["rep", "copies", "v", "list", "codes", "error", "probes"])
    return run


def _bits(column, n: int) -> np.ndarray:
    """Rows of n bits from a binary column."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1, count=n).astype(bool)


def _places(sizes: dict[int, int], lists: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each list: neighbours share a block up to ``block`` rows."""
    first, parts = np.zeros(lists, dtype=np.int64), np.ones(lists, dtype=np.int64)
    at = held = 0
    for k in range(lists):
        n = sizes.get(k, 0)
        if held and held + n > block:
            at, held = at + 1, 0
        first[k], parts[k] = at, max(1, -(-n // block))
        at, held = at + parts[k] - 1, held + n if parts[k] == 1 else block
    return first, parts


def _deal(first: np.ndarray, parts: np.ndarray):
    """Each vector once for every block of which it probes a list, with both blocks in order."""
    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                rows = b.slice(s, 1024)
                own = rows.column("list").to_numpy()
                block = first[own] + rows.column("turn").to_numpy() % parts[own]
                i, k = np.nonzero(_bits(rows.column("probes"), len(first)))
                many = parts[k]
                other = np.repeat(first[k] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                i, other = np.divmod(np.unique(np.repeat(i, many) << 40 | other), 1 << 40)  # small lists share a block
                mine = block[i]
                rows = rows.drop_columns(["turn"]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int32()) for x in (np.zeros(len(i)), np.minimum(mine, other), np.maximum(mine, other), mine)] + rows.columns,
                    ["own_group", "low", "high", "block", *rows.schema.names])
    return run


FOUND = "a long, b long, links long"
SURE = 1e-9  # beyond the rounding of a cosine in double precision


def _cosines(x: np.ndarray, y: np.ndarray, cosine: float, may: np.ndarray | None) -> np.ndarray:
    """Which pairs have the cosine?  ``may`` marks the pairs to look at."""
    if may is not None and may.mean() < 0.02:
        i, j = np.nonzero(may)
        hit = np.zeros_like(may)
    else:
        product = x @ y.T
        hit = product >= cosine + SURE
        doubt = np.abs(product - cosine) <= SURE
        if may is not None:
            hit, doubt = hit & may, doubt & may
        i, j = np.nonzero(doubt)
    for k in range(0, len(i), 1 << 15):
        ii, jj = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
        hit[ii, jj] = np.einsum("nd,nd->n", x[ii], y[jj]) >= cosine
    return hit


def _tile(q: Quantiser, cosine: float, radius: float):
    """Links between the vectors of two blocks, or of one: (vector, null, links) and spanning (a, b, null)."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("list").combine_chunks()
        rep, which, block = (rows.column(c).to_numpy() for c in ("rep", "list", "block"))
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        copies = rows.column("copies").to_numpy().astype(np.float64)
        x = _unit(_vectors(rows.column("v")))
        coded = which[0] >= 0
        if coded:
            code = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint8).reshape(len(rep), -1)
            error, probes = rows.column("error").to_numpy(), _bits(rows.column("probes"), len(q.centre))
            decoded = np.concatenate([q.decoded(q.centre[k], code[which == k]) for k in np.unique(which)])
        many, label = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
        sides = [{k: np.flatnonzero((block == side) & (which == k)) for k in np.unique(which[block == side])} for side in (low, high)]
        for k, left in sides[0].items():
            for m, right in sides[1].items():
                if low == high and m < k:
                    continue
                a, b = (left[probes[left, m]], right[probes[right, k]]) if coded else (left, right)
                same = low == high and k == m
                for s in range(0, len(a), PIECE):
                    i = a[s:s + PIECE]
                    for t in range(s if same else 0, len(b), PIECE):
                        j = b[t:t + PIECE]
                        may = q.near(x[i], decoded[j], error[j], radius) if coded else None
                        if may is not None and not may.any():
                            continue
                        hit = _cosines(x[i], x[j], cosine, may)
                        if same and s == t:
                            hit = np.triu(hit, 1)
                        if hit.any():
                            many[i] += (hit @ copies[j]).astype(np.int64)
                            many[j] += (copies[i] @ hit).astype(np.int64)
                            ii, jj = np.nonzero(hit & (label[i][:, None] != label[j]))
                            merge_labels(label, i[ii], j[jj])
        seen, own = np.flatnonzero(many), np.flatnonzero(label != np.arange(len(rep)))
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.Table.from_arrays([pa.array(np.r_[rep[seen], rep[own]], pa.int64()), pa.concat_arrays([none(len(seen)), pa.array(rep[label[own]], pa.int64())]),
                                     pa.concat_arrays([pa.array(many[seen], pa.int64()), none(len(own))])], ["a", "b", "links"])
    return run


def near_duplicates(vectors: DataFrame, column: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE, lists: int = LISTS, piece: int = PIECE,
                    recall: float = RECALL, queries: int = QUERIES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    rows, distinct = representatives(vectors, column)
    distinct = saved(distinct, "vectors")
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    q = _fit(distinct, sample, lists)
    if q is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    kind = distinct.schema["v"].dataType.simpleString()
    indexed = saved(distinct.select("v", "dim", "rep", "copies").mapInArrow(_index(q, _margin(distinct, q, cosine, radius, recall, queries)), INDEXED.format(kind)), "codes")
    # bounded by the number of lists
    sizes = {r.list: r.n for r in indexed.where("list >= 0").groupBy("list").agg(F.count("*").alias("n")).collect()}
    first, parts = _places(sizes, len(q.centre), max(piece, min(8 * piece, -(-sum(sizes.values()) // BLOCKS))))
    turn = F.pmod(F.xxhash64("rep"), F.lit(1 << 20)).alias("turn")
    dealt = indexed.where("list >= 0").select("*", turn).mapInArrow(_deal(first, parts), DEALT.format(kind))
    others = indexed.where("list < 0")
    blocks = others.groupBy("list").agg(F.ceil(F.count("*") / piece).cast("int").alias("blocks"))
    others = (others.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select(F.col("list").alias("own_group"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *indexed.columns))
    found = saved(dealt.unionByName(others).groupBy("own_group", "low", "high").applyInArrow(_tile(q, cosine, radius), FOUND), "links")
    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    per = (distinct.join(links, distinct.rep == links.a, "left").join(joined, F.col("rep") == F.col("node"), "left")
           .select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    known = rows.where("vec_id is not null")
    out = known.join(per, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

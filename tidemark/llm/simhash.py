"""SimHash near-duplicates: fingerprints, then BK-trees over shards of the fingerprints.

Scale.  Fingerprints of all documents never meet in one place.  Two fingerprints within radius 3
agree on at least two of five bit blocks, so every distinct fingerprint is dealt to the ten shards
"(two blocks, their bits)"; a shard's fingerprints share about 26 bits.  A shard with more than
``HOT_SHARD`` fingerprints is dealt once more by one of four blocks of its other bits (again some
block must agree), so large groups of near copies are divided without losing a link.  Trees are
shipped to the task of their shard by the shuffle.  They are not broadcast: that would bring the
fingerprints of all documents to the driver.

Each task builds the BK-trees of its shards side by side with numpy (a node's children are keyed
by their Hamming distance to it) and follows, for every fingerprint, only edges within the radius
of its distance to the node.  A task returns a spanning forest of the links that it found, at most
one row for each fingerprint, instead of all pairs.

Defined results: null texts and texts without words have fingerprint zero, linked like any other;
exact copies and repeated rows share a fingerprint and so a component; a row whose doc_id is null
has a null component and links with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import components, documents, saved

RADIUS = 3
SHINGLE = 3
SEED = 42
HOT_SHARD = 4096
SALTS = 8
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
BYTE = np.arange(8) * 256


def _mask(lo: int, hi: int) -> int:
    return ((1 << (hi - lo)) - 1) << lo


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


PAIRS = tuple(combinations(range(len(BLOCKS)), 2))
PAIR_MASKS = tuple(_mask(*BLOCKS[i]) | _mask(*BLOCKS[j]) for i, j in PAIRS)


def _rest_masks(taken: int, parts: int = RADIUS + 1) -> tuple[int, ...]:
    """The bits outside ``taken`` in ``parts`` blocks; each mask has ``taken`` and one block."""
    free = [b for b in range(64) if not taken >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return tuple(taken | sum(1 << b for b in free[cuts[k]:cuts[k + 1]]) for k in range(parts))


def fingerprint(text: bytes) -> int:
    """Bit b is set if it is set in over half the XXH64 values of the text's shingles."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-SHINGLE]]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1:])], dtype=np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + BYTE).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits((2 * seen > len(hashes)).astype(np.uint8), axis=1, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [_signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long."""
    bare = documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return bare.mapInArrow(_fingerprints, "doc_id long, fp long")


class BKForest:
    """BK-trees of several shards, level by level in numpy.

    ``shard`` numbers must be ascending and fingerprints distinct within a shard.  The first
    fingerprint of a shard is its root; ``edge`` is a node's distance to its parent.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        first = np.r_[True, shard[1:] != shard[:-1]]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.flatnonzero(~first)
        at = self.root[rest]
        while len(rest):
            key = at * 65 + np.bitwise_count(fp[rest] ^ fp[at]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            nodes = rest[new]
            parent[nodes], edge[nodes] = key[new] // 65, key[new] % 65
            at = nodes[np.cumsum(new) - 1][~new]
            rest = rest[~new]
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 65 + edge[child]
        order = np.argsort(key, kind="stable")
        self.child, self.key = child[order], key[order]

    def links(self, radius: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius; visits are worked off in bounded pieces."""
        todo = [(np.arange(k, min(k + most, len(self.fp))), None) for k in range(0, len(self.fp), most)]
        while todo:
            query, node = todo.pop()
            if node is None:
                node = self.root[query]
            if len(query) > most:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (query != node)
            if hit.any():
                yield query[hit], node[hit]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 1))
            many = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right") - lo
            total = int(many.sum())
            if total:
                within = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
                todo.append((np.repeat(query, many), self.child[np.repeat(lo, many) + within]))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union in place: afterwards a[i] and b[i] share a label, the smallest index of both sets."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _forest_links(batches: Iterator[pa.RecordBatch], radius: int = RADIUS, gather: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Spanning links of shards that arrive sorted; a buffer is searched at the end of a shard."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def search(parts):
        combo, value, fp, rep = (np.concatenate(x) for x in zip(*parts))
        new = np.r_[True, (combo[1:] != combo[:-1]) | (value[1:] != value[:-1])]
        shard = np.cumsum(new)
        several = np.bincount(shard)[shard] > 1
        fp, rep, shard = fp[several].view(np.uint64), rep[several], shard[several]
        label = np.arange(len(fp))
        for q, x in BKForest(shard, fp).links(radius):
            merge_labels(label, q, x)
        own = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[label[own]])], ["a", "b"])

    for batch in batches:
        columns = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(columns[0]):
            continue
        held.append(columns)
        rows += len(columns[0])
        if rows >= gather:
            combo, value = columns[:2]
            turns = np.flatnonzero((combo[1:] != combo[:-1]) | (value[1:] != value[:-1]))
            if len(turns):
                cut = turns[-1] + 1
                held[-1] = tuple(c[:cut] for c in columns)
                yield search(held)
                held = [tuple(c[cut:] for c in columns)]
                rows = len(held[0][0])
    if held:
        yield search(held)


def _shards(distinct: DataFrame, hot_shard: int) -> DataFrame:
    """(combo, value, fp, rep) for every shard of every distinct fingerprint."""
    long = lambda m: F.lit(_signed(m)).cast("long")
    fp = F.col("fp")
    keys = distinct.select("fp", "rep", F.explode(F.array(*[
        F.struct(F.lit(i).alias("combo"), fp.bitwiseAND(long(m)).alias("value")) for i, m in enumerate(PAIR_MASKS)])).alias("k")
    ).select("fp", "rep", "k.combo", "k.value")
    hot = keys.groupBy("combo", "value").count().where(F.col("count") > hot_shard).select("combo", "value", F.lit(True).alias("hot"))
    parts = RADIUS + 1
    finer: Column = F.array(*[F.array(*[long(m) for m in _rest_masks(taken)]) for taken in PAIR_MASKS])
    again = F.transform(F.get(finer, F.col("combo")), lambda m, j: F.struct(
        (F.lit(len(PAIRS)) + F.col("combo") * parts + j).cast("int").alias("combo"), fp.bitwiseAND(m).alias("value")))
    once = F.array(F.struct(F.col("combo").cast("int").alias("combo"), F.col("value").alias("value")))
    return keys.join(hot, ["combo", "value"], "left").select(
        F.explode(F.when(F.col("hot"), again).otherwise(once)).alias("k"), "fp", "rep").select("k.combo", "k.value", "fp", "rep")


def _grouped(fps: DataFrame, hot_shard: int = HOT_SHARD) -> DataFrame:
    """Adds grp, the smallest fingerprint reachable over links, and component_id to saved (doc_id, fp).

    Links join fingerprints, so that two texts under one doc_id stay apart.
    """
    distinct = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = _shards(distinct.select("fp", F.col("fp").alias("rep")), hot_shard)
    dealt = shards.repartition(n, "combo", "value").sortWithinPartitions("combo", "value")
    joined = components(dealt.mapInArrow(_forest_links, "a long, b long"))
    of_fp = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("grp"))
    ids = of_fp.groupBy("grp").agg(F.min("first").alias("component_id"))
    # a crowd of exact copies is dealt over SALTS places, the small side once for each
    of_fp = of_fp.join(ids, "grp").select("fp", "grp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = fps.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    known = F.col("doc_id").isNotNull()
    return salted.join(of_fp, ["fp", "salt"], "left").select(
        "doc_id", "fp", F.when(known, F.col("grp")).alias("grp"), F.when(known, F.col("component_id")).alias("component_id"))


def link(fps: DataFrame, hot_shard: int = HOT_SHARD) -> DataFrame:
    """Adds component_id to (doc_id, fp): the smallest doc_id reachable over links."""
    return _grouped(saved(fps, "fingerprints"), hot_shard).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    out = link(fingerprints(docs))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id (then fingerprint).

    Rows that share an id though their texts differ are documents of their own: each text is judged by
    its own group.  Of rows that agree in id and fingerprint one stays.  Rows without a doc_id belong
    to no group and stay.
    """
    grouped = saved(_grouped(saved(fingerprints(docs), "fingerprints")), "groups").where("doc_id is not null")
    first = grouped.groupBy("grp").agg(F.min(F.struct("doc_id", "fp")).alias("m")).select("m.doc_id", "m.fp")
    shared = grouped.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    key = lambda df, *more: df.select(F.col("doc_id").alias("_id"), *more)
    ids = first.select("doc_id").distinct()
    alone = row.join(key(ids.join(shared, "doc_id", "left_anti")), "_id", "left_semi")
    # only rows whose id is shared are told apart by their text
    several = _add_fingerprint(row.join(key(ids.join(shared, "doc_id", "left_semi")), "_id", "left_semi"))
    one = several.join(key(first, F.col("fp").alias("_fp")), ["_id", "_fp"], "left_semi").dropDuplicates(["_id", "_fp"])
    nameless = row.where("_id is null")
    return alone.select("_row.*").unionByName(one.select("_row.*")).unionByName(nameless.select("_row.*"))


def _add_fingerprint(df: DataFrame) -> DataFrame:
    """``df`` with the fingerprint of ``_text`` in ``_fp``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").cast(pa.binary()).to_pylist()
            yield b.append_column("_fp", pa.array([_signed(fingerprint(t)) for t in texts], pa.int64()))
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("_fp", LongType())]))

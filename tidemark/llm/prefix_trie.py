"""Prefix trie of conversations: ternary search trees over turn ids, one for each range of sequences.

A turn (role, text) becomes a number in a dictionary table that Spark builds; a conversation becomes
its list of numbers.  Equal lists are one row, and rows are dealt by range of the list, so that a
shard holds neighbours in the order of the trie.  A task inserts its lists into a ternary search
tree, the median first and then the medians of both halves, and sums members, leaves and savings
from the last node made back to the first (a node is made after its parent, so no recursion).
Nodes on the paths of a shard's first and last list may go on in other shards: these boundary nodes
carry a digest of their prefix, are merged by it and summed again; all others are final.

Texts never move: turns travel as SHA-256 of (role, text), and meet only by it.  The turns of one
conversation (numbers, not texts) are one row; the boundary nodes, at most two paths a shard, meet
in one task.

Rows without ``conv_id`` belong to no conversation; null ``role`` and ``text`` are empty; turns of
equal number are ordered by role and digest, repeated rows are turns of their own; an empty table
has no node.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved

SHARD_TURNS = 65_536
PIECE = 8192  # ids of conversations joined at once
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_SEQ = "array<struct<i:bigint,b:bigint>>"


def numbered_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as (number in the dictionary, bytes of text)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    bare = df.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"), F.octet_length(text).cast("bigint").alias("b"))
    dictionary = saved(bare.select("key").distinct().withColumn("i", F.monotonically_increasing_id()), "turn-ids")
    coded = bare.join(dictionary, "key")  # a frequent turn is one key here: the adaptive join splits it
    lists = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("there"), "turn", "role", "key", "i", "b"))).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["i"].alias("i"), t["b"].alias("b"))).alias("turns"))


def spliced(convs: DataFrame, every: int = 5, kinds: int = 9) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every, then its own after h; h = crc32(c) % kinds."""
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, kinds - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int")
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")
    head = F.when((F.col("h") > 0) & F.col("head").isNotNull(), F.slice("head", F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.array().cast(_SEQ))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def _joined_ids(convs: DataFrame) -> DataFrame:
    """(cls, sha): SHA-256 of each class's ids, ascending; joined by ranges of ids first, then streamed."""
    pieces = (convs.groupBy("cls", F.expr(f"conv_id - pmod(conv_id, {PIECE})").alias("from_id"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("piece")))
    dealt = pieces.repartition("cls").sortWithinPartitions("cls", "from_id")
    schema = pa.schema([("cls", pa.binary()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for batch in batches:
            cls, sha = [], []
            for c, piece in zip(batch.column("cls").to_pylist(), batch.column("piece").to_pylist()):
                if c == at:
                    h.update(b"," + piece.encode())
                    continue
                if at is not None:
                    cls.append(at)
                    sha.append(h.hexdigest())
                at, h = c, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sha, pa.string())], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()], pa.string())], schema=schema)

    return dealt.mapInArrow(run, "cls binary, sha string")


class Ternary:
    """A ternary search tree over sorted, distinct lists of numbers; node 0 is the empty prefix."""

    def __init__(self, lists: list[list[int]]):
        self.key, self.low, self.same, self.high, self.up, self.depth = [0], [-1], [-1], [-1], [-1], [0]
        self.end = [0] * len(lists)  # the node of each list
        todo = [(0, len(lists))]
        while todo:
            a, b = todo.pop()
            if a < b:
                mid = (a + b) // 2
                self.end[mid] = self._insert(lists[mid])
                todo += [(a, mid), (mid + 1, b)]

    def _new(self, key: int, up: int) -> int:
        self.key.append(key)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        for side in (self.low, self.same, self.high):
            side.append(-1)
        return len(self.key) - 1

    def _insert(self, numbers: list[int]) -> int:
        key, at = self.key, 0
        for x in numbers:
            side, frm = self.same, at
            while (node := side[frm]) >= 0 and key[node] != x:
                side, frm = (self.low if x < key[node] else self.high), node
            if node < 0:
                node = self._new(x, at)
                side[frm] = node
            at = node
        return at

    def path(self, node: int) -> list[int]:
        out = [node]
        while self.up[out[-1]] >= 0:
            out.append(self.up[out[-1]])
        return out[::-1]


_NODE = ("depth bigint, low bigint, parent_low bigint, parent binary, edge binary, n bigint, children bigint, leaves bigint, saved bigint, "
         "last_bytes bigint, cls binary")
_NODE_ARROW = pa.schema([("depth", pa.int64()), ("low", pa.int64()), ("parent_low", pa.int64()), ("parent", pa.binary()), ("edge", pa.binary()), ("n", pa.int64()),
                         ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("last_bytes", pa.int64()), ("cls", pa.binary())])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard.  A boundary node counts its inner children only, and has ``edge`` and its parent's in ``parent``."""
    lists, sizes, cls, n_of, low_of = [], [], [], [], []
    for batch in batches:
        for turns in batch.column("turns"):
            numbers = turns.values.field("i").to_pylist()
            lists.append(numbers)
            sizes.append(turns.values.field("b").to_pylist())
        cls += batch.column("cls").to_pylist()
        n_of += batch.column("n").to_pylist()
        low_of += batch.column("low").to_pylist()
    if not lists:
        return
    tree = Ternary(lists)
    total = len(tree.key)
    n, children, leaves, saving, ends, size = [0] * total, [0] * total, [0] * total, [0] * total, [None] * total, [0] * total
    low: list = [None] * total
    for k, node in enumerate(tree.end):
        ends[node], n[node], low[node] = cls[k], n_of[k], low_of[k]
        # sizes of a path's texts: upwards until a node that has one already
        at, j = node, len(sizes[k])
        while j and not size[at]:
            size[at] = sizes[k][j - 1] + 1  # 0 says "not known yet"
            at, j = tree.up[at], j - 1
    edge: dict[int, bytes] = {}
    for k in (0, len(lists) - 1):
        h = hashlib.sha256()
        for node in tree.path(tree.end[k]):
            if node:
                h.update(tree.key[node].to_bytes(8, "little", signed=True))
            edge[node] = h.copy().digest()
    up = tree.up
    for i in range(total - 1, -1, -1):
        inner = i not in edge
        if inner:
            saving[i] += (n[i] - 1) * (size[i] - 1)
            leaves[i] = leaves[i] or 1
        p = up[i]
        if p >= 0:
            if inner:  # a boundary node is added to its parent when all shards are merged
                children[p] += 1
                leaves[p] += leaves[i]
                saving[p] += saving[i]
            n[p] += n[i]
            low[p] = low[i] if low[p] is None else min(low[p], low[i])
    edges = [edge.get(i) for i in range(total)]
    parents = [None if i == 0 else edge.get(up[i]) for i in range(total)]
    parent_low = [None if i == 0 or up[i] in edge else low[up[i]] for i in range(total)]
    columns = [tree.depth, low, parent_low, parents, edges, n, children, leaves, saving, [s - 1 if s else 0 for s in size], ends]
    for k in range(0, total, 16_384):
        yield pa.RecordBatch.from_arrays([pa.array(c[k:k + 16_384], f.type) for c, f in zip(columns, _NODE_ARROW)], schema=_NODE_ARROW)


def _sum_boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged boundary nodes: children, leaves and savings from the deepest to the root."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    rows.sort(key=lambda r: -r["depth"])
    by = {r["edge"]: r for r in rows}
    for r in rows:
        if not r["children"]:
            r["leaves"] = 1
        r["saved"] += (r["n"] - 1) * r["last_bytes"]
        p = by.get(r["parent"])
        if p is not None:
            p["children"] += 1
            p["leaves"] += r["leaves"]
            p["saved"] += r["saved"]
            r["parent_low"] = p["low"]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_NODE_ARROW)


def trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of ``convs(conv_id, turns)``; ``turns`` is a list of (number i, bytes b).

    (conv_id: smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    spark = convs.sparkSession
    named = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: t["i"].cast("string")), ","), 256))
    convs = saved(convs.withColumn("cls", named), "conversations")
    turns = convs.agg(F.sum(F.size("turns"))).first()[0] or 0
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    classes = convs.groupBy("turns").agg(F.first("cls").alias("cls"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    dealt = classes.repartitionByRange(shards, "turns").sortWithinPartitions("turns")
    nodes = saved(dealt.mapInArrow(_shard, _NODE).withColumn("pid", F.spark_partition_id()), "trie-nodes")
    at_edge = nodes.where("edge is not null")
    merged = at_edge.groupBy("edge").agg(F.first("depth").alias("depth"), F.min("low").alias("low"), F.lit(None).cast("bigint").alias("parent_low"), F.first("parent").alias("parent"),
                                         F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                                         F.max("last_bytes").alias("last_bytes"), F.max("cls").alias("cls"))
    bounds = saved(merged.select(*_NODE_ARROW.names).coalesce(1).mapInArrow(_sum_boundary, _NODE), "trie-boundary")
    # an inner node below a boundary node takes its parent's name from it: joined within the shard, as the root has many children
    lows = at_edge.select("pid", "edge").join(bounds.select("edge", F.col("low").alias("new_low")), "edge").withColumnRenamed("edge", "parent")
    inner = nodes.where("edge is null")
    below = inner.where("parent is not null").join(lows, ["pid", "parent"]).withColumn("parent_low", F.col("new_low"))
    cols = ["depth", "low", "parent_low", "n", "children", "leaves", "saved", "cls"]
    every = inner.where("parent is null").select(*cols).unionByName(below.select(*cols)).unionByName(bounds.select(*cols))
    ended = every.where("cls is not null").join(_joined_ids(convs), "cls").drop("cls")
    passed = every.where("cls is null").drop("cls").withColumn("sha", F.lit(EMPTY_SHA))
    return ended.select(*passed.columns).unionByName(passed).select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def conversation_trie(df: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of the conversations of ``df(conv_id, turn, role, text)`` as they are."""
    return trie(numbered_turns(df), shards)

"""Token-id files: bit-plane shuffled, zstandard-compressed blocks with a chunk index.

File format (one file image for each row of the table, so that Spark's own committers write it and
any store that Spark reads can hold it; the column is not compressed a second time):

    magic "TMBP1\\0\\0\\0" | header length u32 | header JSON | planes

Ids are cut into blocks of ``BLOCK``.  A block is a matrix of 32-bit rows; ``unpackbits`` and a
transpose turn it into 32 bit planes, each compressed alone (planes of unused high bytes are empty).
The header is the chunk index: for each block its number of ids and the lengths of its planes, and
for each document its id and number of ids.  The column ``chunks`` repeats where each block's ids
begin in the partition and its bytes in the image, so that a reader finds a block by the table alone.

Documents are range-partitioned by (doc_id, hash of the text, a running number) and sorted, so the
files follow ascending doc_id order and an id that many rows share spreads.  A file ends at a
document's end once it holds ``FILE_IDS`` ids: memory is bounded by one file plus the longest
document.  A file carries how many ids its partition holds before it; what reading adds is one
number a partition, from totals that are broadcast (as many rows as shuffle partitions, at most
``PARTS``; joined otherwise).  The images are never shuffled.

Defined results: a null text counts as empty and still has its end id; rows without a doc_id come
first; rows that repeat a doc_id keep each its own place, ordered by a hash of the text; other
columns never reach a task; an empty table makes no file; very long texts are encoded in parts.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import documents, saved
from tidemark.llm.tokens import encoder

MAGIC = b"TMBP1\0\0\0"
BLOCK = 1 << 16
FILE_IDS = 1 << 19
PARTS = 100_000  # partitions whose totals may be broadcast, 16 bytes each
FILES = "part int, file int, before long, n_ids long, chunks array<struct<first:long,at:long>>, image binary"


def pack_block(ids: np.ndarray, press: zstandard.ZstdCompressor) -> list[bytes]:
    """32 compressed bit planes, lowest bit first; planes of a byte that is always 0 are empty."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = []
    for k in range(4):
        column = np.ascontiguousarray(octets[:, k])
        if not column.any():
            planes += [b""] * 8
            continue
        planes += [press.compress(np.packbits(column >> b & 1, bitorder="little").tobytes()) for b in range(8)]
    return planes


def unpack_block(n: int, planes: list[bytes], unpress: zstandard.ZstdDecompressor) -> np.ndarray:
    octets = np.zeros((n, 4), dtype=np.uint8)
    for i, plane in enumerate(planes):
        if not plane:
            continue
        bits = np.unpackbits(np.frombuffer(unpress.decompress(plane), dtype=np.uint8), count=n, bitorder="little")
        octets[:, i // 8] |= bits << (i % 8)
    return octets.view("<u4").ravel()


def write_image(doc_ids: list[int | None], ids: list[np.ndarray], level: int = 1) -> tuple[bytes, list[int]]:
    """(image, where each block's planes begin in it)."""
    press = zstandard.ZstdCompressor(level=level)
    every = np.concatenate(ids) if ids else np.zeros(0, dtype="<u4")
    blocks, body = [], []
    for k in range(0, len(every), BLOCK):
        part = every[k:k + BLOCK]
        planes = pack_block(part, press)
        blocks.append([len(part), [len(p) for p in planes]])
        body += planes
    index = json.dumps({"blocks": blocks, "docs": [[d, len(i)] for d, i in zip(doc_ids, ids)]}).encode()
    head = MAGIC + struct.pack("<I", len(index)) + index
    at = len(head) + np.cumsum([0] + [sum(lengths) for _, lengths in blocks])[:-1]
    return head + b"".join(body), at.tolist()


def read_image(image: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in file order."""
    if image[:8] != MAGIC:
        raise ValueError("not a token file")
    size, = struct.unpack_from("<I", image, 8)
    index, at = json.loads(image[12:12 + size]), 12 + size
    unpress, parts = zstandard.ZstdDecompressor(), []
    for n, lengths in index["blocks"]:
        planes = []
        for m in lengths:
            planes.append(image[at:at + m])
            at += m
        parts.append(unpack_block(n, planes, unpress))
    every = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
    at = 0
    for doc_id, n in index["docs"]:
        yield doc_id, every[at:at + n]
        at += n


def _writer(path: str, spaced: bool, end_id: int, file_ids: int):
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, file, before, rows, docs, held = TaskContext.get().partitionId(), 0, 0, 0, [], []
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("at", pa.int64())])), pa.binary()]

        def flush():
            image, places = write_image(docs, held)
            chunks = [{"first": before + k * BLOCK, "at": at} for k, at in enumerate(places)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, file, before, rows, chunks, image), kinds)],
                                              ["part", "file", "before", "n_ids", "chunks", "image"])

        for b in batches:
            for d, ids in zip(b.column("doc_id").to_pylist(), encoder(path, spaced).encode_all(b.column("text"))):
                docs.append(d)
                held.append(np.r_[ids, end])
                rows += len(ids) + 1
                if rows >= file_ids:
                    yield flush()
                    file, before, rows, docs, held = file + 1, before + rows, 0, [], []
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, spaced: bool = False, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the table of file images and returns it as read back."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = documents(docs).select("doc_id", "text", order[1].alias("_h"), order[2].alias("_n"))
    ordered = keyed.repartitionByRange(n, order[0], "_h", "_n").sortWithinPartitions(order[0], "_h", "text").select("doc_id", "text")
    return saved(ordered.mapInArrow(_writer(path, spaced, end_id, file_ids), FILES), "token-files", compression="none")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, image in zip(b.column("start").to_pylist(), b.column("image")):
            rows = []
            for doc_id, ids in read_image(image.as_py()):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the file images alone.

    Starts add a partition's base, a running total over one row a partition, to what its files carry.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = saved(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "starts")
    if base.count() <= PARTS:
        base = F.broadcast(base)
    return files.select("part", "before", "image").join(base, "part").select((F.col("base") + F.col("before")).alias("start"), "image").mapInArrow(
        _reader, "doc_id long, start long, n_tokens long, ids_crc32 long")

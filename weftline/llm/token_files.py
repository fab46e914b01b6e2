"""Token ids in files of range-coded blocks, written and read through Spark's own file access.

A file holds groups, one after the other, of documents in ascending doc_id order. A group is

    magic, part, documents, blocks, bits     "WRC2" and four unsigned 32-bit integers
    documents x (doc_id, ids, flags)         signed 64-bit, unsigned 32-bit, 1: begun in the group before, 2: null doc_id
    blocks x (ids, bytes, crc of the coded bytes, crc of the ids as unsigned 32-bit integers)
    crc of all the above
    the coded blocks
    "|END"

with all integers little-endian. Every block is coded from the same first state, so that each can be read
and checked alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.cluster import cut, in_bounds, joined_small
from weftline.llm.range_coder import decode, encode
from weftline.llm.token_ids import encoder

MAGIC, END = b"WRC2", "|END"
#: Ids of a block, and blocks of a group: what a task holds at once.
BLOCK, GROUP = 4096, 2048
#: Bytes of texts of a file, about: Spark reads a file back as one row, of 2 GB at most.
FILE_BYTES = 256 << 20
#: Bytes of texts whose words are looked up together, and of the words that a worker remembers, in each of two halves:
#: a word is looked up once for all its places in so many bytes, so that more of them take less time.
AT_ONCE, CACHE_BYTES = 16 << 20, 48 << 20
HEAD = struct.Struct("<4s4I")
DOCS = np.dtype([("id", "<i8"), ("n", "<u4"), ("flags", "u1")])
BLOCKS = np.dtype([("n", "<u4"), ("bytes", "<u4"), ("coded", "<u4"), ("ids", "<u4")])


def _group(part: int, docs: list[tuple[int, int, int]], ids: np.ndarray, bits: int) -> bytes:
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    coded = encode(blocks, bits)
    index = np.array([(len(b), len(c), zlib.crc32(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(blocks, coded, strict=True)], BLOCKS)
    head = HEAD.pack(MAGIC, part, len(docs), len(blocks), bits) + np.array(docs, DOCS).tobytes() + index.tobytes()
    return b"".join([head, zlib.crc32(head).to_bytes(4, "little"), *coded])


def groups(content: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, documents, ids) of each group of a file; ValueError if a checksum is wrong."""
    at = 0
    while at < len(content):
        magic, part, n_docs, n_blocks, bits = HEAD.unpack_from(content, at)
        end = at + HEAD.size + n_docs * DOCS.itemsize + n_blocks * BLOCKS.itemsize
        if magic != MAGIC or zlib.crc32(content[at:end]) != int.from_bytes(content[end : end + 4], "little"):
            raise ValueError(f"a group's head at byte {at} is damaged")
        docs = np.frombuffer(content, DOCS, n_docs, at + HEAD.size)
        index = np.frombuffer(content, BLOCKS, n_blocks, end - n_blocks * BLOCKS.itemsize)
        at, coded = end + 4, []
        for b in index:
            coded.append(content[at : at + int(b["bytes"])])
            if zlib.crc32(coded[-1]) != b["coded"]:
                raise ValueError(f"the block at byte {at} is damaged")
            at += int(b["bytes"])
        blocks = decode(coded, index["n"].tolist(), bits)
        if any(zlib.crc32(x.astype("<u4").tobytes()) != b["ids"] for x, b in zip(blocks, index, strict=True)):
            raise ValueError("a block's ids do not match their checksum")
        yield part, docs, np.concatenate(blocks)
        at += len(END)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to at most AT_ONCE bytes; one that is larger stays by itself."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > AT_ONCE:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def written(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each whole text's ids and the end id to files under path, in ascending doc_id order.

    A null text is empty; a null doc_id comes first; equal doc_ids follow each other by their texts' hashes;
    an empty table gives no group; other columns are ignored. One exchange by ranges of doc_id sorts the
    texts; a task encodes its range as it streams by and holds one group of ids at a time. There are as many
    files as keep each to about FILE_BYTES of texts.
    """
    spark = docs.sparkSession
    in_bounds(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("string").alias("text"))
    size = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path, CACHE_BYTES, AT_ONCE)
        part, kind = TaskContext.get().partitionId(), f"<u{ids_of.width}"
        bits = 16 * (ids_of.width // 2)
        end = end_id.to_bytes(ids_of.width, "little")
        docs: list[tuple[int, int, int]] = []
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_group(part, docs, np.concatenate(held), bits)], pa.binary())], ["value"])

        for batch in _together(batches):
            for doc, own in zip(batch.column(0).to_pylist(), ids_of.many(batch.column(1)), strict=True):
                ids = np.frombuffer(own + end, kind)
                null = 0 if doc is not None else 2
                begun = 0
                while len(ids):
                    some = ids[: BLOCK * GROUP - n]
                    docs.append((doc or 0, len(some), begun | null))
                    held.append(some)
                    n, ids, begun = n + len(some), ids[len(some) :], 1
                    if n == BLOCK * GROUP:
                        yield out()
                        docs, held, n = [], [], 0
        if docs:
            yield out()

    placed = given.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    files = placed.select("doc_id", "text").mapInArrow(coded, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", END).text(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids of each document in the files."""

    in_bounds(spark)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows: list[tuple] = []
                before = 0
                for part, docs, ids in groups(content):
                    at, raw = 0, ids.astype("<u4").tobytes()
                    for doc, n, flags in zip(docs["id"].tolist(), docs["n"].tolist(), docs["flags"].tolist(), strict=True):
                        own = raw[4 * at : 4 * (at + n)]
                        at += n
                        if flags & 1:
                            _, start, m, crc, old, _ = rows.pop()
                            rows.append((None if flags & 2 else doc, start, m + n, zlib.crc32(own, crc), old + own if with_ids else None, part))
                        else:
                            rows.append((None if flags & 2 else doc, before, n, zlib.crc32(own), own if with_ids else None, part))
                        before += n
                    if len(rows) > 1:
                        yield told(rows[:-1])  # the last may go on in the next group
                        rows = rows[-1:]
                if rows:
                    yield told(rows)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids", "part"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    contents = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    docs = cut(contents.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary, part long"))
    sizes = docs.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))  # a row for each file
    sizes = sizes.withColumn("before", F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).drop("in_part")
    found = joined_small(docs, cut(sizes), ["part"], "inner").withColumn("start", F.col("start") + F.col("before"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))

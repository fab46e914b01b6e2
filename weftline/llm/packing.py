"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.cluster import cut, in_bounds, lean, worker_turns_to
from weftline.llm.token_ids import encoder, width_of

#: Each queue is cut into blocks by a hash of the document, so that a hot source is many tasks' work: about so many
#: ids a block, or more as the ids grow, so that there are about so many blocks of all queues at most, and one a queue.
BLOCK_IDS, BLOCKS = 1 << 18, 65_536
#: Windows planned at once times queues, and windows at most.
PLANNED, AHEAD = 1 << 16, 256
#: Bytes of ids that are dealt at once.
AT_ONCE = 1 << 20


class Schedule:
    """How many ids of each queue the first k windows hold.

    Each window grants every queue its share of `window` ids. What a queue is due but doesn't get, being
    cut to whole ids, is its deficit, carried to the next window; the ids left in a window go to the queues
    whose next id falls due first. All follows from k alone, so that tasks agree without passing state on.
    Without weights the shares are the queues' sizes and all queues end together. With weights a queue that
    runs dry ends a phase, and the others divide its share.
    """

    def __init__(self, sizes: list[int], window: int, weights: list[int] | None = None):
        self.sizes, self.window, self.total = sizes, window, sum(sizes)
        self.windows = -(-self.total // window)
        self.phases: list[tuple[int, int, list[int], list[int]]] = []  # first id, ids, and by queue ids before and within
        left, before, first = list(sizes), [0] * len(sizes), 0
        while any(left):
            live = [q for q, n in enumerate(left) if n]
            weighed = [q for q in live if weights and weights[q] > 0]
            part = [0] * len(sizes)
            if weighed:
                dry = min(weighed, key=lambda q: (left[q] * 10**12 // weights[q], q))
                for q in weighed:
                    part[q] = min(left[q], left[dry] * weights[q] // weights[dry])
            else:
                part = list(left)
            self.phases.append((first, sum(part), before, part))
            before = [b + p for b, p in zip(before, part, strict=True)]
            left = [n - p for n, p in zip(left, part, strict=True)]
            first += sum(part)
        self.exact = self.total.bit_length() * 2 < 63  # products fit 64 bits

    def before(self, k0: int, k1: int) -> np.ndarray:
        """Rows k0 to k1: by queue, the ids in windows before k. A row follows from its k alone."""
        out = np.empty((k1 - k0 + 1, len(self.sizes)), np.int64)
        at = np.minimum(np.arange(k0, k1 + 1, dtype=np.int64 if self.exact else object) * self.window, self.total)
        out[at >= self.total] = self.sizes
        for first, ids, done, part in self.phases:
            rows = np.flatnonzero((at >= first) & (at < first + ids))
            if not len(rows):
                continue
            kind = np.int64 if self.exact else object
            n, due = np.array(part, kind), (at[rows] - first).astype(kind)[:, None]
            counts = due * n // ids
            short = (due[:, 0] - counts.sum(1)).astype(np.int64)
            per = np.maximum(n, 1)
            wait = (((counts + 1) * ids - due * n) / per).astype(float)
            wait[:, np.array(part) == 0] = np.inf
            step = (ids / per).astype(float)
            # the next three ids of each queue, first due first; a fourth before the last of these is rare
            next_due = (wait[:, :, None] + step[:, None] * np.arange(3)).reshape(len(rows), -1)
            bound = np.sort(next_due, axis=1)[np.arange(len(rows)), np.maximum(short - 1, 0)]
            taken = (next_due <= bound[:, None]) & (short > 0)[:, None]
            given = taken.reshape(len(rows), -1, 3).sum(2)
            latest = np.where(taken, next_due, -np.inf).max(1)
            for r in np.flatnonzero(((wait + 3 * step).min(1) < latest) | (taken.sum(1) != short)):
                heap = [(w, q) for q, w in enumerate(wait[r]) if w < np.inf]
                heapify(heap)
                given[r] = 0
                for _ in range(short[r]):
                    w, q = heap[0]
                    given[r, q] += 1
                    heapreplace(heap, (w + step[q], q))
            out[rows] = (counts + given + np.array(done, kind)).astype(np.int64)
        return out

    def near(self, queue: int, at: int) -> int:
        """A window close to the one that holds id `at` of the queue."""
        first, ids, done, part = next(p for p in self.phases if p[2][queue] <= at < p[2][queue] + p[3][queue])
        return (first + (at - done[queue]) * ids // part[queue]) // self.window


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, ids): each whole text's ids and the end id, as bytes of the encoder's width."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path)
        end = end_id.to_bytes(ids_of.width, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [x + end for x in ids_of.many(part.column(2))]
                n = pa.array([len(x) // ids_of.width for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array(ids, pa.binary())], ["doc_id", "source", "n_tokens", "ids"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(lean(encode), "doc_id long, source string, n_tokens long, ids binary")


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    window: int = 4096,
    weights: dict[str | None, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents, dealt to windows (sequences) of `window` ids in the sources' target proportions.

    Returns doc_id, source, start, length, ids (bytes, unsigned 32-bit little-endian), ids_crc32, doc_tokens,
    sequence_id, offset. All sequences are full but the last. weights are the sources' target shares; without
    them each source's share of all ids; with_ids=False leaves the ids null. A source without a weight comes after all that have one.

    Every source that is due an id of each window, and every one with a weight, has a queue of its own: `window`
    and the weights bound their number. Sources that are due less share one queue, in which documents stand in
    order of a hash, so that each has its share of any long stretch; no window could hold its share more closely.

    A null text is empty and is the end id alone; a null source is a source of its own; a null doc_id stays
    null; equal rows are packed once each; an empty table gives no rows; other columns are ignored.

    Plan: texts are encoded once and the ids written to the shared folder; sizes of queues and of their blocks
    (2 * BLOCKS + window + weights at most) come to the driver and go back as a broadcast table; one exchange by
    block brings each block's ids in order, where their windows follow from the running count.
    """
    spark = docs.sparkSession
    in_bounds(spark)
    tokens = cut(tokenised(docs, tokenizer_path, end_id, id_col, text_col, source_col))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    by_source = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    given = F.lit(False)
    for name in weights or ():
        given = given | F.col("source").eqNullSafe(F.lit(name))
    own = by_source.where((F.col("n") * window >= total) | given)  # window and the weights bound their number
    found = sorted(((r["source"], r["n"]) for r in own.collect()), key=lambda s: (s[0] is not None, s[0] or ""))
    names, sizes = [x for x, _ in found], [n for _, n in found]
    rest = total - sum(sizes)
    sizes += [rest] if rest or not sizes else []
    shares = [int(weights.get(n, 0)) for n in names] + [0] * (len(sizes) - len(names)) if weights else None
    each = max(BLOCK_IDS, -(-total // BLOCKS))
    queues = spark.createDataFrame([(x is None, x or "", i, -(-n // each)) for i, (x, n) in enumerate(found)], "no_source boolean, own_source string, own_queue int, own_blocks int")
    match = (F.col("source").isNull() == F.col("no_source")) & (F.coalesce("source", F.lit("")) == F.col("own_source"))
    placed = tokens.join(F.broadcast(queues), match, "left")
    queue = F.coalesce("own_queue", F.lit(len(names))).cast("int")
    block = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.coalesce("own_blocks", F.lit(max(1, -(-rest // each))))).cast("int")
    placed = placed.select("doc_id", "source", "n_tokens", "ids", queue.alias("queue"), block.alias("block"))
    counts = sorted(tuple(r) for r in placed.groupBy("queue", "block").agg(F.sum("n_tokens").alias("n")).collect())
    bases, before = [], [0] * len(sizes)
    for q, b, n in counts:
        bases.append((q, b, before[q]))
        before[q] += n
    placed = placed.join(F.broadcast(spark.createDataFrame(bases, "queue int, block int, base long")), ["queue", "block"])
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(bases)))
    width = width_of(tokenizer_path)
    names_out = ["doc_id", "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turns_to("deal")
        schedule = Schedule(sizes, window, shares)
        step = max(1, min(AHEAD, PLANNED // len(sizes)))
        ahead = lru_cache(8)(lambda chunk: schedule.before(chunk * step, (chunk + 1) * step))
        here, at = None, 0

        def windows(q: int, at: int, end: int) -> tuple[int, np.ndarray, np.ndarray]:
            """The first window, ids of the queue before each, and where the queue's ids start in each, for ids at..end."""
            chunk = schedule.near(q, at) // step
            while chunk and ahead(chunk)[0, q] > at:
                chunk -= 1
            while ahead(chunk)[-1, q] <= at:
                chunk += 1
            first, have, begin = chunk * step, [], []
            while True:
                table = ahead(chunk)
                have.append(table[:-1, q])
                begin.append(np.diff(table[:, :q].sum(1)))
                if table[-1, q] >= end:
                    return first, np.concatenate(have), np.concatenate(begin)
                chunk += 1

        def pieces(part: pa.RecordBatch, at: int) -> tuple[pa.RecordBatch, int]:
            """The pieces of some rows of one block, the first of which stands at id `at` of its queue, and where the next row stands."""
            n, q = part.column(2).to_numpy(), part.column(4)[0].as_py()
            docs = at + np.concatenate([[0], np.cumsum(n)])
            end = int(docs[-1])
            first, have, begin = windows(q, at, end)
            s = np.union1d(docs[:-1], have[(have > at) & (have < end)])
            e = np.append(s[1:], end)
            doc, k = np.searchsorted(docs, s, "right") - 1, np.searchsorted(have, s, "right") - 1
            ids = np.frombuffer(b"".join(part.column(3).to_pylist()), f"<u{width}").astype("<u4").view(np.uint8)
            cuts = [memoryview(ids[x:y]) for x, y in zip(((s - at) * 4).tolist(), ((e - at) * 4).tolist(), strict=True)]
            told = pa.array([bytes(x) for x in cuts], pa.binary()) if with_ids else pa.nulls(len(s), pa.binary())
            columns = [s - docs[doc], e - s, told, [zlib.crc32(x) for x in cuts], n[doc], first + k, begin[k] + s - have[k]]
            rows = pa.array(doc)
            made = [part.column(0).take(rows), part.column(1).take(rows), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds[2:], strict=True))]
            return pa.RecordBatch.from_arrays(made, names_out), end

        for batch in batches:
            n, q, b = (batch.column(i).to_numpy() for i in (2, 4, 5))
            edges = set((np.flatnonzero((q[1:] != q[:-1]) | (b[1:] != b[:-1])) + 1).tolist())
            total, i = np.cumsum(n * width), 0
            edges = sorted({0, len(n)} | edges) if len(n) else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if here != (q[low], b[low]):
                    here, at = (q[low], b[low]), batch.column(6)[low].as_py()
                i = low
                while i < high:
                    upto = int(np.searchsorted(total, (total[i - 1] if i else 0) + AT_ONCE, "right"))
                    upto = min(high, max(i + 1, upto))
                    made, at = pieces(batch.slice(i, upto - i), at)
                    yield made
                    i = upto

    placed = placed.select("doc_id", "source", "n_tokens", "ids", "queue", "block", "base").repartition(parts, "queue", "block")
    placed = placed.sortWithinPartitions("queue", "block", "doc_id", "n_tokens", F.crc32("ids"))
    return placed.mapInArrow(lean(deal), "doc_id long, source string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

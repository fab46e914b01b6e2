"""What the operators share: the folder every executor sees, blocked buckets, forests and components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import checkpoint_folder, cut

#: A bucket with more rows than this is compared in blocks by several tasks.
BLOCK_ROWS = 2048
#: This many keys of large buckets at most are broadcast; beyond it they are joined.
BROADCAST_KEYS = 100_000
#: Linked pairs handled at once within a task.
PAIRS_AT_ONCE = 1 << 20
#: Links of which a task makes a forest at once.
LINKS_AT_ONCE = 1 << 20
#: Of texts or ids that go to Python at once: rows are of any length, so bytes are what bounds a task's memory.
BATCH_BYTES = 8 << 20


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def in_bounds(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from now on, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, None)
    if given is None or not str(given).rstrip("b").isdigit() or int(str(given).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: What modules keep in a worker from task to task, as functions that let go of it.
FORGET: list[Callable[[], object]] = []
_work = ""


def worker_turns_to(work: str) -> None:
    """Let go of what other work has left in this Python worker, which Spark hands from operator to operator."""
    global _work
    if work == _work:
        return
    _work = work
    for forget in FORGET:
        forget()
    gc.collect()
    give_back()


def give_back() -> None:
    """Return to the machine what this Python worker holds but no longer uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its worker gives back memory: idle workers stay beside those at work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def row_of(df: DataFrame, names: list[str] | None = None) -> Column:
    """All columns, or those named, in one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined_small(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """df joined to keys, by broadcast if keys are proven few."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def blocked(postings: DataFrame, key: str, member: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Postings (key, member, ...) with columns own, lo and hi: a row's block, and the pair of blocks of its bucket that it takes part in.

    A bucket of up to `rows` rows is one block. A larger one is cut into blocks by a hash of the member, and
    each pair of blocks is a task's work of its own, so that no task gathers the bucket and no pair is lost.
    """
    sizes = postings.groupBy(key).agg(F.count(F.lit(1)).alias("bucket_rows"))
    large = cut(sizes.where(F.col("bucket_rows") > rows).select(key, F.ceil(F.col("bucket_rows") / rows).cast("int").alias("blocks")))
    if large.isEmpty():
        return postings.withColumns({"own": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    one = joined_small(postings, large.select(key), [key], "left_anti").withColumns({"own": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    many = joined_small(postings, large, [key], "inner").withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")
    return one.unionByName(many)


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the groups' bounds, from batches in which the rows of a key are adjacent."""
    rest: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for name in key:
            values = table.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        starts = bounds(table)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last).combine_chunks(), starts
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


class Forest:
    """Components of n items, by the smallest item of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        below = np.flatnonzero(self.root != np.arange(len(self.root)))
        return below, self.root[below]


def forests(links: DataFrame) -> DataFrame:
    """Links (a, b) that join what the given ones join: of LINKS_AT_ONCE at a time, each node's to the smallest that it reaches over these."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            trees = Forest(len(nodes))
            trees.link(at[: len(a)], at[len(a) :])
            below, root = trees.edges()
            return pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root])], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= LINKS_AT_ONCE:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return links.select("a", "b").mapInArrow(lean(shrink), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that each can reach.

    In each pass a link to a node goes on to the smallest one that this node has a link to; then tasks make forests of
    what they hold, first where it lies and then by the larger ends, so that none gathers a hub's links. The links are written
    to the shared folder after each pass. They end in stars; the number of passes grows with the logarithm of the longest path.
    """
    links = cut(forests(forests(edges.where("a <> b")).repartition("a")))
    while not _stars(links):
        on = links.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        links = cut(forests(forests(links.join(on, "b", "left").select("a", F.coalesce("m", "b").alias("b"))).repartition("a")))
    ends = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link, and that to a node without one."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    nodes = links.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return nodes.where((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("least") == 0)).isEmpty()

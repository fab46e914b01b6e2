"""Near-duplicates: SimHash by multi-index hashing, and shingle sets by their exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.cluster import PAIRS_AT_ONCE, Forest, blocked, components, cut, in_bounds, lean, row_of, runs, worker_turns_to

BITS = 64
#: Segments of a fingerprint. Two that differ in up to three bits differ in at most one bit of one segment.
SEGMENTS = 2
RADIUS = 3
#: Least minima of permuted shingle hashes, in bands: sets that agree in all of one band's minima are compared further.
#: Two sets at Jaccard 0.8 agree in none of the bands once in 37,000 times ((1 - 0.8**4) ** 20), closer ones more rarely.
BANDS, BAND_ROWS = 20, 4
#: Bits, one for each of 64 minima, in which sets compared further may differ; at Jaccard 0.8 about 6 of 64 do.
SKETCH_RADIUS = 19
#: Rows of a block whose texts are compared in full; two blocks are in a task's memory at once.
TEXT_ROWS = 512
#: Groups up to this size are compared all at once, by shifting the column against itself.
SMALL = 32


def shingle_hashes(text: bytes | None, words: int, hashed) -> np.ndarray:
    """Hashes of the runs of `words` words, in order; a shorter text is one shingle, no words give none."""
    found = (text or b"").lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        shingles: Iterator[bytes] = iter([b" ".join(found)])
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.fromiter(map(hashed, shingles), np.uint64)


def fingerprint(text: bytes | None, words: int, hashed) -> int:
    """Bit i is 1 if it is in over half the shingles' hashes; no words: 0."""
    hashes = shingle_hashes(text, words, hashed)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str, keep: list[str], words: int = 3) -> DataFrame:
    """Columns `keep` and fp, the fingerprint as a signed long. Each text is read whole; null is empty."""
    in_bounds(docs.sparkSession)
    given = docs.select(*keep, F.col(text_col).cast("binary").alias("simhash_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        worker_turns_to("simhash")
        one = partial(xxhash.xxh64_intdigest, seed=42)
        for batch in batches:
            fps = np.array([fingerprint(t, words, one) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps)], [*keep, "fp"])

    return given.mapInArrow(lean(hashed), given.drop("simhash_text").withColumn("fp", F.lit(0).cast("long")).schema)


def linked(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints fp at RADIUS or fewer bits.

    Each fingerprint is posted, for each segment, under its value and under the values with one of its set
    bits cleared; of two values at one bit's distance, one is so posted under the other. Fingerprints that
    meet are held against each other in full. A bucket gives the links of a forest, not all its pairs.
    """
    width = BITS // SEGMENTS
    posted = []
    for k in range(SEGMENTS):
        value = F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1))
        ball = F.transform(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.getbit(F.col("value"), b) == 1), lambda b: F.col("value") - F.call_function("shiftleft", F.lit(1).cast("long"), b))
        keys = fps.select("fp", value.alias("value")).select("fp", F.explode(F.concat(F.array("value"), ball)).alias("value"))
        posted.append(keys.select((F.col("value") + F.lit(k << width)).alias("key"), "fp"))
    postings = posted[0]
    for more in posted[1:]:
        postings = postings.unionByName(more)
    return met_within(postings, RADIUS)


def met_within(postings: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join the fps of postings (key, fp) that share a key and differ in at most radius bits."""
    met = blocked(postings, "key", "fp")
    met = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").select("key", "lo", "hi", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["key", "lo", "hi"]):
            fp = table.column("fp").to_numpy().view(np.uint64)
            sizes = np.diff(starts)
            left = np.repeat(starts[1:], sizes) - np.arange(len(fp)) - 1  # rows of the group after this one
            left[np.repeat(sizes > SMALL, sizes)] = 0
            pairs = []
            for d in range(1, SMALL):
                a = np.flatnonzero(left >= d)
                if not len(a):
                    break
                a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= radius]
                pairs.append((a, a + d))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, int),) * 2
            yield from forest(fp, [(a, b)])
            for g in np.flatnonzero(sizes > SMALL):
                yield from forest(fp[starts[g] : starts[g + 1]], None)

    def forest(fp: np.ndarray, pairs) -> Iterator[pa.RecordBatch]:
        values, at = np.unique(fp, return_inverse=True)
        trees = Forest(len(values))
        if pairs is None:
            step = max(1, PAIRS_AT_ONCE // len(values))
            for i in range(0, len(values), step):
                a, b = np.nonzero(np.bitwise_count(values[i : i + step, None] ^ values[None, i:]) <= radius)
                trees.link(a + i, b + i)
        else:
            for a, b in pairs:
                trees.link(at[a], at[b])
        below, root = trees.edges()
        if len(below):
            yield pa.RecordBatch.from_arrays([pa.array(values[below].view(np.int64)), pa.array(values[root].view(np.int64))], ["a", "b"])

    return met.mapInArrow(lean(link), "a long, b long")


def grouped(fps: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(fp, component): the smallest fingerprint, as a signed long, that each distinct one of fps can reach over links, or linked()."""
    distinct = fps.select("fp").distinct()
    groups = components(linked(distinct) if links is None else links).withColumnRenamed("node", "fp")
    return distinct.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Documents without words have fingerprint zero and link like any other. Null texts are empty; a null
    doc_id stays null and is the component's id only if all its doc_ids are null; equal rows stay rows each;
    an empty table gives no rows; other columns are ignored.

    Equal fingerprints are one before anything is compared, so exact copies cost nothing further, and all
    that is gathered of a group is the links of a forest.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fps = cut(fingerprints(given, "text", ["doc_id"], words))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = grouped(fps).join(least, "fp")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(smallest, "component").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def sketched(texts: DataFrame, keep: list[str], words: int) -> DataFrame:
    """Columns `keep`, set (a hash of the shingle set), fp (a bit of each of 64 minima) and keys, one for each band."""
    in_bounds(texts.sparkSession)
    given = texts.select(*keep, F.col("text").cast("binary").alias("sketched_text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        worker_turns_to("sketches")
        one = partial(xxhash.xxh64_intdigest, seed=42)
        rng = np.random.default_rng(42)
        n = BANDS * BAND_ROWS
        factors, terms, mix = (rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for _ in range(3))
        for batch in batches:
            sets, fps, keys, ends = [], [], [], [0]
            for text in batch.column(len(keep)).to_pylist():
                hashes = np.unique(shingle_hashes(text, words, one))
                sets.append(one(hashes.tobytes()))
                least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(hashes), 1 << 12):
                    np.minimum(least, (factors[:, None] * hashes[at : at + (1 << 12)] + terms[:, None]).min(1), out=least)
                fps.append(int.from_bytes(np.packbits((least[:BITS] * mix[0] >> np.uint64(63)).astype(bool)).tobytes(), "big"))
                if len(hashes):
                    keys.append((least * mix).reshape(BANDS, BAND_ROWS).sum(1, dtype=np.uint64))
                ends.append(len(keys) * BANDS)
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            made = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sets, fps)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, "set", "fp", "keys"])

    none = F.lit(0).cast("long")
    return given.mapInArrow(lean(sketch), given.drop("sketched_text").withColumns({"set": none, "fp": none, "keys": F.array(none)}).schema)


def near(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs that join those of the sets (each distinct values, some at least) that a chain of Jaccard similarities of `least` joins."""
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(len(ids), bool)
    unseen = np.ones(len(sets), bool)
    for first in range(len(sets)):
        waiting = [first] if unseen[first] else []
        unseen[first] = False
        while waiting and unseen.any():
            i = waiting.pop()
            own = ids[starts[i] : starts[i] + sizes[i]]
            held[own] = True
            shared = np.add.reduceat(held[ids], starts, dtype=np.int64)
            held[own] = False
            found = np.flatnonzero(unseen & (shared / (sizes + sizes[i] - shared) >= least))
            unseen[found] = False
            waiting += found.tolist()
            yield from ((i, int(j)) for j in found)


def similar(docs: DataFrame, rows: DataFrame, own_hash: Column, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """Links (a, b) of the sets of rows (sketched, with __id and __hash, of docs) at a Jaccard similarity of `least` or more.

    Sets that agree in a band and in most bits of fp are candidates. What chains of candidates join is then
    compared by whole shingle sets, each text going there once, or once for each pair of blocks if there are many.
    """
    distinct = cut(rows.dropDuplicates(["set"]).select("set", "fp", "keys"))
    postings = distinct.select("fp", F.explode("keys").alias("key")).select("key", "fp").distinct()
    groups = components(met_within(postings, SKETCH_RADIUS)).withColumnRenamed("node", "fp")
    alike = distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", F.lit(None).cast("long").alias("component"))
    groups = groups.unionByName(alike).groupBy("fp").agg(F.coalesce(F.max("component"), "fp").alias("component"))
    suspects = cut(distinct.select("set", "fp").join(groups, "fp").select("component", "set"))
    tasks = blocked(suspects, "component", "set", TEXT_ROWS).select("component", "lo", "hi", "set")
    one = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")).alias("one")
    first = rows.join(suspects.select("set"), "set").groupBy("set").agg(one).select("set", "one.__id", "one.__hash")
    tasks = cut(tasks.join(first, "set"))
    texts = docs.select(F.col(id_col).cast("long").alias("__own_id"), own_hash.alias("__own_hash"), F.col(text_col).cast("binary").alias("text"))
    told = texts.join(tasks, (F.col("__own_hash") == F.col("__hash")) & F.col("__own_id").eqNullSafe(F.col("__id")))
    told = told.select("component", "lo", "hi", "set", "text").repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "set")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        worker_turns_to("similar")
        hashed = partial(xxhash.xxh64_intdigest, seed=42)
        for table, starts in runs(batches, ["component", "lo", "hi"]):
            names, texts = table.column("set").to_numpy(), table.column("text")
            a, b = [], []
            for i, j in zip(starts, [*starts[1:], len(names)], strict=False):
                at = i + np.unique(names[i:j], return_index=True)[1]
                found = {names[x]: np.unique(shingle_hashes(texts[int(x)].as_py(), words, hashed)) for x in at}
                found = {k: v for k, v in found.items() if len(v)}
                if len(found) > 1:
                    named = list(found)
                    for x, y in near(list(found.values()), least):
                        a.append(named[x])
                        b.append(named[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return told.mapInArrow(lean(link), "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, least: float | None = None) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last), then the smallest text hash.

    Links are fingerprints at RADIUS or fewer bits or, with `least`, shingle sets at that Jaccard similarity or more.
    """
    own_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    given = docs.select(F.col(id_col).cast("long").alias("__id"), own_hash.alias("__hash"), F.col(text_col).alias("text"))
    if least is None:
        fps = cut(fingerprints(given, "text", ["__id", "__hash"], words))
        groups = grouped(fps)
    else:
        rows = cut(sketched(given, ["__id", "__hash"], words))
        fps = rows.select("__id", "__hash", F.col("set").alias("fp"))
        groups = grouped(fps, similar(docs, rows, own_hash, id_col, text_col, words, least))
    rank = F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")
    named = fps.groupBy("fp").agg(F.min(rank).alias("least")).join(groups, "fp")
    first = named.groupBy("component").agg(F.min("least").alias("least"))
    first = cut(named.join(first.withColumnRenamed("least", "first"), "component").select("fp", "first"))
    kept = fps.join(first, "fp").where(rank.eqNullSafe(F.col("first")))
    kept = cut(kept.groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("__rows")))
    told = docs.select(row_of(docs).alias("row"), F.col(id_col).cast("long").alias("__own_id"), own_hash.alias("__own_hash"))
    told = told.join(kept, (F.col("__own_hash") == F.col("__hash")) & F.col("__own_id").eqNullSafe(F.col("__id")))
    once = told.where("__rows = 1").select("row.*")
    if kept.where("__rows > 1").isEmpty():
        return once
    many = told.where("__rows > 1").dropDuplicates(["__own_id", "__own_hash"]).select("row.*")
    return once.unionByName(many)


def hex_of(fp) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))

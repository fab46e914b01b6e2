"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.cluster import PAIRS_AT_ONCE, Forest, blocked, components, cut, in_bounds, runs

#: Reference points: twice the root of the number of vectors, in these bounds, so that the lists grow with its root.
#: They are rows of the table, those with the smallest hashes, the first FAR of them chosen far apart.
PIVOTS, FAR = (256, 65_536), 1024
#: A vector is described by its NEAREST pivots in order; two that share SHARED of them are verified, if they meet in a list.
NEAREST, SHARED = 16, 4
#: A vector stands in the lists of so many of its first pivots, the fewest by which RECALL of TRIED random partners at the
#: least similarity are found. What is less similar than asked is never told.
DEPTHS, RECALL, TRIED = (3, NEAREST), 0.97, 1024
#: Vectors described at once.
AT_ONCE = 1 << 22
#: What 16-bit components lose is bounded; pairs nearer to the limit than that are verified by the vectors themselves.
WHOLE = 32_767


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # first, for squares to neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def chosen(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the unit vectors: up to FAR, each as far as can be from those before it, then the others as they come."""
    if not len(sample):
        return sample
    pool = sample[: 2 * FAR]
    rows, near = [0], pool @ pool[0]
    while len(rows) < min(n, len(pool), FAR):
        rows.append(int(near.argmin()))
        near = np.maximum(near, pool @ pool[rows[-1]])
    return sample[[*rows, *sorted(set(range(len(sample))) - set(rows))]][:n]


def described(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each row's nearest pivots, the nearest first."""
    take = min(NEAREST, len(pivots))
    like = -(unit @ pivots.T)
    near = np.argpartition(like, take - 1, axis=1)[:, :take]
    near.sort(axis=1)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(like, near, 1), axis=1, kind="stable"), 1).astype(np.uint16)


def shared_of(near: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many pivots the descriptions of two rows share."""
    return (near[:, :, None] == other[:, None, :]).any(2).sum(1)


def depth(pivots: np.ndarray, least: float) -> int:
    """The fewest first pivots to post vectors under."""
    rng = np.random.default_rng(3)
    take = min(NEAREST, len(pivots))
    n = pivots.shape[1]
    if n < 2:
        return take
    x, u = _unit(rng.normal(size=(TRIED, n))), rng.normal(size=(TRIED, n))
    u = _unit(u - (u * x).sum(1, keepdims=True) * x)
    a, b = described(x, pivots), described(least * x + np.sqrt(max(0.0, 1 - least * least)) * u, pivots)
    enough = shared_of(a, b) >= needed(take)
    for k in range(min(DEPTHS[0], take), take):
        if (enough & (shared_of(a[:, :k], b[:, :k]) > 0)).mean() >= RECALL:
            return k
    return take


def needed(take: int) -> int:
    """The pivots to share of descriptions by `take` pivots."""
    return max(1, SHARED * take // NEAREST)


def labelled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are pairs with cosine >= `least` in double precision that the index finds; none below it.
    n_links counts the other vectors linked directly, component_id is the smallest vec_id reachable, itself
    included, and kept says that vec_id is component_id. Null, zero and non-finite vectors link with nothing,
    and vectors of other lengths with none of theirs. A null vec_id stays null and counts as a vector, kept
    false; equal rows are vectors each; an empty table gives no rows; other columns are ignored.

    Equal vectors (by 128 bits of hash) are one class before the search. A class is posted in the inverted lists
    of its first few pivots, with its description and its components in 16 bits. Within a list, classes that
    share enough pivots are verified; a pair counts in the list of the smallest pivot under which both are
    posted and nowhere else. Lists beyond a block are compared in pairs of blocks. What leaves a list are
    counts and the links of a forest, and the few pairs that 16 bits can't tell, for which the vectors themselves are fetched.
    """
    spark = vectors.sparkSession
    in_bounds(spark)
    kind = next(f.dataType for f in vectors.schema.fields if f.name == vec_col)
    single = isinstance(getattr(kind, "elementType", None), T.FloatType)
    unit_type = "float" if single else "double"
    code = "<f4" if single else "<f8"
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{unit_type}>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    given = given.withColumns({"sound": sound, "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    classes = given.where("sound").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))  # written once, so the numbers stay
    n_pivots = min(PIVOTS[1], max(PIVOTS[0], 1 << (2 * isqrt(classes.count())).bit_length()))
    sample = classes.orderBy("h1", "h2").limit(max(2 * FAR, n_pivots)).select("v").collect()
    length = max((len(r["v"]) for r in sample), default=0)
    alone = given.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not length:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    same = np.array([r["v"] for r in sample if len(r["v"]) == length], float).reshape(-1, length)
    sent = spark.sparkContext.broadcast(chosen(_unit(same), n_pivots).astype(np.float32))  # PIVOTS[1] rows at most

    def points(n: int) -> tuple[np.ndarray, int]:
        if n == length:
            own = sent.value
        else:
            own = _unit(np.random.default_rng(n).normal(size=(PIVOTS[0], n))).astype(np.float32)
        return own, depth(own, least)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for n in np.unique(sizes).tolist():
                if n not in by_length:
                    by_length[n] = points(n)
                pivots, first = by_length[n]
                every = np.flatnonzero(sizes == n)
                step = max(1, AT_ONCE // max(n, len(pivots)))
                for at in range(0, len(every), step):
                    rows = every[at : at + step]
                    unit = _unit(batch.column(1).take(pa.array(rows)).flatten().to_numpy().reshape(-1, n).astype(float))
                    near = described(unit, pivots)
                    post = near[:, :first].astype(np.int64)
                    scale = np.abs(unit).max(1) / WHOLE
                    small = np.rint(unit / scale[:, None]).astype("<i2")
                    back = pa.array(np.repeat(np.arange(len(rows)), post.shape[1]))
                    columns = [batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(scale), pa.array([x.tobytes() for x in near], pa.binary()), pa.array([x.tobytes() for x in small], pa.binary())]
                    keys = (post + n * PIVOTS[1]).ravel()
                    depths = pa.array(np.full(len(keys), first, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(back) for c in columns), depths], ["key", "class", "copies", "scale", "near", "small", "depth"])

    postings = classes.select("class", "v", "copies").mapInArrow(posted, "key long, class long, copies long, scale double, near binary, small binary, depth int")
    met = blocked(postings, "key", "class").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["key", "lo", "hi"]):
            ids, copies, own, scale, first = (table.column(c).to_numpy() for c in ("class", "copies", "own", "scale", "depth"))
            key, lo, hi = (table.column(c).to_numpy() for c in ("key", "lo", "hi"))
            near, small = table.column("near").chunk(0), table.column("small").chunk(0)
            counts = np.zeros(len(ids), np.int64)
            links, open_ = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                m = e - s
                if m < 2:
                    continue
                v = np.frombuffer(b"".join(small.slice(s, m).to_pylist()), "<i2").reshape(m, -1) * scale[s:e, None]
                p = np.frombuffer(b"".join(near.slice(s, m).to_pylist()), np.uint16).reshape(m, -1)
                lost = scale[s:e] * np.sqrt(v.shape[1]) / 2 + 1e-12  # length of what rounding took from a vector
                trees = Forest(m)
                for a, b in candidates(p):
                    apart = own[s + a] != own[s + b] if lo[s] != hi[s] else np.ones(len(a), bool)
                    a, b = a[apart], b[apart]
                    like = np.concatenate([np.einsum("ij,ij->i", v[a[i : i + 4096]], v[b[i : i + 4096]]) for i in range(0, len(a), 4096)] or [np.empty(0)])
                    error = lost[a] + lost[b] + lost[a] * lost[b]
                    some = like >= least - error
                    a, b, sure = a[some], b[some], (like - error >= least)[some]
                    trees.link(a[sure], b[sure])
                    if not len(a):
                        continue
                    top = p[:, : first[s]]
                    both = np.where((top[a][:, :, None] == top[b][:, None, :]).any(2), top[a].astype(np.int64), PIVOTS[1])
                    here = both.min(1) == key[s] % PIVOTS[1]
                    x, y = a[here & sure], b[here & sure]
                    np.add.at(counts, s + x, copies[s + y])
                    np.add.at(counts, s + y, copies[s + x])
                    if (here & ~sure).any():
                        open_.append((ids[s + a[here & ~sure]], ids[s + b[here & ~sure]]))
                below, root = trees.edges()
                if len(below):
                    links.append((ids[s + below], ids[s + root]))
            rows = np.flatnonzero(counts)
            if len(rows):
                some, at = np.unique(ids[rows], return_inverse=True)
                total = np.zeros(len(some), np.int64)
                np.add.at(total, at, counts[rows])
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.array(total)], ["a", "b", "n"])
            for pairs, n in ((links, 0), (open_, -1)):  # links of a forest, and pairs yet to be verified
                if pairs:
                    both = np.unique(np.array([np.concatenate(x) for x in zip(*pairs, strict=True)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(np.full(both.shape[1], n, np.int64))], ["a", "b", "n"])

    share = needed(min(NEAREST, len(sent.value)))

    def candidates(p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a list's rows whose descriptions share enough pivots."""
        names, at = np.unique(p, return_inverse=True)
        holds = np.zeros((len(p), len(names)), np.float32)
        holds[np.arange(len(p))[:, None], at.reshape(p.shape)] = 1
        step = max(1, PAIRS_AT_ONCE // len(p))
        for i in range(0, len(p), step):
            a, b = np.nonzero(holds[i : i + step] @ holds[i:].T >= share)
            some = a < b
            yield a[some] + i, b[some] + i

    found = cut(met.mapInArrow(link, "a long, b long, n long"))
    whole = classes.select("class", "v", "copies")
    asked = found.where("n = -1").select("a", "b").join(whole.toDF("a", "va", "na"), "a").join(whole.toDF("b", "vb", "nb"), "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosines = [float(_unit(np.array(x, code).astype(float)[None])[0] @ _unit(np.array(y, code).astype(float)[None])[0]) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            some = pa.array(np.flatnonzero(np.array(cosines) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(some) for i in (0, 1, 4, 5)], ["a", "b", "na", "nb"])

    near_limit = cut(asked.select("a", "b", "va", "vb", "na", "nb").mapInArrow(verified, "a long, b long, na long, nb long"))
    counted = found.where("b is null").select(F.col("a").alias("class"), "n")
    counted = counted.unionByName(near_limit.select(F.col("a").alias("class"), F.col("nb").alias("n"))).unionByName(near_limit.select(F.col("b").alias("class"), F.col("na").alias("n")))
    counted = counted.groupBy("class").agg(F.sum("n").alias("n"))
    groups = components(found.where("n = 0").select("a", "b").unionByName(near_limit.select("a", "b")))
    named = classes.select("class", "h1", "h2", "least", "copies").join(counted, "class", "left").join(groups.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumns({"component": F.coalesce("component", "class"), "n_links": F.coalesce("n", F.lit(0)) + F.col("copies") - 1})
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(smallest, "component").select("h1", "h2", "n_links", "component_id"))
    rows = given.where("sound").select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Nearest vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries up to so many, about, are broadcast to the vectors at once.
BROADCAST_ROWS = 2_000
#: Scores of queries and vectors that a task holds at once.
SCORES = 1 << 21


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest vectors to each query; ties, to 12 places, by id. Both have id and embedding.

    A stated set of queries, of any number, against all vectors: the queries go to the vectors in blocks of about
    BROADCAST_ROWS by a hash of the id, and each task passes on its own k best for each query at most. Vectors and
    queries that are null, zero or hold null or non-finite components are near nothing, and vectors of other
    lengths are not compared.
    """
    asked = queries.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    given = vectors.select("id", F.col("embedding").cast("array<double>").alias("v"))
    blocks = -(-asked.count() // BROADCAST_ROWS)
    found = [_nearest(asked if blocks <= 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), given, k) for i in range(max(blocks, 1))]
    return reduce(DataFrame.unionByName, found)


def _sound(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places and unit vectors of the sound rows."""
    rows = lists.to_pylist() if lists.flatten().null_count else None
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    found = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        if rows is not None:
            at = np.array([i for i in at if None not in rows[i]], int)
        if not len(at):
            continue
        v = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)
        good = np.isfinite(v).all(1) & (v != 0).any(1)
        at, v = at[good], v[good]
        if len(at):
            v = v / np.abs(v).max(1, keepdims=True)
            found[n] = at, v / np.linalg.norm(v, axis=1, keepdims=True)
    return found


def _nearest(asked: DataFrame, given: DataFrame, k: int) -> DataFrame:
    told = asked.toArrow().combine_chunks()  # a block, about BROADCAST_ROWS
    ids, lists = told.column("query_id"), told.column("v")
    own = {n: (ids.take(pa.array(at)), v) for n, (at, v) in _sound(lists.chunk(0)).items()} if told.num_rows else {}
    sent = given.sparkSession.sparkContext.broadcast({n: v for n, (_, v) in own.items()})
    names = [(n, i, q) for n, (qs, _) in own.items() for i, q in enumerate(qs.to_pylist())]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, pa.Table] = {}
        for batch in batches:
            for n, (at, v) in _sound(batch.column(1)).items():
                queries = sent.value.get(n)
                if queries is None:
                    continue
                step = max(1, SCORES // len(queries))
                for i in range(0, len(at), step):
                    scores = np.round(queries @ v[i : i + step].T, 12)
                    m = min(k, scores.shape[1])
                    least = np.partition(scores, -m, axis=1)[:, -m][:, None]
                    q, r = np.nonzero(scores >= least)
                    new = pa.table({"q": q, "score": scores[q, r], "id": batch.column(0).take(pa.array(at[i : i + step][r]))})
                    both = pa.concat_tables([tops[n], new]) if n in tops else new
                    both = both.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
                    q = both.column("q").to_numpy()
                    first = np.searchsorted(q, q)
                    tops[n] = both.filter(pa.array(np.arange(len(q)) - first < k)).combine_chunks()
        for n, top in tops.items():
            yield from top.append_column("n", pa.array(np.full(top.num_rows, n))).select(["n", "q", "score", "id"]).to_batches()

    kind = given.schema["id"].dataType.simpleString()
    found = given.mapInArrow(best, f"n long, q long, score double, id {kind}")
    query_kind = asked.schema["query_id"].dataType.simpleString()
    table = given.sparkSession.createDataFrame(names, f"n long, q long, query_id {query_kind}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    rows = found.join(F.broadcast(table), ["n", "q"]).select("query_id", "id", "score")  # a row a query of the block
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)

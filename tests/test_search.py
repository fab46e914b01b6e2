"""Nearest vectors, in blocks of queries, against brute force."""

import numpy as np

from weftline.operators import search
from weftline.plans.queries import QUERIES


def brute(rows, asked, k=5):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    return {int(i): [int(x) for x in ids[np.lexsort((ids, -np.round(v @ v[at], 9)))][:k]] for at, i in enumerate(ids) if asked(i)}


def lists(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["id"])
    return found


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_ROWS", 30)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert lists(search.nearest(vectors.where("id < 100"), vectors).collect()) == brute(rows, lambda i: i < 100)
    assert search.nearest(vectors.limit(0), vectors).count() == 0


def test_every_twentieth_vector_asks(spark, data):
    sf_dir = f"{data}/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = QUERIES["embed_topk_twentieth"](spark, sf_dir).collect()
    assert lists(got).keys() == {i for i, _ in rows if i % 20 == 0}
    v = {i: np.array(x, float) / np.linalg.norm(np.array(x, float)) for i, x in rows}
    for q, want in brute(rows, lambda i: i % 20 == 0).items():
        mine = [r for r in got if r["query_id"] == q]
        np.testing.assert_allclose(sorted(r["score"] for r in mine), sorted(v[q] @ v[i] for i in want), atol=2e-6)

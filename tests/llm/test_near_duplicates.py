"""SimHash and pivot index against brute force."""

import re

import numpy as np
import pytest
import xxhash

from weftline.llm import cluster, pivots, simhash
from weftline.llm.queries import QUERIES


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(rows, texts):
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    ids = sorted(texts)
    v = np.array([fps[d] for d in ids], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3, 1))
    root = union_find(len(ids), zip(a, b, strict=True))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{fps[d]:016x}", ids[root[i]]) for i, d in enumerate(ids)}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_simhash_query(spark, data, sf):
    rows = QUERIES["op4_simhash"](spark, f"{data}/{sf}").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    check_simhash(rows, texts)


def test_simhash_odd_texts(spark):
    texts = {3: None, 4: "", 5: " \t\n", 6: "One", 7: "one", 8: "a b", 9: "A B C d é É", 10: "x\x85y z\xa0w q", 11: "word " * 5000, 12: "\x1c \x00 a"}
    df = spark.createDataFrame([(k, v, "clash", 1) for k, v in texts.items()], "doc_id long, text string, fp string, component_id int")
    rows = simhash.labelled(df).select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id").collect()
    check_simhash(rows, texts)
    null = spark.createDataFrame([(None, "same words here now"), (2, "same words here now"), (2, "same words here now")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.labelled(null).collect()) == [(0, 2), (2, 2), (2, 2)]
    assert simhash.labelled(df.limit(0)).count() == 0


def test_simhash_links_in_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    values = {base}
    for _ in range(400):
        x = base
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    values = sorted(values)
    monkeypatch.setattr(simhash, "blocked", lambda p, k, m: cluster.blocked(p, k, m, rows=20))
    fps = spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in values], "fp long")
    got = {r["node"]: r["component"] for r in cluster.components(simhash.linked(fps)).collect()}
    v = np.array(values, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3, 1))
    root = union_find(len(v), zip(a, b, strict=True))
    signed = v.view(np.int64)
    ours = [got.get(int(x), int(x)) for x in signed]
    assert len(set(zip(ours, root, strict=True))) == len(set(root)) == len(set(ours))


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))] + [(7, 7), (500, 501), (501, 500)]
    got = {r["node"]: r["component"] for r in cluster.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = union_find(600, pairs)
    assert got == {x: root[x] for p in pairs if p[0] != p[1] for x in p}
    assert cluster.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passes_of_components_are_few_tasks(spark, monkeypatch):
    """A driver holds what it knows of each task: a pass took 14 times the partitions, and now at most 7."""
    path = [int(x) for x in np.random.default_rng(2).permutation(500)]
    pairs = [*zip(path, path[1:], strict=False), *((9999, i) for i in range(1000, 1300)), *((2000, i) for i in range(2001, 2300))]
    passes = []
    stars = cluster._stars
    monkeypatch.setattr(cluster, "_stars", lambda links: passes.append(1) or stars(links))
    monkeypatch.setattr(cluster, "LINKS_AT_ONCE", 40, raising=False)
    links = cluster.cut(spark.createDataFrame(pairs, "a long, b long").repartition(4))
    context = spark.sparkContext
    context.setJobGroup("components", "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = cluster.components(links)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {r["node"]: r["component"] for r in found.collect()} == dict.fromkeys(range(500), 0) | dict.fromkeys([9999, *range(1000, 1300)], 1000) | dict.fromkeys(range(2000, 2300), 2000)
    assert tasks <= 7 * 4 * len(passes), (tasks, passes)


def check_pivots(rows, vectors, recall=1.0):
    sound = [i for i, (_, v) in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for n in {len(vectors[i][1]) for i in sound}:
        at = np.array([i for i in sound if len(vectors[i][1]) == n])
        m = np.array([vectors[i][1] for i in at], float)
        m /= np.abs(m).max(1, keepdims=True)
        m /= np.linalg.norm(m, axis=1)[:, None]
        a, b = np.nonzero(np.triu(m @ m.T >= 0.9, 1))
        pairs += list(zip(at[a], at[b], strict=True))
    want = np.bincount(np.array(pairs, int).ravel(), minlength=len(vectors))
    got = {r["vec_id"]: r for r in rows}
    total = sum(got[v[0]]["n_links"] for v in vectors)
    assert all(got[v[0]]["n_links"] <= want[i] for i, v in enumerate(vectors))
    assert total >= recall * want.sum()
    if total == want.sum():
        root = union_find(len(vectors), pairs)
        assert all((got[v[0]]["component_id"], got[v[0]]["kept"]) == (vectors[root[i]][0], root[i] == i) for i, v in enumerate(vectors))
    return total, want.sum()


def test_pivot_query(spark, data):
    for sf in ("sf0.01", "sf0.1"):
        rows = QUERIES["op3_pivots"](spark, f"{data}/{sf}").collect()
        vectors = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/{sf}/embeddings.parquet").collect())
        assert len(rows) == len(vectors)
        check_pivots(rows, vectors)


def test_pivot_recall_at_the_bound(spark):
    """Random vectors of 64 components, each with a partner at a cosine of just over 0.9, in floats."""
    rng = np.random.default_rng(9)
    x = pivots._unit(rng.normal(size=(3000, 64)))
    u = rng.normal(size=x.shape)
    u = pivots._unit(u - (u * x).sum(1, keepdims=True) * x)
    both = np.concatenate([x, 0.901 * x + np.sqrt(1 - 0.901**2) * u]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<float>")
    found, there = check_pivots(pivots.labelled(df).collect(), [(i, v.astype(float)) for i, v in enumerate(both)], recall=0.95)
    print(found / there)
    assert there >= 6000


def test_pivots_at_the_bound_are_told_by_whole_vectors(spark):
    """cos 0.9 but for one part in 10^9, above and below, which 16 bits can't tell."""
    rows = []
    for i in range(40):
        c = 0.9 + (1e-9 if i % 2 else -1e-9)
        base = np.zeros(24)
        base[i % 5], other = 1.0, np.zeros(24)
        other[i % 5], other[5 + i % 19] = c, np.sqrt(1 - c * c)
        rows += [(2 * i, base.tolist()), (2 * i + 1, other.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_pivots(pivots.labelled(df).collect(), [(i, np.array(v)) for i, v in rows], recall=1.0)


def test_pivots_near_the_bound_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    near = x[:600] / np.linalg.norm(x[:600], axis=1)[:, None] + rng.normal(size=(600, 16)) * 0.11
    vectors = [(i, [float(y) for y in v]) for i, v in enumerate([*x, *near, *x[:50], *(x[:50] * 3)])]
    n = len(vectors)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-300] * 16, [1e300] * 16]
    vectors += [(n + i, v) for i, v in enumerate(odd)]
    monkeypatch.setattr(pivots, "blocked", lambda p, k, m: cluster.blocked(p, k, m, rows=30))
    df = spark.createDataFrame([(*v, "clash") for v in vectors], "vec_id long, embedding array<double>, v string")
    found, there = check_pivots(pivots.labelled(df).collect(), vectors, recall=0.95)
    assert there > 500
    assert pivots.labelled(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in pivots.labelled(twice).collect()) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]

"""The pipeline, each stage on what the stage before kept."""

import importlib
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_language import plain_places
from tests.llm.test_near_copies import kept as kept_by_jaccard
from tests.llm.test_tokens import check_pieces
from weftline.llm import language


def test_stages(spark, data, tmp_path):
    sf_dir = f"{data}/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(5000, "12 34 !!", "en", "src0", 8), (5001, None, None, None, None), (5002, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(junk)
    start = docs
    kept = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert docs.count() == len(kept[-1]) <= len(kept[-2])
    first, sure, single, cut, clean = kept
    model = language.learned(start, usable=language.not_held_out())
    told = {}
    for i, text in first.items():  # by a plain scorer
        if text is None or not any(c.isalpha() for c in text):
            continue
        places = plain_places(text, model.bits) if len(text) < 600 else np.concatenate(list(language.hashed_grams(text, model.bits)))
        z = (model.weights[places].astype(float).sum(0) / len(places) + model.bias) / model.temperature
        told[i] = float(1 / np.exp(z - z.max()).sum())
    unsure = {i for i, p in told.items() if abs(p - corpus_pipeline.LEAST_SCORE) < 1e-4}
    assert {i for i, p in told.items() if p >= corpus_pipeline.LEAST_SCORE} - unsure == set(sure) - unsure
    assert not {5000, 5001, 5002} & set(sure) and len(sure) > 0.98 * (len(first) - 3)
    want, pairs = kept_by_jaccard(sure)
    assert pairs and set(single) == want and all(single[i] == first[i] for i in single)
    assert set(cut) <= set(single)
    seen = set()
    for i in sorted(cut):  # no passage of 51 words is left twice
        words = [m.span() for m in re.finditer(r"\S+", cut[i])]
        own = {cut[i][words[k][0] : words[k + 50][1]] for k in range(len(words) - 50)}
        assert not own & seen
        seen |= own
    assert all(r["n_chars"] == len(r["text"]) for r in spark.read.parquet(str(tmp_path / "repeated_passages")).collect() if cut[r["doc_id"]] != single[r["doc_id"]])
    items = [" ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", r["text"].lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plain = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) + " "
    leaks = {i for i, t in cut.items() if any(f" {x} " in plain(t) for x in items)}
    assert leaks and not leaks & set(clean) and len(set(cut) - set(clean) - leaks) <= 0.01 * len(cut)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    check_pieces(packed.collect(), clean, 4096)


def test_run_and_registration(spark, data):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert len({n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)}) == 10
    rows = corpus_pipeline.run(spark, f"{data}/sf0.001").collect()
    assert rows and sum(r["length"] for r in rows) == sum(len(r["ids"]) // 4 for r in rows)


def test_stages_on_empty_tables(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"{data}/sf0.001").count() == 0


def test_repeated_and_null_rows(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    text = docs.first()["text"]
    odd = spark.createDataFrame([(1, text, "en", "s", 5)] * 3 + [(None, text + " x", "en", None, None), (None, None, None, None, None), (2, "", None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, f"{data}/sf0.001").collect()
        if name == "near_duplicates":
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == [(False, 1), (False, 2)]


if __name__ == "__main__":
    pytest.main([__file__])

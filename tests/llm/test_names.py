"""Columns of any name pass through the operators that keep rows."""

import pytest

from weftline.llm import chunks, decontamination, language, sharding, simhash

NAMES = "__id __hash __rows __own_id __own_hash __spans __left __told __part __p __k1 __k2 __n row rows spans left who text_hash told none own hashed k1 k2 part p n cuts lo1 fp set keys key component place again".split()


@pytest.mark.parametrize("operator", ["one_of_each", "near", "without_repeats", "clean", "predicted", "sharded"])
def test_clashing_names(spark, operator):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, *NAMES), (2, long + " more", *NAMES), (3, "und die katze", *NAMES), (None, None, *NAMES), (3, "und die katze", *NAMES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    bench = spark.createDataFrame([(1, "die katze")], "item_id long, text string")
    model = language.learned(df.selectExpr("doc_id", "text", "'de' as lang"))
    out = {
        "one_of_each": lambda: simhash.one_of_each(df),
        "near": lambda: simhash.one_of_each(df, words=5, least=0.8),
        "without_repeats": lambda: chunks.without_repeats(df),
        "clean": lambda: decontamination.clean(df, bench),
        "predicted": lambda: language.predicted(df, model).drop("lang_pred", "lang_score"),
        "sharded": lambda: sharding.sharded(df, 3).drop("size", "text_crc32", "shard", "slot"),
    }[operator]()
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in out.collect()))
    assert all(tuple(r)[2:] == tuple(NAMES) for r in out.collect())
    assert len(got) == {"one_of_each": 4, "near": 3, "without_repeats": 5, "clean": 3, "predicted": 5, "sharded": 5}[operator] or operator == "one_of_each" and len(got) == 3

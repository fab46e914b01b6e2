"""Decontamination against plain versions, and its recall."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import decontamination
from weftline.llm.queries import QUERIES
from weftline.llm.words import hashed_words


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_nearest_is_exact():
    rng = random.Random(8)
    items = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))] for _ in range(90)]
    texts = [[rng.randrange(1, 5) for _ in range(rng.randrange(0, 14))] for _ in items]
    told = decontamination.nearest([np.array(x, np.uint64) for x in items], [np.array(x, np.uint64) for x in texts])
    for item, text, (d, s, e) in zip(items, texts, told, strict=True):
        best = min(plain_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert d == best == plain_distance(item, text[s:e])


def test_segments_cover_an_item():
    for n in range(1, 400):
        own = decontamination.segments(n)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own[:-1], own[1:], strict=True))
        assert all(0 < b - a <= decontamination.SEGMENT for a, b in own)
        # edits of the whole leave one segment within its own
        assert sum(decontamination.most_edits(b - a) + 1 for a, b in own) > decontamination.most_edits(n)
        assert decontamination.segments(0) == []


def edited(words, k, rng, word):
    words = list(words)
    for _ in range(k):
        how, at = rng.randrange(3), rng.randrange(len(words))
        if how == 0:
            words[at] = word()
        elif how == 1:
            words.insert(at, word())
        elif len(words) > 1:
            del words[at]
    return words


def words_of(rng):
    return lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))


def grams(text, words):
    h = hashed_words([text.encode()])[0]
    return set(decontamination._grams(h, words).tolist())


def test_gate_loses_nothing():
    rng = random.Random(6)
    word = words_of(rng)
    for n in range(1, 65):
        words, need = decontamination.gate_of(n)
        for _ in range(6):
            item = [word() for _ in range(n)]
            part = edited(item, decontamination.most_edits(n), rng, word)
            assert len(grams(" ".join(item), words) & grams(" ".join(part), words)) >= min(need, len(grams(" ".join(item), words)))


@pytest.mark.parametrize(("n", "wanted"), [(1, 1.0), (3, 1.0), (4, 1.0), (5, 0.98), (6, 0.98), (10, 0.95), (20, 0.95), (60, 0.9), (150, 0.95)])
def test_recall_at_the_greatest_number_of_edits(spark, n, wanted):
    rng = random.Random(n)
    word = words_of(rng)
    items = [(i, " ".join(("zq" + word()) if n < 4 else word() for _ in range(n))) for i in range(60)]
    docs = []
    for copy in range(4):
        for i, t in items:
            part = edited(t.split(), decontamination.most_edits(n), rng, word)
            around = [word() for _ in range(rng.randrange(60))]
            at = rng.randrange(len(around) + 1)
            docs.append((len(docs), " ".join(around[:at]) + ", " + " ".join(part).upper() + ".\n" + " ".join(around[at:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.found(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    recall = np.mean([(d, d % 60) in got for d, _ in docs])
    print(n, recall)
    assert recall >= wanted
    by_item, by_doc = dict(items), dict(docs)
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    for r in rows[:100]:
        part = split(by_doc[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode())
        assert plain_distance(split(by_item[r["item_id"]]), part) == r["edits"] <= 0.2 * n


def test_decontamination_query(spark, data):
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/sf0.01/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/sf0.01/benchmark.parquet").collect()}
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    joined = {d: " " + " ".join(words(t)) + " " for d, t in documents.items()}
    exact = {(d, i) for i, t in items.items() for d in documents if " " + " ".join(words(t)) + " " in joined[d]}
    rows = QUERIES["op7_decontamination"](spark, f"{data}/sf0.01").collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert exact and exact <= got
    for r in rows:
        part = words(documents[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode())
        assert plain_distance(words(items[r["item_id"]]), part) == r["edits"] <= 0.2 * r["item_words"]


def test_decontamination_of_odd_tables(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None, 1, 1, "r"), (2, "", 1, 1, "r"), (3, item, 1, 1, "r"), (None, f"x {item} y {item}", 1, 1, "r"), (3, item, 1, 1, "r"), (4, "one two", 1, 1, "r"), (5, "two one", 1, 1, "r")], "doc_id long, text string, item_id int, own int, row string")
    bench = spark.createDataFrame([(1, item), (None, item.upper()), (3, None), (4, "one two"), (5, "")], "item_id long, text string")
    rows = decontamination.found(docs, bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in rows) == {(3, 1): 2, (3, None): 2, (3, 4): 2, (None, 1): 2, (None, None): 2, (None, 4): 2, (4, 4): 1}
    left = decontamination.clean(docs, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 5] and left.columns == docs.columns
    assert decontamination.found(docs.limit(0), bench).count() == 0 and decontamination.found(docs, bench.limit(0)).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == 7


def test_long_texts_and_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "TEXT_BYTES", 500)  # of this process alone
    texts = [b"Ab c, " * 400, "\u00e9t\u00e9 x ".encode() * 300, b"", b"w" * 3000]
    for a, b in zip(decontamination.hashed_parts(texts), hashed_words(texts), strict=True):
        assert (a == b).all()
    monkeypatch.undo()
    rng = random.Random(1)
    word = words_of(rng)
    item = [word() for _ in range(3000)]
    part = edited(item, 450, rng, word)
    text = " ".join([word() for _ in range(150_000)] + part + [word() for _ in range(150_000)])
    docs = spark.createDataFrame([(1, text), (2, " ".join(item[:2000]))], "doc_id long, text string")
    (r,) = decontamination.found(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert r["doc_id"] == 1 and r["edits"] <= 450

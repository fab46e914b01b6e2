"""Licences, shards, chats, chunks, decontamination and languages against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import accumulate

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import arrays, chat, chunks, language, licenses, sharding
from weftline.llm.license_rules import BASE, RULES
from weftline.llm.queries import HOSTILE, ORACLE_SQL, PASSAGE_WORDS, QUERIES

ODD = [None, "", "   ", "\n", "Été — ñandú", "x" * 5000, "a b c " * 3000]


def documents(spark, data, sf="sf0.01"):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/{sf}/documents.parquet").collect()}


# -- licences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{data}/sf0.001/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, f"{data}/sf0.001").toPandas(), con.sql(ORACLE_SQL[name]).df()
    key = ours.columns[0]
    ours, theirs = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True).astype(object).where(lambda d: d.notna(), None) for x in (ours, theirs))
    assert list(ours.columns) == list(theirs.columns) and (ours.values == theirs.values).all()


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for label, phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_base_phrases(spark, data):
    texts = documents(spark, data) | {-1 - i: t for i, t in enumerate([*ODD, "UNDER the MIT\nLicense, under-the/mit license. under the mit licenses", "cc by nc cc by nc CC-BY-NC-SA 4.0", "apache license version 2 2 Apache License, Version 2.0", "ſ cc K by nc"])}
    df = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "doc_id long, text string, base string")
    rows = licenses.digest(licenses.scanned(df)).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in rows} == {k: plain_base(v) for k, v in texts.items()}
    assert licenses.digest(licenses.scanned(df.limit(0))).count() == 0


def sample(pattern):
    """A text that a pattern matches: optional parts left out, first alternatives, no repeats."""
    out = pattern
    while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m[2] else m[1], out)) != out:
        out = new
    out = re.sub(r"\.\{\d+,\d+\}\??", "some one", re.sub(r"\[(.)[^\]]*\]", r"\1", out))
    return re.sub(r".\?", "", out).strip()


def test_every_rule_is_reached(spark):
    assert len(RULES) > 200
    texts = [(i, sample(line.split(";", 3)[3].strip()).replace(" ", "\n").upper()) for i, line in enumerate(RULES)]
    rows = licenses.scanned(spark.createDataFrame(texts, "doc_id int, text string")).collect()
    missed = [RULES[r["doc_id"]] for r in rows if r["doc_id"] not in {p["rank"] for p in r["license_places"]}]
    assert not missed


def test_containment_and_priority(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0. Also GPL v2, and the MIT License")], "doc_id int, text string")
    found = licenses.scanned(df).first()["license_found"]
    spans = [(p["first"], -p["minus_last"], p["label"]) for p in found]
    assert spans[0] == (0, 7, "apache-2") and [s[2] for s in spans] == ["apache-2", "gpl-2.0", "mit"]
    assert all(not (a[0] <= b[0] and b[1] <= a[1]) for a in spans for b in spans if a != b)


def test_many_matches_take_time_in_proportion(spark):
    """100,000 matches in one text, nested and not; the places are those of a plain scan."""
    parts = ["under the mit license", "see the", "apache license version 2 0", "cc by nc"]
    rng = random.Random(2)
    text = " ".join(rng.choice(parts) for _ in range(130_000))
    began = time.time()
    r = licenses.digest(licenses.scanned(spark.createDataFrame([(1, text), (2, "mit " * 5)], "doc_id long, text string"))).where("doc_id = 1").first()
    assert r["n_base"] > 90_000 and tuple(r)[1:6] == plain_base(text)
    assert time.time() - began < 60
    for n in (0, 1, 255, 256, 257, 1000):
        values = [rng.randrange(-5, 50) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<bigint>").select(arrays.sums(F.col("v")).alias("s"), arrays.maxima(F.col("v")).alias("m")).first()
        assert df["s"] == list(accumulate(values)) and df["m"] == list(accumulate(values, max))


def test_long_blocks_take_time_in_proportion(spark):
    rows = [(1, i, "assistant", f"turn <|{i}|>") for i in range(20_000)] + [(2, i, "user" if i % 2 else "assistant", "x") for i in range(20_000)]
    began = time.time()
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [r[3] for r in rows[:20_000]] and got[1]["loss_text"] == "".join(r[3] for r in rows[:20_000])
    assert got[2]["loss_text"] == "x" * 10_000
    assert time.time() - began < 60


# -- shards


def check_shards(rows, texts, n, slack=None):
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by) <= set(range(n))
    sizes = [sum(r["size"] for r in by.get(k, ())) for k in range(n)]
    most = max((r["size"] for r in rows), default=0)
    assert max(sizes) - min(sizes) <= (slack if slack is not None else 2 * most + 2)
    return sizes


def test_sharding_query(spark, data):
    for sf in ("sf0.01", "sf0.1"):
        texts = documents(spark, data, sf)
        rows = QUERIES["op2_sharding"](spark, f"{data}/{sf}").collect()
        sizes = check_shards(rows, list(texts.items()), 40)
        assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["law"] == "bytes" for r in rows)
        if sf == "sf0.1":
            mean = sum(sizes) / 40
            largest = max(r["size"] for r in rows)
            assert max(abs(s - mean) for s in sizes) <= max(0.002 * mean, largest)


def test_sharding_odd_tables(spark):
    rng = random.Random(4)
    texts = [(i, rng.choice(["same text", "x" * rng.randrange(50), None, ""])) for i in range(3000)] + [(7, "equal row")] * 2000 + [(None, "y")] * 300
    df = spark.createDataFrame([(*t, 1, "clash") for t in texts], "doc_id long, text string, slot int, part string")
    for n in (1, 7, 40):
        rows = sharding.sharded(df, n).select("doc_id", "size", "shard", "slot").collect()
        check_shards(rows, texts, n, 200)
    assert sharding.sharded(df.limit(0), 5).count() == 0
    few = sharding.sharded(df.limit(2), 5).collect()
    assert len(few) == 2


# -- chats


def test_chats_come_back(spark):
    control = [HOSTILE, "<|im_next|>", "a<\\|b", "<\\\\|", "<", "|x", "\\", "<|", "", None, "line\nbreak", "é\U0001f600<|im_end|>\n"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\n<|role"]), rng.choice(control)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (99, None, "assistant", "y"), (99, 1, "assistant", "y"), (99, 1, "assistant", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, ts string")
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    made = chat.formatted(df)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert {c: r["loss_text"] for c, r in got.items()} == {c: "".join(x for role, x in turns if role == "assistant") for c, turns in want.items()}
    assert made.where(F.col("formatted").rlike(r"<\|(?!im_start\|>|im_end\|>|im_next\|>|nl\|>)")).count() == 0
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_chat_query_has_the_hostile_one(spark, data):
    r = QUERIES["op5_chat"](spark, f"{data}/sf0.001").where("conv_id = -1").first()
    told = f"user\n{HOSTILE}\nassistant\n{HOSTILE}\n"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(HOSTILE)) and r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()


# -- chunks


def test_gear_is_a_window():
    data = np.frombuffer(bytes(range(200)) * 3, np.uint8)
    h = chunks.gear(data)
    for i in (20, 100, 599):
        assert h[i] == sum(int(chunks._GEAR[data[i - j]]) << j for j in range(8)) % 2**32


def test_chunks_of_texts_do_not_depend_on_neighbours():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab  cé\n") for _ in range(rng.randrange(900))).encode() for _ in range(60)] + [b"", b" ", b"w " * 26, b"w " * 25]
    together = chunks.stretches(texts)
    for t, (s, e) in zip(texts, together, strict=True):
        (alone,) = chunks.stretches([t])
        assert (alone[0] == s).all() and (alone[1] == e).all()
        words = t.decode().split()
        assert (len(s) > 0) == (len(words) >= chunks.MIN_WORDS)
        for i, j in zip(s, e, strict=True):
            n = len(t[i:j].decode().split())
            assert n >= chunks.MIN_WORDS and (n <= chunks.MIN_WORDS + 2 * chunks.REACH)
            assert t[i:j] == t[i:j].strip()


def planted(seed=3, words=51):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(words) for _ in range(10)]
    docs, has = {}, {}
    for i in range(120):
        own = [text(rng.randrange(5, 200)) for _ in range(3)]
        if i % 4 == 0:
            p = rng.randrange(10)
            own.insert(rng.randrange(4), passages[p])
            has[i] = p
        docs[i] = rng.choice([" ", "\n"]).join(own)
    return docs, has, passages


def test_repeated_passages_are_found_and_no_others(spark):
    docs, has, passages = planted()
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id long, text string, start int")
    rows = {r["doc_id"]: r["spans"] for r in chunks.repeats(df).collect()}
    first = {}
    for i in sorted(has):
        first.setdefault(has[i], i)
    assert set(rows) == {i for i in has if first[has[i]] != i}
    for i, spans in rows.items():
        raw = docs[i].encode()
        assert first[has[i]] in {s["kept_in"] for s in spans}
        assert all(has[s["kept_in"]] == has[i] and s["kept_in"] < i and raw[s["start"] : s["end"]].decode() in docs[s["kept_in"]] for s in spans)
    left = {r["doc_id"]: r["text"] for r in chunks.without_repeats(df).collect()}
    assert {i for i in docs if left[i] != docs[i]} == set(rows)
    assert passages


def test_chunks_of_odd_tables(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, long), (None, long + " tail"), (6, long + " " + long), (7, "short text"), (8, "short text")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = Counter(r["doc_id"] for r in chunks.repeats(df).collect())
    assert got == {None: 1, 3: 1, 4: 1, 6: 1}  # of the two without an id one keeps the passage
    assert next(r for r in chunks.repeats(df).collect() if r["doc_id"] == 6)["spans"][-1]["end"] > len(long) * 1.8
    left = Counter(r["doc_id"] for r in chunks.without_repeats(df).collect())
    assert {1, 2, 7, 8} <= set(left) and not {3, 4} & set(left) and left[None] in (1, 2)
    assert chunks.without_repeats(df.limit(0)).count() == 0 and chunks.repeats(df.limit(0)).count() == 0


def test_repeats_within_one_document(spark):
    long = " ".join(f"word{i}" for i in range(60))
    alone = spark.createDataFrame([(1, long + " and " + long + " end")], "doc_id long, text string")
    (r,) = chunks.repeats(alone).collect()
    assert all(s["kept_in"] == 1 and s["start"] >= len(long) for s in r["spans"])
    (left,) = chunks.without_repeats(alone).collect()
    assert left["text"].startswith(long + " and ") and left["text"].endswith(" end") and len(left["text"]) < 1.4 * len(long)
    periodic = spark.createDataFrame([(1, "one two three " * 500), (2, "w " * 5000)], "doc_id long, text string")
    for r in chunks.without_repeats(periodic).collect():  # the first stretch stays
        assert chunks.MIN_WORDS <= len(r["text"].split()) <= 4 * chunks.MIN_WORDS


def test_short_repeats(spark):
    """Of passages of 14 to 60 words, the share that is found; from 14 + 2 * 11 words on all are."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, sizes = [], {}
    for i in range(300):
        n = rng.choice([10, 13, 16, 20, 25, 30, 36, 40, 52])
        p = text(n)
        sizes[2 * i + 1] = n
        rows += [(2 * i + k, f"{text(30)} {p} {text(30)}") for k in (0, 1)]
    got = {r["doc_id"] for r in chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {n: np.mean([i in got for i, m in sizes.items() if m == n]) for n in sorted(set(sizes.values()))}
    print(share)
    assert share[10] == share[13] == 0 and share[20] > 0.2 and share[25] > 0.6 and share[30] > 0.95 and share[36 + 4] == share[52] == 1 and not {i for i in got if i % 2 == 0}


def test_digests_are_whole(spark):
    """128 bits: two columns of 64, of which no bit is the same in all."""
    docs, _, _ = planted()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(docs)), pa.array([1] * len(docs)), pa.array([t.encode() for t in docs.values()])], ["who", "text_hash", "text"])
    for column in list(next(chunks._chunked(iter([batch]))))[2:]:
        bits = np.unpackbits(column.view(np.uint8)).reshape(-1, 64)
        assert bits.any(0).all() and not bits.all(0).any()


def test_chunk_query_spans_repeat(spark, data):
    texts = documents(spark, data)
    rows = QUERIES["op6_chunks"](spark, f"{data}/sf0.01").collect()
    seen = {}
    for d in sorted(texts):
        words = texts[d].split()
        for i in range(len(words) - PASSAGE_WORDS + 1):
            seen.setdefault(" ".join(words[i : i + PASSAGE_WORDS]), d)
    for r in rows:
        part = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().split()
        n = PASSAGE_WORDS
        assert seen[" ".join(part[:n])] <= r["doc_id"] and all(k <= r["doc_id"] for k in r["kept_in"])
    flagged = {r["doc_id"] for r in rows}
    seen = {}
    for d in sorted(texts):  # every passage of 51 words that an earlier document has, byte for byte
        spots = [m.start() for m in re.finditer(r"\S+", texts[d])]
        ends = [m.end() for m in re.finditer(r"\S+", texts[d])]
        windows = {texts[d][spots[i] : ends[i + 50]] for i in range(len(spots) - 50)}
        if any(seen.get(w, d) != d for w in windows):
            assert d in flagged
        for w in windows:
            seen.setdefault(w, d)


# -- languages


def test_language_query(spark, data):
    rows = QUERIES["op9_language"](spark, f"{data}/sf0.1").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/sf0.1/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows} <= {*truth.values(), "und"}
    right = np.array([r["lang_pred"] == truth[r["doc_id"]] for r in held])
    scores = np.array([r["score"] for r in held])
    assert right.mean() > 0.99
    assert abs(scores.mean() - right.mean()) < 0.02  # calibrated


def test_language_of_odd_tables(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30 + [(None, "en"), ("123 ...", "en"), ("", None), ("und die katze ist hier", None), ("the dog", None)])]
    df = spark.createDataFrame([*rows, (None, "the cat", "en", 1), rows[0]], "doc_id long, text string, lang string, lang_pred int")
    model = language.learned(df)
    got = language.predicted(df, model, keep=["doc_id"]).collect()
    assert len(got) == len(rows) + 2
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[i] for i in range(60, 65)] == ["und", "und", "und", "de", "en"] and by[0] == "en"
    assert language.learned(df.limit(0)) is None
    assert {r["lang_pred"] for r in language.predicted(df, None, keep=["doc_id"]).collect()} == {"und"}
    assert language.predicted(df.limit(0), model, keep=["doc_id"]).count() == 0


def test_long_texts_are_read_in_parts_and_whole(monkeypatch):
    text = "Der Hund, die Katze; é 12 und ßo. " * 50
    whole = language.counted(text)
    monkeypatch.setattr(language, "AT_ONCE", 100)
    parts = language.counted(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])

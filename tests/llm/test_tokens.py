"""Encoder, packing, range coder and token files."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import packing, range_coder, token_files
from weftline.llm.cluster import new_folder
from weftline.llm.queries import END_ID, QUERIES, tokenizer_path
from weftline.llm.token_ids import Encoder

ENCODER, TOKENIZER = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
ODD = ["", " ", "\n\t", "don't I'LL we'Re", "a<|endoftext|>b <|ENDOFTEXT|>", "A\x1cb\x1d c", "É é İ ΑΣ ς K Å ﬁ", "x" * 300, "12 3a4 ²½ _-_", "日本語 テスト한글 ก็", "a b c　d", "...,, ,.a.,b", "\U0001f600 \U0001f469‍\U0001f680", "µ ª º ß ÿ Ÿ", "a\x00b \x7f \x85 z"]


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def ours(text):
    return np.frombuffer(ENCODER(text), f"<u{ENCODER.width}").tolist()


@pytest.mark.parametrize("text", ODD)
def test_encoder_on_odd_texts(text):
    assert ours(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aZéÉß.,'’ \n\t-<|>0_&İſ", max_size=60), st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60)))
def test_encoder_is_the_tokenizer(text):
    assert ENCODER.by_chunk and ENCODER.lowers and ENCODER.spelt
    assert ours(text) == plain(text)


def test_encoder_forgets(monkeypatch):
    from weftline.llm import token_ids

    monkeypatch.setattr(token_ids, "CACHE_BYTES", 2000)
    text = " ".join(f"word{i} Thing, other" for i in range(50))
    own = Encoder(tokenizer_path())
    assert np.frombuffer(own(text), "<u2").tolist() == plain(text)
    assert np.frombuffer(own(text), "<u2").tolist() == plain(text)
    assert own.bytes < 3000 and len(own.known) + len(own.elder) < 40


def test_encoder_cuts_long_columns(monkeypatch):
    from weftline.llm import token_ids

    monkeypatch.setattr(token_ids, "AT_ONCE", 50)
    texts = ["One, two; 3 four." * 9, None, "", *ODD, "É é " * 40, "x"]
    assert [np.frombuffer(x, "<u2").tolist() for x in ENCODER.many(pa.array(texts))] == [plain(t) for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in ENCODER.many(pa.array(texts).slice(2, 9))] == [plain(t) for t in texts[2:11]]


def test_encoder_of_another_kind():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, there = Encoder(path), Tokenizer.from_file(path)
    assert not own.by_chunk
    assert np.frombuffer(own("Hello  world\n x"), f"<u{own.width}").tolist() == there.encode("Hello  world\n x", add_special_tokens=False).ids


def check_pieces(rows, texts, window):
    ids = {d: np.array([*plain(t), END_ID], "<u4") for d, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[d])
    full = []
    for k in sorted(by_seq):
        at = 0
        for r in sorted(by_seq[k], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        full.append(at)
    assert set(full[:-1]) <= {window} and full[-1] <= window and sorted(by_seq) == list(range(len(full)))
    return by_seq


def test_packing_query(spark, data):
    rows = QUERIES["op8_packing"](spark, f"{data}/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/sf0.01/documents.parquet").collect()}
    sequences = check_pieces(rows, texts, 4096)
    total = {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + r["length"]
    everything, done = sum(total.values()), dict.fromkeys(total, 0)
    for k in sorted(sequences):
        for r in sequences[k]:
            done[r["source"]] += r["length"]
        at = min((k + 1) * 4096, everything)
        assert all(abs(done[s] - at * total[s] / everything) < len(total) for s in total)  # the deficits


def test_packing_odd_tables(spark):
    rng = random.Random(2)
    texts = {i: rng.choice([None, "", "a", "one two three", "w " * 700]) for i in range(60)}
    df = spark.createDataFrame([(i, t, rng.choice([None, "x", "y", "z"]), 3) for i, t in texts.items()], "doc_id long, text string, source string, offset int")
    for weights in (None, {"x": 3, "y": 1}):
        rows = packing.packed(df, tokenizer_path(), window=64, weights=weights).collect()
        check_pieces(rows, texts, 64)
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows)
    assert packing.packed(df.limit(0), tokenizer_path()).count() == 0
    twice = spark.createDataFrame([(None, "a b", None)] * 3, "doc_id long, text string, source string")
    assert sum(r["length"] for r in packing.packed(twice, tokenizer_path()).collect()) == 9


def test_packing_many_sources(spark):
    """Each of 90 sources due an id a window is in its share throughout; 4 that are due less have theirs together."""
    texts = {i: "a " * (50 + i % 90) for i in range(900)}
    tiny = {1000 + i: "b" for i in range(4)}
    rows = [(i, t, f"s{i % 90}") for i, t in texts.items()] + [(i, t, f"t{i}") for i, t in tiny.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = packing.packed(df, tokenizer_path(), window=1024).collect()
    sequences = check_pieces(found, texts | tiny, 1024)
    total = {}
    for r in found:
        total[r["source"]] = total.get(r["source"], 0) + r["length"]
    everything, done = sum(total.values()), dict.fromkeys(total, 0)
    assert all(total[f"t{i}"] * 1024 < everything for i in tiny)
    for k in sorted(sequences):
        for r in sequences[k]:
            done[r["source"]] += r["length"]
        at = min((k + 1) * 1024, everything)
        assert all(abs(done[s] - at * total[s] / everything) < 3 for s in total if s[0] == "s")
    weights = {f"s{i}": 1 + i for i in range(90)}
    check_pieces(packing.packed(df, tokenizer_path(), window=1024, weights=weights).collect(), texts | tiny, 1024)


@pytest.mark.parametrize(("sizes", "weights"), [([100, 3, 1, 1, 0, 977], None), ([5000, 1, 1, 1, 1], None), ([100, 300, 50, 7], [1, 1, 5, 0]), ([10**13, 10**12, 7], None), ([1], None)])
def test_schedule(sizes, weights):
    window = 64 if sum(sizes) < 10**6 else 1 << 36
    s = packing.Schedule(sizes, window, weights)
    table = s.before(0, s.windows)
    assert table[0].tolist() == [0] * len(sizes) and table[-1].tolist() == sizes
    assert (np.diff(table, axis=0) >= 0).all()
    assert table.sum(1).tolist() == [min(k * window, sum(sizes)) for k in range(s.windows + 1)]
    assert all((s.before(k, k)[0] == table[k]).all() for k in range(0, s.windows + 1, 7))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 16) - 1), min_size=1, max_size=300), min_size=1, max_size=6))
def test_range_coder_round_trip(blocks):
    blocks = [np.array(b, np.int64) for b in sorted(blocks, key=len, reverse=True)]
    again = range_coder.decode(range_coder.encode(blocks, 16), [len(b) for b in blocks], 16)
    assert all((a == b).all() for a, b in zip(again, blocks, strict=True))


def test_range_coder_presses_and_wide_ids():
    rng = np.random.default_rng(0)
    often = [(rng.zipf(1.3, 4096) % 49_000).astype(np.int64) for _ in range(30)]
    coded = range_coder.encode(often, 16)
    assert sum(map(len, coded)) < 0.75 * 2 * 30 * 4096
    assert all((a == b).all() for a, b in zip(range_coder.decode(coded, [4096] * 30, 16), often, strict=True))
    same = [np.tile(rng.integers(0, 49_000, 64), 64) for _ in range(3)]
    assert sum(map(len, range_coder.encode(same, 16))) < 0.15 * 2 * 3 * 4096
    wide = [rng.integers(0, 1 << 24, 500)]
    assert (range_coder.decode(range_coder.encode(wide, 32), [500], 32)[0] == wide[0]).all()


def test_token_files_query(spark, data):
    rows = sorted(QUERIES["op10_token_files"](spark, f"{data}/sf0.001").collect())
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect())
    at = 0
    for r, (d, t) in zip(rows, texts, strict=True):
        ids = np.array([*plain(t), END_ID], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_odd_tables(spark, monkeypatch):
    texts = [(5, "b c"), (None, "a"), (3, None), (3, ""), (5, "b c"), (1, "word " * 900), (2, "x")]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, part int")
    path = new_folder(spark, "odd")
    token_files.written(df, path, tokenizer_path())
    rows = token_files.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 5, 5]
    want = sorted(([*plain(t), END_ID] for _, t in texts), key=len)
    assert sorted((np.frombuffer(r["ids"], "<u4").tolist() for r in rows), key=len) == want
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    empty = new_folder(spark, "empty")
    token_files.written(df.limit(0), empty, tokenizer_path())
    assert token_files.read(spark, empty).count() == 0


def test_groups_go_on_and_damage_is_seen(monkeypatch):
    ids = np.arange(5000) % 777
    group = token_files._group(0, [(1, 4000, 0), (2, 1000, 1)], ids, 16) + token_files.END.encode()
    (part, docs, again), *rest = token_files.groups(group + group)
    assert part == 0 and len(rest) == 1 and (again == ids).all() and docs["n"].tolist() == [4000, 1000]
    for at in (3, 30, len(group) // 2, len(group) - 10):
        broken = bytearray(group)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(token_files.groups(bytes(broken)))


def test_range_coder_adapts_at_every_step():
    """Ids that follow each other surely for a while, then don't, again and again: 9.85 bits an id; 10.12 if chances wait for set steps."""
    rng = np.random.default_rng(4)
    chain = rng.permutation(300)
    blocks = []
    for _ in range(40):
        out, x = [], 0
        while len(out) < 4096:
            for _ in range(40):
                x = int(chain[x])
                out.append(x)
            out += rng.integers(0, 300, 40).tolist()
        blocks.append(np.array(out[:4096], np.uint16))
    bits = 8 * sum(map(len, range_coder.encode(blocks, 16))) / (40 * 4096)
    print(bits)
    assert bits < 10


def test_remembered_chunks_are_bounded():
    import random
    import sys

    from weftline.llm.token_ids import Encoder

    rng = random.Random(5)
    ids_of = Encoder(tokenizer_path())
    for _ in range(30):
        ids_of(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(10_000)))
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for part in (ids_of.known, ids_of.elder) for k, v in part.items())
    assert held < 34 << 20


def test_a_lean_task_gives_back_memory(monkeypatch):
    from weftline.llm import cluster

    calls = []
    monkeypatch.setattr(cluster, "give_back", lambda: calls.append(1))
    task = cluster.lean(lambda batches: (2 * b for b in batches))
    assert list(task(iter([1, 2]))) == [2, 4] and len(calls) == 1
    cut_short = task(iter([1, 2]))
    assert next(cut_short) == 2
    cut_short.close()
    assert len(calls) == 2


def test_words_are_looked_up_for_many_batches(monkeypatch):
    monkeypatch.setattr(token_files, "AT_ONCE", 3000)
    texts = ["alpha beta " * 20, "gamma alpha", None, "", "beta " * 900, "Delta, é"] * 3
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": pa.array([t], pa.string())}) for i, t in enumerate(texts)]
    together = list(token_files._together(iter(batches)))
    assert [t for b in together for t in b.column(1).to_pylist()] == texts and len(together) < 10
    assert all(b.nbytes <= 3000 or b.num_rows == 1 for b in together)
    own, asked = Encoder(tokenizer_path(), at_once=1 << 20), []
    chunks = own._chunks
    monkeypatch.setattr(own, "_chunks", lambda words: (asked.extend(words), chunks(words))[1])
    assert [np.frombuffer(x, "<u2").tolist() for x in own.many(pa.array(texts))] == [plain(t) for t in texts]
    assert asked.count("alpha") == 1 and own.known.keys() >= {"alpha", "beta", "gamma"}


def test_range_coder_at_the_ends_of_chances():
    """Blocks of one id, then of others at random: hits and misses where both are least expected; 16 and 32 bits."""
    rng = np.random.default_rng(6)
    for bits, most in ((16, 1 << 16), (32, 1 << 28)):
        blocks = [np.concatenate([np.full(n, most - 2), rng.integers(0, most - 1, 900 - n), np.full(3000, 7), [8] * 9]) for n in (800, 500, 1, 0)]
        coded = range_coder.encode(blocks, bits)
        assert all((a == b).all() for a, b in zip(range_coder.decode(coded, [len(b) for b in blocks], bits), blocks, strict=True))
        assert len(coded[0]) < 100 * bits // 8 + 700

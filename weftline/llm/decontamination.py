"""Benchmark decontamination by CGK embedding and bit-sampling LSH."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.cluster import cut, in_bounds, joined_small, lean, row_of, worker_turns_to
from weftline.llm.words import hashed_words, mixed

#: A passage is an item's if it can be turned into it by edits of at most this share of the item's words.
EDITS = 0.2
#: Longer items are cut into segments of so many words at most, each with its own windows. Of a passage within the
#: edits of an item, some segment is within its own.
SEGMENT = 64
#: Random walks, tables of each, and symbols sampled for a table; tests/llm/test_decontamination.py has the recall.
WALKS, TABLES, SAMPLED = 6, 24, 3
#: Bits of the two filters that all tasks hold: so many for each entry, but 2 to the 27 (16 MB) at most.
FILTER_BITS, MOST_BITS = 1024, 27
#: Bytes of texts held at once, and windows embedded at once.
TEXT_BYTES, WINDOWS = 1 << 20, 2048
#: Cells of edit tables filled at once.
CELLS = 1 << 19
#: Hits of one key that start so near each other are one.
NEAR = SEGMENT


def most_edits(n: int) -> int:
    return int(EDITS * n)


def gate_of(n: int) -> tuple[int, int]:
    """(words of a gram, grams): an item of n words shares at least so many of its grams with each of its passages.

    An edit takes `words` grams at most. The longest grams of up to three words that leave one are taken.
    """
    for words in (3, 2, 1):
        left = n - words + 1 - words * most_edits(n)
        if left > 0:
            return words, left
    raise ValueError("no words")


def _grams(h: np.ndarray, words: int) -> np.ndarray:
    out = np.full(max(0, len(h) - words + 1), words, np.uint64)
    for i in range(words):
        out = mixed(out * np.uint64(31) + h[i : i + len(out)])
    return out


def _of_size(grams: np.ndarray, n: int) -> np.ndarray:
    """Grams as those of a segment of n words."""
    return mixed(grams * np.uint64(31) + np.uint64(n))


def segments(n: int) -> list[tuple[int, int]]:
    """(first, end) of an item's segments, near equal."""
    parts = -(-n // SEGMENT)
    bounds = [n * i // parts for i in range(parts + 1)] if n else []
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def embedded(rows: np.ndarray, walk: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """CGK: at each step a row gives the symbol it stands on and goes on to the next one if a coin of step and symbol says so.

    Two rows walk alike on equal symbols; after an edit their places differ until chance brings them together
    again, so that the edit distance shows as a Hamming distance. Returns the symbols and the places, by step
    and row; a row of fewer words gives zero from its end on.
    """
    m, n = rows.shape
    flat, base = rows.reshape(-1), np.arange(m) * n
    at = np.zeros(m, np.int64)
    out, places = np.zeros((steps, m), np.uint64), np.zeros((steps, m), np.uint8)
    seeds = mixed(np.arange(1, steps + 1, dtype=np.uint64) + np.uint64(walk * 100_003))
    for j in range(steps):
        symbol = flat[base + np.minimum(at, n - 1)]
        symbol[at >= n] = 0
        out[j], places[j] = symbol, at
        at += (((symbol ^ seeds[j]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)
    return out, places


def sampled(n: int) -> np.ndarray:
    """Steps that each walk's tables look at, for windows of n words; at even odds a walk of 2n steps sees the whole."""
    return np.random.default_rng(n).integers(0, 2 * n, (WALKS, TABLES, SAMPLED))


def keys_of(rows: np.ndarray, sizes: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, keys) for each size n: a key of each walk and table for those of the rows that sizes names, as windows of n words."""
    longest = max(sizes)
    found = {n: np.empty((len(which), WALKS, TABLES), np.uint64) for n, which in sizes.items()}
    samples = {n: sampled(n) for n in sizes}
    for w in range(WALKS):
        walked, places = embedded(rows[:, :longest], w, 2 * longest)
        for n, which in sizes.items():
            h = np.broadcast_to(mixed(np.arange(w * TABLES, (w + 1) * TABLES, dtype=np.uint64) + np.uint64(n * 1_000_003)), (len(which), TABLES))
            for s in range(SAMPLED):
                steps = samples[n][w, :, s][None, :]
                symbol = np.where(places[steps, which[:, None]] < n, walked[steps, which[:, None]], np.uint64(0))
                h = mixed(h * np.uint64(31) + symbol)
            found[n][:, w] = h
    for n, keys in found.items():
        yield n, keys.reshape(len(keys), -1)


class Filter:
    """A set of hashes by their first bits: what it doesn't hold was never added."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - bits)
        whole = np.zeros(1 << (bits - 6), np.uint64)
        whole[words] = values
        self.bytes = whole.view(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _filter(hashes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits, words and values of the Filter of a column h; 2 to the MOST_BITS bits at most reach the driver."""
    n = hashes.count()
    bits = min(MOST_BITS, max(16, (n * FILTER_BITS).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(F.shiftrightunsigned(place, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    told = rows.toArrow()
    return bits, told.column("word").to_numpy(), told.column("bits").to_numpy().view(np.uint64)


class Windows:
    """What a task needs to find the windows of its texts that some item's keys meet."""

    def __init__(self, sizes: list[int], grams: tuple, keys: tuple):
        self.sizes = sizes
        self.gates = {n: gate_of(n) for n in sizes}
        self.grams, self.keys = Filter(*grams), Filter(*keys)

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, starts as words of all texts): windows of each size whose keys the filter holds; text i has words bounds[i] to bounds[i + 1]."""
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        if not len(h):
            return none
        ends = np.repeat(bounds[1:], np.diff(bounds))
        counts, members = {}, {}
        for words in {w for w, _ in self.gates.values()}:
            member = np.zeros(len(h) + 1, np.int64)
            g = _grams(h, words)
            member[1 : len(g) + 1] = self.grams.has(g) & (np.arange(len(g)) + words <= ends[: len(g)])
            counts[words] = np.cumsum(member)
            at = np.flatnonzero(member[1:])
            members[words] = at, g[at]
        # places from which the widest window of a gate has the fewest grams that any of its sizes needs
        likely = np.zeros(len(h), bool)
        place = np.arange(len(h))
        for words, total in counts.items():
            own = [n for n in self.sizes if self.gates[n][0] == words]
            reach = max(n + most_edits(n) for n in own) - words + 1
            likely |= total[np.minimum(place + reach, ends)] - total[:-1] >= min(self.gates[n][1] for n in own)
        place = place[likely]
        by_size = {}
        for n in self.sizes if len(place) else ():
            words, need = self.gates[n]
            at, grams = members[words]
            own = at[self.grams.has(_of_size(grams, n))]
            upto = np.minimum(place + n + most_edits(n), ends[place]) - words + 1
            which = np.flatnonzero(np.searchsorted(own, upto) - np.searchsorted(own, place) >= need)
            if len(which):
                by_size[n] = place[which]
        if not by_size:
            return none
        every = np.unique(np.concatenate(list(by_size.values())))
        longest = max(by_size)
        found_keys, found_starts = [], []
        for i in range(0, len(every), WINDOWS):
            part = every[i : i + WINDOWS]
            sizes = {}
            for n, starts in by_size.items():
                lo, hi = np.searchsorted(starts, [part[0], part[-1] + 1])
                if hi > lo:
                    sizes[n] = np.searchsorted(part, starts[lo:hi])
            spread = part[:, None] + np.arange(longest)
            rows = np.where(spread < ends[part][:, None], h[np.minimum(spread, len(h) - 1)], np.uint64(0))
            for n, keys in keys_of(rows, sizes):
                met = self.keys.has(keys.ravel()).reshape(keys.shape)
                r, c = np.nonzero(met)
                found_keys.append(keys[r, c])
                found_starts.append(part[sizes[n][r]])
        return np.concatenate(found_keys), np.concatenate(found_starts)


def hashed_parts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashed_words, where long texts go through it in parts that end between words."""
    if sum(map(len, texts)) <= 4 * TEXT_BYTES:
        return hashed_words(texts)
    hashes, starts, ends, bounds = [], [], [], [0]
    for t in texts:
        at = n = 0
        while at < len(t):
            upto = at + TEXT_BYTES
            while upto < len(t) and (t[upto] >= 128 or chr(t[upto]).isalnum()):
                upto += 1
            h, s, e, _ = hashed_words([t[at:upto]])
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
            n, at = n + len(h), upto
        bounds.append(bounds[-1] + n)
    one = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return one(hashes, np.uint64), one(starts, np.int64), one(ends, np.int64), np.array(bounds)


def nearest(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(edits, first, end) of the stretch of each text with the least edit distance to its item, the first of equals."""
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(items)
    order = sorted(range(len(items)), key=lambda i: -len(items[i]))
    at = 0
    while at < len(order):
        wide, upto = len(texts[order[at]]) + 1, at + 1
        while upto < len(order) and (upto - at + 1) * max(wide, len(texts[order[upto]]) + 1) <= CELLS:
            wide = max(wide, len(texts[order[upto]]) + 1)
            upto += 1
        own = order[at:upto]
        for i, told in zip(own, _nearest([items[i] for i in own], [texts[i] for i in own], wide), strict=True):
            out[i] = told
        at = upto
    return out


def _nearest(items: list[np.ndarray], texts: list[np.ndarray], wide: int) -> list[tuple[int, int, int]]:
    """nearest() for items in order of falling length, all at once, in tables of `wide` columns."""
    sizes = np.array([len(x) for x in items])
    text = np.zeros((len(texts), wide - 1), np.uint64)
    for i, t in enumerate(texts):
        text[i, : len(t)] = t
    steps = np.arange(wide, dtype=np.int32)
    row = np.zeros((len(items), wide), np.int32)
    begin = np.broadcast_to(steps, row.shape).copy()
    for j in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -j, "left"))  # items with a word j
        word = np.array([x[j] for x in items[:m]], np.uint64)[:, None]
        over = row[:m, :-1] + (text[:m] != word)
        new = row[:m] + 1
        diagonal = over < new[:, 1:]
        came = begin[:m].copy()
        came[:, 1:][diagonal] = begin[:m, :-1][diagonal]
        np.minimum(new[:, 1:], over, out=new[:, 1:])
        flat = new - steps
        low = np.minimum.accumulate(flat, axis=1)
        source = np.maximum.accumulate(np.where(flat == low, steps, 0), axis=1)
        row[:m] = low + steps
        begin[:m] = np.take_along_axis(came, source, axis=1)
    for i, t in enumerate(texts):
        row[i, len(t) + 1 :] = np.iinfo(np.int32).max
    ends = row.argmin(axis=1)
    return [(int(row[i, e]), int(begin[i, e]), int(e)) for i, e in enumerate(ends.tolist())]


def passages(h: np.ndarray, items: list[tuple[np.ndarray, list[tuple[int, int]]]]) -> Iterator[tuple[int, int, int, int]]:
    """(item, edits, first, end), words of a text with hashes h, from items' words and (least, greatest) places where each may start."""
    waiting = []
    for i, (words, spans) in enumerate(items):
        margin = most_edits(len(words)) + len(words) // 4 + 1
        merged: list[list[int]] = []
        for lo, hi in sorted(spans):
            lo, hi = max(0, lo - margin), min(len(h), hi + len(words) + margin)
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            elif lo < hi:
                merged.append([lo, hi])
        waiting += [(i, lo, hi) for lo, hi in merged]
    while waiting:
        told = nearest([items[i][0] for i, _, _ in waiting], [h[lo:hi] for _, lo, hi in waiting])
        more = []
        for (i, lo, hi), (edits, first, end) in zip(waiting, told, strict=True):
            n = len(items[i][0])
            if edits <= most_edits(n) and end > first:
                yield i, edits, lo + first, lo + end
                more += [(i, a, b) for a, b in ((lo, lo + first), (lo + end, hi)) if b - a >= max(1, n - most_edits(n))]
        waiting = more


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, words) and (item, at, size, keys, grams), a row a segment."""
    given = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [hashed_parts([t])[0].tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["item_id", "words"])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(raw, np.uint64)
                own = segments(len(words))
                by_size: dict[int, list[int]] = {}
                for i, (a, b) in enumerate(own):
                    by_size.setdefault(b - a, []).append(i)
                for n, which in by_size.items():
                    rows = np.array([words[own[i][0] : own[i][1]] for i in which])
                    _, keys = next(keys_of(rows, {n: np.arange(len(which))}))
                    grams = [np.concatenate([g := _grams(r, gate_of(n)[0]), _of_size(g, n)]).view(np.int64) for r in rows]
                    columns = [pa.array([item] * len(which), pa.int64()), pa.array([own[i][0] for i in which], pa.int32()), pa.array([n] * len(which), pa.int32())]
                    columns += [pa.array([k.view(np.int64).tolist() for k in keys], pa.list_(pa.int64())), pa.array([g.tolist() for g in grams], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "at", "size", "keys", "grams"])

    items = cut(given.mapInArrow(worded, "item_id long, words binary").where(F.octet_length("words") > 0).withColumn("item", F.monotonically_increasing_id()))  # written once, so the numbers stay
    return items, cut(items.select("item", "words").mapInArrow(indexed, "item long, at int, size int, keys array<long>, grams array<long>"))


def found(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Passages of benchmark items in documents: doc_id, text_hash, item_id, edits, item_words, start_byte, end_byte.

    A passage counts if its words (A-Z lower-cased, marks and white space dropped) are an item's after edits of
    up to EDITS of the item's words; items of under five words are found as they are. All passages of an item
    are told that do not overlap a better one. Candidates are item-sized windows whose CGK embeddings meet an
    item's in a sampled table; each is verified by exact edit distance.

    Null texts and texts without words hold nothing, and items without words are not looked for; equal rows each
    give rows; null ids stay null; empty tables give no rows; other columns are ignored.

    Plan: one pass over the texts gives their windows' keys, of those keys that some item may have. A window is
    passed over if it and the words that edits may add hold fewer word grams of items of its size than each of
    those leaves (gate_of), so that nothing is lost by that. Keys meet those of the items in a join, and
    the texts with hits, a row each, are verified beside the items that they met. The driver and all tasks hold
    two filters of 16 MB at most, whatever the benchmark's size, and the at most SEGMENT sizes of segments.
    """
    spark = docs.sparkSession
    in_bounds(spark)
    items, parts = _items(benchmark, item_col, item_text_col)
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect())  # SEGMENT at most
    schema = "doc_id long, text_hash long, item_id long, edits int, item_words int, start_byte long, end_byte long"
    if not sizes:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((sizes, _filter(parts.select(F.explode("grams").alias("h"))), _filter(parts.select(F.explode("keys").alias("h")))))
    own = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(own).alias("text_hash"), own.cast("binary").alias("text"))

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turns_to("decontamination")
        windows = None
        for batch in batches:
            windows = windows or Windows(*sent.value)
            for at, texts in _held(batch.column(2)):
                h, _, _, bounds = hashed_parts(texts)
                keys, starts = windows.hits(h, bounds)
                if not len(keys):
                    continue
                text = np.searchsorted(bounds, starts, "right") - 1
                order = np.lexsort((starts, keys, text))
                text, keys, starts = text[order], keys[order], starts[order]
                new = np.ones(len(keys), bool)
                new[1:] = (text[1:] != text[:-1]) | (keys[1:] != keys[:-1]) | (starts[1:] - starts[:-1] > NEAR)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(keys)) - 1
                text, keys, lo, hi = text[first], keys[first], starts[first], starts[last]
                some, offsets = np.unique(text, return_index=True)
                offsets = pa.array(np.append(offsets, len(text)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys.view(np.int64), lo - bounds[text], hi - bounds[text])]
                rows = pa.array(at + some)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), *lists], ["doc_id", "text_hash", "text", "keys", "lo", "hi"])

    suspects = given.mapInArrow(lean(windowed), "doc_id long, text_hash long, text binary, keys array<long>, lo array<long>, hi array<long>")
    suspects = cut(suspects).withColumn("row", F.monotonically_increasing_id())
    asked = suspects.select("row", F.explode(F.arrays_zip("keys", "lo", "hi")).alias("w")).select("row", F.col("w.keys").alias("key"), "w.lo", "w.hi")
    had = parts.select("item", "at", F.explode("keys").alias("key"))
    met = asked.join(had, "key").select("row", "item", F.struct((F.col("lo") - F.col("at")).alias("lo"), (F.col("hi") - F.col("at")).alias("hi")).alias("span"))
    met = met.groupBy("row", "item").agg(F.collect_set("span").alias("spans")).join(items, "item")
    met = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item_id", "words", "spans"))).alias("items"))
    beside = suspects.select("row", "doc_id", "text_hash", "text").join(met, "row").select("doc_id", "text_hash", "text", "items")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turns_to("decontamination")
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                h, starts, ends, _ = hashed_parts([batch.column(2)[i].as_py()])
                its = batch.column(3)[i].as_py()
                asked = [(np.frombuffer(x["words"], np.uint64), [(s["lo"], s["hi"]) for s in x["spans"]]) for x in its]
                for k, edits, first, end in sorted(passages(h, asked)):
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), its[k]["item_id"], edits, len(asked[k][0]), int(starts[first]), int(ends[end - 1])))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "text_hash", "item_id", "edits", "item_words", "start_byte", "end_byte"])

    return beside.mapInArrow(lean(verified), schema)


def _held(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of about TEXT_BYTES."""
    sizes = np.cumsum([len(t.as_buffer()) for t in texts])
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield at, texts.slice(at, upto - at).to_pylist()
        at = upto


def _same(own: Column, hashed: Column) -> list[Column]:
    return [own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("own"), hashed.alias("hashed")]


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item's passage; all their columns stay, whatever their names."""
    dirty = cut(found(docs, benchmark, id_col, text_col).select(*_same(F.col("doc_id"), F.col("text_hash"))).distinct())
    rows = docs.select(row_of(docs).alias("row"), *_same(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    return joined_small(rows, dirty, ["none", "own", "hashed"], "left_anti").select("row.*")

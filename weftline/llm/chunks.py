"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.cluster import cut, in_bounds, lean, row_of, worker_turns_to

#: A chunk starts at the word with the smallest gear hash of any REACH words in a row, so has REACH words at most.
REACH = 11
#: What is compared are the shortest runs of whole chunks with this many words, or so many as are asked for. A passage
#: that stands twice surely has such a run if it has MIN_WORDS + 2 * REACH words after its first WINDOW bytes.
MIN_WORDS = 14
#: Bytes that the gear hash of a place takes in.
WINDOW = 8
#: Texts handled at once: up to so many bytes.
AT_ONCE = 1 << 20

_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
_GEAR[0] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, sum of gear[b] << age over it and the 7 bytes before, modulo 2 to the 32."""
    h = _GEAR[data]
    for n in (1, 2, 4):
        older = h[:-n] << np.uint32(n)
        h = h.copy()
        h[n:] += older
    return h


def stretches(texts: list[bytes], least_words: int = MIN_WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the first bytes and the ends of its runs of chunks with least_words."""
    pad = bytes(WINDOW)
    joined = pad + pad.join(texts) + pad
    data = np.frombuffer(joined, np.uint8)
    first = np.cumsum([WINDOW] + [len(t) + WINDOW for t in texts[:-1]])
    last = first + np.array([len(t) for t in texts])
    space = _SPACE[data]
    doc = np.zeros(len(data) + 1, np.int8)
    np.add.at(doc, first, 1)
    np.add.at(doc, last, -1)
    word = (np.cumsum(doc[:-1]) > 0) & ~space
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    # texts never touch, so that words don't run over from one to the next
    of = np.searchsorted(first, starts, "right") - 1
    n = len(starts)
    empty = np.empty(0, np.int64)
    if n < REACH:
        cuts = empty
    else:
        hashed = gear(data)[starts - 1].astype(np.uint64)  # of what stands before the word
        least = (hashed << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        have = 1
        while 2 * have <= REACH:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < REACH:
            least = np.minimum(least[: len(least) - (REACH - have)], least[REACH - have :])
        whole = of[: n - REACH + 1] == of[REACH - 1 :]
        cuts = np.unique((least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))  # words before each text
    cuts = np.union1d(cuts, bounds)
    to = np.searchsorted(cuts, cuts + least_words)
    fits = to < len(cuts)
    a, b = cuts[fits], cuts[to[fits]]
    inside = (a < n) & (b <= n)
    a, b = a[inside], b[inside]
    long = np.flatnonzero(np.diff(bounds) >= least_words)
    ends_at = bounds[long + 1]  # the run that ends a text, for the shortest ones may stop before
    a, b = np.append(a, cuts[np.searchsorted(cuts, ends_at - least_words, "right") - 1]), np.append(b, ends_at)
    a, b = np.unique(np.stack([a, b]), axis=1)
    same = of[np.minimum(a, n - 1)] == of[np.maximum(b, 1) - 1] if n else a < 0
    a, b = a[same], b[same]
    owner = of[a] if n else empty
    shift = first[owner] if n else empty
    s, e = starts[a] - shift, ends[b - 1] - shift
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(s[i:j], e[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """who (the doc_id, or for a null one a negative hash of the text) and text_hash."""
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return [F.coalesce(F.col(id_col).cast("long"), _unnamed(hashed)).alias("who"), hashed.alias("text_hash")]


def _unnamed(hashed: Column) -> Column:
    return hashed.bitwiseOR(F.lit(-(1 << 63)))


def _chunked(batches: Iterator[pa.RecordBatch], least_words: int = MIN_WORDS) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray, np.ndarray]]:
    """Parts of batches (who, text_hash, text), their texts' runs, and all runs' digests as two columns of integers."""
    import xxhash

    worker_turns_to("chunks")
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        at = 0
        sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
        while at < batch.num_rows:
            upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right"))
            part = batch.slice(at, max(1, upto - at))
            at += part.num_rows
            texts = part.column(2).to_pylist()
            found = stretches(texts, least_words)
            digests = np.frombuffer(b"".join([digest(t[i:j]) for t, (s, e) in zip(texts, found, strict=True) for i, j in zip(s.tolist(), e.tolist(), strict=True)]), "<i8")
            yield part, found, np.ascontiguousarray(digests[0::2]), np.ascontiguousarray(digests[1::2])


def _firsts_in(text: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each run the place among all of the first one in its text with its digest."""
    if not len(text):
        return np.empty(0, np.int64)
    order = np.lexsort((low, high, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]  # lexsort is stable, so the first of equals leads
    return out


def _flat(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all runs in a row."""
    return np.repeat(np.arange(len(found)), [len(s) for s, _ in found]), *(np.concatenate([f[k] for f in found]) for k in (0, 1))


def _met(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(who, text_hash, spans) of the texts with stretches that stand elsewhere before."""
    in_bounds(docs.sparkSession)
    given = docs.select(*_key(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, high, low in _chunked(batches, least_words):
            text, _, _ = _flat(found)
            own = np.flatnonzero(_firsts_in(text, high, low) == np.arange(len(text)))  # each digest of a text once
            yield pa.RecordBatch.from_arrays([pa.array(high[own]), pa.array(low[own]), part.column(0).take(pa.array(text[own]))], ["high", "low", "who"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, high, low in _chunked(batches, least_words):
            text, start, end = _flat(found)
            again = start >= end[_firsts_in(text, high, low)]  # not what overlaps the first one
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(high), pa.array(low), pa.array((start << 32) | end), pa.array(again)], ["who", "text_hash", "high", "low", "place", "again"])

    sums = given.mapInArrow(lean(summed), "high long, low long, who long")
    firsts = sums.groupBy("high", "low").agg(F.min("who").alias("first"), F.max("who").alias("last"))
    firsts = cut(firsts.where("first <> last").drop("last"))
    places = given.mapInArrow(lean(placed), "who long, text_hash long, high long, low long, place long, again boolean")
    met = places.join(firsts, ["high", "low"], "left").withColumn("elsewhere", F.coalesce(F.col("first") != F.col("who"), F.lit(False)))
    met = met.where("elsewhere or again").withColumn("kept_in", F.when(F.col("elsewhere"), F.col("first")).otherwise(F.col("who")))
    span = F.struct(F.shiftright("place", 32).cast("int").alias("start"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end"), F.col("kept_in"))
    return met.groupBy("who", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("spans"))  # equal rows have equal spans


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = MIN_WORDS) -> DataFrame:
    """Stretches of text that an earlier document, or the same one before, has too, as (doc_id, text_hash, spans).

    spans are (start, end, kept_in), bytes of the UTF-8 text (32 bits, as long as Spark's texts can be) and the
    doc_id of the first document that has the stretch, which keeps it where it stands first. The stretches are the
    shortest runs of content-defined chunks with least_words words; equal ones are found by 128-bit digests. Every passage of
    least_words + 2 * REACH words after its first WINDOW bytes that stands in two places byte for byte is found,
    wherever they are; of what overlaps itself the first stretch stays. Rows with equal doc_id are one document, and so are rows
    without a doc_id that have equal texts; these come first, with a negative hash for kept_in. Null texts are
    empty; texts of fewer words have no stretch; an empty table gives no rows; other columns are ignored.

    Plan: whole texts are chunked twice and no list of chunks is written: once for the first and last document of
    each digest, combined before their exchange, of which those in more than one are written to the shared folder;
    and once for the places, which one join brings to their first document.
    """
    null = F.col("who") == _unnamed(F.col("text_hash"))
    return _met(docs, id_col, text_col, least_words).select(F.when(~null, F.col("who")).alias("doc_id"), "text_hash", "spans")


def merged(spans: Column) -> Column:
    """Sorted spans (start, end, kept_in) as the fewest that cover the same bytes: (start, end, kept_in list)."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(s["kept_in"]).alias("kept_in"))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.array_union(last["kept_in"], F.array(s["kept_in"])).alias("kept_in"))
        touches = (F.size(done) > 0) & (s["start"] <= F.coalesce(last["end"], F.lit(-1)))
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(own)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<start:int,end:int,kept_in:array<bigint>>>)"), add)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated stretches cut out of the text; documents of which nothing but white space is left go.

    All columns stay as they are but the text. A text that loses nothing is left as it is, null and empty too.
    """
    spans = _met(docs, id_col, text_col, least_words).select("who", "text_hash", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    own = docs.select(row_of(docs).alias("row"), *_key(docs, id_col, text_col))
    told = own.join(spans, ["who", "text_hash"], "left")

    @F.pandas_udf("string")
    def left(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans, strict=True):
            if t is None or found is None:
                out.append(None)
                continue
            raw, kept, at = t.encode(), [], 0
            for s in found:
                if s["start"] > at:
                    kept.append(raw[at : s["start"]])
                at = max(at, s["end"])
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    hit = F.col("spans").isNotNull()
    text = F.col("row").getField(text_col)
    told = told.select("row", "spans", left(F.when(hit, text), F.col("spans")).alias("left")).where(~hit | F.col("left").rlike(r"\S"))
    return told.select(*(F.when(hit, F.col("left")).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))

"""Language identification by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.cluster import in_bounds, lean, row_of, worker_turns_to

#: Lengths of the n-grams, and bits of the places they are hashed to: so many, or fewer for more than 128 languages,
#: so that places times languages, the weights, keep to 2 to the CELL_BITS.
ORDERS = (1, 2, 3, 4)
BITS, CELL_BITS = 17, 24
#: The bound on what weights are learned from: about so many documents of each language, those whose hashes are
#: smallest, or fewer of each so that there are about SAMPLE at most; and of the languages those with the most documents.
PER_LANGUAGE, SAMPLE, MAX_LANGUAGES = 1000, 1 << 18, 1 << 13
#: Of these every so many-th, by a hash, is for the temperature alone.
CALIBRATION = 5
#: Follow-the-regularised-leader: step size, its smoothing, and the penalties (times 1 / documents) on |w| and w^2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-5, 1e-6
EPOCHS = 4
#: Characters of texts handled at once.
AT_ONCE = 1 << 18


def bits_for(languages: int) -> int:
    return min(BITS, CELL_BITS - max(0, languages - 1).bit_length())


_LETTERS = np.array([i if chr(i).isalpha() else 32 for i in range(128)], np.uint32)


def hashed_grams(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """Places of a whole text's n-grams, part by part and length by length.

    The text is lower-cased, ASCII digits and marks are spaces, and a space is put on each side.
    """
    every = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(every), AT_ONCE):
        part = every[at : at + AT_ONCE + max(ORDERS) - 1]
        part = np.where(part < 128, _LETTERS[part & 127], part)
        for n in ORDERS:
            c = part[: AT_ONCE + n - 1]
            if len(c) < n:
                break
            h = np.full(len(c) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def counted(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The places of a whole text's n-grams and how often each occurs, as a share of all."""
    found = [np.unique(grams, return_counts=True) for grams in hashed_grams(text, bits)]
    places, counts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    own, at = np.unique(places, return_inverse=True)
    return own.astype(np.int32), (np.bincount(at, counts, len(own)) / counts.sum()).astype(np.float32)


@dataclass
class Model:
    """weights (places x languages) already times the places' idf, and the temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int = BITS

    def probabilities(self, places: np.ndarray, shares: np.ndarray) -> np.ndarray:
        z = (shares @ self.weights[places] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def fitted(rows: list[tuple[str, bool, np.ndarray, np.ndarray]], having: np.ndarray, documents: int) -> Model:
    """From rows (language, for calibration, places, shares), in a fixed order, and how many of all documents have each place."""
    languages = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    train = [r for r in rows if not r[1]] or rows
    rest = [r for r in rows if r[1]] or rows
    size, k = len(having), len(languages)
    idf = (np.log((1 + documents) / (1 + having)) + 1).astype(np.float64)
    z, n = np.zeros((size, k)), np.zeros((size, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            language, _, places, shares = train[i]
            x = shares * idf[places] * SCALE
            w, b = weights(z[places], n[places], L1), weights(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[number[language]] -= 1
            g = x[:, None] * p
            own = n[places]
            z[places] += g - (np.sqrt(own + g * g) - np.sqrt(own)) / ALPHA * w
            n[places] = own + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * b
            nb += p * p
    w = weights(z, n, L1) * idf[:, None] * SCALE
    model = Model(languages, w.astype(np.float32), weights(zb, nb, 0.0).astype(np.float32), 1.0, size.bit_length() - 1)
    scores = np.array([shares @ model.weights[places] + model.bias for _, _, places, shares in rest])
    right = np.array([number[r[0]] for r in rest])

    def loss(t: float) -> float:
        s = scores / t
        top = s.max(1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(1)) + top[:, 0] - s[np.arange(len(s)), right]).mean())

    tries = np.geomspace(0.05, 20, 241)  # the loss has one low in log temperature
    model.temperature = float(tries[int(np.argmin([loss(t) for t in tries]))])
    return model


#: Shares of n-grams are small; this brings a text's features to the order of one.
SCALE = 30.0


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None) -> Model | None:
    """A model from docs with a language, of those that are usable; None if there are none.

    What comes to the driver is bounded: the numbers of documents of MAX_LANGUAGES languages, about PER_LANGUAGE
    documents of each or SAMPLE in all, as sparse rows, and for 2^BITS places at most how many documents have
    each, which is counted over all usable documents, whole.
    """
    in_bounds(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), (usable if usable is not None else F.lit(True)).alias("usable"))
    rows = rows.where("usable and lang is not null and text is not null").select("id", "text", "lang")
    largest = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    counts = {r["lang"]: r["n"] for r in largest}
    if not counts:
        return None
    bits, per = bits_for(len(counts)), max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    having, documents = frequencies(rows, bits)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, per / n)) for lang, n in counts.items()], "lang string, share double")
    hashed = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 30))
    taken = rows.join(F.broadcast(shares), "lang").where(hashed < F.col("share") * (1 << 30)).select("id", "text", "lang").withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(CALIBRATION)) == 0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turns_to("language")
        for batch in batches:
            found = [counted(t, bits) for t in batch.column(1).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([p.tobytes() for p, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["id", "lang", "calibrates", "places", "shares"])

    sparse = taken.mapInArrow(lean(features), "id string, lang string, calibrates boolean, places binary, shares binary").collect()
    sparse.sort(key=lambda r: (r["id"] or "", r["lang"], bytes(r["places"]), bytes(r["shares"])))
    return fitted([(r["lang"], r["calibrates"], np.frombuffer(r["places"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in sparse], having, documents)


def frequencies(rows: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """How many of the texts have each place, and how many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turns_to("language")
        having, n = np.zeros((1 << bits) + 1, np.int64), 0  # the last counts texts
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for grams in hashed_grams(text, bits):
                    seen[grams] = True
                own = np.flatnonzero(seen)
                having[own] += 1
                seen[own] = False
                n += 1
        having[-1] = n
        some = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(having[some])], ["place", "n"])

    found = rows.select("text").mapInArrow(lean(count), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    having = np.zeros((1 << bits) + 1, np.int64)
    having[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return having[:-1].astype(float), int(having[-1])


def predicted(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all of docs' unless named), lang_pred and lang_score (replaced if there) for every whole text.

    A null text or one without a letter is `und` with score 0, and so is every text if there is no model.
    The score is the calibrated probability of the language predicted. Texts of any length are read whole; an
    empty table gives no rows; only the text is looked at.
    """
    in_bounds(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^17 places at most

    @F.pandas_udf("lang_pred string, lang_score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        worker_turns_to("language")
        model, langs, scores = sent.value, [], []
        for text in texts:
            if text is None or model is None:
                langs.append("und")
                scores.append(0.0)
                continue
            total, n = np.zeros(len(model.languages)), 0
            for grams in hashed_grams(text, model.bits):
                total += np.ones(len(grams), np.float32) @ model.weights.take(grams, axis=0)
                n += len(grams)
            z = (total / n + model.bias) / model.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            langs.append(model.languages[best])
            scores.append(float(p[best]))
        return pd.DataFrame({"lang_pred": langs, "lang_score": scores})

    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score")]
    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    told = docs.select(row_of(docs, keep).alias("row"), predict(lettered).alias("told"))
    return told.select("row.*", "told.lang_pred", "told.lang_score")


def not_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(True))

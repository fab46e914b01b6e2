"""Language identification against plain versions of its learner and its scorer."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import language


def plain_places(text, bits):
    """Places of a text's n-grams, one by one."""
    chars = [ord(c) if ord(c) >= 128 or c.isalpha() else 32 for c in f" {text.lower()} "]
    out = []
    for n in language.ORDERS:
        for i in range(len(chars) - n + 1):
            h = n * 0x9E3779B1 % 2**32
            for c in chars[i : i + n]:
                h = (h ^ c) * 0x01000193 % 2**32
            h ^= h >> 15
            out.append(h * 0x85EBCA6B % 2**32 >> (32 - bits))
    return out


def corpus(n=60):
    rng = random.Random(3)
    words = {"en": "the of and house with night".split(), "de": "der und die haus mit nacht".split(), "fr": "le et la maison avec nuit".split()}
    return [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(2, 9))), lang) for i in range(n) for lang in [rng.choice(sorted(words))]]


def plain_ftrl(rows, having, documents):
    """Follow-the-regularised-leader with dicts, a coordinate at a time."""
    languages = sorted({r[0] for r in rows})
    idf = [math.log((1 + documents) / (1 + h)) + 1 for h in having]
    z, n, zb, nb = {}, {}, [0.0] * len(languages), [0.0] * len(languages)

    def weight(z, n, l1):
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((language.BETA + math.sqrt(n)) / language.ALPHA + language.L2)

    train = [r for r in rows if not r[1]]
    rng = np.random.default_rng(7)
    for _ in range(language.EPOCHS):
        for i in rng.permutation(len(train)):
            lang, _, places, shares = train[i]
            x = {int(p): float(s) * idf[p] * language.SCALE for p, s in zip(places, shares)}
            w = {(p, k): weight(z.get((p, k), 0.0), n.get((p, k), 0.0), language.L1) for p in x for k in range(len(languages))}
            b = [weight(zb[k], nb[k], 0.0) for k in range(len(languages))]
            s = [sum(x[p] * w[p, k] for p in x) + b[k] for k in range(len(languages))]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(len(languages)):
                d = e[k] / sum(e) - (languages[k] == lang)
                for p in x:
                    g, had = x[p] * d, n.get((p, k), 0.0)
                    z[p, k] = z.get((p, k), 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / language.ALPHA * w[p, k]
                    n[p, k] = had + g * g
                zb[k] += d - (math.sqrt(nb[k] + d * d) - math.sqrt(nb[k])) / language.ALPHA * b[k]
                nb[k] += d * d
    out = np.zeros((len(having), len(languages)))
    for (p, k), v in z.items():
        out[p, k] = weight(v, n[p, k], language.L1) * idf[p] * language.SCALE
    return out, [weight(zb[k], nb[k], 0.0) for k in range(len(languages))]


def test_learner_is_plain_ftrl():
    bits = 9
    rows = [(lang, i % 5 == 0, *language.counted(text, bits)) for i, text, lang in corpus()]
    having = np.zeros(1 << bits)
    for _, text, _ in corpus():
        having[list(set(plain_places(text, bits)))] += 1
    model = language.fitted(rows, having, 60)
    weights, bias = plain_ftrl(rows, having, 60)
    assert np.allclose(model.weights, weights, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-5) and model.bits == bits


def test_grams_and_shares_are_plain():
    for text in ("Der Hund; 12 \u00e9t\u00e9", "", "a", "\u65e5\u672c x"):
        places, shares = language.counted(text, 12)
        plain = plain_places(text, 12)
        assert places.tolist() == sorted(set(plain)) and np.allclose(shares, [plain.count(p) / len(plain) for p in places], atol=1e-6)


def test_frequencies_cover_all_rows(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    having, n = language.frequencies(df.repartition(5), 12)
    want = np.zeros(1 << 12)
    for _, text, _ in corpus():
        want[list(set(plain_places(text, 12)))] += 1
    assert n == 60 and (having == want).all()


def test_scores_are_plain(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = language.learned(df)
    got = {r["doc_id"]: r for r in language.predicted(df, model).collect()}
    for i, text, _ in corpus():
        places = plain_places(text, model.bits)
        z = (sum(model.weights[p].astype(float) for p in places) / len(places) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang_pred"] == model.languages[int(p.argmax())] and abs(got[i]["lang_score"] - p.max()) < 1e-4


def test_more_languages_than_five_hundred(spark):
    assert language.bits_for(2) == language.bits_for(128) == 17 and language.bits_for(129) == 16 and language.bits_for(8192) == 11
    df = spark.range(1400).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.sha2((F.col("id") % 700).cast("string"), 256)).alias("text"), F.concat(F.lit("l"), (F.col("id") % 700).cast("string")).alias("lang"))
    model = language.learned(df)
    assert len(model.languages) > 512 and model.weights.shape == (1 << language.bits_for(700), len(model.languages))
    assert language.predicted(df.limit(5), model).count() == 5

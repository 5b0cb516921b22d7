"""Language ID: n-grams, training steps and calibration against plain Python."""
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sigspark.llm import langid
from sigspark.llm.text import mix64

TEXTS = ["", None, "!!!", "a", "Ab c", "über 12 straße -- Ünï", "日本 語の x", "  lead and trail ", "word " * 400, "é" * 700, "x1y2z3"]


def plain_grams(text, settings):
    """(letters, sorted hashed n-grams) by the definition: letters stay, runs of others behind a letter become a blank."""
    chars, letters = [], 0
    for c in pa.compute.utf8_lower(pa.scalar(text or "")).as_py():
        if c.isalpha():
            chars.append(ord(c))
            letters += 1
        elif chars and chars[-1] != 32:
            chars.append(32)
    out = []
    for n in range(1, settings.max_n + 1):
        for i in range(len(chars) - n + 1):
            value = 0
            for c in chars[i: i + n]:
                value = (value * 0x110001 + c + 1) % (1 << 64)
            out.append(int(mix64(np.array([(value * 8 + n) % (1 << 64)], np.uint64))[0] % np.uint64(settings.buckets)))
    return letters, sorted(out)


def test_grams_by_definition_whatever_the_pieces():
    s = langid.Settings()
    want = [plain_grams(t, s) for t in TEXTS]
    for limit in (1, 3, 7, 64, 1 << 20):
        got, letters = [[] for _ in TEXTS], [0] * len(TEXTS)
        for p in langid._grams(pa.array(TEXTS, pa.string()), s, limit):
            for i in range(len(p.letters)):
                got[p.first + i] += p.flat[p.off[i]: p.off[i + 1]].tolist()
                letters[p.first + i] += int(p.letters[i])
        assert [(n, sorted(g)) for n, g in zip(letters, got)] == want


def test_memory_of_one_very_long_text():
    column = pa.array([("the whole of it " * (30 << 16))])                 # 30 MB
    tracemalloc.start()
    total = sum(len(p.flat) for p in langid._grams(column, langid.Settings()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 80_000_000 and peak < 64 << 20


def test_long_texts_count_as_one_document(spark):
    s = langid.Settings(buckets=1 << 10, parts=1)
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "key long, text string, lang string").coalesce(1)
    whole = langid.document_frequencies(docs, s)
    df = Counter(g for t in TEXTS for g in set(plain_grams(t, s)[1]))
    assert whole[0] == len(TEXTS) and {i: int(v) for i, v in enumerate(whole[1]) if v} == df


def test_training_and_temperature_against_plain_python(spark):
    rnd = random.Random(1)
    words = {"en": "the of and with that have", "fr": "le de et avec que dans", "xx": "zu qa wy"}
    rows = [(i, " ".join(rnd.choice(words[lang].split()) for _ in range(rnd.randint(1, 9))), lang)
            for i, lang in enumerate(rnd.choice(sorted(words)) for _ in range(120))]
    rows += [(None, "the", "en"), (500, "le", None), (501, None, "en"), (502, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = langid.Settings(buckets=1 << 10, parts=1, epochs=2, sample_docs=10_000)
    model = langid.train(docs, settings=s)
    known = docs.filter("lang is not null and doc_id is not null").withColumn(
        "part", F.floor(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * 2).cast("int")).collect()
    classes = sorted({r.lang for r in known})
    df = Counter(g for r in known for g in set(plain_grams(r.text, s)[1]))
    idf = [math.log((len(known) + 1) / (df[b] + 1)) + 1 for b in range(s.buckets)]
    z = [[0.0] * 3 for _ in range(s.buckets + 1)]
    n = [[0.0] * 3 for _ in range(s.buckets + 1)]

    def weight(i, c):
        if abs(z[i][c]) <= s.l1:
            return 0.0
        return -(z[i][c] - math.copysign(s.l1, z[i][c])) / ((s.beta + math.sqrt(n[i][c])) / s.alpha + s.l2)

    def features(text):
        grams = plain_grams(text, s)[1]
        return {g: np.float32(k / max(1, len(grams))) for g, k in sorted(Counter(grams).items())}

    train = [(features(r.text), classes.index(r.lang)) for r in known if r.part == 0]
    train.sort(key=lambda r: (zlib.crc32(np.array(list(r[0]), "<i4").tobytes())))
    for _ in range(s.epochs):
        for x, label in train:
            x = {**{i: float(v) * idf[i] * s.scale for i, v in x.items()}, s.buckets: 1.0}
            w = {i: [weight(i, c) for c in range(3)] for i in x}
            logit = [sum(x[i] * w[i][c] for i in x) for c in range(3)]
            e = [math.exp(v - max(logit)) for v in logit]
            for i, v in x.items():
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == label))
                    z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / s.alpha * w[i][c]
                    n[i][c] += g * g
        z = [[float(np.float32(v)) for v in r] for r in z]                  # states travel as 32-bit numbers
        n = [[float(np.float32(v)) for v in r] for r in n]
    want = np.array([[weight(i, c) * idf[i] * s.scale for c in range(3)] for i in range(s.buckets)])
    assert np.allclose(model.weights, want, rtol=2e-3, atol=5e-3) and np.count_nonzero(model.weights) < model.weights.size
    left = [(features(r.text), classes.index(r.lang)) for r in known if r.part == 1]
    grid = np.geomspace(0.05, 20.0, 121)

    def loss(t):
        total = 0.0
        for x, label in left:
            v = (sum((float(f) * model.weights[i] for i, f in x.items()), np.zeros(3)) + model.bias) / t
            total -= v[label] - v.max() - math.log(np.exp(v - v.max()).sum())
        return total
    assert loss(model.temperature) <= min(loss(t) for t in grid) + 1e-6

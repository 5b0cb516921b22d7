"""Ranked search against brute force: every interval bound, ties, odd rows, long texts."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sigspark.llm import ranked_search as rs

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def plain(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 20 * m))
                        for w in set(words(text)) if c[w])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, "x", 1.0, i) for i, t in docs], "doc_id long, text string, term string, score double, doc long").repartition(4)
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in rs.search(d, q, k).select("item", "rank", "doc", "score").collect()), key=repr)


def corpus(n, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Über", "日本", "x́y", "A1"]
    weight = [1 / (i + 1) for i in range(len(vocab))]
    return [(i * 3 + 1, rnd.choice(" _-.").join(rnd.choices(vocab, weight, k=rnd.randint(0, 40)))) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    docs = corpus(400)
    items = [(i, t) for i, (_, t) in enumerate(corpus(12, 9))] + [(100, "w0"), (101, "none here"), (102, "Über W3 w3"), (103, "...")]
    for k in (1, 10, 1000):
        assert found(spark, docs, items, k) == plain(docs, items, k)
    monkeypatch.setattr(rs, "ITEMS_AT_ONCE", 5)                              # several passes
    assert found(spark, docs, items, 7) == plain(docs, items, 7)


def test_ties_copies_and_odd_rows(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    rows += [(i, "same words here") for i in range(5000, 5300)] + [(None, "same words here"), (7000, "same words here and more")]
    random.Random(2).shuffle(rows)
    items = [(1, "same words"), (1, "same words"), (None, "alpha the"), (3, None), (4, ""), (5, "alpha one A1 aaaa 日本語の長い文章が続く")]
    assert found(spark, rows, items, 50) == plain(rows, items, 50)
    assert found(spark, [], items, 5) == [] and found(spark, rows, [], 5) == []
    assert found(spark, [(1, None), (2, "!!")], items, 5) == []


@pytest.mark.parametrize("limit", [1, 3, 10, 1000])
def test_long_texts_in_pieces(limit):
    texts = ["the cat", "", "a" * 50 + " the " + "b" * 9, "cat theé the-THE", "x" * 33, "the" * 11 + " the"]
    buf, off = rs.column_buffer(rs.pa.array(texts))
    asked, longest = rs.terms_of(["the cat theé"])
    vocab = {int(rs.terms_of([w])[0][0][0]): w for w in ("the", "cat", "theé")}
    n, seen = [0] * len(texts), [Counter() for _ in texts]
    for row, count, of, hashes in rs._words(buf, off, longest, limit):
        for i, c in enumerate(count):
            n[row + i] += int(c)
        for i, h in zip(of, hashes):
            if int(h) in vocab:
                seen[row + i][vocab[int(h)]] += 1
    assert n == [len(words(t)) for t in texts]
    assert seen == [Counter(w for w in words(t) if w in vocab.values()) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_range_maxima_and_search_of_one_block(seed):
    rnd = np.random.default_rng(seed)
    n, terms = 300, 9
    dense = rnd.integers(0, 50, size=(terms, n)) * (rnd.random((terms, n)) < rnd.random((terms, 1)))
    term, at = np.nonzero(dense)
    lists = rs.PostingLists(np.arange(n) * 2, term, at, dense[term, at])
    for t in range(terms):
        mine = np.flatnonzero(term == t)
        for a in mine[::7]:
            for b in mine[mine >= a][::5]:
                value, place = lists.highest(np.array([a]), np.array([b + 1]))
                assert value[0] == dense[t][at[a: b + 1]].max() and lists.impact[place[0]] == value[0]
    asked = np.array([0, 2, 3, 7])
    scores, ids = lists.search(asked, np.zeros(0, np.int64), np.zeros(0, np.int64), 20)
    total = dense[asked].sum(axis=0)
    want = np.lexsort((np.arange(n), -total))[:20]
    assert ids.tolist() == (want * 2).tolist() and scores.tolist() == total[want].tolist()

"""Top-k, near duplicates, suffix dedup and n-gram scores against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.llm import near_dedup, ngram_lm, suffix_dedup, topk
from sigspark.llm.frames import crc_mod

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute_top_k(rows, k):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
               if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ((i, v) for i, v in vectors if i % 3 == 0):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("pivots, block", [(1, 4096), (7, 5), (64, 10)])
def test_top_k(spark, pivots, block):
    rnd = random.Random(pivots)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(80)]                       # one very common vector
    rows += [(300, None), (303, [None] * 6), (306, [math.nan] * 6), (309, [math.inf] * 6), (None, [1.0] * 6), (312, [])]
    rows += [(315, [1e5, -1e5, 3e5, 2e5, 1e5, -3e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x"))
    got = topk.top_k(df.repartition(4), F.col("vec_id") % 3 == 0, k=10, pivots=pivots, block_rows=block).collect()
    assert sorted(tuple(r) for r in got) == brute_top_k(rows, 10)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 3 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_top_k(rows, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0


@pytest.mark.parametrize("pivots", [3, 64])
def test_top_k_of_mixed_lengths(spark, monkeypatch, pivots):
    """Rows of every length take part, whichever are pivots; queries of a cell come in blocks."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rnd = random.Random(pivots)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(rnd.choice([1, 3, 6, 6, 6]))]) for i in range(150)]
    rows += [(200 + i, [rnd.uniform(-1, 1) for _ in range(40)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.repartition(4), F.col("vec_id") % 3 == 0, k=10, pivots=pivots, block_rows=20).collect()
    assert sorted(tuple(r) for r in got) == brute_top_k(rows, 10)


def shingle_set(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """Row number -> smallest row number of its class, by plain Jaccard similarity."""
    sets = [shingle_set(t) for t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared, where = Counter(), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for at in where.values():
        shared.update((a, b) for j, b in enumerate(at) for a in at[:j])
    for i, t in enumerate(rows):
        shared.update((j, i) for j in range(i) if t and not sets[i] and rows[j] == t)
    for (a, b), c in shared.items():
        n = len(sets[a]) + len(sets[b]) - c
        if not sets[a] or c / n >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [root(i) for i in range(len(rows))]


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.random()}"
    return " ".join(words)


def test_near_duplicate_classes(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = ["", "", None, "   ", "!!!", "!!!", "one", "One.", "two three", "a" * 3000]
    for size in (1, 2, 3, 40):
        base = [rnd.choice(vocabulary) for _ in range(300)]
        texts += [edited(rnd, base, rnd.randint(0, 3)) for _ in range(size)]
        texts += [" ".join(base).upper()] * 5
    texts += [" ".join([rnd.choice(vocabulary) for _ in range(90)] + passage) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("label", F.lit(1))
    expected = brute_classes(texts)
    got = {r.doc: r for r in near_dedup.classes(df.repartition(3)).collect()}
    assert {i: got[i].class_id for i in got} == dict(enumerate(expected))
    sizes = Counter(expected)
    assert all(got[i].class_size == sizes[c] for i, c in enumerate(expected))
    kept = near_dedup.keep_first(df.repartition(3))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(sizes)


def test_near_duplicates_without_a_common_centre(spark):
    """Many edited copies: most pairs lie below the threshold, classes hang together by links between members."""
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    texts = [edited(rnd, base, 1 + i % 4) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = near_dedup.Settings(block=16)
    got = {r.doc: r.class_id for r in near_dedup.classes(df.repartition(3), settings=settings).collect()}
    expected = brute_classes(texts)
    assert 1 < len(set(expected)) < 80
    assert got == dict(enumerate(expected))


def test_near_duplicates_with_repeated_passages(spark):
    """A repeated passage leaves plain similarity high and makes weighted similarity low."""
    rnd = random.Random(11)
    texts = []
    for _ in range(40):
        base = [f"p{rnd.random()}" for _ in range(300)]
        passage = base[100:200]
        texts += [" ".join(base), " ".join(base[:200] + passage * rnd.randint(3, 8) + base[200:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_classes(texts)
    assert len(set(expected)) == 40
    assert {r.doc: r.class_id for r in near_dedup.classes(df.repartition(3)).collect()} == dict(enumerate(expected))


@pytest.mark.parametrize("block", [5, 1024])
def test_every_pair_of_a_bucket_is_compared(block):
    """Links given out join the same classes as all exact pairs do, also of copies that samples take for unlike."""
    rng = np.random.default_rng(5)
    weights = np.ones(1 << 8, np.float32)
    base = rng.integers(0, 1 << 32, 300, dtype=np.uint64)
    rows = []
    for i in range(30):
        own = np.concatenate([base[: 300 - 2 * i], rng.integers(0, 1 << 32, 2 * i, dtype=np.uint64)])
        rows.append(np.sort(np.concatenate([own, *[own[:100]] * (i % 4)])).astype("<u4"))
    names = [bytes([i]) * 16 for i in range(len(rows))]
    table = pa.table({"bucket": pa.array([1] * 60, pa.int64()), "mine": pa.array([0] * 60, pa.int32()), "other": pa.array([0] * 60, pa.int32()),
                      "node": pa.array(names * 2, pa.binary()), "label": pa.array(names * 2, pa.binary()),
                      "shingles": pa.array([r.tobytes() for r in rows] * 2, pa.binary()), "asks": [True] * 30 + [False] * 30})

    class Shared:
        value = weights

    got = [r for batch in near_dedup._alike(near_dedup.Settings(), Shared, piece=block * 300)(iter(table.to_batches())) for r in batch.to_pylist()]

    def joined(pairs):
        parent = {n: n for n in names}

        def root(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for x, y in pairs:
            x, y = sorted((root(x), root(y)))
            parent[y] = x
        return {n: root(n) for n in names}

    all_pairs = [(names[i], names[j]) for j in range(30) for i in range(j) if max(near_dedup.similarity(rows[i], rows[j], weights)) >= 0.8]
    assert joined([(r["a"], r["b"]) for r in got]) == joined(all_pairs)
    assert set((r["a"], r["b"]) for r in got) <= set(all_pairs)


def test_open_members_of_one_class_are_not_compared(spark):
    """Rows of a round: none for buckets of one class, members once and few leaders for the others."""
    rows = [(1, f"{i:016d}".encode(), b"x", i == 0) for i in range(2000)]                                # one class, 1999 without a link to the leader
    rows += [(2, f"{i:016d}".encode(), b"x" if i < 1990 else b"%d" % i, i == 0) for i in range(2000)]    # ten others
    rows += [(3, f"{i:016d}".encode(), b"%d" % i, i == 0) for i in range(500)]                           # all apart
    state = spark.createDataFrame(rows, "bucket long, node binary, label binary, led boolean")
    asking = near_dedup._asking(state, 64)
    dealt = near_dedup._placed(asking.filter("asks"), 64, True).unionByName(near_dedup._placed(asking, 64, False))
    counts = {(r.bucket, r.asks): r["count"] for r in dealt.groupBy("bucket", "asks").count().collect()}
    assert {b for b, _ in counts} == {2, 3}
    assert counts[2, False] == 2000 and counts[2, True] == 10 * 32
    assert counts[3, False] == 500 and 0 < counts[3, True] <= 130 * 8
    pairs = dealt.select("bucket", "mine", "other", "node", "asks")
    a, b = pairs.filter("asks").alias("a"), pairs.filter("not asks").alias("b")
    met = a.join(b, ["bucket", "mine", "other"]).groupBy("bucket", "a.node").agg(F.countDistinct("b.node").alias("n")).collect()
    assert {(r.bucket, r.n) for r in met} == {(2, 2000), (3, 500)}          # each leader meets the whole bucket
    led = state.withColumn("led", F.expr("led or bucket = 2 and label <> 'x' or bucket = 3"))
    assert near_dedup._asking(led, 64).count() == 0


def test_near_duplicates_of_odd_rows(odd_documents):
    rows = near_dedup.classes(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    kept = near_dedup.keep_first(odd_documents).collect()
    names = {r.class_key for r in rows if r.class_key}
    assert len(kept) == len(names) + sum(r.class_key is None for r in rows)
    assert near_dedup.classes(odd_documents.limit(0)).count() == 0
    assert near_dedup.keep_first(odd_documents.limit(0)).count() == 0


def test_consistent_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    settings = near_dedup.Settings(bands=100, rows=5)
    sampler = near_dedup.Sampler(settings)
    weights = np.ones(1 << 10, np.float32)
    a = np.unique(rng.integers(0, 1 << 32, 400, dtype=np.uint64).astype(np.uint32))
    b = np.unique(np.concatenate([a[:320], rng.integers(0, 1 << 32, 80, dtype=np.uint64).astype(np.uint32)]))
    rows = np.concatenate([a, b])
    s = sampler.samples(rows, np.ones(len(rows), np.float32), np.array([0, len(a), len(rows)]))
    assert abs((s[0] == s[1]).mean() - near_dedup.similarity(a, b, weights)[0]) < 0.08


def brute_repeats(data, length):
    seen = Counter(t[i: i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        runs = []
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + t[at:a], b
        out.append((len(t), [tuple(r) for r in runs], kept + t[at:]))
    return out


@pytest.mark.parametrize("length, hot", [(20, 20_000), (33, 20_000), (33, 1)])
def test_suffix_dedup(spark, length, hot):
    rnd = random.Random(length)
    base = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(10, 4 * length))) for _ in range(25)]
    texts = [None, "", "x" * (length - 1), "x" * length, "é" * 3 * length, "y" * 400, "y" * 401]
    for _ in range(200):
        b = rnd.choice(base)
        a = rnd.randint(0, len(b))
        filler = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 2 * length)))
        texts.append(rnd.choice([b, filler + b[:a] + rnd.choice(["", "Q", "é"]) + b[a:], filler + b + rnd.choice(base), "x" * rnd.randint(0, 3 * length)]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("runs", F.lit("x"))
    got = {r.doc_id: r for r in suffix_dedup.remove(df.repartition(4), length=length, hot_contexts=hot).collect()}
    for i, (n, runs, kept) in enumerate(brute_repeats([(t or "").encode() for t in texts], length)):
        assert (got[i].n_bytes, [tuple(s) for s in got[i].spans], bytes(got[i].kept)) == (n, runs, kept)
        assert got[i].runs == "x"


def test_suffix_dedup_of_odd_rows(odd_documents):
    rows = suffix_dedup.remove(odd_documents.drop("kept")).collect()
    assert len(rows) == odd_documents.count()
    texts = [(r.text or "").encode() for r in odd_documents.collect()]
    expected = Counter((n, tuple(runs), hashlib.md5(kept).hexdigest()) for n, runs, kept in brute_repeats(texts, 200))
    assert Counter((r.n_bytes, tuple(tuple(s) for s in r.spans), hashlib.md5(r.kept).hexdigest()) for r in rows) == expected
    assert suffix_dedup.remove(odd_documents.drop("kept").limit(0)).count() == 0


def test_anchors_cover_every_window():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 3_000_000 // 10).astype(np.uint8)
    _, at, lo, hi = suffix_dedup.anchors(data, 50)
    assert lo[0] == 0 and hi[-1] == len(data) - 50 and (lo[1:] == hi[:-1] + 1).all()
    assert ((at >= hi) & (at - lo <= 50 - suffix_dedup.GRAM)).all()


def test_elias_fano():
    rng = np.random.default_rng(4)
    for values in (np.zeros(0, np.int64), np.array([0]), np.array([5, 5, 5, 9]), np.sort(rng.integers(0, 1 << 40, 3000)), np.arange(700)):
        ef = ngram_lm.EliasFano.encode(values)
        if len(values):
            assert (ef.get(np.arange(len(values))) == values).all()
        ask = np.unique(np.concatenate([values, values + 1, [0, 1, 1 << 41]]))
        assert (ef.successor(ask) == np.searchsorted(values, ask)).all()


def brute_scores(rows, learned):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for t in rows]
    uni, bi, after, kinds = Counter(), Counter(), Counter(), Counter()
    for w, on in zip(tokens, learned):
        if on:
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w))
    for (u, _), n in bi.items():
        after[u] += n
        kinds[u] += 1
    total = sum(uni.values())
    floor, d = total + 0.5 * (len(uni) + 1), ngram_lm.DISCOUNT
    for w in tokens:
        model = 0.0
        for u, x in zip(["<s>", *w[:-1]], w):
            low = (uni[x] + 0.5) / floor
            model += math.log10(max(bi[u, x] - d, 0) / after[u] + d * kinds[u] / after[u] * low) if after[u] else math.log10(low)
        yield len(w), sum(uni[x] > 0 for x in w), total, sum(math.log10((uni[x] + 0.5) / floor) for x in w), model


def test_ngram_scores(spark, odd_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    for frame in (docs, odd_documents):
        rows = frame.collect()
        got = ngram_lm.score(frame, crc_mod("doc_id", 5) != 1, carry={"doc_id": F.col("doc_id"), "t": F.col("text")}, shards=5).collect()
        expected = list(brute_scores([r.text for r in rows], [r.doc_id is not None and not held(r.doc_id) for r in rows]))
        key = lambda x: repr((x[0], x[1] or ""))
        got = sorted(((r.doc_id, r.t, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
        want = sorted(((r.doc_id, r.text, *e) for r, e in zip(rows, expected)), key=key)
        for g, w in zip(got, want, strict=True):
            assert (g[0], g[1] or "", *g[2:5]) == (w[0], w[1] or "", *w[2:5])
            assert g[5] == pytest.approx(w[5], rel=1e-9)
            assert abs(g[6] - w[6]) <= ngram_lm.STEP * w[2]
    assert ngram_lm.score(docs.limit(0), F.lit(True), shards=3).count() == 0

"""Language ID, license scan and quality rules against brute force and held-out accuracy."""
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sigspark.llm import langid, licenses, quality
from sigspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd_documents):
    model = langid.train(odd_documents, settings=langid.Settings(sample_docs=200, epochs=2))
    rows = langid.predict(odd_documents, model, carry={"t": F.col("text")}).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        if not any(c.isalpha() for c in r.t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr") and 0 < r.score <= 1
    nothing = langid.train(odd_documents.limit(0))
    assert {r.lang_pred for r in langid.predict(odd_documents, nothing).collect()} == {"und"}


@pytest.mark.parametrize("line, labels, openness", [
    ("MIT", {"mit"}, 1.0),
    ("MIT OR GPL-3.0-only", {"mit", "gpl-3"}, 1.0),
    ("MIT and GPL-3.0-only", {"mit", "gpl-3"}, 0.4),
    ("MIT OR GPL-2.0 AND CC-BY-NC-4.0", {"mit", "gpl-2", "cc-by-nc"}, 1.0),
    ("(MIT OR GPL-2.0) AND CC-BY-NC-4.0", {"mit", "gpl-2", "cc-by-nc"}, 0.1),
    ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl-2"}, 0.6),
    ("GPL-2.0+ with x or Apache-2.0 */", {"gpl-2", "apache-2"}, 1.0),
    ("MIT, and more prose", {"mit"}, 1.0),
    ("OR MIT", {"mit"}, 0.0),
    ("((MIT)", {"mit"}, 0.0),
    ("", set(), 0.0),
])
def test_expressions(line, labels, openness):
    got = licenses.read_expression(line)
    assert got[0] == labels and got[1] == pytest.approx(openness)


def test_license_scan_against_words(spark, odd_documents):
    extra = spark.createDataFrame([(900, "Under THE mit\nlicense; apache license, version 2.0 CC-BY-NC cc by nc"),
                                   (901, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only\nrest"),
                                   (902, "undér the mit license underthe mit license")], "doc_id long, text string")
    rows = odd_documents.select("doc_id", "text").unionByName(extra)
    expected = []
    for r in rows.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
        at = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.split()]
              for i in range(len(w) - len(p) + 1) if w[i: i + len(p)] == p]
        expected.append((r.doc_id, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
                         ",".join(sorted({x for _, x in at}))))
    got = licenses.summary(licenses.scan(rows)).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(expected, key=repr)
    assert next(r for r in got if r.doc == 901).labels == "apache-2,gpl-3,mit"
    assert next(r for r in got if r.doc == 901).score == pytest.approx(0.4)
    assert licenses.scan(rows.limit(0)).count() == 0


def test_license_expressions_of_any_length(spark):
    many = " OR ".join(["GPL-3.0-only"] * 400)
    rows = spark.createDataFrame([
        (1, f"SPDX-License-Identifier: ({many} OR MIT) AND CC-BY-NC-4.0\nOR 0BSD"),
        (2, "SPDX-License-Identifier: " + "Apache-2.0 and " * 160 + "MPL-2.0 " + "prose goes on " * 300),
        (3, "License-Expression: (MIT AND " + " " * 3000 + "EPL-2.0)")], "doc_id long, text string")
    got = {r.doc: (r.labels, round(r.score, 6)) for r in licenses.summary(licenses.scan(rows)).collect()}
    assert got == {1: ("cc-by-nc,gpl-3,mit", 0.1), 2: ("apache-2,mpl", 0.6), 3: ("epl,mit", 0.6)}


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i: i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
            len(w) < 20 or 100 * len(again) > 30 * len(w))


def llr(text, ratio, buckets):
    h1 = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    h2 = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)) for a, b in zip(h1, h1[1:])]
    signed = [x - (1 << 64) if x >> 63 else x for x in h1 + h2]
    return sum(ratio[x % buckets] for x in signed) / max(1, 2 * len(h1) - 1)


def test_quality_against_brute_force(spark, odd_documents):
    labels = spark.createDataFrame([(100, 1, 0), (101, 1, None), (102, 0, 0), (103, 1, 1), (None, 1, 0), (100, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    buckets = 512
    table = quality.ratio_table(odd_documents, labels, buckets).collect()
    ratio = {r.bucket: r.ratio for r in table}
    docs = odd_documents.collect()
    n = lambda t: max(0, 2 * len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) - 1)
    assert sum(r.raw for r in table) == sum(n(r.text) for r in docs)
    assert sum(r.target for r in table) == sum(n(r.text) for r in docs if r.doc_id in (100, 101))
    got = quality.judge(odd_documents, labels, buckets, threshold=-0.01).collect()
    assert len(got) == len(docs)
    for r in got:
        text = r.text or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(text)
        assert r.llr == pytest.approx(llr(text, ratio, buckets), abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= -0.01)
    assert quality.judge(odd_documents.limit(0), labels.limit(0)).count() == 0


def test_quality_without_trusted_documents(odd_documents, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge(odd_documents, labels, 64).filter("kept").collect()
    assert rows and all(r.llr == 0 and not r.base_failed for r in rows)

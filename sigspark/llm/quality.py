"""Quality rules in SQL functions: text measures and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: the
trusted target (documents labelled good) and the raw corpus (all documents).
A document's score is its summed log ratio divided by its number of n-grams;
every document is judged by the same fixed threshold.

Counts of the raw corpus cover all documents. The target is fitted on a bounded
sample of labelled documents (``target_docs``, chosen by hash), so their ids
may be broadcast. The ratio table has ``buckets`` entries and reaches the tasks
as one array; no row of text is shuffled.

Defined cases: null text has no word and counts 0 everywhere, so it fails the
base rule; a text without n-grams scores 0; without any trusted document all
ratios are 0 and only the base rule decides. Repeated rows are judged alike
and come out once each; null ids never belong to the target.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.frames import TMP

#: Entries of the ratio table.
BUCKETS = 1 << 16
#: Most labelled documents that the target is fitted on.
TARGET_DOCS = 16_384
#: Pseudo-count of every n-gram in the target.
PRIOR = 5.0
#: Mean log ratio (nats per n-gram) from which a document is kept.
THRESHOLD = -0.25

WHITE = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def _pairs(a: Column, shift: int) -> Column:
    """Hash of each element with the one ``shift`` places on."""
    return F.zip_with(a, F.slice(a, F.lit(shift + 1), F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the hashes of the words and of the word pairs of every text."""
    return (docs.withColumn(TMP + "text", F.coalesce(F.col(text_col), F.lit("")))
            .withColumn(TMP + "words", words_of(F.col(TMP + "text")))
            .withColumn(TMP + "h1", F.transform(TMP + "words", lambda w: F.xxhash64(w)))
            .withColumn(TMP + "h2", _pairs(F.col(TMP + "h1"), 1)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text, n = F.col(TMP + "text"), F.size(TMP + "words")
    h8 = F.col(TMP + "h8")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE + " ", "") != "")
    at = F.sequence(F.lit(0), F.greatest(F.size(h8) - 1, F.lit(0)))
    ordered = F.col(TMP + "ordered")
    same = lambda a, b: F.get(ordered, a)["h"] == b["h"]
    places = F.col(TMP + "places")
    frame = (docs
             .withColumn(TMP + "h4", _pairs(F.col(TMP + "h2"), 2))
             .withColumn(TMP + "h8", F.when(n >= 8, F.slice(_pairs(F.col(TMP + "h4"), 4), F.lit(1), F.greatest(n - 7, F.lit(1))))
                         .otherwise(F.array().cast("array<bigint>")))
             # windows found twice, by sorting; only texts that have any
             .withColumn(TMP + "ordered", F.when(
                 F.size(F.array_distinct(h8)) < F.size(h8),
                 F.sort_array(F.zip_with(h8, at, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))))
             .withColumn(TMP + "places", F.sort_array(F.transform(
                 F.filter(ordered, lambda x, i: F.coalesce(same(i - 1, x), F.lit(False)) | F.coalesce(same(i + 1, x), F.lit(False))),
                 lambda x: x["p"])))
             .withColumn(TMP + "gaps", F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))),
                                                  lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8)))))
             .withColumn(TMP + "lines", lines))
    repeated = F.coalesce(F.aggregate(TMP + "gaps", F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    frame = (frame
             .withColumn("n_words", n.cast("long"))
             .withColumn("word_chars", F.length(F.translate(text, WHITE + " ", "")).cast("long"))
             .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
             .withColumn("n_dup_lines", (F.size(TMP + "lines") - F.size(F.array_distinct(TMP + "lines"))).cast("long"))
             .withColumn("n_repeat_words", repeated))
    return frame.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _features() -> Column:
    """Hashes of all words and word pairs."""
    return F.concat(F.col(TMP + "h1"), F.slice(F.col(TMP + "h2"), F.lit(1), F.greatest(F.size(TMP + "h2") - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, target_docs: int = TARGET_DOCS) -> DataFrame:
    """At most ``target_docs`` distinct doc ids labelled good and not toxic, chosen by hash."""
    good = (labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").alias(TMP + "id")).distinct())
    return good.orderBy(F.xxhash64(TMP + "id"), TMP + "id").limit(target_docs)


def ratio_table(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS,
                doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, target and raw counts, and ratio: ln of target over raw probability.

    Both multinomials get pseudo-counts in proportion to their size (``PRIOR`` for the target), so
    n-grams that are rare in a corpus of any size say little.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_col).alias(TMP + "doc"), F.col(text_col).alias("text"))
    trusted = trusted_ids(labels, target_docs).withColumn(TMP + "good", F.lit(1))
    marked = base.join(F.broadcast(trusted), F.col(TMP + "doc") == F.col(TMP + "id"), "left")   # at most target_docs ids
    counts = (with_words(marked)
              .select(F.coalesce(F.col(TMP + "good"), F.lit(0)).alias("good"), F.explode(_features()).alias("h"))
              .select("good", F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"))
              .groupBy("bucket").agg(F.sum("good").alias("target"), F.count(F.lit(1)).alias("raw")))
    dense = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
             .select("bucket", F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("raw", F.lit(0)).alias("raw")))
    totals = dense.agg(F.sum("target"), F.sum("raw")).first()
    n_target, n_raw = int(totals[0] or 0), int(totals[1] or 0)
    if not n_target:
        return dense.withColumn("ratio", F.lit(0.0))
    expected = F.col("raw") * F.lit(n_target / n_raw)
    return dense.withColumn("ratio", F.log((F.col("target") + F.lit(PRIOR)) / (expected + F.lit(PRIOR))))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS,
          threshold: float = THRESHOLD, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the measures, ``llr`` and ``kept``; columns of these names are replaced."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    columns = [c for c in docs.columns if c not in made]
    table = ratio_table(docs, labels, buckets, target_docs, doc_col, text_col)
    ratios = table.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))),
                                   lambda x: x["ratio"]).alias("ratios"))       # buckets entries, whatever the corpus
    frame = measures(with_words(docs, text_col)).withColumn(TMP + "ratios", ratios.scalar())
    total = F.aggregate(_features(), F.lit(0.0), lambda a, h: a + F.get(TMP + "ratios", F.pmod(h, F.lit(buckets)).cast("int")))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    frame = frame.withColumn("llr", total / grams)
    # always true, but not deterministic for the optimiser: a filter on the result is not
    # pushed below, where it would repeat the nested array expressions many times over
    here = F.monotonically_increasing_id() >= 0
    return frame.select(*[F.col(f"`{c}`") for c in columns], "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "llr",
                        (~F.col("base_failed") & (F.col("llr") >= threshold) & here).alias("kept"))

"""Train/test family coverage: set operations and the coverage reports.

Inputs are the per-family count tables of the two splits (small aggregates),
so every join here is between aggregated tables and the report is a single
conditional aggregate over their full outer join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import IGNORE_TAGS, label_counts


def family_counts(train: DataFrame, test: DataFrame, label_col: str = "family") -> DataFrame:
    """``join_full_counts``: (family, train_count, test_count), missing side = 0."""
    tr = label_counts(train, label_col).withColumnRenamed("n", "train_count")
    te = label_counts(test, label_col).withColumnRenamed("n", "test_count")
    return (tr.join(te, "label", "full_outer")
              .select(F.col("label").alias("family"),
                      F.coalesce("train_count", F.lit(0)).alias("train_count"),
                      F.coalesce("test_count", F.lit(0)).alias("test_count")))


def classified(counts: DataFrame, class_min: int) -> DataFrame:
    """Adds the family sets as flags (ignored tags are in neither set)."""
    ign = F.col("family").isin(IGNORE_TAGS)
    in_train = (F.col("train_count") > 0) & ~ign
    in_test = (F.col("test_count") > 0) & ~ign
    trained = in_train & (F.col("train_count") >= class_min)
    return counts.select("*", in_train.alias("in_train"), in_test.alias("in_test"), trained.alias("trained"),
                         (in_train & in_test).alias("overlap"), (in_train & ~in_test).alias("only_train"),
                         (in_test & ~in_train).alias("only_test"),
                         (in_train & in_test & ~trained).alias("below_min"))


def coverage_report(train: DataFrame, test: DataFrame, class_min: int = 10, label_col: str = "family") -> DataFrame:
    """``agg_family_coverage``: one row of family-set sizes and invisible test samples.
    The denominator counts every test family value, ignored tags included."""
    c = classified(family_counts(train, test, label_col), class_min)
    total = F.sum("test_count")
    invisible = F.sum(F.when(F.col("only_test") | F.col("below_min"), F.col("test_count")).otherwise(0))
    return c.agg(
        F.count_if("in_train").alias("n_families_train_raw"),
        F.count_if("trained").alias("n_families_train_used_as_class"),
        F.count_if("in_test").alias("n_families_test_raw"),
        F.count_if("overlap").alias("n_families_overlap"),
        F.count_if("only_train").alias("n_families_only_train"),
        F.count_if("only_test").alias("n_families_only_test_never_seen"),
        F.count_if("below_min").alias("n_families_below_class_min"),
        F.coalesce(total, F.lit(0)).alias("total_test_malware_samples"),
        F.coalesce(invisible, F.lit(0)).alias("test_samples_invisible_to_model"),
        F.coalesce(F.try_divide(invisible, total), F.lit(0.0)).alias("test_samples_invisible_rate"))


def top_unseen(train: DataFrame, test: DataFrame, class_min: int = 10, top_n: int = 10,
               label_col: str = "family") -> DataFrame:
    """``srt_topn_unseen``: the top-N test families never seen in train and the top-N
    seen but below class_min, by test count (ties by name)."""
    c = classified(family_counts(train, test, label_col), class_min)
    a = (c.where("only_test").orderBy(F.col("test_count").desc(), F.col("family")).limit(top_n)
          .select(F.lit("never_seen_in_train").alias("list"), "family", "test_count", F.lit(None).cast("bigint").alias("train_count")))
    b = (c.where("below_min").orderBy(F.col("test_count").desc(), F.col("family")).limit(top_n)
          .select(F.lit("below_class_min").alias("list"), "family", "test_count", "train_count"))
    return a.unionByName(b)


def family_sets(train: DataFrame, test: DataFrame, label_col: str = "family"):
    """Distinct non-ignored family names of each split (single-column frames)."""
    def fams(df):
        return (label_counts(df, label_col).select(F.col("label").alias("family"))
                .where(~F.col("family").isin(IGNORE_TAGS)))
    return fams(train), fams(test)


def overlap_families(train: DataFrame, test: DataFrame, label_col: str = "family") -> DataFrame:
    """``set_intersect_families``."""
    a, b = family_sets(train, test, label_col)
    return a.intersect(b)


def except_families(train: DataFrame, test: DataFrame, class_min: int = 10, label_col: str = "family") -> DataFrame:
    """``set_except_families``: train - test, test - train, (test & train) - trained."""
    a, b = family_sets(train, test, label_col)
    trained = (label_counts(train, label_col).where((F.col("n") >= class_min) & ~F.col("label").isin(IGNORE_TAGS))
               .select(F.col("label").alias("family")))
    return (a.subtract(b).withColumn("set", F.lit("only_train"))
            .unionByName(b.subtract(a).withColumn("set", F.lit("only_test")))
            .unionByName(a.intersect(b).subtract(trained).withColumn("set", F.lit("below_class_min"))))


def semi_overlap(train: DataFrame, test: DataFrame, label_col: str = "family") -> DataFrame:
    """``join_semi_overlap``: train families (with counts) that also occur in test."""
    tr = label_counts(train, label_col).where(~F.col("label").isin(IGNORE_TAGS))
    te = label_counts(test, label_col).where(~F.col("label").isin(IGNORE_TAGS))
    return tr.join(te.select("label"), "label", "left_semi").select(F.col("label").alias("family"), "n")


def anti_only(train: DataFrame, test: DataFrame, label_col: str = "family") -> DataFrame:
    """``join_anti_only``: families of one split that never occur in the other."""
    tr = label_counts(train, label_col).where(~F.col("label").isin(IGNORE_TAGS))
    te = label_counts(test, label_col).where(~F.col("label").isin(IGNORE_TAGS))
    return (tr.join(te.select("label"), "label", "left_anti").withColumn("side", F.lit("train"))
            .unionByName(te.join(tr.select("label"), "label", "left_anti").withColumn("side", F.lit("test")))
            .select(F.col("label").alias("family"), "n", "side"))


def coverage_from_encoded(test: DataFrame, y_bin: str = "y_bin", y_fam: str = "y_fam") -> DataFrame:
    """``agg_family_coverage_vec``: known / unseen malware in the encoded test split."""
    mal = F.col(y_bin) == 1
    unseen = mal & (F.col(y_fam) == -1)
    known = mal & (F.col(y_fam) != -1)
    return test.agg(
        F.count_if(mal).alias("true_malware_samples_in_test"),
        F.count_if(known).alias("known_family_samples_in_test"),
        F.count_if(unseen).alias("unseen_family_samples_in_test"),
        F.coalesce(F.try_divide(F.count_if(unseen), F.count_if(mal)), F.lit(0.0)).alias("unseen_family_rate"),
        F.count_distinct(F.when(known, F.col(y_fam))).alias("n_family_classes_seen_in_test"))

"""Deterministic range buckets for global running sums and positions.

Spark's ``repartitionByRange`` samples its bounds each time the plan runs;
when a frame is used twice (once for per-partition totals, once for the
rows) the two runs may split differently. Here the bounds are sampled once
on the driver (a bounded sample, like the range partitioner's own) and
frozen as literals, so every use of the bucket column agrees. Bounds are
tuples over all order columns, so a single hot value of the first column
is still split over several buckets by the tie-breaking columns.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_BUCKET = 40


def _n_buckets(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bucket(df: DataFrame, order_cols: list[str], n: int | None = None, descending: bool = False,
                 seed: int = 17) -> Column:
    """Bucket id in [0, n) that is monotone in the (lexicographic) order of ``order_cols``;
    equal keys always share a bucket."""
    spark = df.sparkSession
    n = n or _n_buckets(spark)
    total = df.count()
    if total == 0 or n <= 1:
        return F.lit(0)
    frac = min(1.0, SAMPLE_PER_BUCKET * n / total)
    sample = [tuple(r) for r in df.select(*order_cols).sample(False, frac, seed).collect()]
    sample = sorted(s for s in sample if all(v is not None for v in s))
    if not sample:
        return F.lit(0)
    bounds = sorted({sample[(len(sample) * i) // n] for i in range(1, n)})
    types = {f.name: f.dataType for f in df.schema.fields}
    def literal(b):
        return F.struct(*[F.lit(v).cast(types[c]).alias(f"k{j}") for j, (c, v) in enumerate(zip(order_cols, b))])

    def not_above(some, r):
        return F.size(F.filter(some, lambda b: b <= r))

    # two steps of about sqrt(n) comparisons: the run of bounds, then the place in it; lambda variables hold row and run
    step = max(1, math.isqrt(len(bounds)))
    runs = [F.array(*map(literal, bounds[i:i + step])) for i in range(0, len(bounds), step)]
    heads, runs = F.array(*map(literal, bounds[::step])), F.array(*runs)
    row = F.struct(*[F.col(c).alias(f"k{j}") for j, c in enumerate(order_cols)])
    place = F.flatten(F.transform(F.array(row), lambda r: F.transform(F.array(not_above(heads, r)), lambda h: F.when(
        h > 0, (h - 1) * step + not_above(F.get(runs, h - 1), r)).otherwise(0))))
    asc = F.element_at(place, 1)
    return (F.lit(len(bounds)) - asc) if descending else asc


def running_sums(df: DataFrame, order_cols: list[str], sums: list[str], descending: bool = False,
                 prefix: str = "cum_", inclusive: bool = True) -> DataFrame:
    """Running sums of ``sums`` in global order, computed per bucket plus bucket
    offsets (the offset table has one row per bucket)."""
    d = df.withColumn("__b", range_bucket(df, order_cols, descending=descending))
    tot = d.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    w_off = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("__b", *[F.coalesce(F.sum(f"__t_{c}").over(w_off), F.lit(0)).alias(f"__o_{c}") for c in sums])
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w_in = Window.partitionBy("__b").orderBy(*order).rowsBetween(*frame)
    out = d.join(F.broadcast(offs), "__b")
    for c in sums:
        out = out.withColumn(f"{prefix}{c}", F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0)))
    return out.drop("__b", *[f"__o_{c}" for c in sums])


def positions(df: DataFrame, order_cols: list[str], out: str = "pos") -> DataFrame:
    """0-based global position in ``order_cols`` order (make the order total by
    including a unique column)."""
    d = df.withColumn("__one", F.lit(1))
    r = running_sums(d, order_cols, ["__one"], prefix="__cum", inclusive=True)
    return r.withColumn(out, (F.col("__cum__one") - 1).cast("bigint")).drop("__one", "__cum__one")

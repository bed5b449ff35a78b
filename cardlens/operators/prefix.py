"""Global ordered prefix sums without a single-partition window (§4.3 item 1).

A window with no ``partitionBy`` pulls every row into one task.  Instead:

1. give each row a bucket id that is monotone in the sort order and bounded
   (at most ``n_buckets`` values),
2. aggregate per bucket (partial + final hash aggregate, tiny result),
3. prefix-sum that bucket table (bounded size, so broadcasting it is safe),
4. run the in-bucket window ``partitionBy(bucket)`` and add the offset.

Exact, and every step is distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 4096


def range_bucket(df: DataFrame, col: str, n_buckets: int = DEFAULT_BUCKETS) -> Column:
    """Equal-width bucket of a numeric column over its observed [min, max].

    Only two scalars reach the driver.
    """
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return F.lit(0).cast("long")
    width = max((hi - lo) / n_buckets, 1e-300) if isinstance(lo, float) else \
        max(-(-(hi - lo + 1) // n_buckets), 1)
    return F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("long"),
                   F.lit(n_buckets - 1))


def unit_bucket(col: str, n_buckets: int = DEFAULT_BUCKETS, descending: bool = False) -> Column:
    """Bucket of a value in [0, 1] (scores); descending puts high scores first."""
    b = F.least(F.greatest(F.floor(F.col(col) * n_buckets), F.lit(0)), F.lit(n_buckets - 1))
    b = b.cast("long")
    return (F.lit(n_buckets - 1) - b) if descending else b


def with_quantile_bucket(df: DataFrame, col: str, out: str, n_buckets: int = DEFAULT_BUCKETS,
                         descending: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Add bucket id ``out`` from approximate quantile boundaries of ``col``.

    Balanced even when values crowd into a narrow range (a real score
    distribution).  The boundaries only need to be monotone, not exact: the
    offsets come from real counts, so results stay exact.  At most
    ``n_buckets`` boundaries reach the driver; the lookup is the JVM binary
    search of ``Bucketizer``; equal values always share a bucket.
    """
    from pyspark.ml.feature import Bucketizer
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.agg(F.percentile_approx(col, probs, accuracy)).first()[0] or []
    bounds = sorted(set(float(b) for b in bounds if b is not None))
    if not bounds:
        return df.withColumn(out, F.lit(0).cast("long"))
    splits = [float("-inf")] + bounds + [float("inf")]
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)
    idx = F.col(out).cast("long")
    return b.withColumn(out, (F.lit(len(splits) - 2) - idx) if descending else idx)


def bucket_offsets(df: DataFrame, bucket: str, sums: dict[str, Column]) -> DataFrame:
    """Per bucket: exclusive prefix of each sum over all earlier buckets."""
    per = df.groupBy(bucket).agg(*[e.alias(k) for k, e in sums.items()])
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # the bucket table has at most n_buckets rows: one small task, safe to broadcast
    return per.select(bucket, *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k + "_before")
                                for k in sums])


def global_row_number(df: DataFrame, order: list[str], bucket_col: Column | None = None,
                      n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """0-based rank of every row in ``order``; buckets are monotone in order[0]
    (quantile boundaries of order[0] unless ``bucket_col`` is given)."""
    if bucket_col is None:
        d = with_quantile_bucket(df.withColumn("_bv", F.col(order[0]).cast("double")), "_bv", "_bkt",
                                 n_buckets).drop("_bv")
    else:
        d = df.withColumn("_bkt", bucket_col)
    offs = bucket_offsets(d, "_bkt", {"_cnt": F.count(F.lit(1))})
    w = Window.partitionBy("_bkt").orderBy(*order)
    return (d.join(F.broadcast(offs), "_bkt")
             .withColumn("global_rank", F.col("_cnt_before") + F.row_number().over(w) - 1)
             .drop("_bkt", "_cnt_before"))

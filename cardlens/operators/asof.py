"""Point-in-time (as-of) feature lookup.

For each label row: the newest feature row of the same entity at or before
the label time (ties: latest ``created``), or null when that row is older
than the view's TTL.

Plan: tag and ``unionByName`` both sides, then ``last(struct, ignorenulls)``
over ``(entity, slice) ORDER BY ts, side, created``.  Because a feature older
than the TTL is never returned, a slice only needs the feature rows of the
last TTL before it: those are copied into the next slice as context.  A hot
entity is therefore split into one task per time slice, and the only shuffle
is the one that co-locates (entity, slice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(labels: DataFrame, features: DataFrame, entity: str, ts: str, ttl_us: int,
              feature_cols: list[str], created: str | None = None,
              slice_us: int | None = None) -> DataFrame:
    """``labels`` (entity, ts, ...) + the as-of values of ``feature_cols``.

    ``ts`` columns are microseconds (long).  Adds ``feature_ts`` (null when no
    row qualifies).
    """
    slice_us = slice_us or max(ttl_us, 7 * 86_400_000_000)
    if slice_us < ttl_us:
        raise ValueError("slice must cover the TTL")
    created_col = F.col(created) if created else F.lit(0)
    feat = features.select(
        F.col(entity).alias("_e"), F.col(ts).alias("_ts"), F.lit(0).alias("_side"),
        created_col.alias("_created"),
        F.struct(F.col(ts).alias("feature_ts"), *[F.col(c) for c in feature_cols]).alias("_f"))
    lab = labels.select(F.col(entity).alias("_e"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"),
                        F.lit(0).alias("_created"),
                        F.lit(None).cast(feat.schema["_f"].dataType).alias("_f"),
                        F.struct(*[F.col(c) for c in labels.columns]).alias("_l"))
    feat = feat.withColumn("_l", F.lit(None).cast(lab.schema["_l"].dataType))
    sl = F.floor(F.col("_ts") / F.lit(slice_us)).cast("long")
    feat = feat.withColumn("_slice", sl)
    ctx = (feat.filter(F.col("_ts") >= (F.col("_slice") + 1) * F.lit(slice_us) - F.lit(ttl_us))
               .withColumn("_slice", F.col("_slice") + 1))
    both = feat.unionByName(ctx).unionByName(lab.withColumn("_slice", sl))
    w = Window.partitionBy("_e", "_slice").orderBy("_ts", "_side", "_created").rowsBetween(
        Window.unboundedPreceding, 0)
    got = both.withColumn("_asof", F.last("_f", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    fresh = F.col("_asof.feature_ts") >= F.col("_ts") - F.lit(ttl_us)
    hit = F.when(fresh, F.col("_asof"))
    return got.select("_l.*", hit["feature_ts"].alias("feature_ts"),
                      *[hit[c].alias(c) for c in feature_cols])

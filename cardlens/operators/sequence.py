"""Sequence window (W1): the last 7 rows of the card before each row, oldest first.

Hot cards are split by time slice like the feature windows.  A slice only
needs the last 7 rows that came before it, which live in the *tails* of the
previous non-empty slices: per (card, slice) the last 7 rows are kept (a
window over one slice), the tails of the 7 preceding slices are concatenated
on the tiny per-(card, slice) table, trimmed to 7, and added to the slice as
context rows.  Every step is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlens.constants import DAY_US
from cardlens.operators.features import DEFAULT_BUCKET_DAYS

SEQ_LEN = 8


def sequence_window(df: DataFrame, value: Column, seq_len: int = SEQ_LEN,
                    bucket_days: int = DEFAULT_BUCKET_DAYS) -> DataFrame:
    """Adds ``window`` = array of the previous ``seq_len - 1`` structs
    ``(transaction_id, value)`` of the same card, oldest first (shorter at the
    start of a card's history; pad with :func:`left_pad`)."""
    hist = seq_len - 1
    bucket_us = bucket_days * DAY_US
    rows = df.withColumn("_v", value).withColumn(
        "_b", F.floor(F.col("event_us") / F.lit(bucket_us)).cast("long"))
    item = F.struct("event_us", "seq", "transaction_id", F.col("_v").alias("v"))
    # a long before the card's text: it tells most rows apart in a sort
    card = [F.xxhash64("card_id", "_b"), "card_id", "_b"]
    w_last = Window.partitionBy(*card).orderBy(F.col("event_us").desc(), F.col("seq").desc())
    tails = (rows.withColumn("_r", F.row_number().over(w_last)).filter(F.col("_r") <= hist)
                 .groupBy("card_id", "_b").agg(F.array_sort(F.collect_list(item)).alias("tail")))
    w_prev = Window.partitionBy("card_id").orderBy("_b").rowsBetween(-hist, -1)
    ctx = tails.withColumn("_ctx", F.flatten(F.collect_list("tail").over(w_prev))) \
               .select("card_id", "_b", F.slice(
                   F.col("_ctx"), F.greatest(F.size("_ctx") - hist + 1, F.lit(1)), hist).alias("_ctx"))
    ctx_rows = ctx.select("card_id", "_b", F.explode("_ctx").alias("x")).select(
        "card_id", "_b", F.col("x.event_us").alias("event_us"), F.col("x.seq").alias("seq"),
        F.col("x.transaction_id").alias("transaction_id"), F.col("x.v").alias("_v"),
        F.lit(True).alias("_is_ctx"))
    own = rows.withColumn("_is_ctx", F.lit(False))
    both = own.unionByName(ctx_rows, allowMissingColumns=True)
    w = Window.partitionBy(*card).orderBy("event_us", "seq").rowsBetween(-hist, -1)
    out = both.withColumn("window", F.collect_list(
        F.struct("transaction_id", F.col("_v").alias("value"))).over(w))
    return out.filter(~F.col("_is_ctx")).drop("_v", "_b", "_is_ctx")


def left_pad(window: Column, current: Column, seq_len: int = SEQ_LEN, pad: float = 0.0) -> Column:
    """Values of the window plus this row's value, left padded to ``seq_len``."""
    vals = F.transform(window, lambda e: e["value"])
    return F.concat(F.array_repeat(F.lit(pad), F.lit(seq_len - 1) - F.size(vals)), vals,
                    F.array(current))

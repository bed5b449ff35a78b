"""Model evaluation on a scored table.

Everything is one or two distributed aggregates.  Ranking metrics (AP, ROC
AUC, recall at FPR) group rows by distinct score first (partial aggregation),
then take exact descending prefix sums through :mod:`cardlens.operators.prefix`
instead of a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlens.constants import (CHAMPION_MIN_GAIN, EVAL_THRESHOLDS, FALSE_DECLINE_COST,
                                RECOVERY_RATE, REVIEW_COST)
from cardlens.operators.prefix import bucket_offsets, with_quantile_bucket
from cardlens.session import materialize


def _cnt(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def operating_points(df: DataFrame, score: str = "risk_score", label: str = "is_fraud",
                     amount: str = "amount", thresholds=EVAL_THRESHOLDS) -> DataFrame:
    """A2-A4: confusion counts and rates at each threshold (``score >= t``), one pass."""
    y = F.col(label) == 1
    s = F.col(score)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.when(y, F.col(amount))), F.lit(0.0)).alias("fraud_value")]
    for i, t in enumerate(thresholds):
        aggs += [_cnt((s >= t) & y).alias(f"tp{i}"), _cnt((s >= t) & ~y).alias(f"fp{i}"),
                 _cnt((s < t) & y).alias(f"fn{i}"), _cnt((s < t) & ~y).alias(f"tn{i}"),
                 F.coalesce(F.sum(F.when((s >= t) & y, F.col(amount))), F.lit(0.0)).alias(f"v{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"),
                              F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                              F.col(f"fn{i}").alias("fn"), F.col(f"tn{i}").alias("tn"),
                              F.col(f"v{i}").alias("flagged_fraud_value"))
                     for i, t in enumerate(thresholds)])
    long = wide.select("n", "fraud_value", F.inline(rows))
    fv = F.when(F.col("fraud_value") == 0, 1.0).otherwise(F.col("fraud_value"))
    one = F.lit(1)
    return long.select(
        "threshold", "tp", "fp", "fn", "tn",
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).alias("precision"),
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)).alias("recall"),
        (F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), one)).alias("false_positive_rate"),
        (10000.0 * (F.col("tp") + F.col("fp")) / F.greatest(F.col("n"), one)).alias("alerts_per_10k"),
        (F.col("flagged_fraud_value") / fv).alias("value_recall"))


def net_benefit(df: DataFrame, score: str = "risk_score", label: str = "is_fraud",
                amount: str = "amount", thresholds=EVAL_THRESHOLDS,
                recovery_rate: float = RECOVERY_RATE, review_cost: float = REVIEW_COST,
                false_decline_cost: float = FALSE_DECLINE_COST) -> DataFrame:
    """A4/A5: value stopped at the decline threshold and the net loss reduction."""
    hi, lo = max(thresholds), min(thresholds)
    s, y = F.col(score), F.col(label) == 1
    agg = df.agg(
        F.coalesce(F.sum(F.when((s >= hi) & y, F.col(amount))), F.lit(0.0)).alias("declined_fraud_value"),
        F.coalesce(F.sum(F.when(y, F.col(amount))), F.lit(0.0)).alias("fraud_value"),
        _cnt((s >= hi) & ~y).alias("false_declines"),
        _cnt((s >= lo) & (s < hi)).alias("review_band"))
    fv = F.when(F.col("fraud_value") == 0, 1.0).otherwise(F.col("fraud_value"))
    return agg.select(
        (F.col("declined_fraud_value") * recovery_rate).alias("stopped_value"),
        "false_declines", "review_band",
        (F.col("declined_fraud_value") / fv).alias("value_detection_rate"),
        (F.col("declined_fraud_value") * recovery_rate
         - F.col("false_declines") * false_decline_cost
         - F.col("review_band") * review_cost).alias("estimated_loss_reduction"))


def score_curve(df: DataFrame, score: str = "risk_score", label: str = "is_fraud",
                n_buckets: int = 1024) -> DataFrame:
    """Per distinct score (descending): tp/fp at that score, cumulative
    ``cum_tp``/``cum_fp`` over all scores >= it, and totals ``n_pos``/``n_neg``."""
    y = F.col(label) == 1
    per = df.groupBy(F.col(score).alias("score")).agg(_cnt(y).alias("tp"), _cnt(~y).alias("fp"))
    # one row per distinct score, written once: everything below reads this table only
    per = materialize(with_quantile_bucket(materialize(per), "score", "_b", n_buckets,
                                           descending=True))
    offs = bucket_offsets(per, "_b", {"tp": F.sum("tp"), "fp": F.sum("fp")})
    w = Window.partitionBy("_b").orderBy(F.col("score").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    totals = per.agg(F.sum("tp").alias("n_pos"), F.sum("fp").alias("n_neg"))
    curve = (per.join(F.broadcast(offs), "_b")
                .withColumn("cum_tp", F.col("tp_before") + F.sum("tp").over(w))
                .withColumn("cum_fp", F.col("fp_before") + F.sum("fp").over(w))
                .drop("_b", "tp_before", "fp_before"))
    return attach_scalars(curve, totals)


def ranking_metrics(curve: DataFrame, fpr_targets=(0.01, 0.005)) -> DataFrame:
    """A6 average precision, A7 ROC AUC (ties at mid-rank), A8 recall at FPR."""
    P, N = F.col("n_pos"), F.col("n_neg")
    TP, FP = F.col("cum_tp"), F.col("cum_fp")
    prec = TP / (TP + FP)
    tpr, fpr = TP / P, FP / N
    aggs = [
        F.sum(F.col("tp") / P * prec).alias("pr_auc"),
        F.sum(F.col("fp") * (TP - F.col("tp") / 2.0) / (P * N)).alias("roc_auc"),
    ]
    for t in fpr_targets:
        name = "recall_at_" + str(t * 100).replace(".", "p").rstrip("0").rstrip("p") + "pct_fpr"
        aggs.append(F.coalesce(F.max(F.when(fpr <= t, tpr)), F.lit(0.0)).alias(name))
    return curve.agg(*aggs)


def evaluation_summary(df: DataFrame, score: str = "risk_score", label: str = "is_fraud",
                       amount: str = "amount") -> DataFrame:
    """A9 header plus A6-A8 and the decline-threshold value metrics, one row."""
    head = df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.col(label)).cast("long").alias("n_fraud"),
                  F.avg(F.col(label).cast("double")).alias("prevalence"))
    rank = ranking_metrics(score_curve(df, score, label))
    nb = net_benefit(df, score, label, amount)
    return attach_scalars(attach_scalars(head, rank), nb)


def attach_scalars(one_row: DataFrame, other: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame, read by one scalar subquery (no join)."""
    row = other.select(F.struct(*other.columns).alias("_row")).scalar()
    return one_row.withColumn("_row", row).select(*one_row.columns, "_row.*")


def champion_gate(df: DataFrame, champion: str | None, challenger: str,
                  label: str = "is_fraud", min_gain: float = CHAMPION_MIN_GAIN) -> DataFrame:
    """Challenger passes when its AP >= champion AP + min_gain; no champion passes."""
    ch = ranking_metrics(score_curve(df, challenger, label)).select(
        F.col("pr_auc").alias("challenger_pr_auc"))
    if champion is None:
        return ch.select("challenger_pr_auc", F.lit(None).cast("double").alias("champion_pr_auc"),
                         F.lit(True).alias("passed"))
    cp = ranking_metrics(score_curve(df, champion, label)).select(
        F.col("pr_auc").alias("champion_pr_auc"))
    return attach_scalars(ch, cp).withColumn(
        "passed", F.col("challenger_pr_auc") >= F.col("champion_pr_auc") + min_gain)


def class_weight(train: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Positive class weight max(neg / max(pos, 1), 1)."""
    y = F.col(label) == 1
    return train.agg(_cnt(y).alias("n_pos"), _cnt(~y).alias("n_neg")).withColumn(
        "pos_weight", F.greatest(F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)), F.lit(1.0)))

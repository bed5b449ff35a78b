"""Outcome fairness across segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.constants import (ADVERSE_IMPACT_RATIO_FLOOR, MAX_FPR_GAP, MAX_TPR_GAP,
                                MIN_POSITIVES_FOR_TPR, MIN_SEGMENT_SIZE, MIN_SELECTED_FOR_RATIO,
                                NOTE_FEW_SEGMENTS)
from cardlens.operators.decide import fixed_text


def segment_metrics(df: DataFrame, attribute: str = "customer_age_band", score: str = "risk_score",
                    label: str = "is_fraud", threshold: float = 0.86) -> DataFrame:
    """A10: one row per non-null segment value."""
    y = F.col(label) == 1
    flag = F.col(score) >= threshold
    agg = (df.filter(F.col(attribute).isNotNull())
             .groupBy(F.col(attribute).cast("string").alias("segment"))
             .agg(F.count(F.lit(1)).alias("n"),
                  F.count(F.when(y, 1)).alias("n_fraud"),
                  F.count(F.when(flag, 1)).alias("n_flagged"),
                  F.count(F.when(flag & y, 1)).alias("tp"),
                  F.count(F.when(flag & ~y, 1)).alias("fp"),
                  F.avg(F.col(score)).alias("mean_score")))
    n_legit = F.col("n") - F.col("n_fraud")
    return agg.select(
        "segment", "n", "n_fraud", "n_flagged",
        (F.col("n_flagged") / F.col("n")).alias("selection_rate"),
        F.when(F.col("n_fraud") >= MIN_POSITIVES_FOR_TPR, F.col("tp") / F.col("n_fraud"))
         .alias("true_positive_rate"),
        F.when(n_legit > 0, F.col("fp") / n_legit).otherwise(0.0).alias("false_positive_rate"),
        F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
         .alias("precision"),
        "mean_score",
        (F.col("n") >= MIN_SEGMENT_SIZE).alias("reliable"))


def bias_summary(segments: DataFrame, threshold: float = 0.86, max_fpr_gap: float = MAX_FPR_GAP,
                 max_tpr_gap: float = MAX_TPR_GAP) -> DataFrame:
    """A11 + A12: disparities over reliable segments, flags, notes and pass."""
    rel = segments.filter("reliable")
    s = rel.agg(
        F.count(F.lit(1)).alias("n_reliable"),
        F.max("selection_rate").alias("sel_max"), F.min("selection_rate").alias("sel_min"),
        F.max("n_flagged").alias("max_flagged"),
        F.max("false_positive_rate").alias("fpr_max"), F.min("false_positive_rate").alias("fpr_min"),
        F.count("true_positive_rate").alias("n_tpr"),
        F.max("true_positive_rate").alias("tpr_max"), F.min("true_positive_rate").alias("tpr_min"))
    enough = F.col("n_reliable") >= 2
    ratio_ok = enough & (F.col("max_flagged") >= MIN_SELECTED_FOR_RATIO)
    air = F.when(ratio_ok, F.col("sel_min") / F.greatest(F.col("sel_max"), F.lit(1e-9))).otherwise(1.0)
    disp = F.when(ratio_ok, F.col("sel_max") / F.greatest(F.col("sel_min"), F.lit(1e-9))).otherwise(0.0)
    fpr_gap = F.when(enough, F.col("fpr_max") - F.col("fpr_min")).otherwise(0.0)
    tpr_gap = F.when(enough & (F.col("n_tpr") >= 2), F.col("tpr_max") - F.col("tpr_min")).otherwise(0.0)
    out = s.select(F.lit(float(threshold)).alias("threshold"), "n_reliable",
                   disp.alias("selection_rate_disparity"), air.alias("adverse_impact_ratio"),
                   fpr_gap.alias("fpr_gap"), tpr_gap.alias("tpr_gap"), enough.alias("_enough"),
                   ratio_ok.alias("_ratio_ok"))
    a, fg, tg = F.col("adverse_impact_ratio"), F.col("fpr_gap"), F.col("tpr_gap")
    flags = F.array_compact(F.array(
        F.when(F.col("_enough") & (a < ADVERSE_IMPACT_RATIO_FLOOR), F.concat(
            F.lit("adverse impact ratio "), fixed_text(a, 3),
            F.lit(f" below the {ADVERSE_IMPACT_RATIO_FLOOR} four-fifths floor"))),
        F.when(F.col("_enough") & (fg > max_fpr_gap), F.concat(
            F.lit("false positive rate gap "), fixed_text(fg, 4),
            F.lit(f" exceeds {max_fpr_gap} - some segments are wrongly declined more often"))),
        F.when(F.col("_enough") & (tg > max_tpr_gap), F.concat(
            F.lit("true positive rate gap "), fixed_text(tg, 4),
            F.lit(f" exceeds {max_tpr_gap} - some segments receive less fraud protection"))),
    ))
    notes = F.array_compact(F.array(
        F.when(~F.col("_enough"), F.lit(NOTE_FEW_SEGMENTS)),
        F.when(F.col("_enough") & ~F.col("_ratio_ok"), F.lit(
            "selection-rate parity not assessed: no segment reaches "
            f"{MIN_SELECTED_FOR_RATIO} flagged transactions at this threshold")),
    ))
    return out.withColumn("flags", flags).withColumn("notes", notes) \
              .withColumn("passed", F.size("flags") == 0).drop("_enough", "_ratio_ok")


def flags_text(c: Column) -> Column:
    return F.concat_ws(" | ", c)

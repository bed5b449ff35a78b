"""End-to-end batch scoring (R4): features -> three detectors -> blend -> decision.

Stages (each a distributed Spark job):
features over the whole log (W3) -> time split (P6) -> M1 gradient-boosted
trees on train, class-weighted (A21), cut at the prefix that is best on
validation -> M2 isotonic calibration on validation
-> M3 isolation forest on legitimate train rows + A18/X2 calibration -> M4
sequence ridge on train rows with history + A18/X2, cold cards neutral (W2)
-> A19 reference medians on validation -> M5 blend -> R1/R2 decisions.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.constants import FEATURE_NAMES
from cardlens.functions.scoring import blend_logit, minmax_calibrate
from cardlens.models.iforest import fit_iforest, score_iforest
from cardlens.models.sequence import fit_sequence, score_sequence, with_windows
from cardlens.models.attribution import TreeTable, tree_table, with_contributions
from cardlens.models.isotonic import fit_isotonic
from cardlens.models.staged import best_prefix, prefix_precision, with_probability
from cardlens.operators.decide import decide, top_reasons
from cardlens.operators.evaluate import class_weight
from cardlens.operators.features import assert_model_inputs
from cardlens.operators.quantiles import column_quantiles, quantiles
from cardlens.plans.features import split_feature_table
from cardlens.session import materialize


def _bounds(df: DataFrame, col: str, lo_p: float, hi_p: float) -> tuple[float, float]:
    lo, hi = quantiles(df, col, [lo_p, hi_p])
    if lo is None:
        return 0.0, 1.0
    return lo, (hi if hi > lo else lo + 1e-6)


def fit_supervised(feats: DataFrame, gbt_iters: int = 40, seed: int = 17) -> tuple[TreeTable, DataFrame]:
    """M1 on the ``train`` split, class-weighted (A21); returns the trees up to
    the prefix with the highest average precision on ``valid`` (of at most
    ``gbt_iters``), and all rows with ``p_raw``."""
    assert_model_inputs(FEATURE_NAMES)
    assembler = VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="fvec")
    train = feats.filter(F.col("split") == "train")
    w = class_weight(train).first()["pos_weight"]
    weighted = assembler.transform(train).withColumn(
        "w", F.when(F.col("is_fraud") == 1, F.lit(float(w))).otherwise(1.0))
    gbt = GBTClassifier(featuresCol="fvec", labelCol="is_fraud", weightCol="w", maxIter=gbt_iters,
                        maxDepth=6, stepSize=0.05, minInstancesPerNode=120,
                        featureSubsetStrategy="0.8", subsamplingRate=0.8, seed=seed)
    table = tree_table(feats.sparkSession, gbt.fit(weighted))
    table = table.cut(best_prefix(prefix_precision(feats.filter(F.col("split") == "valid"), table)))
    return table, with_probability(feats, table, "p_raw")


def sequence_scores(feats: DataFrame) -> DataFrame:
    """M4 + A18/X2 + W2 over a feature table with ``split``."""
    train = feats.filter(F.col("split") == "train")
    mom = train.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(FEATURE_NAMES)],
                    *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(FEATURE_NAMES)]).first()
    mean = np.array([mom[f"m{i}"] for i in range(len(FEATURE_NAMES))], dtype=np.float64)
    std = np.array([mom[f"s{i}"] for i in range(len(FEATURE_NAMES))], dtype=np.float64)
    std = np.where(std < 1e-6, 1.0, std)
    win = with_windows(feats)
    seq_model = fit_sequence(win.filter(F.col("split") == "train"), mean, std)
    win = materialize(score_sequence(win, seq_model))
    slo, shi = _bounds(win.filter((F.col("split") == "train") & (F.col("is_fraud") == 0)
                                  & (F.col("n_hist") >= 2)), "sequence_raw", 0.05, 0.995)
    return win.withColumn("sequence_score", F.when(F.col("n_hist") < 2, F.lit(0.5)).otherwise(
        minmax_calibrate(F.col("sequence_raw"), slo, shi)))


def score_transactions(txn: DataFrame, gbt_iters: int = 40, n_trees: int = 300,
                       max_samples: int = 8192, seed: int = 17) -> DataFrame:
    feats = materialize(split_feature_table(txn))
    table, scored = fit_supervised(feats, gbt_iters, seed)
    scored = materialize(scored)

    # M2: isotonic calibration on validation (constant outside the fitted range)
    m2 = fit_isotonic(scored.filter(F.col("split") == "valid"), "p_raw", "is_fraud")
    scored = scored.withColumn("p_cal", m2.apply(F.col("p_raw")))

    # M3: isolation forest on legitimate training rows
    legit_train = scored.filter((F.col("split") == "train") & (F.col("is_fraud") == 0))
    forest = fit_iforest(legit_train, list(FEATURE_NAMES), n_trees, max_samples, seed)
    scored = score_iforest(scored, forest)
    scored = materialize(scored)
    lo, hi = _bounds(scored.filter((F.col("split") == "train") & (F.col("is_fraud") == 0)),
                     "iforest_raw", 0.01, 0.99)
    scored = scored.withColumn("anomaly_score", minmax_calibrate(F.col("iforest_raw"), lo, hi))

    # M4: sequence model on training rows with history
    win = sequence_scores(scored)

    # A19 reference medians on legitimate validation rows, then M5 + decisions
    vl = win.filter((F.col("split") == "valid") & (F.col("is_fraud") == 0))
    refs = column_quantiles(vl, {c: F.col(c) for c in ("anomaly_score", "sequence_score")},
                            {c: [0.5] for c in ("anomaly_score", "sequence_score")})
    ref_if, ref_seq = (refs.get(c, [0.5])[0] for c in ("anomaly_score", "sequence_score"))
    out = win.withColumn("supervised_score", F.col("p_cal")).withColumn(
        "risk_score", blend_logit(F.col("p_cal"), F.col("anomaly_score"), F.col("sequence_score"),
                                  F.lit(ref_if), F.lit(ref_seq)))
    decided = materialize(decide(out))

    # R3 + M7: reasons only for declines, attributed from the tree model, joined back
    declines = decided.filter(F.col("action") == "decline").select("transaction_id", *FEATURE_NAMES)
    reasons = with_contributions(declines, table).select(
        "transaction_id", top_reasons(F.col("contrib")).alias("reasons"))
    joined = decided.join(reasons, "transaction_id", "left")
    return joined.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))

"""Sequence anomaly model (M4), re-aimed as a multi-output ridge regression.

Predict the 15 "choice" features of a row from the previous 7 standardised
rows of the same card (zero padding after standardising).  Fitting needs only
``X'X`` and ``X'Y``: each partition sums them in ``mapInArrow`` (a 218 x 218
and a 218 x 15 matrix), one aggregate adds the partials, and the small solve
runs on the driver.  Raw score = mean squared error of the prediction;
calibrated with the 5 / 99.5 percentiles of legitimate training rows;
cards with fewer than 2 earlier rows get the neutral 0.5 (W2).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.constants import FEATURE_NAMES
from cardlens.models.batches import matrix, with_values
from cardlens.operators.sequence import sequence_window

# ---------------------------------------------------------------- FIXED VALUES
SEQ_TARGET_FEATURES = [
    "log_amount", "amount_zscore_card", "amount_ratio_card_mean", "hour_of_day", "is_night",
    "channel_is_ecom", "channel_is_atm", "entry_is_swipe", "entry_is_keyed", "is_cross_border",
    "is_new_merchant_for_card", "is_new_device_for_card", "is_new_country_for_card",
    "merchant_risk_score", "mcc_risk_score",
]
# ------------------------------------------------------------ END FIXED VALUES
HIST = 7
D = len(FEATURE_NAMES)
TARGET_IDX = np.array([FEATURE_NAMES.index(f) for f in SEQ_TARGET_FEATURES])


def with_windows(features: DataFrame) -> DataFrame:
    """Adds ``n_hist`` and ``wv``: up to 7 feature vectors of the rows before,
    oldest first (slice-split W1 operator)."""
    vec = F.array(*[F.col(n).cast("double") for n in FEATURE_NAMES])
    w = sequence_window(features, vec)
    return w.withColumn("n_hist", F.size("window")).withColumn("wv", F.col("window.value")).drop("window")


def _design(batch: pa.RecordBatch, mean: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    past = batch.column(batch.schema.get_field_index("wv"))
    size = pa.compute.list_value_length(past).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = past.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, D)
    n = batch.num_rows
    row = np.repeat(np.arange(n), size)
    # the last vector of a row stands at the end of its 7 places
    place = np.arange(len(raw)) - np.repeat(np.cumsum(size) - HIST, size)
    # standardise, then zero the padding (batch rule: padding is zero after scaling)
    wide = np.zeros((n, HIST, D))
    wide[row, place] = np.nan_to_num((raw - mean) / std, nan=0.0)
    x = np.ones((n, HIST * D + 1))                   # last column: intercept
    x[:, :-1] = wide.reshape(n, HIST * D)
    y = ((matrix(batch, list(FEATURE_NAMES)) - mean) / std)[:, TARGET_IDX]
    return x, y


class SequenceModel:
    def __init__(self, mean, std, coef, lo=0.0, hi=1.0):
        self.mean, self.std, self.coef, self.lo, self.hi = mean, std, coef, lo, hi

    def raw(self, batch: pa.RecordBatch) -> np.ndarray:
        x, y = _design(batch, self.mean, self.std)
        return np.mean((x @ self.coef - y) ** 2, axis=1)


def fit_sequence(train_windows: DataFrame, mean: np.ndarray, std: np.ndarray,
                 ridge: float = 1.0) -> SequenceModel:
    """Train on legitimate rows with at least 2 earlier rows."""
    rows = train_windows.filter((F.col("is_fraud") == 0) & (F.col("n_hist") >= 2))
    p = HIST * D + 1

    q = len(TARGET_IDX)

    def partial(batches):
        xtx = np.zeros((p, p))
        xty = np.zeros((p, q))
        seen = False
        for b in batches:
            x, y = _design(b, mean, std)
            xtx += x.T @ x
            xty += x.T @ y
            seen = True
        if seen:
            flat = np.concatenate([xtx.reshape(-1), xty.reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)),
                                              pa.array(flat, from_pandas=True)], names=["k", "v"])

    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])
    parts = rows.select("wv", *FEATURE_NAMES).mapInArrow(partial, schema)
    # p*p + p*q cells (about 51k): the normal equations are model-sized, not data-sized
    cells = parts.groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(p * p + p * q)
    flat[cells["k"].to_numpy()] = cells["v"].to_numpy()
    xtx = flat[:p * p].reshape(p, p)
    xty = flat[p * p:].reshape(p, q)
    coef = np.linalg.solve(xtx + ridge * np.eye(p), xty)
    return SequenceModel(mean, std, coef)


def score_sequence(windows: DataFrame, model: SequenceModel, out_col: str = "sequence_raw") -> DataFrame:
    """The rows with their score, without ``wv``."""
    bc = windows.sparkSession.sparkContext.broadcast(model)

    def fn(batches):
        m = bc.value
        for b in batches:
            yield with_values(b, out_col, m.raw(b), drop=("wv",))

    kept = [f for f in windows.schema.fields if f.name != "wv"]
    schema = T.StructType(kept + [T.StructField(out_col, T.DoubleType())])
    return windows.mapInArrow(fn, schema)

"""Score arithmetic as column expressions.

All of it stays inside whole-stage codegen: no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardlens.constants import (IFOREST_LOGIT_WEIGHT, LOGIT_EPS, MAX_LOGIT_ADJUSTMENT,
                                SEQUENCE_LOGIT_WEIGHT, SIGMOID_CLIP)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def logit(p: Column) -> Column:
    """log(p/(1-p)) with p clamped to [1e-6, 1-1e-6]."""
    q = clip(p, LOGIT_EPS, 1.0 - LOGIT_EPS)
    return F.log(q / (1.0 - q))


def sigmoid(z: Column) -> Column:
    """1/(1+exp(-z)) with z clipped to +-30."""
    return 1.0 / (1.0 + F.exp(-clip(z, -SIGMOID_CLIP, SIGMOID_CLIP)))


def logit_adjustment(s_if: Column, s_seq: Column, ref_if: Column | float = 0.5,
                     ref_seq: Column | float = 0.5) -> Column:
    """Bounded evidence from the two detectors, in log-odds."""
    adj = (IFOREST_LOGIT_WEIGHT * (s_if - ref_if) + SEQUENCE_LOGIT_WEIGHT * (s_seq - ref_seq))
    return clip(adj, -MAX_LOGIT_ADJUSTMENT, MAX_LOGIT_ADJUSTMENT)


def blend_logit(p_cal: Column, s_if: Column, s_seq: Column, ref_if: Column | float = 0.5,
                ref_seq: Column | float = 0.5) -> Column:
    """M5: sigmoid(logit(calibrated supervised) + clipped detector adjustment)."""
    return sigmoid(logit(p_cal) + logit_adjustment(s_if, s_seq, ref_if, ref_seq))


def minmax_calibrate(raw: Column, lo: Column | float, hi: Column | float) -> Column:
    """(raw - lo) / (hi - lo) clipped to [0, 1]."""
    return clip((raw - lo) / (F.lit(hi) - F.lit(lo)) if not isinstance(hi, Column)
                else (raw - lo) / (hi - lo), 0.0, 1.0)


def round6(c: Column) -> Column:
    return F.round(c, 6)

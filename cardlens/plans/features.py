"""Feature table over the whole log (W3): one pass, split afterwards.

Computing features over the full log once and splitting afterwards gives the
same rows as replaying train, validation and test in order with carried
state, because every feature only looks backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.constants import FEATURE_NAMES
from cardlens.operators.features import DEFAULT_BUCKET_DAYS, card_features
from cardlens.operators.lookups import merchant_counts, rated, with_counterparty
from cardlens.operators.split import with_split
from cardlens.session import materialize


def profile_from_train(txn: DataFrame) -> DataFrame:
    """A1 fitted on the training window only; the counts are written once, since
    both the join and the base rate read them."""
    return _profile(with_split(txn.select("seq", "event_us", "merchant_id", "is_fraud")))


def _profile(split: DataFrame) -> DataFrame:
    return rated(materialize(merchant_counts(split.filter(F.col("split") == "train"))))


def feature_table(txn: DataFrame, profile: DataFrame | None = None,
                  bucket_days: int = DEFAULT_BUCKET_DAYS) -> DataFrame:
    """All 31 features next to the transaction columns (plus ``history_len``)."""
    if profile is None:
        profile = profile_from_train(txn)
    return with_counterparty(card_features(txn, bucket_days=bucket_days), profile)


def split_feature_table(txn: DataFrame, bucket_days: int = DEFAULT_BUCKET_DAYS) -> DataFrame:
    """Time split (P6) once, profile from its train rows, then all features."""
    split = with_split(txn)
    return feature_table(split, _profile(split), bucket_days)


def feature_vector_columns() -> list[str]:
    return list(FEATURE_NAMES)

from __future__ import annotations

from cardlens.operators import features
from cardlens.sources.transactions import TXN_SCHEMA


def test_helper_keys_do_not_travel_with_the_row(spark, monkeypatch):
    """The keys of the windows stand beside the transaction; a second copy
    inside it would go through every sort and shuffle."""
    kept, timeline = [], features._timeline

    def watched(rows, bucket_us, keep):
        kept.extend(keep)
        return timeline(rows, bucket_us, keep)
    monkeypatch.setattr(features, "_timeline", watched)
    row = ("t1", 1, 10, "c", "u", "m", "x", "US", 5.0, "USD", "pos", "chip", "d", "US", "18-25", 0)
    out = features.card_features(spark.createDataFrame([row], TXN_SCHEMA))
    helpers = {"bucket", "merchant_key", "country_key", "device_key"}
    assert set(TXN_SCHEMA.names) <= set(kept) and not helpers & set(kept)
    assert set(kept) <= set(out.columns) and not helpers & set(out.columns)
    assert out.first()["transaction_id"] == "t1"

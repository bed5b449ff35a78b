from __future__ import annotations

import __spark_entry__ as entry_mod


def test_entry_and_registry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "card_txn_count_1h" in df.columns
    qs, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80

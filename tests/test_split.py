from __future__ import annotations

import random

import pytest

from cardlens.operators.lookups import merchant_profile
from cardlens.operators.split import keys_at, time_split, with_split
from cardlens.plans.features import profile_from_train
from cardlens.sources.bindings import txn
from tests.conftest import SF_SMALL


def _table(spark, keys):
    return spark.createDataFrame(keys, "event_us long, seq long")


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_keys_equal_sorted_order(spark, bins):
    rng = random.Random(bins)
    keys = [(rng.choice([5, 5, 5, -40, rng.randrange(10 ** 15), rng.randrange(90)]), i)
            for i in rng.sample(range(10 ** 6), 300)]
    keys += [(2 ** 62, 1), (-2 ** 62, 2)]
    ranks = [0, 1, 17, 150, 151, len(keys) - 1, len(keys)]
    want = [*(sorted(keys)[r] for r in ranks[:-1]), None]
    assert keys_at(_table(spark, keys).repartition(3), ranks, bins=bins) == want


def test_split_equals_ranking(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 10, 333):
        keys = [(rng.randrange(max(1, n // 4)), i) for i in range(n)]
        df = _table(spark, keys)
        got = {tuple(r)[:2]: r["split"] for r in with_split(df).collect()}
        want = {tuple(r)[:2]: r["split"] for r in time_split(df).drop("global_rank").collect()}
        assert got == want and len(got) == n


def test_equal_and_missing_keys_stay_together(spark):
    df = _table(spark, [(None, 1), (None, 2), (3, 1), (3, 1), (3, 1), (3, 1), (9, None), (9, 4)])
    by_key = {}
    for r in with_split(df).collect():
        by_key.setdefault((r["event_us"], r["seq"]), set()).add(r["split"])
    assert all(len(v) == 1 for v in by_key.values()) and by_key[None, 1] == {"train"}


def test_split_has_no_window_and_no_shuffle(spark, capsys):
    with_split(txn(spark, SF_SMALL)).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Exchange" not in plan


def test_profile_of_train_rows(spark):
    t = txn(spark, SF_SMALL)
    key = lambda df: sorted(map(tuple, df.select(
        "merchant_id", "fraud_count", "total_count", "base_rate", "merchant_risk").collect()))
    assert key(profile_from_train(t)) == key(merchant_profile(with_split(t).where("split = 'train'")))

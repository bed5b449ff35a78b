from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cardlens.functions.scoring import blend_logit
from cardlens.operators.decide import base_action, decide, top_reasons

RULE_COLS = "risk_score double, amount double, card_txn_count_1h double, card_distinct_countries_7d double, " \
            "is_new_device_for_card double, entry_is_swipe double, is_cross_border double"


@pytest.mark.parametrize("score,action", [(0.05, "approve"), (0.34, "approve"), (0.35, "step_up"),
                                          (0.54, "step_up"), (0.55, "review"), (0.85, "review"),
                                          (0.86, "decline"), (0.99, "decline")])
def test_bands(spark, score, action):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(base_action(F.col("s"))).first()[0] == action


def _decide(spark, rows):
    return [r.asDict() for r in decide(spark.createDataFrame(rows, RULE_COLS)).collect()]


def test_rules_escalate_only_and_list_in_order(spark):
    rows = [
        (0.1, 10.0, 6.0, 1.0, 0.0, 0.0, 0.0),      # card testing -> review
        (0.1, 100.0, 2.0, 3.0, 0.0, 0.0, 0.0),     # multi country -> review
        (0.1, 3000.0, 0.0, 1.0, 1.0, 0.0, 0.0),    # high value new device -> step_up
        (0.1, 100.0, 0.0, 1.0, 0.0, 1.0, 1.0),     # cross-border swipe -> review
        (0.9, 10.0, 6.0, 3.0, 0.0, 1.0, 1.0),      # decline stays decline; all fired rules listed
        (0.6, 3000.0, 0.0, 1.0, 1.0, 0.0, 0.0),    # review is not lowered by a step_up rule
    ]
    out = _decide(spark, rows)
    assert [o["action"] for o in out] == ["review", "review", "step_up", "review", "decline", "review"]
    assert out[4]["triggered_rules"] == ["velocity.card_testing_burst", "geo.multi_country_velocity",
                                         "counterfeit.cross_border_swipe"]
    assert out[5]["triggered_rules"] == ["ato.high_value_new_device"]


def test_reason_codes_ranked_by_magnitude(spark):
    df = spark.createDataFrame([({"amount": 0.5, "card_txn_count_1h": -1.25, "zz_unknown": 0.1},)],
                               "c map<string,double>")
    got = df.select(top_reasons(F.col("c"), 2)).first()[0]
    assert got == ["high transaction count in the last hour (-1.250)", "transaction amount (+0.500)"]
    got1 = df.select(top_reasons(F.col("c"), 3)).first()[0]
    assert got1[-1] == "zz_unknown (+0.100)"


def test_blend_properties(spark):
    df = spark.createDataFrame([(p, a, b) for p in (0.001, 0.2, 0.7) for a in (0.0, 0.5, 1.0)
                                for b in (0.0, 0.5, 1.0)], "p double, a double, b double")
    rows = df.select("p", "a", "b", blend_logit(F.col("p"), F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        assert 0.0 < r["r"] < 1.0
        if r["a"] == 0.5 and r["b"] == 0.5:
            assert abs(r["r"] - r["p"]) < 1e-9          # neutral detectors leave the base
    by = {(r["p"], r["a"], r["b"]): r["r"] for r in rows}
    assert by[(0.2, 1.0, 0.5)] > by[(0.2, 0.5, 0.5)] > by[(0.2, 0.0, 0.5)]   # monotone

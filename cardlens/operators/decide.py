"""Score -> action, rule overlay, reason codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.constants import (ACTION_RANK, DECLINE_AT, FEATURE_NAMES, HIGH_VALUE_AMOUNT,
                                REASON_TEXT, REVIEW_AT, RULE_CARD_TESTING,
                                RULE_CROSS_BORDER_SWIPE, RULE_HIGH_VALUE_NEW_DEVICE,
                                RULE_MULTI_COUNTRY, STEP_UP_AT)

_NAMES = ["approve", "step_up", "review", "decline"]


def base_action(score: Column, decline_at: float = DECLINE_AT, review_at: float = REVIEW_AT,
                step_up_at: float = STEP_UP_AT) -> Column:
    """>= decline_at decline, >= review_at review, >= step_up_at step_up, else approve."""
    return (F.when(score >= decline_at, "decline").when(score >= review_at, "review")
             .when(score >= step_up_at, "step_up").otherwise("approve"))


def _rank(action: Column) -> Column:
    m = []
    for k, v in ACTION_RANK.items():
        m += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*m), action)


def _rules(high_value: float) -> list[tuple[Column, str, str]]:
    c1h = F.col("card_txn_count_1h")
    return [
        ((c1h >= 5) & (F.col("amount") < 20), "review", RULE_CARD_TESTING),
        ((F.col("card_distinct_countries_7d") >= 3) & (c1h >= 2), "review", RULE_MULTI_COUNTRY),
        ((F.col("amount") >= high_value) & (F.col("is_new_device_for_card") == 1.0), "step_up",
         RULE_HIGH_VALUE_NEW_DEVICE),
        ((F.col("entry_is_swipe") == 1.0) & (F.col("is_cross_border") == 1.0), "review",
         RULE_CROSS_BORDER_SWIPE),
    ]


def decide(df: DataFrame, score_col: str = "risk_score",
           high_value: float = HIGH_VALUE_AMOUNT) -> DataFrame:
    """R2: base action, then rules that only escalate; every fired rule listed in order.

    Needs ``amount`` and the rule features next to the score.
    """
    rules = _rules(high_value)
    fired = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
                                      for cond, _, name in rules]))
    ranks = [_rank(F.col("base_action"))] + [
        F.when(F.coalesce(cond, F.lit(False)), F.lit(ACTION_RANK[to])).otherwise(0)
        for cond, to, _ in rules]
    names = F.array(*[F.lit(n) for n in _NAMES])
    return (df.withColumn("base_action", base_action(F.col(score_col)))
              .withColumn("triggered_rules", fired)
              .withColumn("action", names[F.greatest(*ranks)]))


def _reason_map() -> Column:
    m = []
    for k, v in REASON_TEXT.items():
        m += [F.lit(k), F.lit(v)]
    return F.create_map(*m)


def top_reasons(contrib: Column, k: int = 4) -> Column:
    """Top-k entries by |contribution| (ties keep map order), rendered
    ``"<reason text> (+0.123)"``; unknown names pass through (J4)."""
    entries = F.map_entries(contrib)
    keyed = F.transform(entries, lambda e, i: F.struct(
        (-F.abs(e["value"])).alias("k"), i.alias("i"), e["key"].alias("name"),
        e["value"].alias("value")))
    top = F.slice(F.array_sort(keyed), 1, k)
    text = _reason_map()
    return F.transform(top, lambda e: F.format_string(
        "%s (%+.3f)", F.coalesce(F.element_at(text, e["name"]), e["name"]), e["value"]))


def feature_snapshot(df: DataFrame) -> Column:
    """Map feature name -> value, in model order."""
    m = []
    for n in FEATURE_NAMES:
        m += [F.lit(n), F.col(n)]
    return F.create_map(*m)


def fixed_text(v: Column, decimals: int) -> Column:
    """Decimal text of ``v`` rounded half-up at ``decimals`` places, computed
    with integer arithmetic so every engine prints the same digits."""
    scale = 10 ** decimals
    q = F.floor(F.abs(v) * scale + 0.5).cast("long")
    sign = F.when((v < 0) & (q > 0), "-").otherwise("")
    return F.format_string(f"%s%d.%0{decimals}d", sign, F.floor(q / scale).cast("long"),
                           F.pmod(q, F.lit(scale)))


def top_features(snapshot: Column, k: int = 12) -> Column:
    """T4: the k features of largest magnitude, ``"name = 1.2345"``."""
    keyed = F.transform(F.map_entries(snapshot), lambda e, i: F.struct(
        (-F.abs(e["value"])).alias("k"), i.alias("i"), e["key"].alias("name"),
        e["value"].alias("value")))
    top = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(top, lambda e: F.concat(e["name"], F.lit(" = "), fixed_text(e["value"], 4)))


def with_decline_reasons(df: DataFrame, contrib_col: str = "contrib", explain_col: str | None = None,
                         k: int = 4) -> DataFrame:
    """Reasons only for declines (or rows that ask for them); others get an empty list."""
    want = F.col("action") == "decline"
    if explain_col:
        want = want | F.coalesce(F.col(explain_col), F.lit(False))
    return df.withColumn("reasons", F.when(want, top_reasons(F.col(contrib_col), k))
                         .otherwise(F.array().cast("array<string>")))

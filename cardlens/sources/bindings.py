"""Bindings: the driver's tables mapped onto the card-transaction data model.

``txn`` turns the ``events`` table into an authorisation log (one event = one
transaction, ``user_id`` = card). ``scored`` adds deterministic pseudo-scores so
that decisions, evaluation, fairness and audit operators can be checked
without a trained model. Every expression here has an exact DuckDB twin in
``cardlens.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.functions.scoring import blend_logit
from cardlens.sources.tables import read_table

EPOCH_2024_US = 1704067200000000
COMPRESSED_USER_MOD = 10   # every tenth card's time axis is compressed ...
COMPRESSION = 72           # ... 72-fold, so hourly bursts exist

CATEGORIES = ["grocery", "fuel", "restaurant", "electronics", "travel", "apparel",
              "digital_goods", "pharmacy", "gambling", "money_transfer"]
COUNTRIES = ["US", "CA", "GB", "DE", "FR", "MX", "BR", "IN", "NG", "RO"]
ENTRY = ["chip", "contactless", "swipe", "keyed", "token"]
AGE_BANDS = ["18-25", "26-40", "41-60", "60+"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[idx.cast("int")]


def txn_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select("event_id", "user_id", "event_type", "value", k.alias("k"), us.alias("us"))
    event_us = F.when(F.col("user_id") % COMPRESSED_USER_MOD == 0,
                      F.lit(EPOCH_2024_US) + F.expr(f"(us - {EPOCH_2024_US}) div {COMPRESSION}")
                      ).otherwise(F.col("us"))
    eid = F.col("event_id")
    return e.select(
        F.concat(F.lit("txn_"), eid).alias("transaction_id"),
        eid.alias("seq"),
        event_us.alias("event_us"),
        F.concat(F.lit("card_"), F.col("user_id")).alias("card_id"),
        F.concat(F.lit("cust_"), F.col("user_id")).alias("customer_id"),
        F.concat(F.lit("mch_"), F.col("k") % 40).alias("merchant_id"),
        _pick(CATEGORIES, F.col("k") % 10).alias("merchant_category"),
        F.when(eid % 13 == 0, _pick(COUNTRIES, F.col("k") % 10)).otherwise(F.lit("US"))
         .alias("merchant_country"),
        (F.col("value") * 10.0).alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(F.col("event_type").isin("view", "purchase"), "pos")
         .when(F.col("event_type").isin("click", "error"), "ecom")
         .otherwise("atm").alias("channel"),
        _pick(ENTRY, eid % 5).alias("entry_mode"),
        F.when(eid % 17 == 0, F.lit(None).cast("string"))
         .when(eid % 7 == 0, F.concat(F.lit("dev_x"), F.col("k")))
         .otherwise(F.concat(F.lit("dev_"), F.col("user_id"))).alias("device_id"),
        F.lit("US").alias("issuer_country"),
        _pick(AGE_BANDS, F.col("user_id") % 4).alias("customer_age_band"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 60), 1).otherwise(0)
         .alias("is_fraud"),
    )


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn_from_events(read_table(spark, sf_dir, "events"))


def unit_hash(salt: str, key: Column) -> Column:
    """Deterministic uniform [0,1) from md5(salt || key)."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10)
            .cast("double") / 4294967296.0)


def with_pseudo_scores(t: DataFrame) -> DataFrame:
    """Deterministic stand-ins for the three model outputs plus their blend."""
    h_a = unit_hash("a", F.col("seq"))
    p_sup = F.least(F.lit(0.999),
                    0.55 * h_a * h_a + 0.42 * F.col("is_fraud")
                    + F.when(F.col("customer_age_band") == "60+", 0.05).otherwise(0.0))
    out = (t.withColumn("p_sup", p_sup)
            .withColumn("s_if", unit_hash("b", F.col("seq")))
            .withColumn("s_seq", unit_hash("c", F.col("seq"))))
    return out.withColumn("risk_score", blend_logit(F.col("p_sup"), F.col("s_if"), F.col("s_seq")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pseudo_scores(txn(spark, sf_dir))


CONTRIB_FEATURES = ["amount", "card_txn_count_1h", "amount_zscore_card", "merchant_risk_score",
                    "is_new_device_for_card", "card_velocity_ratio", "mcc_risk_score",
                    "hour_deviation_card"]


def with_contributions(t: DataFrame) -> DataFrame:
    """Map of 8 feature names -> signed pseudo-contribution ``(h(name)-0.5)*4``."""
    entries = []
    for name in CONTRIB_FEATURES:
        entries += [F.lit(name), (unit_hash(name, F.col("seq")) - 0.5) * 4.0]
    return t.withColumn("contrib", F.create_map(*entries))

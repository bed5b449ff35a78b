"""Structured Streaming jobs (S3, S5, ST1-ST9, A24).

Source: JSON transaction messages (a file folder here; ``kafka`` in
production - no connector jar is installed in this environment, so the file
source stands in; offsets are checkpointed either way, replacing manual
commits).  The valid / quarantine split is the batch contract check (P1),
so a bad message is counted and skipped while the stream goes on (ST4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.operators.contract import check_contract
from cardlens.operators.features import intrinsic_columns, mcc_risk
from cardlens.sources.transactions import TXN_SCHEMA
from cardlens.streaming.card_state import EXPIRY_MS, card_feature_stream

MESSAGE_SCHEMA = T.StructType(TXN_SCHEMA.fields + [T.StructField("commit", T.BooleanType())])


def read_messages(spark: SparkSession, source: str, max_files_per_trigger: int | None = None,
                  fmt: str = "json") -> DataFrame:
    """S3: streaming transactions with the fixed schema; malformed lines become
    rows of nulls (PERMISSIVE) and fail the contract check."""
    r = spark.readStream.schema(MESSAGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.format(fmt).option("mode", "PERMISSIVE").load(source)


def feature_stream(messages: DataFrame) -> DataFrame:
    """ST1 on the valid messages: one feature row per transaction (append mode)."""
    checked = check_contract(messages)
    return card_feature_stream(checked.filter("valid").drop("violations", "valid"))


def quarantine(messages: DataFrame) -> DataFrame:
    """ST4: rows that fail the contract, with their violation codes."""
    checked = check_contract(messages)
    return checked.filter(~F.col("valid")).withColumn("violations", F.concat_ws(",", "violations"))


def start_feature_sink(spark: SparkSession, source: str, out_path: str, checkpoint: str,
                       available_now: bool = True, max_files_per_trigger: int | None = None,
                       expiry_ms: int | None = EXPIRY_MS, ordered: bool = False):
    """ST1 + S5: card features landed as parquet partitioned by event date, with
    ``created_at``; the checkpoint makes state and offsets exactly-once (ST5/ST6)."""
    msgs = read_messages(spark, source, max_files_per_trigger)
    checked = check_contract(msgs)
    valid = checked.filter("valid").drop("violations", "valid")
    feats = card_feature_stream(valid, expiry_ms, ordered).withColumns({
        "created_at": F.current_timestamp(),
        "event_date": F.to_date(F.timestamp_micros("event_us")),
    })
    w = (feats.writeStream.format("parquet").option("path", out_path)
              .option("checkpointLocation", checkpoint).partitionBy("event_date").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_quarantine_sink(spark: SparkSession, source: str, out_path: str, checkpoint: str,
                          available_now: bool = True):
    msgs = read_messages(spark, source, None)
    w = (quarantine(msgs).writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def decisions_by_hour_stream(decisions: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """A24 as a stream: decisions per (hour, action), finalised once the watermark passes."""
    d = decisions.withColumn("event_time", F.timestamp_micros("event_us"))
    return (d.withWatermark("event_time", watermark)
             .groupBy(F.window("event_time", "1 hour"), "action").count())


def late_rows(landed: DataFrame, emitted: DataFrame, watermark_us: int) -> DataFrame:
    """ST9 late table (batch): landed raw rows older than the watermark that
    never produced a feature row."""
    old = landed.filter(F.col("event_us") < F.lit(watermark_us))
    return old.join(emitted.select("transaction_id"), "transaction_id", "left_anti")


def intrinsic_and_counterparty(card_rows: DataFrame, txn: DataFrame, profile: DataFrame) -> DataFrame:
    """Complete the 31-column vector for streamed card features (batch side of ST8)."""
    t = txn.select("transaction_id", "merchant_id", "merchant_category", "merchant_country",
                   "issuer_country", "amount", "channel", "entry_mode", "event_us")
    j = card_rows.drop("event_us").join(t, "transaction_id").withColumns(intrinsic_columns())
    prof = profile.select("merchant_id", "merchant_risk", "total_count")
    base_rate = profile.agg(F.first("base_rate")).scalar()
    return j.join(prof, "merchant_id", "left").withColumns({
        "merchant_risk_score": F.coalesce(F.col("merchant_risk"), base_rate),
        "merchant_log_volume": F.log1p(F.coalesce(F.col("total_count"), F.lit(0.0))),
        "mcc_risk_score": mcc_risk(F.col("merchant_category")),
    }).drop("merchant_risk", "total_count")


def start_decision_stream(spark: SparkSession, source: str, out_path: str, checkpoint: str,
                          profile: DataFrame, score_fn, available_now: bool = True,
                          expiry_ms: int | None = EXPIRY_MS, max_files_per_trigger: int | None = None):
    """ST8: streamed card features -> intrinsic + counterparty features ->
    ``score_fn`` (adds ``risk_score``) -> decisions, per micro-batch.

    Each micro-batch is written to its own ``batch_id=`` folder with overwrite,
    so a retried batch replaces its own output (idempotent sink).
    """
    from cardlens.operators.decide import decide
    from cardlens.operators.lookups import with_counterparty

    msgs = read_messages(spark, source, max_files_per_trigger)
    checked = check_contract(msgs)
    feats = card_feature_stream(checked.filter("valid").drop("violations", "valid"), expiry_ms)

    def process(batch: DataFrame, batch_id: int) -> None:
        f = with_counterparty(batch.withColumns(intrinsic_columns()), profile)
        d = decide(score_fn(f))
        (d.select("transaction_id", "card_id", "event_us", "risk_score", "base_action", "action",
                  "triggered_rules")
          .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}"))

    w = feats.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

"""Transaction log schema, scan and write.

The log is keyed by ``card_id`` and ordered by ``(event_us, seq)``: ``event_us``
is the event time in UTC microseconds and ``seq`` a unique, monotone arrival
number that breaks ties between rows at the same instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TXN_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("event_us", T.LongType(), True),
    T.StructField("card_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("merchant_id", T.StringType(), False),
    T.StructField("merchant_category", T.StringType(), True),
    T.StructField("merchant_country", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("entry_mode", T.StringType(), True),
    T.StructField("device_id", T.StringType(), True),
    T.StructField("issuer_country", T.StringType(), True),
    T.StructField("customer_age_band", T.StringType(), True),
    T.StructField("is_fraud", T.IntegerType(), True),
])

TXN_COLUMNS = [f.name for f in TXN_SCHEMA.fields]


def with_event_time(txn: DataFrame) -> DataFrame:
    """Add a ``timestamp`` column for sinks and event-time windows."""
    return txn.withColumn("event_time", F.timestamp_micros("event_us"))


def with_event_us(df: DataFrame, ts_col: str = "event_time") -> DataFrame:
    """Normalise an event-time column to UTC microseconds.

    ``timestamp_ntz`` values are read as UTC wall time; numbers are epoch
    seconds; a null stays null (the contract check rejects it, never "now").
    """
    dtype = df.schema[ts_col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    elif isinstance(dtype, T.NumericType):
        us = (F.col(ts_col).cast("double") * 1_000_000).cast("long")
    else:
        us = F.unix_micros(F.to_timestamp(F.col(ts_col)))
    return df.withColumn("event_us", us)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Scan a transaction table written by :func:`write_transactions`."""
    schema = T.StructType(TXN_SCHEMA.fields + [T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def write_transactions(txn: DataFrame, path: str, mode: str = "append") -> None:
    """Write the log partitioned by event date, so time filters prune files."""
    (txn.withColumn("event_date", F.to_date(F.timestamp_micros("event_us")))
        .write.mode(mode).partitionBy("event_date").parquet(path))

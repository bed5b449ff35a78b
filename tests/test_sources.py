"""Transaction sources, missing times, late rows, replay (S2, P2, P3, A24, ST7, ST9)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from cardlens.operators.contract import fill_missing_time, split_valid
from cardlens.sources.bindings import txn
from cardlens.sources.transactions import (TXN_COLUMNS, read_transactions, with_event_us,
                                           write_transactions)
from cardlens.streaming.jobs import (decisions_by_hour_stream, feature_stream, late_rows,
                                     read_messages)
from tests.conftest import SF_SMALL


def test_event_time_forms_agree(spark):
    df = spark.sql("""SELECT timestamp'2024-01-01 00:00:01.5' AS ts, timestamp_ntz'2024-01-01 00:00:01.5' AS ntz,
                      1704067201.5D AS num, '2024-01-01T00:00:01.5Z' AS txt, CAST(NULL AS timestamp) AS nul""")
    want = 1_704_067_201_500_000
    for c in ("ts", "ntz", "num", "txt"):
        assert with_event_us(df, c).first()["event_us"] == want, c
    assert with_event_us(df, "nul").first()["event_us"] is None


def test_missing_time_is_filled_only_on_request(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "i int, event_us long")
    assert fill_missing_time(df).where("event_us is null").count() == 1
    filled = {r["i"]: r["event_us"] for r in fill_missing_time(df, True).collect()}
    assert filled[1] > 1_700_000_000_000_000 and filled[2] == 5


def test_transactions_round_trip_and_prune(spark, tmp_path):
    t = txn(spark, SF_SMALL).select(*TXN_COLUMNS)
    path = str(tmp_path / "log")
    write_transactions(t, path)
    back = read_transactions(spark, path)
    assert back.select(*TXN_COLUMNS).exceptAll(t).isEmpty() and back.count() == t.count()
    day = back.agg(F.min("event_date")).first()[0]
    plan = back.where(F.col("event_date") == F.lit(day))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    good, bad = split_valid(t)
    assert good.count() + bad.count() == t.count()


def test_late_rows(spark):
    landed = spark.createDataFrame([("a", 10), ("b", 20), ("c", 99)], "transaction_id string, event_us long")
    emitted = landed.where("transaction_id = 'a'")
    assert [r["transaction_id"] for r in late_rows(landed, emitted, 50).collect()] == ["b"]


def _stream_to_rows(spark, stream, name):
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="cardlens-mem-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.table(name).collect()


def test_replay_with_a_new_checkpoint_rebuilds_the_same_features(spark):
    src = tempfile.mkdtemp(prefix="cardlens-replay-")
    rows = txn(spark, SF_SMALL).orderBy("event_us", "seq").limit(300)
    rows.coalesce(1).write.mode("overwrite").json(os.path.join(src, "in"))
    a, b = ({r["transaction_id"]: r for r in _stream_to_rows(
        spark, feature_stream(read_messages(spark, os.path.join(src, "in"))), f"replay_{i}")}
        for i in (1, 2))
    assert a == b and len(a) == 300


def test_hourly_decisions_stream(spark):
    src = tempfile.mkdtemp(prefix="cardlens-hours-")
    hour = 3_600_000_000
    rows = [("approve", 0), ("approve", 10), ("decline", hour - 1), ("approve", hour), ("approve", 9 * hour)]
    df = spark.createDataFrame(rows, "action string, event_us long")
    df.coalesce(1).write.mode("overwrite").json(os.path.join(src, "in"))
    stream = spark.readStream.schema(df.schema).json(os.path.join(src, "in"))
    out = {(r["window"]["start"].hour, r["action"]): r["count"]
           for r in _stream_to_rows(spark, decisions_by_hour_stream(stream), "hours")}
    assert out == {(0, "approve"): 2, (0, "decline"): 1, (1, "approve"): 1}

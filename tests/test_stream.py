"""Stream = batch: the keyed streaming state gives the batch features row for row
(with idle expiry off, the batch-replay semantics), and idle cards expire."""

from __future__ import annotations

import json
import math
import os
import tempfile
import time

from pyspark.sql import functions as F

from cardlens.operators.features import card_features
from cardlens.sources.bindings import txn
from cardlens.streaming.card_state import CARD_FEATURES
from cardlens.streaming.jobs import start_feature_sink, start_quarantine_sink
from tests.conftest import SF_SMALL


def _write_parts(rows, folder, n_parts, start=0):
    rows = sorted(rows, key=lambda r: (r["event_us"], r["seq"]))
    size = -(-len(rows) // n_parts)
    for i in range(n_parts):
        part = rows[i * size:(i + 1) * size]
        with open(os.path.join(folder, f"part-{start + i:03d}.json"), "w") as fh:
            for r in part:
                fh.write(json.dumps(r) + "\n")
        t = time.time() - 1000 + start + i
        os.utime(os.path.join(folder, f"part-{start + i:03d}.json"), (t, t))


def _check(spark, out_path, batch):
    got = {r["transaction_id"]: r.asDict() for r in spark.read.parquet(out_path).collect()}
    want = {r["transaction_id"]: r.asDict() for r in batch.collect()}
    assert set(got) == set(want)
    for tid, w in want.items():
        for k in CARD_FEATURES:
            assert math.isclose(got[tid][k], w[k], rel_tol=1e-9, abs_tol=1e-7), (tid, k, got[tid][k], w[k])


def test_stream_equals_batch_with_restart_and_poison(spark):
    t = txn(spark, SF_SMALL).withColumn("commit", F.col("seq") % 19 != 0)
    rows = [r.asDict() for r in t.collect()]
    root = tempfile.mkdtemp(prefix="cardlens-stream-")
    src, out, ckpt = (os.path.join(root, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    first = sorted(rows, key=lambda r: (r["event_us"], r["seq"]))
    half = len(first) // 2
    _write_parts(first[:half], src, 2, 0)
    q = start_feature_sink(spark, src, out, ckpt, expiry_ms=None, max_files_per_trigger=1)
    q.awaitTermination(300)
    # restart from the same checkpoint with more data and three broken lines
    _write_parts(first[half:], src, 2, 2)
    with open(os.path.join(src, "part-099.json"), "w") as fh:
        fh.write('{"transaction_id": "bad1", "amount": -5}\nnot json at all\n{"card_id": null}\n')
    q = start_feature_sink(spark, src, out, ckpt, expiry_ms=None, max_files_per_trigger=1)
    q.awaitTermination(300)
    assert q.exception() is None
    _check(spark, out, card_features(t))
    qq = start_quarantine_sink(spark, src, os.path.join(root, "bad"), os.path.join(root, "bad_ckpt"))
    qq.awaitTermination(300)
    assert spark.read.parquet(os.path.join(root, "bad")).count() == 3


def test_rows_out_of_order_within_the_watermark_are_put_in_order(spark):
    import random

    from tests.test_features import T0, _frame, _row
    rng = random.Random(4)
    minute = 60_000_000
    rows = [_row(i, T0 + i * minute // 2, card=f"card_{i % 3}", merchant=f"m{i % 5}") for i in range(60)]
    # each file holds the rows of three minutes in any order, one row in four slips into the next file
    parts = [[] for _ in range(11)]
    for i, r in enumerate(rows):
        parts[min(10, i // 6 + (rng.random() < 0.25))].append(r)
    flush = [_row(1000 + k, T0 + (9 + k) * 24 * 60 * minute, card="other") for k in range(2)]
    root = tempfile.mkdtemp(prefix="cardlens-order-")
    src, out, ckpt = (os.path.join(root, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    for i, part in enumerate([*parts, [flush[0]], [flush[1]]]):
        rng.shuffle(part)
        with open(os.path.join(src, f"part-{i:03d}.json"), "w") as fh:
            fh.writelines(json.dumps(r) + "\n" for r in part)
        t = time.time() - 1000 + i
        os.utime(os.path.join(src, f"part-{i:03d}.json"), (t, t))
    q = start_feature_sink(spark, src, out, ckpt, expiry_ms=None, max_files_per_trigger=1, ordered=True)
    q.awaitTermination(300)
    assert q.exception() is None
    got = {r["transaction_id"]: r for r in spark.read.parquet(out).collect()}
    want = {r["transaction_id"]: r for r in card_features(_frame(spark, rows)).collect()}
    assert set(want) <= set(got)
    for k, w in want.items():
        for f in CARD_FEATURES:
            assert math.isclose(got[k][f], w[f], rel_tol=1e-9, abs_tol=1e-7), (k, f)


def test_window_keeps_exact_sums_and_peaks():
    import random

    from cardlens.streaming.card_state import Window
    rng = random.Random(5)
    w, events, now = Window(1000, 3), [], 0
    for _ in range(3000):
        now += rng.randint(0, 40)
        w.move_to(now)
        alive = [e for e in events if e[0] >= now - 1000]
        assert w.count == len(alive) and w.largest == max((e[2] for e in alive), default=0.0)
        assert math.isclose(w.total, math.fsum(e[2] for e in alive), abs_tol=1e-9)
        assert w.distinct(0) == len({e[3] for e in alive})
        e = (now, len(events), rng.choice([0.1, 7.25, rng.random() * 1000]), rng.choice("abcd"))
        events.append(e)
        w.add(e)


def test_idle_card_state_expires_after_8_days(spark):
    from tests.test_features import T0, _row
    day = 86_400_000_000
    a1 = _row(0, T0, card="card_a", merchant="m1")
    b1 = _row(1, T0 + 9 * day, card="card_b", merchant="m9")      # moves the watermark
    a2 = _row(2, T0 + 9 * day + 3_600_000_000, card="card_a", merchant="m1")
    root = tempfile.mkdtemp(prefix="cardlens-expiry-")
    src, out, ckpt = (os.path.join(root, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    for i, rows in enumerate([[a1], [b1], [a2]]):
        rows = [{k: v for k, v in r.items()} for r in rows]
        _write_parts(rows, src, 1, i)
    q = start_feature_sink(spark, src, out, ckpt, max_files_per_trigger=1)
    q.awaitTermination(300)
    got = {r["transaction_id"]: r for r in spark.read.parquet(out).collect()}
    # the card was idle for more than 8 days: its state (and novelty) was forgotten
    assert got["t2"]["is_new_merchant_for_card"] == 1.0
    assert got["t2"]["history_len"] == 0


def test_stream_scoring_equals_batch_decisions(spark):
    from cardlens.operators.decide import decide
    from cardlens.plans.features import feature_table
    from cardlens.sources.bindings import with_pseudo_scores
    from cardlens.operators.lookups import merchant_profile
    from cardlens.streaming.jobs import start_decision_stream

    t = txn(spark, SF_SMALL)
    profile = merchant_profile(t)
    rows = [r.asDict() for r in t.collect()]
    root = tempfile.mkdtemp(prefix="cardlens-score-")
    src, out, ckpt = (os.path.join(root, d) for d in ("src", "out", "ckpt"))
    os.makedirs(src)
    _write_parts(rows, src, 3, 0)
    q = start_decision_stream(spark, src, out, ckpt, profile, with_pseudo_scores, expiry_ms=None,
                              max_files_per_trigger=1)
    q.awaitTermination(300)
    assert q.exception() is None
    got = {r["transaction_id"]: r for r in spark.read.parquet(out).collect()}
    want = {r["transaction_id"]: r for r in
            decide(feature_table(with_pseudo_scores(t), profile)).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k]["action"] == w["action"]
        assert list(got[k]["triggered_rules"]) == list(w["triggered_rules"])
        assert abs(got[k]["risk_score"] - w["risk_score"]) < 1e-12

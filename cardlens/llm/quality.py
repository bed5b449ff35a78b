"""Quality selection by importance resampling.

Two generative models over hashed words and word pairs: one of target text
(labelled good and not toxic), one of all raw text.  A document's log weight is
the log of the ratio of its probabilities under the two, the sum of log(target
/ raw) over its words and pairs.  Buckets whose target count differs from the
raw share by less than ``SURE`` standard deviations say nothing: their ratio is
1.

Documents are sampled without replacement, with chances in proportion to their
weights, by Gumbel top-k: each gets the key log weight + standard Gumbel noise
(from a hash of its id, so runs agree) and those with the k largest keys are
kept; equal keys stay together.  k is stated as a share of all rows
(``KEEP_SHARE``).

A pipeline stage that drops bad documents needs a decision on each document
instead of a sample of stated size.  ``keep_good`` is that: a cut without noise
through the same weights, divided by the square root of the number of features
so that length does not decide, at the ``LOSS`` quantile of good documents that
were held back from fitting.

Counts cover all documents.  Labels are a sample of at most ``MAX_LABELS``
rows, whose ids are broadcast.

Defined cases: null and empty texts have weight 0; a null doc_id draws the
noise of id 0; rows with equal ids share label and noise; without good labels
all weights are 0, the sample is drawn by noise alone and ``keep_good`` keeps
every document; an empty table gives no rows; other columns are not read
(``keep_good`` hands them on).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm.common import (U64, Words, arrow_map, mix, portions, read, small_batches,
                                 stored, text_bytes)

WORD_BITS, PAIR_BITS = 18, 18
BUCKETS = (1 << WORD_BITS) + (1 << PAIR_BITS)
#: Bound of the labelled sample; the first is a documented parameter.
MAX_LABELS = 50_000
SURE = 4.0
SMOOTH = 0.1
#: Share of all rows that the sample holds.
KEEP_SHARE = 0.8
LOSS = 0.01
_BINS = 2048


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and word pair."""
    pairs, at = words.grams(2)
    one = (mix(words.hash, 1) & U64((1 << WORD_BITS) - 1)).astype(np.int64)
    two = (pairs & U64((1 << PAIR_BITS) - 1)).astype(np.int64) + (1 << WORD_BITS)
    return np.r_[words.row, words.row[at]], np.r_[one, two]


def label_sample(labels: DataFrame, most: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """(ids to fit on, ids held back) of good documents, each sorted."""
    rows = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
            .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
            .withColumn("h", F.xxhash64("id")).orderBy("h").limit(most)
            .where("quality = 1 and coalesce(toxic, 0) = 0").select("id").toArrow())
    ids = np.sort(rows.column("id").to_numpy().astype(np.int64))
    back = mix(ids.view(U64), 17) % U64(5) == 0
    return ids[~back], ids[back]


def _member(sorted_ids: np.ndarray, ids: pa.Array) -> np.ndarray:
    known = np.array(ids.is_valid())
    x = ids.fill_null(0).to_numpy(zero_copy_only=False)
    if not len(sorted_ids):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_ids, x), len(sorted_ids) - 1)
    return known & (sorted_ids[at] == x)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_t"))


def fit(docs: DataFrame, good: np.ndarray) -> np.ndarray:
    """log(target / raw) of every bucket."""
    held = docs.sparkSession.sparkContext.broadcast(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in portions(batches):
            row, bucket = features(Words(batch.column(1), lower=True))
            raw += np.bincount(bucket, minlength=BUCKETS)
            chosen = _member(held.value, batch.column(0))[row]
            target += np.bincount(bucket[chosen], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        for part in np.array_split(at, max(1, len(at) // 65536)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(raw[part]), pa.array(target[part])],
                names=["bucket", "raw", "target"])
    table = (_plain(docs).mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket")
             .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    bucket = table.column("bucket").to_numpy()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[bucket], target[bucket] = table.column("raw").to_numpy(), table.column("target").to_numpy()
    expected = np.zeros(BUCKETS)
    for part in (slice(0, 1 << WORD_BITS), slice(1 << WORD_BITS, BUCKETS)):
        expected[part] = raw[part] * target[part].sum() / max(1.0, raw[part].sum())
    ratio = np.log((target + SMOOTH) / (expected + SMOOTH))
    ratio[np.abs(target - expected) < SURE * np.sqrt(expected + 1)] = 0
    return ratio


def _weights(ratio: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(log weight, number of features) of every text."""
    row, bucket = features(Words(texts, lower=True))
    n = len(texts)
    return np.bincount(row, ratio[bucket], n), np.bincount(row, minlength=n)


def gumbel(ids: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise of every id."""
    u = ((mix(ids.view(U64), 23) >> U64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
    return -np.log(-np.log(u))


def _level(weight: np.ndarray, size: np.ndarray) -> np.ndarray:
    return weight / np.sqrt(np.maximum(size, 1))


def scores(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, key) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        weight, _ = _weights(held.value, batch.column(1))
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(weight), pa.array(weight + gumbel(ids))],
            names=["doc_id", "log_weight", "key"])
    return arrow_map(_plain(docs), rows, "doc_id long, log_weight double, key double")


def kth_largest(table: DataFrame, col: str, k: int) -> float:
    """The kth largest value of a double column, by histograms that narrow down
    to the bin that holds it; equal values end the search."""
    lo, hi = table.agg(F.min(col), F.max(col)).first()
    above = 0
    while lo < hi:
        width = (hi - lo) / _BINS
        if width == 0 or lo + width == lo:
            break
        bin_of = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(_BINS - 1))
        bins = (table.where(F.col(col).between(lo, hi)).groupBy(bin_of.alias("bin"))
                .agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
                .orderBy(F.desc("bin")).collect())
        for b in bins:
            if above + b["n"] >= k:
                lo, hi = b["lo"], b["hi"]
                break
            above += b["n"]
    return hi


def model(docs: DataFrame, labels: DataFrame, most_labels: int = MAX_LABELS
          ) -> tuple[np.ndarray, np.ndarray]:
    """(log ratio of every bucket, ids of good documents held back)."""
    small_batches(docs.sparkSession)
    good, back = label_sample(labels, most_labels)
    return (fit(docs, good) if len(good) else np.zeros(BUCKETS)), back


def resample(docs: DataFrame, labels: DataFrame, share: float = KEEP_SHARE,
             most_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, log_weight, key, kept): a sample of ceil(share x rows) rows by
    importance resampling, all rows with their weights."""
    table = stored(scores(docs, model(docs, labels, most_labels)[0]))
    k = math.ceil(share * table.count())
    cut = kth_largest(table, "key", k) if k else float("inf")
    return table.withColumn("kept", F.col("key") >= F.lit(cut))


def good_level(docs: DataFrame, ratio: np.ndarray, held_back: np.ndarray) -> float:
    """The ``LOSS`` quantile of the weights of good documents held back, by
    length; at most ``MAX_LABELS`` ids have one."""
    held = docs.sparkSession.sparkContext.broadcast((ratio, held_back))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(pa.array(_member(held.value[1], batch.column(0))))
        if not batch.num_rows:
            return None
        level = _level(*_weights(held.value[0], batch.column(1)))
        return pa.RecordBatch.from_arrays([pa.array(level)], names=["level"])
    least = (arrow_map(_plain(docs), rows, "level double")
             .agg(F.percentile("level", F.lit(LOSS))).first()[0])
    return float("-inf") if least is None else least


def keep_good(docs: DataFrame, labels: DataFrame, most_labels: int = MAX_LABELS) -> DataFrame:
    """The documents at or above ``good_level``, all columns."""
    ratio, back = model(docs, labels, most_labels)
    cut = good_level(docs, ratio, back)
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    text, names = docs.columns.index("text"), docs.columns

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text).cast(pa.binary())
        if texts.null_count:
            texts = pa.array([x or b"" for x in texts.to_pylist()], pa.binary())
        return batch.filter(pa.array(_level(*_weights(held.value, texts)) >= cut))
    # columns travel under plain names: an own name may hold any character
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return arrow_map(plain, rows, plain.schema).toDF(*names)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return table.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), "kept")

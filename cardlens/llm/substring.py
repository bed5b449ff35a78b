"""Removal of repeated passages by level-wise doubling.

A passage counts as repeated if a window of ``n`` consecutive words also
starts in a document with a smaller id.  Windows are found level by level, and
only what repeats at one length is extended to about twice that length:

* level k = (n+1)/2.  Every n-word window holds n-k+1 windows of k words; the
  one with the smallest hash stands for it, and equal n-word windows choose
  equal ones.  So about a quarter of the k-word windows are grouped, and those
  in two documents survive.
* level n = 2k-1.  Only n-word windows whose k-word window survived are hashed
  (128 bits) and grouped; those with a smaller document are removed.
* levels 2n, 4n, ... (``repeat_levels``).  A window of twice the length is a
  candidate if both halves repeat; its hash comes from theirs, so these levels
  join the surviving windows and need no text.  They end when none survives.

Groups are min/max aggregates with map-side combine, so a passage that a third
of all documents share is one row per task; the way back is a join on the
window, whose skewed partitions Spark splits.

Survivors of level k travel to the texts as a fixed-size approximate set
(false members only cost work, level n is exact).  With more survivors than it
can hold they are joined to the texts by document instead.

Defined cases: null and empty texts have no words; a null doc_id is neither
smaller nor larger than another, so its words stay and remove none; rows with
equal doc_id do not remove each other's words; texts under n words stay; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm.common import (Membership, Words, arrow_map, mix, read, signed, small_batches,
                                 stored, text_bytes)

WINDOW = 13


def _windows(words: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every n-word window of a batch: (index of its first word, index of its
    k-word window with the smallest hash, that hash)."""
    g, at = words.grams(k)
    m = n - k + 1
    size = len(g) - m + 1
    if size < 1:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64)
    best, where = g[:size].copy(), np.zeros(size, np.int64)
    for j in range(1, m):
        other = g[j:size + j]
        less = other < best
        best[less] = other[less]
        where[less] = j
    whole = np.flatnonzero(words.row[at[:size]] == words.row[at[m - 1:]])
    return at[whole], (whole + where[whole]), best[whole]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_d"), text_bytes().alias("_t"))


def anchors(docs: DataFrame, n: int) -> DataFrame:
    """(h, doc_id) of the standing k-word windows of every document."""
    k = (n + 1) // 2

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1), lower=False)
        start, where, h = _windows(words, n, k)
        new = np.ones(len(where), bool)
        new[1:] = where[1:] != where[:-1]
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(h[new])), pa.array(_ids(batch)[words.row[start[new]]])],
            names=["h", "doc_id"])
    return arrow_map(_known(docs).where("_d is not null"), rows, "h long, doc_id long")


def _candidates(texts: DataFrame, n: int, survivors: Membership | None,
                places: bool) -> DataFrame:
    """(w1, w2, doc_id[, place]) of the n-word windows whose k-word window
    survived: by ``survivors``, else by the column ``_hs`` of ``texts``."""
    k = (n + 1) // 2
    held = texts.sparkSession.sparkContext.broadcast(survivors.bits) if survivors else None

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1), lower=False)
        start, _, h = _windows(words, n, k)
        if held is not None:
            keep = Membership(held.value).has(h)
        else:
            lists = batch.column(2)
            own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            pairs = mix(flat ^ mix(own.astype(np.uint64), 5), 6)
            keep = np.isin(mix(h ^ mix(words.row[start].astype(np.uint64), 5), 6), pairs)
        g, at = words.grams(n)
        second = words.grams(n, 9)[0]
        row = words.row[at[keep]]
        if not places:  # once for each document
            _, first = np.unique(mix(g[keep] ^ mix(row.astype(np.uint64), 5), 6),
                                 return_index=True)
        else:
            first = np.arange(len(row))
        out = [pa.array(signed(g[keep][first])), pa.array(signed(second[keep][first])),
               pa.array(_ids(batch)[row[first]])]
        if places:
            out.append(pa.array(at[keep] - words.first[row]))
        return pa.RecordBatch.from_arrays(out, names=["w1", "w2", "doc_id", "place"][:len(out)])
    return arrow_map(texts, rows, "w1 long, w2 long, doc_id long" + ", place long" * places)


def repeated_windows(docs: DataFrame, n: int = WINDOW, most: int = Membership.MOST,
                     places: bool = False) -> tuple[DataFrame, DataFrame]:
    """(windows, groups): candidate windows of ``n`` words by document, and for
    each window found in several documents its smallest ``_min``."""
    texts = _known(docs).where("_d is not null")
    survived = stored(anchors(docs, n).groupBy("h")
                      .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                      .where("lo < hi").select("h"))
    if survived.count() <= most:
        candidates = _candidates(texts, n, Membership.build(survived, "h"), places)
    else:
        lists = stored(anchors(docs, n).join(survived.hint("shuffle_merge"), "h")
                       .groupBy(F.col("doc_id").alias("_k")).agg(F.collect_set("h").alias("_hs")))
        candidates = _candidates(texts.join(lists.hint("shuffle_merge"), F.col("_d") == F.col("_k"))
                                 .select("_d", "_t", "_hs"), n, None, places)
    groups = stored(candidates.groupBy("w1", "w2")
                    .agg(F.min("doc_id").alias("_min"), F.max("doc_id").alias("_max"))
                    .where("_min < _max").select("w1", "w2", "_min"))
    return candidates, groups


def repeat_levels(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """Doubling beyond ``n``: (words, doc_id, place, first_doc) for windows of
    n, 2n, 4n, ... words that also stand in a document with a smaller id."""
    candidates, groups = repeated_windows(docs, n, places=True)
    level = stored(candidates.join(groups, ["w1", "w2"]).distinct())
    found, words = [], n
    while not level.isEmpty():
        found.append(level.where("doc_id > _min").select(
            F.lit(words).alias("words"), "doc_id", "place", F.col("_min").alias("first_doc")))
        left = level.select("w1", "w2", "doc_id", "place")
        right = level.select(F.col("w1").alias("v1"), F.col("w2").alias("v2"), "doc_id",
                             (F.col("place") - words).alias("place"))
        joined = left.join(right, ["doc_id", "place"]).select(
            F.xxhash64("w1", "v1", F.lit(words)).alias("w1"),
            F.xxhash64("v2", "w2", F.lit(-words)).alias("w2"), "doc_id", "place")
        wider = stored(joined)
        groups = (wider.groupBy("w1", "w2").agg(F.min("doc_id").alias("_min"),
                                                F.max("doc_id").alias("_max"))
                  .where("_min < _max").select("w1", "w2", "_min"))
        level = stored(wider.join(groups, ["w1", "w2"]))
        words *= 2
    if not found:
        return docs.sparkSession.createDataFrame(
            [], "words int, doc_id long, place long, first_doc long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def remove_repeats(docs: DataFrame, n: int = WINDOW, most: int = Membership.MOST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary): every document's words that
    no repeated window covers, joined by one space."""
    small_batches(docs.sparkSession)
    candidates, groups = repeated_windows(docs, n, most)
    cut = stored(candidates.join(groups.hint("shuffle_merge"), ["w1", "w2"])
                 .where(F.col("doc_id") > F.col("_min"))
                 .groupBy(F.col("doc_id").alias("_k")).agg(F.collect_set("w1").alias("_ws")))
    joined = (_known(docs).join(cut.hint("shuffle_merge"), F.col("_d") == F.col("_k"), "left")
              .select("_d", "_t", "_ws"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1), lower=False)
        g, at = words.grams(n)
        lists = batch.column(2)
        first = np.searchsorted(words.row[at], np.arange(len(lists) + 1))
        n_words, n_removed, kept = words.counts(), [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            parts = text.split()
            if lists[i].is_valid:
                own = lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                a, b = first[i], first[i + 1]
                hit = at[a:b][np.isin(g[a:b], own)] - words.first[i]
                edge = np.zeros(len(parts) + 1, np.int64)
                edge[hit] += 1
                np.subtract.at(edge, np.minimum(hit + n, len(parts)), 1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(b" ".join(p for p, x in zip(parts, gone.tolist()) if not x))
                n_removed.append(int(gone.sum()))
            else:
                kept.append(b" ".join(parts))
                n_removed.append(0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])
    return arrow_map(joined, rows, "doc_id long, n_words long, n_removed long, kept binary")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2("kept", 256).alias("kept_sha256"))

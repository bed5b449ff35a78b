"""Detection of periodic runs by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``SHORTEST`` words and two periods long, that no
neighbouring word extends keeping q.

All documents of a batch are handled together, as one row of words in which no
match crosses documents:

* Equal factors of 1, 2, 4, ... words get equal ranks by prefix doubling; a
  rank is the first place of the factor in the suffix array.  Only suffixes
  that are not alone yet are sorted again, so plain text ends after two or
  three rounds.
* A dyadic block of m words that stands at a multiple of m asks for its
  occurrences in the window of the next 2m to 4m words.  Its occurrences are an
  interval of the suffix array, and the next one behind a given place is a
  range successor query on a wavelet tree over the suffix array.
* Occurrences at most m apart continue as an arithmetic progression, whose end
  comes from one longest common extension; so a window is asked for a few
  progressions, not for single occurrences.  Distances in the progressions are
  candidate periods.  Of those in the block's own progression only the
  difference can be a smallest period.
* Longest common extensions to both sides, read off the ranks, turn block and
  candidate into the stretch that keeps the period.  Of the candidates with the
  same stretch the smallest is its smallest period.

A run of period q >= 2m-1 with two periods holds a block and its copy q words
on, so no run is missed: blocks of 8, 16, ... words find q from 2m-1 to 4m-2,
and blocks of four at every second word find q up to 14 (a run of 12 words has
six words with a copy at q = 6, and any five hold such a block).

Blocks and their extensions never leave a document; the work is proportional to
n log n for a document of n words at worst, and to n for plain text.

Defined cases: null and empty texts have no words and no runs; equal rows are
searched each for itself; a null id stays null; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm.common import Words, arrow_map, ranges, read, small_batches, text_bytes

SHORTEST = 12
#: Level (log2 of the words) of the smallest blocks.
BASE_LEVEL = 2

RUN = "array<struct<start:long,length:long,period:long>>"


class Factors:
    """Ranks of all factors of 2^k words within documents, and the suffix array
    of those suffixes whose first four words stand twice in their document."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, doc_end: np.ndarray):
        """``words``: a number per word; ``doc``: its document, in order;
        ``doc_end``: one past the last word of its document."""
        n = len(words)
        self.doc_end = doc_end
        order = np.lexsort((words, doc))
        w, d = words[order], doc[order]
        new = np.ones(n, bool)
        new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
        rank, live = self._ranks(order, np.zeros(n, np.int64), new, np.zeros(n, np.int64))
        self.levels = [rank]
        while len(live):
            h = 1 << (len(self.levels) - 1)
            after = live + h
            key = np.where(after < doc_end[live], rank[np.minimum(after, n - 1)], -1)
            order = np.lexsort((key, rank[live]))
            live, key = live[order], key[order]
            group = rank[live]
            first = np.ones(len(live), bool)
            first[1:] = group[1:] != group[:-1]
            new = first.copy()
            new[1:] |= key[1:] != key[:-1]
            rank, live = self._ranks(live, np.flatnonzero(first)[np.cumsum(first) - 1], new, group,
                                     rank)
            self.levels.append(rank)
        # at the last level no two places agree
        if len(self.levels) > BASE_LEVEL + 1:
            base = self.levels[BASE_LEVEL]
            self.places = np.flatnonzero(np.bincount(base, minlength=n)[base] > 1)
        else:
            self.places = np.empty(0, np.int64)
        #: suffix array of those places
        self.suffixes = self.places[np.argsort(rank[self.places], kind="stable")]

    @staticmethod
    def _ranks(order: np.ndarray, group_at: np.ndarray, new: np.ndarray, group_rank: np.ndarray,
               old: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(new ranks of all, places that still share theirs in sorted order)."""
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(order)])
        own = np.repeat(start, size)
        rank = np.empty(len(order), np.int64) if old is None else old.copy()
        rank[order] = group_rank + own - group_at
        return rank, order[np.repeat(size > 1, size)]

    def extend(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal words from ``x`` and ``y`` on (x < y, one document):
        the binary digits of it, since no factor of the last level stands
        twice."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            at = np.flatnonzero(y + out < self.doc_end[x])
            rank = self.levels[k]
            out[at[rank[x[at] + out[at]] == rank[y[at] + out[at]]]] += 1 << k
        return out

    def extend_back(self, x: np.ndarray, y: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Number of equal words before ``x`` and ``y``, not before ``begin``."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            rank, h = self.levels[k], 1 << k
            at = np.flatnonzero(x - out - h >= begin)
            out[at[rank[x[at] - out[at] - h] == rank[y[at] - out[at] - h]]] += h
        return out


class WaveletTree:
    """Range successor over a permutation of 0 .. n-1: the levels of a wavelet
    tree side by side, each with the number of zero bits before every place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        v = values
        for b in range(self.bits - 1, -1, -1):
            bit = (v >> b & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~bit)])
            v = np.concatenate([v[~bit], v[bit]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value >= ``least`` at the places lo .. hi-1, else -1."""
        # values below ``least`` in the range ...
        below = np.zeros(len(lo), np.int64)
        a, b = lo.copy(), hi.copy()
        over = least >> self.bits > 0
        for level, zero in enumerate(self.zeros):
            one = (least >> (self.bits - 1 - level) & 1).astype(bool)
            za, zb, z = zero[a], zero[b], zero[-1]
            below += np.where(one, zb - za, 0)
            a = np.where(one, z + a - za, za)
            b = np.where(one, z + b - zb, zb)
        # ... and the one behind them in order of size
        nth, out = below.copy(), np.zeros(len(lo), np.int64)
        found = ~over & (below < hi - lo)
        a, b = lo.copy(), hi.copy()
        for level, zero in enumerate(self.zeros):
            za, zb, z = zero[a], zero[b], zero[-1]
            one = nth >= zb - za
            nth = np.where(one, nth - (zb - za), nth)
            out |= one.astype(np.int64) << (self.bits - 1 - level)
            a = np.where(one, z + a - za, za)
            b = np.where(one, z + b - zb, zb)
        return np.where(found, out, -1)


def _candidates(f: Factors, tree: WaveletTree, rank_of: np.ndarray, k: int,
                doc_begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, candidate period) of the blocks of 2^k words."""
    m = 1 << k
    least, most = (1, 4 * m - 2) if k == BASE_LEVEL else (2 * m - 1, 4 * m - 2)
    step = m // 2 if k == BASE_LEVEL else m
    rank = f.levels[k]
    x = f.places[(f.places - doc_begin[f.places]) % step == 0]
    own = rank[x]
    lo, hi = np.searchsorted(rank_of, own, "left"), np.searchsorted(rank_of, own, "right")
    on = hi - lo > 1
    x, lo, hi = x[on], lo[on], hi[on]

    def after(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The next occurrence at ``at`` or behind, a far place if none."""
        got = tree.successor(lo, hi, np.searchsorted(f.places, at))
        return np.where(got >= 0, f.places[np.maximum(got, 0)], np.iinfo(np.int64).max // 2)

    def last_of(y: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Number of steps by p from y on that the progression goes."""
        return (p + f.extend(y, y + p) - m) // p

    blocks, periods = [], []
    # the block's own progression: only its difference can be a smallest period
    y = after(x + 1, lo, hi)
    on = y - x <= most
    x, lo, hi, y = x[on], lo[on], hi[on], y[on]
    p = y - x
    near = p <= m
    take = near & (p >= least)
    blocks.append(x[take])
    periods.append(p[take])
    at = y
    if near.any():
        at = y.copy()
        at[near] = x[near] + last_of(x[near], p[near]) * p[near] + 1
        again = np.flatnonzero(near)
        at[again] = after(np.maximum(at[again], x[again] + least), lo[again], hi[again])
    short = at < x + least
    at[short] = after(x[short] + least, lo[short], hi[short])
    # further progressions within the window
    while True:
        on = at - x <= most
        x, lo, hi, at = x[on], lo[on], hi[on], at[on]
        if not len(x):
            break
        nxt = after(at + 1, lo, hi)
        p = nxt - at
        near = p <= m
        count = np.ones(len(x), np.int64)
        if near.any():
            count[near] = 1 + last_of(at[near], p[near])
            inside = (x[near] + most - at[near]) // p[near] + 1
            end = at[near] + (count[near] - 1) * p[near]
            where = np.flatnonzero(near)
            nxt[where] = after(end + 1, lo[where], hi[where])
            count[near] = np.minimum(count[near], inside)
        blocks.append(np.repeat(x, count))
        periods.append(np.repeat(at - x, count)
                       + ranges(np.zeros(len(x), np.int64), count) * np.repeat(np.where(near, p, 0), count))
        at = nxt
    return np.concatenate(blocks), np.concatenate(periods)


def find_runs(words: np.ndarray, first: np.ndarray, shortest: int = SHORTEST
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``shortest`` (12 or
    more) words, sorted by start and period.

    ``words``: a number for each word, equal for equal words; document i has
    the words ``first[i]`` .. ``first[i+1]-1``.  Starts count over all words.
    """
    none = np.empty(0, np.int64)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    f = Factors(words, doc, np.repeat(first[1:], size))
    if len(f.places) < 2:
        return none, none, none
    doc_begin = np.repeat(first[:-1], size)
    place_no = np.empty(len(words), np.int64)
    place_no[f.places] = np.arange(len(f.places))
    tree = WaveletTree(place_no[f.suffixes])
    starts, ends, periods = [none], [none], [none]
    for k in range(BASE_LEVEL, len(f.levels)):
        x, q = _candidates(f, tree, f.levels[k][f.suffixes], k, doc_begin)
        if not len(x):
            continue
        end = x + q + f.extend(x, x + q)
        begin = x - f.extend_back(x, x + q, doc_begin[x])
        long = end - begin >= np.maximum(shortest, 2 * q)
        starts.append(begin[long])
        ends.append(end[long])
        periods.append(q[long])
    start, end, q = map(np.concatenate, (starts, ends, periods))
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], (end - start)[order], q[order]


def _joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of every text, joined by one space."""
    at = np.flatnonzero(keep)
    size = words.end[at] - words.start[at]
    # every word with one more byte, which becomes the space
    out = words.raw[np.minimum(ranges(words.start[at], size + 1), max(0, len(words.raw) - 1))]
    stop = np.cumsum(size + 1)
    out[stop - 1] = 32
    edge = np.r_[0, stop][np.searchsorted(at, words.first)]
    whole = out.tobytes()
    return [whole[a:b - 1] if b > a else b"" for a, b in zip(edge.tolist(), edge[1:].tolist())]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed binary): every document's runs, by
    start and period, and its words without those that a run repeats (all but
    the first period of each run), joined by one space."""
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1), lower=False)
        start, length, q = find_runs(words.hash.view(np.int64), words.first, shortest)
        mark = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(mark, start + q, 1)
        np.add.at(mark, start + length, -1)
        texts = _joined(words, np.cumsum(mark[:-1]) == 0)
        row = words.row[start]
        offs = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
        run = pa.StructArray.from_arrays(
            [pa.array(start - words.first[row]), pa.array(length), pa.array(q)],
            names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words.counts()), pa.ListArray.from_arrays(offs, run),
             pa.array(texts, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])
    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_bytes().alias("_t")), rows,
                     f"doc_id long, n_words long, runs {RUN}, collapsed binary")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one text in ten, chosen by its id, repeats from
    some word on: with h the crc32 of the decimal id, n the number of words,
    a = floor(h/10) mod n and p = 1 + floor((n-a) / (3 + floor(h/10) mod 8)),
    word i >= a is the word a + (i-a) mod p."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    chosen = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), h.alias("_h"))
              .withColumn("_w", F.when(F.col("_h") % 10 == 0, words)))
    n, g = F.size("_w").cast("long"), F.floor(F.col("_h") / 10)
    # a negative divisor never arises: texts without words are left as they are
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))

    def source(i: Column) -> Column:
        return F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                                        lambda i: F.get("_w", source(i).cast("int"))), " ")
    return (chosen.withColumn("_a", a).withColumn("_p", p)
            .select("doc_id", F.when(F.size("_w") > 0, repeated).otherwise(F.col("text")).alias("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return (found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"),
        (-F.col("_b.period")).alias("period"),
        F.floor(1000 * F.col("_b.length") / (-F.col("_b.period"))).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))

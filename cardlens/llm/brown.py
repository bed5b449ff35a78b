"""Brown class-based bigram language model.

``P(text) = prod P(class_i | class_i-1) * P(word_i | class_i)``; the end of a
text is a token with a class of its own, and stands before the first word too.

* Counts.  Words are counted over all training texts: partial counts per Arrow
  batch, then a Spark aggregate on the 64-bit word hash.  The table grows with
  the corpus and is only joined, never collected.
* Units.  A word with at least 1/``CLUSTERED`` of all tokens is a unit of its
  own, so there are at most ``CLUSTERED``; during the exchange every other word
  belongs to the unit of its ending (``ENDINGS`` hash buckets of the last three
  bytes).
* Exchange clustering puts units into ``CLASSES`` classes.  A round counts, in
  Spark, the classes before and after each unit over the whole training corpus;
  these counts, whose number is bounded by units and classes, come to the
  driver, which moves one unit after the other to the class with the largest
  gain in likelihood.  Rounds end when the likelihood no longer rises.
* Words.  Every other word that occurs ``OWN`` times or more then gets the class
  in which the model gives its own occurrences, between the classes around
  them, the highest probability.  The classes around each word are shuffled by
  word and added up; this table of words grows with the corpus and is only
  joined.  Words seen less often keep the
  class of their ending.  Then the class transitions are counted anew.
* Scores.  Per text: class transitions from the small class tables, and the sum
  of log10(count + 1).  Words with at least 1/``HEAD`` of the tokens (at most
  ``HEAD``, 20 bytes each) are looked up in a broadcast table; counts and
  classes of the others are joined.

Smoothing: transitions have a Dirichlet prior on the class frequencies; a class
gives each word count + 1 and one share to all words it has not seen.

Defined cases: null and empty texts are the end token alone; a null doc_id
counts as the empty text in the hold-out rule; equal rows count and are scored
each for itself; without training texts the counts are zero; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm.common import (U64, Words, arrow_map, mix, portions, read, signed,
                                 small_batches, stored, text_bytes)

CLASSES = 32
CLUSTERED = 8192
ENDINGS = 512
HEAD = 1 << 19
#: A word seen so often in training has a class from its own contexts.
OWN = 2
ROUNDS = 5
#: Words that a task counts before it emits partial counts, and words whose
#: contexts it holds before it emits them.
FLUSH, CONTEXTS = 2_000_000, 1_000_000


def held_out(doc_id: str, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, is ``fold``."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def endings(words: Words) -> np.ndarray:
    """Bucket of each word's last three bytes."""
    key = np.zeros(len(words.start), U64)
    size = words.end - words.start
    for j in range(1, 4):
        at = np.maximum(words.end - j, 0)
        key = key * U64(257) + np.where(size >= j, words.data[at].astype(U64) + U64(1), U64(0))
    return (mix(key, 3) % U64(ENDINGS)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, ending, c) over all texts of ``docs(_t)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            h, e = (np.concatenate(x) for x in zip(*parts))
            word, first, c = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(word)), pa.array(e[first].astype(np.int32)), pa.array(c)],
                names=["h", "ending", "c"])
        held, size = [], 0
        for batch in portions(batches):
            words = Words(batch.column(0), lower=True)
            held.append((words.hash, endings(words)))
            size += len(words.hash)
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)
    return (docs.select("_t").mapInArrow(run, "h long, ending int, c long")
            .groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")))


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def _find(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value) of hashes in a sorted table."""
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), values.dtype)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, values[at]


def encode(texts: DataFrame, head: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per text of ``texts(_id, doc_id, held_out, _t)``: a code (32 bit)
    for each word, the sums over head words, and its distinct other words.

    The code is a head word's place in the table; for others it is the size of
    the table + ending, and ``spots`` has their places in ``rest``.
    """
    sc = texts.sparkSession.sparkContext
    table = sc.broadcast(head)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = table.value
        words = Words(batch.column(3), lower=True)
        n = batch.num_rows
        known, at = _find(keys, np.arange(len(keys)), words.hash)
        logs = np.zeros(len(known))
        logs[known] = np.log10(counts[at[known]] + 1.0)
        code = np.where(known, at, len(keys) + endings(words)).astype("<u4")
        rest = ~known
        pair = mix(words.hash[rest] ^ mix(words.row[rest].astype(U64), 5), 6)
        _, first, which = np.unique(pair, return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = first[order]
        rest_row, rest_hash = words.row[rest][first], words.hash[rest][first]
        cut = np.searchsorted(rest_row, np.arange(n + 1)).astype(np.int32)
        every = np.searchsorted(words.row[rest], np.arange(n + 1)).astype(np.int32)
        spots = (rank[which] - cut[words.row[rest]]).astype(np.int32)
        raw, place = code.tobytes(), 4 * words.first
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(words.counts()),
             pa.array(np.bincount(words.row, logs, n).astype(float)),
             pa.array(np.bincount(words.row, known, n).astype(np.int64)),
             pa.array([raw[a:b] for a, b in zip(place, place[1:])], pa.binary()),
             pa.ListArray.from_arrays(pa.array(cut), pa.array(signed(rest_hash))),
             pa.ListArray.from_arrays(pa.array(every), pa.array(spots))],
            names=["_id", "doc_id", "held_out", "n_words", "head_log", "head_known", "codes",
                   "rest", "spots"])
    return arrow_map(texts, rows, "_id long, doc_id long, held_out boolean, n_words long, "
                     "head_log double, head_known long, codes binary, rest array<long>, "
                     "spots array<int>")


def _flat(col: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, texts) of a column of packed numbers."""
    raw = col.to_pylist()
    size = np.array([len(x) for x in raw], np.int64) // np.dtype(kind).itemsize
    return (np.frombuffer(b"".join(raw), kind).astype(np.int64),
            np.repeat(np.arange(len(raw)), size))


def _lists(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values, texts) of a column of lists; null is empty."""
    size = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    return col.flatten(), np.repeat(np.arange(len(size)), size)


def _around(c: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class before, class after) at every place; the end class is the last."""
    before, after = np.full(len(c), CLASSES), np.full(len(c), CLASSES)
    same = row[1:] == row[:-1]
    before[1:][same] = c[:-1][same]
    after[:-1][same] = c[1:][same]
    return before, after


def context_counts(encoded: DataFrame, unit_of: np.ndarray, classes: np.ndarray) -> DataFrame:
    """(side, unit, cls, n): how often a class stands before (0) or after (1) a
    unit; ``unit_of`` has the unit of every code."""
    k = CLASSES + 1
    table = encoded.sparkSession.sparkContext.broadcast(unit_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(classes) * k), np.int64)
        for batch in portions(batches):
            code, row = _flat(batch.column(0), "<u4")
            unit = table.value[code]
            for side, c in enumerate(_around(classes[unit], row)):
                total[side] += np.bincount(unit * k + c, minlength=total.shape[1])
        side, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(side.astype(np.int32)), pa.array((at // k).astype(np.int32)),
             pa.array((at % k).astype(np.int32)), pa.array(total[side, at])],
            names=["side", "unit", "cls", "n"])
    return (encoded.where("not held_out").select("codes")
            .mapInArrow(run, "side int, unit int, cls int, n long")
            .groupBy("side", "unit", "cls").agg(F.sum("n").alias("n")))


def word_classes(encoded: DataFrame, head: np.ndarray, unit_of: np.ndarray, units: int,
                 classes: np.ndarray, step: np.ndarray, emit: np.ndarray) -> DataFrame:
    """(h, ending, c, cls) of every training word that is no unit of its own;
    cls is null for words seen less than ``OWN`` times.

    ``step`` and ``emit`` are the log probabilities of the exchanged model: an
    occurrence between classes l and r has step[l, c] + step[c, r] - emit[c] in
    class c (the word's own count is the same in all classes).
    """
    k, least = CLASSES + 1, OWN
    table = encoded.sparkSession.sparkContext.broadcast((head, unit_of, classes))
    value = (step[:, None, :CLASSES] + step[:CLASSES, :].T[None, :, :] - emit).reshape(k * k, -1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            # one row a word: the pairs of classes around its occurrences
            h, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            raw, place = (at % (k * k)).astype("<u2").tobytes(), 2 * np.r_[new, len(h)]
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(h[new])), pa.array((at[new] // (k * k)).astype(np.int32)),
                 pa.array([raw[a:b] for a, b in zip(place, place[1:])], pa.binary())],
                names=["h", "ending", "found"])
        held, size = [], 0
        for batch in portions(batches):
            keys, unit_at, own = table.value
            code, row = _flat(batch.column(0), "<u4")
            rest, rest_row = _lists(batch.column(1))
            spots, spot_row = _lists(batch.column(2))
            rest = rest.to_numpy(zero_copy_only=False).view(U64)
            start = np.searchsorted(rest_row, np.arange(batch.num_rows))
            h = np.zeros(len(code), U64)
            known = code < len(keys)
            h[known] = keys[code[known]]
            h[~known] = rest[start[spot_row] + spots.to_numpy(zero_copy_only=False)]
            unit = unit_at[code]
            before, after = _around(own[unit], row)
            some = unit >= units
            at = (unit[some] - units) * (k * k) + (before * k + after)[some]
            held.append((h[some], at.astype(np.int32)))
            size += len(at)
            if size >= CONTEXTS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the rows of a word, which follow each other; the last word
        of a batch waits for the next batch."""
        def rows(h, e, c, total):
            cls = pa.array(total.argmax(1).astype(np.int32), mask=c < least)
            return pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(e), pa.array(c), cls], names=["h", "ending", "c", "cls"])
        wait = None
        for batch in portions(batches):
            h, e = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ctx, row = _flat(batch.column(2), "<u2")
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            word = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))[row]
            c = np.bincount(word, minlength=len(first))
            total = np.stack([np.bincount(word, v[ctx], len(first)) for v in value.T], 1)
            h, e = h[first], e[first]
            if wait and wait[0][0] == h[0]:
                c[0] += wait[2][0]
                total[0] += wait[3][0]
            elif wait:
                yield rows(*wait)
            if len(h) > 1:
                yield rows(h[:-1], e[:-1], c[:-1], total[:-1])
            wait = h[-1:], e[-1:], c[-1:], total[-1:]
        if wait:
            yield rows(*wait)
    return (encoded.where("not held_out").select("codes", "rest", "spots")
            .mapInArrow(count, "h long, ending int, found binary")
            .repartition("h").sortWithinPartitions("h")
            .mapInArrow(choose, "h long, ending int, c long, cls int"))


def class_texts(encoded: DataFrame, tail: DataFrame, heads: int,
                class_of: np.ndarray) -> DataFrame:
    """Each text with the class (8 bit) of each word, and the sums over the
    words of ``tail(_k, own)``: struct (place in rest * 64 + class + 1, count).
    ``class_of`` is by code; a word of ``tail`` without a class keeps that."""
    table = encoded.sparkSession.sparkContext.broadcast(class_of)
    keep = ["doc_id", "held_out", "n_words", "head_log", "head_known"]
    types = "doc_id long, held_out boolean, n_words long, head_log double, head_known long"

    def by_code(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Bit 128 marks the words that are in ``rest``."""
        code, row = _flat(batch.column(6), "<u4")
        raw = (table.value[code] + 128 * (code >= heads)).astype(np.uint8).tobytes()
        place = np.searchsorted(row, np.arange(batch.num_rows + 1))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:6], pa.array([raw[a:b] for a, b in zip(place, place[1:])],
                                          pa.binary()), *batch.columns[7:]],
            names=["_id", *keep, "classes", "spots", "_n"])

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        cls, row = _flat(batch.column(5), "u1")
        spots, spot_row = _lists(batch.column(6))
        size = batch.column(7).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        own, own_row = _lists(batch.column(8))
        at, c = (own.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        given, seen = np.full(int(size.sum()), -1), np.zeros(int(size.sum()), np.int64)
        place = start[own_row] + (at >> 6)
        given[place], seen[place] = (at & 63) - 1, c
        place = start[spot_row] + spots.to_numpy(zero_copy_only=False)
        other = cls >= 128
        cls[other] = np.where(given[place] >= 0, given[place], cls[other] - 128)
        raw = cls.astype(np.uint8).tobytes()
        cut = np.searchsorted(row, np.arange(n + 1))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5],
             pa.array(np.bincount(spot_row, np.log10(seen[place] + 1.0), n).astype(float)),
             pa.array(np.bincount(spot_row, seen[place] > 0, n).astype(np.int64)),
             pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
            names=[*keep, "tail_log", "tail_known", "classes"])
    coded = arrow_map(encoded.select("_id", *keep, "codes", "spots", F.size("rest").alias("_n")),
                      by_code, f"_id long, {types}, classes binary, spots array<int>, _n int")
    # a text's own sums: one row each, so no key is frequent here
    joined = coded.join(tail.hint("shuffle_merge"), F.col("_id") == F.col("_k"), "left")
    return arrow_map(joined.select(*keep, "classes", "spots", "_n", "own"), rows,
                     f"{types}, tail_log double, tail_known long, classes binary")


def class_bigrams(classed: DataFrame) -> np.ndarray:
    """Class bigram counts over the training texts, ends included."""
    k = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in portions(batches):
            c, row = _flat(batch.column(0), "u1")
            before, after = _around(c, row)
            total += np.bincount(before * k + c, minlength=k * k)
            total += np.bincount(c[after == CLASSES] * k + CLASSES, minlength=k * k)
            total[-1] += batch.num_rows - len(np.unique(row))  # texts without words
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])],
                                         names=["at", "n"])
    at, n = _columns(classed.where("not held_out").select("classes")
                     .mapInArrow(run, "at int, n long").groupBy("at")
                     .agg(F.sum("n").alias("n")), "at", "n")
    m = np.zeros(k * k)
    m[at] = n
    return m.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def transitions(context: np.ndarray, classes: np.ndarray, texts: int) -> np.ndarray:
    """Class bigram counts; row and column ``CLASSES`` are the end."""
    k = CLASSES + 1
    m = np.zeros((k, k))
    for c in range(CLASSES):
        m[c] = context[1][classes == c].sum(0)
        m[CLASSES, c] = context[0][classes == c, CLASSES].sum()
    m[CLASSES, CLASSES] = max(0, texts - m[CLASSES, :CLASSES].sum())  # texts without words
    return m


def likelihood(m: np.ndarray) -> float:
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def exchange(context: np.ndarray, classes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """One round: every unit, most frequent first, moves to its best class."""
    m, classes = m.copy(), classes.copy()
    size = context[1].sum(1)
    for w in np.argsort(-size, kind="stable"):
        n = size[w]
        if not n:
            break
        left, right, a = context[0][w], context[1][w], classes[w]
        m[a] -= right
        m[:, a] -= left
        np.maximum(m, 0, out=m)
        rows, cols = m[:CLASSES], m[:, :CLASSES]
        out, into = rows.sum(1), cols.sum(0)
        gain = ((_xlogx(rows + right) - _xlogx(rows)).sum(1)
                + (_xlogx(cols + left[:, None]) - _xlogx(cols)).sum(0)
                - (_xlogx(out + n) - _xlogx(out)) - (_xlogx(into + n) - _xlogx(into)))
        b = int(np.argmax(gain))
        m[b] += right
        m[:, b] += left
        classes[w] = b
    return classes


def model(m: np.ndarray, size: np.ndarray, words_of: np.ndarray, texts: int,
          total: int) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the class transitions, log10 of what counts in a class are
    divided by)."""
    k = CLASSES + 1
    prior = (np.r_[size, texts] + 1) / (total + k)
    return (np.log10((m + k * prior) / (m.sum(1, keepdims=True) + k)),
            np.log10(size + words_of + 1))


def cluster(encoded: DataFrame, unit_of: np.ndarray, unit_counts: np.ndarray, texts: int,
            rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts)."""
    classes = np.empty(len(unit_counts), np.int64)
    classes[np.argsort(-unit_counts, kind="stable")] = np.arange(len(unit_counts)) % CLASSES
    best = None
    for r in range(rounds + 1):
        side, unit, cls, n = _columns(context_counts(encoded, unit_of, classes),
                                      "side", "unit", "cls", "n")
        context = np.zeros((2, len(classes), CLASSES + 1))
        context[side, unit, cls] = n
        m = transitions(context, classes, texts)
        now = likelihood(m)
        if best and now <= best[0]:
            break
        best = (now, classes, m)
        if r < rounds:
            classes = exchange(context, classes, m)
    return best[1], best[2]


def score(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Fit on the texts outside ``fold`` and score all: (doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("_id"),
                        F.col("doc_id").cast("long").alias("doc_id"),
                        held_out("doc_id", folds, fold).alias("held_out"),
                        text_bytes().alias("_t"))
    vocabulary = stored(word_counts(texts.where("not held_out")))
    n_texts = docs.where(~held_out("doc_id", folds, fold)).count()
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
                          F.count("*").alias("v")).first()
    total, distinct = sums["n"] + n_texts, sums["v"] + (n_texts > 0)

    head = vocabulary.where(F.col("c") * HEAD >= total)
    h, c, ending = _columns(head, "h", "c", "ending")
    h = h.view(U64)
    order = np.argsort(h)
    h, c, ending = h[order], c[order], ending[order]
    frequent = c * CLUSTERED >= total
    units = h[frequent]
    #: unit of every code
    unit_of = np.r_[np.where(frequent, np.cumsum(frequent) - 1, len(units) + ending),
                    len(units) + np.arange(ENDINGS)]
    ends, of_end, kinds = _columns(vocabulary.groupBy("ending").agg(
        F.sum("c").alias("c"), F.count("*").alias("v")), "ending", "c", "v")
    own_end, own_c, own_v = _columns(vocabulary.where(F.col("c") * CLUSTERED >= total)
                                     .groupBy("ending").agg(F.sum("c").alias("c"),
                                                            F.count("*").alias("v")),
                                     "ending", "c", "v")
    count = np.r_[c[frequent], np.zeros(ENDINGS, np.int64)]
    kind = np.r_[np.ones(len(units), np.int64), np.zeros(ENDINGS, np.int64)]
    count[len(units) + ends], kind[len(units) + ends] = of_end, kinds
    count[len(units) + own_end] -= own_c
    kind[len(units) + own_end] -= own_v

    encoded = stored(encode(texts, (h, c)))
    classes, m = cluster(encoded, unit_of, count, n_texts)
    step, emit = model(m, np.bincount(classes, count, CLASSES),
                       np.bincount(classes, kind, CLASSES), n_texts, total)

    assigned = stored(word_classes(encoded, h, unit_of, len(units), classes, step, emit))
    end, cls, moved, moved_kinds = _columns(
        assigned.where("cls is not null").groupBy("ending", "cls")
        .agg(F.sum("c").alias("c"), F.count("*").alias("v")), "ending", "cls", "c", "v")
    np.subtract.at(count, len(units) + end, moved)
    np.subtract.at(kind, len(units) + end, moved_kinds)
    size = np.bincount(classes, count, CLASSES) + np.bincount(cls, moved, CLASSES)
    words_of = np.bincount(classes, kind, CLASSES) + np.bincount(cls, moved_kinds, CLASSES)
    own_h, own_cls = _columns(assigned.where((F.col("c") * HEAD >= total)
                                             & F.col("cls").isNotNull()), "h", "cls")
    class_of = classes[unit_of]
    class_of[np.searchsorted(h, own_h.view(U64))] = own_cls

    rest = encoded.select(F.col("_id").alias("_k"), F.posexplode("rest").alias("pos", "h"))
    found = stored(rest.join(assigned.where(F.col("c") * HEAD < total)
                             .hint("shuffle_merge"), "h")
                   .select("_k", (F.col("pos").cast("long") * 64 + F.coalesce("cls", F.lit(-1))
                                  + 1).alias("at"), "c"))
    tail = (found.repartition("_k").groupBy("_k")
            .agg(F.collect_list(F.struct("at", "c")).alias("own")))
    classed = stored(class_texts(encoded, tail, len(h), class_of))
    step, emit = model(class_bigrams(classed), size, words_of, n_texts, total)
    class_tables = spark.sparkContext.broadcast((step, emit))

    def class_part(batch: pa.RecordBatch) -> pa.RecordBatch:
        moves, shares = class_tables.value
        own, row = _flat(batch.column(batch.schema.get_field_index("classes")), "u1")
        before, after = _around(own, row)
        n = batch.num_rows
        value = np.bincount(row, moves[before, own] - shares[own], n).astype(float)
        last = after == CLASSES
        value += np.bincount(row[last], moves[own[last], CLASSES], n)
        value[np.bincount(row, minlength=n) == 0] += moves[CLASSES, CLASSES]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in keep), pa.array(value)], names=[*keep, "class_log"])

    keep = ["doc_id", "held_out", "n_words", "head_log", "head_known", "tail_log", "tail_known"]
    joined = arrow_map(classed.select(*keep, "classes"), class_part,
                       "doc_id long, held_out boolean, n_words long, head_log double, "
                       "head_known long, tail_log double, tail_known long, class_log double")
    logs = F.col("head_log") + F.col("tail_log")
    n_tokens = F.col("n_words") + 1
    return joined.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("head_known") + F.col("tail_known") + int(n_texts > 0))
        .cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs + float(np.log10(n_texts + 1.0))
         - n_tokens * float(np.log10(total + distinct + 1.0))).alias("base_score"),
        (logs + F.col("class_log")).alias("score"))


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))

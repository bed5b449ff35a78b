"""Benchmark decontamination with CGK embedding and bit-sampling LSH.

A document is contaminated by an item if some run of its words is within
``n // 5`` word edits of the item's ``n`` words (words lower-cased; items under
eight words must occur unchanged).

* Windows.  An item-sized window within that distance keeps at least three
  words in a row (n - e unchanged words in e + 1 runs), so windows are laid
  where a word triple of the text is a triple of an item: nothing within the
  distance is lost, and the rest of the text costs one table lookup per word.
* CGK embedding.  A random walk over the window's words, steered by random bits
  for (step, word), writes one symbol a step; windows at a small edit distance
  agree with the item in many places.  A walk leaves its n words after about
  2n steps; what it writes then is padding, which agrees with nothing.
* Bit sampling.  Each of ``repetitions`` rounds has an embedding of its own, of
  whose first 2n places it samples ``GROUPS`` times ``SAMPLED``; window and item
  must agree in all places of one group.  The number of rounds is for pairs with
  the share ``AGREE`` of equal places, 1 - (1 - AGREE^SAMPLED)^rounds >= recall.
  Pairs with all n // 5 edits have less; ``GROUPS`` is measured on them: with
  one group 0.85 of the items of 45 to 59 words with evenly spread deletions
  are found, with four 0.99, and all of the other kinds of edits tried.
* Windows that pass are verified: the least word edit distance between the item
  and any run of words near the window.

The benchmark is broadcast in blocks of bounded size; a larger one takes more
passes.

Defined cases: null and empty texts, and items without words, match nothing; a
null item_id is reported as null; equal items are reported each; an item
matches a document once, at its best place (then the first); empty tables give
no rows; other columns are not read (``drop_contaminated`` hands them on).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm.common import U64, Words, arrow_map, mix, ranges, read, small_batches, text_bytes

SEED_WORDS = 3
SHORT = 8
#: Two places of each group; the share of equal places that the number of
#: rounds is computed for.
SAMPLED, AGREE, RECALL = 2, 0.5, 0.99
#: Groups of sampled places in a round.
GROUPS = 4
#: Bytes of item text that one pass broadcasts.
BLOCK_BYTES = 16 << 20
FILTER_BITS = 1 << 22
#: Windows that walk together.
WINDOWS = 1024


def repetitions(recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREE ** SAMPLED))


def allowed(n: int) -> int:
    return n // 5 if n >= SHORT else 0


class Items:
    """A block of benchmark items as arrays."""

    def __init__(self, ids: list, texts: list[bytes]):
        words = Words(pa.array(texts, pa.binary()), lower=True)
        keep = np.flatnonzero(words.counts() > 0)
        self.ids = [ids[i] for i in keep]
        self.words = [words.hash[words.first[i]:words.first[i + 1]] for i in keep]
        self.size = np.array([len(w) for w in self.words], np.int64)
        grams, item, place = [], [], []
        for j, w in enumerate(self.words):
            q = min(SEED_WORDS, len(w))
            g = _grams(w, q)
            grams.append(g)
            item.append(np.full(len(g), j))
            place.append(np.arange(len(g)))
        none = np.empty(0, np.int64)
        g = np.concatenate([none.astype(U64), *grams])
        order = np.argsort(g, kind="stable")
        self.gram = g[order]
        self.item = np.concatenate([none, *item])[order]
        self.place = np.concatenate([none, *place])[order]
        self.bits = np.zeros(FILTER_BITS, bool)
        self.bits[(self.gram & U64(FILTER_BITS - 1)).astype(np.int64)] = True
        self.lengths = sorted({min(SEED_WORDS, int(s)) for s in self.size})
        longest = int(self.size.max(initial=0))
        rng = np.random.default_rng(77)
        rounds = repetitions()
        #: sampled places as shares of 2n, the same for windows and items
        self.share = rng.random((rounds, GROUPS, SAMPLED))
        self.longest, self.rounds = longest, rounds
        self.seeds_of_rounds = list(range(1, rounds + 1))
        self._samples: np.ndarray | None = None

    def samples(self) -> np.ndarray:
        """The sampled places of the items themselves, made once a task."""
        if self._samples is None:
            self._samples = np.zeros((len(self.words), *self.share.shape), np.uint32)
            for a in range(0, len(self.words), WINDOWS):
                part = self.words[a:a + WINDOWS]
                table = np.zeros((len(part), max(map(len, part))), U64)
                for k, w in enumerate(part):
                    table[k, :len(w)] = w
                self._samples[a:a + WINDOWS] = sampled_symbols(
                    table, self.size[a:a + WINDOWS], self.share, self.seeds_of_rounds)
        return self._samples

    def seeds(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, window start within the text), distinct."""
        rows, items, starts = [], [], []
        for q in self.lengths:
            g, at = _text_grams(words, q)
            hit = np.flatnonzero(self.bits[(g & U64(FILTER_BITS - 1)).astype(np.int64)])
            lo = np.searchsorted(self.gram, g[hit], "left")
            n = np.searchsorted(self.gram, g[hit], "right") - lo
            which = ranges(lo, n)
            where = np.repeat(at[hit], n)
            same = np.minimum(self.size[self.item[which]], SEED_WORDS) == q
            which, where = which[same], where[same]
            rows.append(words.row[where])
            items.append(self.item[which])
            starts.append(where - words.first[words.row[where]] - self.place[which])
        if not rows:
            none = np.empty(0, np.int64)
            return none, none, none
        found = np.unique(np.stack([np.concatenate(x) for x in (rows, items, starts)]), axis=1)
        return found[0], found[1], found[2]


def _grams(w: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(len(w) - q + 1, U64)
    with np.errstate(over="ignore"):
        for j in range(q):
            out = out * U64(0x9E3779B97F4A7C15) + w[j:len(w) - q + 1 + j]
    return mix(out, q)


def _text_grams(words: Words, q: int) -> tuple[np.ndarray, np.ndarray]:
    if len(words.hash) < q:
        return np.empty(0, U64), np.empty(0, np.int64)
    g = _grams(words.hash, q)
    at = np.flatnonzero(words.row[:len(g)] == words.row[q - 1:])
    return g[at], at


def _term(seed: int) -> int:
    """What ``mix`` adds to its argument for a seed."""
    return (0x632BE59BD9B4E019 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF


def sampled_symbols(symbols: np.ndarray, size: np.ndarray, shares: np.ndarray,
                    seeds: list[int]) -> np.ndarray:
    """Sampled places of the CGK embeddings of many strings at once.

    ``symbols``: strings as rows, padded with 0; ``size``: their lengths;
    ``shares``: the places of each round as parts of 2 x length.  In round r
    the walk of step t stays or moves on by one bit of (seed r, t, symbol).
    Returns 32 bits of each symbol (string, round, group, sample); 0 where the
    walk has left its string.
    """
    n, width = symbols.shape
    rounds, samples = shares.shape[0], shares[0].size
    wanted = (shares.reshape(1, rounds, samples) * 2 * size[:, None, None]).astype(np.int64)
    out = np.zeros((n, rounds, samples), np.uint32)
    padded = np.concatenate([symbols, np.zeros((n, 1), U64)], 1)
    place = np.zeros((n, rounds), np.int64)
    for t in range(int(wanted.max(initial=-1)) + 1):
        now = np.take_along_axis(padded, np.minimum(place, width), 1)
        here = wanted == t
        if here.any():
            low = (now >> U64(32)).astype(np.uint32)
            out[here] = np.broadcast_to(low[:, :, None], out.shape)[here]
        shift = np.array([(_term(x * 100_003 + t) - _term(0)) & 0xFFFFFFFFFFFFFFFF
                          for x in seeds], U64)
        with np.errstate(over="ignore"):
            place += ((mix(now + shift[None, :]) >> U64(40)) & U64(1)).astype(np.int64)
    return out.reshape(n, *shares.shape)


def passes(items: Items, words: Words, row: np.ndarray, item: np.ndarray,
           start: np.ndarray) -> np.ndarray:
    """Which windows agree with their item in one round at least."""
    if not len(row):
        return np.empty(0, bool)
    size = items.size[item]
    width = int(size.max())
    at = start[:, None] + np.arange(width)[None, :]
    length = words.counts()[row]
    inside = (at >= 0) & (at < length[:, None]) & (np.arange(width)[None, :] < size[:, None])
    window = np.where(inside, words.hash[np.where(inside, words.first[row][:, None] + at, 0)],
                      U64(0))
    good = np.zeros(len(row), bool)
    for a in range(0, len(row), WINDOWS):
        part = slice(a, a + WINDOWS)
        x = sampled_symbols(window[part], size[part], items.share, items.seeds_of_rounds)
        same = (x == items.samples()[item[part]]) & (x != 0)
        good[part] = same.all(3).any((1, 2))
    return good


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end): the run of ``text`` with the least word edit
    distance to ``item``, the first such."""
    m = len(text)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for i, w in enumerate(item):
        swap = cost[:-1] + (text != w)
        drop = cost[1:] + 1
        new, origin = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], origin[0] = i + 1, 0
        new[1:] = np.minimum(swap, drop)
        origin[1:] = np.where(swap <= drop, begin[:-1], begin[1:])
        flat = new - steps
        low = np.minimum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat == low, steps, 0))
        cost, begin = low + steps, origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def matches(items: Items, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, end word, distance) of every contaminated
    (text, item)."""
    words = Words(texts, lower=True)
    row, item, start = items.seeds(words)
    good = passes(items, words, row, item, start)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, j, s in zip(row[good].tolist(), item[good].tolist(), start[good].tolist()):
        e = allowed(int(items.size[j]))
        if best.get((r, j), (1,))[0] == 0 and s >= best[r, j][1]:
            continue
        total = int(words.first[r + 1] - words.first[r])
        a, b = max(0, s - e), min(total, s + int(items.size[j]) + e)
        f = int(words.first[r])
        d, x, y = best_run(items.words[j], words.hash[f + a:f + b])
        if d <= e and (d, a + x, a + y) < best.get((r, j), (e + 1, 0, 0)):
            best[r, j] = (d, a + x, a + y)
    return [(r, j, x, y, d) for (r, j), (d, x, y) in sorted(best.items())]


def item_blocks(benchmark: DataFrame):
    """The benchmark in blocks of about ``BLOCK_BYTES``."""
    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             text_bytes().alias("_t"))
    total = plain.agg(F.sum(F.length("_t"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    key = F.pmod(F.xxhash64("item_id", "_t"), F.lit(blocks))
    for k in range(blocks):
        rows = plain.where(key == k).collect()
        yield Items([r["item_id"] for r in rows], [bytes(r["_t"]) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, distance) per document and item."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_t"))
    out = None
    for block in item_blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def rows(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            items = held.value
            found = matches(items, batch.column(1))
            r, j, x, y, d = (list(c) for c in zip(*found)) if found else ([],) * 5
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(r, pa.int64())),
                 pa.array([items.ids[k] for k in j], pa.int64()),
                 *(pa.array(c, pa.int64()) for c in (x, y, d))],
                names=["doc_id", "item_id", "first_word", "end_word", "distance"])
        part = arrow_map(plain, rows, "doc_id long, item_id long, first_word long, "
                         "end_word long, distance long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns."""
    spark = docs.sparkSession
    small_batches(spark)
    names = docs.columns
    at = names.index("text")
    for block in item_blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def rows(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            texts = batch.column(at).cast(pa.binary())
            if texts.null_count:
                texts = pa.array([x or b"" for x in texts.to_pylist()], pa.binary())
            hit = {r for r, *_ in matches(held.value, texts)}
            return batch.filter(pa.array([i not in hit for i in range(batch.num_rows)]))
        # columns travel under plain names: an own name may hold any character
        plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
        docs = arrow_map(plain, rows, plain.schema).toDF(*names)
    return docs


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

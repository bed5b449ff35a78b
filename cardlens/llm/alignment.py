"""Alignment of two tokenizers by lockstep merging.

Every text is encoded by a byte-level vocabulary (A) and by a piece vocabulary
(B).  Both give the same bytes, a blank and the text, so every token has an end
in one common byte row.  Ends that both sides share cut the tokens into groups,
and the A and the B token that end there are linked.

The ends are merged in lockstep: one state vector holds the A and the B pointer
of every document of a batch.  A step compares the two ends of all documents at
once, emits link and cut where they are equal, and moves the pointer (both, if
equal) that lags behind; documents that have come to their end leave the
vector.  A long document is dealt to several places of the vector at blanks,
where both sides surely end a token, so the number of steps is bounded.

How often an id pair is linked in the whole corpus is counted in Spark, from
the pairs of each document, summed up within a task first.  The way back to the
documents is split by frequency: pairs with at least 1/2^``HOT_BITS`` of all
links are at most 2^``HOT_BITS`` and go to all tasks as two arrays; all others
are too rare for a hot key and are joined.  The highest count of each B id is a
table of the size of the vocabulary.

Defined cases: texts null, empty, or whose joined A or B bytes differ from
blank and text (the piece vocabulary's own blank sign, for one) have no tokens
and all their numbers are 0; strings of special tokens are plain text; rows
with equal ids or texts count each for itself; a null id stays null; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm.common import portions, read, small_batches, stored

#: Words whose ids a task remembers, and the longest of them in characters.
MEMORY_WORDS, MEMORY_CHARS = 200_000, 48
#: Words of a document that share one place of the state vector.
LANE_WORDS = 512
#: Pairs with at least 1/2^18 of all links: at most 2^18 of them.
HOT_BITS = 18
#: Pair counts that a task holds before it puts them out.
HELD_PAIRS = 1 << 21
PAIR_BASE = 1 << 24

#: Characters on which both libraries of the byte-level vocabulary split alike.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: A blank next to other white space: such texts are encoded as a whole.
_LOOSE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")

ROWS = ("row long, doc_id long, n_a long, n_b long, n_groups long, groups string, "
        "pairs array<long>, counts array<int>")


def tokenizer_files() -> tuple[str, str, str, str]:
    """(json file, rank file and split pattern of A, model file of B)."""
    import public_tokenizers as files
    return (files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN,
            files.path("piece_bpe_32k.model"))


class PairEncoder:
    """A and B ids of texts, as little-endian 32-bit bytes.

    No token of either side crosses a single blank between other characters, so
    most texts are encoded word by word, each with the blank before it, and the
    ids of a word are remembered.
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str, model_path: str):
        import base64

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(json_path)
        self.slow.encode_special_tokens = True
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = max(self.slow.get_vocab_size(), 1 + max(ranks.values()))
        self.a_bytes = [b""] * size
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i)
                        else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.pieces.id_to_piece,
                                                  range(self.pieces.get_piece_size())))]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _both(self, a: list[int], b: list[int], text: str) -> tuple[bytes, bytes] | None:
        """Packed ids, or None where either side does not give the text back."""
        raw = b" " + text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or \
                b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return array("I", a).tobytes(), array("I", b).tobytes()

    def lanes(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """For every text the ids of its lanes, in order; none where it has no
        tokens."""
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        words: list[list[str] | None] = []
        for t in texts:
            plain = t and t[0] != " " and t[-1] != " " and _PLAIN.fullmatch(t) \
                and not any(x in t for x in _LOOSE)
            words.append(t.split(" ") if plain else None)
        new = list({w for ws in words if ws for w in ws if w not in known})
        fast = self.fast.encode_ordinary
        got = {w: self._both(fast(" " + w), b, w)
               for w, b in zip(new, self.pieces.encode(new, num_threads=1) if new else [])}
        known.update((w, x) for w, x in got.items() if len(w) <= MEMORY_CHARS)
        find = (lambda w: got[w] if w in got else known[w]) if got else known.__getitem__
        out = []
        for t, ws in zip(texts, words):
            if ws is None:
                whole = t and self._both(
                    self.slow.encode(" " + t, add_special_tokens=False).ids,
                    self.pieces.encode(t), t)
                out.append([whole] if whole else [])
                continue
            parts = list(map(find, ws))
            out.append([] if None in parts else
                       [(b"".join([a for a, _ in lane]), b"".join([b for _, b in lane]))
                        for lane in (parts[i:i + LANE_WORDS]
                                     for i in range(0, len(parts), LANE_WORDS))])
        return out


@cache
def pair_encoder(*files: str) -> PairEncoder:
    """One per Python worker."""
    return PairEncoder(*files)


def merge(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray,
          a_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lockstep merge of many lanes: (A token, B token) of every shared end.

    ``a_end``/``b_end``: ends of all tokens; ``a_first``/``b_first``: the first
    token of each lane; ``a_stop``: one past its last A token.  Both sides of a
    lane end at the same place, and every token has a length.
    """
    at_a, at_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    on = a_first < a_stop
    a, b, stop = a_first[on], b_first[on], a_stop[on]
    while len(a):
        x, y = a_end[a], b_end[b]
        cut = x == y
        at_a.append(a[cut])
        at_b.append(b[cut])
        a = a + (x <= y)
        b = b + (y <= x)
        on = a < stop
        if not on.all():
            a, b, stop = a[on], b[on], stop[on]
    # links of a lane come in order and lanes follow each other on both sides
    return np.sort(np.concatenate(at_a)), np.sort(np.concatenate(at_b))


def _group_texts(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray,
                 docs: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every document.

    ``cut_a``/``cut_b``: the last token of each group; ``docs``: first token of
    each document on both sides together, and their number.
    """
    def group(n: int, cuts: np.ndarray) -> np.ndarray:
        last = np.zeros(n, np.int64)
        last[cuts] = 1
        return np.cumsum(last) - last
    # tokens in the order of the text: the A, then the B tokens of a group
    place_a = np.arange(len(a)) + np.r_[0, cut_b + 1][group(len(a), cut_a)]
    place_b = np.arange(len(b)) + (cut_a + 1)[group(len(b), cut_b)]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[place_a[cut_a]] = ord("|")
    mark[place_b[cut_b]] = ord(";")
    digits = np.ones(len(ids), np.int64)
    most = int(ids.max()) if len(ids) else 0
    limit = 10
    while limit <= most:
        digits += ids >= limit
        limit *= 10
    end = np.cumsum(digits + 1)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = mark
    place, rest = end - 2, ids
    while len(rest):
        rest, digit = np.divmod(rest, 10)
        out[place] = digit + 48
        more = rest > 0
        place, rest = place[more] - 1, rest[more]
    edge = np.r_[0, end][docs]
    whole = out.tobytes()
    return [whole[x:y - 1] if y > x else b"" for x, y in zip(edge.tolist(), edge[1:].tolist())]


def align(docs: DataFrame, files: tuple[str, str, str, str] | None = None) -> DataFrame:
    """One row per document: number of tokens and groups, the groups as text,
    and its linked id pairs (A id x ``PAIR_BASE`` + B id) with their counts.
    ``row`` tells rows apart."""
    files = files or tokenizer_files()

    def rows(batch: pa.RecordBatch, enc: PairEncoder, first: int) -> pa.RecordBatch:
        n = batch.num_rows
        lanes = enc.lanes([t or "" for t in batch.column(1).to_pylist()])
        flat = [x for doc in lanes for x in doc]
        doc_of = np.repeat(np.arange(n), [len(x) for x in lanes])
        a = np.frombuffer(b"".join([x for x, _ in flat]), "<u4").astype(np.int64)
        b = np.frombuffer(b"".join([x for _, x in flat]), "<u4").astype(np.int64)
        size_a = np.array([len(x) // 4 for x, _ in flat], np.int64)
        size_b = np.array([len(x) // 4 for _, x in flat], np.int64)
        stop_a, stop_b = np.cumsum(size_a), np.cumsum(size_b)
        cut_a, cut_b = merge(np.cumsum(enc.a_len[a]), np.cumsum(enc.b_len[b]),
                             stop_a - size_a, stop_b - size_b, stop_a)
        n_a = np.bincount(doc_of, size_a, n).astype(np.int64)
        n_b = np.bincount(doc_of, size_b, n).astype(np.int64)
        end_a = np.cumsum(n_a)
        doc_of_link = np.searchsorted(end_a, cut_a, "right")
        texts = _group_texts(a, b, cut_a, cut_b, np.r_[0, end_a + np.cumsum(n_b)])
        # pairs of a document once each, with their number
        pair = a[cut_a] * PAIR_BASE + b[cut_b]
        order = np.lexsort((pair, doc_of_link))
        pair, own = pair[order], doc_of_link[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        offs = pa.array(np.searchsorted(own[at], np.arange(n + 1)).astype(np.int32))
        counts = np.diff(np.r_[at, len(pair)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(first + np.arange(n)), batch.column(0), pa.array(n_a), pa.array(n_b),
             pa.array(np.bincount(doc_of_link, minlength=n).astype(np.int64)),
             pa.array(texts, pa.binary()).cast(pa.string()),
             pa.ListArray.from_arrays(offs, pa.array(pair[at])),
             pa.ListArray.from_arrays(offs, pa.array(counts))],
            names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first = pair_encoder(*files), TaskContext.get().partitionId() << 36
        for batch in portions(batches):
            if batch.num_rows:
                yield rows(batch, enc, first)
                first += batch.num_rows

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def _sums(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
    return pair[at], np.add.reduceat(n[order], at) if len(at) else np.empty(0, np.int64)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in the batch, pair, count) of the list columns."""
    pairs = batch.column("pairs")
    own = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
    return (own, pairs.flatten().to_numpy(),
            batch.column("counts").flatten().to_numpy().astype(np.int64))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the whole table hold each id pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(parts: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(parts[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 16)]) for x in parts],
                                                 names=["pair", "n"])
        for batch in batches:
            _, pair, n = _lists(batch)
            held.append((pair, n))
            size += len(pair)
            if size > HELD_PAIRS:
                held = [_sums(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield from out(held[0])
                    held, size = [], 0
        if held:
            yield from out(_sums(*map(np.concatenate, zip(*held))))
    return (aligned.select("pairs", "counts").mapInArrow(run, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")))


def rate_links(aligned: DataFrame, hot_bits: int = HOT_BITS) -> DataFrame:
    """Add ``n_links``, ``n_best`` (links whose count is the highest that their
    B id has) and ``count_sum`` to the written rows of ``align``."""
    counts = stored(link_counts(aligned))
    b_id = F.pmod("pair", F.lit(PAIR_BASE)).alias("b")
    highest = counts.groupBy(b_id).agg(F.max("n").alias("most"))
    # one row for each id of a vocabulary
    rated = (counts.withColumn("b", b_id).join(F.broadcast(highest), "b")
             .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * F.lit(1 << hot_bits) >= F.lit(total)
    hot = rated.where(is_hot).orderBy("pair").toArrow()
    keys, n_of, best_of = (hot.column(c).to_numpy() for c in ("pair", "n", "best"))
    held = aligned.sparkSession.sparkContext.broadcast((keys, n_of, best_of))

    def places(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(held.value[0], pair), max(0, len(held.value[0]) - 1))
        return at, (held.value[0][at] == pair if len(held.value[0]) else np.zeros(len(pair), bool))

    def rows_of_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, pair, c = _lists(batch)
            at, is_in = places(pair)
            own, at, hit, n = own[is_in], at[is_in], c[is_in], batch.num_rows
            links = np.zeros(n, np.int64)
            np.add.at(links, _lists(batch)[0], c)
            best, total_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(best, own, hit * held.value[2][at])
            np.add.at(total_, own, hit * held.value[1][at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(links), pa.array(best), pa.array(total_)],
                names=["row", "n_links", "best", "total"])

    def rare_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, pair, c = _lists(batch)
            out = ~places(pair)[1]
            row = batch.column("row").to_numpy()[own[out]]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pair[out]), pa.array(c[out])],
                                             names=["row", "pair", "c"])

    lists = aligned.select("row", "pairs", "counts")
    hot_part = lists.mapInArrow(rows_of_hot, "row long, n_links long, best long, total long")
    rare_part = (lists.mapInArrow(rare_links, "row long, pair long, c long")
                 .join(rated.where(~is_hot).hint("shuffle_merge"), "pair")
                 .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).alias("best"),
                                     F.sum(F.col("c") * F.col("n")).alias("total")))
    sums = (hot_part.unionByName(rare_part.withColumn("n_links", F.lit(0).cast("long")))
            .groupBy("row").agg(F.sum("n_links").alias("n_links"), F.sum("best").alias("n_best"),
                                F.sum("total").alias("count_sum")))
    return aligned.drop("pairs", "counts").join(sums.hint("shuffle_merge"), "row")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    out = rate_links(stored(rows.withColumn("groups_sha256", digest).drop("groups")))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      "groups_sha256")

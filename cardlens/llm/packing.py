"""Best-fit packing by exact-complement hashing.

Documents become token ids plus one end id; only longer ones than the capacity
are cut.  Packing needs nothing but the number of pieces of each length (at
most ``capacity`` counts), so Spark counts lengths and the driver lays out
*patterns*, i.e. which lengths share a sequence and how often:

* the longest length left opens a sequence; its gap is looked up in the index
  of single lengths, of pair sums and of triple sums, and a combination that
  fills the gap exactly is consumed as often as the counts allow;
* where none exists the longest length that fits is put in (best fit) and the
  rest of the gap is looked up again.

Each step uses up some length, so there are at most a few patterns per length.
Spark then numbers the pieces of each length (a running count inside each task
plus the counts of the tasks before it) and reads place and sequence off the
pattern table.  No piece passes through the driver.

Defined cases: null or empty text is one piece holding the end id alone; rows
with equal ids or texts are packed each for itself; a null id stays null; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.llm.common import read, small_batches
from cardlens.session import materialize

CAPACITY = 2048
END_ID = 0
#: Units whose ids a task remembers, and the longest of them in characters.
MEMORY_UNITS, MEMORY_CHARS = 300_000, 48

#: Characters on which both tokenizer libraries split alike; others take the
#: slower library.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: A blank next to other white space.
_LOOSE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, place long"


class Encoder:
    """Ids of a text under the byte-level vocabulary ``<name>.json``.

    The rank file of the same vocabulary gives the same ids several times
    faster.  Texts are cut before single blanks, where no token crosses, and
    the ids of short units are remembered.  Texts with special-token strings
    or with characters outside Latin script go through the json file itself.
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import base64
        import os

        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={})
        self.known: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        return np.array(self.fast.encode_ordinary(unit), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text[:1] == " " or text[-1:] == " " or any(x in text for x in _LOOSE):
            return self._unit(text)
        first, *rest = text.split(" ")
        known = self.known
        if len(known) > MEMORY_UNITS:
            known.clear()
        out = []
        for u in rest:
            got = known.get(u)
            if got is None:
                got = self._unit(" " + u)
                if len(u) <= MEMORY_CHARS:
                    known[u] = got
            out.append(got)
        return self._unit(first) + b"".join(out)


@cache
def encoder(json_path: str, rank_path: str, pattern: str) -> Encoder:
    """One per Python worker."""
    return Encoder(json_path, rank_path, pattern)


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers as files
    return files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str] | None = None,
           capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Cut documents to pieces: ``PIECES`` and, on request, the ids.

    ``tokenizer``: paths of the json and the rank file and the split pattern.
    ``pid``/``place``: the task and the piece's number among the pieces of its
    length in that task.
    """
    files = tokenizer or tokenizer_files()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*files)
        pid, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                n = len(ids) // 4
                head = n % capacity or capacity
                cuts = [0, *range(head, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a:4 * b]
                    out.append((doc, k, a, b - a, zlib.crc32(part), pid, seen[b - a], part))
                    seen[b - a] += 1
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
                     pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "place"]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
            if keep_ids:
                flat = np.frombuffer(b"".join(cols[7]), "<u4").astype(np.int32)
                offs = np.cumsum([0, *cols[3]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


class _Index:
    """Which sums of one, two and three available lengths exist."""

    def __init__(self, left: np.ndarray):
        self.left, self.stale = left, True

    def refresh(self) -> None:
        if self.stale:
            have = np.flatnonzero(self.left).tolist()
            self.single = sum(1 << x for x in have)
            self.pair = 0
            limit = (1 << len(self.left)) - 1
            for x in have:
                self.pair |= (self.single << x) & limit
            self.have, self.stale = have[::-1], False

    def fill(self, gap: int, used: Counter) -> list[int] | None:
        """Lengths, at most three, summing to ``gap`` and still available."""
        self.refresh()
        left = self.left

        def ok(parts: list[int]) -> bool:
            return all(left[x] >= used[x] + c for x, c in Counter(parts).items())

        if self.single >> gap & 1 and ok([gap]):
            return [gap]
        if self.pair >> gap & 1:
            for b in self.have:
                if 2 * b < gap:
                    break
                if b < gap and self.single >> (gap - b) & 1 and ok([b, gap - b]):
                    return [b, gap - b]
        for b in self.have:
            if 3 * b < gap:
                break
            rest = gap - b
            if rest > 1 and self.pair >> rest & 1:
                for c in self.have:
                    if 2 * c < rest:
                        break
                    if c < rest and self.single >> (rest - c) & 1 and ok([b, c, rest - c]):
                        return [b, c, rest - c]
        return None


def layout(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns ``(times, lengths)`` that use up the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for x, c in histogram.items():
        left[x] = c
    index, out = _Index(left), []
    for a in range(capacity, 0, -1):
        while left[a]:
            parts, used, gap = [a], Counter({a: 1}), capacity - a
            while gap:
                found = index.fill(gap, used)
                if found is None:
                    index.refresh()
                    b = next((x for x in index.have if x <= gap and left[x] > used[x]), 0)
                    if not b:
                        break
                    # several of one length at once: keeps the loop short for tiny lengths
                    found = [b] * max(1, min(gap // b, int(left[b]) - used[b]) // 2)
                parts += found
                used.update(found)
                gap -= sum(found)
            times = min(int(left[x]) // c for x, c in used.items())
            for x, c in used.items():
                left[x] -= times * c
                index.stale |= left[x] == 0
            out.append((times, sorted(parts, reverse=True)))
    return out


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows ``(length, first rank, first sequence, offset, pieces per
    sequence)`` sorted by length and rank."""
    rows, rank, sequence = [], Counter(), 0
    for times, parts in patterns:
        at = 0
        for x, c in sorted(Counter(parts).items(), reverse=True):
            rows.append((x, rank[x], sequence, at, c))
            rank[x] += times * c
            at += x * c
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a written table with
    ``pid``, ``length``, ``place``; further columns stay)."""
    counts = cut.groupBy("pid", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in
                 counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = slots(layout(histogram, capacity))
    width = int(table[:, 1].max()) + 1 if len(table) else 1
    keys = table[:, 0] * width + table[:, 1]
    before = W.partitionBy("length").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("pid").alias("_pid"), F.col("length").alias("_length"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = (cut.join(offsets, (cut["pid"] == offsets["_pid"])
                       & (cut["length"] == offsets["_length"]))
              .withColumn("_rank", F.col("_before") + F.col("place"))
              .drop("_pid", "_length", "_before", "pid", "place"))
    kept = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), "right") - 1
            row = table[at]
            turn, nth = np.divmod(rank - row[:, 1], row[:, 4])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array(row[:, 2] + turn), pa.array(row[:, 3] + nth * length)],
                names=[*kept, "sequence_id", "offset"])

    types = dict(ranked.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: tuple[str, str, str] | None = None,
                   capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` ids:
    one row per piece with its place."""
    return pack(materialize(pieces(docs, tokenizer, capacity, keep_ids)), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))

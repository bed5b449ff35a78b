"""Helpers shared by the corpus operators.

Texts travel to Python as Arrow binary columns, so a whole Arrow batch is one
byte buffer and the word work (split, lower-case, hash) is a few numpy passes
over it instead of a loop over words.

Word rule everywhere: ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes.  A null text
counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Base of the polynomial word hash (odd, so it has an inverse modulo 2^64).
HASH_BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(HASH_BASE, -1, 1 << 64)
#: Rows of one Arrow batch and text bytes of one numpy pass: they bound the
#: memory of a Python task.
BATCH_ROWS = 400
PORTION_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session to ``BATCH_ROWS`` rows, since one
    text may hold megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(col: str = "text"):
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have yet, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list:
    """All columns of ``df`` by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            if (out := rows(batch)) is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def portions(batches: Iterator[pa.RecordBatch],
             most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about ``most`` bytes (one text at
    least): numpy work needs some fifty bytes for each byte of text."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for col in batch.columns:
            if pa.types.is_binary(col.type) or pa.types.is_string(col.type):
                size += pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = tuple(np.multiply.accumulate(np.r_[U64(1), np.full(size, b, U64)])
                            for b in (HASH_BASE, BASE_INVERSE))
    return _powers


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x + U64((0x632BE59BD9B4E019 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow column without nulls."""
    if pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Words:
    """All words of a batch of texts.

    ``hash``: 64-bit hash per word; ``row``: its text; ``start``/``end``: byte
    places in ``data``; ``first``: index of each text's first word (one more
    entry than texts).
    """

    def __init__(self, texts: pa.Array, lower: bool, seed: int = 0):
        data, off = buffer_of(texts)
        self.raw, self.offsets = data, off
        self.data = _LOWER[data] if lower else data
        n = len(data)
        gap = np.ones(n + 1, bool)
        gap[:n] = _SPACE[data]
        begin = ~gap[:n]
        begin[1:] &= gap[:n - 1] if n else gap[:0]
        inner = off[1:-1]
        inner = inner[inner < n]
        begin[inner] |= ~gap[inner]
        stop = ~gap[:n]
        stop &= gap[1:]
        last = inner[inner > 0] - 1
        stop[last] |= ~gap[last]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.hash = self._hashes(seed)

    def _hashes(self, seed: int) -> np.ndarray:
        n = len(self.data)
        up, down = _power_tables(n + 1)
        prefix = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum((self.data.astype(U64) + U64(1 + 2 * seed)) * up[:n], out=prefix[1:])
            h = (prefix[self.end] - prefix[self.start]) * down[self.start]
            return mix(h + (self.end - self.start).astype(U64) * U64(0xA24BAED4963EE407), seed)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every run of ``n`` words within
        one text."""
        h, total = (mix(self.hash, seed) if seed else self.hash), len(self.hash)
        if total < n:
            return np.empty(0, U64), np.empty(0, np.int64)
        out = np.zeros(total - n + 1, U64)
        with np.errstate(over="ignore"):
            for j in range(n):
                out = out * U64(HASH_BASE) + h[j:total - n + 1 + j]
        at = np.flatnonzero(self.row[:total - n + 1] == self.row[n - 1:])
        return mix(out[at], seed), at


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of ``start .. start+length-1``, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(total)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans nobody holds any more (its
    cleaner acts on garbage collection, which an idle driver seldom does)."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder, read it back and
    release the shuffles that made it."""
    from cardlens.session import materialize
    out = materialize(df)
    release(out.sparkSession)
    return out


def empty_batch(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema=schema)


class Membership:
    """Approximate set of 64-bit hashes of fixed size: 2^27 bits in 256
    segments, two bits a key.  It says yes to every member and to few others;
    those who use it check exactly afterwards."""

    SEGMENTS, BITS = 256, 1 << 19
    #: Above so many members it says yes too often to be of use.
    MOST = 1 << 24

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def places(cls, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first bit, second bit) within the segment."""
        low = U64(cls.BITS - 1)
        return ((h >> U64(56)).astype(np.int64), (h & low).astype(np.int64),
                ((h >> U64(24)) & low).astype(np.int64))

    @classmethod
    def build(cls, keys: DataFrame, col: str) -> Membership:
        """From a long column.  Each segment is made where its keys are; only
        the bits, whose size is fixed, come to the driver."""
        def segment(table: pa.Table) -> pa.Table:
            h = table.column(1).combine_chunks().to_numpy(zero_copy_only=False).view(U64)
            s, a, b = cls.places(h)
            bits = np.zeros(cls.BITS, np.uint8)
            bits[a] = 1
            bits[b] = 1
            return pa.table({"s": pa.array([int(s[0])], pa.int32()),
                             "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})
        top = F.shiftrightunsigned(F.col(col), 56).cast("int")
        rows = (keys.select(top.alias("_s"), F.col(col).alias("_h")).groupBy("_s")
                .applyInArrow(segment, "s int, bits binary").collect())
        bits = np.zeros((cls.SEGMENTS, cls.BITS // 8), np.uint8)
        for r in rows:
            bits[r["s"]] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        s, a, b = self.places(h)

        def bit(x: np.ndarray) -> np.ndarray:
            return (self.bits[s, x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1
        return (bit(a) & bit(b)).astype(bool)

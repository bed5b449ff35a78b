"""Packing by concatenating and cutting.

All documents, as token ids with one end id each, stand one after the other in
one long row of tokens that is cut into windows of ``capacity`` tokens.  Where
a document lies in that row comes from prefix sums in two passes:

* the first pass encodes the documents, writes their ids, and notes for every
  document how many tokens its task has put out before it; the totals of the
  tasks (one number a task) are summed up to the base of each task;
* the second pass reads the written ids.  Base plus tokens before is the global
  offset of a document, so every row knows by itself which windows it reaches:
  no shuffle, no sort and no window over all rows.  A document over a window's
  edge gives one piece to either side; ``goes_on`` marks the pieces that the
  next sequence continues and ``comes_from`` those that continue one, which is
  all that a reader needs to join or mask documents at the edges.

What is left after the last full window is cut by its binary digits, longest
first.  Sequences whose length is a power of two need no padding, so at most
log2(capacity) short sequences end the packing and nothing is padded.

Defined cases: a null or empty text is one piece holding the end id alone; rows
with equal ids or texts are packed each for itself; a null id stays null; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm.common import ranges, read, small_batches
from cardlens.session import materialize

CAPACITY = 4096
END_ID = 2
#: Characters of one pass over texts.
PASS_CHARS = 1 << 20

WORD_END = "</w>"
# fixed value of the vocabulary: how it cuts text before the merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that both libraries cut and lower-case alike, one for one.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-\u012f\u0131-\u017f]*")
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KINDS = np.array([0 if chr(i).isspace() else {"L": _LETTER, "N": _DIGIT}.get(
    unicodedata.category(chr(i))[0], _OTHER) for i in range(0x180)], np.uint8)
_SHORT = [ord(c) for c in "stmd"]
_LONG = [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")]

ROWS = "doc_id long, pid int, before long, doc_tokens long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, comes_from boolean, goes_on boolean")


class WordEncoder:
    """Ids under a vocabulary whose tokens never cross white space.

    Texts of Latin script are encoded many at a time by the faster library: they
    are cut into parts (letters, single digits, other signs, contractions) by
    array operations on their characters, and all parts stand in one string,
    each with a zero byte for the word end, so that the tokens that hold a zero
    byte end the parts.  All other texts go through the json file itself.
    """

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(json_path, encoding="utf-8") as f:
            self._make_fast(json.load(f))

    def _make_fast(self, spec: dict) -> None:
        """Only for a vocabulary of bytes, bytes with word end, and merges in
        the order of their ids; others have no fast way."""
        import tiktoken
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        split, self.fast = spec["pre_tokenizer"].get("pretokenizers", [{}])[0], None
        if (spec["model"].get("end_of_word_suffix") != WORD_END
                or split.get("pattern", {}).get("Regex") != PATTERN
                or [n["type"] for n in spec["normalizer"].get("normalizers", [])]
                != ["NFC", "Replace", "Lowercase"]
                or any(vocab["".join(m)] != 512 + i for i, m in enumerate(pairs))):
            return
        # bytes that print stand for themselves, the others for characters from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(x): x for x in own}
        alphabet |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
        ranks = {bytes(alphabet[c] for c in t.removesuffix(WORD_END)) + b"\0" * t.endswith(WORD_END): i
                 for t, i in vocab.items() if t not in self.special}
        self.ends = np.zeros(1 + max(ranks.values()), bool)
        self.ends[[i for t, i in ranks.items() if t[-1:] == b"\0"]] = True
        self.fast = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks,
                                      special_tokens={})

    def _slow(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fast(self, texts: list[str]) -> list[bytes]:
        joined = "\n".join(t.lower() for t in texts) + "\n"
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = _KINDS[chars]
        start = np.zeros(len(chars) + 3, bool)
        start[:len(chars)] = kind > 0
        start[1:len(chars)] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        # 's 't 'm 'd 're 've 'll are parts, wherever the sign begins one
        at = np.flatnonzero((chars == 39) & start[:len(chars)])
        one, two = (np.r_[chars, 0, 0][at + i] for i in (1, 2))
        short = np.isin(one, _SHORT)
        long = np.isin(one.astype(np.int64) << 16 | two, _LONG)
        start[at[short | long] + 1] = False
        for rest in (at[short] + 2, at[long] + 3):
            start[rest] |= np.r_[kind, 0, 0, 0][rest] == _LETTER
        word = np.flatnonzero(kind > 0)
        end = start[word + 1] | (kind[word + 1] == 0)
        out = np.zeros(len(word) + int(end.sum()), "<u4")
        out[np.arange(len(word)) + np.cumsum(end) - end] = chars[word]
        if not len(out):
            return [b""] * len(texts)
        ids = self.fast.encode_to_numpy(out.tobytes().decode("utf-32-le"), disallowed_special=())
        stops = np.cumsum([len(t) + 1 for t in texts])
        parts = np.searchsorted(word[end], stops)
        cuts = 4 * np.r_[0, np.flatnonzero(self.ends[ids]) + 1][np.r_[0, parts]]
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        plain = [self.fast is not None and bool(_PLAIN.fullmatch(t))
                 and not any(s in t for s in self.special) for t in texts]
        fast: list[bytes] = []
        held, size = [], 0
        for t in (x for x, p in zip(texts, plain) if p):
            if len(t) > PASS_CHARS:     # words do not cross white space, so neither does a cut
                pieces, at = [], 0
                while at < len(t):
                    to = at + PASS_CHARS
                    to = len(t) if to >= len(t) else max(t.rfind(" ", at, to), t.rfind("\n", at, to)) + 1
                    if to <= at:        # one word longer than a pass
                        to = min((x for x in (t.find(" ", at), t.find("\n", at)) if x >= 0),
                                 default=len(t) - 1) + 1
                    pieces.append(t[at:to])
                    at = to
                if held:
                    fast += self._fast(held)
                    held, size = [], 0
                fast.append(b"".join(self._fast([p])[0] for p in pieces))
                continue
            held.append(t)
            size += len(t)
            if size > PASS_CHARS:
                fast += self._fast(held)
                held, size = [], 0
        if held:
            fast += self._fast(held)
        rest = iter(fast)
        return [next(rest) if p else self._slow(t) for t, p in zip(texts, plain)]


@cache
def word_encoder(json_path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(json_path)


def tokenizer_file() -> str:
    import public_tokenizers as files
    return files.path("word_bpe_49k.json")


def token_rows(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """First pass: ids of every document and the tokens before it in its task."""
    path = tokenizer or tokenizer_file()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seen = word_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + end for x in enc.ids([t or "" for t in batch.column(1).to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            last = seen + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), pid, np.int32)), pa.array(last - n),
                 pa.array(n), pa.array(ids, pa.binary())],
                names=["doc_id", "pid", "before", "doc_tokens", "ids"])
            seen = int(last[-1]) if len(last) else seen

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def window_edges(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Edges of the windows behind the last full one: the rest is cut into
    powers of two, longest first.  The first entry ends the full windows."""
    rest = total % capacity
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.cumsum([total - rest, *sizes])


def cut(rows: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Second pass over the written ``token_rows``: ``PIECES`` and, on request,
    the ids of every piece."""
    totals = rows.groupBy("pid").agg(F.sum("doc_tokens").alias("n")).orderBy("pid").toArrow()
    pids = totals.column("pid").to_numpy()
    base = np.cumsum(np.r_[0, totals.column("n").to_numpy()]).astype(np.int64)
    edges = window_edges(int(base[-1]), capacity)
    full = int(edges[0]) // capacity

    def window_of(at: np.ndarray) -> np.ndarray:
        return np.where(at < edges[0], at // capacity,
                        full + np.searchsorted(edges, at, "right") - 1)

    def begin_of(window: np.ndarray) -> np.ndarray:
        return np.where(window < full, window * capacity,
                        edges[np.clip(window - full, 0, len(edges) - 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pid, before, n = (batch.column(c).to_numpy() for c in ("pid", "before", "doc_tokens"))
            at = base[np.searchsorted(pids, pid)] + before
            first = window_of(at)
            pieces = window_of(at + n - 1) - first + 1
            row, window = np.repeat(np.arange(len(n)), pieces), ranges(first, pieces)
            left = np.maximum(begin_of(window), at[row])
            right = np.minimum(begin_of(window + 1), (at + n)[row])
            start, length = left - at[row], right - left
            ids = batch.column("ids").to_pylist()
            parts = [ids[r][4 * a:4 * b] for r, a, b in
                     zip(row.tolist(), start.tolist(), (start + length).tolist())]
            arrays = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length),
                      pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(n[row]),
                      pa.array(window), pa.array(left - begin_of(window)),
                      pa.array(start > 0), pa.array(start + length < n[row])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                     "offset", "comes_from", "goes_on"]
            if keep_ids:
                offs = pa.array(np.cumsum(np.r_[0, length]).astype(np.int32))
                flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(offs, pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def concatenate_and_cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                        end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)``: one row per piece with its place."""
    return cut(materialize(token_rows(docs, tokenizer, end_id)), capacity, keep_ids)


def op13_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concatenate_and_cut(read(spark, sf_dir, "documents"))

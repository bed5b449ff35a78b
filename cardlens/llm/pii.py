"""Personal data: fixed patterns plus bootstrapped contextual extraction.

* Base spans (email, ip, card, phone) come from fixed patterns and checks; they
  are the seeds.
* Each text also gives *near misses*: strings that look like an identifier but
  fail its pattern (a number without ``+``, a card number with a wrong check
  digit, an address part over 255, ``name [at] host [dot] org``).
* What stands around an instance is a pattern: the two words before it, or the
  word before and the word after it (words without punctuation at their edges).
* Spark scores the bipartite graph of patterns and instances in rounds.  A
  pattern is as trustworthy as its instances, discounted if it has few; an
  instance that is no seed is believed if a trusted pattern holds it.  Both
  steps are joins on written tables and aggregates with map-side combine.
  Rounds end when no score rises by more than ``RISE`` and none newly reaches
  ``ACCEPT``; scores only rise and stay below one, so they do end.
* Patterns whose trust reaches ``ACCEPT`` are then matched over all texts.
  Words of ``SHORTEST`` or more characters with a digit, ``@`` or ``_`` can be
  believed; words without such a character are *plain*.  A pattern proposes words only
  if its trust reaches ``ACCEPT`` also with every occurrence of a plain word in
  its slot counted as an instance of score 0; this is decided once, from counts
  by pattern, before any word is sent anywhere.  Every word in the slot of a
  pattern that proposes becomes an instance.  Believed words
  are looked up in all texts, where they induce further patterns.  Scoring and
  matching alternate until no unmatched pattern is trusted and no believed
  word has not been looked up; both sets only grow, so this ends too.
* Near misses and words whose score reaches ``ACCEPT`` become spans, wherever
  they stand outside of base spans and near misses; a word of two kinds takes
  the kind with the higher score, then the first kind listed.

Defined cases: null and empty texts have no spans; rows are treated each for
itself, equal rows alike; a null doc_id stays null; an empty table gives no
rows; other columns of the input are not read (``redact`` hands them on).
Places are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cardlens.llm.common import (HASH_BASE, U64, Membership, Words, arrow_map, fresh, mix, own,
                                 read, signed, small_batches, stored, text_bytes)
from cardlens.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Scores that rise by less have converged.
RISE = 1e-3
#: A pattern with n instances keeps n / (n + DISCOUNT) of their mean score.
DISCOUNT = 1.0
ACCEPT = 0.7
#: Words with fewer characters are never believed.
SHORTEST = 4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.@-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")
_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}"
                 r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'.,;:!?()[]{}<>*#|$%&"
_IS_EDGE = np.zeros(256, bool)
_IS_EDGE[list(_EDGE.encode())] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"0123456789@_")] = True
#: Stand for the words missing at either end of a text.
_BEGIN, _END = U64(1), U64(2)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses.  Only an ``@`` can hold one: the
    part before it reaches back as far as allowed characters go, the part after
    it is matched forward, so the work is linear for any text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _HOST.match(text, at) if a < at else None
        if m:
            out.append((a, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(spans by kind, near misses (kind, start, end))."""
    found = {k: [] for k in KINDS}
    near: list[tuple[str, int, int]] = []
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            good = all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))
            if good:
                found["ip"].append(m.span())
            else:
                near.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                if luhn(digits):
                    found["card"].append(m.span())
                else:
                    near.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                count = sum(c.isdigit() for c in m.group())
                if 9 <= count <= 15:
                    found["phone"].append(m.span())
                else:
                    near.append(("phone", *m.span()))
        near += [("phone", *m.span()) for m in _NUMBER.finditer(text)]
    if "[at]" in text or "(at)" in text:
        near += [("email", *m.span()) for m in _AT.finditer(text)]
    taken = sorted(s for spans in found.values() for s in spans)
    return found, _free_of(near, taken)


def _free_of(near: list[tuple[str, int, int]], taken: list[tuple[int, int]]
             ) -> list[tuple[str, int, int]]:
    """Near misses that touch neither base spans nor an earlier near miss."""
    reach, ends = [], 0
    for a, b in taken:
        ends = max(ends, b)
        reach.append(ends)
    out, last = [], -1
    for kind, a, b in sorted(near, key=lambda x: (x[1], -x[2], x[0])):
        k = bisect_left(taken, (b, -1))
        if a >= last and (k == 0 or reach[k - 1] <= a):
            out.append((kind, a, b))
            last = b
    return out


def contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str, str]]:
    """(second word before, word before, word after) of each span; "" where the
    text has none.  A word that a span is part of counts up to it, from the end
    of the span before it in the same word, if there is one."""
    words = [(a, b, w) for m in _WORD.finditer(text) for a, b in (m.span(),)
             if (w := m.group().strip(_EDGE))]
    starts, ends = [a for a, _, _ in words], [b for _, b, _ in words]
    froms, tos = sorted(a for a, _ in spans), sorted(b for _, b in spans)
    out = []
    for a, b in spans:
        i = bisect_left(starts, a)
        before = []
        if i and ends[i - 1] > a:
            k = bisect_right(tos, a)
            i -= 1
            before = [text[max(starts[i], tos[k - 1] if k else 0):a].strip(_EDGE)]
        before = [w for w in before if w]
        before = [w for _, _, w in words[max(0, i - 2 + len(before)):i]] + before
        j, after = bisect_right(ends, b), ""
        if j < len(words) and starts[j] < b:
            k = bisect_left(froms, b)
            after = text[b:min(ends[j], froms[k] if k < len(froms) else ends[j])].strip(_EDGE)
            j += 1
        if not after and j < len(words):
            after = words[j][2]
        out.append((*(["", ""] + before)[-2:], after))
    return out


def _hashes(words: list[str]) -> np.ndarray:
    """The hash ``Words`` gives each word, case of A-Z aside; 0 for ""."""
    known = sorted(set(words) - {""})
    h = Words(pa.array([w.encode("utf-8", "replace") for w in known], pa.binary()), lower=True).hash
    of = dict(zip(known, h.tolist())) | {"": 0}
    return np.array([of[w] for w in words], U64)


def _patterns(before2: np.ndarray, before: np.ndarray, after: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return (mix(before2 * U64(HASH_BASE) + before, 1), mix(before * U64(HASH_BASE) + after, 2))


def _name(kind: str, s: str) -> str:
    return s.lower() if kind == "email" else (s if kind == "ip" else
                                              "".join(c for c in s if c.isdigit()))


_OCCURRENCE = pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()),
                         ("name", pa.string()), ("seed", pa.bool_()), ("p1", pa.int64()),
                         ("p2", pa.int64())])


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per text: doc_id, _key, n_email.., base, and found: every seed
    and near miss with its patterns."""
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, sha, every, around = {k: [] for k in KINDS}, [], [], []
        for text in batch.column(2).to_pylist():
            text = text or ""
            found, near = base_spans(text)
            for k in KINDS:
                counts[k].append(len(found[k]))
            joined = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])
            sha.append(hashlib.sha256(joined.encode()).hexdigest())
            spans = [(k, a, b, True) for k in KINDS for a, b in found[k]]
            spans += [(k, a, b, False) for k, a, b in near]
            around += contexts(text, [(a, b) for _, a, b, _ in spans]) if spans else []
            every.append([{"kind": k, "a": a, "b": b, "name": _name(k, text[a:b]), "seed": seed}
                          for k, a, b, seed in spans])
        if around:
            before2, before, after = (_hashes(list(w)) for w in zip(*around))
            p1, p2 = _patterns(np.where(before2 == 0, _BEGIN, before2),
                               np.where(before == 0, _BEGIN, before),
                               np.where(after == 0, _END, after))
            flat = (x for items in every for x in items)
            for x, one, two in zip(flat, signed(p1).tolist(), signed(p2).tolist()):
                x["p1"], x["p2"] = one, two
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(counts[k], pa.int64()) for k in KINDS),
             pa.array(sha), pa.array(every, pa.list_(_OCCURRENCE))],
            names=["doc_id", "_key", *(f"n_{k}" for k in KINDS), "base_sha256", "found"])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64("text").alias("_key"), F.col("text").cast("string"))
    return arrow_map(plain, rows, "doc_id long, _key long, "
                     + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, found "
                     "array<struct<kind:string,a:long,b:long,name:string,seed:boolean,"
                     "p1:long,p2:long>>")


def _placed(texts: pa.Array):
    """(words without punctuation at their edges, row, hash, first pattern,
    second pattern, characters before each byte, can it be believed, is it
    plain); None without words."""
    words = Words(texts, lower=True)
    data, n = words.raw, len(words.raw)
    if not len(words.start):
        return None
    plain = ~_IS_EDGE[data]
    place = np.arange(n)
    following = np.minimum.accumulate(np.where(plain, place, n)[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(plain, place, -1))
    start, end = following[words.start], preceding[words.end - 1] + 1
    full = start < end
    row = words.row[full]
    words.start, words.end = start[full], end[full]
    if not len(row):
        return None
    h = words._hashes(0)
    same = row[1:] == row[:-1]
    before = np.full(len(h), _BEGIN)
    before[1:][same] = h[:-1][same]
    before2 = np.full(len(h), _BEGIN)
    before2[2:][row[2:] == row[:-2]] = h[:-2][row[2:] == row[:-2]]
    after = np.full(len(h), _END)
    after[:-1][same] = h[1:][same]
    p1, p2 = _patterns(before2, before, after)
    marks = np.r_[0, np.cumsum(_IS_MARK[data])]
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    plain = marks[words.end] == marks[words.start]
    can = ~plain & (chars[words.end] - chars[words.start] >= SHORTEST)
    return words, row, h, p1, p2, chars, can, plain


def plain_counts(docs: DataFrame, wanted: Membership) -> DataFrame:
    """(pattern, plain): how often plain words stand in the slot of a ``wanted``
    pattern, summed in the tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        placed = _placed(batch.column(0))
        if placed is None:
            return None
        _, _, _, p1, p2, _, _, plain = placed
        p = np.concatenate([p1[plain], p2[plain]])
        p, n = np.unique(p[shared.value.has(p)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(p)), pa.array(n.astype(np.int64))],
                                          names=["pattern", "n"])
    return (arrow_map(docs.select(text_bytes().alias("text")), rows, "pattern long, n long")
            .groupBy("pattern").agg(F.sum("n").alias("plain")))


def slots(docs: DataFrame, wanted: Membership, known: Membership) -> DataFrame:
    """Words outside of base spans and near misses that stand in the slot of a
    ``wanted`` pattern or are ``known`` (each approximately, never too few):
    doc_id, _key, a, b, name, can (it can be believed), p1, p2."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, known))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        wanted, known = shared.value
        placed = _placed(batch.column(2))
        if placed is None:
            return None
        words, row, h, p1, p2, chars, can, _ = placed
        hit = np.flatnonzero(wanted.has(p1) | wanted.has(p2) | known.has(h))
        if not len(hit):
            return None
        s, e = words.start[hit], words.end[hit]
        a = chars[s] - chars[words.offsets[row[hit]]]
        b = chars[e] - chars[words.offsets[row[hit]]]
        can = can[hit]
        free = np.ones(len(hit), bool)
        rows_hit, first = np.unique(row[hit], return_index=True)
        for r, at in zip(rows_hit.tolist(), np.split(np.arange(len(hit)), first[1:])):
            found, near = base_spans(batch.column(2)[r].as_py().decode("utf-8", "replace"))
            held = sorted([x for k in KINDS for x in found[k]] + [(x, y) for _, x, y in near])
            if held:
                froms = np.array([x for x, _ in held])
                reach = np.maximum.accumulate([y for _, y in held])
                i = np.searchsorted(froms, b[at]) - 1
                free[at] = (i < 0) | (reach[np.maximum(i, 0)] <= a[at])
        a, b, can, hit = a[free], b[free], can[free], hit[free]
        take = pa.array(row[hit])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(a, pa.int64()),
             pa.array(b, pa.int64()), pa.array(signed(h[hit])), pa.array(can),
             pa.array(signed(p1[hit])), pa.array(signed(p2[hit]))],
            names=["doc_id", "_key", "a", "b", "name", "can", "p1", "p2"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64("text").alias("_key"), text_bytes().alias("text"))
    return arrow_map(texts, rows, "doc_id long, _key long, a long, b long, name long, can boolean, "
                     "p1 long, p2 long")


def graph_scores(edges: DataFrame, accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """(instances ``_k, _n, word, is_seed, can, score``; patterns ``_k, _p,
    trust``) at the end of the rounds over stored ``edges``."""
    names = edges.groupBy("kind", "name", "word").agg(F.max("seed").alias("is_seed"),
                                                      F.max("can").alias("can"))
    scores = stored(names.select(F.col("kind").alias("_k"), F.col("name").alias("_n"),
                                 F.col("word").alias("_w"), "is_seed", "can",
                                 F.col("is_seed").cast("double").alias("score")))
    moving = True
    while moving:
        held = edges.join(scores.drop("can").hint("shuffle_merge"), (edges["kind"] == scores["_k"])
                          & (edges["name"] == scores["_n"]) & (edges["word"] == scores["_w"]))
        trust = (held.groupBy(F.col("kind").alias("_k"), F.col("pattern").alias("_p"))
                 .agg((F.sum("score") / (F.count("*") + DISCOUNT)).alias("trust"),
                      F.sum("score").alias("total"), F.count("*").alias("n"))
                 .where("trust > 0.2"))
        noisy = (edges.where("can and not seed").join(
            trust.hint("shuffle_merge"), (edges["kind"] == trust["_k"])
            & (edges["pattern"] == trust["_p"]))
            .groupBy("kind", "name", "word").agg(F.max("trust").alias("best")))
        scores = materialize(scores.join(noisy.hint("shuffle_merge"),
                                         (scores["_k"] == noisy["kind"])
                                         & (scores["_n"] == noisy["name"])
                                         & (scores["_w"] == noisy["word"]), "left")
                             .select("_k", "_n", "_w", "is_seed", "can",
                                     F.col("score").alias("was"),
                                     F.when(F.col("is_seed"), F.lit(1.0))
                                     .otherwise(F.coalesce("best", F.lit(0.0))).alias("score")))
        risen = (F.col("score") - F.col("was") > RISE) | (
            (F.col("score") >= accept) & (F.col("was") < accept))
        moving = not scores.where(risen).isEmpty()
        scores = scores.drop("was")
    return scores, stored(trust)


_EDGES = ("kind", "name", "word", "pattern")


def _distinct(edges: DataFrame) -> DataFrame:
    return stored(edges.groupBy(*_EDGES).agg(F.max("seed").alias("seed"),
                                             F.max("can").alias("can")))


def believed(docs: DataFrame, table: DataFrame, accept: float = ACCEPT
             ) -> tuple[DataFrame, DataFrame | None]:
    """(instances ``_k, _n, _w, score`` that trusted patterns hold, seeds
    aside; the words seen in slots, None if no pattern was matched)."""
    each = table.select(F.explode("found").alias("x")).select("x.*")
    edges = _distinct(each.select("kind", F.xxhash64("name").alias("name"),
                                  F.lit(False).alias("word"), "seed", F.lit(True).alias("can"),
                                  F.explode(F.array("p1", "p2")).alias("pattern")))
    asked = looked = seen = None
    while True:
        scores, trust = graph_scores(edges, accept)
        good = scores.where((~F.col("is_seed")) & F.col("can") & (F.col("score") >= accept))
        high = trust.where(F.col("trust") >= accept).select("_k", "_p", "total", "n")
        new = good.where("_w").select("_k", "_n")
        if asked is not None:
            high = high.join(asked.hint("shuffle_merge"), ["_k", "_p"], "left_anti")
            new = new.join(looked.hint("shuffle_merge"), ["_k", "_n"], "left_anti")
        high, new = materialize(high), materialize(new)
        if high.isEmpty() and new.isEmpty():
            return good.select("_k", "_n", "_w", "score"), seen
        asked = high.select("_k", "_p") if asked is None else asked.unionByName(
            high.select("_k", "_p"))
        plain = plain_counts(docs, Membership.build(high, "_p"))
        high = materialize(high.join(plain.hint("shuffle_merge"), high["_p"] == plain["pattern"],
                                     "left")
                           .where(F.col("total") >= accept * (
                               F.col("n") + DISCOUNT + F.coalesce("plain", F.lit(0))))
                           .select("_k", "_p"))
        hits = stored(slots(docs, Membership.build(high, "_p"), Membership.build(new, "_n")))
        both = hits.select("name", "can", F.explode(F.array("p1", "p2")).alias("pattern")) \
            .groupBy("name", "pattern").agg(F.max("can").alias("can"))
        fillers = both.join(high.hint("shuffle_merge"), both["pattern"] == high["_p"])
        others = both.join(new.hint("shuffle_merge"), both["name"] == new["_n"])
        more = [x.select(F.col("_k").alias("kind"), "name", F.lit(True).alias("word"), "pattern",
                         F.lit(False).alias("seed"), "can") for x in (fillers, others)]
        edges = _distinct(edges.unionByName(more[0]).unionByName(more[1]))
        words = hits.where("can").select("doc_id", "_key", "a", "b", "name")
        seen = words if seen is None else seen.unionByName(words)
        looked = new if looked is None else looked.unionByName(new)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and hash of the base spans, and ``all_spans``: an array
    of (kind, a, b, found: false for base)."""
    small_batches(docs.sparkSession)
    table = stored(occurrences(docs))
    more = added(docs, table)
    joined = table.join(more.hint("shuffle_merge"), table["doc_id"].eqNullSafe(more["_d"])
                        & (table["_key"] == more["_h"]), "left")
    spans = F.concat(
        F.transform(F.filter("found", lambda x: x["seed"]),
                    lambda x: F.struct(x["kind"].alias("kind"), x["a"].alias("a"),
                                       x["b"].alias("b"), F.lit(False).alias("found"))),
        F.coalesce("extra", F.array().cast("array<struct<kind:string,a:bigint,b:bigint,"
                                           "found:boolean>>")))
    rank = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*(F.lit(v) for kv in rank.items() for v in kv))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(
        order[x["kind"]].alias("r"), x["a"].alias("a"), x["b"].alias("b"),
        x["kind"].alias("kind"), x["found"].alias("found"))))
    return joined.select("doc_id", "_key", *(f"n_{k}" for k in KINDS), "base_sha256",
                         F.transform(keyed, lambda x: F.struct(
                             x["kind"].alias("kind"), x["a"].alias("a"), x["b"].alias("b"),
                             x["found"].alias("found"))).alias("all_spans"))


def added(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(_d, _h, extra): accepted near misses and words of each text."""
    good, seen = believed(docs, table)
    good = stored(good)
    misses = (table.select("doc_id", "_key", F.explode("found").alias("x")).where("not x.seed")
              .select("doc_id", "_key", "x.kind", "x.a", "x.b",
                      F.xxhash64("x.name").alias("name")))
    near = good.where("not _w")
    hit = misses.join(near.hint("shuffle_merge"), (misses["kind"] == near["_k"])
                      & (misses["name"] == near["_n"])).select(*misses.columns)
    if seen is not None:
        rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("_k"))
        best = good.where("_w").groupBy("_n").agg(
            F.max(F.struct("score", (-rank).alias("r"), "_k"))["_k"].alias("kind"))
        hit = hit.unionByName(seen.join(best.hint("shuffle_merge"), seen["name"] == best["_n"])
                              .select("doc_id", "_key", "kind", "a", "b", "name"))
    return stored(hit.groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_h"))
                  .agg(F.collect_set(F.struct("kind", "a", "b", F.lit(True).alias("found")))
                       .alias("extra")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; a
    column ``n_chars`` follows the new text."""
    small_batches(docs.sparkSession)
    more = added(docs, stored(occurrences(docs)))
    names = docs.columns
    key, d, h, extra = fresh(docs, "_key", "_d", "_h", "extra")
    keyed = docs.select(*own(docs), F.xxhash64("text").alias(key))
    more = more.select(F.col("_d").alias(d), F.col("_h").alias(h), F.col("extra").alias(extra))
    joined = keyed.join(more.hint("shuffle_merge"), F.col("doc_id").cast("long").eqNullSafe(
        F.col(d)) & (F.col(key) == F.col(h)), "left").select(*own(docs), extra)
    at = names.index("text")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, extra in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
            if text is None:
                out.append(None)
                continue
            spans = [(a, b, k) for k, found in base_spans(text)[0].items()
                     for a, b in found]
            spans += [(x["a"], x["b"], x["kind"]) for x in extra or ()]
            parts, place = [], 0
            for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
                if b <= place:
                    continue
                parts += [text[place:max(a, place)], f"<{k.upper()}>" if a >= place else ""]
                place = b
            out.append("".join(parts) + text[place:])
        cols = [pa.array(out, pa.string()) if i == at else batch.column(i)
                for i in range(len(names))]
        return pa.RecordBatch.from_arrays(cols, names=plain)
    # columns travel under plain names: an own name may hold any character
    plain = [f"c{i}" for i in range(len(names))]
    kinds = [f.dataType for f in docs.schema.fields]
    schema = StructType([StructField(c, StringType() if i == at else kinds[i])
                         for i, c in enumerate(plain)])
    clean = arrow_map(joined.toDF(*plain, "extra"), rows, schema).toDF(*names)
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.length("text").cast(kinds[names.index("n_chars")]))
    return clean


def op1_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(read(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("all_spans", lambda x: F.concat_ws(":", x["kind"], x["a"],
                                                                       x["b"])), ",")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", text.alias("spans"),
                      F.size(F.filter("all_spans", lambda x: x["found"])).cast("long")
                      .alias("n_found"))

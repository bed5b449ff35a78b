import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cardlens.llm.periodic import WaveletTree, find_runs, op11_periodic_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All runs (start, length, period) by the definition."""
    w, out = list(w), []
    n = len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            a, e = i, j + q
            if e - a >= max(12, 2 * q) and not any(w[a:e - p] == w[a + p:e] for p in range(1, q)):
                out.append((a, e - a, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(docs):
    """find_runs over many documents at once, by document."""
    ids = {}
    flat = np.array([ids.setdefault(x, len(ids) * 7919 % 1009 + len(ids) * 2000)
                     for d in docs for x in d], np.int64)
    first = np.cumsum([0, *map(len, docs)])
    start, length, q = find_runs(flat, first)
    doc = np.searchsorted(first, start, "right") - 1
    out = [[] for _ in docs]
    for d, s, n, p in zip(doc.tolist(), start.tolist(), length.tolist(), q.tolist()):
        out[d].append((s - int(first[d]), n, p))
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def shapes():
    rng = np.random.default_rng(5)
    out = ["", "a", "a" * 11, "a" * 12, "a" * 300, "ab" * 6, "ab" * 5 + "a", "abc" * 40,
           "abcdef" * 2, "abcdef" * 2 + "a", "abcdefg" * 2, "abcdef" + "abcdeg", fibonacci(400),
           "aabaabaab" * 9, ("a" * 9 + "b") * 12, ("a" * 30 + "b" + "a" * 17 + "c") * 4,
           "ababaababaababa", "x" * 15 + "y" * 15 + "x" * 15, "ab" * 20 + "ac" * 20 + "ab" * 20,
           "".join(chr(200 + i) for i in range(200)) * 2, "ab" * 17 + "a" + "ab" * 17]
    for k in (1, 2, 3, 5, 20):
        for _ in range(30):
            out.append("".join(chr(97 + x) for x in rng.integers(0, k + 1, rng.integers(1, 160))))
    for _ in range(150):  # repeats with errors
        p = "".join(chr(97 + x) for x in rng.integers(0, 4, rng.integers(1, 40)))
        s = list(p * int(rng.integers(2, 9)))
        for _ in range(int(rng.integers(0, 3))):
            s[int(rng.integers(0, len(s)))] = "z"
        out.append("q" * int(rng.integers(0, 3)) + "".join(s))
    return out


def test_runs_equal_brute_force():
    docs = shapes()
    assert found(docs) == [brute(d) for d in docs]


@pytest.mark.parametrize("k", [2, 3, 4])
def test_runs_of_long_random_texts(k):
    rng = np.random.default_rng(k)
    docs = [rng.integers(0, k, 700).tolist() for _ in range(3)]
    docs.append(sum((rng.integers(0, 2, int(rng.integers(1, 60))).tolist() * int(rng.integers(1, 5))
                     for _ in range(20)), []))
    assert found(docs) == [brute(d) for d in docs]


def test_one_word_repeated_is_one_run():
    start, length, q = find_runs(np.zeros(200_000, np.int64), np.array([0, 200_000]))
    assert (start.tolist(), length.tolist(), q.tolist()) == ([0], [200_000], [1])


def test_range_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 100):
        v = rng.permutation(n)
        tree = WaveletTree(v)
        lo, hi = rng.integers(0, n + 1, (2, 300))
        lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
        least = rng.integers(0, n + 2, 300)
        want = [min((x for x in v[a:b] if x >= t), default=-1) for a, b, t in zip(lo, hi, least)]
        assert tree.successor(lo, hi, least).tolist() == want


def planted(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def digest(doc_id, text):
    w = planted(doc_id, text)
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)),
            1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark, edge, tmp_path):
    rng = np.random.default_rng(9)
    short = [(r["doc_id"], r["text"]) for r in edge.collect() if len(r["text"] or "") < 1000]
    more = [(int(i), " ".join(rng.choice(["a", "b", "c d", "é", "\t\n"], int(rng.integers(0, 120)))))
            for i in range(100, 220)]
    rows = short + more
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int") \
        .repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()))
    assert got == Counter(digest(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_very_long_text_and_real_output(spark):
    text = "head " + "x y z " * 60_000 + "tail"
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 180_000, 3)]
    assert row["collapsed"] == b"head x y z tail" and row["n_words"] == 180_002


def test_empty(nothing):
    assert periodic_runs(nothing).collect() == []

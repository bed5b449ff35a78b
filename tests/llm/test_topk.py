import math

import numpy as np
from pyspark.sql import functions as F

from cardlens.llm import topk
from cardlens.llm.topk import search


def brute(rows, k, scale=1024):
    points = []
    for i, v in rows:
        if i is not None and v is not None and all(
                x is not None and math.isfinite(x) for x in v):
            points.append((i, [max(-2 ** 53, min(2 ** 53, math.floor(x * scale))) for x in v]))
    out = []
    for i, q in points:
        if i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in points
                           if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, max(-2 ** 63, min(2 ** 63 - 1, -s))) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, entry long, v string")
    return sorted(tuple(r) for r in search(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0,
                                           k).select("query_id", "rank", "vec_id", "score")
                  .collect())


def table(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, dim)], 1, "x") for i in range(n)]


def plain(rows):
    return [(r[0], r[1]) for r in rows]


def test_equals_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ENTRY_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rows = table(700, 8)
    assert run(spark, rows) == brute(plain(rows), 10)


def test_ties_repeats_and_bad_vectors(spark):
    rows = table(40, 3)
    same = rows[5][1]
    rows += [(i, same, 1, "x") for i in range(200, 260)] + [(300, same, 1, "x")]
    rows += [(400, None, 1, "x"), (500, [1.0, None, 2.0], 1, "x"), (501, [math.nan, 1.0, 1.0], 1, "x"),
             (502, [math.inf, 0.0, 0.0], 1, "x"), (None, same, 1, "x"), (600, [0.0, 0.0, 0.0], 1, "x"),
             (700, [0.5, 0.5], 1, "x"), (701, [0.25, 0.5], 1, "x"), (7, rows[9][1], 1, "x")]
    assert run(spark, rows) == brute(plain(rows), 10)


def test_fewer_candidates_than_k(spark):
    rows = table(4, 5)
    assert run(spark, rows) == brute(plain(rows), 10)


def test_empty(spark):
    assert run(spark, []) == []


def test_large_components(spark):
    """Products beyond a long, and bounds beyond exact doubles."""
    rng = np.random.default_rng(6)
    for size in (1e6, 3e7, 1e12, 1e13, 1e30):
        rows = [(i, [float(np.float32(x)) for x in rng.normal(0, size, 8)], 1, "x") for i in range(250)]
        rows += [(i, [float(np.float32(size * (1 + 1e-6 * j))) for j in range(8)], 1, "x")
                 for i in range(300, 330)]
        assert run(spark, rows) == brute(plain(rows), 10)

import random

import corpus_pipeline as cp
from cardlens.llm.minhash import bands, near_duplicates, slack


def sets(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def alike(x, y):
    x, y = sets(x), sets(y)
    return len(x & y) / len(x | y)


def stays(rows, threshold):
    """Ids without a smaller one in their group (no chains in these rows)."""
    return [j for j, y in rows
            if not any(alike(x, y) >= threshold for _, x in rows[:j])]


def between():
    """Pairs whose similarity is 0.80 to below 0.85 (and some outside)."""
    rng = random.Random(3)
    rows = []
    for n in [49, 50, 53, 57, 61, 65, 94, 101, 110, 119, 127, 40, 44, 70, 90] * 4:
        words = [f"p{rng.randint(0, 10**6)}" for _ in range(n)]
        other = list(words)
        other[n // 3] = f"q{rng.randint(0, 10**6)}"
        if n > 90:
            other[2 * n // 3] = f"q{rng.randint(0, 10**6)}"
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    return rows


def test_stage_equals_brute_force_between_the_thresholds(spark):
    rows = between()
    likeness = [alike(x, y) for (_, x), (_, y) in zip(rows[::2], rows[1::2])]
    assert sum(0.8 <= v < 0.85 for v in likeness) >= 40 and min(likeness) < 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = stays(rows, 0.8)
    assert len(want) < len(stays(rows, 0.85))
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, df, "").collect()) == want
    assert sorted(r["doc_id"] for r in near_duplicates(df).where("kept").collect()) == (
        stays(rows, 0.85))


def test_bands_follow_the_threshold():
    assert bands(85) == (19, 5) and bands(80) == (24, 4)
    assert abs(slack(0.85) - 0.2) < 0.002 and slack(0.8) > slack(0.85)

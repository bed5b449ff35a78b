import math
import zlib
from collections import Counter

import numpy as np

from cardlens.llm import brown
from cardlens.llm.brown import exchange, likelihood, score


def words(text):
    return [*(text or "").encode().lower().split(), None]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check_base(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    counts = Counter(w for i, t in rows if not fold(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6),
                   fold(i)) for i, t in rows)
    out = score(df).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"],
                  r["train_tokens"], round(r["base_score"], 6), r["held_out"]) for r in out)
    assert got == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in out)
    return out


def test_edges(edge, nothing):
    check_base(edge)
    assert score(nothing).collect() == []


def test_rare_words_are_joined(edge, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 8)
    check_base(edge)


def test_no_training_texts(spark):
    ids = [i for i in range(200) if fold(i)][:3]
    check_base(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string"))


def test_classes_beat_unigrams_on_held_out_text(spark):
    rng = np.random.default_rng(0)
    left, right = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(f"{rng.choice(left)} {rng.choice(right)}" for _ in range(40)))
            for i in range(400)]
    out = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 20
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_model_is_a_distribution(spark):
    # all texts of one word over the vocabulary plus the unseen share sum to one
    rows = [(i, "x y" if i % 2 else "y") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r["doc_id"]: 10 ** r["score"] for r in score(df).collect()}
    assert 0 < first[0] + first[1] < 1


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    k = brown.CLASSES + 1
    context = rng.integers(0, 50, (2, 90, k)).astype(float)
    context[1, :45, :8] += 400
    classes = np.arange(90) % brown.CLASSES
    m = brown.transitions(context, classes, 10)
    assert (exchange(context, classes, m) != classes).any()
    assert np.isfinite(likelihood(m))

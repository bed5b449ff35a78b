import math

import numpy as np

from cardlens.llm import brown
from cardlens.llm.brown import score


def rows(seed=4):
    """Two kinds of words that take turns; all end alike, few are frequent."""
    rng = np.random.default_rng(seed)
    share = np.r_[np.full(4, 0.15), np.full(80, 0.005)]
    return [(i, " ".join(f"a{rng.choice(84, p=share)}xyz b{rng.choice(84, p=share)}xyz"
                         for _ in range(30))) for i in range(600)]


def gain(spark):
    """Held-out gain over unigrams, log10 a token."""
    out = score(spark.createDataFrame(rows(), "doc_id long, text string")).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 40
    return (sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held))


def test_words_that_are_no_units_have_a_class_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(brown, "CLUSTERED", 64)  # the eight frequent words
    whole = gain(spark)
    assert whole > 0.9 * math.log10(2)
    monkeypatch.setattr(brown, "HEAD", 16)  # the others' classes are joined
    assert abs(gain(spark) - whole) < 1e-9
    monkeypatch.setattr(brown, "OWN", 1 << 40)  # ending buckets alone
    assert gain(spark) < 0.8 * whole

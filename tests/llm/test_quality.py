import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from cardlens.llm import quality
from cardlens.llm.common import Words
from cardlens.llm.quality import features, gumbel, keep_good, kth_largest, label_sample, resample


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    good, junk = [f"g{i}" for i in range(150)], [f"j{i}" for i in range(20)]
    rows, labels = [], []
    for i in range(n):
        kind = "bad" if i % 4 == 0 else "toxic" if i % 10 == 1 else "good"
        words = [rng.choice(junk if kind == "bad" else good) for _ in range(rng.randint(20, 120))]
        if kind == "toxic":
            for _ in range(6):
                words.insert(rng.randrange(len(words)), "insult")
        rows.append((i, " ".join(words), kind))
        if i % 2:
            labels.append((i, int(kind != "bad"), int(kind == "toxic")))
    return rows, labels


def test_rejects_bad_and_toxic_keeps_good(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    labs = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = keep_good(docs, labs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    rate = lambda kind: np.mean([i in ids for i, _, k in rows if k == kind])
    assert rate("good") > 0.95 and rate("bad") < 0.05 and rate("toxic") < 0.1
    drawn = resample(docs, labs, 0.6).where("kept").collect()
    assert len(drawn) == 240 and not any(rows[r["doc_id"]][2] == "bad" for r in drawn)


def brute(rows, good, share):
    """{row number: (log weight, kept)} with dictionaries over single texts."""
    raw, target, own = defaultdict(int), defaultdict(int), []
    for i, text in rows:
        words = Words(pa.array([(text or "").encode()]), lower=True)
        own.append(Counter(features(words)[1].tolist()))
        for b, c in own[-1].items():
            raw[b] += c
            target[b] += c * (i in good)
    total = {kind: [sum(c for b, c in t.items() if (b >= 1 << quality.WORD_BITS) == kind)
                    for t in (raw, target)] for kind in (False, True)}
    ratio = {}
    for b, c in raw.items():
        all_raw, all_target = total[b >= 1 << quality.WORD_BITS]
        expected = c * all_target / max(1, all_raw)
        sure = abs(target[b] - expected) >= quality.SURE * math.sqrt(expected + 1)
        ratio[b] = math.log((target[b] + 0.1) / (expected + 0.1)) if sure else 0.0
    weight = [sum(ratio[b] * c for b, c in o.items()) for o in own]
    noise = gumbel(np.array([i or 0 for i, _ in rows], np.int64))
    key = [w + g for w, g in zip(weight, noise.tolist())]
    cut = sorted(key, reverse=True)[math.ceil(share * len(rows)) - 1]
    return [(i, round(w, 6), k >= cut) for (i, _), w, k in zip(rows, weight, key)]


def test_weights_keys_and_selection_equal_brute_force(spark, edge):
    rows, labels = corpus(300)
    more = [(r["doc_id"], r["text"]) for r in edge.collect() if r["doc_id"] not in (2, None)]
    rows = [(i + 1000, t) for i, t, _ in rows] + more
    labels = [(i + 1000, q, t) for i, q, t in labels] + [(1, 1, 0), (9, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labs = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, back = label_sample(labs)
    assert len(back) and {*good.tolist(), *back.tolist()} == {
        i for i, q, t in labels if q == 1 and t == 0}
    for share in (0.15, 0.8):
        got = resample(docs, labs, share).collect()
        assert sorted((r["doc_id"], round(r["log_weight"], 6), r["kept"]) for r in got) == \
            sorted(brute(rows, set(good.tolist()), share))


def test_sample_is_nearer_the_target_than_raw_and_than_a_cut(spark):
    """One word a text, so the weight is the exact ratio: the sample must have
    the target's word distribution, while a cut by weight has the top words."""
    rng = np.random.default_rng(2)
    share = 1 / np.arange(1, 31) ** 0.7
    target = rng.choice(30, 4000, p=share / share.sum())
    raw = rng.integers(0, 30, 16_000)
    rows = [(i, f"w{x}") for i, x in enumerate([*target.tolist(), *raw.tolist()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labs = spark.createDataFrame([(i, 1, 0) for i in range(4000)],
                                 "doc_id long, quality int, toxic int")
    table = resample(docs, labs, 0.1).toPandas().sort_values("doc_id")

    def spread(words):
        return (np.bincount(words, minlength=30) + 0.5) / (len(words) + 15)

    def divergence(words):
        p, q = spread(target), spread(words)
        return float((p * np.log(p / q)).sum())
    word = np.array([int(t[1:]) for _, t in rows])
    sample = word[table["kept"].to_numpy()]
    cut = word[np.argsort(-table["log_weight"].to_numpy(), kind="stable")[:len(sample)]]
    assert len(sample) == 2000
    assert divergence(sample) < 0.5 * divergence(word) and divergence(sample) < 0.1 * divergence(cut)
    assert len(set(cut.tolist())) < 5 and len(set(sample.tolist())) == 30


def test_edges(spark, edge, nothing):
    labs = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 2, 3, 9, 10, 12)] + [(None, 1, 0)],
                                 "doc_id long, quality int, toxic int")
    table = resample(edge, labs)
    assert table.count() == edge.count()
    assert {r["log_weight"] for r in table.where("doc_id in (4, 5, 6)").collect()} == {0.0}
    assert keep_good(edge, labs.limit(0)).count() == edge.count()  # nothing to learn: all stay
    by_noise = resample(edge, labs.limit(0), 0.5)
    assert {r["log_weight"] for r in by_noise.collect()} == {0.0}
    assert by_noise.where("kept").count() >= edge.count() / 2
    assert keep_good(nothing, labs).collect() == [] and resample(nothing, labs).collect() == []


def test_columns_with_odd_names_pass(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in rows],
                                 ["doc_id", "text", "a`b", "x.y, z"])
    labs = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert keep_good(docs, labs).columns == docs.columns


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = np.r_[rng.normal(0, 1, 800), np.full(300, 0.25), [1e9, -1e9]]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in (1, 2, 300, 500, len(values)):
        assert kth_largest(df, "x", k) == np.sort(values)[-k]

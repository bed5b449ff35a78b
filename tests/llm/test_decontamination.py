import random

import numpy as np
import pyarrow as pa

from cardlens.llm import decontamination as dc
from cardlens.llm.decontamination import Items, contaminated, drop_contaminated, matches


def distance(item, text):
    """Least word edit distance of the item to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def words(t):
    return (t or "").encode().lower().split()


def brute(docs, items):
    out = set()
    for i, t in docs:
        for j, s in items:
            w = words(s)
            if w and distance(w, words(t)) <= dc.allowed(len(w)):
                out.add((i, j))
    return out


def fixture(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 15, 38, 59]))))
             for j in range(25)]
    docs = []
    for i in range(120):
        text = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, max(1, len(part) // 4))):
                k = rng.randrange(len(part))
                change = rng.random()
                if change < 0.4:
                    part[k] = "changed"
                elif change < 0.7 and len(part) > 1:
                    del part[k]
                else:
                    part.insert(k, "extra")
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() if i % 2 else x for x in part]
        docs.append((i, " ".join(text)))
    return docs, items


def test_recall_against_brute_force_and_no_false_hits(spark):
    docs, items = fixture()
    out = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string")).collect()
    got, want = {(r["doc_id"], r["item_id"]) for r in out}, brute(docs, items)
    assert got <= want
    assert len(want) > 25 and len(got) >= 0.97 * len(want)
    by_doc, by_item = dict(docs), dict(items)
    for r in out:
        run = words(by_doc[r["doc_id"]])[r["first_word"]:r["end_word"]]
        item = words(by_item[r["item_id"]])
        assert distance(item, run) == r["distance"]


def test_edges_and_dropping(spark, edge, nothing):
    items = spark.createDataFrame(
        [(1, "the small cat sleeps near the warm stove and nobody"), (2, None), (3, ""),
         (None, "One"), (4, "zzz yyy"), (1, "the small cat sleeps near the warm stove and nobody")],
        "item_id long, text string")
    out = contaminated(edge, items).collect()
    hits = {(r["doc_id"], r["item_id"]) for r in out}
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (12, 1), (7, None), (8, None)} <= hits
    kept = drop_contaminated(edge, items)
    assert kept.columns == edge.columns
    gone = {d for d, _ in hits}
    assert {r["doc_id"] for r in kept.collect()} == {
        r["doc_id"] for r in edge.collect() if r["doc_id"] not in gone or r["text"] is None}
    assert contaminated(nothing, items).collect() == []
    assert contaminated(edge, items.limit(0)).collect() == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    docs, items = fixture(3)
    out = contaminated(spark.createDataFrame(docs[:40], "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} <= brute(docs[:40], items)
    assert len(out) > 3


def test_embedding_keeps_close_strings_close():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 60, 40, dtype=np.uint64)
    near = base.copy()
    near[20] = 5
    other = rng.integers(1, 1 << 60, 40, dtype=np.uint64)
    share = np.linspace(0, 0.99, 60)
    agree = {"near": 0, "other": 0}
    for seed in range(20):
        x = dc.sampled_symbols(np.stack([base, near, other]), np.array([40, 40, 40]),
                               share[None, :], [seed])
        agree["near"] += (x[0] == x[1]).mean()
        agree["other"] += (x[0] == x[2]).mean()
    assert agree["near"] > 12 and agree["other"] < 8
    assert dc.repetitions(0.99) == 17


def test_one_text_by_hand():
    items = Items([9], [b"a b c d e f g h i j"])
    assert matches(items, pa.array([b"x a b c d e f g h i j y", b"", b"a b c"], pa.binary())) == [
        (0, 0, 1, 11, 0)]

import hashlib
import random

from cardlens.llm.substring import remove_repeats, repeat_levels


def brute(rows, n):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for p in range(len(w) - n + 1):
                k = tuple(w[p:p + n])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if i is not None and first[tuple(w[p:p + n])] < i:
                gone[p:p + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i if i is not None else -1, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"],
                   hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


def shared_rows(seed=3):
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(40)]
    passage = [[rng.choice(word) for _ in range(rng.randint(10, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passage) if rng.random() < 0.5 else [
                rng.choice(word) for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(text)))
    return rows


def test_edges_equal_brute_force(edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert got(remove_repeats(edge)) == brute(rows, 13)


def test_shared_passages_and_both_ways_back(spark):
    rows = shared_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 13)
    assert got(remove_repeats(df)) == want
    assert got(remove_repeats(df, most=0)) == want


def test_other_length(spark):
    rows = shared_rows(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(df, n=6)) == brute(rows, 6)


def test_levels_double_until_none_survives(spark):
    text = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "x y " + text), (3, "only this")],
                               "doc_id long, text string")
    levels = {r["words"]: r["n"] for r in repeat_levels(df).groupBy("words").count()
              .withColumnRenamed("count", "n").collect()}
    assert levels == {13: 48, 26: 35, 52: 9}


def test_empty(nothing):
    assert remove_repeats(nothing).collect() == []
    assert repeat_levels(nothing).collect() == []

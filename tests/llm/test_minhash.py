import random
from itertools import combinations

from cardlens.llm.minhash import keep_one, near_duplicates


def sets(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    named = [(i, sets(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        (i, x), (j, y) = named[a], named[b]
        if i is not None and j is not None and x and y and (
                100 * len(x & y) >= 85 * len(x | y)):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((-1 if i is None else i, len(named[k][1]),
                   -1 if i is None else least[root(k)],
                   i is None or least[root(k)] == i) for k, (i, _) in enumerate(rows))


def got(df):
    none = lambda x: -1 if x is None else x
    return sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"]), r["kept"])
                  for r in df.collect())


def chains(seed=1):
    """Groups whose members drift apart: links hold between neighbours, not
    between the ends, and not to the smallest."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        words = [f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 200))]
        for _ in range(8):
            rows.append((len(rows) * 7 % 997, " ".join(words)))
            for _ in range(max(1, len(words) // 90)):
                words[rng.randrange(len(words))] = f"u{rng.randint(0, 10**6)}"
    return rows


def test_edges_equal_brute_force(edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert got(near_duplicates(edge)) == brute(rows)


def test_chains_equal_brute_force(spark):
    rows = chains()
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) \
        == brute(rows)


def test_one_of_each_group_stays(edge):
    kept = keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {x[2] for x in brute([(r["doc_id"], r["text"]) for r in edge.collect()]) if x[0] >= 0}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2


def test_empty(nothing):
    assert near_duplicates(nothing).collect() == []
    assert keep_one(nothing).collect() == []

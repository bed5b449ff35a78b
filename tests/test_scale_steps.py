"""Steps that every row of the large tables takes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cardlens.operators import features
from cardlens.sources.transactions import TXN_SCHEMA


def test_only_own_rows_hold_the_transaction(spark, monkeypatch):
    held, by_value = [], features._by_value

    def watched(rows):
        held.extend(rows.select("transaction_id" if "_row" not in rows.columns else "_row.transaction_id",
                                "ctx").collect())
        return by_value(rows)
    monkeypatch.setattr(features, "_by_value", watched)
    late = 13 * 86_400_000_000
    rows = [(f"t{i}", i, late + i, "c", "u", "m", "x", "US", 5.0, "USD", "pos", "chip", "d", "US", "18-25", 0)
            for i in range(3)]
    out = features.card_features(spark.createDataFrame(rows, TXN_SCHEMA))
    assert sorted(r["transaction_id"] for r in held if not r["ctx"]) == ["t0", "t1", "t2"]
    context = [r for r in held if r["ctx"]]
    assert context and all(r["transaction_id"] is None for r in context)
    assert [r["card_txn_count_1h"] for r in out.orderBy("seq").collect()] == [0.0, 1.0, 2.0]


def test_search_sends_texts_instead_of_vectors(spark):
    """A vector is several times as long as its text."""
    import contextlib
    import io

    from cardlens.operators import similarity as sim
    docs = spark.createDataFrame([("d1", "same text"), ("d2", "\U0001F600 other"), ("d3", None)],
                                 "case_id string, text string")
    queries = spark.createDataFrame([("q", "Same  text")], "query_id string, query_text string")
    hits = sim.top_k_similar(spark, queries, docs, 3)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        hits.explain()
    assert "slots" not in plan.getvalue()
    got = hits.orderBy("rank").collect()
    assert [r["case_id"] for r in got][0] == "d1" and got[0]["score"] == 1.0 and len(got) == 3


def test_weights_are_rounded_as_by_sql(spark):
    from pyspark.sql import functions as F

    from cardlens.operators.similarity import embed, rounded
    x = [0.0, 1.0, -1.0, 1 / 128, -1 / 128, 3 / 128, 0.0000005, 0.1234565, -0.1234565, 2 / 7, 5 / 12.5 ** 0.5 / 9]
    want = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double") \
        .select("i", F.round("x", 6).alias("x")).orderBy("i").collect()
    assert rounded(np.array(x), 6).tolist() == [r["x"] for r in want]
    docs = spark.createDataFrame([("a", "some words of a text"), ("b", ""), ("c", "x" * 20)],
                                 "case_id string, text string")
    got = embed(docs, "case_id", "text", weight_digits=6)
    for r in got.withColumn("own", F.expr("transform(counts, c -> round(c / norm, 6))")).collect():
        assert r["weights"] == r["own"]


def _walked(nodes, psi, x):
    """Path lengths row by row."""
    from cardlens.models.iforest import c_factor
    trees = {t: g.set_index("node") for t, g in nodes.groupby("tree")}
    out = []
    for row in x:
        total = 0.0
        for g in trees.values():
            at = g.loc[0]
            while at["feature"] >= 0:
                left = row[int(at["feature"])] < at["threshold"]
                at = g.loc[int(at["left"] if left else at["right"])]
            total += at["depth"] + c_factor(float(at["size"]))
        out.append(2.0 ** (-total / len(trees) / c_factor(psi)))
    return np.array(out)


def test_forest_walk_equals_row_by_row(monkeypatch):
    import pandas as pd

    from cardlens.models import iforest
    monkeypatch.setattr(iforest, "SCORE_ROWS", 7, raising=False)
    rng = np.random.default_rng(3)
    cols = ["a", "b", "c"]
    grow = iforest._grower(cols, 6, 1)
    nodes = pd.concat([grow(pd.DataFrame(rng.normal(0, 1, (64, 3)), columns=cols).assign(tree=t))
                       for t in range(4)])
    model = iforest.IsolationForestModel(nodes, 64, cols)
    x = rng.normal(0, 2, (30, 3))
    x[3, 1], x[4], x[5, 0] = np.nan, np.nan, np.inf
    assert np.allclose(model.raw_scores(x), _walked(nodes, 64, x), rtol=1e-12)
    assert model.steps.max() <= 6      # leaves lead to themselves: no step beyond the depth
    assert len(model.raw_scores(np.zeros((0, 3)))) == 0


def test_models_score_arrow_batches():
    """Columns that the model does not read pass as they are; NaN becomes null."""
    from cardlens.models.batches import matrix, with_values
    b = pa.RecordBatch.from_arrays([pa.array(["x", None]), pa.array([1, None]), pa.array([float("nan"), 2.0]),
                                    pa.array([[1.0], []])], names=["t", "n", "d", "wv"])
    assert np.array_equal(matrix(b, ["d", "n"]), [[np.nan, 1.0], [2.0, np.nan]], equal_nan=True)
    out = with_values(b, "s", np.array([0.5, np.nan]), drop=("wv",))
    assert out.to_pydict() == {"t": ["x", None], "n": [1, None], "d": [None, 2.0], "s": [0.5, None]}


def test_sequence_windows_are_padded_by_the_model():
    from cardlens.constants import FEATURE_NAMES
    from cardlens.models.sequence import D, HIST, TARGET_IDX, _design
    rng = np.random.default_rng(4)
    past = [rng.normal(0, 1, (k, D)) for k in (0, 7, 2)]
    past[2][0, 3] = np.nan
    now = rng.normal(0, 1, (3, D))
    wv = pa.array([[v.tolist() for v in p] for p in past], pa.list_(pa.list_(pa.float64())))
    b = pa.RecordBatch.from_arrays([wv, *map(pa.array, now.T)], names=["wv", *FEATURE_NAMES])
    mean, std = rng.normal(0, 1, D), rng.uniform(1, 2, D)
    for part in (b, b.slice(1)):
        x, y = _design(part, mean, std)
        for i, (p, c) in enumerate(list(zip(past, now))[3 - part.num_rows:]):
            want = np.zeros((HIST, D))
            if len(p):
                want[HIST - len(p):] = np.nan_to_num((p - mean) / std)
            assert np.allclose(x[i, :-1], want.ravel()) and x[i, -1] == 1.0
            assert np.allclose(y[i], ((c - mean) / std)[TARGET_IDX])


def test_whole_numbers_need_no_decimal_rounding(spark):
    from pyspark.sql import functions as F

    from cardlens.operators.drift import value_of
    x = [0.0, -0.0, 3.0, -2.0, 0.1234567891, -7.00000000049, 1e20, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, f double")
    made = value_of("f")
    rows = df.select(made.alias("a"), F.round("f", 9).alias("b")).orderBy("i").collect()
    assert [repr(r["a"]) for r in rows] == [repr(r["b"]) for r in rows]
    assert "FLOOR" in str(made).upper()

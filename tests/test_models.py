from __future__ import annotations

import numpy as np

from cardlens.models.iforest import fit_iforest, score_iforest


def test_isolation_forest_ranks_outlier_high(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(0, 1, (2000, 8))
    x[0] = 25.0
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    cols = [f"f{j}" for j in range(8)]
    df = spark.createDataFrame(rows, "seq long, " + ", ".join(f"{c} double" for c in cols))
    model = fit_iforest(df, cols, n_trees=50, max_samples=256)
    s = {r["seq"]: r["iforest_raw"] for r in score_iforest(df, model).collect()}
    vals = np.array(list(s.values()))
    assert s[0] == vals.max()
    assert 0.0 < vals.min() and vals.max() <= 1.0


def test_tree_attributions_are_additive(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from cardlens.constants import FEATURE_NAMES
    from cardlens.models.attribution import tree_table, with_contributions

    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, len(FEATURE_NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(0, 0.5, 600) > 0.8).astype(int)
    df = spark.createDataFrame([(int(v), *map(float, r)) for v, r in zip(y, x)],
                               "is_fraud int, " + ", ".join(f"{n} double" for n in FEATURE_NAMES))
    vec = VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="fvec").transform(df)
    model = GBTClassifier(featuresCol="fvec", labelCol="is_fraud", maxIter=5, maxDepth=3).fit(vec)
    p = model.transform(vec).withColumn("p", vector_to_array("probability")[1]).drop(
        "fvec", "rawPrediction", "probability", "prediction")
    c = with_contributions(p, tree_table(spark, model))
    rows = c.select("p", F.aggregate(F.map_values("contrib"), F.lit(0.0), lambda a, v: a + v)
                    .alias("s"), "contrib_bias").collect()
    for r in rows:
        logit = np.log(r["p"] / (1 - r["p"]))
        assert abs(r["s"] + r["contrib_bias"] - logit) < 1e-9


def _labelled(spark, n, seed, noise):
    from pyspark.sql import functions as F  # noqa: F401

    from cardlens.constants import FEATURE_NAMES
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, len(FEATURE_NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(0, noise, n) > 1.0).astype(int)
    split = np.where(np.arange(n) % 2 == 0, "train", "valid")
    return spark.createDataFrame(
        [(i, int(v), str(s), *map(float, r)) for i, (v, s, r) in enumerate(zip(y, split, x))],
        "seq long, is_fraud int, split string, " + ", ".join(f"{c} double" for c in FEATURE_NAMES)), x, y


def _fit(df, iters, depth):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from cardlens.constants import FEATURE_NAMES
    vec = VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="fvec").transform(df)
    return GBTClassifier(featuresCol="fvec", labelCol="is_fraud", maxIter=iters, maxDepth=depth,
                         stepSize=0.5, seed=3).fit(vec.where("split = 'train'")), vec


def _average_precision(y, s):
    """A6 by the definition, ties together."""
    total, out, seen, hits = y.sum(), 0.0, 0, 0
    for v in np.unique(s)[::-1]:
        at = s == v
        seen, hits = seen + at.sum(), hits + y[at].sum()
        out += y[at].sum() / total * hits / seen
    return out


def test_best_prefix_of_trees(spark):
    """Precision of every prefix equals the definition; on a noisy label the
    best prefix is not the last, and a later one is worse."""
    from pyspark.ml.functions import vector_to_array

    from cardlens.constants import FEATURE_NAMES
    from cardlens.models.attribution import tree_table
    from cardlens.models.staged import best_prefix, prefix_precision, with_probability
    df, x, y = _labelled(spark, 800, 7, 3.0)
    model, vec = _fit(df, 14, 5)
    table = tree_table(spark, model)
    valid = np.arange(800) % 2 == 1
    got = prefix_precision(df.where("split = 'valid'"), table, ranges=8)
    margins = table.margins(x[valid])
    want = [_average_precision(y[valid], margins[:, t]) for t in range(14)]
    assert np.allclose(got, want)
    best = best_prefix(got)
    assert best < 14 and got[-1] < got[best - 1]
    # all trees: the probability and the importance that Spark's own model gives
    p = {r["seq"]: r["p"] for r in with_probability(df, table, "p").select("seq", "p").collect()}
    own = {r["seq"]: r["p"] for r in model.transform(vec).select(
        "seq", vector_to_array("probability")[1].alias("p")).collect()}
    assert all(abs(p[i] - own[i]) < 1e-12 for i in own)
    assert np.allclose(table.importance(len(FEATURE_NAMES)), model.featureImportances.toArray())
    cut = with_probability(df, table.cut(best), "p").select("seq", "p").toPandas().set_index("seq")["p"]
    assert np.allclose(cut.loc[np.flatnonzero(valid)], 1 / (1 + np.exp(-2 * margins[:, best - 1])))


def _pool_plainly(s, y):
    """Pool adjacent violators, one row after the other, over distinct scores."""
    blocks = []
    for v in np.unique(s):
        at = s == v
        blocks.append([v, v, float(y[at].sum()), int(at.sum())])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return blocks


def test_isotonic_equals_plain_pooling_and_improves_calibration(spark):
    from pyspark.sql import functions as F

    from cardlens.models.isotonic import fit_isotonic
    rng = np.random.default_rng(2)
    for n, digits, ranges in ((1, 3, 4), (300, 1, 4), (2000, 3, 64), (2000, 9, 16)):
        s = np.round(rng.random(n) ** 2, digits)
        y = (rng.random(n) < s ** 0.5 * 0.6 + 0.1 * np.sin(20 * s)).astype(float)
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y)], "s double, y double")
        iso = fit_isotonic(df.repartition(3), "s", "y", ranges)
        blocks = _pool_plainly(s, y)
        x = [v for b in blocks for v in ((b[0], b[1]) if b[0] < b[1] else (b[0],))]
        assert iso.x.tolist() == x and (np.diff(iso.y) >= 0).all()
        asked = np.r_[-1.0, 0.0, 0.123, 0.5, 0.77, 1.0, 2.0]
        got = [r[0] for r in spark.createDataFrame([(float(a),) for a in asked], "s double")
               .select(iso.apply(F.col("s"))).collect()]
        values = [b[2] / b[3] for b in blocks for _ in range(2 if b[0] < b[1] else 1)]
        assert np.allclose(got, np.interp(asked, x, values))
    brier = lambda p: float(((p - y) ** 2).mean())
    assert brier(np.interp(s, iso.x, iso.y)) < brier(s)
    nothing = fit_isotonic(df.limit(0), "s", "y")
    assert [r[0] for r in df.limit(3).select(nothing.apply(F.col("s")) - F.col("s")).collect()] == [0, 0, 0]

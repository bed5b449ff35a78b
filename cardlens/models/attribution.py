"""Per-row additive contributions of the boosted-tree model (M7).

Path-based attribution: walking a row down each tree, every split moves the
expected value from the parent's prediction to the child's; that change is
credited to the split feature.  Summed over trees (times their weights) and
converted to log-odds (Spark's logistic GBT uses ``p = 1 / (1 + exp(-2 m))``)
the contributions plus the bias add up exactly to the row's log-odds.

The node table comes from the saved model's parquet data (split feature,
threshold, children and node predictions).  Its size is fixed by the number
and depth of trees; it is broadcast to ``mapInPandas``, which only runs on the
rows that need reasons (declines or explicit requests: the filter is applied
before this operator).
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.constants import FEATURE_NAMES
from cardlens.session import ensure_checkpoint_dir


class TreeTable:
    def __init__(self, nodes: pd.DataFrame, weights: list[float]):
        self.trees, self.gains = [], []
        for t, g in nodes.groupby("treeID"):
            g = g.sort_values("id")
            n = int(g["id"].max()) + 1
            feat = np.full(n, -1, dtype=np.int64)
            thr = np.zeros(n)
            left = np.full(n, -1, dtype=np.int64)
            right = np.full(n, -1, dtype=np.int64)
            pred = np.zeros(n)
            ids = g["id"].to_numpy()
            feat[ids] = g["feature"].to_numpy()
            thr[ids] = g["threshold"].to_numpy()
            left[ids] = g["leftChild"].to_numpy()
            right[ids] = g["rightChild"].to_numpy()
            pred[ids] = g["prediction"].to_numpy()
            inner = g[g["feature"] >= 0]
            self.gains.append((inner["feature"].to_numpy(np.int64),
                               (inner["gain"] * inner["count"]).to_numpy(np.float64)))
            self.trees.append((float(weights[int(t)]), feat, thr, left, right, pred))

    def cut(self, n_trees: int) -> TreeTable:
        """The first ``n_trees`` trees."""
        out = TreeTable.__new__(TreeTable)
        out.trees, out.gains = self.trees[:n_trees], self.gains[:n_trees]
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(n, trees): half the log-odds after each tree."""
        out = np.zeros((len(x), len(self.trees)))
        rows = np.arange(len(x))
        for t, (w, feat, thr, left, right, pred) in enumerate(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            inner = feat[node] >= 0
            while inner.any():
                at = rows[inner]
                here = node[at]
                node[at] = np.where(x[at, feat[here]] <= thr[here], left[here], right[here])
                inner = feat[node] >= 0
            out[:, t] = w * pred[node]
        return np.cumsum(out, axis=1)

    def importance(self, n_features: int) -> np.ndarray:
        """Gain by feature, weighted by the rows of the node, normalised to 1."""
        total = np.zeros(n_features)
        for feature, gain in self.gains:
            total += np.bincount(feature, gain, n_features)
        return total / total.sum() if total.sum() > 0 else total

    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, d) log-odds contributions and (n,) bias."""
        n, d = x.shape
        contrib = np.zeros((n, d))
        bias = np.zeros(n)
        rows = np.arange(n)
        for w, feat, thr, left, right, pred in self.trees:
            node = np.zeros(n, dtype=np.int64)
            bias += w * pred[0]
            while True:
                f = feat[node]
                active = f >= 0
                if not active.any():
                    break
                go_left = np.zeros(n, dtype=bool)
                go_left[active] = x[rows[active], f[active]] <= thr[node[active]]
                child = np.where(go_left, left[node], right[node])
                child = np.where(active, child, node)
                delta = w * (pred[child] - pred[node])
                np.add.at(contrib, (rows[active], f[active]), delta[active])
                node = child
        return 2.0 * contrib, 2.0 * bias


def tree_table(spark: SparkSession, model) -> TreeTable:
    """Read the node table of a fitted ``GBTClassificationModel`` from its saved form."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    nodes = data.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild",
                        "nodeData.rightChild", "nodeData.gain",
                        F.get("nodeData.impurityStats", 0).alias("count"), F.col("nodeData.split.featureIndex").alias("feature"),
                        F.coalesce(F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0),
                                   F.lit(0.0)).alias("threshold")).toPandas()
    nodes.loc[nodes["leftChild"] < 0, "feature"] = -1
    return TreeTable(nodes, list(model.treeWeights))


def with_contributions(df: DataFrame, table: TreeTable, out_col: str = "contrib") -> DataFrame:
    """Adds ``contrib`` (map feature -> log-odds contribution) and ``contrib_bias``."""
    bc = df.sparkSession.sparkContext.broadcast(table)
    names = list(FEATURE_NAMES)

    def fn(batches):
        t = bc.value
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=np.float64)
            c, b = t.contributions(x)
            yield pdf.assign(**{out_col: list(c), "contrib_bias": b})

    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.DoubleType())),
        T.StructField("contrib_bias", T.DoubleType())])
    # Python hands over plain arrays; Spark makes the map
    return df.mapInPandas(fn, schema).withColumn(out_col, F.map_from_arrays(
        F.array(*map(F.lit, names)), F.col(out_col)))

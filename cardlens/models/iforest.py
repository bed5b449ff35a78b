"""Distributed isolation forest (M3).

Fit, with no n x trees explosion:
1. one pass over the legitimate training rows emits, for every tree, the rows
   whose deterministic hash ``u(seq, tree) < psi / n`` (about ``psi`` rows per
   tree, independent of n and of partitioning);
2. ``groupBy(tree).applyInPandas`` grows each tree on its own sample (a group
   holds ~psi rows, bounded by the hyper-parameter), returning a node table;
3. scoring is ``mapInArrow`` with the node table broadcast (its size is
   trees x 2 psi nodes, fixed by the hyper-parameters): raw = 2^(-E[h]/c(psi)).
   Leaves lead to themselves, so all rows of a block take the same few steps.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.models.batches import matrix, with_values

SCORE_ROWS = 4096         # rows that walk a tree together
SAMPLE_ROWS = 1 << 16     # sampled rows of a batch
EULER = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 -> uniform [0, 1)."""
    z = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        z = (z + np.uint64(0x9E3779B97F4A7C15))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _sampler(n_trees: int, frac: float, features: list[str], seed: int):
    def some(x, picked):
        tree = np.repeat([t for t, _ in picked], [len(at) for _, at in picked]).astype(np.int32)
        part = pd.DataFrame(x[np.concatenate([at for _, at in picked])], columns=features)
        part.insert(0, "tree", tree)
        return part

    def fn(batches):
        for pdf in batches:
            ids = pdf["seq"].to_numpy(dtype=np.int64).astype(np.uint64) * np.uint64(1_000_003)
            x = pdf[features].to_numpy(dtype=np.float64)
            picked, held = [], 0
            for t in range(n_trees):
                at = np.flatnonzero(_mix(ids + np.uint64(t * 7919 + seed)) < frac)
                if len(at):
                    picked.append((t, at))
                    held += len(at)
                if held >= SAMPLE_ROWS:
                    yield some(x, picked)
                    picked, held = [], 0
            if picked:
                yield some(x, picked)
    return fn


def _grower(features: list[str], max_depth: int, seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[features].to_numpy(dtype=np.float64)
        rng = np.random.default_rng(seed * 100_003 + tree)
        rows = []
        stack = [(0, np.arange(len(x)), 0)]
        next_id = 1
        while stack:
            node, idx, depth = stack.pop()
            if depth >= max_depth or len(idx) <= 1:
                rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
                continue
            sub = x[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if len(cand) == 0:
                rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
                continue
            f = int(rng.choice(cand))
            thr = float(rng.uniform(lo[f], hi[f]))
            left_mask = sub[:, f] < thr
            left, right = next_id, next_id + 1
            next_id += 2
            rows.append((tree, node, f, thr, left, right, len(idx), depth))
            stack.append((left, idx[left_mask], depth + 1))
            stack.append((right, idx[~left_mask], depth + 1))
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])
    return grow


class IsolationForestModel:
    def __init__(self, nodes: pd.DataFrame, psi: int, features: list[str]):
        self.features = features
        self.psi = psi
        self.c_psi = c_factor(psi)
        self.n_trees = int(nodes["tree"].nunique())
        # dense per-tree arrays, padded to the largest tree
        width = int(nodes["node"].max()) + 1
        shape = (self.n_trees, width)
        self.feature = np.full(shape, -1, dtype=np.int32)
        self.threshold = np.zeros(shape)
        self.left = np.full(shape, -1, dtype=np.int32)
        self.right = np.full(shape, -1, dtype=np.int32)
        self.size = np.zeros(shape, dtype=np.int32)
        self.depth = np.zeros(shape, dtype=np.int32)
        t = nodes["tree"].rank(method="dense").astype(int).to_numpy() - 1
        nd = nodes["node"].to_numpy()
        for arr, col in ((self.feature, "feature"), (self.threshold, "threshold"),
                         (self.left, "left"), (self.right, "right"), (self.size, "size"),
                         (self.depth, "depth")):
            arr[t, nd] = nodes[col].to_numpy()
        known, which = np.unique(self.size, return_inverse=True)
        leaf_c = np.array([c_factor(float(n)) for n in known])[which.reshape(shape)]
        self.leaf_len = self.depth + leaf_c
        # for the walk: (left, right) of every node, a leaf's being itself
        leaf = self.feature < 0
        own = np.broadcast_to(np.arange(width), shape)
        self.child = np.stack([np.where(leaf, own, self.left), np.where(leaf, own, self.right)],
                              2).reshape(self.n_trees, -1).astype(np.intp)
        self.steps = np.where(leaf, 0, self.depth + 1).max(1)

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        """2^(-E[h(x)] / c(psi)): higher = more anomalous (as -score_samples)."""
        total = np.zeros(len(x))
        for begin in range(0, len(x), SCORE_ROWS):
            block = np.ascontiguousarray(x[begin:begin + SCORE_ROWS])
            total[begin:begin + SCORE_ROWS] = self._lengths(block)
        mean_h = total / self.n_trees
        return np.power(2.0, -mean_h / self.c_psi) if self.c_psi > 0 else np.zeros(len(x))

    def _lengths(self, x: np.ndarray) -> np.ndarray:
        """Path lengths of the rows, summed over the trees."""
        n, d = x.shape
        total, values, row = np.zeros(n), x.ravel(), np.arange(n, dtype=np.intp) * d
        at, value, cut = np.empty(n, np.intp), np.empty(n), np.empty(n)
        for t in range(self.n_trees):
            feature, threshold, child = self.feature[t].astype(np.intp), self.threshold[t], self.child[t]
            np.maximum(feature, 0, out=feature)
            node = np.zeros(n, np.intp)
            for _ in range(self.steps[t]):
                np.take(feature, node, out=at, mode="clip")
                at += row
                np.take(values, at, out=value, mode="clip")
                np.take(threshold, node, out=cut, mode="clip")
                node *= 2
                node += ~(value < cut)
                np.take(child, node, out=at, mode="clip")
                node, at = at, node
            total += self.leaf_len[t][node]
        return total


def fit_iforest(train: DataFrame, features: list[str], n_trees: int = 300, max_samples: int = 8192,
                seed: int = 17) -> IsolationForestModel:
    n = train.count()
    psi = int(min(max_samples, n))
    frac = min(1.0, psi / max(n, 1))
    sample_schema = T.StructType([T.StructField("tree", T.IntegerType())] +
                                 [T.StructField(f, T.DoubleType()) for f in features])
    samples = train.select("seq", *[F.col(f).cast("double") for f in features]).mapInPandas(
        _sampler(n_trees, frac, features, seed), sample_schema)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    nodes = samples.groupBy("tree").applyInPandas(_grower(features, max_depth, seed), NODE_SCHEMA)
    # node table size is fixed by (n_trees, psi), not by the data
    return IsolationForestModel(nodes.toPandas(), psi, features)


def score_iforest(df: DataFrame, model: IsolationForestModel, out_col: str = "iforest_raw") -> DataFrame:
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(model)
    feats = model.features

    def fn(batches):
        m = bc.value
        for b in batches:
            yield with_values(b, out_col, m.raw_scores(matrix(b, feats)))

    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.DoubleType())])
    return df.mapInArrow(fn, schema)

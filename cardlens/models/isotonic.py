"""Isotonic calibration (M2) by pooling adjacent violators in pieces that merge.

A *block* is a stretch of neighbouring scores with one fitted value, kept as
(lowest score, highest score, sum of labels, number of rows).  Pooling a list of
blocks joins neighbours as long as a value falls.  Pooled lists of neighbouring
score ranges can be joined and pooled again, and the result is that of pooling
all at once.  So Spark counts labels by distinct score, cuts the scores into
ranges, pools every range where it lies, and merges ranges, ``MERGE`` at a time,
until one is left.  Its blocks (the steps of the fitted curve) come to the
driver; rows never do.

The curve runs linearly between blocks and is constant outside, as in the usual
library implementations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.operators.prefix import with_quantile_bucket
from cardlens.session import materialize

RANGES, MERGE = 256, 8
_BLOCKS = "g long, lo double, hi double, s double, n double"


def pool(lo: np.ndarray, hi: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Blocks in order of score -> pooled blocks with rising values."""
    out: list[list[float]] = []
    for a, b, t, m in zip(lo.tolist(), hi.tolist(), s.tolist(), n.tolist()):
        out.append([a, b, t, m])
        # a value not above the one before it: compare t/m without dividing
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, b, t, m = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = b, out[-1][2] + t, out[-1][3] + m
    return [tuple(x) for x in out]


def _pool_group(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("lo").to_numpy(), kind="stable")
    blocks = pool(*(table.column(c).to_numpy()[order] for c in ("lo", "hi", "s", "n")))
    g = int(table.column("g")[0].as_py())
    cols = list(zip(*blocks))
    return pa.table({"g": pa.array([g] * len(blocks), pa.int64()),
                     **{c: pa.array(x, pa.float64()) for c, x in zip(("lo", "hi", "s", "n"), cols)}})


class Isotonic:
    """The fitted curve: knots ``x`` (rising) with values ``y``."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def apply(self, score: Column) -> Column:
        x, y = self.x, self.y

        @F.pandas_udf("double")
        def curve(s: pd.Series) -> pd.Series:
            if not len(x):
                return s
            return pd.Series(np.interp(s.to_numpy(dtype=np.float64), x, y)).where(s.notna().to_numpy())
        return curve(score)


def fit_isotonic(df: DataFrame, score: str, label: str, ranges: int = RANGES) -> Isotonic:
    """Curve through the rows of ``df`` with score and label; without rows it
    leaves scores as they are."""
    rows = df.select(F.col(score).cast("double").alias("lo"), F.col(label).cast("double").alias("y"))
    rows = rows.where(F.col("lo").isNotNull() & ~F.isnan("lo") & F.col("y").isNotNull())
    per = materialize(rows.groupBy("lo").agg(F.sum("y").alias("s"), F.count("y").cast("double").alias("n")))
    cut = with_quantile_bucket(per, "lo", "g", ranges)
    blocks = materialize(cut.select("g", "lo", F.col("lo").alias("hi"), "s", "n").groupBy("g")
                         .applyInArrow(_pool_group, _BLOCKS))
    left = ranges + 2
    while left > 1:
        left = -(-left // MERGE)
        blocks = blocks.withColumn("g", F.floor(F.col("g") / MERGE)).groupBy("g") \
            .applyInArrow(_pool_group, _BLOCKS)
    b = blocks.toPandas().sort_values("lo")
    value = (b["s"] / b["n"]).to_numpy()
    x = np.column_stack([b["lo"], b["hi"]]).ravel()
    y = np.repeat(value, 2)
    first = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
    return Isotonic(x[first], y[first])

"""Staged prediction: which prefix of the boosted trees to keep (M1, early stop).

All trees are fitted once.  One pass over the validation rows gives each row's
margin after every tree (a running sum of leaf values), and the average
precision (A6) of every prefix comes from one table with a row for each prefix
and distinct margin.  The best prefix stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardlens.constants import FEATURE_NAMES
from cardlens.models.attribution import TreeTable
from cardlens.models.batches import matrix, with_values
from cardlens.operators.quantiles import with_place
from cardlens.session import materialize

RANGES = 64


def with_margins(df: DataFrame, table: TreeTable, keep: list[str]) -> DataFrame:
    """``keep`` and ``margins``: half the log-odds after each tree."""
    held = df.sparkSession.sparkContext.broadcast(table)
    d = len(FEATURE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d)])
            m = held.value.margins(x.astype(np.float64))
            offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[d:], lists], names=[*keep, "margins"])
    narrow = df.select(*[F.col(n).cast("double") for n in FEATURE_NAMES], *keep)
    schema = ", ".join(f"{n} {t}" for n, t in narrow.dtypes[d:]) + ", margins array<double>"
    return narrow.mapInArrow(run, schema)


def with_probability(df: DataFrame, table: TreeTable, out: str) -> DataFrame:
    """All columns and the probability under all trees of ``table``."""
    held = df.sparkSession.sparkContext.broadcast(table)
    names = list(FEATURE_NAMES)

    def run(batches):
        for b in batches:
            m = held.value.margins(matrix(b, names))
            last = m[:, -1] if m.shape[1] else np.zeros(b.num_rows)
            yield with_values(b, out, 1.0 / (1.0 + np.exp(-2.0 * last)))
    from pyspark.sql import types as T
    return df.mapInArrow(run, T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())]))


def prefix_precision(valid: DataFrame, table: TreeTable, label: str = "is_fraud",
                     ranges: int = RANGES) -> list[float]:
    """A6 of every prefix of trees (1, 2, ... trees) on ``valid``."""
    wide = with_margins(valid.withColumn("_y", (F.col(label) == 1).cast("long")), table, ["_y"])
    per = materialize(wide.select("_y", F.posexplode("margins").alias("c", "x")).groupBy("c", "x")
                      .agg(F.sum("_y").alias("tp"), F.count(F.lit(1)).alias("n")))
    # ranges of margins for each prefix: trees x ranges numbers
    probs = [i / ranges for i in range(1, ranges)]
    found = {r["c"]: r["q"] for r in per.groupBy("c").agg(F.percentile_approx("x", probs, 1000).alias("q"))
             .collect()}
    trees = len(table.trees)
    placed = with_place(per, [sorted(set(found.get(c) or [])) for c in range(trees)], "b")
    sums = placed.groupBy("c", "b").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    above = Window.partitionBy("c").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("c", "b", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("tp0"),
                          F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"))
    total = F.sum("tp").over(Window.partitionBy("c"))
    positives = sums.withColumn("p", total).select("c", "b", "p")
    inside = Window.partitionBy("c", "b").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    # at most trees x ranges rows each
    curve = (placed.join(F.broadcast(offsets), ["c", "b"]).join(F.broadcast(positives), ["c", "b"])
             .withColumn("cum_tp", F.col("tp0") + F.sum("tp").over(inside))
             .withColumn("cum_n", F.col("n0") + F.sum("n").over(inside)))
    ap = {r["c"]: r["ap"] for r in curve.groupBy("c").agg(
        F.sum(F.col("tp") / F.nullif(F.col("p"), F.lit(0)) * F.col("cum_tp") / F.col("cum_n")).alias("ap")).collect()}
    return [ap.get(c) or 0.0 for c in range(trees)]


def best_prefix(precision: list[float]) -> int:
    """Number of trees with the highest precision, the fewest of equal ones."""
    return int(np.argmax(precision)) + 1 if precision else 0

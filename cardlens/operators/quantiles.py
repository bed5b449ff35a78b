"""Exact quantiles of many columns, without collecting or sorting a column.

Spark's exact ``percentile`` keeps every value of a column in one aggregation
buffer.  Here the whole table is read twice, whatever the number of columns:

1. One aggregate over all columns builds a mergeable quantile sketch of each
   (``percentile_approx``), whose rank error is known, and reads off it a
   bracket of two values around every order statistic that is needed.
2. One aggregate counts, for every column, the rows between the brackets (one
   group each) and the rows inside them by value.  Only the values inside, a
   few rows in ten thousand, are shuffled one by one; they are ranked bracket
   by bracket.

A bracket that misses its rank is widened and counted again.  That happens only
where a table is so small that the sketch's error is less than one row.

Result equals ``numpy.quantile`` / DuckDB ``quantile_cont``:
``x[lo] + (h - lo) * (x[hi] - x[lo])`` with ``h = (n - 1) * p``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
INF = float("inf")


def finite(col: Column) -> Column:
    """The value, null where it is not finite."""
    return F.when(~F.isnan(col) & (F.abs(col) < INF), col)


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def long_form(df: DataFrame, columns: list[Column], *more: Column | str) -> DataFrame:
    """(c, x, ...): the values of all columns under each other, c counting the
    columns; nulls stay.  ``more``: columns that every value keeps."""
    wide = df.select(*more, *[x.alias(f"x{i}") for i, x in enumerate(columns)])
    kept = [c for c in wide.columns[:len(wide.columns) - len(columns)]]
    cells = [F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("x")) for i in range(len(columns))]
    return wide.select(*kept, F.inline(F.array(*cells)))


def with_place(long: DataFrame, cuts: list[list[float]], name: str) -> DataFrame:
    """Add how many of its column's sorted cuts a value has reached, by binary
    search in one constant array: a few steps a value, whatever the columns."""
    depth = max((len(c) for c in cuts), default=0).bit_length()
    width = (1 << depth) - 1
    padded = [x for c in cuts for x in [*c, *[INF] * (width - len(c))]]
    if not padded:
        return long.withColumn(name, F.lit(0))
    table = F.expr("array(" + ", ".join("double('Infinity')" if x == INF else "double('-Infinity')"
                                        if x == -INF else f"{x!r}D" for x in padded) + ")")
    out = long.withColumn(name, F.lit(0))
    for step in (1 << d for d in range(depth - 1, -1, -1)):
        at = F.col("c") * width + F.col(name) + (step - 1)
        out = out.withColumn(name, F.col(name) + F.when(F.get(table, at) <= F.col("x"), step).otherwise(0))
    return out


def _cuts(spans: list[tuple[float, float]]) -> list[float]:
    """Cuts of which an odd number is reached exactly inside the spans."""
    return [x for lo, hi in spans for x in (lo, math.nextafter(hi, INF))]


def order_statistics(df: DataFrame, columns: dict[str, Column],
                     spans: dict[str, dict[int, tuple[float, float]]]) -> dict[str, dict[int, float]]:
    """The values at these 0-based ranks of every column, given a bracket for
    each.  One pass, and another over those whose bracket missed."""
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    left = {c: dict(s) for c, s in spans.items() if s}
    while left:
        merged = {c: _merged(list(s.values())) for c, s in left.items()}
        names = list(merged)
        long = long_form(df, [finite(columns[c]) for c in names]).where("x is not null")
        placed = with_place(long, [_cuts(merged[c]) for c in names], "zone")
        # between the spans one group for each gap, inside them one for each value
        counts = (placed.groupBy("c", "zone", F.when(F.col("zone") % 2 == 1, F.col("x")).alias("x"))
                  .agg(F.count(F.lit(1)).alias("n")))
        in_zone = Window.partitionBy("c", "zone").orderBy("x")
        ranked = counts.withColumn("to", F.sum("n").over(in_zone))
        # the rows of a zone, and inside the spans only values at a wanted rank
        zones = {(r["c"], r["zone"]): r["n"] for r in
                 counts.groupBy("c", "zone").agg(F.sum("n").alias("n")).collect()}
        wanted, missed = [], {}
        for k, c in enumerate(names):
            s = merged[c]
            for r, (lo, hi) in left[c].items():
                i = next(i for i, (a, b) in enumerate(s) if a <= lo and hi <= b)
                before = sum(n for (kk, z), n in zones.items() if kk == k and z < 2 * i + 1)
                inside = zones.get((k, 2 * i + 1), 0)
                if r < before:
                    missed.setdefault(c, {})[r] = (-INF, s[i][1])
                elif r >= before + inside:
                    missed.setdefault(c, {})[r] = (s[i][0], INF)
                else:
                    wanted.append((k, 2 * i + 1, r, r - before))
        if wanted:
            want = df.sparkSession.createDataFrame(wanted, "c int, zone int, r long, nth long")
            # a few rows for each column
            hit = ranked.join(F.broadcast(want), ["c", "zone"]).where(
                (F.col("nth") < F.col("to")) & (F.col("nth") >= F.col("to") - F.col("n")))
            for row in hit.select("c", "r", "x").collect():
                found[names[row["c"]]][row["r"]] = row["x"]
        left = missed
    return found


def column_quantiles(df: DataFrame, columns: dict[str, Column], probs: dict[str, list[float]],
                     accuracy: int = ACCURACY) -> dict[str, list[float]]:
    """Exact quantiles of expressions over ``df``; a column without a finite
    value has none.  The result is as large as ``probs``."""
    margin = 2.5 / accuracy
    aggs, asked = [], {}
    wide = df.select(*[finite(x).alias(f"x{i}") for i, x in enumerate(columns.values())])
    for i, c in enumerate(columns):
        v = F.col(f"x{i}")
        asked[c] = sorted({min(1.0, max(0.0, p + d)) for p in probs[c] for d in (-margin, margin)})
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.percentile_approx(v, asked[c], accuracy).alias(f"q{i}")]
    row = wide.agg(*aggs).first()
    known: dict[str, dict[int, float]] = {}
    spans: dict[str, dict[int, tuple[float, float]]] = {}
    for i, c in enumerate(columns):
        n, lo, hi = row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]
        if not n:
            continue
        at = dict(zip(asked[c], row[f"q{i}"]))
        known[c], spans[c] = {0: lo, n - 1: hi}, {}
        for p in probs[c]:
            h = (n - 1) * p
            for r in {math.floor(h), min(math.floor(h) + 1, n - 1)} - known[c].keys():
                a, b = (at[min(1.0, max(0.0, p + d))] for d in (-margin, margin))
                old = spans[c].get(r, (a, b))
                spans[c][r] = (min(a, old[0]), max(b, old[1]))
    found = order_statistics(df, {c: columns[c] for c in spans}, spans) if spans else {}
    out: dict[str, list[float]] = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if not n:
            continue
        value = known[c] | found.get(c, {})
        out[c] = []
        for p in probs[c]:
            h = (n - 1) * p
            lo, hi = value[math.floor(h)], value[min(math.floor(h) + 1, n - 1)]
            out[c].append(lo + (h - math.floor(h)) * (hi - lo))
    return out


def quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of one column, None each for a column without values."""
    got = column_quantiles(df, {col: F.col(col).cast("double")}, {col: probs})
    return got.get(col, [None] * len(probs))

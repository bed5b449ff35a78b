"""Population stability and drift.

One table holds both sides, told apart by ``side`` ('b' baseline, 'c' current).
It is read three times for any number of features: twice for the exact quantile
edges of the baseline, once for all bin counts and means.  The edges (bins + 1
numbers a feature) are literals of the third pass, whose result has one row for
each feature, side and bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.constants import PSI_INVESTIGATE, PSI_STABLE
from cardlens.operators.quantiles import column_quantiles, finite, long_form, with_place

VALUE_DIGITS = 9
PSI_BINS, SCORE_BINS = 10, 20


def value_of(feature: str) -> Column:
    """Values are rounded to 9 decimals (model vectors are float32 anyway) so that
    last-bit noise from summation order cannot move a value across a bin edge.
    Whole numbers, as flags and counts are, need no decimal arithmetic."""
    v = F.col(feature).cast("double")
    return F.when(v == F.floor(v), v + 0.0).otherwise(F.round(v, VALUE_DIGITS))


def with_sides(baseline: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Both tables as one with ``side``."""
    return (baseline.select(*features, F.lit("b").alias("side"))
            .unionByName(current.select(*features, F.lit("c").alias("side"))))


def baseline_edges(sided: DataFrame, bins: dict[str, int]) -> dict[str, list[float]]:
    """De-duplicated baseline quantile edges of every feature."""
    got = column_quantiles(sided.where("side = 'b'"), {f: value_of(f) for f in bins},
                           {f: [i / k for i in range(k + 1)] for f, k in bins.items()})
    return {f: sorted(set(q)) for f, q in got.items()}


def psi(sided: DataFrame, bins: dict[str, int]) -> DataFrame:
    """A14 + A15 and the means per feature: ``(feature, psi, n_edges,
    rate_shift_abs, baseline_mean, current_mean, nb, nc)``.

    With fewer than 3 distinct edges the rate form is used:
    ``|b - c| * ln(max(c, 1e-6) / max(b, 1e-6))`` on the means (negative when
    the rate falls, kept as is); ``rate_shift_abs`` reports ``|b - c|``.
    """
    edges = baseline_edges(sided, bins)
    names = list(bins)
    long = long_form(sided, [F.struct(finite(value_of(f)).alias("x"), F.col(f).cast("double").alias("raw"))
                             for f in names], "side")
    long = long.select("side", "c", F.col("x.x").alias("x"), F.col("x.raw").alias("raw"))
    # bin: number of inner edges reached; none for values that are not finite
    placed = with_place(long, [edges.get(f, [])[1:-1] for f in names], "bin")
    label = F.array(*map(F.lit, names))
    counts = (placed.groupBy("c", "side", F.when(F.col("x").isNotNull(), F.col("bin")).alias("bin"))
              .agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.count("raw").alias("n_raw"),
                   F.sum("raw").alias("s_raw")).withColumn("feature", F.get(label, F.col("c"))))

    def side(s: str, col: str) -> Column:
        return F.sum(F.when(F.col("side") == s, F.col(col)))

    most = max(bins.values(), default=0)
    wide = counts.groupBy("feature").agg(
        *[F.coalesce(side(s, "n"), F.lit(0)).alias("n" + s) for s in "bc"],
        *[(side(s, "s") / F.nullif(side(s, "n"), F.lit(0))).alias(s + "_rate") for s in "bc"],
        *[(side(s, "s_raw") / F.nullif(side(s, "n_raw"), F.lit(0))).alias(s + "_mean") for s in "bc"],
        *[F.coalesce(F.sum(F.when((F.col("side") == s) & (F.col("bin") == i), F.col("n"))), F.lit(0))
          .alias(f"{s}{i}") for s in "bc" for i in range(most)])
    sizes = F.create_map(*[F.lit(x) for f in bins for x in (f, len(edges.get(f, [])))])
    wide = wide.withColumn("n_edges", F.element_at(sizes, F.col("feature")))
    k = F.greatest(F.col("n_edges") - 1, F.lit(1))
    total = F.lit(0.0)
    for i in range(most):
        bp, cp = ((F.col(f"{s}{i}") + 0.5) / (F.col("n" + s) + 0.5 * k) for s in "bc")
        total = total + F.when(F.lit(i) < k, (cp - bp) * F.log(cp / bp)).otherwise(0.0)
    b, c = F.col("b_rate"), F.col("c_rate")
    rate = F.abs(b - c) * F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(b, F.lit(1e-6)))
    value = (F.when((F.col("nb") < 2) | (F.col("nc") < 2), 0.0)
              .when(F.col("n_edges") < 3, rate).otherwise(total))
    return wide.select("feature", value.alias("psi"), "n_edges", F.abs(b - c).alias("rate_shift_abs"),
                       F.col("b_mean").alias("baseline_mean"), F.col("c_mean").alias("current_mean"),
                       "nb", "nc")


def status(psi_col) -> F.Column:
    return (F.when(psi_col < PSI_STABLE, "stable")
             .when(psi_col < PSI_INVESTIGATE, "monitor").otherwise("investigate"))


def drift_report(sided: DataFrame, features: list[str], score: str | None = None) -> DataFrame:
    """Per feature PSI, means, % shift and status; with ``score`` also A17,
    its PSI with 20 bins, as a further row."""
    bins = {f: PSI_BINS for f in features} | ({score: SCORE_BINS} if score else {})
    shift = 100.0 * (F.col("current_mean") - F.col("baseline_mean")) / F.greatest(
        F.abs(F.col("baseline_mean")), F.lit(1e-9))
    return psi(sided, bins).select("feature", "psi", "baseline_mean", "current_mean",
                                   shift.alias("mean_shift_pct"), status(F.col("psi")).alias("status"),
                                   "rate_shift_abs")


def score_psi(sided: DataFrame, score: str = "risk_score", bins: int = SCORE_BINS) -> DataFrame:
    """PSI of the score with 20 bins."""
    return psi(sided, {score: bins}).select("psi", status(F.col("psi")).alias("status"))

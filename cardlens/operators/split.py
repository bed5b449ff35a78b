"""Chronological train / validation / test split by exact time rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.operators.prefix import global_row_number

#: Bins of one counting pass of the selection.
SELECT_BINS = 4096


def time_split(txn: DataFrame, train_frac: float = 0.7, valid_frac: float = 0.15,
               n_buckets: int = 1024) -> DataFrame:
    """Adds ``global_rank`` (0-based, order ``event_us, seq``) and ``split``.

    ``a = int(n*train_frac)``, ``b = int(n*(train_frac+valid_frac))``: rank < a is
    train, a <= rank < b validation, the rest test.  Where only the split is
    needed ``with_split`` gives it without ranking all rows.
    """
    n = txn.count()
    a = int(n * train_frac)
    b = int(n * (train_frac + valid_frac))
    ranked = global_row_number(txn, ["event_us", "seq"], n_buckets=n_buckets)
    r = F.col("global_rank")
    return ranked.withColumn(
        "split", F.when(r < a, "train").when(r < b, "valid").otherwise("test"))


#: Key before all rows that have one.
NO_KEY = (-(1 << 63), None)
Key = tuple[int, int | None]


def keys_at(df: DataFrame, ranks: list[int], first: str = "event_us",
            second: str | None = "seq", bins: int = SELECT_BINS) -> list[Key | None]:
    """The keys ``(first, second)`` of the rows with these 0-based ranks, by
    distributed selection: count the rows of ``bins`` bins between bounds, go on
    in the bin that holds the rank.  All ranks share a pass, which is one
    aggregate with at most ``bins`` rows for each rank; integer keys of 64 bits
    need six passes at most.  Rows at one ``first`` are told apart by
    ``second`` in the same way.  None for a rank outside the table; rows without
    ``first`` come first, with ``NO_KEY``."""
    x = F.col(first).cast("long")
    whole = df.agg(F.min(x), F.max(x), F.count(x), F.count(F.lit(1))).first()
    lo, hi, n, n_all = whole
    y = F.col(second).cast("long") if second else F.lit(None).cast("long")
    out: dict[int, Key | None] = {}
    open_ranks: dict[int, tuple[int, int, int]] = {}     # rank -> (lo, hi, rows before lo)
    for r in ranks:
        if n_all - n <= r < n_all:
            open_ranks[r] = (lo, hi, n_all - n)
        else:
            out[r] = NO_KEY if 0 <= r < n_all else None
    tied: dict[int, tuple[int, int]] = {}                 # rank -> (first, rank among its rows)
    while open_ranks:
        spans = sorted({(a, b) for a, b, _ in open_ranks.values()})
        span, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (a, b) in enumerate(spans):
            width = -(-(b - a + 1) // bins)
            inside = F.col("x").between(a, b)
            span = F.when(inside, F.lit(i)).otherwise(span)
            # whole division rounded down; a cell holds ``width`` values at most
            cell = F.when(inside, F.expr(f"x div {width} - if(x % {width} < 0, 1, 0)")).otherwise(cell)
        rows = (df.select(x.alias("x"), y.alias("y"))
                .select("x", "y", span.alias("span"), cell.alias("cell")).where("span is not null")
                .groupBy("span", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"),
                                             F.max("x").alias("hi"), F.min("y").alias("y"))
                .orderBy("span", "cell").collect())
        narrower = {}
        for r, (a, b, before) in open_ranks.items():
            for c in (c for c in rows if spans[c["span"]] == (a, b)):
                if r < before + c["n"]:
                    break
                before += c["n"]
            if c["n"] == 1:
                out[r] = (c["lo"], c["y"])
            elif c["lo"] == c["hi"]:
                tied[r] = (c["lo"], r - before)
            else:
                narrower[r] = (c["lo"], c["hi"], before)
        open_ranks = narrower
    for r, (value, nth) in tied.items():
        inner = keys_at(df.where(x == value), [nth], second, None, bins)[0] if second else None
        out[r] = (value, inner[0] if inner else None)
    return [out[r] for r in ranks]


def _before(key: Key | None) -> Column:
    """Rows whose ``(event_us, seq)`` is smaller than ``key``."""
    us, seq = F.col("event_us"), F.col("seq")
    if key is None:
        return F.lit(True)
    later = F.lit(False) if key[1] is None else (us == key[0]) & (F.coalesce(seq < key[1], F.lit(True)))
    return us.isNull() | (us < key[0]) | later


def with_split(txn: DataFrame, train_frac: float = 0.7, valid_frac: float = 0.15) -> DataFrame:
    """Adds ``split`` as ``time_split`` does, by comparing each row with the keys
    at the two cut ranks: no shuffle, no window.  Rows with equal ``event_us``
    and ``seq`` fall to one side together."""
    n = txn.count()
    cuts = [int(n * train_frac), int(n * (train_frac + valid_frac))]
    first, second = keys_at(txn, cuts)
    return txn.withColumn("split", F.when(_before(first), "train").when(_before(second), "valid")
                          .otherwise("test"))

"""The 31 strictly backward-looking transaction features (F1-F31, W2, ST3 batch form).

Semantics: a row sees only *committed* rows of the same card that come before
it in ``(event_us, seq)`` order; a window of length L includes age == L; an
earlier row at the same instant is seen, a later one is not.

Physical plan: rows are dealt by ``(card_id, slice)``, slices being whole weeks
(14 days by default), so a busy card is one task a slice.  Committed rows of the
last 7 days of a slice also stand in the next one as *context*.  Every feature
is a running aggregate, so a row costs the same on a quiet and on a hot card:

* **Sliding counts and sums** (1 h, 24 h, 7 d): a committed row adds at its own
  time and, as a *leave row*, takes away at the time when it leaves the window.
  Sums are decimals, so what is taken away is exactly what was added.
* **Distinct values** are intervals.  One window by value finds for every
  committed row the neighbours with the same value.  A row adds 1 if its value
  is not present, and its leave row takes 1 away if the value has not occurred
  again by then; the count is a running sum, too.
* **The sliding maximum** uses tiles as long as the window.  A window that ends
  in one tile is a prefix of that tile and a suffix of the one before: a running
  maximum in time order over rows, and one in reverse order over leave rows.
* **All-time state** enters a slice from outside: a row with the moments of all
  earlier slices, and *seed rows*, one for each value seen before, which only
  the windows by value read.

All windows ask for rows by ``(card_id, slice)``, so there is one shuffle; the
forward windows share one sort.  A transaction travels as one struct, which only
its own row holds, and sorts begin with a hash of the card, a long that tells most
rows apart without reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlens.constants import (DAY_US, FEATURE_NAMES, HOUR_US, IDENTIFIER_COLUMNS,
                                MCC_DEFAULT_RISK, MCC_RISK_PRIOR, PROTECTED_ATTRIBUTES, WEEK_US)
from cardlens.functions.scoring import clip

DEFAULT_BUCKET_DAYS = 14
WEEK_S = 7 * 86400.0

_NOVELTY = (("merchant", "merchant_key"), ("device", "device_key"), ("country", "country_key"))
_DISTINCT = (("merchant", "merchant_key", DAY_US), ("country", "country_key", WEEK_US),
             ("device", "device_key", WEEK_US))

_KEYS = ("bucket", "merchant_key", "country_key", "device_key")
_EXACT = "decimal(38,12)"
_FIRST_SEQ, _LAST_SEQ = -(1 << 63), (1 << 63) - 1


def _d(c: Column) -> Column:
    return c.cast("double")


def normalized(txn: DataFrame) -> DataFrame:
    """Keys the features read, with the defaults of P5 applied."""
    cols = txn.columns
    commit = F.col("commit") if "commit" in cols else F.lit(True)
    return txn.withColumns({
        "commit": F.coalesce(commit, F.lit(True)),
        "merchant_key": F.col("merchant_id").cast("string"),
        "country_key": F.coalesce(F.col("merchant_country"), F.lit("US")),
        "device_key": F.coalesce(F.nullif(F.col("device_id"), F.lit("")), F.lit("unknown")),
    })


def intrinsic_columns() -> dict[str, Column]:
    """Functions of the row alone (UTC hour / Monday=0 weekday from event_us)."""
    us = F.col("event_us")
    hour = F.floor(F.pmod(us, F.lit(DAY_US)) / HOUR_US)
    dow = F.pmod(F.floor(us / DAY_US) + 3, F.lit(7))          # 1970-01-01 was a Thursday
    issuer = F.coalesce(F.col("issuer_country"), F.lit("US"))
    country = F.coalesce(F.col("merchant_country"), F.lit("US"))

    def flag(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)

    return {
        "amount": _d(F.col("amount")),
        "log_amount": F.log1p(F.col("amount")),
        "hour_of_day": _d(hour),
        "day_of_week": _d(dow),
        "is_night": flag((hour < 6) | (hour >= 23)),
        "is_weekend": flag(dow >= 5),
        "channel_is_ecom": flag(F.col("channel") == "ecom"),
        "channel_is_atm": flag(F.col("channel") == "atm"),
        "entry_is_swipe": flag(F.col("entry_mode") == "swipe"),
        "entry_is_keyed": flag(F.col("entry_mode") == "keyed"),
        "is_cross_border": flag(country != issuer),
    }


def _hour_rad(us: Column) -> Column:
    return F.radians(F.floor(F.pmod(us, F.lit(DAY_US)) / HOUR_US) * 15.0)


def _bucket_col(bucket_us: int) -> Column:
    return F.floor(F.col("event_us") / F.lit(bucket_us)).cast("long")


def _slice_state(rows: DataFrame) -> DataFrame:
    """Per (card, slice): moments and last time of committed rows in earlier
    slices."""
    c = F.col("commit")
    rad = _hour_rad(F.col("event_us"))
    per_slice = rows.groupBy("card_id", "bucket").agg(
        F.count(F.when(c, 1)).alias("n"), F.sum(F.when(c, F.col("amount"))).alias("s"),
        F.sum(F.when(c, F.col("amount") * F.col("amount"))).alias("ss"),
        F.sum(F.when(c, F.sin(rad))).alias("sin"), F.sum(F.when(c, F.cos(rad))).alias("cos"),
        F.max(F.when(c, F.col("event_us"))).alias("last"))
    before = Window.partitionBy("card_id").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    return per_slice.select(
        "card_id", "bucket", *[F.sum(n).over(before).alias(n) for n in ("n", "s", "ss", "sin", "cos")],
        F.max("last").over(before).alias("last"))


def _seen_before(rows: DataFrame) -> DataFrame:
    """(card, slice, kind, value) of the values of a slice that a committed row
    of an earlier slice had."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(col).alias("value"))
                      for k, col in _NOVELTY])
    per_slice = (rows.select("card_id", "bucket", "commit", F.inline(kinds))
                 .groupBy("card_id", "kind", "value", "bucket").agg(F.max("commit").alias("c")))
    before = Window.partitionBy("card_id", "kind", "value").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    return (per_slice.withColumn("seen", F.max("c").over(before)).where("seen")
            .select("card_id", "bucket", "kind", "value"))


def _rows(base: DataFrame, bucket_us: int, keep: list[str]) -> DataFrame:
    """Own rows, context rows (``ctx``) and seed rows (``seed_kind``) of every
    slice.  Own rows hold the columns ``keep`` as ``_row``."""
    end = (F.col("bucket") + 1) * F.lit(bucket_us)
    again = F.col("commit") & (F.col("event_us") >= end - F.lit(WEEK_US))
    later = F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in keep])
    rows = base.select("card_id", "bucket", "event_us", "seq", "commit",
                       F.col("amount").cast("double").alias("amount"),
                       *[col for _, col in _NOVELTY], whole.alias("_row"), F.explode(later).alias("_later"))
    rows = rows.withColumns({
        "bucket": F.col("bucket") + F.col("_later"), "ctx": F.col("_later") == 1,
        "_row": F.when(F.col("_later") == 0, F.col("_row")),
        "seed_kind": F.lit(None).cast("string")}).drop("_later")
    seeds = _seen_before(base).select(
        "card_id", "bucket", F.lit(False).alias("commit"), F.lit(True).alias("ctx"),
        F.col("kind").alias("seed_kind"),
        *[F.when(F.col("kind") == k, F.col("value")).alias(col) for k, col in _NOVELTY])
    return rows.unionByName(seeds, allowMissingColumns=True)


def _by_value(rows: DataFrame) -> DataFrame:
    """For every kind of value: ``_new`` (no committed row had it before),
    ``_in`` (it is not in the sliding window of a committed row) and ``_next``
    (when a committed row has it next).  Seed rows end here."""
    pos = F.struct("event_us", "seq")
    for kind, key, length in _DISTINCT:
        # seeds, committed rows in time order, quotes
        w = Window.partitionBy(F.xxhash64("card_id", "bucket", key), "card_id", "bucket", key).orderBy(
            F.col("seed_kind").eqNullSafe(kind).desc(), F.col("commit").desc(), "event_us", "seq")
        sofar = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.col("commit") & ~F.col("ctx")
        first = F.min(F.when(own, pos)).over(sofar)
        before = F.lag(F.when(F.col("commit"), F.col("event_us"))).over(w)
        rows = rows.withColumns({
            f"_seed_{kind}": F.max(F.col("seed_kind").eqNullSafe(kind)).over(sofar),
            f"_first_{kind}": first, f"_before_{kind}": before,
            f"_next_{kind}": F.lead(F.when(F.col("commit"), F.col("event_us"))).over(w)})
        seen = F.col(f"_seed_{kind}") | F.coalesce(F.col(f"_first_{kind}") < pos, F.lit(False))
        enters = F.col("commit") & F.col(key).isNotNull() & F.coalesce(
            F.col(f"_before_{kind}") + length < F.col("event_us"), F.lit(True))
        rows = rows.withColumns({f"_new_{kind}": ~seen, f"_in_{kind}": enters}).drop(
            f"_seed_{kind}", f"_first_{kind}", f"_before_{kind}")
    return rows.where("seed_kind is null")


def _timeline(rows: DataFrame, bucket_us: int, keep: list[str]) -> DataFrame:
    """Rows and their leave rows by time, ``shift`` being 0 or the window that a
    row leaves.  Own rows carry the transaction, the columns ``keep``, as ``_row``."""
    times = F.when(F.col("commit"), F.array(*[F.lit(n).cast("long") for n in (0, HOUR_US, DAY_US, WEEK_US)])
                   ).otherwise(F.array(F.lit(0).cast("long")))
    stays = F.col("shift") == 0
    pos = F.col("event_us") + F.col("shift")
    start = F.col("bucket") * F.lit(bucket_us)

    def step(kind: str, key: str, length: int) -> Column:
        leaves = (F.col("shift") == length) & F.col(key).isNotNull() & ~F.coalesce(
            F.col(f"_next_{kind}") <= pos, F.lit(False))
        return F.when(stays & F.col(f"_in_{kind}"), 1).when(leaves, -1).alias(f"_d_{kind}")
    return (rows.withColumn("shift", F.explode(times))
            .where(stays | (pos < start + F.lit(bucket_us)))
            .select("card_id", "bucket", "shift", pos.alias("pos_us"),
                    F.floor(pos / F.lit(DAY_US)).cast("long").alias("day"),
                    F.when(stays, F.col("seq")).otherwise(_LAST_SEQ).alias("pos_seq"),
                    (stays & F.col("commit")).alias("hist"),
                    (stays & F.col("commit") & ~F.col("ctx")).alias("own"),
                    F.when(F.col("commit"), F.col("amount")).alias("amt"),
                    *[step(*d) for d in _DISTINCT], *[f"_new_{kind}" for kind, _, _ in _DISTINCT],
                    F.when(stays, F.col("_row")).alias("_row")))


def card_features(txn: DataFrame, bucket_days: int = DEFAULT_BUCKET_DAYS) -> DataFrame:
    """F1-F28 for every row of ``txn`` (an optional boolean ``commit`` column
    marks quotes: they are scored but never become history).  Slices are whole
    weeks, at least ``bucket_days``.  Amounts that are not finite are no part of
    sliding sums."""
    if bucket_days < 7:
        raise ValueError("bucket_days must cover the 7-day frame")
    bucket_us = -(-bucket_days // 7) * WEEK_US
    base = normalized(txn).withColumn("bucket", _bucket_col(bucket_us))
    keep = [c for c in base.columns if c not in _KEYS]
    rows = _rows(base, bucket_us, keep).repartition("card_id", "bucket")
    line = _timeline(_by_value(rows), bucket_us, keep)
    state = _slice_state(base).select(
        "card_id", "bucket", (F.col("bucket") * F.lit(bucket_us)).alias("pos_us"),
        F.floor(F.col("bucket") * F.lit(bucket_us) / F.lit(DAY_US)).cast("long").alias("day"),
        F.lit(_FIRST_SEQ).alias("pos_seq"), F.struct("n", "s", "ss", "sin", "cos", "last").alias("carry"))
    line = line.unionByName(state, allowMissingColumns=True).repartition("card_id", "bucket")
    line = line.withColumn("_card", F.xxhash64("card_id", "bucket"))
    card = ["_card", "card_id", "bucket"]

    in_time = ["pos_us", "pos_seq"]
    w = (Window.partitionBy(*card).orderBy("day", *in_time)
         .rowsBetween(Window.unboundedPreceding, -1))
    w_day = (Window.partitionBy(*card, "day").orderBy(*in_time)
             .rowsBetween(Window.unboundedPreceding, -1))
    w_back = (Window.partitionBy(*card, "day").orderBy(*[F.desc(c) for c in in_time])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own, hist, amt, carry = F.col("own"), F.col("hist"), F.col("amt"), F.col("carry")
    exact = amt.try_cast(_EXACT)
    rad = _hour_rad(F.col("pos_us"))

    def moment(name: str, value: Column) -> Column:
        return F.sum(F.coalesce(carry[name], F.when(own, value))).over(w)

    cols = {"_n": moment("n", F.lit(1).cast("long")), "_s": moment("s", amt), "_ss": moment("ss", amt * amt),
            "_sin": moment("sin", F.sin(rad)), "_cos": moment("cos", F.cos(rad)),
            "_last_us": F.max(F.coalesce(carry["last"], F.when(hist, F.col("pos_us")))).over(w)}
    for name, length in (("1h", HOUR_US), ("24h", DAY_US), ("7d", WEEK_US)):
        left = F.col("shift") == length
        cols[f"_c{name}"] = F.sum(F.when(hist, 1).when(left, -1)).over(w)
        if name != "7d":
            cols[f"_s{name}"] = F.sum(F.when(hist, exact).when(left, -exact)).over(w)
    for kind, _, _ in _DISTINCT:
        cols[f"_n_{kind}"] = F.sum(f"_d_{kind}").over(w)
    cols["_max"] = F.max(F.when(hist, amt)).over(w_day)
    framed = line.withColumns(cols).where(F.col("_row").isNotNull() | (F.col("shift") == DAY_US))
    framed = framed.withColumn("_max_", F.max(F.when(F.col("shift") == DAY_US, amt)).over(w_back))
    made = [*cols, "_max_", *[f"_new_{kind}" for kind, _, _ in _DISTINCT]]
    framed = framed.where("_row is not null").select("_row.*", *made)

    n = F.coalesce(F.col("_n"), F.lit(0))
    mean = F.col("_s") / n
    var = F.greatest(F.col("_ss") / n - mean * mean, F.lit(1e-9))
    zscore = F.when(n >= 2, clip((F.col("amount") - mean) / F.sqrt(var), -20.0, 20.0)) \
              .otherwise(0.0)
    ratio = F.when(n >= 2, clip(F.col("amount") / F.greatest(mean, F.lit(1e-6)), 0.0, 500.0)) \
             .otherwise(1.0)
    hour = F.floor(F.pmod(F.col("event_us"), F.lit(DAY_US)) / HOUR_US)
    mean_hour = F.pmod(F.degrees(F.atan2(F.col("_sin") / n, F.col("_cos") / n)), F.lit(360.0)) / 15.0
    diff = F.abs(hour - mean_hour)
    hour_dev = F.when(n >= 3, F.least(diff, 24.0 - diff)).otherwise(0.0)
    secs = F.when(F.col("_last_us").isNull(), F.lit(WEEK_S)).otherwise(
        F.least((F.col("event_us") - F.col("_last_us")) / 1e6, F.lit(WEEK_S)))
    s1h, s24h = (F.coalesce(_d(F.col(c)), F.lit(0.0)) for c in ("_s1h", "_s24h"))
    vel = F.when(s24h > 0, clip(s1h / F.greatest(s24h / 24.0, F.lit(1e-6)), 0.0, 500.0)) \
           .otherwise(0.0)

    def count(name: str) -> Column:
        return F.coalesce(_d(F.col(name)), F.lit(0.0))

    def novel(kind: str) -> Column:
        return F.when(F.col(f"_new_{kind}"), 1.0).otherwise(0.0)

    out = framed.withColumns({
        **intrinsic_columns(),
        "amount_zscore_card": zscore,
        "amount_ratio_card_mean": ratio,
        "hour_deviation_card": _d(hour_dev),
        "card_txn_count_1h": count("_c1h"),
        "card_txn_count_24h": count("_c24h"),
        "card_txn_count_7d": count("_c7d"),
        "card_amount_sum_1h": s1h,
        "card_amount_sum_24h": s24h,
        "card_amount_max_24h": F.coalesce(F.greatest("_max", "_max_"), F.lit(0.0)),
        "card_seconds_since_last": secs,
        "card_velocity_ratio": vel,
        "card_distinct_merchants_24h": count("_n_merchant"),
        "card_distinct_countries_7d": count("_n_country"),
        "card_distinct_devices_7d": count("_n_device"),
        "is_new_merchant_for_card": novel("merchant"),
        "is_new_device_for_card": novel("device"),
        "is_new_country_for_card": novel("country"),
        "history_len": F.least(n, F.lit(7)).cast("int"),
    })
    drop = [c for c in out.columns if c.startswith("_")]
    return out.drop(*drop, *_KEYS)


def mcc_risk(category: Column) -> Column:
    """Category prior from a literal map, 1.0 when unknown."""
    entries = []
    for k, v in MCC_RISK_PRIOR.items():
        entries += [F.lit(k), F.lit(float(v))]
    return F.coalesce(F.element_at(F.create_map(*entries), category), F.lit(MCC_DEFAULT_RISK))


def assert_model_inputs(columns: list[str] | tuple[str, ...]) -> None:
    """Protected attributes and raw identifiers never reach a model."""
    bad = (set(columns) & PROTECTED_ATTRIBUTES) | (set(columns) & IDENTIFIER_COLUMNS)
    if bad:
        raise ValueError(f"columns not allowed as model inputs: {sorted(bad)}")
    if tuple(columns) != FEATURE_NAMES:
        raise ValueError("model inputs must be exactly FEATURE_NAMES, in order")

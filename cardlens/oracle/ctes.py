"""Shared DuckDB CTE fragments (bindings and the feature table)."""

from __future__ import annotations

from cardlens.constants import FEATURE_NAMES, MCC_RISK_PRIOR
from cardlens.sources.bindings import AGE_BANDS, CATEGORIES, COUNTRIES, ENTRY


def _lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TXN = f"""
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) AS us
  FROM events),
txn AS (
  SELECT concat('txn_', event_id) AS transaction_id, event_id AS seq,
    CASE WHEN user_id % 10 = 0 THEN 1704067200000000 + (us - 1704067200000000) // 72 ELSE us END AS event_us,
    concat('card_', user_id) AS card_id, concat('cust_', user_id) AS customer_id,
    concat('mch_', k % 40) AS merchant_id,
    ({_lst(CATEGORIES)})[k % 10 + 1] AS merchant_category,
    CASE WHEN event_id % 13 = 0 THEN ({_lst(COUNTRIES)})[k % 10 + 1] ELSE 'US' END AS merchant_country,
    value * 10.0 AS amount, 'USD' AS currency,
    CASE event_type WHEN 'view' THEN 'pos' WHEN 'purchase' THEN 'pos' WHEN 'click' THEN 'ecom'
                    WHEN 'error' THEN 'ecom' ELSE 'atm' END AS channel,
    ({_lst(ENTRY)})[event_id % 5 + 1] AS entry_mode,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 7 = 0 THEN concat('dev_x', k)
         ELSE concat('dev_', user_id) END AS device_id,
    'US' AS issuer_country,
    ({_lst(AGE_BANDS)})[user_id % 4 + 1] AS customer_age_band,
    CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS is_fraud
  FROM ev)"""


def H(salt: str, key: str = "seq") -> str:
    """DuckDB twin of ``bindings.unit_hash``."""
    return (f"(CAST(('0x' || substr(md5(concat('{salt}', {key})), 1, 8))::BIGINT AS DOUBLE)"
            f" / 4294967296.0)")


def _sigmoid(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-least(greatest({z}, -30.0), 30.0))))"


def _logit(p: str) -> str:
    q = f"least(greatest({p}, 1e-6), 1.0 - 1e-6)"
    return f"ln({q} / (1.0 - {q}))"


def blend_sql(p: str, s_if: str, s_seq: str, ref_if: str = "0.5", ref_seq: str = "0.5") -> str:
    adj = f"least(greatest(1.6 * ({s_if} - {ref_if}) + 1.1 * ({s_seq} - {ref_seq}), -2.5), 2.5)"
    return _sigmoid(f"{_logit(p)} + {adj}")


SCORED = f"""
scored AS (
  SELECT *, {blend_sql('p_sup', 's_if', 's_seq')} AS risk_score
  FROM (SELECT *,
          least(0.999, 0.55 * {H('a')} * {H('a')} + 0.42 * is_fraud
                       + CASE WHEN customer_age_band = '60+' THEN 0.05 ELSE 0.0 END) AS p_sup,
          {H('b')} AS s_if, {H('c')} AS s_seq
        FROM txn))"""

MCC_CASE = "CASE merchant_category " + " ".join(
    f"WHEN '{k}' THEN {float(v)}" for k, v in MCC_RISK_PRIOR.items()) + " ELSE 1.0 END"


def split_cte(src: str = "txn") -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (ORDER BY event_us, seq) - 1 AS global_rank,
         count(*) OVER () AS n_rows FROM {src}),
splitted AS (
  SELECT * EXCLUDE (n_rows),
    CASE WHEN global_rank < floor(CAST(n_rows AS DOUBLE) * 0.7) THEN 'train'
         WHEN global_rank < floor(CAST(n_rows AS DOUBLE) * (0.7 + 0.15)) THEN 'valid'
         ELSE 'test' END AS split
  FROM ranked)"""


PROFILE = """
prof_base AS (SELECT coalesce(avg(CAST(is_fraud AS DOUBLE)), 0.01) AS base_rate
              FROM splitted WHERE split = 'train'),
profile AS (
  SELECT merchant_id, sum(CAST(is_fraud AS DOUBLE)) AS fraud_count,
         CAST(count(*) AS DOUBLE) AS total_count,
         (sum(CAST(is_fraud AS DOUBLE)) + 50.0 * (SELECT base_rate FROM prof_base))
           / (count(*) + 50.0) AS merchant_risk
  FROM splitted WHERE split = 'train' GROUP BY merchant_id)"""


def card_feature_ctes(src: str = "txn", commit: str = "TRUE") -> str:
    """Per-card window form of F1-F28, tie-exact through (event_us, seq) list filters."""
    return f"""
fb AS (
  SELECT *, {commit} AS cmt,
    coalesce(merchant_country, 'US') AS country_key,
    coalesce(nullif(device_id, ''), 'unknown') AS device_key,
    CAST(merchant_id AS VARCHAR) AS merchant_key,
    (event_us % 86400000000) // 3600000000 AS hr,
    ((event_us // 86400000000) + 3) % 7 AS dow
  FROM {src}),
fw AS (
  SELECT *,
    list(CASE WHEN cmt THEN {{'us': event_us, 'sq': seq, 'a': amount, 'm': merchant_key,
                          'c': country_key, 'd': device_key}} END)
      OVER (PARTITION BY card_id ORDER BY event_us
            RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS win,
    sum(CASE WHEN cmt THEN 1 ELSE 0 END) OVER wall AS n,
    sum(CASE WHEN cmt THEN amount END) OVER wall AS s,
    sum(CASE WHEN cmt THEN amount * amount END) OVER wall AS ss,
    sum(CASE WHEN cmt THEN sin(radians(hr * 15)) END) OVER wall AS ssin,
    sum(CASE WHEN cmt THEN cos(radians(hr * 15)) END) OVER wall AS scos,
    max(CASE WHEN cmt THEN event_us END) OVER wall AS last_us,
    sum(CASE WHEN cmt THEN 1 ELSE 0 END) OVER (PARTITION BY card_id, merchant_key ORDER BY event_us, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_m,
    sum(CASE WHEN cmt THEN 1 ELSE 0 END) OVER (PARTITION BY card_id, device_key ORDER BY event_us, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_d,
    sum(CASE WHEN cmt THEN 1 ELSE 0 END) OVER (PARTITION BY card_id, country_key ORDER BY event_us, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_c
  FROM fb
  WINDOW wall AS (PARTITION BY card_id ORDER BY event_us, seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fh AS (
  SELECT *,
    list_filter(win, lambda e: e IS NOT NULL AND (e.us < event_us OR e.sq < seq)) AS h7,
    list_filter(win, lambda e: e IS NOT NULL AND (e.us < event_us OR e.sq < seq)
                               AND e.us >= event_us - 86400000000) AS h24,
    list_filter(win, lambda e: e IS NOT NULL AND (e.us < event_us OR e.sq < seq)
                               AND e.us >= event_us - 3600000000) AS h1,
    coalesce(n, 0) AS nn,
    s / nullif(n, 0) AS mean_amt
  FROM fw),
cf AS (
  SELECT *,
    CAST(amount AS DOUBLE) AS f_amount,
    ln(1 + amount) AS f_log_amount,
    CAST(hr AS DOUBLE) AS f_hour_of_day,
    CAST(dow AS DOUBLE) AS f_day_of_week,
    CASE WHEN hr < 6 OR hr >= 23 THEN 1.0 ELSE 0.0 END AS f_is_night,
    CASE WHEN dow >= 5 THEN 1.0 ELSE 0.0 END AS f_is_weekend,
    CASE WHEN channel = 'ecom' THEN 1.0 ELSE 0.0 END AS f_channel_is_ecom,
    CASE WHEN channel = 'atm' THEN 1.0 ELSE 0.0 END AS f_channel_is_atm,
    CASE WHEN entry_mode = 'swipe' THEN 1.0 ELSE 0.0 END AS f_entry_is_swipe,
    CASE WHEN entry_mode = 'keyed' THEN 1.0 ELSE 0.0 END AS f_entry_is_keyed,
    CASE WHEN country_key <> coalesce(issuer_country, 'US') THEN 1.0 ELSE 0.0 END AS f_is_cross_border,
    CASE WHEN nn >= 2 THEN least(greatest((amount - mean_amt)
            / sqrt(greatest(ss / nn - mean_amt * mean_amt, 1e-9)), -20.0), 20.0) ELSE 0.0 END
      AS f_amount_zscore_card,
    CASE WHEN nn >= 2 THEN least(greatest(amount / greatest(mean_amt, 1e-6), 0.0), 500.0) ELSE 1.0 END
      AS f_amount_ratio_card_mean,
    CASE WHEN nn >= 3 THEN least(
        abs(hr - ((degrees(atan2(ssin / nn, scos / nn)) % 360 + 360) % 360) / 15.0),
        24.0 - abs(hr - ((degrees(atan2(ssin / nn, scos / nn)) % 360 + 360) % 360) / 15.0))
      ELSE 0.0 END AS f_hour_deviation_card,
    CAST(len(h1) AS DOUBLE) AS f_card_txn_count_1h,
    CAST(len(h24) AS DOUBLE) AS f_card_txn_count_24h,
    CAST(len(h7) AS DOUBLE) AS f_card_txn_count_7d,
    coalesce(list_sum(list_transform(h1, lambda e: e.a)), 0.0) AS f_card_amount_sum_1h,
    coalesce(list_sum(list_transform(h24, lambda e: e.a)), 0.0) AS f_card_amount_sum_24h,
    coalesce(list_max(list_transform(h24, lambda e: e.a)), 0.0) AS f_card_amount_max_24h,
    CASE WHEN last_us IS NULL THEN 604800.0
         ELSE least((event_us - last_us) / 1e6, 604800.0) END AS f_card_seconds_since_last,
    CAST(len(list_distinct(list_transform(h24, lambda e: e.m))) AS DOUBLE) AS f_card_distinct_merchants_24h,
    CAST(len(list_distinct(list_transform(h7, lambda e: e.c))) AS DOUBLE) AS f_card_distinct_countries_7d,
    CAST(len(list_distinct(list_transform(h7, lambda e: e.d))) AS DOUBLE) AS f_card_distinct_devices_7d,
    CASE WHEN coalesce(seen_m, 0) = 0 THEN 1.0 ELSE 0.0 END AS f_is_new_merchant_for_card,
    CASE WHEN coalesce(seen_d, 0) = 0 THEN 1.0 ELSE 0.0 END AS f_is_new_device_for_card,
    CASE WHEN coalesce(seen_c, 0) = 0 THEN 1.0 ELSE 0.0 END AS f_is_new_country_for_card,
    least(nn, 7) AS history_len
  FROM fh),
cf2 AS (
  SELECT *,
    CASE WHEN f_card_amount_sum_24h > 0 THEN least(greatest(f_card_amount_sum_1h
         / greatest(f_card_amount_sum_24h / 24.0, 1e-6), 0.0), 500.0) ELSE 0.0 END
      AS f_card_velocity_ratio
  FROM cf)"""


def full_feature_ctes(commit: str = "TRUE") -> str:
    """txn -> split -> profile -> all 31 features in table ``fv``."""
    return split_cte("txn") + "," + PROFILE + "," + card_feature_ctes("txn", commit) + f""",
fv AS (
  SELECT cf2.*,
    coalesce(p.merchant_risk, (SELECT base_rate FROM prof_base)) AS f_merchant_risk_score,
    ln(1 + coalesce(p.total_count, 0.0)) AS f_merchant_log_volume,
    {MCC_CASE} AS f_mcc_risk_score
  FROM cf2 LEFT JOIN profile p USING (merchant_id))"""


def feature_select(names, prefix: str = "f_") -> str:
    return ", ".join(f"round({prefix}{n}, 6) AS {n}" for n in names)


ALL_FEATURES = list(FEATURE_NAMES)


def scored_feature_ctes() -> str:
    """Features (``fv``) plus pseudo-scores and the decision, in table ``dec``."""
    return full_feature_ctes() + f""",
sfv AS (
  SELECT *, {blend_sql('p_sup', 's_if', 's_seq')} AS risk_score
  FROM (SELECT *,
          least(0.999, 0.55 * {H('a')} * {H('a')} + 0.42 * is_fraud
                       + CASE WHEN customer_age_band = '60+' THEN 0.05 ELSE 0.0 END) AS p_sup,
          {H('b')} AS s_if, {H('c')} AS s_seq
        FROM fv)),
dec0 AS (
  SELECT *,
    CASE WHEN risk_score >= 0.86 THEN 'decline' WHEN risk_score >= 0.55 THEN 'review'
         WHEN risk_score >= 0.35 THEN 'step_up' ELSE 'approve' END AS base_action,
    coalesce(f_card_txn_count_1h >= 5 AND amount < 20, false) AS r1,
    coalesce(f_card_distinct_countries_7d >= 3 AND f_card_txn_count_1h >= 2, false) AS r2,
    coalesce(amount >= 2500 AND f_is_new_device_for_card = 1.0, false) AS r3,
    coalesce(f_entry_is_swipe = 1.0 AND f_is_cross_border = 1.0, false) AS r4
  FROM sfv),
dec AS (
  SELECT *,
    (['approve', 'step_up', 'review', 'decline'])[greatest(
        CASE base_action WHEN 'approve' THEN 0 WHEN 'step_up' THEN 1 WHEN 'review' THEN 2 ELSE 3 END,
        CASE WHEN r1 THEN 2 ELSE 0 END, CASE WHEN r2 THEN 2 ELSE 0 END,
        CASE WHEN r3 THEN 1 ELSE 0 END, CASE WHEN r4 THEN 2 ELSE 0 END) + 1] AS action,
    list_filter([CASE WHEN r1 THEN 'velocity.card_testing_burst' END,
                 CASE WHEN r2 THEN 'geo.multi_country_velocity' END,
                 CASE WHEN r3 THEN 'ato.high_value_new_device' END,
                 CASE WHEN r4 THEN 'counterfeit.cross_border_swipe' END], lambda v: v IS NOT NULL)
      AS triggered_rules
  FROM dec0)"""


CONTRIB_NAMES = ["amount", "card_txn_count_1h", "amount_zscore_card", "merchant_risk_score",
                 "is_new_device_for_card", "card_velocity_ratio", "mcc_risk_score",
                 "hour_deviation_card"]


def contrib_list() -> str:
    """List of {k: -|v|, i, name, value} for the binding's 8 pseudo-contributions."""
    items = []
    for i, n in enumerate(CONTRIB_NAMES):
        v = f"(({H(n)} - 0.5) * 4.0)"
        items.append(f"{{'k': -abs({v}), 'i': {i}, 'name': '{n}', 'value': {v}}}")
    return "[" + ", ".join(items) + "]"


def reason_text_case(expr: str) -> str:
    from cardlens.constants import REASON_TEXT
    whens = " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in REASON_TEXT.items())
    return f"CASE {expr} {whens} ELSE {expr} END"


def reasons_sql(lst: str, k: int = 4) -> str:
    return (f"array_to_string(list_transform(list_sort({lst})[1:{k}], lambda e: "
            f"printf('%s (%+.3f)', {reason_text_case('e.name')}, e.value)), ' | ')")


def snapshot_list() -> str:
    items = [f"{{'k': -abs(f_{n}), 'i': {i}, 'name': '{n}', 'value': f_{n}}}"
             for i, n in enumerate(FEATURE_NAMES)]
    return "[" + ", ".join(items) + "]"


def fixed_text(v: str, decimals: int) -> str:
    scale = 10 ** decimals
    q = f"CAST(floor(abs({v}) * {scale} + 0.5) AS BIGINT)"
    return (f"printf('%s%d.%0{decimals}d', CASE WHEN {v} < 0 AND {q} > 0 THEN '-' ELSE '' END, "
            f"{q} // {scale}, {q} % {scale})")


def split_feature_ctes() -> str:
    """Scored features with the time split: table ``fvs``."""
    return scored_feature_ctes() + """,
fvs AS (SELECT d.*, s.split FROM dec d JOIN splitted s USING (transaction_id))"""


def long_features(src: str = "fvs", names=None) -> str:
    names = list(names or FEATURE_NAMES)
    items = ", ".join(f"{{'feature': '{n}', 'value': round(CAST(f_{n} AS DOUBLE), 9)}}" for n in names)
    return f"""
flong AS (SELECT split, x.feature AS feature, x.value AS value
          FROM (SELECT split, unnest([{items}]) AS x FROM {src}))"""


def psi_ctes(long: str, bins: int, base_filter: str, cur_filter: str, prefix: str = "p") -> str:
    probs = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"""
{prefix}_bl AS (SELECT feature, value FROM {long} WHERE {base_filter} AND isfinite(value)),
{prefix}_cl AS (SELECT feature, value FROM {long} WHERE {cur_filter} AND isfinite(value)),
{prefix}_edges AS (
  SELECT feature, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS edges
  FROM {prefix}_bl GROUP BY feature),
{prefix}_e AS (
  SELECT feature, edges, len(edges) - 1 AS n_bins,
         CASE WHEN len(edges) > 2 THEN edges[2:len(edges) - 1] ELSE [] END AS inner_e
  FROM {prefix}_edges),
{prefix}_sides AS (SELECT feature, value, 'b' AS side FROM {prefix}_bl
                   UNION ALL SELECT feature, value, 'c' AS side FROM {prefix}_cl),
{prefix}_counts AS (
  SELECT s.feature, s.side, len(list_filter(e.inner_e, lambda x: x <= s.value)) AS bin, count(*) AS cnt
  FROM {prefix}_sides s JOIN {prefix}_e e USING (feature) GROUP BY ALL),
{prefix}_means AS (
  SELECT feature, count(*) FILTER (WHERE side = 'b') AS nb, count(*) FILTER (WHERE side = 'c') AS nc,
         avg(value) FILTER (WHERE side = 'b') AS b_rate, avg(value) FILTER (WHERE side = 'c') AS c_rate
  FROM {prefix}_sides GROUP BY feature),
{prefix}_grid AS (SELECT feature, n_bins, unnest(range(greatest(n_bins, 1))) AS bin FROM {prefix}_e),
{prefix}_full AS (
  SELECT g.feature, g.bin, g.n_bins AS k, coalesce(b.cnt, 0) AS b, coalesce(c.cnt, 0) AS c
  FROM {prefix}_grid g
  LEFT JOIN {prefix}_counts b ON b.feature = g.feature AND b.bin = g.bin AND b.side = 'b'
  LEFT JOIN {prefix}_counts c ON c.feature = g.feature AND c.bin = g.bin AND c.side = 'c'),
{prefix}_tot AS (SELECT feature, sum(b) AS tb, sum(c) AS tc FROM {prefix}_full GROUP BY feature),
{prefix}_binned AS (
  SELECT f.feature, sum((((c + 0.5) / (tc + 0.5 * k)) - ((b + 0.5) / (tb + 0.5 * k)))
                        * ln(((c + 0.5) / (tc + 0.5 * k)) / ((b + 0.5) / (tb + 0.5 * k)))) AS psi_bins
  FROM {prefix}_full f JOIN {prefix}_tot t USING (feature) GROUP BY f.feature),
{prefix}_psi AS (
  SELECT m.feature,
    CASE WHEN m.nb < 2 OR m.nc < 2 THEN 0.0
         WHEN len(e.edges) < 3 THEN abs(b_rate - c_rate) * ln(greatest(c_rate, 1e-6) / greatest(b_rate, 1e-6))
         ELSE bb.psi_bins END AS psi,
    abs(b_rate - c_rate) AS rate_shift_abs
  FROM {prefix}_means m LEFT JOIN {prefix}_e e USING (feature) LEFT JOIN {prefix}_binned bb USING (feature))"""


def status_sql(x: str) -> str:
    return f"CASE WHEN {x} < 0.1 THEN 'stable' WHEN {x} < 0.25 THEN 'monitor' ELSE 'investigate' END"


CURVE = """
cv_per AS (SELECT {score} AS score, count(*) FILTER (WHERE is_fraud = 1) AS tp,
                  count(*) FILTER (WHERE is_fraud <> 1) AS fp FROM scored GROUP BY 1),
cv AS (SELECT *, sum(tp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
              sum(fp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_fp,
              sum(tp) OVER () AS n_pos, sum(fp) OVER () AS n_neg FROM cv_per),
rank_m AS (
  SELECT sum(tp / n_pos * (cum_tp / (cum_tp + cum_fp))) AS pr_auc,
         sum(fp * (cum_tp - tp / 2.0) / (n_pos * n_neg)) AS roc_auc,
         coalesce(max(CASE WHEN cum_fp / n_neg <= 0.01 THEN cum_tp / n_pos END), 0.0) AS recall_at_1pct_fpr,
         coalesce(max(CASE WHEN cum_fp / n_neg <= 0.005 THEN cum_tp / n_pos END), 0.0) AS recall_at_0p5pct_fpr
  FROM cv)"""


def curve(score: str = "risk_score", tag: str = "") -> str:
    return CURVE.replace("{score}", score).replace("cv_per", f"cv_per{tag}").replace(
        "cv AS", f"cv{tag} AS").replace("FROM cv)", f"FROM cv{tag})").replace(
        "FROM cv_per)", f"FROM cv_per{tag})").replace("rank_m", f"rank_m{tag}")

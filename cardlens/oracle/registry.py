"""Oracle SQL per query name (DuckDB dialect)."""

from __future__ import annotations

from cardlens.constants import FEATURE_NAMES
from cardlens.oracle import ctes as C

SQL: dict[str, str] = {}


def _w(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


TXN_COLS = ("transaction_id, seq, event_us, card_id, customer_id, merchant_id, merchant_category, "
            "merchant_country, round(amount, 6) AS amount, currency, channel, entry_mode, device_id, "
            "issuer_country, customer_age_band, is_fraud")

SQL["scan_transactions"] = _w(C.TXN) + f"SELECT {TXN_COLS} FROM txn"

SQL["contract_violations"] = _w(C.TXN) + """
, chk AS (
  SELECT transaction_id, list_filter([
      CASE WHEN transaction_id IS NULL THEN 'missing:transaction_id' END,
      CASE WHEN event_us IS NULL THEN 'missing:event_us' END,
      CASE WHEN card_id IS NULL THEN 'missing:card_id' END,
      CASE WHEN customer_id IS NULL THEN 'missing:customer_id' END,
      CASE WHEN merchant_id IS NULL THEN 'missing:merchant_id' END,
      CASE WHEN merchant_category IS NULL THEN 'missing:merchant_category' END,
      CASE WHEN merchant_country IS NULL THEN 'missing:merchant_country' END,
      CASE WHEN amount IS NULL THEN 'missing:amount' END,
      CASE WHEN amount <= 0 THEN 'amount_not_positive' END,
      CASE WHEN coalesce(channel, 'pos') NOT IN ('pos', 'ecom', 'atm', 'moto') THEN 'bad_channel' END,
      CASE WHEN coalesce(entry_mode, 'chip') NOT IN ('chip', 'contactless', 'swipe', 'keyed', 'token')
           THEN 'bad_entry_mode' END], lambda v: v IS NOT NULL) AS v
  FROM txn)
SELECT transaction_id, len(v) = 0 AS valid, CAST(len(v) AS INTEGER) AS n_violations,
       array_to_string(v, ',') AS violations FROM chk"""

SQL["amount_band_counts"] = _w(C.TXN) + """
SELECT CASE WHEN amount < 25 THEN 'micro' WHEN amount < 100 THEN 'small' WHEN amount < 500 THEN 'medium'
            WHEN amount < 2500 THEN 'large' ELSE 'very_large' END AS amount_band,
       count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_fraud
FROM txn GROUP BY 1"""

_FEATS = {
    "feat_intrinsic": list(FEATURE_NAMES[:11]),
    "feat_amount_baseline": ["amount_zscore_card", "amount_ratio_card_mean"],
    "feat_hour_deviation": ["hour_deviation_card"],
    "feat_velocity_counts": ["card_txn_count_1h", "card_txn_count_24h", "card_txn_count_7d"],
    "feat_velocity_amounts": ["card_amount_sum_1h", "card_amount_sum_24h", "card_amount_max_24h",
                              "card_velocity_ratio"],
    "feat_recency": ["card_seconds_since_last"],
    "feat_diversity": ["card_distinct_merchants_24h", "card_distinct_countries_7d",
                       "card_distinct_devices_7d"],
    "feat_novelty": ["is_new_merchant_for_card", "is_new_device_for_card", "is_new_country_for_card"],
}
for _name, _cols in _FEATS.items():
    SQL[_name] = (_w(C.TXN, C.card_feature_ctes("txn")) +
                  f"SELECT transaction_id, {C.feature_select(_cols)} FROM cf2")

SQL["feat_counterparty"] = _w(C.TXN, C.full_feature_ctes()) + \
    "SELECT transaction_id, " + C.feature_select(
        ["merchant_risk_score", "merchant_log_volume", "mcc_risk_score"]) + " FROM fv"
SQL["feat_merchant_risk"] = _w(C.TXN, C.full_feature_ctes()) + \
    "SELECT transaction_id, " + C.feature_select(
        ["merchant_risk_score", "merchant_log_volume"]) + " FROM fv"
SQL["feature_vector"] = _w(C.TXN, C.full_feature_ctes()) + \
    "SELECT transaction_id, " + C.feature_select(FEATURE_NAMES) + " FROM fv"
SQL["feat_mcc_risk"] = _w(C.TXN) + f"SELECT transaction_id, {C.MCC_CASE} AS mcc_risk_score FROM txn"

SQL["merchant_profile"] = _w(C.TXN, C.split_cte("txn"), C.PROFILE) + """
SELECT merchant_id, round(fraud_count, 6) AS fraud_count, round(total_count, 6) AS total_count,
       round((SELECT base_rate FROM prof_base), 6) AS base_rate, round(merchant_risk, 6) AS merchant_risk
FROM profile"""

SQL["time_split"] = _w(C.TXN, C.split_cte("txn")) + \
    "SELECT transaction_id, CAST(global_rank AS BIGINT) AS global_rank, split FROM splitted"

SQL["training_rows"] = _w(C.TXN, C.split_cte("txn"), C.card_feature_ctes("txn")) + """
SELECT s.transaction_id, CAST(f.history_len AS INTEGER) AS history_len, f.history_len >= 2 AS for_sequence
FROM splitted s JOIN cf2 f USING (transaction_id)
WHERE s.split = 'train' AND s.is_fraud = 0"""

SQL["cold_cards"] = _w(C.TXN, C.card_feature_ctes("txn")) + """
SELECT transaction_id, CAST(history_len AS INTEGER) AS history_len,
       CASE WHEN history_len < 2 THEN 0.5 END AS neutral_sequence_score FROM cf2"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

SQL["blend_scores"] = _w(C.TXN, C.SCORED) + """
SELECT transaction_id, round(p_sup, 6) AS p_sup, round(s_if, 6) AS s_if, round(s_seq, 6) AS s_seq,
       round(risk_score, 6) AS risk_score FROM scored"""

SQL["base_actions"] = _w(C.TXN, C.SCORED) + """
SELECT transaction_id, round(risk_score, 6) AS risk_score,
  CASE WHEN risk_score >= 0.86 THEN 'decline' WHEN risk_score >= 0.55 THEN 'review'
       WHEN risk_score >= 0.35 THEN 'step_up' ELSE 'approve' END AS base_action FROM scored"""

SQL["decisions"] = _w(C.TXN, C.scored_feature_ctes()) + """
SELECT transaction_id, base_action, action, array_to_string(triggered_rules, ',') AS triggered_rules
FROM dec"""

SQL["reason_codes"] = _w(C.TXN) + f"""
SELECT transaction_id, {C.reasons_sql(C.contrib_list())} AS reasons FROM txn"""

SQL["decline_reasons"] = _w(C.TXN, C.scored_feature_ctes()) + f"""
SELECT transaction_id, action,
  CASE WHEN action = 'decline' THEN {C.reasons_sql(C.contrib_list())} ELSE '' END AS reasons FROM dec"""

SQL["alert_top_features"] = _w(C.TXN, C.scored_feature_ctes()) + f"""
SELECT transaction_id, action,
  array_to_string(list_transform(list_sort({C.snapshot_list()})[1:12],
                  lambda e: e.name || ' = ' || {C.fixed_text('e.value', 4)}), '; ') AS top_features
FROM dec WHERE action IN ('review', 'decline')"""

_OP_ROWS = " UNION ALL ".join(
    f"""SELECT {t} AS threshold, count(*) FILTER (WHERE risk_score >= {t} AND is_fraud = 1) AS tp,
       count(*) FILTER (WHERE risk_score >= {t} AND is_fraud <> 1) AS fp,
       count(*) FILTER (WHERE risk_score < {t} AND is_fraud = 1) AS fn,
       count(*) FILTER (WHERE risk_score < {t} AND is_fraud <> 1) AS tn,
       coalesce(sum(amount) FILTER (WHERE risk_score >= {t} AND is_fraud = 1), 0.0) AS v,
       count(*) AS n, coalesce(sum(amount) FILTER (WHERE is_fraud = 1), 0.0) AS fraud_value
     FROM scored""" for t in (0.35, 0.55, 0.70, 0.86))

SQL["operating_points"] = _w(C.TXN, C.SCORED) + f"""
SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn,
  round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall,
  round(fp / greatest(fp + tn, 1), 6) AS false_positive_rate,
  round(10000.0 * (tp + fp) / greatest(n, 1), 6) AS alerts_per_10k,
  round(v / CASE WHEN fraud_value = 0 THEN 1.0 ELSE fraud_value END, 6) AS value_recall
FROM ({_OP_ROWS})"""

_NB = """
nb AS (
  SELECT coalesce(sum(amount) FILTER (WHERE risk_score >= 0.86 AND is_fraud = 1), 0.0) AS dfv,
         coalesce(sum(amount) FILTER (WHERE is_fraud = 1), 0.0) AS fraud_value,
         count(*) FILTER (WHERE risk_score >= 0.86 AND is_fraud <> 1) AS false_declines,
         count(*) FILTER (WHERE risk_score >= 0.35 AND risk_score < 0.86) AS review_band
  FROM scored),
nb2 AS (
  SELECT dfv * 0.85 AS stopped_value, false_declines, review_band,
         dfv / CASE WHEN fraud_value = 0 THEN 1.0 ELSE fraud_value END AS value_detection_rate,
         dfv * 0.85 - false_declines * 12.0 - review_band * 4.5 AS estimated_loss_reduction
  FROM nb)"""

SQL["net_benefit"] = _w(C.TXN, C.SCORED, _NB) + """
SELECT round(stopped_value, 6) AS stopped_value, false_declines, review_band,
       round(value_detection_rate, 6) AS value_detection_rate,
       round(estimated_loss_reduction, 6) AS estimated_loss_reduction FROM nb2"""

SQL["pr_auc"] = _w(C.TXN, C.SCORED, C.curve()) + "SELECT round(pr_auc, 6) AS pr_auc FROM rank_m"
SQL["roc_auc"] = _w(C.TXN, C.SCORED, C.curve()) + "SELECT round(roc_auc, 6) AS roc_auc FROM rank_m"
SQL["recall_at_fpr"] = _w(C.TXN, C.SCORED, C.curve()) + """
SELECT round(recall_at_1pct_fpr, 6) AS recall_at_1pct_fpr,
       round(recall_at_0p5pct_fpr, 6) AS recall_at_0p5pct_fpr FROM rank_m"""

SQL["evaluation_summary"] = _w(C.TXN, C.SCORED, C.curve(), _NB) + """
SELECT count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, round(avg(CAST(is_fraud AS DOUBLE)), 6) AS prevalence,
  round((SELECT pr_auc FROM rank_m), 6) AS pr_auc, round((SELECT roc_auc FROM rank_m), 6) AS roc_auc,
  round((SELECT recall_at_1pct_fpr FROM rank_m), 6) AS recall_at_1pct_fpr,
  round((SELECT recall_at_0p5pct_fpr FROM rank_m), 6) AS recall_at_0p5pct_fpr,
  round((SELECT stopped_value FROM nb2), 6) AS stopped_value,
  (SELECT false_declines FROM nb2) AS false_declines, (SELECT review_band FROM nb2) AS review_band,
  round((SELECT value_detection_rate FROM nb2), 6) AS value_detection_rate,
  round((SELECT estimated_loss_reduction FROM nb2), 6) AS estimated_loss_reduction
FROM scored"""

_TEST_WINDOW = "FROM (SELECT * FROM {} WHERE split = 'test') GROUP BY 1)"
SQL["champion_gate"] = _w(C.TXN, C.SCORED, C.split_cte("scored"), C.curve("p_sup", "_ch"),
                          C.curve("risk_score", "_cp")).replace(
    "FROM scored GROUP BY 1)", _TEST_WINDOW.format("splitted")) + """
SELECT round(a.pr_auc, 6) AS challenger_pr_auc, round(b.pr_auc, 6) AS champion_pr_auc,
       a.pr_auc >= b.pr_auc + 0.01 AS passed
FROM rank_m_ch a, rank_m_cp b"""

SQL["class_weight"] = _w(C.TXN, C.split_cte("txn")) + """
SELECT count(*) FILTER (WHERE is_fraud = 1) AS n_pos, count(*) FILTER (WHERE is_fraud <> 1) AS n_neg,
  round(greatest((count(*) FILTER (WHERE is_fraud <> 1)) / greatest(count(*) FILTER (WHERE is_fraud = 1), 1), 1.0), 6)
    AS pos_weight
FROM splitted WHERE split = 'train'"""

SQL["feature_moments"] = _w(C.TXN, C.split_feature_ctes(), C.long_features()) + """
SELECT feature, round(avg(value), 6) AS mean,
       round(CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END, 6) AS std
FROM flong WHERE split = 'train' GROUP BY feature"""

_LEGIT_TRAIN = """
lt AS (SELECT * FROM scored JOIN (SELECT transaction_id, split FROM splitted) USING (transaction_id)
       WHERE split = 'train' AND is_fraud = 0)"""


def _bounds_sql(col: str, lo: float, hi: float, name: str) -> str:
    return f"""SELECT '{name}' AS detector, round(lo, 6) AS lo,
  round(CASE WHEN hi <= lo THEN lo + 1e-6 ELSE hi END, 6) AS hi
FROM (SELECT quantile_cont({col}, {lo}) AS lo, quantile_cont({col}, {hi}) AS hi FROM lt)"""


SQL["calibration_bounds"] = _w(C.TXN, C.SCORED, C.split_cte("txn"), _LEGIT_TRAIN) + \
    _bounds_sql("s_if", 0.01, 0.99, "iforest") + " UNION ALL " + \
    _bounds_sql("s_seq", 0.05, 0.995, "sequence")

SQL["calibrated_anomaly"] = _w(C.TXN, C.SCORED, C.split_cte("txn"), _LEGIT_TRAIN) + """
, b AS (SELECT quantile_cont(s_if, 0.01) AS lo, quantile_cont(s_if, 0.99) AS hi0 FROM lt),
b2 AS (SELECT lo, CASE WHEN hi0 <= lo THEN lo + 1e-6 ELSE hi0 END AS hi FROM b)
SELECT transaction_id, round(least(greatest((s_if - lo) / (hi - lo), 0.0), 1.0), 6) AS anomaly_score
FROM scored, b2"""

SQL["reference_medians"] = _w(C.TXN, C.SCORED, C.split_cte("txn")) + """
, v AS (SELECT * FROM scored JOIN (SELECT transaction_id, split FROM splitted) USING (transaction_id)
        WHERE split = 'valid' AND is_fraud = 0)
SELECT 'iforest' AS detector, round(quantile_cont(s_if, 0.5), 6) AS median FROM v
UNION ALL SELECT 'sequence' AS detector, round(quantile_cont(s_seq, 0.5), 6) AS median FROM v"""

SQL["global_importance"] = _w(C.TXN) + f"""
, long AS (SELECT x.name AS feature, x.value AS value FROM (SELECT unnest({C.contrib_list()}) AS x FROM txn)),
per AS (SELECT feature, avg(abs(value)) AS mean_abs FROM long GROUP BY feature)
SELECT feature, round(mean_abs / (SELECT CASE WHEN sum(mean_abs) = 0 THEN 1.0 ELSE sum(mean_abs) END FROM per), 6)
  AS importance FROM per"""

_SEG = """
seg AS (
  SELECT CAST(customer_age_band AS VARCHAR) AS segment, count(*) AS n,
    count(*) FILTER (WHERE is_fraud = 1) AS n_fraud,
    count(*) FILTER (WHERE risk_score >= 0.7) AS n_flagged,
    count(*) FILTER (WHERE risk_score >= 0.7 AND is_fraud = 1) AS tp,
    count(*) FILTER (WHERE risk_score >= 0.7 AND is_fraud <> 1) AS fp,
    avg(risk_score) AS mean_score
  FROM scored WHERE customer_age_band IS NOT NULL GROUP BY 1),
segm AS (
  SELECT segment, n, n_fraud, n_flagged, n_flagged / n AS selection_rate,
    CASE WHEN n_fraud >= 20 THEN tp / n_fraud END AS true_positive_rate,
    CASE WHEN n - n_fraud > 0 THEN fp / (n - n_fraud) ELSE 0.0 END AS false_positive_rate,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, mean_score, n >= 200 AS reliable
  FROM seg)"""

SQL["bias_segments"] = _w(C.TXN, C.SCORED, _SEG) + """
SELECT segment, n, n_fraud, n_flagged, round(selection_rate, 6) AS selection_rate,
  round(true_positive_rate, 6) AS true_positive_rate, round(false_positive_rate, 6) AS false_positive_rate,
  round(precision, 6) AS precision, round(mean_score, 6) AS mean_score, reliable FROM segm"""

_BIAS = """
bs AS (
  SELECT count(*) AS n_reliable, max(selection_rate) AS sel_max, min(selection_rate) AS sel_min,
    max(n_flagged) AS max_flagged, max(false_positive_rate) AS fpr_max, min(false_positive_rate) AS fpr_min,
    count(true_positive_rate) AS n_tpr, max(true_positive_rate) AS tpr_max, min(true_positive_rate) AS tpr_min
  FROM segm WHERE reliable),
bs2 AS (
  SELECT n_reliable, n_reliable >= 2 AS enough, n_reliable >= 2 AND max_flagged >= 20 AS ratio_ok, * FROM bs),
bs3 AS (
  SELECT n_reliable, enough, ratio_ok,
    CASE WHEN ratio_ok THEN sel_max / greatest(sel_min, 1e-9) ELSE 0.0 END AS selection_rate_disparity,
    CASE WHEN ratio_ok THEN sel_min / greatest(sel_max, 1e-9) ELSE 1.0 END AS adverse_impact_ratio,
    CASE WHEN enough THEN fpr_max - fpr_min ELSE 0.0 END AS fpr_gap,
    CASE WHEN enough AND n_tpr >= 2 THEN tpr_max - tpr_min ELSE 0.0 END AS tpr_gap
  FROM bs2),
bias AS (
  SELECT *,
    list_filter([
      CASE WHEN enough AND adverse_impact_ratio < 0.8 THEN 'adverse impact ratio ' || {air}
           || ' below the 0.8 four-fifths floor' END,
      CASE WHEN enough AND fpr_gap > 0.01 THEN 'false positive rate gap ' || {fg}
           || ' exceeds 0.01 - some segments are wrongly declined more often' END,
      CASE WHEN enough AND tpr_gap > 0.15 THEN 'true positive rate gap ' || {tg}
           || ' exceeds 0.15 - some segments receive less fraud protection' END],
      lambda v: v IS NOT NULL) AS flags,
    list_filter([
      CASE WHEN NOT enough THEN 'insufficient data: fewer than two segments meet the minimum size' END,
      CASE WHEN enough AND NOT ratio_ok THEN
        'selection-rate parity not assessed: no segment reaches 20 flagged transactions at this threshold' END],
      lambda v: v IS NOT NULL) AS notes
  FROM bs3)""".format(air=C.fixed_text("adverse_impact_ratio", 3), fg=C.fixed_text("fpr_gap", 4),
                      tg=C.fixed_text("tpr_gap", 4))

SQL["bias_summary"] = _w(C.TXN, C.SCORED, _SEG, _BIAS) + """
SELECT 0.7 AS threshold, n_reliable, round(selection_rate_disparity, 6) AS selection_rate_disparity,
  round(adverse_impact_ratio, 6) AS adverse_impact_ratio, round(fpr_gap, 6) AS fpr_gap,
  round(tpr_gap, 6) AS tpr_gap, array_to_string(flags, ' | ') AS flags,
  array_to_string(notes, ' | ') AS notes, len(flags) = 0 AS passed FROM bias"""

_DRIFT_BASE = [C.TXN, C.split_feature_ctes(), C.long_features(),
               C.psi_ctes("flong", 10, "split = 'train'", "split = 'test'")]

SQL["psi_edges"] = _w(*_DRIFT_BASE) + """
SELECT feature, CAST(i - 1 AS INTEGER) AS edge_idx, round(edges[i], 6) AS edge
FROM p_edges, range(1, len(edges) + 1) t(i)"""

SQL["feature_psi"] = _w(*_DRIFT_BASE) + """
SELECT feature, round(psi, 6) AS psi, round(rate_shift_abs, 6) AS rate_shift_abs FROM p_psi"""

_DRIFT = """
dmeans AS (SELECT feature, avg(value) FILTER (WHERE split = 'train') AS baseline_mean,
                  avg(value) FILTER (WHERE split = 'test') AS current_mean FROM flong GROUP BY feature),
drift AS (
  SELECT p.feature, p.psi, m.baseline_mean, m.current_mean,
    100.0 * (m.current_mean - m.baseline_mean) / greatest(abs(m.baseline_mean), 1e-9) AS mean_shift_pct,
    {st} AS status, p.rate_shift_abs
  FROM p_psi p JOIN dmeans m USING (feature))""".format(st=C.status_sql("p.psi"))

SQL["drift_report"] = _w(*_DRIFT_BASE, _DRIFT) + """
SELECT feature, round(psi, 6) AS psi, round(baseline_mean, 6) AS baseline_mean,
  round(current_mean, 6) AS current_mean, round(mean_shift_pct, 6) AS mean_shift_pct, status,
  round(rate_shift_abs, 6) AS rate_shift_abs FROM drift"""

_SCORE_LONG = """
slong AS (SELECT split, 'risk_score' AS feature, round(risk_score, 9) AS value FROM fvs)"""

SQL["score_psi"] = _w(C.TXN, C.split_feature_ctes(), _SCORE_LONG,
                      C.psi_ctes("slong", 20, "split = 'train'", "split = 'test'", "sp")) + f"""
SELECT round(psi, 6) AS psi, {C.status_sql('psi')} AS status FROM sp_psi"""

SQL["governance_findings"] = _w(
    *_DRIFT_BASE, _DRIFT, _SCORE_LONG,
    C.psi_ctes("slong", 20, "split = 'train'", "split = 'test'", "sp"),
    _SEG, _BIAS, C.curve("p_sup", "_ch"), C.curve("risk_score", "_cp")).replace(
        "FROM scored GROUP BY 1)", _TEST_WINDOW.format("fvs")).replace("FROM scored", "FROM sfv") + """
SELECT len(flags) = 0 AS fairness_passed, CAST(len(flags) AS INTEGER) AS fairness_flags,
  (SELECT count(*) FROM drift WHERE status = 'investigate') AS drift_flagged_features,
  (SELECT psi >= 0.25 FROM sp_psi) AS score_drift_investigate,
  (SELECT a.pr_auc >= b.pr_auc + 0.01 FROM rank_m_ch a, rank_m_cp b) AS gate_passed,
  (SELECT count(*) FROM drift WHERE status = 'investigate') = 0 AND NOT (SELECT psi >= 0.25 FROM sp_psi)
    AS drift_passed,
  len(flags) = 0 AND (SELECT count(*) FROM drift WHERE status = 'investigate') = 0
    AND NOT (SELECT psi >= 0.25 FROM sp_psi) AS passed
FROM bias"""

# ---------------------------------------------------------------- text guardrails
from cardlens.functions.text import (CASE_CLOSE_TAG, DECISION_CLAIM, INJECTION_PATTERNS,  # noqa: E402
                                     PAN_LEAK, REDACTIONS)


def _q(s: str) -> str:
    return s.replace("'", "''")


def _redact_sql(t: str) -> str:
    out = t
    for _, pat, rep, ic in REDACTIONS:
        out = f"regexp_replace({out}, '{_q(('(?i)' if ic else '') + pat)}', '{rep}', 'g')"
    return out


def _counts_sql(t: str) -> str:
    cur = t
    parts = []
    for kind, pat, rep, ic in REDACTIONS:
        p = _q(("(?i)" if ic else "") + pat)
        parts.append(f"CASE WHEN len(regexp_extract_all({cur}, '{p}')) > 0 THEN '{kind}:' || "
                     f"len(regexp_extract_all({cur}, '{p}')) END")
        cur = f"regexp_replace({cur}, '{p}', '{rep}', 'g')"
    return "concat_ws(',', " + ", ".join(parts) + ")"


def _flags_sql(t: str) -> str:
    parts = [f"CASE WHEN regexp_matches({t}, '{_q('(?i)' + p)}') THEN '{n}' END"
             for n, p in INJECTION_PATTERNS]
    return "concat_ws(',', " + ", ".join(parts) + ")"


SQL["redact_documents"] = f"SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents"
SQL["redaction_counts"] = f"SELECT doc_id, {_counts_sql('text')} AS redactions FROM documents"
SQL["injection_flags"] = f"SELECT doc_id, {_flags_sql('text')} AS flags FROM documents"
SQL["sanitize_documents"] = f"""
WITH s AS (SELECT doc_id, text, regexp_replace(text, '{_q('(?i)' + CASE_CLOSE_TAG)}', '[/case]', 'g') AS t
           FROM documents)
SELECT doc_id, t AS sanitized, {_flags_sql('text')} AS flags FROM s"""

_QUESTIONS = f"""
WITH q AS (SELECT conv_id, turn, text, {_redact_sql('text')} AS redacted, {_counts_sql('text')} AS redactions
           FROM conversations WHERE role = 'user'),
q2 AS (SELECT *, {_flags_sql('redacted')} AS injection_flags FROM q),
q3 AS (SELECT *, (injection_flags LIKE '%instruction_override%' OR injection_flags LIKE '%system_prompt_probe%')
                   AS blocked FROM q2)
"""

SQL["guard_questions"] = _QUESTIONS + """
SELECT conv_id, turn, redacted, redactions, injection_flags, blocked,
  CASE WHEN blocked THEN 'question contains prompt-injection patterns' END AS block_reason FROM q3"""

SQL["guard_log"] = _QUESTIONS + """
SELECT CAST(conv_id AS VARCHAR) AS case_id, turn, CAST(length(text) AS INTEGER) AS question_length, redactions,
  injection_flags, blocked, CASE WHEN blocked THEN 'question contains prompt-injection patterns' END AS block_reason,
  'investigation-assistant' AS model FROM q3"""

SQL["validate_answers"] = f"""
WITH a AS (SELECT conv_id, turn,
  CASE WHEN regexp_matches(text, '{_q(PAN_LEAK)}') THEN 'response contained something matching a card number'
       WHEN regexp_matches(text, '{_q('(?i)' + DECISION_CLAIM)}')
         THEN 'response claimed to have taken an action the assistant cannot take' END AS block_reason
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, block_reason IS NOT NULL AS blocked, block_reason FROM a"""

SQL["pseudonyms"] = _w(C.TXN) + """
SELECT card_id, substring(sha256('local-development-salt:' || card_id), 1, 32) AS card_hash
FROM (SELECT DISTINCT card_id FROM txn)"""

# ---------------------------------------------------------------- case library


def _money(v: str) -> str:
    c = f"CAST(floor(abs({v}) * 100 + 0.5) AS BIGINT)"
    return (f"(CASE WHEN {v} < 0 AND {c} > 0 THEN '-' ELSE '' END || format('{{:,}}', {c} // 100) || '.' "
            f"|| lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))")


_NARR = f"""
cbase AS (
  SELECT *, CASE WHEN action = 'decline' THEN list_transform(list_sort({C.contrib_list()})[1:4],
              lambda e: printf('%s (%+.3f)', {C.reason_text_case('e.name')}, e.value)) ELSE [] END AS reasons,
    CASE WHEN is_fraud = 1 THEN 'confirmed_fraud' WHEN is_fraud = 0 THEN 'legitimate' ELSE 'unknown' END AS disp,
    list_filter([
      CASE WHEN coalesce(f_is_cross_border <> 0, false) THEN 'cross-border' END,
      CASE WHEN coalesce(f_entry_is_swipe <> 0, false) THEN 'magnetic stripe entry on a chip-capable card' END,
      CASE WHEN coalesce(f_is_new_device_for_card <> 0, false) THEN 'device not previously seen on this card' END,
      CASE WHEN coalesce(f_is_new_country_for_card <> 0, false) THEN 'country not previously seen on this card' END,
      CASE WHEN f_card_txn_count_1h >= 4 THEN CAST(CAST(f_card_txn_count_1h AS BIGINT) AS VARCHAR)
           || ' transactions in the preceding hour' END,
      CASE WHEN f_amount_ratio_card_mean >= 4 THEN 'amount ' || {C.fixed_text('f_amount_ratio_card_mean', 1)}
           || 'x the card''s average' END,
      CASE WHEN f_merchant_risk_score > 0.02 THEN 'merchant with an elevated historical fraud rate' END,
      CASE WHEN coalesce(f_is_night <> 0, false) THEN 'outside the cardholder''s usual hours' END],
      lambda v: v IS NOT NULL) AS signals
  FROM dec),
cdocs0 AS (
  SELECT transaction_id AS case_id, is_fraud, action, reasons, merchant_category, channel, entry_mode,
    merchant_country, amount, disp AS disposition,
    'Transaction of ' || coalesce(currency, 'USD') || ' ' || {_money('amount')} || ' at a '
      || coalesce(merchant_category, 'unknown') || ' merchant in ' || coalesce(merchant_country, 'unknown')
      || '. Channel ' || coalesce(channel, 'None') || ', entry mode ' || coalesce(entry_mode, 'None') || '.'
      || CASE WHEN len(signals) > 0 THEN ' Observed signals: ' || array_to_string(signals, '; ') || '.' ELSE '' END
      || CASE WHEN is_fraud IS NOT NULL THEN ' Disposition: ' || disp || '.' ELSE '' END AS raw_text
  FROM cbase),
cdocs AS (SELECT * EXCLUDE (raw_text), {_redact_sql('raw_text')} AS text FROM cdocs0),
lib_f AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('17', case_id))) AS rn
                         FROM cdocs WHERE is_fraud = 1) WHERE rn <= 2000),
lib_l AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('17', case_id))) AS rn
                         FROM cdocs WHERE is_fraud = 0) WHERE rn <= 4000 - (SELECT count(*) FROM lib_f)),
picked AS (SELECT * EXCLUDE (rn) FROM lib_f UNION ALL SELECT * EXCLUDE (rn) FROM lib_l),
lib AS (SELECT * FROM cdocs),
aq AS (
  SELECT case_id AS query_id,
    array_to_string(list_filter(list_concat([coalesce(merchant_category, ''), coalesce(channel, ''),
      coalesce(entry_mode, ''), coalesce(merchant_country, ''), 'amount_band_' ||
      CASE WHEN amount < 25 THEN 'micro' WHEN amount < 100 THEN 'small' WHEN amount < 500 THEN 'medium'
           WHEN amount < 2500 THEN 'large' ELSE 'very_large' END], reasons), lambda s: s <> ''), ' ') AS query_text
  FROM cdocs WHERE action = 'decline')"""

_CASES = _w(C.TXN, C.scored_feature_ctes(), _NARR)


def _emb(src: str, idc: str, textc: str, name: str) -> str:
    return f"""
{name}_t AS (SELECT {idc} AS id, lower(trim(regexp_replace({textc}, '\\s+', ' ', 'g'))) AS t FROM {src}),
{name}_g AS (SELECT id, substring(t, i, 4) AS g
             FROM (SELECT id, t, unnest(range(1, greatest(1, length(t) - 3) + 1)) AS i FROM {name}_t
                   WHERE length(t) > 0)),
{name}_c AS (
  SELECT id, CAST(('0x' || substring(md5(g), 1, 8))::BIGINT % 512 AS INTEGER) AS slot,
         CAST(sum(CASE WHEN ('0x' || substring(md5(g), 9, 1))::INTEGER < 8 THEN 1 ELSE -1 END) AS INTEGER) AS count
  FROM {name}_g GROUP BY ALL HAVING sum(CASE WHEN ('0x' || substring(md5(g), 9, 1))::INTEGER < 8 THEN 1 ELSE -1 END) <> 0),
{name}_n AS (SELECT {idc} AS id, coalesce((SELECT sqrt(sum(count * count)) FROM {name}_c c WHERE c.id = s.{idc}), 0.0)
             AS norm FROM {src} s)"""


def _topk_sql(filter_sql: str = "TRUE") -> str:
    return (_emb(f"(SELECT * FROM lib WHERE {filter_sql})", "case_id", "text", "d") + "," +
            _emb("aq", "query_id", "query_text", "q") + """,
dots AS (SELECT q.id AS query_id, d.id AS case_id, sum(q.count * d.count) AS dot
         FROM q_c q JOIN d_c d USING (slot) GROUP BY ALL),
pairs AS (
  SELECT qn.id AS query_id, dn.id AS case_id,
    round(CASE WHEN dn.norm * qn.norm > 0 THEN coalesce(dt.dot, 0) / (dn.norm * qn.norm) ELSE 0.0 END, 9) AS score
  FROM q_n qn CROSS JOIN d_n dn LEFT JOIN dots dt ON dt.query_id = qn.id AND dt.case_id = dn.id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank
                        FROM pairs) WHERE rank <= 6)""")


SQL["case_narratives"] = _CASES + "SELECT case_id, text, disposition FROM cdocs"
SQL["case_sample"] = _CASES + "SELECT case_id, disposition FROM picked"
SQL["pattern_queries"] = _CASES + "SELECT query_id, query_text FROM aq"
SQL["ngram_embedding"] = _CASES + "," + _emb("lib", "case_id", "text", "d") + """
SELECT c.id AS case_id, c.slot, c.count, round(c.count / n.norm, 6) AS weight
FROM d_c c JOIN d_n n USING (id)"""
SQL["similar_cases"] = _CASES + "," + _topk_sql() + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, case_id, round(score, 6) AS score FROM hits"""
SQL["similar_cases_filtered"] = _CASES + "," + _topk_sql("disposition = 'confirmed_fraud'") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, case_id, round(score, 6) AS score FROM hits"""
SQL["case_upsert"] = _CASES + """
SELECT case_id, text, 'library' AS origin FROM lib WHERE case_id NOT IN (SELECT case_id FROM cdocs WHERE action = 'decline')
UNION ALL SELECT case_id, text, 'update' AS origin FROM cdocs WHERE action = 'decline'"""
SQL["investigation_packets"] = _CASES + "," + _topk_sql() + f""",
blocks AS (
  SELECT h.query_id, h.rank,
    '<case id="' || h.case_id || '" similarity="' || {C.fixed_text('h.score', 3)} || '" disposition="'
      || coalesce(l.disposition, 'unknown') || '">' || chr(10)
      || regexp_replace(l.text, '(?i)</\\s*case\\s*>', '[/case]', 'g')
      || chr(10) || '</case>' AS block,
    {_flags_sql('l.text')} AS fl
  FROM hits h JOIN lib l USING (case_id)),
pk AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS cases_block,
              string_agg(CASE WHEN fl <> '' THEN fl END, ',' ORDER BY rank) AS flags, count(*) AS n_cases
       FROM blocks GROUP BY query_id)
SELECT a.query_id AS case_id, coalesce(pk.cases_block, '<case>No comparable historical cases found.</case>')
  AS cases_block, coalesce(pk.flags, '') AS flags, CAST(coalesce(pk.n_cases, 0) AS INTEGER) AS n_cases
FROM aq a LEFT JOIN pk USING (query_id)"""
SQL["retrieval_only"] = _CASES + "," + _topk_sql() + """
, ids AS (SELECT query_id, string_agg(case_id, ',' ORDER BY rank) AS retrieved_case_ids FROM hits GROUP BY query_id)
SELECT a.query_id AS case_id,
  'Assistant unavailable for this case: no narrative model configured for batch runs. Retrieved case IDs are still listed for manual review.' AS summary,
  coalesce(ids.retrieved_case_ids, '') AS retrieved_case_ids, 'Review the retrieved cases manually.' AS recommended_checks,
  'low' AS confidence, 'automated narrative not generated' AS evidence_gaps, true AS blocked
FROM aq a LEFT JOIN ids USING (query_id)"""

# conversations hold no objects inside other text; a whole JSON text is read, any other is the summary
SQL["parse_answers"] = """
WITH a AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t
           FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '```')
        THEN regexp_replace(regexp_extract(t, '(?s)^```(?:json)?(.*?)(?:```.*)?$', 1), '^\\s+|\\s+$', '', 'g')
        ELSE t END AS body FROM a),
p AS (SELECT *, starts_with(body, '{') AND json_valid(body) AS parsed FROM b)
SELECT conv_id, turn, parsed,
  CASE WHEN parsed THEN coalesce(json_extract_string(body, '$.summary'), '') ELSE body END AS summary,
  CASE WHEN parsed THEN coalesce(json_extract_string(body, '$.confidence'), 'low') ELSE 'low' END AS confidence
FROM p"""

SQL["cosine_topk"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vn AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id,
            round(CASE WHEN b.norm * a.norm > 0 THEN list_dot_product(a.e, b.e) / (b.norm * a.norm) ELSE 0.0 END, 9)
              AS score
          FROM vn a JOIN vn b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, CAST(neighbor_id AS VARCHAR)) AS rank
      FROM pairs)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(score, 6) AS score FROM r WHERE rank <= 6"""

# ---------------------------------------------------------------- audit log
def _lp(v: str) -> str:
    """A value with its length; null as ``-``."""
    return f"coalesce(length({v}) || ':' || {v}, '-')"


def _lps(v: str) -> str:
    return f"'[' || len({v}) || ']' || array_to_string(list_transform({v}, lambda x: {_lp('x')}), '')"


_SNAP_TXT = " || '|' || ".join(
    f"'{n}=' || {C.fixed_text(f'round(f_{n}, 6)', 6)}" for n in FEATURE_NAMES)
_SNAP_PARTS = " || ".join(_lp(C.fixed_text(f"round(f_{n}, 6)", 6)) for n in FEATURE_NAMES)
_SCORES = {"risk_score": "risk_score", "supervised_score": "p_sup", "anomaly_score": "s_if",
           "sequence_score": "s_seq"}

_AUDIT = f"""
ap AS (
  SELECT strftime(make_timestamp(event_us), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp, transaction_id, seq,
    card_hash,
    'pseudo-scores-v1' AS model_version, action,
    {", ".join(f"round({v}, 6) AS {k}" for k, v in _SCORES.items())},
    CASE WHEN action = 'decline' THEN list_transform(list_sort({C.contrib_list()})[1:4],
      lambda e: printf('%s (%+.3f)', {C.reason_text_case('e.name')}, e.value)) ELSE [] END AS reasons,
    triggered_rules, {_SNAP_TXT} AS snap, {_SNAP_PARTS} AS snap_parts,
    card_hash || '-' || CAST(event_us // 2419200000000 AS VARCHAR) AS chain_id
  FROM (SELECT *, substring(sha256('local-development-salt:' || card_id), 1, 32) AS card_hash FROM dec)),
aph AS (SELECT *, sha256({{canon}}) AS payload_hash FROM ap)"""

_CANON = " || ".join([_lp("chain_id"), _lp("CAST(seq AS VARCHAR)"),
                      *(_lp(c) for c in ("timestamp", "transaction_id", "card_hash", "model_version", "action")),
                      *(_lp(C.fixed_text(k, 6)) for k in _SCORES),
                      _lps("reasons"), _lps("triggered_rules"), "snap_parts"])
_AUDIT = _AUDIT.replace("{canon}", _CANON)

_CHAIN = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY seq) AS pos FROM aph),
chain AS (
  WITH RECURSIVE ch(chain_id, pos, prev_hash, record_hash) AS (
    SELECT chain_id, pos, repeat('0', 64), sha256(repeat('0', 64) || ':1:' || payload_hash) FROM ordered WHERE pos = 1
    UNION ALL
    SELECT o.chain_id, o.pos, c.record_hash, sha256(c.record_hash || ':' || o.pos || ':' || o.payload_hash)
    FROM ch c JOIN ordered o ON o.chain_id = c.chain_id AND o.pos = c.pos + 1)
  SELECT o.*, ch.prev_hash, ch.record_hash FROM ordered o JOIN ch USING (chain_id, pos))"""

SQL["audit_records"] = _w(C.TXN, C.scored_feature_ctes(), _AUDIT) + """
SELECT timestamp, transaction_id, card_hash, model_version, action, risk_score, supervised_score,
  anomaly_score, sequence_score, array_to_string(reasons, ' | ') AS reason_codes,
  array_to_string(triggered_rules, ',') AS triggered_rules, snap AS feature_snapshot FROM aph"""
SQL["audit_hash"] = _w(C.TXN, C.scored_feature_ctes(), _AUDIT) + \
    "SELECT transaction_id, chain_id, payload_hash FROM aph"
SQL["audit_chain"] = _w(C.TXN, C.scored_feature_ctes(), _AUDIT, _CHAIN) + \
    "SELECT chain_id, seq, transaction_id, prev_hash, record_hash FROM chain"

SQL["audit_chain_breaks"] = _w(C.TXN, C.scored_feature_ctes(), _AUDIT, _CHAIN) + f"""
, t0 AS (SELECT * REPLACE (CASE WHEN seq = 1000 THEN CASE WHEN action = 'approve' THEN 'decline' ELSE 'approve' END
                                ELSE action END AS action)
         FROM chain WHERE seq <> 2000),
t AS (SELECT *, sha256(prev_hash || ':' || pos || ':' || sha256({_CANON})) AS expected FROM t0),
brk AS (
  SELECT chain_id, seq, transaction_id FROM t WHERE expected <> record_hash
  UNION ALL
  SELECT a.chain_id, a.seq, a.transaction_id FROM t a LEFT JOIN t p ON p.chain_id = a.chain_id AND p.pos = a.pos - 1
  WHERE (a.pos = 1 AND a.prev_hash <> repeat('0', 64))
     OR (a.pos > 1 AND (p.record_hash IS NULL OR p.record_hash <> a.prev_hash))
  UNION ALL
  SELECT a.chain_id, a.seq, a.transaction_id FROM t a JOIN t p ON p.chain_id = a.chain_id AND p.pos = a.pos - 1
  WHERE p.seq >= a.seq
  UNION ALL
  SELECT chain_id, max(seq), NULL FROM chain c GROUP BY chain_id
  HAVING max(pos) > coalesce((SELECT max(pos) FROM t WHERE t.chain_id = c.chain_id), 0))
SELECT chain_id, arg_min(transaction_id, seq) AS first_broken_transaction_id, min(seq) AS first_broken_seq,
       count(*) AS n_broken FROM brk GROUP BY chain_id"""

# ---------------------------------------------------------------- point in time / latest / quotes
SQL["pit_join"] = """
WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
f AS (SELECT event_id AS feature_event_id, user_id, epoch_us(ts) AS fus, value FROM events WHERE event_type = 'view'),
j AS (SELECT l.*, f.feature_event_id, f.fus, f.value FROM l ASOF LEFT JOIN f ON l.user_id = f.user_id AND l.us >= f.fus)
SELECT event_id, user_id,
  CAST(CASE WHEN fus >= us - 90000000000 THEN feature_event_id END AS VARCHAR) AS feature_event_id,
  CASE WHEN fus >= us - 90000000000 THEN round(value, 6) END AS feature_value,
  CASE WHEN fus >= us - 90000000000 THEN round((us - fus) / 1e6, 6) END AS feature_age_s
FROM j"""

SQL["latest_card_features"] = _w(C.TXN, C.full_feature_ctes()) + f"""
SELECT card_id, transaction_id, event_us, {C.feature_select(FEATURE_NAMES)}
FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY event_us DESC, seq DESC) AS rn FROM fv)
WHERE rn = 1"""

SQL["quote_features"] = _w(C.TXN, C.card_feature_ctes("txn", "seq % 19 <> 0")) + f"""
SELECT transaction_id, cmt AS commit, CAST(history_len AS INTEGER) AS history_len,
  {C.feature_select(list(FEATURE_NAMES[11:28]))} FROM cf2"""

SQL["decisions_by_hour"] = _w(C.TXN, C.scored_feature_ctes()) + """
SELECT (event_us // 3600000000) * 3600000000 AS hour_start_us, action, count(*) AS n FROM dec GROUP BY ALL"""

SQL["sequence_window"] = _w(C.TXN) + f"""
, sw AS (SELECT transaction_id, amount,
    list(transaction_id) OVER w AS ids, list(amount) OVER w AS amts
  FROM txn WINDOW w AS (PARTITION BY card_id ORDER BY event_us, seq ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT transaction_id, CAST(len(coalesce(ids, [])) AS INTEGER) AS n_history,
  array_to_string(coalesce(ids, []), ',') AS window_ids,
  array_to_string(list_transform(list_concat(list_resize([]::DOUBLE[], 7 - len(coalesce(amts, [])), 0.0),
    coalesce(amts, []), [amount]), lambda v: {C.fixed_text('v', 6)}), ',') AS window_amounts
FROM sw"""

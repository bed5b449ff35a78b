"""Constants that define query results.

FIXED VALUES — these must equal the values of the system we reproduce so that
results agree; they are stated here once, in natural order, and everything
else reads them from here.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Time
HOUR_US = 3_600 * 1_000_000
DAY_US = 86_400 * 1_000_000
WEEK_US = 7 * DAY_US

# Merchant target encoding prior strength
MERCHANT_PRIOR_WEIGHT = 50.0

# Category risk prior (default 1.0 for anything not listed)
MCC_RISK_PRIOR = {
    "grocery": 0.2, "fuel": 0.5, "restaurant": 0.3, "electronics": 1.6,
    "travel": 1.2, "apparel": 0.7, "digital_goods": 2.2, "pharmacy": 0.4,
    "gambling": 3.0, "money_transfer": 3.4,
}
MCC_DEFAULT_RISK = 1.0

# The 31 model features, in model order
FEATURE_NAMES: tuple[str, ...] = (
    "amount",
    "log_amount",
    "hour_of_day",
    "day_of_week",
    "is_night",
    "is_weekend",
    "channel_is_ecom",
    "channel_is_atm",
    "entry_is_swipe",
    "entry_is_keyed",
    "is_cross_border",
    "amount_zscore_card",
    "amount_ratio_card_mean",
    "hour_deviation_card",
    "card_txn_count_1h",
    "card_txn_count_24h",
    "card_txn_count_7d",
    "card_amount_sum_1h",
    "card_amount_sum_24h",
    "card_amount_max_24h",
    "card_seconds_since_last",
    "card_velocity_ratio",
    "card_distinct_merchants_24h",
    "card_distinct_countries_7d",
    "card_distinct_devices_7d",
    "is_new_merchant_for_card",
    "is_new_device_for_card",
    "is_new_country_for_card",
    "merchant_risk_score",
    "merchant_log_volume",
    "mcc_risk_score",
)

# Columns that must never reach a model
PROTECTED_ATTRIBUTES = frozenset({"customer_age_band"})
IDENTIFIER_COLUMNS = frozenset(
    {"transaction_id", "card_id", "customer_id", "merchant_id", "device_id", "ip_prefix"})

# Transaction contract
CHANNELS = ("pos", "ecom", "atm", "moto")
ENTRY_MODES = ("chip", "contactless", "swipe", "keyed", "token")

# Decision thresholds and rule constant
DECLINE_AT = 0.86
REVIEW_AT = 0.55
STEP_UP_AT = 0.35
HIGH_VALUE_AMOUNT = 2500.0
ACTION_RANK = {"approve": 0, "step_up": 1, "review": 2, "decline": 3}

# Blend
IFOREST_LOGIT_WEIGHT = 1.6
SEQUENCE_LOGIT_WEIGHT = 1.1
MAX_LOGIT_ADJUSTMENT = 2.5
LOGIT_EPS = 1e-6
SIGMOID_CLIP = 30.0

# Evaluation
EVAL_THRESHOLDS = (0.35, 0.55, 0.70, 0.86)
RECOVERY_RATE = 0.85
REVIEW_COST = 4.50
FALSE_DECLINE_COST = 12.0

# Fairness
MIN_SEGMENT_SIZE = 200
MIN_POSITIVES_FOR_TPR = 20
MIN_SELECTED_FOR_RATIO = 20
ADVERSE_IMPACT_RATIO_FLOOR = 0.8
MAX_FPR_GAP = 0.01
MAX_TPR_GAP = 0.15

# Drift
PSI_STABLE = 0.10
PSI_INVESTIGATE = 0.25

# Champion/challenger gate
CHAMPION_MIN_GAIN = 0.01

# Audit
GENESIS_HASH = "0" * 64
DEFAULT_AUDIT_SALT = "local-development-salt"

# Retrieval
EMBEDDING_DIM = 512
NGRAM = 4
TOP_K = 6
SANITIZE_MAX_CHARS = 4000
SEED = 17
CASE_MAX = 4000
CASE_FRAUD_SHARE = 0.5

# Amount bands: (upper bound exclusive, name), then the top band
AMOUNT_BANDS = ((25, "micro"), (100, "small"), (500, "medium"), (2500, "large"))
AMOUNT_BAND_TOP = "very_large"

# Case dispositions
DISPOSITIONS = {1: "confirmed_fraud", 0: "legitimate"}

# Reason text per feature (unknown names pass through unchanged)
REASON_TEXT = {
    "amount": "transaction amount",
    "log_amount": "transaction amount",
    "amount_zscore_card": "amount unusual for this card",
    "amount_ratio_card_mean": "amount far above this card's average",
    "card_txn_count_1h": "high transaction count in the last hour",
    "card_txn_count_24h": "high transaction count in the last 24 hours",
    "card_amount_sum_1h": "high spend in the last hour",
    "card_amount_sum_24h": "high spend in the last 24 hours",
    "card_velocity_ratio": "spend rate above this card's norm",
    "card_seconds_since_last": "unusually short gap since the previous transaction",
    "card_distinct_merchants_24h": "many distinct merchants in 24 hours",
    "card_distinct_countries_7d": "transactions across several countries",
    "card_distinct_devices_7d": "several devices used recently",
    "is_new_merchant_for_card": "first transaction with this merchant",
    "is_new_device_for_card": "device not seen before on this card",
    "is_new_country_for_card": "country not seen before on this card",
    "is_cross_border": "cross-border transaction",
    "merchant_risk_score": "elevated historical fraud rate at this merchant",
    "merchant_log_volume": "low-volume merchant",
    "mcc_risk_score": "high-risk merchant category",
    "entry_is_swipe": "magnetic-stripe entry",
    "entry_is_keyed": "manually keyed card number",
    "channel_is_ecom": "card-not-present transaction",
    "channel_is_atm": "ATM withdrawal",
    "is_night": "transaction outside typical hours",
    "hour_deviation_card": "time of day unusual for this card",
    "hour_of_day": "time of day",
    "day_of_week": "day of week",
    "is_weekend": "weekend transaction",
    "card_amount_max_24h": "large maximum transaction in 24 hours",
    "card_txn_count_7d": "transaction count over 7 days",
}

# Rule names, in evaluation order
RULE_CARD_TESTING = "velocity.card_testing_burst"
RULE_MULTI_COUNTRY = "geo.multi_country_velocity"
RULE_HIGH_VALUE_NEW_DEVICE = "ato.high_value_new_device"
RULE_CROSS_BORDER_SWIPE = "counterfeit.cross_border_swipe"

# Guard messages
BLOCK_QUESTION = "question contains prompt-injection patterns"
BLOCK_PAN = "response contained something matching a card number"
BLOCK_CLAIM = "response claimed to have taken an action the assistant cannot take"
NO_CASES_TEXT = "<case>No comparable historical cases found.</case>"
TRUNCATION_MARKER = "\n[...truncated]"

# Fairness / drift report texts
NOTE_FEW_SEGMENTS = "insufficient data: fewer than two segments meet the minimum size"
# ------------------------------------------------------------ END FIXED VALUES

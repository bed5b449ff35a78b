"""Plain-Python replay of the card features: the second implementation the
Spark windows are tested against.  Rows are processed one at a time in
(event_us, seq) order; each row reads the state left by committed rows."""

from __future__ import annotations

import math
from collections import defaultdict

HOUR, DAY, WEEK = 3_600_000_000, 86_400_000_000, 7 * 86_400_000_000


def replay(rows: list[dict]) -> dict[str, dict[str, float]]:
    rows = sorted(rows, key=lambda r: (r["event_us"], r["seq"]))
    hist: dict[str, list[dict]] = defaultdict(list)
    out = {}
    for r in rows:
        h = hist[r["card_id"]]
        us, amt = r["event_us"], r["amount"]
        country = r.get("merchant_country") or "US"
        device = r.get("device_id") or "unknown"
        hour = (us % DAY) // HOUR
        dow = (us // DAY + 3) % 7
        win7 = [e for e in h if us - e["us"] <= WEEK]
        win24 = [e for e in win7 if us - e["us"] <= DAY]
        win1 = [e for e in win24 if us - e["us"] <= HOUR]
        n = len(h)
        s = sum(e["a"] for e in h)
        ss = sum(e["a"] * e["a"] for e in h)
        if n >= 2:
            mean = s / n
            var = max(ss / n - mean * mean, 1e-9)
            z = min(max((amt - mean) / math.sqrt(var), -20.0), 20.0)
            ratio = min(max(amt / max(mean, 1e-6), 0.0), 500.0)
        else:
            z, ratio = 0.0, 1.0
        if n >= 3:
            sn = sum(math.sin(math.radians(e["h"] * 15)) for e in h) / n
            cs = sum(math.cos(math.radians(e["h"] * 15)) for e in h) / n
            mh = (math.degrees(math.atan2(sn, cs)) % 360) / 15.0
            d = abs(hour - mh)
            hdev = min(d, 24.0 - d)
        else:
            hdev = 0.0
        s1 = sum(e["a"] for e in win1)
        s24 = sum(e["a"] for e in win24)
        last = max((e["us"] for e in h), default=None)
        secs = WEEK / 1e6 if last is None else min((us - last) / 1e6, WEEK / 1e6)
        vel = min(max(s1 / max(s24 / 24.0, 1e-6), 0.0), 500.0) if s24 > 0 else 0.0
        out[r["transaction_id"]] = {
            "amount_zscore_card": z, "amount_ratio_card_mean": ratio, "hour_deviation_card": hdev,
            "card_txn_count_1h": float(len(win1)), "card_txn_count_24h": float(len(win24)),
            "card_txn_count_7d": float(len(win7)), "card_amount_sum_1h": s1,
            "card_amount_sum_24h": s24, "card_amount_max_24h": max([e["a"] for e in win24], default=0.0),
            "card_seconds_since_last": secs, "card_velocity_ratio": vel,
            "card_distinct_merchants_24h": float(len({e["m"] for e in win24})),
            "card_distinct_countries_7d": float(len({e["c"] for e in win7})),
            "card_distinct_devices_7d": float(len({e["d"] for e in win7})),
            "is_new_merchant_for_card": float(all(e["m"] != r["merchant_id"] for e in h)),
            "is_new_device_for_card": float(all(e["d"] != device for e in h)),
            "is_new_country_for_card": float(all(e["c"] != country for e in h)),
            "hour_of_day": float(hour), "day_of_week": float(dow),
        }
        if r.get("commit", True):
            h.append({"us": us, "a": amt, "m": r["merchant_id"], "c": country, "d": device, "h": hour})
    return out

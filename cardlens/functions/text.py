"""Text guardrails as column expressions.

All patterns run in the JVM (``regexp_replace`` / ``regexp_count`` /
``rlike``).  They carry the ``(?U)`` flag so ``\\w``, ``\\d``, ``\\s`` and
``\\b`` are Unicode-aware, as in the Python ``re`` semantics we reproduce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.constants import (BLOCK_CLAIM, BLOCK_PAN, BLOCK_QUESTION, DEFAULT_AUDIT_SALT,
                                SANITIZE_MAX_CHARS, TRUNCATION_MARKER)

# ---------------------------------------------------------------- FIXED VALUES
# Redaction rules, applied in this order: (kind, pattern, replacement, case-insensitive)
REDACTIONS = [
    ("pan", r"\b(?:\d[ -]*?){13,19}\b", "[REDACTED_PAN]", False),
    ("cvv", r"\bcvv:?\s*\d{3,4}\b", "[REDACTED_CVV]", True),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]", False),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[REDACTED_EMAIL]", False),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED_PHONE]", False),
]

# Injection patterns (all case-insensitive), reported by name in this order
INJECTION_PATTERNS = [
    ("instruction_override", r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?"),
    ("role_switch", r"\b(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be|roleplay)\b"),
    ("system_prompt_probe", r"\b(?:system\s+prompt|your\s+instructions|reveal\s+your)\b"),
    ("fake_delimiter", r"</?(?:system|assistant|human|instructions?)>"),
    ("decision_override",
     r"\b(?:approve|clear|whitelist|unblock)\s+(?:this|the)\s+(?:card|transaction|case)\b"),
    ("exfiltration",
     r"\b(?:send|post|email|upload)\s+(?:this|the|all)\b.{0,40}\b(?:to|at)\b\s*\S+@|https?://"),
]

# Output checks
PAN_LEAK = r"\b(?:\d[ -]*?){13,19}\b"
DECISION_CLAIM = r"\bI\s+(?:have\s+)?(?:approved|declined|blocked|unblocked|refunded|closed)\b"
CASE_CLOSE_TAG = r"</\s*case\s*>"
# ------------------------------------------------------------ END FIXED VALUES

BLOCKING_FLAGS = ("instruction_override", "system_prompt_probe")


def _rx(pattern: str, ignore_case: bool = False) -> str:
    return ("(?Ui)" if ignore_case else "(?U)") + pattern


# What every match of a rule begins with: looked at before the word boundary,
# whose Unicode form costs far more at every place of a text.
_FIRST = {"pan": r"(?=\d)", "cvv": "(?=c)", "ssn": r"(?=\d)", "phone": r"(?=[+(\d])"}


def _rule(kind: str, pattern: str, ignore_case: bool) -> str:
    return _rx(_FIRST.get(kind, "") + pattern, ignore_case)


def _may_match(text: Column, kind: str) -> Column:
    return text.contains("@") if kind == "email" else text.isNotNull()


def _redacted(text: Column, kind: str, pat: str, rep: str, ic: bool) -> Column:
    return F.when(_may_match(text, kind), F.regexp_replace(text, _rule(kind, pat, ic), rep)) \
            .otherwise(text)


def _hits(text: Column, kind: str, pat: str, rep: str, ic: bool) -> Column:
    return F.when(_may_match(text, kind), F.regexp_count(text, F.lit(_rule(kind, pat, ic)))) \
            .otherwise(0).cast("int")


def redact(text: Column) -> Column:
    """Apply every redaction rule in order."""
    out = text
    for kind, pat, rep, ic in REDACTIONS:
        out = F.regexp_replace(out, _rule(kind, pat, ic), rep)
    return out


def redaction_counts(text: Column) -> Column:
    """Map kind -> hits, each counted on the text left by the earlier rules;
    only kinds with hits are kept."""
    cur = text
    entries = []
    for kind, pat, rep, ic in REDACTIONS:
        entries += [F.lit(kind), F.regexp_count(cur, F.lit(_rule(kind, pat, ic))).cast("int")]
        cur = F.regexp_replace(cur, _rule(kind, pat, ic), rep)
    return F.map_filter(F.create_map(*entries), lambda k, v: v > 0)


def with_redactions(df: DataFrame, text: str, redacted: str | None = None,
                    counts: str | None = None) -> DataFrame:
    """X3 and X4 as columns of ``df``.  Each rule is a step of its own, so the
    text it leaves is made once, whoever reads it."""
    own = [c for c in df.columns if c not in (redacted, counts)]
    cur, entries = F.col(text), []
    for i, rule in enumerate(REDACTIONS):
        df = df.withColumns({f"_n{i}": _hits(cur, *rule), f"_text{i}": _redacted(cur, *rule)})
        entries += [F.lit(rule[0]), F.col(f"_n{i}")]
        cur = F.col(f"_text{i}")
    made = [cur.alias(redacted)] if redacted else []
    if counts:
        made.append(F.map_filter(F.create_map(*entries), lambda k, v: v > 0).alias(counts))
    return df.select(*own, *made)


def counts_text(counts: Column) -> Column:
    """Render a redaction-count map as ``kind:n`` pairs in rule order."""
    return F.concat_ws(",", F.transform(
        F.filter(F.array(*[F.lit(k) for k, *_ in REDACTIONS]),
                 lambda k: F.coalesce(F.element_at(counts, k), F.lit(0)) > 0),
        lambda k: F.concat(k, F.lit(":"), F.element_at(counts, k).cast("string"))))


def injection_flags(text: Column) -> Column:
    """Names of the injection patterns found, in pattern order."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(text.rlike(_rx(p, True)), F.lit(False)), F.lit(n))
        for n, p in INJECTION_PATTERNS]))


def sanitize(text: Column, max_chars: int | None = None) -> Column:
    """Neutralise closing case tags; ``max_chars`` (such as
    ``SANITIZE_MAX_CHARS``) cuts what is longer and marks the cut."""
    t = F.regexp_replace(text, _rx(CASE_CLOSE_TAG, True), "[/case]")
    if max_chars is None:
        return t
    return F.when(F.char_length(t) > max_chars,
                  F.concat(F.substring(t, 1, max_chars), F.lit(TRUNCATION_MARKER))).otherwise(t)


def question_blocked(flags: Column) -> Column:
    """Block on an override or a prompt probe."""
    return F.arrays_overlap(flags, F.array(*[F.lit(f) for f in BLOCKING_FLAGS]))


def question_reason(flags: Column) -> Column:
    return F.when(question_blocked(flags), F.lit(BLOCK_QUESTION))


def answer_block_reason(text: Column) -> Column:
    """First failing check gives the reason; null when the answer passes."""
    return (F.when(text.rlike(_rx(PAN_LEAK)), F.lit(BLOCK_PAN))
             .when(text.rlike(_rx(DECISION_CLAIM, True)), F.lit(BLOCK_CLAIM)))


def pseudonym(value: Column, salt: str = DEFAULT_AUDIT_SALT) -> Column:
    """First 32 hex digits of sha256(salt:value)."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), value.cast("string")), 256), 1, 32)

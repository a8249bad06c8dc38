"""Column functions on text: tokenizers, overlaps, sentences, windows, and the scans for secrets and injected instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: token patterns, and the patterns of the scans -------------------------------------------------
TERM = r"[A-Za-z0-9_@./{}-]{2,}"
LEARNING = r"[a-z0-9][a-z0-9_-]{2,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"
WORD = r"[A-Za-z0-9_@]+"
SECRETS = {
    "aws_access_key_id": r"\bAKIA[0-9A-Z]{16}\b",
    "aws_secret_key": r"(?i)aws_secret_access_key\s*[=:]\s*['\"]?[A-Za-z0-9/+=]{40}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "generic_api_key": r"(?i)\b(?:api[_-]?key|apikey|access[_-]?token)\b\s*[=:]\s*['\"]?[A-Za-z0-9_\-]{16,}",
    "hardcoded_password": r"(?i)\bpassword\b\s*[=:]\s*['\"][^'\"\s]{4,}['\"]",
    "jdbc_credentials": r"jdbc:[a-z]+://[^\s'\"]*[?&]password=[^&\s'\"]+",
    "slack_webhook": r"https://hooks\.slack\.com/services/[A-Za-z0-9/]+",
    "jwt_token": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
}
PII = {
    "email_address": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b",
}
INJECTIONS = {
    "override_instructions": r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?)\b",
    "role_override": r"(?i)\byou\s+are\s+now\s+(?:a|an|no\s+longer)\b",
    "system_prompt_probe": r"(?i)\b(?:reveal|show|print|output|leak)\s+(?:your\s+|the\s+)?(?:system\s+prompt|instructions|api\s+key|secret|credentials?)\b",
    "new_instructions_marker": r"(?im)^\s*###?\s*(?:new|updated|admin|developer)\s+instructions?\s*:?\s*$",
    "act_as_jailbreak": r"(?i)\bact\s+as\s+(?:if\s+you\s+(?:have\s+no|are\s+not)|dan|jailbreak)\b",
}
# ------------------------------------------------------------------------------------------------------------------


def terms(c: Column) -> Column:
    """Lower-cased retrieval terms, in order; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))


def learning_terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(LEARNING), F.lit(0))


def identifiers(c: Column) -> Column:
    """The set of lower-cased identifiers of three characters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), F.lower))


def words(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0)), F.lower))


def overlap(query: Column, found: Column) -> Column:
    """Share of the query's words that were found; 0 for an empty query."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, found)) / F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def sentences(c: Column) -> Column:
    """Parts after ``.!?;`` or a line end with blanks folded, of 24 to 420 characters; longer ones cut at their last blank before; if none is left the first 420 characters."""
    raw = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    parts = F.transform(F.split(raw, r"(?<=[.!?;])\s+|\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    kept = F.filter(parts, lambda s: F.length(s) >= 24)
    cut = F.transform(kept, lambda s: F.when(F.length(s) <= 420, s).otherwise(F.regexp_replace(F.substring(s, 1, 420), r" [^ ]*$", "")))
    return F.when(raw == "", F.array().cast("array<string>")).when(F.size(cut) > 0, cut).otherwise(F.array(F.substring(raw, 1, 420)))


def windows(c: Column, width: int) -> Column:
    """Windows of ``width`` words that overlap by an eighth; struct(pos, text). Blank text has none."""
    step = max(1, width - width // 8)
    ws = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(F.array(ws), lambda w: F.when(F.size(w) == 0, F.array().cast("array<struct<pos:int,text:string>>")).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda i: (i == 0) | (i + (width - step) < F.size(w))),
        lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i + 1, width), " ").alias("text")),
    )))[0]


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def findings(c: Column, patterns: dict[str, str]) -> Column:
    """Array of struct(kind, n) of the patterns that match at least once."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(F.coalesce(c, F.lit("")), F.lit(p)).alias("n")) for k, p in patterns.items()])
    return F.filter(each, lambda f: f["n"] > 0)


def redact(c: Column, patterns: dict[str, str] = SECRETS, mark: str = "***REDACTED-{}***") -> Column:
    """The text with every match replaced by the mark of its kind, in the order of the patterns."""
    for k, p in patterns.items():
        c = F.regexp_replace(c, p, mark.format(k.upper()))
    return c


def approx_tokens(c: Column) -> Column:
    """Characters over four, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")

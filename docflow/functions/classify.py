"""Error classes, fallback eligibility and message texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case substrings that decide the class of an error.
RATE_LIMIT_PATTERNS = [
    "429",
    "rate limit",
    "too many requests",
    "rate_limit_exceeded",
]
PERMANENT_PATTERNS = [
    "unsupported base64 file format",
    "unsupported file format",
    "invalid image format",
    "failed to process some items",
    "invalid url",
    "image too large",
    "unable to decode image",
    "corrupted image",
]
FALLBACK_STATUS = "400"
FALLBACK_PHRASE = "failed to download"

# Message prefixes per class, first for the primary call, then
# for the call to the fallback address.
PRIMARY_PREFIX = {
    "rate_limit": "Rate limited: ",
    "permanent": "Permanent OCR failure: ",
    "transient": "OCR failed: ",
}
FALLBACK_PREFIX = {
    "rate_limit": "Rate limited on fallback: ",
    "permanent": "Permanent OCR failure on fallback: ",
    "transient": "OCR fallback failed: ",
}


def _mentions(message: Column, patterns: list[str]) -> Column:
    # contains, not LIKE: '_' in a pattern must stay literal
    folded = F.lower(message)
    return reduce(or_, [F.contains(folded, F.lit(p)) for p in patterns])


def classify_error(message: Column) -> Column:
    """rate_limit before permanent before transient; null stays null."""
    return (
        F.when(message.isNull(), F.lit(None).cast("string"))
        .when(_mentions(message, RATE_LIMIT_PATTERNS), "rate_limit")
        .when(_mentions(message, PERMANENT_PATTERNS), "permanent")
        .otherwise("transient")
    )


def fallback_eligible(message: Column, has_fallback: Column) -> Column:
    """Whether a failed primary call earns one try with the fallback address."""
    return F.coalesce(
        has_fallback
        & (classify_error(message) == "transient")
        & F.contains(message, F.lit(FALLBACK_STATUS))
        & F.contains(F.lower(message), F.lit(FALLBACK_PHRASE)),
        F.lit(False),
    )


def normalise_message(message: Column, outcome: Column, on_fallback: Column) -> Column:
    """Put the class prefix in front of a raw error message."""
    text = F.lit(None).cast("string")
    for name in PRIMARY_PREFIX:
        prefix = F.when(on_fallback, FALLBACK_PREFIX[name]).otherwise(PRIMARY_PREFIX[name])
        text = F.when(outcome == name, F.concat(prefix, message)).otherwise(text)
    return text


def earns_fallback(message: str) -> bool:
    """The eligibility rule for one message, used next to the model call."""
    folded = message.lower()
    if any(p in folded for p in (*RATE_LIMIT_PATTERNS, *PERMANENT_PATTERNS)):
        return False
    return FALLBACK_STATUS in message and FALLBACK_PHRASE in folded

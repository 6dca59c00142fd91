"""Table schemas, allowed values and the key check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_KEYS = ["batch_id", "chunk_id"]
PI_KEYS = [*CHUNK_KEYS, "pi"]
REF_KEYS = [*PI_KEYS, "filename"]

# The states a chunk, a ref and a report can be in.
PHASES = ["FETCHING", "PROCESSING", "PUBLISHING", "DONE", "ERROR"]
REF_STATUSES = ["pending", "done", "skipped", "error"]
REPORT_STATUSES = ["success", "partial", "error"]
OUTCOMES = ["done", "skipped", "permanent", "rate_limit", "transient"]

REQUESTS = "batch_id string, chunk_id string, pis array<string>, custom_prompt string, received_at timestamp"
VERSIONS = (
    "entity string, ver long, tip string, prev_tip string, note string, network string, "
    "n_components long"
)
COMPONENTS = "entity string, ver long, filename string, cid string"
CONTENTS = "cid string, content string"
REFS = (
    "batch_id string, chunk_id string, pi string, filename string, cdn_url string, "
    "original_cid string, ref_data_json string"
)
ATTEMPTS = (
    "batch_id string, chunk_id string, pi string, filename string, seq long, "
    "attempted_at timestamp, outcome string, text string, tokens long, message string, "
    "fails long, prompt_tokens long, completion_tokens long"
)
REPORTS = {
    "chunks": (
        "batch_id string, chunk_id string, status string, total_refs long, completed long, "
        "failed long, skipped long, processing_time_ms long, error string"
    ),
    "entities": (
        "batch_id string, chunk_id string, pi string, status string, new_tip string, "
        "new_version long, refs_completed long, refs_failed long"
    ),
    "failed_refs": "batch_id string, chunk_id string, pi string, filename string, error string",
}
CHUNK_FAILURES = "batch_id string, chunk_id string, seq long, phase string, message string"


class KeyViolation(ValueError):
    """A table holds more than one row for a declared key."""


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") > 1)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise with one offending key."""
    bad = key_violations(df, keys).take(1)
    if bad:
        raise KeyViolation(f"duplicate key {bad[0].asDict()} for {keys}")
    return df


def unexpected_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose enum column holds none of the allowed values."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


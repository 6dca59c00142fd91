"""Scalar expressions over status, time and text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two delay rules, in milliseconds.
BASE_DELAY_MS = 1000
MAX_DELAY_MS = 60000
MAX_EXPONENT = 5
JITTER_SHARE = 0.25

REF_SUFFIX = ".ref.json"
TEST_PREFIX = "II"


def utf16_length(text: Column) -> Column:
    """Text length in UTF-16 code units."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def is_ref(filename: Column) -> Column:
    return F.endswith(filename, F.lit(REF_SUFFIX))


def network_tag(pi: Column) -> Column:
    """'test' for ids of the test network, else null."""
    return F.when(F.startswith(pi, F.lit(TEST_PREFIX)), "test")


def falsy_to(column: Column, default: Column) -> Column:
    """Replace null and the empty string."""
    return F.coalesce(F.nullif(column, F.lit("")), default)


def _js_round(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def backoff_ms(streak: Column, jitter: Column | None = None) -> Column:
    """Delay after ``streak`` rate-limited steps in a row.

    ``jitter`` in [-1, 1] moves the delay by up to a quarter; it is an input so
    that a re-run gives the same schedule.
    """
    exponent = F.least(streak - 1, F.lit(MAX_EXPONENT))
    delay = F.least(F.lit(BASE_DELAY_MS) * F.pow(F.lit(2.0), exponent), F.lit(float(MAX_DELAY_MS)))
    if jitter is not None:
        delay = delay + delay * F.lit(JITTER_SHARE) * jitter
    return F.when(streak > 0, _js_round(delay))


def backoff_remaining(until_ms: Column, as_of_ms: Column) -> Column:
    """Milliseconds left at an instant, 0 when there is no backoff."""
    return F.when(F.coalesce(until_ms, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(
        F.greatest(F.lit(0).cast("long"), until_ms - as_of_ms)
    )


def in_backoff(until_ms: Column, as_of_ms: Column) -> Column:
    return backoff_remaining(until_ms, as_of_ms) > 0


def global_retry_delay(failures: Column) -> Column:
    """Delay before a whole chunk is tried again."""
    grown = F.lit(BASE_DELAY_MS) * F.pow(F.lit(2.0), F.least(failures, F.lit(30)))
    return F.least(F.lit(float(MAX_DELAY_MS)), grown).cast("long")


def status_of_phase(phase: Column) -> Column:
    return (
        F.when(phase == "DONE", "done")
        .when(phase == "ERROR", "error")
        .when(phase.isNotNull(), "processing")
    )


def elapsed_ms(started: Column, completed: Column, as_of: Column) -> Column:
    return F.unix_millis(F.coalesce(completed, as_of)) - F.unix_millis(started)


def chunk_label(batch_id: Column, chunk_id: Column) -> Column:
    """Display name only; the two columns stay the key."""
    return F.concat_ws(":", batch_id, chunk_id)


def version_note(n_components: Column) -> Column:
    return F.concat(F.lit("OCR: Updated "), n_components.cast("string"), F.lit(" refs"))

"""Progress, per-entity results, chunk reports and status reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.scalars import elapsed_ms, falsy_to, status_of_phase
from docflow.schema import CHUNK_KEYS
from docflow.session import spread

UNKNOWN_ERROR = "Unknown error"
_COUNTERS = ["total_refs", "completed", "failed", "skipped", "pending"]


def _status_counts() -> list[Column]:
    status = F.col("status")
    return [
        F.count(status).alias("total_refs"),
        F.count_if(status == "done").alias("completed"),
        F.count_if(status == "error").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "pending").alias("pending"),
    ]


def chunk_progress(refs: DataFrame, keys: list[str] = CHUNK_KEYS) -> DataFrame:
    return refs.groupBy(*keys).agg(*_status_counts())


def pi_results(pis: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and status per entity.

    ``refs_completed`` includes skipped refs. An entity without refs, or with
    only pending ones, counts as success.
    """
    counts = refs.groupBy(*keys).agg(*_status_counts())
    joined = pis.join(counts, keys, "left").fillna(0, _COUNTERS)
    joined = joined.withColumn("refs_completed", F.col("completed") + F.col("skipped"))
    some_failed, some_done = F.col("failed") > 0, F.col("refs_completed") > 0
    has_error = F.nullif(F.col("entity_error"), F.lit("")).isNotNull()
    return joined.withColumn(
        "status",
        F.when(has_error, "error")
        .when(some_failed & some_done, "partial")
        .when(some_failed, "error")
        .otherwise("success"),
    ).withColumn("refs_failed", F.col("failed"))


def failed_refs(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Failed refs in long form, one row each; no shuffle."""
    return refs.where(F.col("status") == "error").select(
        *keys, "filename", falsy_to(F.col("error"), F.lit(UNKNOWN_ERROR)).alias("error")
    )


def chunk_report(chunks: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """One row per chunk: status, counters, elapsed time, error.

    ``results`` is the output of ``pi_results`` with the chunk keys. A chunk
    without entities is a success. Phase ERROR overrides the status.
    """
    totals = results.groupBy(*CHUNK_KEYS).agg(
        F.bool_and(F.col("status") == "success").alias("all_ok"),
        F.bool_and(F.col("status") == "error").alias("all_bad"),
        *[F.sum(c).alias(c) for c in ("total_refs", "completed", "failed", "skipped")],
    )
    broken = F.coalesce(F.col("phase") == "ERROR", F.lit(False))
    status = (
        F.when(broken, "error")
        .when(F.coalesce(F.col("all_ok"), F.lit(True)), "success")
        .when(F.col("all_bad"), "error")
        .otherwise("partial")
    )
    return (
        chunks.join(totals, CHUNK_KEYS, "left")
        .fillna(0, ["total_refs", "completed", "failed", "skipped"])
        .select(
            *CHUNK_KEYS,
            status.alias("status"),
            "total_refs",
            "completed",
            "failed",
            "skipped",
            elapsed_ms(F.col("started_at"), F.col("completed_at"), as_of).alias(
                "processing_time_ms"
            ),
            F.when(broken, F.col("global_error")).alias("error"),
        )
    )


def entity_rows(results: DataFrame) -> DataFrame:
    """The entity table of the reports."""
    return results.select(
        *CHUNK_KEYS,
        "pi",
        "status",
        F.nullif(F.col("new_tip"), F.lit("")).alias("new_tip"),
        F.nullif(F.col("new_version"), F.lit(0)).alias("new_version"),
        "refs_completed",
        "refs_failed",
    )


def chunk_status(wanted: DataFrame, chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """Status read for a table of chunk keys; unknown chunks are not_found."""
    known = chunks.join(progress, CHUNK_KEYS, "left").fillna(0, _COUNTERS)
    return (
        wanted.join(spread(known), CHUNK_KEYS, "left")
        .withColumn("status", F.coalesce(status_of_phase(F.col("phase")), F.lit("not_found")))
    )


def latest_run(rows: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Rows of the newest run of each chunk; older runs stay stored."""
    newest = rows.groupBy(*keys).agg(F.max(run).alias(run))
    return rows.join(spread(newest), [*keys, run], "left_semi")


def complete_chunks(refs: DataFrame, chunks: DataFrame, keys: list[str] = CHUNK_KEYS) -> DataFrame:
    """Chunks with no pending ref left; one without refs is complete."""
    pending = refs.groupBy(*keys).agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count(F.lit(1)).alias("total_refs"),
    )
    joined = chunks.select(*keys).join(pending, keys, "left").fillna(0, ["pending", "total_refs"])
    return joined.where(F.col("pending") == 0).drop("pending")

"""What the stored tables of a run say about its chunks, at any time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.scalars import backoff_ms, status_of_phase
from docflow.operators.fold import MAX_RETRIES, backoff_steps, chunk_fail_fold, current_streak
from docflow.operators.queue import LOG_SHOWN, log_lines
from docflow.operators.report import chunk_progress
from docflow.plans.enrich import ref_status
from docflow.schema import ATTEMPTS, CHUNK_FAILURES, CHUNK_KEYS, REF_KEYS
from docflow.session import is_done, is_missing, spread

_KEYS = "batch_id string, chunk_id string"
_COUNTERS = ["total_refs", "completed", "failed", "skipped", "pending"]


def _rows(spark: SparkSession, path: str, schema: str, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted chunks; none if the table is not there yet."""
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if not is_missing(problem):
            raise
        return spark.createDataFrame([], schema)
    return table.join(spread(wanted), CHUNK_KEYS, "left_semi")


def _progress(spark: SparkSession, run_path: str, wanted: DataFrame, max_retries: int) -> DataFrame:
    """Counts per chunk; a ref that was never tried is pending."""
    refs = _rows(spark, f"{run_path}/refs/rows", f"{_KEYS}, pi string, filename string", wanted)
    if not is_done(spark, f"{run_path}/log/done/round=0"):
        return chunk_progress(refs.withColumn("status", F.lit("pending")))
    status = ref_status(spark, f"{run_path}/log", max_retries, wanted)
    known = refs.join(status.select(*REF_KEYS, "status"), REF_KEYS, "left")
    return chunk_progress(known.withColumn("status", F.coalesce("status", F.lit("pending"))))


def run_status(
    spark: SparkSession,
    run_path: str,
    wanted: DataFrame,
    max_retries: int = MAX_RETRIES,
    lines: int = LOG_SHOWN,
) -> DataFrame:
    """Status of the wanted chunks (batch_id, chunk_id) of a run: one row each.

    It may be read while ``process_chunks`` works on ``run_path``, between two of its calls, or
    after them. Chunks the run does not have are ``not_found``, their other columns null.
    Everything is cut down to the wanted chunks before it is aggregated.

    Result: batch_id, chunk_id, status, phase, the counters of the refs, ``failures`` (how often the
    chunk itself has failed), ``error`` (the message that ended it), ``last_failure``, ``streak``
    (rounds with a rate limit up to now), ``delay_ms`` (what that streak makes a round that
    follows wait for, without jitter) and ``debug_log``, the newest ``lines`` messages of attempts,
    oldest first.
    """
    wanted = wanted.select(*CHUNK_KEYS).distinct()
    begun = is_done(spark, f"{run_path}/refs/done")
    ended = is_done(spark, f"{run_path}/reported")
    attempts = _rows(spark, f"{run_path}/log/attempts/round=*/slice=*", ATTEMPTS, wanted)
    attempts = attempts.where(F.col("seq") > 0)
    failures = _rows(spark, f"{run_path}/failures/*/rows", CHUNK_FAILURES, wanted)
    folded = chunk_fail_fold(failures).select(
        *CHUNK_KEYS, (F.col("phase") == "ERROR").alias("lost"), "global_error",
        F.col("global_retry_count").alias("failures"),
    )
    newest = failures.groupBy(*CHUNK_KEYS).agg(F.max_by("message", "seq").alias("last_failure"))
    noted = F.concat("pi", F.lit("/"), "filename", F.lit(": "), "message").alias("message")
    log = attempts.where(F.col("message").isNotNull()).select(*REF_KEYS, "seq", noted)

    known = _rows(spark, f"{run_path}/chunks/rows", _KEYS, wanted)
    for part in (
        _progress(spark, run_path, wanted, max_retries),
        folded,
        newest,
        current_streak(backoff_steps(attempts)),
        log_lines(log, CHUNK_KEYS, ["seq", "pi", "filename"], lines),
    ):
        known = known.join(part, CHUNK_KEYS, "left")
    known = known.fillna(0, [*_COUNTERS, "failures", "streak"])
    phase = (
        F.when(F.col("lost"), "ERROR")
        .when(F.lit(ended), "DONE")
        .when(F.lit(not begun), "FETCHING")
        .when(F.col("pending") > 0, "PROCESSING")
        .otherwise("PUBLISHING")
    )
    known = known.withColumn("phase", phase)
    waits = F.col("phase") == "PROCESSING"
    return wanted.join(known, CHUNK_KEYS, "left").select(
        *CHUNK_KEYS,
        F.coalesce(status_of_phase(F.col("phase")), F.lit("not_found")).alias("status"),
        "phase",
        *_COUNTERS,
        "failures",
        F.when(F.col("phase") == "ERROR", F.col("global_error")).alias("error"),
        "last_failure",
        "streak",
        F.when(waits, backoff_ms(F.col("streak"))).alias("delay_ms"),
        "debug_log",
    )

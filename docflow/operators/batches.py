"""Batch-level use of chunk reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.schema import CHUNK_KEYS, PI_KEYS
from docflow.session import spread


def batch_rollup(dispatched: DataFrame, reports: DataFrame) -> DataFrame:
    """Per batch: chunks sent, complete, failed, and whether all have ended."""
    states = dispatched.select(*CHUNK_KEYS).join(
        reports.select(*CHUNK_KEYS, "status"), CHUNK_KEYS, "left"
    )
    state = (
        F.when(F.col("status").isNull(), "dispatched")
        .when(F.col("status") == "error", "error")
        .otherwise("complete")
    )
    return (
        states.withColumn("state", state)
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("n_chunks"),
            F.count_if(F.col("state") == "complete").alias("n_complete"),
            F.count_if(F.col("state") == "error").alias("n_error"),
            F.bool_and(F.col("state") != "dispatched").alias("all_ended"),
        )
    )


def report_lines(entities: DataFrame, failed: DataFrame) -> DataFrame:
    """One row per reported entity and failed ref; an entity without any has one row."""
    return entities.join(failed.select(*PI_KEYS, "filename", "error"), PI_KEYS, "left")


def apply_report(node_refs: DataFrame, entities: DataFrame, failed: DataFrame) -> DataFrame:
    """Mark the refs of reported nodes.

    Refs listed as failed get their error, all other refs of the node are
    complete. Nodes no report names keep their refs as they were. Of several
    reports on a node the one with the newest version names its tip, and of
    several errors of one ref the greatest stays.
    """
    reported = entities.groupBy("pi").agg(
        F.max_by("new_tip", "new_version").alias("new_tip"),
        F.max("new_version").alias("new_version"),
    )
    failed = failed.groupBy("pi", "filename").agg(F.max("error").alias("failed_error"))
    named = F.col("is_reported")
    wrong = F.col("failed_error").isNotNull()
    return (
        node_refs.join(spread(reported.withColumn("is_reported", F.lit(True))), "pi", "left")
        .join(spread(failed), ["pi", "filename"], "left")
        .withColumn("ocr_error", F.when(named & wrong, F.col("failed_error")))
        .withColumn("ocr_complete", F.coalesce(named & ~wrong, F.lit(False)))
        .drop("is_reported", "failed_error")
    )


def node_states(applied: DataFrame) -> DataFrame:
    """Per node: complete when every ref is complete or failed; its new version."""
    ended = F.col("ocr_complete") | F.col("ocr_error").isNotNull()
    return applied.groupBy("pi").agg(
        F.bool_and(ended).alias("ocr_complete"),
        F.count_if(F.col("ocr_error").isNotNull()).alias("n_errors"),
        F.max("new_tip").alias("new_tip"),
        F.max("new_version").alias("new_version"),
    )

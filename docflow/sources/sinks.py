"""Writers: content, versions and reports.

Every write goes to a folder named after the run or micro-batch and replaces
that folder only, so repeating a failed write never doubles rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.contents import content_bucket
from docflow.operators.report import entity_rows
from docflow.operators.versions import version_rows
from docflow.schema import CHUNK_KEYS, PI_KEYS


def write_contents(new_rows: DataFrame, path: str, write_id: str) -> None:
    """Append contents, laid out in folders by their id: see ``only_wanted``."""
    rows = new_rows.select("cid", "content", content_bucket(F.col("cid")).alias("bucket"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/write={write_id}"
    )


def append_versions(
    plan: DataFrame,
    components: DataFrame,
    path: str,
    write_id: str,
    update_keys: list[str] | None = None,
) -> None:
    """Append the committed part of a plan.

    ``components`` is in long form: entity, the ``update_keys`` (default
    update_id), filename, cid.
    ``plan`` is read twice, so it should be a stored table. The version row is
    written last: components without a version row are invisible to readers
    that join from versions. One writer at a time is assumed, as plain files
    have no transaction log.
    """
    keys = ["entity", *(update_keys or ["update_id"])]
    won = plan.where("committed").select(*keys, F.col("new_version").alias("ver"))
    rows = components.join(won, keys)
    rows = rows.select("entity", "ver", "filename", "cid")
    rows.write.mode("overwrite").parquet(f"{path}/components/write={write_id}")
    # tips are hex digits: only an entropy coder makes them smaller
    versions = version_rows(plan).write.mode("overwrite").option("compression", "zstd")
    versions.parquet(f"{path}/versions/write={write_id}")


def write_reports(
    report: DataFrame,
    entities: DataFrame,
    failed: DataFrame,
    path: str,
    run_id: str | None = None,
) -> None:
    """Reports as three flat tables: chunks, entities, failed refs.

    Their form does not depend on any size. Rows are sorted by batch and chunk inside
    the files, so a reader of one batch skips most of each file; there is no folder
    per batch. The chunks come last: entities without their chunk are unfinished.

    With a ``run_id`` the tables hold many runs, a folder each; writing a run again replaces
    its folders and leaves the others.
    """
    tables = (
        ("failed_refs", failed.select(*PI_KEYS, "filename", "error")),
        ("entities", entity_rows(entities)),
        ("chunks", report),
    )
    for name, rows in tables:
        if run_id is not None:
            rows = rows.withColumn("run_id", F.lit(run_id))
        ordered = rows.hint("rebalance", F.col("batch_id")).sortWithinPartitions(*CHUNK_KEYS)
        writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if run_id is not None:
            writer = writer.partitionBy("run_id")
        writer.parquet(f"{path}/{name}")

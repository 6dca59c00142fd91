"""Readers for the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow import schema
from docflow.session import spread


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request messages, one JSON object per line; bad lines keep their text in
    ``_corrupt_record``."""
    return (
        spark.read.schema(schema.REQUESTS + ", _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def read_versions(
    spark: SparkSession, path: str, columns: str = schema.VERSIONS
) -> DataFrame:
    return spark.read.schema(columns).parquet(f"{path}/versions/*")


def read_components(
    spark: SparkSession, path: str, columns: str = schema.COMPONENTS
) -> DataFrame:
    return spark.read.schema(columns).parquet(f"{path}/components/*")


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """Contents as written by ``write_contents``, with the ``bucket`` they are laid out by."""
    return spark.read.schema(schema.CONTENTS + ", bucket int").parquet(path)


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, entities, failed refs) as written by ``write_reports``."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("chunks", "entities", "failed_refs"))


def read_latest_reports(
    spark: SparkSession, path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, entities, failed refs) of each chunk's newest run, with its ``run_id``.

    Only the small chunk table is read for all runs. Of the others, the folders of runs that
    are the newest of some chunk are opened; the number of runs bounds that list.
    """

    # the schema is given: a run id may look like a number, and no ref may have failed
    chunks, *others = (
        spark.read.schema(f"{columns}, run_id string").parquet(f"{path}/{name}")
        for name, columns in schema.REPORTS.items()
    )
    newest = chunks.groupBy(*schema.CHUNK_KEYS).agg(F.max("run_id").alias("run_id"))
    runs = [r.run_id for r in newest.select("run_id").distinct().collect()]
    keys = [*schema.CHUNK_KEYS, "run_id"]
    return tuple(
        rows.where(F.col("run_id").isin(runs)).join(spread(newest), keys, "left_semi")
        for rows in (chunks, *others)
    )

"""Ordered picks per chunk: next work, claimed rows, log tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.schema import CHUNK_KEYS, REF_KEYS
from docflow.sources.keyed import KeyedTable

NEXT_BATCH = 20
LOG_KEPT = 100
LOG_SHOWN = 50


def first_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows per key; the limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def next_batch(
    ref_status: DataFrame,
    keys: list[str] = CHUNK_KEYS,
    order: list[Column | str] | None = None,
    n: int = NEXT_BATCH,
) -> DataFrame:
    """Per chunk the first ``n`` refs that are still pending."""
    pending = ref_status.where(F.col("status") == "pending")
    return first_k(pending, keys, order or ["pi", "filename"], n)


def claim_batch(refs: DataFrame, batch: DataFrame, keys: list[str] = REF_KEYS) -> DataFrame:
    """The ref rows named by a batch of keys."""
    return refs.join(batch.select(*keys), keys, "left_semi")


def log_tail(
    log: DataFrame,
    keys: list[str] = CHUNK_KEYS,
    order: list[str] | None = None,
    k: int = LOG_SHOWN,
) -> DataFrame:
    """The newest ``k`` entries per chunk with their ``age`` (1 = newest)."""
    newest = [F.col(c).desc() for c in order or ["ts", "id"]]
    return first_k(log, keys, newest, k).withColumnRenamed("rank", "age")


def log_lines(
    log: DataFrame,
    keys: list[str] = CHUNK_KEYS,
    order: list[str] | None = None,
    k: int = LOG_SHOWN,
) -> DataFrame:
    """The newest ``k`` entries per chunk as text lines, oldest first."""
    order = order or ["ts", "id"]
    line = F.concat_ws(" ", F.col(order[0]).cast("string"), F.col("message"))
    lines = log_tail(log, keys, order, k).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("age")).alias("at"), line.alias("line")))).alias(
            "_lines"
        )
    )
    return lines.select(*keys, F.col("_lines.line").alias("debug_log"))


def kept_log(
    log: DataFrame,
    keys: list[str] = CHUNK_KEYS,
    order: list[str] | None = None,
    k: int = LOG_KEPT,
) -> DataFrame:
    """The entries a capped log keeps: the newest ``k`` per chunk."""
    return log_tail(log, keys, order, k).drop("age")


def append_log(
    table: KeyedTable,
    entries: DataFrame,
    order: list[str] | None = None,
    k: int = LOG_KEPT,
) -> int:
    """Append entries to a capped log, kept as a table by chunk; returns its generation.

    Only the buckets of chunks that have new entries are read and rewritten. What cannot stay,
    because the chunk has ``k`` newer entries, is dropped in the tasks that hold it.
    """
    spark = entries.sparkSession
    generation = table.newest(spark) + 1
    table.write(
        spark,
        generation,
        entries,
        lambda old: kept_log(old.unionByName(entries.select(old.columns)), table.keys, order, k),
    )
    return generation

"""The attempt fold on a stream of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.fold import MAX_RETRIES, attempt_fold
from docflow.schema import REF_KEYS
from docflow.session import spread
from docflow.sources.keyed import BUCKETS, KeyedTable

_VALUES = ["status", "retry_count", "error"]


def state_table(
    attempts: DataFrame, path: str, keys: list[str] = REF_KEYS, buckets: int = BUCKETS
) -> KeyedTable:
    """The stored states of refs: keys, status, retry_count, error."""
    names = ", ".join(f"{k} {attempts.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{names}, status string, retry_count long, error string"
    return KeyedTable(f"{path}/state", keys, schema, buckets)


def _fold_batch(old: DataFrame, batch: DataFrame, keys: list[str], order: str, max_retries: int):
    """States after a micro-batch: what its rows make of pending refs, all others as they are."""
    ended = old.where("status <> 'pending'").select(*keys)
    before = old.where("status = 'pending'").select(*keys, F.col("retry_count").alias("before"))
    new = attempt_fold(
        batch.join(spread(ended), keys, "left_anti"), keys, [order], max_retries, before=before
    )
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    last = F.max_by(F.struct(*_VALUES), "is_new").alias("last")
    return both.groupBy(*keys).agg(last).select(*keys, "last.*")


def write_fold(
    attempts: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str] = REF_KEYS,
    order: str = "seq",
    max_retries: int = MAX_RETRIES,
    buckets: int = BUCKETS,
):
    """Start folding streamed attempts (keys, ``order``, outcome, message) into a state table.

    Each micro-batch is folded by the same aggregates as a stored log: every ref is reduced to
    its summary before it meets its old state, so a hot ref is combined in the tasks that
    read it. Only the buckets of refs in the micro-batch are read and rewritten. ``order`` is a whole
    number, total per ref; a ref's attempts may be mixed inside a micro-batch but not
    across micro-batches. Attempts of an ended ref change nothing.
    """
    table = state_table(attempts, path, keys, buckets)

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        table.write(
            batch.sparkSession,
            batch_id,
            batch,
            lambda old: _fold_batch(old, batch, keys, order, max_retries),
        )
        batch.unpersist()

    return (
        attempts.select(*keys, order, "outcome", "message")
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(fold)
        .start()
    )


def folded(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """The newest state of every ref."""
    return table.read(spark, table.newest(spark))

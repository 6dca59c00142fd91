"""Chunk completion and publishing on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from docflow.operators.versions import chain_updates, entity_tip, only_entities
from docflow.schema import CHUNK_KEYS
from docflow.session import spread
from docflow.sources.keyed import BUCKETS, KeyedTable
from docflow.sources.sinks import append_versions


def open_chunks(
    final_refs: DataFrame, path: str, keys: list[str] = CHUNK_KEYS, buckets: int = BUCKETS
) -> KeyedTable:
    """The state of ``write_complete_chunks``: chunks that are not complete, with a count."""
    names = ", ".join(f"{k} {final_refs.schema[k].dataType.simpleString()}" for k in keys)
    return KeyedTable(f"{path}_open", keys, f"{names}, n_final long", buckets)


def write_complete_chunks(
    final_refs: DataFrame,
    totals: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str] = CHUNK_KEYS,
    buckets: int = BUCKETS,
):
    """Start a stream that emits a chunk once, when its last ref has ended.

    ``final_refs`` streams one row per ref that reached a final status, each ref once,
    ``totals`` gives ``total_refs`` per chunk. A micro-batch is counted per chunk, combined
    before the shuffle, and added to the counts of its chunks. A chunk that is complete
    is emitted and leaves the state, so the state holds open chunks only and is empty when
    all are done; what was emitted is never read again. A chunk unknown to
    ``totals`` stays open.
    """
    table = open_chunks(final_refs, path, keys, buckets)

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_final")).persist()
        due = totals.join(spread(counts.select(*keys)), keys, "left_semi")

        def counted(old: DataFrame) -> DataFrame:
            both = old.unionByName(counts)
            return both.groupBy(*keys).agg(F.sum("n_final").alias("n_final"))

        before = table.read(spark, batch_id - 1, counts)
        full = counted(before).join(due, keys).where(F.col("n_final") >= F.col("total_refs"))
        out = f"{path}/batch={batch_id}"
        full.select(*keys, "total_refs").write.mode("overwrite").parquet(out)
        done = spark.read.schema(table.schema.replace(", n_final long", "")).parquet(out)
        table.write(
            spark, batch_id, counts, lambda old: counted(old).join(spread(done), keys, "left_anti")
        )
        counts.unpersist()

    return (
        final_refs.select(*keys)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(emit)
        .start()
    )


def _of_updates(components: DataFrame, plan: DataFrame) -> DataFrame:
    """Components between the first and the last committed update of a plan.

    Updates of a micro-batch mostly lie together, so most other components leave before
    the join and are not shuffled by every micro-batch.
    """
    if not isinstance(plan.schema["update_id"].dataType, (IntegralType, StringType)):
        return components
    low, high = plan.where("committed").agg(F.min("update_id"), F.max("update_id")).first()
    return components.where(F.col("update_id").between(low, high))


def publish_batches(
    updates: DataFrame,
    versions: Callable[[SparkSession], DataFrame],
    components: DataFrame,
    path: str,
    checkpoint: str,
    buckets: int = BUCKETS,
):
    """Start a stream that appends versions for each micro-batch of updates.

    ``versions`` gives the versions stored before the stream. The tips of entities that the
    stream has touched are kept in a table by entity: a micro-batch reads the tips of its
    own entities there, looks up those it meets for the first time among the earlier
    versions, and never reads what the stream appended. A repeated micro-batch plans
    against the same tips and replaces its own folders. Every update of a known
    entity commits, however the stream is cut into micro-batches.
    """
    kind = updates.schema["entity"].dataType.simpleString()
    table = KeyedTable(f"{path}/tips", ["entity"], f"entity {kind}, tip string, ver long", buckets)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        touched = batch.select("entity").distinct()
        known = table.read(spark, batch_id - 1, touched).join(spread(touched), "entity", "left_semi")
        fresh = touched.join(spread(known.select("entity")), "entity", "left_anti")
        tips = known
        if not fresh.isEmpty():
            base = versions(spark).select("entity", "tip", "ver")
            first = entity_tip(only_entities(base, fresh.withColumnRenamed("entity", "pi")))
            tips = known.unionByName(first)
        plan_path = f"{path}/plans/write={batch_id}"
        planned = chain_updates(batch, tips).write.mode("overwrite")
        planned.option("compression", "zstd").parquet(plan_path)
        plan = spark.read.parquet(plan_path)
        append_versions(plan, _of_updates(components, plan), path, str(batch_id))
        won = plan.where("committed").select(
            "entity", F.col("new_tip").alias("tip"), F.col("new_version").alias("ver")
        )
        table.write(
            spark, batch_id, touched, lambda old: entity_tip(old.unionByName(won)).select(old.columns)
        )
        batch.unpersist()

    return (
        updates.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(apply)
        .start()
    )

"""Request validation, work items, admission and chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators.ordered import dense_index
from docflow.schema import CHUNK_KEYS
from docflow.session import spread

CHUNK_SIZE = 10


def reject_reason(df: DataFrame) -> Column:
    """Null for a valid request. An empty ``pis`` array is valid."""

    def missing(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    reason = F.when(
        missing("batch_id") | missing("chunk_id") | F.col("pis").isNull(),
        "Missing required fields: batch_id, chunk_id, pis",
    )
    if "_corrupt_record" in df.columns:
        reason = F.when(F.col("_corrupt_record").isNotNull(), "Invalid request").otherwise(reason)
    return reason


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reason``)."""
    judged = df.withColumn("reason", reject_reason(df))
    ok = judged.where(F.col("reason").isNull()).drop("reason", "_corrupt_record")
    return ok, judged.where(F.col("reason").isNotNull())


def work_items(requests: DataFrame) -> DataFrame:
    """One row per entity of a request; ``pos`` keeps the request's order."""
    return requests.select(
        *CHUNK_KEYS,
        F.posexplode("pis").alias("pos", "pi"),
    )


def admit(requests: DataFrame, chunk_status: DataFrame) -> DataFrame:
    """Decide each request: accepted, or already_processing with the phase.

    A chunk that is absent, DONE or ERROR takes its earliest request; every
    later one in the same batch then meets a chunk in phase FETCHING.
    ``requests`` needs ``request_id`` and ``received_at``; ``chunk_status`` has
    one row per chunk with its ``phase``.
    """
    first = requests.groupBy(*CHUNK_KEYS).agg(
        F.min(F.struct("received_at", "request_id")).alias("_first")
    )
    chunks = first.join(chunk_status.select(*CHUNK_KEYS, "phase"), CHUNK_KEYS, "left")
    free = F.coalesce(F.col("phase").isin("DONE", "ERROR"), F.lit(True))
    wins = free & (F.struct("received_at", "request_id") == F.col("_first"))
    return (
        requests.join(spread(chunks), CHUNK_KEYS)
        .withColumn("status", F.when(wins, "accepted").otherwise("already_processing"))
        .withColumn(
            "phase",
            F.when(wins, F.lit(None).cast("string"))
            .when(free, "FETCHING")
            .otherwise(F.col("phase")),
        )
        .drop("_first")
    )


def assign_chunks(
    df: DataFrame, order: list[Column], size: int = CHUNK_SIZE, keys: list[str] | None = None
) -> DataFrame:
    """Number rows in order and cut them into chunks of ``size``.

    With ``keys`` (such as the batch) the numbers start at 0 for each key. The
    rows are still ranked all at once, so one huge batch is no hot group.
    """
    keys = keys or []
    ranked = dense_index(df, [*[F.col(k) for k in keys], *order], "_rank")
    place = F.col("_rank")
    if keys:
        first = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
        ranked = ranked.join(spread(first), keys)
        place = place - F.col("_first")
    chunk = F.floor(place / float(size)).cast("long")
    return ranked.withColumn("chunk_id", chunk).drop("_rank", "_first")


def chunk_requests(chunked: DataFrame, order: str = "pi") -> DataFrame:
    """Requests from numbered rows; each array holds one chunk, so its size is
    the chunk size."""
    members = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "pi")))
    return (
        chunked.groupBy(*CHUNK_KEYS)
        .agg(members.alias("_members"))
        .select(*CHUNK_KEYS, F.col("_members.pi").alias("pis"))
    )

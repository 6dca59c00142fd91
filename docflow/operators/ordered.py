"""Global ranks without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.session import durable

_LOCAL_BITS = 33


def dense_index(df: DataFrame, order: list[Column], alias: str) -> DataFrame:
    """Add the 0-based rank of each row in a total order.

    One range shuffle sorts the rows; the partition id and the position inside
    the partition come from ``monotonically_increasing_id``. Those pairs are
    checkpointed, so that the counting branch and the row branch see the same
    partitions also after an executor is lost. Only one offset per partition is
    windowed and broadcast: its row count is the number of shuffle partitions.
    """
    sorted_rows = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    tagged = durable(sorted_rows).withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(alias, (F.col("_before") + local).cast("long"))
        .drop("_pid", "_mid", "_before")
    )

"""Session settings and the shared folder used for checkpoints and run files."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TARGET_PARTITION_BYTES = 128 * 1024 * 1024

# Runtime SQL settings every plan relies on. Skew splitting is forced because a
# single entity, source or content id can own a third of a table, and the
# splitting must also happen when an aggregate follows the join.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # rows a model call's batch may hold at once in a Python worker
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the settings above.

    ``input_bytes`` raises the shuffle partition count so that one partition
    holds about 128 MB; adaptive execution merges what turns out too small.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes:
        wanted = math.ceil(input_bytes / TARGET_PARTITION_BYTES)
        current = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(wanted, current)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a session in one process may go without it and gets a temporary folder;
    on a cluster, executors would not see that.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="docflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def run_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/docflow/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; a missing one is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, read by every later branch."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def is_missing(problem: AnalysisException) -> bool:
    """Whether a read failed because nothing was written there yet."""
    return problem.getCondition() == "PATH_NOT_FOUND"


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a step has finished before."""
    try:
        return not spark.read.schema("id long").parquet(path).isEmpty()
    except AnalysisException as problem:
        if not is_missing(problem):
            raise
        return False


def set_done(spark: SparkSession, path: str) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(path)


def once(spark: SparkSession, path: str, action: Callable[[], None]) -> None:
    """Run a step unless it was finished before."""
    if not is_done(spark, path):
        action()
        set_done(spark, path)


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build and write a table once, and read it back."""
    once(spark, f"{path}/done", lambda: build().write.mode("overwrite").parquet(f"{path}/rows"))
    return spark.read.parquet(f"{path}/rows")


def spread(per_key: DataFrame) -> DataFrame:
    """Prepare a one-row-per-key aggregate for a join with many rows per key.

    Adaptive skew splitting only acts when both sides of the join come straight
    from a shuffle made for it. An aggregate on the join key is partitioned by
    that key already and gets no such shuffle, so a hot key on the other side
    would stay in one task. Rebalancing the few aggregate rows brings it back.
    """
    return per_key.hint("rebalance")

"""A stored table by key, of which an update reads and rewrites only a part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.session import is_missing, remove_folder

#: Rows are dealt to so many buckets by a hash of their key, unless a table says otherwise:
#: enough that a bucket is a task's work, so thousands for billions of keys.
BUCKETS = 16


class KeyedTable:
    """Rows by key in a shared folder, rewritten bucket by bucket.

    Every write is a generation, numbered like the micro-batches of a stream: the rows of the buckets it
    touched, and a short list that says for each bucket which generation holds it. Reading
    opens the buckets that are asked for and nothing else, so a micro-batch costs by the
    keys it touches and not by what was written before. A micro-batch that is repeated
    starts from the generation before it and replaces its own, so it finds what the first
    try found. Generations that neither the newest list nor the one before it
    names are deleted.
    """

    def __init__(self, path: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.path, self.keys, self.schema, self.buckets = path, keys, schema, buckets

    def bucket(self) -> Column:
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys]
        return F.pmod(F.crc32(F.concat_ws("|", *parts)), F.lit(self.buckets)).cast("int")

    def _list(self, spark: SparkSession, generation: int) -> dict[int, int] | None:
        """Bucket and the generation that holds it, at most one row per bucket."""
        try:
            rows = spark.read.schema("bucket int, generation long").parquet(
                f"{self.path}/lists/{generation}"
            )
            return {r.bucket: r.generation for r in rows.collect()}
        except AnalysisException as problem:
            if not is_missing(problem):
                raise
            return None

    def _opened(self, spark: SparkSession, held: dict[int, int]) -> DataFrame:
        if not held:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/rows/{g}/bucket={b}" for b, g in sorted(held.items())]
        return spark.read.schema(self.schema).parquet(*paths)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the keys in ``batch``."""
        found = batch.select(self.bucket().alias("bucket")).distinct().collect()
        return sorted(r.bucket for r in found)

    def write(
        self,
        spark: SparkSession,
        generation: int,
        batch: DataFrame,
        change: Callable[[DataFrame], DataFrame],
    ) -> None:
        """Replace the buckets of the keys in ``batch`` by ``change`` of their old rows.

        Generations count up from 0 without gaps. ``change`` gets all rows of these
        buckets, also of keys that are not in ``batch``, and returns all that stay.
        """
        held = self._list(spark, generation - 1) if generation else {}
        if held is None:
            raise ValueError(f"generation {generation - 1} was never written")
        mine = self.touched(batch)
        old = self._opened(spark, {b: held[b] for b in mine if b in held})
        rows = change(old).select(*old.columns).withColumn("bucket", self.bucket())
        target = f"{self.path}/rows/{generation}"
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(target)
        # the partition values alone: a bucket without rows has no folder
        filled = spark.read.schema("bucket int").parquet(target).distinct().collect()
        now = {b: g for b, g in held.items() if b not in mine}
        now |= {r.bucket: generation for r in filled}
        entries = spark.createDataFrame(sorted(now.items()), "bucket int, generation long")
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/{generation}")
        newest = spark.createDataFrame([(generation,)], "generation long")
        newest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/newest")
        if generation > 1:
            older = self._list(spark, generation - 2) or {}
            for gone in set(older.values()) - set(held.values()) - set(now.values()):
                remove_folder(spark, f"{self.path}/rows/{gone}")

    def read(
        self, spark: SparkSession, generation: int, of: DataFrame | None = None
    ) -> DataFrame:
        """Rows after a generation: all, or those in the buckets of the keys in ``of``."""
        held = self._list(spark, generation) or {}
        if of is not None:
            wanted = self.touched(of)
            held = {b: g for b, g in held.items() if b in wanted}
        return self._opened(spark, held)

    def newest(self, spark: SparkSession) -> int:
        """The last generation, -1 for a table that was never written."""
        try:
            return spark.read.schema("generation long").parquet(f"{self.path}/newest").first()[0]
        except AnalysisException as problem:
            if not is_missing(problem):
                raise
            return -1

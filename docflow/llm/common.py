"""What several operators share: words, stored tables, bounded label samples."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow import configure
from docflow.session import remove_folder, run_dir

#: Whole texts reach Python in batches of at most this many bytes.
BATCH_BYTES = 32 * 1024 * 1024


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the library, with batches of whole texts bounded by size."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Each job inside removes its shuffle files once its result is stored.

    For steps that hand on stored tables only; a frame that is executed again
    would repeat its stages.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    Cuts the lineage: what was read by one branch is what all others read, also
    after an executor is lost.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a ``saved`` table that no later step reads."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        remove_folder(table.sparkSession, folder)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shielded(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with all columns but the ``needed`` ones renamed, and new names by old ones.

    The new names are ``own_`` and a number, so no column that is added meets one.
    """
    names = {c: c if c in needed else f"own_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def id_crc(column: str) -> Column:
    """crc32 of an id written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def label_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, chosen by a hash of the id.

    Ids without a label are left out; an id with several labels takes the
    largest. The result has columns ``doc_id`` and ``y`` and at most
    ``2 * per_class`` rows, so it may be broadcast.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return known.where("y = 0").orderBy(*order).limit(per_class).union(
        known.where("y > 0").withColumn("y", F.lit(1)).orderBy(*order).limit(per_class)
    )


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the sampled ids, one row each: of repeated ids the least text."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

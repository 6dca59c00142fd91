"""Content-addressed texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.session import durable, spread
from docflow.sources.keyed import KeyedTable

#: Stored contents are laid out in so many folders by a hash of their id.
BUCKETS = 64


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def content_bucket(cid: Column) -> Column:
    """The folder of a content id, whatever form ids have."""
    return F.pmod(F.crc32(cid), F.lit(BUCKETS)).cast("int")


def only_wanted(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contents cut down to the folders that the ids (``cid``) of ``wanted`` lie in.

    The list of folders is bounded and becomes a partition filter, so that a small batch
    opens a part of the table's files. Contents that are not laid out are read as they are.
    ``wanted`` should be a stored table: it is read once more.
    """
    if "bucket" not in contents.columns:
        return contents
    found = wanted.select(content_bucket(F.col("cid")).alias("bucket")).distinct().collect()
    buckets = sorted(r.bucket for r in found if r.bucket is not None)
    if len(buckets) < BUCKETS:
        contents = contents.where(F.col("bucket").isin(buckets))
    return contents.drop("bucket")


def put_contents(
    df: DataFrame, contents: DataFrame, text: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``cid``, contents rows to append).

    Known ids leave by anti join before the texts are reduced to one per id, a
    reduction that starts inside each map task.
    """
    tagged = df.withColumn("cid", content_id(F.col(text)))
    fresh = tagged.select("cid", F.col(text).alias("content"))
    fresh = fresh.join(contents.select("cid"), "cid", "left_anti")
    return tagged, fresh.dropDuplicates(["cid"])


def dedup_extract(
    df: DataFrame,
    text: str,
    extract: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Run ``extract`` once per distinct text and hand the result to all copies.

    ``extract`` maps (cid, text) rows to rows that keep ``cid``. The join back
    carries no text on the many-rows side; a text with very many copies is cut
    up by adaptive skew splitting.
    """
    tagged = df.withColumn("cid", content_id(F.col(text)))
    distinct = tagged.select("cid", text).dropDuplicates(["cid"])
    return tagged.drop(text).join(extract(distinct), "cid", "left")


def extract_new(
    df: DataFrame,
    text: str,
    extract: Callable[[DataFrame], DataFrame],
    results: KeyedTable,
) -> DataFrame:
    """``dedup_extract`` that keeps its results: what a former call extracted is not sent again.

    ``results`` is a table by ``cid`` with the columns that ``extract`` returns. Texts
    without a row in it are extracted once each and checkpointed, so no later step calls
    the model again, and join the table in the buckets of their ids. Every row of ``df`` gets its
    result from there; ``reused`` tells a former call's from a new one. A text that ``extract``
    returns no row for has a null result and is sent again by the next call. A null text has
    no id, is never sent and has no result.

    The result reads the stored table: write it before the call after the next one.
    """
    spark = df.sparkSession
    last = results.newest(spark)
    tagged = df.withColumn("cid", content_id(F.col(text)))
    ids = tagged.where(F.col("cid").isNotNull()).select("cid")
    distinct = tagged.where(F.col("cid").isNotNull()).select("cid", text).dropDuplicates(["cid"])
    known = results.read(spark, last, ids).select("cid")
    fresh = durable(extract(distinct.join(known, "cid", "left_anti")))
    results.write(
        spark, last + 1, fresh, lambda old: old.unionByName(fresh.select(*old.columns))
    )
    new = fresh.select("cid", F.lit(True).alias("_new"))
    found = results.read(spark, last + 1, ids).join(new, "cid", "left")
    found = found.withColumn("reused", F.col("_new").isNull()).drop("_new")
    return tagged.drop(text).join(spread(found), "cid", "left")

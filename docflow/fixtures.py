"""The engine's input shapes, derived from the given star-schema tables.

All derivations are whole-table and free of global or per-key windows, so they
stay usable at scale: a chunk is ten consecutive order keys, and versions are
ordered by (date, key) instead of being numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.classify import classify_error

CDN = "cdn.example.org"
CHUNK_SIZE = 10
CHUNKS_PER_BATCH = 100
AS_OF = "2001-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(column: str, n: int):
    return F.col(column) % n


def _with_chunk(df: DataFrame, key: str) -> DataFrame:
    chunk = F.floor(F.col(key) / float(CHUNK_SIZE)).cast("long")
    batch = F.floor(F.col("chunk_id") / float(CHUNKS_PER_BATCH)).cast("long")
    return df.withColumn("chunk_id", chunk).withColumn(
        "batch_id", F.concat(F.lit("b"), batch.cast("string"))
    )


def attempts_of(events: DataFrame) -> DataFrame:
    """One extraction attempt per event; works on a stream as well."""
    kind = F.col("event_type")
    message = (
        F.when(kind == "click", "HTTP 429 Too Many Requests")
        .when(
            kind == "signup",
            F.concat(F.lit("Invalid Image Format: item "), F.col("event_id").cast("string")),
        )
        .when((kind == "error") & (_mod("event_id", 3) == 0), "400 Failed to download image")
        .when(kind == "error", "503 upstream timeout")
    )
    result = F.when(kind == "view", "done").when(kind == "purchase", "skipped")
    return events.select(
        F.col("user_id").alias("pi"),
        F.to_date("ts").cast("string").alias("filename"),
        "event_id",
        "ts",
        result.alias("result"),
        message.alias("message"),
    ).withColumn("outcome", F.coalesce("result", classify_error(F.col("message"))))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_of(table(spark, sf_dir, "events"))


def pis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of chunks: one per order."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        key.alias("pi"),
        F.when((F.col("o_orderstatus") == "P") & (key % 7 == 0), "CAS failure").alias(
            "entity_error"
        ),
        F.when(key % 3 == 0, "")
        .when(key % 3 == 1, F.concat(F.lit("tip"), key.cast("string")))
        .alias("new_tip"),
        (key % 3).alias("new_version"),
        "o_orderdate",
    )
    return _with_chunk(orders, "pi")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs with a state: one per (order, line number)."""
    lineitem = table(spark, sf_dir, "lineitem")
    # the two one-letter flags as one number: a numeric maximum is hash-aggregated
    code = F.ascii("l_returnflag") * 256 + F.ascii("l_linestatus")
    grouped = lineitem.groupBy(F.col("l_orderkey").alias("pi"), "l_linenumber").agg(
        F.max(code).alias("code"), F.max("l_partkey").alias("partkey")
    )

    def flags(*names: str):
        return F.col("code").isin([ord(n[0]) * 256 + ord(n[1]) for n in names])

    return _with_chunk(
        grouped.select(
            "pi",
            F.concat(F.col("l_linenumber").cast("string"), F.lit(".ref.json")).alias("filename"),
            F.when(flags("AF", "NF"), "done")
            .when(flags("AO"), "skipped")
            .when(flags("NO"), "pending")
            .otherwise("error")
            .alias("status"),
            F.when(flags("RF"), "503 upstream timeout").alias("error"),
            F.concat(F.lit("cid"), F.col("partkey").cast("string")).alias("result_cid"),
        ),
        "pi",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State row of every chunk, plus chunks without any entity."""
    filled = (
        pis(spark, sf_dir)
        .groupBy("batch_id", "chunk_id")
        .agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("ended_at"))
    )
    epoch = F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))
    empty = table(spark, sf_dir, "nation").select(
        F.lit("empty").alias("batch_id"),
        F.col("n_nationkey").cast("long").alias("chunk_id"),
        epoch.alias("started_at"),
        epoch.alias("ended_at"),
    )
    kind = _mod("chunk_id", 6)
    return filled.unionByName(empty).select(
        "batch_id",
        "chunk_id",
        F.col("started_at").cast("timestamp").alias("started_at"),
        F.when(_mod("chunk_id", 4) != 0, F.col("ended_at").cast("timestamp")).alias("completed_at"),
        F.when(kind == 0, "ERROR")
        .when(kind == 1, "PROCESSING")
        .when(kind == 2, "FETCHING")
        .otherwise("DONE")
        .alias("phase"),
        F.when(kind == 0, F.concat(F.lit("lost "), F.col("chunk_id").cast("string"))).alias(
            "global_error"
        ),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of entities: one per order of a customer, ordered by ``at``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.concat(F.lit("tip"), F.col("o_orderkey").cast("string")).alias("tip"),
        F.struct("o_orderdate", "o_orderkey").alias("at"),
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per version in long form."""
    line = F.col("l_linenumber")
    name = F.when(
        line % 4 == 0, F.concat(F.lit("meta"), line.cast("string"), F.lit(".json"))
    ).otherwise(F.concat(F.lit("img"), line.cast("string"), F.lit(".ref.json")))
    # dealt by order once, as numbers: the aggregate and the join both keep to it
    lines = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_orderkey").isNotNull())
        .select("l_orderkey", "l_linenumber", "l_partkey")
        .repartition("l_orderkey")
    )
    files = (
        lines.groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_partkey").alias("partkey"))
        .select(
            "l_orderkey",
            name.alias("filename"),
            F.concat(F.lit("cid"), F.col("partkey").cast("string")).alias("cid"),
        )
    )
    heads = versions(spark, sf_dir).select("entity", "at", F.col("at.o_orderkey").alias("l_orderkey"))
    return files.join(heads, "l_orderkey").withColumnRenamed("l_orderkey", "version_id")


def part_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ref documents by content id: some absent, some broken, some without url."""
    key = F.col("p_partkey")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ocr = F.when(key % 5 == 0, F.concat(F.lit("text of part "), key.cast("string"))).when(
        key % 17 == 0, ""
    )
    url = F.when(key % 11 == 0, "").otherwise(
        F.concat(F.lit(f"https://{CDN}/asset/01AB"), key.cast("string"), F.lit("/large"))
    )
    document = F.to_json(F.struct(url.alias("url"), key.alias("part"), ocr.alias("ocr")))
    return (
        table(spark, sf_dir, "part")
        .where(key % 19 != 0)
        .select("p_partkey")
        .repartition(tasks, "p_partkey")  # one small file of keys, but many documents
        .select(
            F.concat(F.lit("cid"), key.cast("string")).alias("cid"),
            F.when(key % 13 == 0, '{"part": ').otherwise(document).alias("content"),
        )
    )


def ref_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ref documents built from texts: doc_id, lang, source, text, json."""
    key = F.col("doc_id")
    url = F.when(key % 11 == 0, "").otherwise(
        F.concat(F.lit("https://docs.example.org/"), F.col("source"), F.lit("/"), key.cast("string"))
    )
    ocr = F.when(key % 5 == 0, F.col("text")).when(key % 17 == 0, "")
    document = F.to_json(
        F.struct(
            url.alias("url"), "doc_id", ocr.alias("ocr"), "lang", F.struct("source").alias("extra")
        )
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "text",
        F.when(key % 13 == 0, '{"doc_id": ').otherwise(document).alias("json"),
    )


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image addresses of four kinds, with the page text as payload."""
    key = F.col("page_id")
    asset = F.concat(F.lit(f"{CDN}/asset/01AB"), key.cast("string"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(key % 4 == 0, F.concat(F.lit("https://"), asset, F.lit("/large")))
        .when(key % 4 == 1, F.concat(F.lit("http://"), asset, F.lit("?w=10")))
        .when(key % 4 == 2, F.concat(F.lit(f"https://{CDN}/asset/lower"), key.cast("string")))
        .otherwise(F.col("url"))
        .alias("cdn_url"),
        "html",
    )

"""Token archives: whole texts as id blocks in a table of files, and back.

Rows are written in ascending document order by one range shuffle. Each row of the
archive is a run of whole documents: their ids and counts, and the run's blocks
(see ``idcoder``). Runs are decoded independently, so the archive is read by as many
tasks as it has runs. The table is written by Spark's own writer: a task that is
repeated replaces its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.idcoder import BLOCK, LANES, decode_ids, encode_ids
from docflow.llm.tokens import encoder
from docflow.session import run_dir

END_ID = 2
#: Ids after which a run of documents is closed.
RUN_IDS = BLOCK * LANES // 2
#: Texts given to the tokenizer at once, in characters.
CHUNK_CHARS = 2_000_000

ARCHIVE = (
    "part int, run int, doc_ids array<long>, counts array<long>, n_ids long, n_bytes long, "
    "blocks binary"
)
_FIELDS = [
    ("part", pa.int32()),
    ("run", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())),
    ("n_ids", pa.int64()),
    ("n_bytes", pa.int64()),
    ("blocks", pa.binary()),
]


def _tokenized(batches: Iterator, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    encode = encoder(path)
    tail = np.array([end_id], dtype="<u4")
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
        lengths = np.asarray(texts.is_valid()) * np.nan_to_num(
            texts.fill_null("").to_pandas().str.len().to_numpy()
        )
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // CHUNK_CHARS, prepend=0))
        edges = [0, *cuts.tolist(), len(doc_ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            ids = encode(texts.slice(a, b - a).to_pylist())
            for doc_id, own in zip(doc_ids[a:b], ids, strict=True):
                yield doc_id, np.concatenate((own, tail))


def _runs(batches: Iterator, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, run = TaskContext.get().partitionId(), 0
    held_ids, held, size = [], [], 0

    def close() -> pa.RecordBatch:
        data = encode_ids(np.concatenate(held))
        counts = [len(x) for x in held]
        row = (part, run, held_ids, counts, size, len(data), data)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], type=t) for v, (_, t) in zip(row, _FIELDS, strict=True)],
            names=[n for n, _ in _FIELDS],
        )

    for doc_id, ids in _tokenized(batches, path, end_id):
        held_ids.append(doc_id)
        held.append(ids)
        size += len(ids)
        if size >= RUN_IDS:
            yield close()
            run, held_ids, held, size = run + 1, [], [], 0
    if held:
        yield close()


def write_archive(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None
) -> None:
    """Encode whole texts and write them as an archive in ascending ``doc_id`` order.

    ``docs`` needs doc_id and text; other columns are not read. A null text is
    empty: only the end id. Rows without doc id come first; rows of one id are in the
    order of a hash of their text, so that a shared or missing id spreads over the
    parts. No rows give an empty archive.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        "text",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ("doc_id", "text_hash", "row")
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    encoded = dealt.select("doc_id", "text").mapInArrow(lambda batches: _runs(batches, tokenizer, end_id), ARCHIVE)
    encoded.write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_ids(row["blocks"])
            stops = np.cumsum(row["counts"])
            crcs = [
                zlib.crc32(ids[stop - count : stop].tobytes())
                for stop, count in zip(stops.tolist(), row["counts"], strict=True)
            ]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["run"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(stops - np.array(row["counts"]), pa.int64()),
                    pa.array(row["counts"], pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                names=["part", "run", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def archive_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the decoded blocks.

    ``start`` counts the ids of all documents before it. Only per-run and per-part
    totals are summed up: a run holds about ``RUN_IDS`` ids, a part is one task of the writer.
    """
    archive = spark.read.schema(ARCHIVE).parquet(path)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = archive.groupBy("part").agg(F.sum("n_ids").alias("n"))
    by_part = before.orderBy("part")
    offsets = totals.select(
        "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("part_start")
    )
    by_run = before.partitionBy("part").orderBy("run")
    runs = (
        archive.select("part", "run", "n_ids")
        .withColumn("run_start", F.coalesce(F.sum("n_ids").over(by_run), F.lit(0)))
        .join(offsets, "part")
        .select("part", "run", (F.col("run_start") + F.col("part_start")).alias("run_start"))
    )
    schema = (
        "part int, run int, doc_id long, within long, n_tokens long, ids_crc32 long"
    )
    rows = archive.select("part", "run", "doc_ids", "counts", "blocks").mapInArrow(
        _documents, schema
    )
    return rows.join(runs, ["part", "run"]).select(
        "doc_id", (F.col("run_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write an archive below the shared folder and read its documents back."""
    spark = docs.sparkSession
    path = run_dir(spark, "token-archive")
    write_archive(docs, path, tokenizer)
    return archive_documents(spark, path)
